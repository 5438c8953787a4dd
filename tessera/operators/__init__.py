"""DataFrame to DataFrame operators. None of them collects a table; every order ends with a unique key."""
