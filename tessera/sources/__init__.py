"""Readers: everything goes through Spark's own file sources, so any store that Spark reads will do."""
