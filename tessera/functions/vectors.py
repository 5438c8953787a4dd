"""Vector arithmetic and deterministic embeddings as Column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from tessera.functions.core import let

DIMS = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors without a direction or of unlike lengths."""
    return let(norm(a) * norm(b), lambda n: F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n))


def unit(a: Column) -> Column:
    """The vector at length 1; null for one without a direction."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


_WORD = re.compile(r"\w+")


def embedded(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Rows for texts: the unit sum of a pseudo-random direction for each word."""
    found = [_WORD.findall(t.lower()) for t in texts]
    code: dict[str, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for words_ in found for w in words_), np.int64)
    digests = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in code)
    # A word's direction: its digest, scrambled once for each axis.
    h = np.frombuffer(digests, "<u8")[:, None] + np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    direction = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0
    out = np.zeros((len(texts), dims))
    first = 0
    for i, words_ in enumerate(found):
        if words_:
            out[i] = direction[codes[first : first + len(words_)]].sum(axis=0)
            first += len(words_)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


@F.pandas_udf(types.ArrayType(types.DoubleType()))
def _embedded(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, dims in texts:
        yield pd.Series(list(embedded(text.fillna("").tolist(), int(dims.iloc[0]))) if len(text) else [], dtype=object)


def hash_embedding(c: Column, dims: int = DIMS) -> Column:
    """Unit sum of a pseudo-random direction for each word; zero for a text without words. Words are hashed once a batch."""
    return _embedded(c, F.lit(dims))


def sparse_counts(c: Column) -> Column:
    """map<term, count> of a text's words."""
    count = lambda own: F.map_from_arrays(F.array_distinct(own), F.transform(F.array_distinct(own), lambda w: F.size(F.filter(own, lambda x: x == w)).cast("double")))
    return let(words(c), count)


def int8(v: Column, top: Column) -> Column:
    """Components as whole numbers from -127 to 127, scaled by a positive bound."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / top * 127).cast("int"))))


def of_dims(v: Column, dims: int) -> Column:
    """The vector itself; fails the query if its length differs."""
    return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, got "), F.size(v).cast("string"))))
