"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence where its own neighbourhood says so: runs of
one symbol become one symbol, each symbol is relabelled by the lowest bit in which it
differs from its left neighbour until six labels are left, and local maxima of the
labels begin phrases of 2 to about 12 symbols. A phrase is named by its content, and
the names are the symbols of the next level. A phrase depends on a few symbols around it
only, so equal substrings get equal phrases inside, wherever they stand.

A fingerprint keeps the smallest hashes of the distinct phrase names of one level; two
fingerprints estimate the Jaccard likeness of the two phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm import cluster

LEVELS = 3
SIZE = 128
BATCH_BYTES = 2_000_000

_LOW_BIT = np.array([0 if not v else (v & -v).bit_length() - 1 for v in range(256)], np.uint8)


def _lowest(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of each value, which is not 0."""
    if x.dtype == np.uint8:
        return _LOW_BIT[x]
    low = (x & (~x + np.uint64(1))).astype(np.float64)
    return ((low.view(np.uint64) >> np.uint64(52)) - np.uint64(1023)).astype(np.uint8)


def _labels(symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, unlike in neighbours; symbols: unlike in neighbours, heads: where rows begin."""
    labels, bits = symbols, 8 * symbols.dtype.itemsize
    while bits > 3:
        apart = np.empty_like(labels)
        apart[1:] = labels[1:] ^ labels[:-1]
        apart[heads] = 1  # the symbol before a row counts as differing in the lowest bit
        low = _lowest(apart)
        bit = ((labels >> low.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)
        labels = (low << 1) | bit
        bits = (2 * bits - 1).bit_length()
    apart = np.empty_like(labels)
    apart[1:] = labels[1:] ^ labels[:-1]
    apart[heads] = 1
    low = _LOW_BIT[apart]
    return (low << 1) | ((labels >> low) & 1)


def _next_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each row, and where the rows begin among them."""
    heads = first[:-1][np.diff(first) > 0]
    new = np.empty(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[heads] = True
    at_ = np.flatnonzero(new)
    if len(at_) < len(symbols):  # a run of one symbol becomes one symbol
        length = np.diff(np.concatenate((at_, [len(symbols)])))
        wide = symbols[at_].astype(np.uint64)
        many = length > 1
        wide[many] = at.mix(wide[many] + at.ODD * length[many].astype(np.uint64))
        first = np.searchsorted(at_, first)
        heads = first[:-1][np.diff(first) > 0]
        if symbols.dtype == np.uint8:
            # Neighbours must differ as coin tossing sees them, and they do: runs are of unlike symbols.
            labels = _labels(np.ascontiguousarray(symbols[at_]), heads)
        else:
            labels = _labels(wide, heads)
    else:
        wide = symbols.astype(np.uint64)
        labels = _labels(symbols, heads)
    top = np.zeros(len(labels), bool)
    top[1:] = labels[1:] > labels[:-1]
    top[:-1] &= labels[:-1] > labels[1:]
    top[heads[heads > 0] - 1] = False  # the last symbol of a row begins no phrase of its own
    top[-1] = False
    top[heads] = True
    begin = np.flatnonzero(top)
    size = np.diff(np.concatenate((begin, [len(wide)])))
    place = np.arange(1, len(wide) + 1) - np.repeat(begin, size)
    names = at.mix(np.add.reduceat(at.mix(wide + at.ODD * place.astype(np.uint64)), begin) + size.astype(np.uint64))
    return names, np.searchsorted(begin, first)


def sketches(texts: pa.Array, levels: int = LEVELS, size: int = SIZE) -> list[np.ndarray]:
    """The smallest `size` 32-bit hashes of each text's phrase names, sorted."""
    symbols, first = at.raw(texts)
    for _ in range(levels):
        if len(symbols):
            symbols, first = _next_level(symbols, first)
    out = []
    short = (symbols >> np.uint64(32)).astype(np.uint32) if len(symbols) else np.zeros(0, np.uint32)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(short[a:b])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own[:size])
    return out


def likeness(x: np.ndarray, y: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard likeness of two phrase sets; exact while both have at most `size` names. Two empty sets: 1."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate((x, y)))
    twice = both[1:] == both[:-1]
    n = len(both) - int(twice.sum())
    if n <= size:
        return int(twice.sum()) / n
    # The smallest `size` of the union: its i-th distinct value stands at the i-th new one.
    new = np.concatenate(([True], ~twice))
    last = both[np.flatnonzero(new)[size - 1]]
    return int((both[1:][twice] <= last).sum()) / size


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def _edits(levels: int, size: int):
    """Rows in order of descending doc_id; a last row with look is the document after them."""

    def rows(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        """texts: one more than ids."""
        edited = []
        for here, after in zip(texts, texts[1:], strict=False):
            k = len(here) // 3
            edited.append(here[: len(here) - k] + after[:k])
        prints = sketches(pa.array([*texts, *edited], pa.large_string()), levels, size)
        own, other = prints[: len(texts)], prints[len(texts) :]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array([_hex(x) for x in own[:-1]]),
            pa.array([_hex(x) for x in other]),
            pa.array([likeness(x, y, size) for x, y in zip(own, other, strict=False)], pa.float64()),
            pa.array([likeness(x, y, size) for x, y in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        for table in at.batches(frames, "text", BATCH_BYTES):
            for i, text, look in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("look").to_pylist(), strict=True):
                if not look:
                    ids.append(i)
                    texts.append(text)
                elif ids:  # the part ends here; more rows of the same look are of the same id
                    yield rows(ids, [*texts, text])
                    ids, texts = [], []
            if len(ids) > 1:
                yield rows(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]
        assert not ids, "every part ends with the document after it"

    return run


def _part(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are above an id: a tree of comparisons."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(len(cuts) - lo)
        middle = (lo + hi) // 2
        return F.when(doc_id < cuts[middle], below(lo, middle)).otherwise(below(middle + 1, hi))

    return below(0, len(cuts)).cast("int")


def edit_fingerprints(docs: DataFrame, levels: int = LEVELS, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its text edited with the next document's.

    docs needs doc_id (integer) and text (null: empty); other columns are not read. The next
    document has the next smaller doc_id; after the smallest comes the largest. The
    edited text has its last floor(n_chars / 3) code points replaced by as many first ones of
    the next text, or all that it has. Returns a row a row: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Rows that
    repeat a doc_id follow each other by text. Rows with a null doc_id have no place
    in the order and are left out. An empty table gives an empty result; a single document
    is its own next. Fingerprints are hex strings of sorted 32-bit values; empty texts have none.
    """
    spark = docs.sparkSession
    cluster.short_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    n = cluster.partitions(spark)
    # Some n ids on the driver, as a range partitioner holds them.
    cuts = np.array(sorted(set(keyed.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else [], np.float64).astype(np.int64)

    part = _part(F.col("doc_id"), cuts.tolist())
    heads = {r.part: r.head for r in keyed.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    full = sorted(heads)
    # A part's first document is also what follows the part before it. A row a part: its first document, and the part before.
    before = spark.createDataFrame([(heads[p], full[i - 1]) for i, p in enumerate(full)], "head bigint, before int")
    places = F.filter(F.array(part, F.col("before")), lambda p: p.isNotNull())
    dealt = keyed.join(F.broadcast(before), F.col("doc_id") == F.col("head"), "left").select("doc_id", "text", F.posexplode(places).alias("look", "part"))
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "look", F.col("doc_id").desc(), "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_edits(levels, size), schema)
