"""Quality scores by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words (A-Z lower-cased) and the shapes of its words: letters
become one letter, digits one digit, other signs stay; and pairs of shapes of words that
follow each other, where a word said twice is a pair of its own. Terms are hashed into a fixed number
of columns, weighted by log counts and inverse document frequency over all documents, and
projected on the leading right singular vectors of a bounded sample of labelled texts. The
sample's vectors, whose size is fixed, go to every task. A document takes exact cosines with all of them, in
blocks, and its nearest neighbours vote with the weight of their similarity, times the number of
labelled documents that a sampled one of its label stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as at
from tessera.llm import cluster

WORDS, SHAPES, PAIRS = 2560, 512, 1024  # hashed columns
WIDTH = WORDS + SHAPES + PAIRS
RANK = 48
SAMPLE = 2_000  # labelled texts of each label that the model is fitted on
NEIGHBOURS = 25
POWER = 4
THRESHOLD = 0.3
BATCH_BYTES = 2_000_000
BLOCK = 256

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: one in five, by its id."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _shapes(vocabulary: pa.Array) -> np.ndarray:
    """Column of each word's shape: its bytes by kind, repeats as one."""
    data, first = at.raw(vocabulary)
    if not len(first) - 1:
        return np.zeros(0, np.int64)
    kind = _SHAPE[data]
    new = np.empty(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[first[:-1]] = True
    spots = np.flatnonzero(new)
    heads = np.searchsorted(spots, first[:-1])
    place = np.arange(len(spots)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(spots)]))))
    names = np.add.reduceat(at.mix(kind[spots].astype(np.uint64) + at.ODD * (place + 1).astype(np.uint64)), heads)
    return (at.mix(names) % np.uint64(SHAPES)).astype(np.int64)


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Term counts of blocks of texts, a row a text: columns of words, of shapes, of pairs."""
    w = at.words(texts)
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter((digest(x.lower()) % WORDS for x in w.vocabulary.to_pylist()), np.int64, len(w.vocabulary))
    rows, shape = w.rows(), _shapes(w.vocabulary)
    own, look = (word[w.codes], shape[w.codes]) if len(w.codes) else (w.codes, w.codes)
    pair = np.full(len(own), -1)
    if len(own):
        after = at.mix((look[:-1] * SHAPES + look[1:]).astype(np.uint64)) % np.uint64(PAIRS - 1)
        pair[1:] = np.where(rows[1:] != rows[:-1], -1, np.where(w.codes[1:] == w.codes[:-1], 0, after.astype(np.int64) + 1))
    for lo in range(0, len(w.first) - 1, BLOCK):
        hi = min(lo + BLOCK, len(w.first) - 1)
        a, b = w.first[lo], w.first[hi]
        base = (rows[a:b] - lo) * WIDTH
        size = (hi - lo) * WIDTH
        two = pair[a:b] >= 0
        terms = np.concatenate((base + own[a:b], base + WORDS + look[a:b], base[two] + WORDS + SHAPES + pair[a:b][two]))
        yield np.bincount(terms, minlength=size).reshape(hi - lo, WIDTH).astype(np.float32)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows in which words, shapes and pairs have equal weight."""
    x = np.log1p(tf) * idf
    for part in np.split(x, [WORDS, WORDS + SHAPES], axis=1):
        norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
        part /= np.maximum(norm, 1e-12)
    return x


def _frequencies(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term in a task, as one row."""
    df, n = np.zeros(WIDTH, np.int64), 0
    for table in at.batches(frames, "text", BATCH_BYTES):
        for tf in counts(at.chunk(table, "text")):
            df += (tf > 0).sum(axis=0)
            n += len(tf)
    yield pa.RecordBatch.from_arrays([pa.array([*range(WIDTH), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["term", "n"])


def _sparse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in at.batches(frames, "text", BATCH_BYTES):
        terms, values = [], []
        for tf in counts(at.chunk(table, "text")):
            for row in tf:
                spots = np.flatnonzero(row)
                terms.append(spots.astype(np.uint16).tobytes())
                values.append(row[spots].tobytes())
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("quality").combine_chunks(), pa.array(terms, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "quality", "terms", "tf"])


@dataclass
class Sample:
    """Term counts of texts, a row a text, without the zeros."""

    first: np.ndarray  # where each row's terms begin, and the end of the last one
    terms: np.ndarray
    tf: np.ndarray

    def blocks(self, idf: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Weighted rows, some at a time: the whole sample is never dense."""
        for lo in range(0, len(self.first) - 1, BLOCK):
            hi = min(lo + BLOCK, len(self.first) - 1)
            x = np.zeros((hi - lo, WIDTH), np.float32)
            own = slice(self.first[lo], self.first[hi])
            x[np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1])), self.terms[own]] = self.tf[own]
            yield slice(lo, hi), weighted(x, idf)


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray  # of the sample's rows; what all texts share doesn't make two of them alike
    axes: np.ndarray  # WIDTH x rank
    vectors: np.ndarray  # of the sample, unit rows
    labels: np.ndarray
    prior: float
    stands_for: np.ndarray  # labelled documents a sampled one, of each row of the sample

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (x - self.mean) @ self.axes
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def neighbours(self) -> int:
        """As many as NEIGHBOURS, but no more than the rarer label has."""
        return max(1, min(NEIGHBOURS, *(int((self.labels == y).sum()) for y in (0, 1))))

    def scores(self, tf: np.ndarray) -> np.ndarray:
        """Share of the vote for label 1 of each row of counts; the prior where nothing is known.

        Cosines count to six places. Neighbours tied for the last places share them evenly.
        """
        if not len(self.labels):
            return np.full(len(tf), self.prior)
        cosine = np.rint(self.latent(weighted(tf, self.idf)) @ self.vectors.T * np.float32(1e6)).astype(np.int32)
        k, n = self.neighbours(), len(self.labels)
        last = np.partition(cosine, n - k, axis=1)[:, n - k, None]
        row, at_ = np.nonzero(cosine >= last)
        found = cosine[row, at_]
        tied = found == last[row, 0]
        rows = len(tf)
        over, ties = np.bincount(row[~tied], minlength=rows), np.bincount(row[tied], minlength=rows)
        weight = (np.maximum(found, 0) / 1e6) ** POWER * self.stands_for[at_] * np.where(tied, ((k - over) / ties)[row], 1.0)
        total, vote = np.bincount(row, weight, rows), np.bincount(row, weight * self.labels[at_], rows)
        return np.where((total > 1e-9) & (tf.any(axis=1)), vote / np.maximum(total, 1e-9), self.prior)


def fit(sample: Sample, labels: np.ndarray, df: np.ndarray, n: int, prior: float, known: dict[int, int]) -> Model:
    """A model of a sample; known: labelled documents of each label that it was drawn from."""
    stands_for = np.ones(len(labels))
    for y, size in known.items():
        stands_for[labels == y] = size / max(1, int((labels == y).sum()))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)
    if not len(labels):
        return Model(idf, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior, stands_for)
    mean = sum(x.sum(axis=0, dtype=np.float64) for _, x in sample.blocks(idf)) / len(labels)
    mean = mean.astype(np.float32)
    rank = min(RANK, len(labels), WIDTH)
    z = np.random.default_rng(7).standard_normal((WIDTH, min(rank + 16, WIDTH)), dtype=np.float32)
    for _ in range(5):  # subspace iteration: the leading right singular vectors
        y = np.concatenate([(x - mean) @ z for _, x in sample.blocks(idf)])
        y = np.linalg.qr(y)[0]
        z = sum((x - mean).T @ y[at_] for at_, x in sample.blocks(idf))
    u, _, _ = np.linalg.svd(z, full_matrices=False)
    axes = np.ascontiguousarray(u[:, :rank].astype(np.float32))
    model = Model(idf, mean, axes, np.zeros((0, rank), np.float32), labels.astype(np.float64), prior, stands_for)
    model.vectors = np.concatenate([model.latent(x) for _, x in sample.blocks(idf)])
    return model


def _score(model: Model, names: list[str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in at.batches(frames, "text", BATCH_BYTES):
            scores = np.concatenate([model.scores(tf) for tf in counts(at.chunk(table, "text"))])
            scores = np.clip(scores, 0, 1)
            yield pa.RecordBatch.from_arrays([*(at.chunk(table, c) for c in names), pa.array(scores), pa.array(scores >= THRESHOLD).cast(pa.int32())], [*names, "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of at most SAMPLE labelled texts of each label, by a hash of their id; term frequencies are of all documents."""
    seen = {r.term: r.n for r in docs.select("text").mapInArrow(_frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # WIDTH rows
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    # Each task keeps SAMPLE ids of a label at most, however common it is.
    first = lambda label: known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = first(0).unionByName(first(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_sparse, "doc_id bigint, quality int, terms binary, tf binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("terms", "tf", "quality")).alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect()
    terms = [np.frombuffer(r.terms, np.uint16) for r in rows]
    first = np.cumsum([0, *map(len, terms)])
    found = Sample(first, np.concatenate([*terms, np.zeros(0, np.uint16)]), np.concatenate([*(np.frombuffer(r.tf, np.float32) for r in rows), np.zeros(0, np.float32)]))
    df = np.array([seen.get(i, 0) for i in range(WIDTH)], np.float64)
    return fit(found, np.array([r.quality for r in rows], np.float64), df, seen.get(-1, 0), prior, sizes)


def score(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """Quality of every text as labels.quality marks it.

    docs needs doc_id and text, labels doc_id and quality (0 or 1; other values and null
    are no label; of labels that repeat an id the smallest counts). Labels of held-out ids are
    never used. Returns a row a row: doc_id, held_out, score (0 to 1, higher: label 1
    likelier), predicted (1 if score >= THRESHOLD); with carry also row, a struct
    of all columns of docs. Null, empty and wordless texts, and all texts where nothing was
    learned, score the share of label 1. A null doc_id is not held out. Rows that repeat a doc_id
    are scored each by its text; its label counts once, for the text that comes first by its terms.
    Equal texts have equal scores: neighbours tied for the last places share them.
    """
    cluster.short_batches(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    ).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = learn(own.filter("doc_id is not null"), labels)
    names = ["doc_id", "held_out", *(["row"] if carry else [])]
    schema = T.StructType([T.StructField(c, own.schema[c].dataType) for c in names]).add("score", "double").add("predicted", "integer")
    return own.select(*names, "text").mapInArrow(_score(model, names), schema)
