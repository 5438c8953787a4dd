"""Toxicity scores by gradient-boosted trees over few dense features, calibrated by isotonic regression.

The features of a text are densities of words of a lexicon, how many of these stand near a word that
addresses the reader, and rates of capitals, punctuation and disguised spellings. The lexicon is learned: words
and beginnings of words that toxic texts hold more often than others by more than chance would give, spellings
undisguised first. Trees must not see a text through a lexicon that knows its label, so labelled texts are in folds,
a text's features come from the lexicon of the other folds, and the calibration from trees of the
other folds. All is fitted on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as at
from tessera.llm import cluster
from tessera.llm.quality import held_out

SAMPLE = 4_000  # labelled texts of each label that the model is fitted on
UNITS = 20_000  # words and beginnings in the lexicon
FOLDS = 5
PREFIXES = (4, 5, 6, 7)
NEAR = 5  # words between a lexicon word and the reader's address
STRONG = 1.5  # weight of a word that counts as strong
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 64, 5
THRESHOLD = 0.5
BATCH_BYTES = 2_000_000
REMEMBERED = 200_000  # distinct words that a task keeps the weights of

# Words that address the reader, common insults, and signs that stand for letters.
ADDRESS = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split()
)
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless disgusting trash garbage scum clown fool fools jerk jerks ugly shut hate bastard bitch asshole crap damn hell freak creep filthy vermin "
    "idiotisch dumm dummkopf trottel depp versager abschaum arschloch mistkerl ekelhaft wertlos erbärmlich hässlich hasse "
    "idiote stupide imbécile crétin connard salaud ordure minable pathétique dégoûtant nul abruti débile haine "
    "idiota estúpido estúpida imbécil tonto tonta basura asqueroso patético inútil payaso escoria odio cabrón".split()
)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"})

_EDGE = string.punctuation + "«»“”‘’„¡¿…–—"
_LONG = re.compile(r"([^\W\d])\1\1+")
_JOINER = frozenset("'’-‐‑")

NAMES = (
    "words", "hits", "hit_rate", "strong", "strong_rate", "most", "total", "insult_rate", "near_address", "address_rate",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "disguised_rate", "disguised_hits",
)


def undisguised(word: str) -> tuple[str, bool]:
    """The letters of a word in lower case, and whether signs, digits or repeats hid them."""
    w = word.lower()
    if not w.isalpha():
        w = w.strip(_EDGE)
        if not w.isalpha():
            inner = {c for c in w if not c.isalpha()}
            if len(inner) == len(set(w)):
                return "", False
            if inner <= _JOINER:
                return "".join(c for c in w if c.isalpha()), False
            return _LONG.sub(r"\1", "".join(c for c in w.translate(_LEET) if c.isalpha())), True
    if len(w) - len(set(w)) < 2:  # no letter three times
        return w, False
    short = _LONG.sub(r"\1", w)
    return short, short != w


def units(word: str) -> list[str]:
    """What a lexicon may hold of an undisguised word: itself, and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def _units_of(texts: pa.Array, group: np.ndarray, groups: int) -> tuple[list[str], np.ndarray]:
    """Units of a batch and how many texts of each group hold them (units x groups)."""
    w = at.words(texts)
    known: dict[str, int] = {}
    own = [[known.setdefault(u, len(known)) for u in units(undisguised(x.decode())[0])] for x in w.vocabulary.to_pylist()]
    n = np.fromiter(map(len, own), np.int64, len(own))
    flat = np.fromiter((u for x in own for u in x), np.int64, int(n.sum()))
    codes = w.codes.astype(np.int64)
    each = n[codes] if len(codes) else codes
    spots = np.repeat((np.cumsum(n) - n)[codes] - (np.cumsum(each) - each), each) + np.arange(int(each.sum())) if len(codes) else codes
    pairs = np.unique(np.repeat(w.rows(), each) * max(1, len(known)) + flat[spots])
    doc, unit = pairs // max(1, len(known)), pairs % max(1, len(known))
    return list(known), np.bincount(unit * groups + group[doc], minlength=len(known) * groups).reshape(len(known), groups)


def _lexicon_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in at.batches(frames, "text", BATCH_BYTES):
        group = at.chunk(table, "fold").to_numpy() * 2 + at.chunk(table, "toxic").to_numpy()
        names, n = _units_of(at.chunk(table, "text"), group.astype(np.int64), 2 * FOLDS)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(n[:, i]) for i in range(2 * FOLDS))], ["unit", *(f"n{i}" for i in range(2 * FOLDS))])


def weights(holding: np.ndarray, others: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log odds ratio less one standard error of units held by so many toxic and other texts, of so many; 0 where chance would do."""
    ratio = np.log((holding + 0.5) / (toxic + 1)) - np.log((others + 0.5) / (clean + 1))
    error = np.sqrt(1 / (holding + 0.5) + 1 / (others + 0.5))
    return np.where((holding >= 2) & (ratio > 2 * error), ratio - error, 0.0)


class Lexicon:
    """Weights of words by their units, a column each for every way of weighing, and what else is told of a word by its letters."""

    def __init__(self, units_: list[str], table: np.ndarray) -> None:
        self.units, self.table = {u: i for i, u in enumerate(units_)}, table
        self.starts = {u[: PREFIXES[0]].rstrip("*") for u in self.units}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.weight, self.marks = np.zeros((0, self.table.shape[1])), np.zeros((0, 4), bool)

    def __reduce__(self):
        return Lexicon, (list(self.units), self.table)

    def __call__(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its weights, and whether it addresses the reader, insults, is in capitals, is disguised. Words of earlier batches are remembered, up to a bound."""
        if len(self.place) > REMEMBERED:
            self._forget()
        new = [x for x in vocabulary if x not in self.place]
        weight, marks = np.zeros((len(new), self.table.shape[1])), []
        for i, raw in enumerate(new, len(self.place)):
            self.place[raw] = i
            spelled = raw.decode()
            plain, hidden = undisguised(spelled)
            marks.append((plain in ADDRESS, plain in INSULTS, len(spelled) > 1 and spelled.isupper(), hidden))
            if plain[: PREFIXES[0]] in self.starts and (held := [self.units[u] for u in units(plain) if u in self.units]):
                weight[i - len(self.weight)] = self.table[held].max(axis=0)
        marks = np.array(marks, bool).reshape(-1, 4)
        self.weight, self.marks = np.concatenate((self.weight, weight)), np.concatenate((self.marks, marks))
        spots = np.fromiter(map(self.place.__getitem__, vocabulary), np.int64, len(vocabulary))
        return self.weight[spots], self.marks[spots]


def features(texts: pa.Array, lexicon: Lexicon, column: np.ndarray) -> np.ndarray:
    """A row of NAMES a text. column: which of the lexicon's ways of weighing counts for each text."""
    w = at.words(texts)
    rows, codes, n = w.rows(), w.codes, len(w.first) - 1
    words = np.diff(w.first).astype(float)
    add = lambda x: np.bincount(rows, x, n)
    if not len(codes):
        return np.zeros((n, len(NAMES)))
    best, marks = lexicon(w.vocabulary.to_pylist())
    weight = best[codes, column[rows]]
    hit, strong = weight > 0, weight >= STRONG
    address, insult, upper, hidden = marks[codes].T
    marked = strong | insult
    spots, mine = np.flatnonzero(address), np.flatnonzero(marked)
    near = np.zeros(len(codes), bool)
    if len(spots) and len(mine):
        for side in (-1, 0):
            other = spots[np.clip(np.searchsorted(spots, mine) + side, 0, len(spots) - 1)]
            near[mine] |= (np.abs(other - mine) <= NEAR) & (rows[other] == rows[mine])
    most = np.zeros(n)
    np.maximum.at(most, rows, weight)
    data, offsets = at.raw(texts)
    each = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets]).astype(float)
    big = (data >= 65) & (data <= 90)
    small = (data >= 97) & (data <= 122)
    sign = (data > 32) & (data < 127) & ~big & ~small & ~((data >= 48) & (data <= 57))
    calls, asks = data == ord("!"), data == ord("?")
    per = np.maximum(words, 1)
    return np.column_stack((
        np.log1p(words), np.log1p(add(hit)), add(hit) / per, np.log1p(add(strong)), add(strong) / per, most, add(weight) / np.sqrt(per), add(insult) / per, np.log1p(add(near)), add(address) / per,
        each(big) / np.maximum(each(big | small), 1), add(upper) / per, each(calls) / per, each(asks) / per, each(sign & ~calls & ~asks) / per, add(hidden) / per, np.log1p(add(hidden & marked)),
    ))


@dataclass
class Tree:
    """A full binary tree: node i has children 2i + 1 and 2i + 2; a feature of -1 sends all to the left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # of the leaves

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = self.feature[node]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node])
            node = 2 * node + 1 + right
        return self.value[node - (2**DEPTH - 1)]


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> Tree:
    """One tree for the gradients, by histograms of binned features."""
    inner = 2**DEPTH - 1
    feature, cut = np.full(inner, -1), np.zeros(inner)
    node = np.zeros(len(x), np.int64)
    gain_of = lambda g, h: g * g / (h + 1)
    for level in range(DEPTH):
        base, width = 2**level - 1, 2**level
        local = node - base
        best = np.full(width, 1e-6)
        for f in range(x.shape[1]):
            at_ = local * BINS + bins[:, f]
            g, h, c = (np.cumsum(np.bincount(at_, v, width * BINS).reshape(width, BINS), axis=1) for v in (slope, curve, np.ones(len(x))))
            gain = gain_of(g, h) + gain_of(g[:, -1:] - g, h[:, -1:] - h) - gain_of(g[:, -1:], h[:, -1:])
            gain[(c < LEAF) | (c[:, -1:] - c < LEAF)] = 0
            top = gain.argmax(axis=1)
            better = gain[np.arange(width), top] > best
            for i in np.flatnonzero(better):
                best[i] = gain[i, top[i]]
                feature[base + i], cut[base + i] = f, edges[f][min(top[i], len(edges[f]) - 1)]
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]))
    leaf = node - inner
    return Tree(feature, cut, -RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + 1))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[Tree]]:
    """Start and trees of the log odds of y."""
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    raw, trees = np.full(len(x), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        trees.append(_grow(x, bins, edges, weight * (p - y), weight * p * (1 - p)))
        raw = raw + trees[-1](x)
    return start, trees


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising function of raw nearest to y: mean place and level of each block."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted raw, weighted y
    values, spots = np.unique(raw[order], return_inverse=True)
    w, wy = np.bincount(spots, weight[order]), np.bincount(spots, (weight * y)[order])
    for a, b, c in zip(w, w * values, wy, strict=True):
        blocks.append([a, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[0] for b in blocks]), np.array([b[2] / b[0] for b in blocks])


@dataclass
class Model:
    prior: float
    lexicon: Lexicon | None = None
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    levels: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.levels is None:
            return np.full(len(texts), self.prior)
        x = features(texts, self.lexicon, np.zeros(len(texts), np.int64))
        return np.clip(np.interp(self.raw(x), *self.levels), 0, 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t(x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> tuple[float, list[Tree], tuple[np.ndarray, np.ndarray]]:
    """Trees of all rows, and levels from trees that haven't seen the row that they judge."""
    weight = weight / weight.mean()
    raw = np.zeros(len(x))
    for k in range(FOLDS):
        other = fold != k
        if other.all():
            continue
        start, trees = boost(x[other], y[other], weight[other])
        raw[~other] = start + sum(t(x[~other]) for t in trees)
    return *boost(x, y, weight), isotonic(raw, y, weight)


def _featured(lexicon: Lexicon):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in at.batches(frames, "text", BATCH_BYTES):
            x = features(at.chunk(t, "text"), lexicon, at.chunk(t, "fold").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([at.chunk(t, "doc_id"), at.chunk(t, "toxic"), at.chunk(t, "fold"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "toxic", "fold", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of at most SAMPLE distinct labelled texts of each label, the first by a hash of their id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.0
    if len(sizes) < 2:
        return Model(prior)
    # A text that is copied a thousand times tells no more than once; texts themselves aren't shuffled for that.
    named = docs.select("doc_id", F.xxhash64("text").alias("name")).join(known, "doc_id")
    distinct = named.groupBy("name").agg(F.min(F.struct(F.xxhash64("doc_id").alias("o"), "doc_id", "toxic")).alias("x")).select("name", "x.*")
    first = lambda label: distinct.filter(F.col("toxic") == label).orderBy("o", "name").limit(SAMPLE)
    chosen = first(0).unionByName(first(1)).select("name", "doc_id", "toxic", F.pmod(F.xxhash64("name"), F.lit(FOLDS)).cast("int").alias("fold"))
    met = docs.select("doc_id", F.xxhash64("text").alias("name"), "text").join(F.broadcast(chosen), ["doc_id", "name"])
    sample = cluster.cut(met.groupBy("doc_id", "name").agg(F.first(F.struct("text", "toxic", "fold")).alias("x")).select("doc_id", "x.*"))
    columns = [f"n{i}" for i in range(2 * FOLDS)]
    counts = sample.select("text", "toxic", "fold").mapInArrow(_lexicon_counts, "unit string, " + ", ".join(f"{c} bigint" for c in columns))
    counts = counts.groupBy("unit").agg(*(F.sum(c).alias(c) for c in columns))
    toxic, clean = (sum((F.col(f"n{2 * k + y}") for k in range(FOLDS)), F.lit(0)) for y in (1, 0))
    seen = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    of = {y: sum(seen.get((k, y), 0) for k in range(FOLDS)) for y in (0, 1)}
    lift = F.log((toxic + 0.5) / (of[1] + 1)) - F.log((clean + 0.5) / (of[0] + 1))
    telling = counts.filter(toxic >= 2).withColumn("z", lift / F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))).filter("z > 1").orderBy(F.desc("z"), "unit").limit(UNITS).collect()
    telling.sort(key=lambda r: r.unit)
    n = np.array([[r[c] for c in columns] for r in telling], float).reshape(-1, FOLDS, 2)
    table = np.zeros((len(telling), FOLDS + 1))
    for k in range(FOLDS + 1):  # the lexicon without fold k, and the whole one
        left = [j for j in range(FOLDS) if j != k]
        texts = [sum(seen.get((j, y), 0) for j in left) for y in (1, 0)]
        table[:, k] = weights(n[:, left, 1].sum(axis=1), n[:, left, 0].sum(axis=1), *texts)
    names = [r.unit for r in telling]
    rows = sample.mapInArrow(_featured(Lexicon(names, table)), "doc_id bigint, toxic int, fold int, x binary").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r.x) for r in rows])
    y, fold = np.array([r.toxic for r in rows], float), np.array([r.fold for r in rows])
    share = np.array([sizes[k] / max(1, of[k]) for k in (0, 1)])  # labelled texts that one of the sample stands for
    if not (of[0] and of[1]):
        return Model(prior)
    start, trees, levels = fit(x, y, fold, share[y.astype(int)])
    kept = np.flatnonzero(table[:, -1])
    return Model(prior, Lexicon([names[i] for i in kept], table[kept][:, -1:]), start, trees, levels)


def _score(model: Model, names: list[str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in at.batches(frames, "text", BATCH_BYTES):
            scores = model.scores(at.chunk(table, "text"))
            yield pa.RecordBatch.from_arrays([*(at.chunk(table, c) for c in names), pa.array(scores), pa.array(scores >= THRESHOLD).cast(pa.int32())], [*names, "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """Toxicity of every text as labels.toxic marks it.

    docs needs doc_id and text, labels doc_id and toxic (0 or 1; other values and null are no label; of
    labels that repeat an id the largest counts). Labels of held-out ids are never used. Returns a row a row: doc_id,
    held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= THRESHOLD); with carry also
    row, a struct of all columns of docs. Null texts count as empty; these have the features of no words and are scored as
    any other. Where labels of one kind only are known, all texts score the share of label 1, and 0 without labels.
    A null doc_id is not held out. Rows that repeat a doc_id are scored each by its text, and equal texts alike.
    """
    cluster.short_batches(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    ).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = learn(own.filter("doc_id is not null").select("doc_id", "text"), labels)
    names = ["doc_id", "held_out", *(["row"] if carry else [])]
    schema = T.StructType([T.StructField(c, own.schema[c].dataType) for c in names]).add("score", "double").add("predicted", "integer")
    return own.select(*names, "text").mapInArrow(_score(model, names), schema)
