"""Language identification by cross-parsing entropy.

Each language gets a suffix automaton of a sample of its labelled text. A text is parsed
into the longest phrases that occur in the sample; a language that knows the text needs
few. A phrase costs log2(sample length) bits for its place and log2(letters of all samples) for
the letter after it, so that a sample of a few words, whose phrases are single letters, does not win
by their short places. The language with the fewest bits wins.

The automaton steps are table lookups, so a batch of texts is parsed in lock-step: texts
are cut into lanes of a fixed length that are parsed side by side, all of them whole.
Every letter of any sample is a symbol. The tables are sparse, so that scripts of thousands of
letters cost no more than others: rows of transitions lie over each other in one array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm import cluster

LANE = 512
BATCH_BYTES = 3_000_000
BATCH_COUNTS = 2_000_000  # texts x languages of a batch
MOST_BROADCAST = 200_000  # sampled ids sent to every task; more are joined by a shuffle
SAMPLE_CHARS = 30_000  # of labelled text that a language is learned from
ALL_CHARS = 3_000_000  # the same for all languages together: more than 100 share it
LEAST_CHARS = 500  # that a language keeps however many share
SAMPLE_TEXTS = 64  # that it may come from
LONGEST = 20_000  # code points of a text in the sample; of longer ones, taken where shorter ones are too few, the first

_UNKNOWN, _PAD, _GAP = 0, 1, 2  # symbols: not in any sample; after a lane's end; all but letters


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: one in five, by its id."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


@dataclass
class Table:
    """Transitions of an automaton. A state is the place of its row; its step by a symbol lies that much further."""

    steps: np.ndarray  # (next state, state whose step it is, or -1) by place
    start: np.ndarray  # state after a symbol alone, the root where it does not occur
    root: int


@dataclass
class Model:
    names: list[str]
    symbol: np.ndarray  # of each code point
    letter: np.ndarray  # whether each code point is one
    tables: list[Table]
    bits: list[float]  # of a phrase


def _laid(state: np.ndarray, symbol: np.ndarray, states: int, most: int) -> np.ndarray:
    """A place for the row of each state so that no steps (state, symbol) meet in one place. Longer rows come first, each where its draw finds room."""
    rng = np.random.default_rng(0)
    room = 3 * max(len(state), states) + 1
    place = np.full(states, -1, np.int64)
    taken, used = np.zeros(room + most, bool), np.zeros(room, bool)
    by = np.argsort(state, kind="stable")
    degree = np.bincount(state, minlength=states)
    first = np.cumsum(degree) - degree
    for d in np.unique(degree)[::-1].tolist():
        todo = np.flatnonzero(degree == d)
        tries = 0
        while len(todo):
            tries += 1
            if tries % 40 == 0:  # too full for rows of this length
                taken, used, room = np.concatenate((taken, np.zeros(room, bool))), np.concatenate((used, np.zeros(room, bool))), 2 * room
            drawn = rng.integers(0, room, len(todo))
            spots = drawn[:, None] + symbol[by[first[todo][:, None] + np.arange(d)]]
            free = np.flatnonzero(~used[drawn] & ~taken[spots].any(axis=1))
            # Of draws that meet, the last stands.
            at_row, at_spot = np.empty(room, np.int64), np.empty(len(taken), np.int64)
            at_row[drawn[free]] = free
            at_spot[spots[free].ravel()] = np.repeat(free, d)
            won = free[(at_row[drawn[free]] == free) & (at_spot[spots[free]] == free[:, None]).all(axis=1)]
            place[todo[won]] = drawn[won]
            used[drawn[won]] = True
            taken[spots[won].ravel()] = True
            todo = np.delete(todo, won)
    return place


def automaton(symbols: list[int], most: int) -> Table:
    """The suffix automaton of a sample of symbols under most."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        own = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = own
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[own] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[own] = twin
        last = own
    state = np.repeat(np.arange(len(to)), [len(x) for x in to])
    symbol = np.fromiter((c for x in to for c in x), np.int64, len(state))
    target = np.fromiter((t for x in to for t in x.values()), np.int64, len(state))
    place = _laid(state, symbol, len(to), most)
    steps = np.full((int(place.max()) + most, 2), -1, np.int32)
    steps[place[state] + symbol] = np.stack((place[target], place[state]), axis=1)
    start = np.full(most, place[0], np.int32)
    start[list(to[0])] = place[list(to[0].values())]
    return Table(steps, start, int(place[0]))


def sample_chars(languages: int) -> int:
    """Characters that each of so many languages is learned from."""
    return min(SAMPLE_CHARS, max(LEAST_CHARS, ALL_CHARS // max(1, languages)))


def learn(samples: dict[str, list[str]]) -> Model:
    """A model of each language's sample texts, as many characters of them as sample_chars gives."""
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    taken = {}
    for name in sorted(samples):
        text = " ".join(samples[name])[: sample_chars(len(samples))].lower()
        if text.strip():
            taken[name] = text
    letters = sorted({c for text in taken.values() for c in text if letter[ord(c)]})
    most = len(letters) + 3
    symbol = np.where(letter, _UNKNOWN, _GAP).astype(np.min_scalar_type(most))
    for i, c in enumerate(letters):
        symbol[ord(c)] = i + 3
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            symbol[i] = symbol[ord(low)]
    tables, bits = [], []
    for text in taken.values():
        tables.append(automaton(symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist(), most))
        bits.append(float(np.log2(len(text) + 1) + np.log2(len(letters) + 1)))
    return Model(list(taken), symbol, letter, tables, bits)


def parse(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (rows) in each language, and whether the text has a letter."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    phrases = np.zeros((len(texts), len(model.names)), np.int64)
    spoken = np.zeros(len(texts), bool)
    full = np.flatnonzero(sizes)
    if not len(full):
        return phrases, spoken
    first = np.cumsum(sizes) - sizes
    spoken[full] = np.logical_or.reduceat(model.letter[points], first[full])
    lanes = -(-sizes // LANE)
    lane_first = np.cumsum(lanes) - lanes
    n = int(lanes.sum())
    # The place of each code point: its lane, and its position in it.
    within = np.arange(len(points)) - np.repeat(first, sizes)
    lane = np.repeat(lane_first, sizes) + within // LANE
    grid = np.full((LANE, n), _PAD, np.int32)
    grid[within % LANE, lane] = model.symbol[points]
    steps = min(LANE, int(sizes.max()))
    ends = np.full(n, LANE)
    ends[np.cumsum(lanes)[full] - 1] = (sizes[full] - 1) % LANE + 1
    at_, got, fails = np.empty(n, np.int32), np.empty((n, 2), np.int32), np.empty(n, bool)
    for k, table in enumerate(model.tables):
        pairs = table.steps.view(np.int64).ravel()
        state, count = np.full(n, table.root, np.int32), np.minimum(ends - steps, 0) + 1  # steps after a lane's end fail
        for j in range(steps):
            np.add(state, grid[j], out=at_)
            np.take(pairs, at_, out=got.view(np.int64).ravel(), mode="clip")
            np.not_equal(got[:, 1], state, out=fails)
            count += fails
            np.take(table.start, grid[j], out=state, mode="clip")
            np.copyto(state, got[:, 0], where=~fails)
        phrases[full, k] = np.add.reduceat(count, lane_first[full])
    return phrases, spoken


def _predict(model: Model):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bits = np.array([*model.names, "und"], object), np.array(model.bits)
        most = max(1, BATCH_COUNTS // len(names))
        for table in (t.slice(i, most) for t in at.batches(frames, "text", BATCH_BYTES) for i in range(0, t.num_rows, most)):
            phrases, spoken = parse(model, table.column("text").to_pylist())
            if model.names:
                cost = phrases * bits
                best = cost.argmin(axis=1)
                score = 1 / np.exp2(-np.minimum(cost - cost.min(axis=1, keepdims=True), 1000) / 8).sum(axis=1)
            else:
                best, score = np.zeros(len(spoken), int), np.zeros(len(spoken))
            best = np.where(spoken & bool(model.names), best, len(model.names))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(names[best], pa.string()), pa.array(np.where(spoken, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Labelled texts to learn every language from: the first SAMPLE_TEXTS by a hash of their id, those of up to LONGEST code points first, of others their beginning."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("held_out")).select("doc_id", "lang", F.char_length("text").alias("n"))
    rows = rows.filter(F.col("n") > 0).withColumn("h", F.xxhash64("doc_id")).withColumn("long", F.col("n") > LONGEST)
    by = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "n")
    first = cluster.cut(rows.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= SAMPLE_TEXTS))
    chars = sample_chars(first.select("lang").distinct().count())
    # Texts after those that fill the sample stay where they are.
    before = F.coalesce(F.sum(F.least("n", F.lit(LONGEST))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("before", before).filter(F.col("before") < chars).select("doc_id", "lang", "n").distinct()
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    # An id may stand for many texts of one length; of these, one of each beginning.
    texts = docs.filter(~F.col("held_out")).select("doc_id", "lang", F.char_length("text").alias("n"), F.left("text", F.lit(min(chars, LONGEST))).alias("text")).join(chosen, ["doc_id", "lang", "n"], "left_semi")
    part = Window.partitionBy("lang").orderBy(F.col("n") > LONGEST, F.xxhash64("doc_id"), "doc_id", "text")
    found: dict[str, list[str]] = {}
    for r in texts.distinct().withColumn("i", F.row_number().over(part)).filter(F.col("i") <= SAMPLE_TEXTS).orderBy("lang", "i").select("lang", "text").collect():
        found.setdefault(r.lang, []).append(r.text)
    return found


def identify(docs: DataFrame) -> DataFrame:
    """The language of every text, learned from the labels of those not held out.

    docs needs doc_id, text and lang; other columns are not read, and only text enters a
    prediction. Returns a row a row: doc_id, held_out, lang_pred (a learned value of lang; `und`
    where text is null or has no letter, or nothing was learned) and score (0 to 1: the
    winner's share when each bit more costs an eighth of a doubling). A tie goes to the
    language that sorts first. A null doc_id is not held out and not learned from.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = learn(sample(own.filter("doc_id is not null")))
    source = own.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out")
    return source.mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
