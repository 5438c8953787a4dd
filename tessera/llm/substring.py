"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at a word of a document; what it shares with others matters from a depth of
min_words on. Four passes:

1. Screen. A suffix whose first min_words words no other document holds lies under no deep internal
   node, so it needs no tree. Tasks exchange 32-bit names of these windows, each one once,
   and each document gets back the names that some other document also has. Unlike windows of one
   name only make more suffixes pass.
2. Partition. The suffixes that passed are dealt with their words to groups by a prefix: of the
   first min_words words the run of 2 words with the least hash, so that neighbouring
   suffixes mostly go together and their words are sent once. A group that holds more suffixes than
   fit in memory is dealt again by prefixes of 4, 8, ... up to min_words words.
3. Trees. Each group's suffixes are ordered by their words (ranks in the group, doubled up to the depth),
   neighbours give the longest common prefixes by comparing words, and intervals of these of at
   least min_words are the deep internal nodes. All owners of a node but the smallest document
   lose its path.
4. Cut. Each document removes the words below the paths that it lost; those that overlap join
   to maximal repeats.

No result hangs on hashes: they only choose tasks and who is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as at
from tessera.llm import cluster

WORD_BYTES = 6  # of a word and its space, to choose the number of tasks
TASK = 1_000_000  # windows that a task of the screen gets
GROUP = 1_000_000  # suffixes of a group that are ordered at once; more are dealt by longer prefixes
BATCH_BYTES = 2_500_000


def ladder(min_words: int) -> list[int]:
    """Prefix lengths tried in turn."""
    steps = [min(2, min_words)]
    while steps[-1] < min_words:
        steps.append(min(2 * steps[-1], min_words))
    return steps


# --- documents on their way -------------------------------------------------------------------------------------


def _key(text: bytes) -> int:
    """Tells unlike texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def _zipped(names: list[str]):
    """Texts as they travel: compressed, with their size and key."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for table in at.batches(frames, "text", BATCH_BYTES):
            texts = [None if x is None else x.encode() for x in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(at.chunk(table, c) for c in names),
                    pa.array([None if x is None else press.compress(x) for x in texts], pa.binary()),
                    pa.array([0 if x is None else len(x) for x in texts], pa.int64()),
                    pa.array([0 if x is None else _key(x) for x in texts], pa.int64()),
                ],
                [*names, "body", "n_bytes", "key"],
            )

    return run


def _unzipped(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows again, at most BATCH_BYTES of text at a time (a longer text stands alone), with their texts."""
    press = zstandard.ZstdDecompressor()
    for frame in frames:
        ends, lo = np.cumsum(frame.column("n_bytes").to_numpy()), 0
        while lo < frame.num_rows:
            most = (ends[lo - 1] if lo else 0) + BATCH_BYTES
            hi = max(lo + 1, int(np.searchsorted(ends, most, "right")))
            part = frame.slice(lo, hi - lo)
            yield part, pa.array([None if x is None else press.decompress(x) for x in part.column("body").to_pylist()], pa.large_binary())
            at.trim()
            lo = hi


def _words(texts: pa.Array) -> at.Words:
    return at.words(texts.fill_null(b"") if texts.null_count else texts)


# --- 1: the screen ----------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that equal upper bytes stand together and compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(body: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).ravel()


_MESSAGE = "task int, to int, base bigint, docs binary, paths binary"


class _Outbox:
    """Packed (doc, window) pairs on their way: base is the first doc, docs the steps from it; task works on them next, to is the share of documents that gets them (-1: undecided)."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def put(self, key: np.ndarray, doc: np.ndarray, path: np.ndarray, decided: bool) -> None:
        """doc ascends; its steps are small numbers and take next to no room."""
        if not len(key):
            return
        by = np.argsort(key, kind="stable")
        key, doc, path = key[by], doc[by], path[by]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True):
            k, steps = int(key[a]), np.diff(doc[a:b], prepend=doc[a])
            narrow = steps.astype(np.uint32) if int(steps.max()) < 1 << 32 else steps
            self.rows.append((k, k if decided else -1, int(doc[a]), _planes(narrow), path[a:b].tobytes()))

    def sent(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.rows), 256):
            columns = zip(*self.rows[lo : lo + 256], strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["task", "to", "base", "docs", "paths"])
        self.rows = []


def _unpacked(base: int, docs: bytes, paths: bytes) -> tuple[np.ndarray, np.ndarray]:
    path = np.frombuffer(paths, np.uint32)
    steps = _from_planes(docs, np.uint32 if len(docs) == 4 * len(path) else np.int64)
    return np.cumsum(steps.astype(np.int64)) + base, path


def _share(doc: np.ndarray, tasks: int) -> np.ndarray:
    return (at.mix(doc.view(np.uint64)) % np.uint64(tasks)).astype(np.int64)


def _names(w: at.Words, min_words: int) -> np.ndarray:
    """Hash of each run of min_words words, by its first word."""
    return at.mix(at.runs(w.hashes(), min_words))


def _short(names: np.ndarray) -> np.ndarray:
    return names.astype(np.uint32)


def _shared(order: np.ndarray, path: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in order of (path, doc): where each path begins, and which windows have one that several documents hold."""
    new = np.concatenate(([True], path[order[1:]] != path[order[:-1]])) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    ends = np.concatenate((start[1:], [len(order)]))
    several = doc[order[start]] != doc[order[ends - 1]] if len(start) else np.zeros(0, bool)
    return start, order[np.repeat(several, ends - start)]


def _windows(min_words: int, tasks: int):
    """Names of the windows of a task's documents, each with one owner a batch; and those that several documents of a batch hold."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Outbox()
        for table in at.batches(frames, "text", BATCH_BYTES):
            table = table.sort_by("doc_id").combine_chunks()
            ids = at.chunk(table, "doc_id").to_numpy()
            w = at.words(at.chunk(table, "text"))
            where, begin = at.within(w.first, min_words)
            if not len(where):
                continue
            path = _names(w, min_words)[where]
            doc = np.repeat(ids, np.diff(begin))
            order = np.argsort(path, kind="stable")
            start, shared = _shared(order, path, doc)
            shared = np.sort(shared)
            out.put(_share(doc[shared], tasks), doc[shared], _short(path[shared]), True)
            own = np.sort(order[start])
            out.put(((path[own] >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64), doc[own], _short(path[own]), False)
            yield from out.sent()

    return run


def _screen(tasks: int):
    """Names that several documents hold, for each of these."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, docs = [], []
        for frame in frames:
            yield frame.filter(pa.array(frame.column("to").to_numpy() >= 0))
            for _, to, base, near, body in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if to < 0:
                    doc, path = _unpacked(base, near, body)
                    docs.append(doc)
                    paths.append(path)
        if not paths:
            return
        path, doc = np.concatenate(paths), np.concatenate(docs)
        del paths, docs
        order = np.argsort(path, kind="stable")
        same = path[order[1:]] == path[order[:-1]]
        inner = np.zeros(len(path), bool)
        inner[order[1:][same]] = inner[order[:-1][same]] = True
        path, doc = path[inner], doc[inner]
        del order, same, inner
        _, shared = _shared(np.lexsort((doc, path)), path, doc)
        shared = shared[np.argsort(doc[shared], kind="stable")]
        out = _Outbox()
        out.put(_share(doc[shared], tasks), doc[shared], path[shared], True)
        del path, doc, shared
        yield from out.sent()
        at.trim()

    return run


def _by_document(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names that each document of a task's shares shares with others."""
    docs, paths = [], []
    for frame in frames:
        for _, _, base, near, body in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            doc, path = _unpacked(base, near, body)
            docs.append(doc)
            paths.append(path)
    if not docs:
        return
    doc, path = np.concatenate(docs), np.concatenate(paths)
    del docs, paths
    order = np.lexsort((path, doc))
    doc, path = doc[order], path[order]
    once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])))
    doc, path = doc[once], path[once]
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.concatenate((edge[1:], [len(doc)]))
    for lo in range(0, len(edge), 2048):
        a, b = edge[lo : lo + 2048], ends[lo : lo + 2048]
        yield pa.RecordBatch.from_arrays([pa.array(doc[a], pa.int64()), pa.array([path[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], ["doc_id", "hits"])
    del doc, path, order
    at.trim()


# --- 2: groups by prefix ----------------------------------------------------------------------------------------


@dataclass
class Suffixes:
    """Suffixes that begin at some words of w; row r of w belongs to a document and holds the words of its text with this key from `offset` on."""

    w: at.Words
    doc: np.ndarray  # by row, as the next two
    key: np.ndarray
    offset: np.ndarray
    at_word: np.ndarray  # ascending: the first word of each suffix
    row: np.ndarray  # of each suffix

    def place(self, some: np.ndarray) -> np.ndarray:
        """The first word of suffixes, counted in their texts."""
        return self.at_word[some] - self.w.first[self.row[some]] + self.offset[self.row[some]]


_SENT = "slot int, suffixes bigint, places binary, body binary, doc_id bigint, key bigint, first int, n int"


def _batch(**columns) -> pa.RecordBatch:
    kinds = {"slot": pa.int32(), "suffixes": pa.int64(), "places": pa.binary(), "body": pa.binary(), "doc_id": pa.int64(), "key": pa.int64(), "first": pa.int32(), "n": pa.int32()}
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in kinds.items()], list(kinds))


def least_prefix(hashes: np.ndarray, words: int, min_words: int) -> np.ndarray:
    """For each run of min_words words the least hash of the runs of `words` words in it."""
    least = at.mix(at.runs(hashes, words))
    wide, width = min_words - words + 1, 1
    while width < wide:
        step = min(width, wide - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _dealt(s: Suffixes, words: int, min_words: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Suffixes with their words, by the group of their prefix of so many words; neighbours of one group as one piece of text."""
    if not len(s.at_word):
        return
    slot = (at.mix(least_prefix(s.w.hashes(), words, min_words)[s.at_word] + np.uint64(words)) % np.uint64(slots)).astype(np.int32)
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (s.row[1:] != s.row[:-1]) | (np.diff(s.at_word) != 1)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(slot)])))
    begin, end = s.w.start[s.at_word[first]], s.w.end[s.at_word[first] + n + min_words - 2]
    by = np.argsort(slot[first], kind="stable")
    data = memoryview(np.ascontiguousarray(s.w.data))
    press = zstandard.ZstdCompressor(level=1)
    columns = np.stack((s.doc[s.row[first]], s.key[s.row[first]], s.place(first), n, end - begin), axis=1)
    ordered = slot[first][by]
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rows: list[tuple] = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True):
        own = by[a:b]
        body = b"".join([data[x:y] for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)])
        rows.append((int(ordered[a]), int(n[own].sum()), press.compress(_planes(np.ascontiguousarray(columns[own]).ravel())), press.compress(body)))
    for lo in range(0, len(rows), 64):
        part = zip(*rows[lo : lo + 64], strict=True)
        yield _batch(**dict(zip(("slot", "suffixes", "places", "body"), part, strict=True)))


def _received(rows: list[tuple[bytes, bytes]], min_words: int) -> Suffixes:
    """The suffixes of some messages."""
    press = zstandard.ZstdDecompressor()
    places = np.concatenate([_from_planes(press.decompress(p), np.int64).reshape(-1, 5) for p, _ in rows])
    body = b"".join([press.decompress(b) for _, b in rows])
    ends = np.concatenate(([0], np.cumsum(places[:, 4])))
    w = at.words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(body)]))
    where, begin = at.within(w.first, min_words)
    return Suffixes(w, places[:, 0], places[:, 1], places[:, 2], where, np.repeat(np.arange(len(places)), np.diff(begin)))


# --- 3: trees ---------------------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, vocabulary: pa.Array, at_word: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` words. Each of them has so many."""
    order = pc.sort_indices(vocabulary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank, width = rank[codes], 1
    while width < depth:  # ranks of runs of twice as many words, or as many more as are left
        step = min(width, depth - width)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    return np.argsort(rank[at_word], kind="stable")


def common_prefixes(codes: np.ndarray, at_word: np.ndarray, depth: int) -> np.ndarray:
    """Words, up to depth, that each suffix of an ordered list shares with the one before it."""
    shared = np.zeros(len(at_word), np.int64)
    alike = np.ones(max(len(at_word) - 1, 0), bool)
    for j in range(depth):
        alike &= codes[at_word[1:] + j] == codes[at_word[:-1] + j]
        shared[1:] += alike
    return shared


def deep_nodes(s: Suffixes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the number of the internal node of at least that depth, or of the leaf, that each lies under."""
    order = suffix_order(s.w.codes, s.w.vocabulary, s.at_word, depth)
    return order, np.cumsum(common_prefixes(s.w.codes, s.at_word[order], depth) < depth)


def _lost(s: Suffixes, order: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch | None]:
    """Suffixes that the smallest owner of their node keeps; and the others, as runs."""
    doc = s.doc[s.row]
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    least = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.concatenate((start, [len(order)]))))
    lost = order[doc[order] > least]
    kept = np.sort(order[doc[order] == least])
    if not len(lost):
        return kept, None
    place = s.place(lost)
    by = np.lexsort((place, s.key[s.row[lost]], doc[lost]))
    place, key, doc = place[by], s.key[s.row[lost]][by], doc[lost][by]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (np.diff(place) > 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(place)])) - 1
    return kept, _batch(doc_id=doc[first], key=key[first], first=place[first].astype(np.int32), n=(place[last] - place[first] + 1).astype(np.int32))


def _candidates(min_words: int, slots: int):
    """Suffixes that passed the screen: what loses to another document of a batch, and the others with their words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _unzipped(frames):
            w = _words(texts)
            where, begin = at.within(w.first, min_words)
            if not len(where):
                continue
            short = _short(_names(w, min_words)[where])
            passed = np.zeros(len(where), bool)
            for r, hits in enumerate(part.column("hits").to_pylist()):
                own = slice(begin[r], begin[r + 1])
                passed[own] = np.isin(short[own], np.frombuffer(hits, np.uint32))
            row = np.repeat(np.arange(part.num_rows), np.diff(begin))
            s = Suffixes(w, part.column("doc_id").to_numpy(), part.column("key").to_numpy(), np.zeros(part.num_rows, np.int64), where[passed], row[passed])
            if not len(s.at_word):
                continue
            # Suffixes of one name lie together; those whose words differ all the same are told apart by the trees.
            order = np.argsort(short[passed], kind="stable")
            node = np.cumsum(common_prefixes(w.codes, s.at_word[order], min_words) < min_words)
            kept, lost = _lost(s, order, node)
            if lost is not None:
                yield lost
            s.at_word, s.row = s.at_word[kept], s.row[kept]
            yield from _dealt(s, ladder(min_words)[0], min_words, slots)

    return run


def _trees(level: int, min_words: int, slots: int, group: int):
    """The deep internal nodes of each group of a task, or the group dealt by longer prefixes.

    At the full length a group too large to be ordered at once is ordered part by part, and only what the
    smallest owners keep is held.
    """
    steps = ladder(min_words)
    final = level == len(steps) - 1

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size: dict[int, int] = {}
        large: set[int] = set()
        most: dict[int, int] = {}  # suffixes that were left after the last ordering: it comes again when these have doubled

        def trees(slot: int, keep: bool) -> Iterator[pa.RecordBatch]:
            s = _received(held.pop(slot), min_words)
            kept, lost = _lost(s, *deep_nodes(s, min_words))
            if lost is not None:
                yield lost
            if keep:
                s.at_word, s.row = s.at_word[kept], s.row[kept]
                rows = [r for b in _dealt(s, min_words, min_words, 1) for r in zip(b.column("suffixes").to_pylist(), b.column("places").to_pylist(), b.column("body").to_pylist(), strict=True)]
                held[slot], size[slot] = [r[1:] for r in rows], sum(r[0] for r in rows)
            del s
            at.trim()

        def longer(rows: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            yield from _dealt(_received(rows, min_words), steps[level + 1], min_words, slots)

        for frame in frames:
            for slot, n, places, body in zip(*(frame.column(c).to_pylist() for c in ("slot", "suffixes", "places", "body")), strict=True):
                if slot in large:
                    yield from longer([(places, body)])
                    continue
                held.setdefault(slot, []).append((places, body))
                size[slot] = size.get(slot, 0) + n
                if size[slot] > group:
                    if not final:
                        large.add(slot)
                        for row in held.pop(slot):
                            yield from longer([row])
                    elif size[slot] > 2 * most.get(slot, 0):
                        yield from trees(slot, True)
                        most[slot] = size[slot]
        for slot in list(held):
            yield from trees(slot, False)

    return run


# --- 4: the cut -------------------------------------------------------------------------------------------------


def _cut(min_words: int, names: list[str]):
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _unzipped(frames):
            w = _words(texts)
            counts = np.diff(w.first)
            lists = part.column("lost")
            ends = lists.offsets.to_numpy()
            runs = lists.values
            row = np.repeat(np.arange(part.num_rows), np.diff(ends))
            key, first, n = (runs.field(c).to_numpy()[ends[0] : ends[-1]] for c in ("key", "first", "n"))
            own = key == part.column("key").to_numpy()[row]  # a repeated id may have another text
            row, first, n = row[own], first[own].astype(np.int64), n[own].astype(np.int64)
            cover = np.zeros(len(w.codes) + 1, np.int64)
            np.add.at(cover, w.first[row] + first, 1)
            np.subtract.at(cover, w.first[row] + first + n + min_words - 1, 1)
            gone = np.cumsum(cover)[:-1] > 0
            keep = ~gone
            total = np.concatenate(([0], np.cumsum(keep)))
            left = total[w.first[1:]] - total[w.first[:-1]]
            spans: list[list] = [[] for _ in range(part.num_rows)]
            for r in np.flatnonzero(left < counts).tolist():
                step = np.diff(np.concatenate(([0], gone[w.first[r] : w.first[r + 1]].astype(np.int8), [0])))
                spans[r] = [{"first": x, "end": y} for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
            offsets = np.concatenate(([0], np.cumsum(left)))
            body = w.vocabulary.cast(pa.large_binary()).take(pa.array(w.codes[keep])) if len(w.codes) else pa.array([], pa.large_binary())
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), body), pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
            out = [*(part.column(c) for c in names), texts.cast(pa.large_string()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(counts - left, pa.int64()), pa.array(spans, kind), joined]
            yield pa.RecordBatch.from_arrays(out, [*names, "text", "n_words", "n_removed", "spans", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, min_words: int = 50, carry: bool = False, group: int = GROUP) -> DataFrame:
    """Documents without the words of any window of min_words words that a document with a smaller doc_id also has.

    docs needs doc_id (integer) and text; windows are judged on the texts as given. Returns
    a row a document: doc_id, n_words, n_removed, spans (maximal removed runs of words,
    array<struct<first, end>>, end exclusive) and kept_text (kept words joined by one
    space); with carry also row, a struct of all columns of docs. Null
    texts have no words. Rows with a null doc_id keep all words and take none from others.
    Rows that repeat a doc_id are parts of one document: they take nothing from each other.
    group: suffixes that a task orders at once.
    """
    spark = docs.sparkSession
    cluster.short_batches(spark)
    rest = [F.struct(F.lit(True).alias("__row"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")] if carry else []
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    plain = keyed.select("doc_id", "text").filter("doc_id is not null and text is not null")
    words = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES
    least = cluster.partitions(spark)
    tasks = max(least, -(-words // TASK))

    found = plain.mapInArrow(_windows(min_words, tasks), _MESSAGE)
    shared = found.repartitionById(tasks, F.col("task")).mapInArrow(_screen(tasks), _MESSAGE)
    hits = shared.repartitionById(tasks, F.col("to")).mapInArrow(_by_document, "doc_id bigint, hits binary")

    names = ["doc_id", *(["rest"] if carry else [])]
    zipped = T.StructType().add("body", "binary").add("n_bytes", "long").add("key", "long")
    travel = lambda df, own: df.select(*own, "text").mapInArrow(_zipped(own), T.StructType([df.schema[c] for c in own] + zipped.fields))
    sent = cluster.cut(travel(plain, ["doc_id"]).join(hits, "doc_id").select("doc_id", "body", "n_bytes", "key", "hits").mapInArrow(_candidates(min_words, tasks), _SENT))
    lost = sent.filter("slot is null")
    cluster.free(spark)  # of the screen
    for level in range(len(ladder(min_words))):
        sent = cluster.cut(sent.filter("slot is not null").repartitionById(tasks, F.col("slot")).mapInArrow(_trees(level, min_words, tasks, group), _SENT))
        lost = lost.unionByName(sent.filter("slot is null"))
        if not sent.filter("slot is not null").limit(1).count():
            break
    cluster.free(spark)
    marks = lost.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "n")).alias("lost"))

    known = travel(keyed, names).filter("doc_id is not null").join(marks, "doc_id", "left")
    if keyed.filter("doc_id is null").limit(1).count():  # their tasks run two workers, one after the other
        known = known.unionByName(travel(keyed.filter("doc_id is null"), names).withColumn("lost", F.lit(None).cast(marks.schema["lost"].dataType)))
    ready = known.select(*names, "body", "n_bytes", "key", F.coalesce("lost", F.array().cast(marks.schema["lost"].dataType)).alias("lost"))
    spans = T.ArrayType(T.StructType().add("first", "long").add("end", "long"))
    schema = T.StructType([ready.schema[c] for c in names]).add("text", "string").add("n_words", "long").add("n_removed", "long").add("spans", spans).add("kept_text", "string")
    out = ready.mapInArrow(_cut(min_words, names), schema)
    row = [F.struct(*((F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns)).alias("row")] if carry else []
    return out.select("doc_id", *row, "n_words", "n_removed", "spans", "kept_text")
