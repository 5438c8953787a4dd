"""Best-fit-decreasing packing of token sequences.

Documents longer than a window are first cut into full windows; what is left of each is
one item. Items differ for packing only by their length, so the plan is made on
the histogram of lengths, which has at most `window` entries however many
documents there are: lengths come in decreasing order, and a segment tree indexed by
remaining capacity finds the tightest windows that are still open for a length.
Equal windows are filled together as one range. The plan has some rows a length;
each item finds its window by its rank among the items of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm import cluster

BATCH_BYTES = 2_000_000
MOST_BROADCAST = 1_000_000  # steps of a plan; some 40 MB

# Fixed values of byte-level BPE files: the pattern of words, and the characters that stand for bytes.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_characters() -> dict[str, int]:
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


class OpenWindows:
    """Ranges of equal open windows by remaining capacity, under a segment tree of non-empty capacities."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _set(self, at_: int, value: int) -> None:
        i = at_ + self.size
        while i and self.tree[i] != value:
            self.tree[i] = value
            i //= 2
            if i:
                value = self.tree[2 * i] | self.tree[2 * i + 1]

    def add(self, remaining: int, first: int, n: int) -> None:
        if remaining and n:
            self.ranges[remaining].append((first, n))
            self._set(remaining, 1)

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least `least` that some window has, or -1."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.tree[2 * i])
                return i - self.size
            i //= 2
        return -1

    def take(self, remaining: int, n: int) -> tuple[int, int]:
        """A range of at most n windows with that remaining capacity, taken out."""
        first, have = self.ranges[remaining].pop()
        if have > n:
            self.ranges[remaining].append((first + n, have - n))
        elif not self.ranges[remaining]:
            self._set(remaining, 0)
        return first, min(have, n)


@dataclass
class Step:
    length: int
    rank: int  # of the first item of that length that the step places
    n: int
    sequence: int  # of the first item; each later one goes to the next sequence
    offset: int


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[Step]:
    """Where the items of each length go. histogram: items by length, 1 to window."""
    open_, steps, used = OpenWindows(window), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = open_.tightest(length)
            if remaining < 0:  # as many new windows as these items fill
                remaining, n = window, -(-left // (window // length))
                open_.add(window, used, n)
                used += n
            # A window stays the tightest until no other item fits, so it is filled before the next one.
            per = remaining // length
            first, n = open_.take(remaining, -(-left // per))
            whole = min(n, left // per)
            rest = left - whole * per if whole < n else 0
            for j in range(per):
                offset = window - remaining + j * length
                if whole:
                    steps.append(Step(length, rank, whole, first, offset))
                    rank += whole
                if j < rest:
                    steps.append(Step(length, rank, 1, first + whole, offset))
                    rank += 1
            open_.add(remaining - per * length, first, whole)
            if rest:
                open_.add(remaining - rest * length, first + whole, 1)
            left -= whole * per + rest
    return steps


class _Encoder:
    """Token ids of texts, as the tokenizers file gives them, each piece that repeats in a batch encoded once.

    A byte-level tokenizer never joins a visible ASCII character with white space
    after it, so a text may be cut there and each piece encoded alone, or pieces that begin
    and end so encoded one after the other as one text. Where the vocabulary is numbered in
    the order of its merges, tiktoken's merge loop gives the same ids several times
    faster. The file's added tokens are cut out of a text before, as tokenizers does. Texts
    of any other kind of file are encoded whole by tokenizers.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.added: dict[str, int] = {}
        for t in spec["added_tokens"]:  # one that is not in the vocabulary takes the next free id, whatever the file says
            if t["content"]:
                self.added[t["content"]] = vocabulary.get(t["content"], len(vocabulary) + len(set(self.added) - set(vocabulary)))
        bare = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ordered = False
        if bare and plain and spec["model"].get("type", "BPE") == "BPE":
            byte_of = _byte_characters()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
            merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
            ordered = [vocabulary[m.replace(" ", "")] for m in merges] == list(range(256, 256 + len(merges))) and len(ranks) == 256 + len(merges)
        self.encode = self.whole = None
        if ordered:
            import tiktoken

            self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
            for token, i in vocabulary.items():
                self.lengths[i] = len(token)
            merger = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda text: merger.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            # Of tokens that begin at one place the longest is meant.
            self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        else:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(path)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the number of each row."""
        if self.whole is not None:
            found = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int64) for t in texts.fill_null("").to_pylist()]
            return np.concatenate([*found, np.zeros(0, np.int64)]), np.fromiter(map(len, found), np.int64, len(found))
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._plain(texts)
        parts, marks, rows = [], [], []  # a part of a text, and the added token after it or -1
        for r, text in enumerate(texts.to_pylist()):
            lo = 0
            for m in self.marks.finditer(text) if marked[r] else ():
                parts.append(text[lo : m.start()])
                marks.append(self.added[m.group()])
                rows.append(r)
                lo = m.end()
            parts.append((text or "")[lo:])
            marks.append(-1)
            rows.append(r)
        ids, n = self._plain(pa.array(parts, pa.large_string()))
        after = np.array(marks)
        own = np.flatnonzero(after >= 0)
        ids = np.insert(ids, np.cumsum(n)[own], after[own])
        return ids, np.bincount(np.array(rows), n + (after >= 0), len(texts)).astype(np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        data, offsets = at.raw(texts)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        space, visible = _SPACE[data], _VISIBLE[data]
        head = np.zeros(len(data), bool)
        head[1:] = space[1:] & visible[:-1]
        full = np.flatnonzero(np.diff(offsets))
        head[offsets[full]] = True
        start = np.flatnonzero(head)
        ends = np.concatenate((start[1:], [len(data)]))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate((start, [len(data)]))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        codes = coded.indices.to_numpy()
        # Pieces that can stand next to each other, by code.
        free = np.zeros(len(coded.dictionary), bool)
        free[codes] = space[start] & visible[ends - 1]
        body, at_piece = at.raw(coded.dictionary)
        sizes = np.zeros(len(free), np.int64)
        flat = []
        order = np.concatenate((np.flatnonzero(free), np.flatnonzero(~free)))
        joined = int(free.sum())
        for lo in range(0, joined, 20_000):
            some = order[lo : min(lo + 20_000, joined)]
            ids = self.encode(b"".join(coded.dictionary.take(pa.array(some)).to_pylist()).decode())
            flat.append(ids)
            last = np.cumsum(np.diff(at_piece)[some])  # byte where each piece ends
            got = np.searchsorted(np.cumsum(self.lengths[ids]), last, "right")
            sizes[some] = np.diff(np.concatenate(([0], got)))
        for i in order[joined:].tolist():
            flat.append(self.encode(body[at_piece[i] : at_piece[i + 1]].tobytes().decode()))
            sizes[i] = len(flat[-1])
        flat = np.concatenate(flat)
        begin = np.zeros(len(free), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        n = sizes[codes]
        end = np.cumsum(n)
        spots = np.repeat((begin[codes] - (end - n)).astype(np.int32), n)
        spots += np.arange(end[-1], dtype=np.int32)
        return flat[spots], np.diff(np.concatenate(([0], end))[np.searchsorted(start, offsets)])


def _pieces(path: str, window: int, end_id: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(path)
        for table in at.batches(frames, "text", BATCH_BYTES):
            ids, counts = encode(at.chunk(table, "text"))
            doc = at.chunk(table, "doc_id").to_pylist()
            tail = np.array([end_id], "<u4").tobytes()
            body, size = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts) * 4
            del ids
            out: tuple[list, ...] = ([], [], [], [], [])
            lo = 0
            for r, hi in enumerate(size.tolist()):
                mine = bytes(body[lo:hi]) + tail
                n = len(mine) // 4
                for start in range(0, n, window):
                    piece = mine[4 * start : 4 * (start + window)]
                    for column, value in zip(out, (doc[r], start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most `window` tokens.

    docs needs doc_id and text; other columns are not read. A document is the ids of
    its text (null: none), added tokens of the file among them, then end_id. Returns a row a piece: doc_id, start (ids of the
    document before it), length, ids_crc32, doc_tokens, sequence_id, offset. A sequence's
    pieces follow each other without a gap from 0. tokenizer is the path of a
    tokenizers file that every executor can read. Rows that repeat a doc_id, and rows
    with a null doc_id, are documents of their own. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    cluster.short_batches(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = cluster.cut(source.mapInArrow(_pieces(tokenizer, window, end_id), schema))
    # A length may hold a third of all pieces, so ranks are counted in shares of a length.
    shares = cluster.partitions(spark) * 4
    shared = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)).cast("int"))
    counts = shared.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).drop("n")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    steps = best_fit_decreasing(histogram, window)
    by_length: dict[int, list[Step]] = {}
    for s in steps:
        by_length.setdefault(s.length, []).append(s)
    width = "length bigint, plan array<struct<rank: bigint, sequence: bigint, offset: bigint>>"
    plan = spark.createDataFrame([(k, [(s.rank, s.sequence, s.offset) for s in v]) for k, v in by_length.items()], width)
    own = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        shared.withColumn("own", F.row_number().over(own))
        .join(before, ["length", "share"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
        .drop("own", "before", "share")
    )
    # A length takes at most some 2 * window steps: the plan's size depends on the window only, but is checked all the same.
    flat = plan.select("length", F.posexplode("plan").alias("i", "step")).select("length", F.col("step.rank").alias("from"), (F.lead("step.rank").over(Window.partitionBy("length").orderBy("i"))).alias("to"), "step.sequence", "step.offset")
    flat = flat.withColumnRenamed("length", "l")
    placed = ranked.join(F.broadcast(flat) if len(steps) <= MOST_BROADCAST else flat, (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("from")) & ((F.col("rank") < F.col("to")) | F.col("to").isNull()))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("from")).alias("sequence_id"), F.col("offset").cast("bigint").alias("offset"))
