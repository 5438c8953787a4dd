"""Alignment of two tokenizers over the bytes of a corpus.

A text is cut by both tokenizers; where tokens of both end at one byte the text is cut into groups, and
every token of the first is linked with every token of the second in its group. Batches of texts are
aligned with numpy: cumsum gives the bytes where tokens end, intersect1d the cuts that both have,
searchsorted the group of each token, and links are expanded with repeat.

How many texts hold a pair of ids is counted over the whole corpus: tasks pre-aggregate, then a
salted and a final shuffle add up. Each text keeps its distinct pairs as a short blob, so that it needs no second
run of the tokenizers when the counts come back. The most frequent pairs, as many as a parameter says, go to
every task; the rest, which are rare and so can't be hot keys, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm import cluster, packing

BATCH_BYTES = 2_000_000
LINKS = 2_000_000  # expanded at a time
KNOWN = 300_000  # segments that a task keeps aligned, some 140 bytes each
JOINED = 4_000  # words that are encoded as one text
PAIRS = 1_000_000  # pre-aggregated in a task before they are passed on
COMMON = 1_000_000  # most frequent pairs that go to every task, 16 bytes each
SALTS = 8
BINS = 8  # of counts a power of two, from which the bound of the frequent pairs is drawn


def _binary(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.large_binary())


class ByteLevel:
    """Ids of texts by a tokenizers file, texts with the file's special tokens taken as they are."""

    def __init__(self, path: str) -> None:
        import json

        self.encoder = packing._Encoder(path)
        if self.encoder.whole is not None:
            self.encoder.whole.encode_special_tokens = True
        with open(path, "rb") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of = packing._byte_characters()
        self.size = max(vocabulary.values()) + 1
        pieces = [b""] * self.size
        for token, i in vocabulary.items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes = _binary(pieces)

    def __call__(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder(spaced) if self.encoder.whole is not None else self.encoder._plain(spaced)


class Pieces:
    """Ids of texts by a sentencepiece model that puts a space before a text.

    If the model leaves texts as they are and none of its pieces has a space after another
    character, no merge crosses the beginning of a run of spaces; so each distinct run with the word after it
    is encoded once a batch. Texts of other models are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = type(spec.pieces[0])
        pieces = [p.piece for p in spec.pieces]
        self.size = len(pieces)
        self.bytes = _binary([bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in spec.pieces])
        self.lengths = np.diff(at.raw(self.bytes)[1])
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix
        apart = train.model_type == train.BPE and not any("▁" in p.lstrip("▁") for p in pieces) and not any(p.type == kinds.USER_DEFINED for p in spec.pieces)
        self.by_word = bool(plain and apart)
        self.space = [self.model.piece_to_id("▁")]

    def __call__(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """spaced: texts with one space before each."""
        data, offsets = at.raw(spaced)
        start = offsets[:-1]
        if self.by_word:
            head = np.zeros(len(data) + 1, bool)
            head[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
            head[start] = True
            start = np.flatnonzero(head[:-1])
        bounds = np.concatenate((start, [len(data)]))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        flat, sizes = self._words(coded.dictionary)
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        return gather(flat, (np.cumsum(sizes) - sizes)[codes], n), np.diff(np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, offsets)])


    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with the spaces before it, one after the other, and the number of each."""
        body, bounds = at.raw(words)
        sizes = np.zeros(len(words), np.int64)
        last = body[bounds[1:] - 1] if len(words) else body
        # A word that isn't spaces only stands in front of any other as in front of the end of a text.
        free = np.flatnonzero(last != 0x20) if self.by_word else np.zeros(0, np.int64)
        alone = np.setdiff1d(np.arange(len(words)), free)
        flat, order = [], []
        for lo in range(0, len(free), JOINED):
            some = free[lo : lo + JOINED]
            text, ends = at.raw(words.take(pa.array(some)))
            ids = np.array(self.model.encode(text[1:].tobytes().decode()), np.int64)
            made = np.cumsum(self.lengths[ids])
            if not len(ids) or made[-1] != len(text):  # a sign that tokens don't give back
                alone = np.concatenate((alone, some))
                continue
            flat.append(ids)
            order.append(some)
            sizes[some] = np.diff(np.searchsorted(made, ends[1:], "right"), prepend=0)
        # An empty text has no pieces, so a lone space is put in by hand.
        found = [ids or self.space for ids in self.model.encode([w[1:].decode() for w in words.take(pa.array(alone)).to_pylist()], num_threads=1)]
        sizes[alone] = np.fromiter(map(len, found), np.int64, len(found))
        flat.append(np.fromiter((i for ids in found for i in ids), np.int64, int(sizes[alone].sum())))
        order = np.concatenate([*order, alone])
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(np.concatenate(flat), begin, sizes), sizes


def gather(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i] + n[i]] for each i, one after the other."""
    return values[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _true(ids: np.ndarray, n: np.ndarray, table: pa.Array, lengths: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text."""
    size = np.concatenate(([0], np.cumsum(lengths[ids])))[np.concatenate(([0], np.cumsum(n)))]
    made = at.raw(table.take(pa.array(ids)))[0]
    if np.array_equal(size, offsets):
        wrong = np.flatnonzero(made != data)
        return ~np.isin(np.arange(len(n)), np.searchsorted(offsets, wrong, "right") - 1)
    return np.array([np.array_equal(made[size[r] : size[r + 1]], data[offsets[r] : offsets[r + 1]]) for r in range(len(n))], bool)


@dataclass
class Segments:
    """Aligned segments of texts."""

    segments: pa.Array
    good: np.ndarray  # whether the tokens of both sides give the segment back
    sizes: dict[str, np.ndarray]
    groups: pa.Array  # as text, each with a sign after it
    keys: np.ndarray  # distinct pairs of all segments, and how often each is linked there
    times: np.ndarray
    n: np.ndarray  # pairs of each segment

    def __add__(self, other: Segments) -> Segments:
        both = lambda x, y: pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate((x, y))
        sizes = {k: both(v, other.sizes[k]) for k, v in self.sizes.items()}
        return Segments(both(self.segments, other.segments), both(self.good, other.good), sizes, both(self.groups, other.groups), both(self.keys, other.keys), both(self.times, other.times), both(self.n, other.n))


class Aligner:
    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.lengths = [np.diff(at.raw(x.bytes)[1]) for x in (self.a, self.b)]
        # Each id in decimal with the sign after it: within the list, at its end.
        self.names = _binary([f"{i}{sign}".encode() for x, signs in ((self.a, ",|"), (self.b, ",;")) for i in range(x.size) for sign in signs])
        self.known = self._aligned(_binary([]))
        self.key = np.dtype(np.min_scalar_type(self.a.size * self.b.size))

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct segments of the texts, those of each text in order, and where each text's begin.

        A space after a visible ASCII character begins a token on both sides, so groups never reach across it, and
        a segment is aligned once a batch. Where that isn't known of a tokenizer, a text is one segment.
        """
        start = offsets[:-1]
        if self.a.encoder.whole is None and self.b.by_word:
            head = np.zeros(len(data) + 1, bool)
            head[1:-1] = (data[1:] == 0x20) & packing._VISIBLE[data[:-1]]
            head[start] = True
            start = np.flatnonzero(head[:-1])
        bounds = np.concatenate((start, [len(data)]))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(start, offsets)

    def __call__(self, texts: pa.Array) -> dict[str, list]:
        """Columns of a batch of texts, none of them null or empty."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        segments, codes, first = self._segments(*at.raw(spaced))
        place = self._places(segments)[codes]
        # A text with one bad segment is out; its good ones may stand in other texts.
        bad = ~self.known.good[place]
        lost = np.add.reduceat(bad, first[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        own = np.flatnonzero(~lost)
        words = place[np.repeat(~lost, np.diff(first))]
        first = np.concatenate(([0], np.cumsum(np.diff(first)[own])))
        out: dict[str, list | np.ndarray] = {k: np.add.reduceat(v[words], first[:-1]) if len(own) else first[:0] for k, v in self.known.sizes.items()}
        out["groups_sha256"] = self._digests(self.known.groups.take(pa.array(words)), first)
        keys, times, n = self._united(words, first)
        bounds = np.concatenate(([0], np.cumsum(n)))
        out["pairs"] = [pack_pairs(keys[lo:hi].astype(self.key), times[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        full: dict[str, list] = {}
        for name, values in out.items():
            values = values.tolist() if isinstance(values, np.ndarray) else values
            column = ["" if name == "groups_sha256" else None if name == "pairs" else 0] * len(texts)
            for r, v in zip(own.tolist(), values, strict=True):
                column[r] = v
            full[name] = column
        return full

    def _places(self, segments: pa.Array) -> np.ndarray:
        """Where the segments stand in self.known, those that are new aligned and put there."""
        if len(self.known.segments) > KNOWN:
            self.known = self._aligned(segments.slice(0, 0))
        found = pc.index_in(segments, value_set=self.known.segments)
        new = pc.is_null(found).to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.known.segments) + np.arange(int(new.sum()))
        self.known = self.known + self._aligned(segments.filter(pa.array(new)))
        return place

    def _aligned(self, segments: pa.Array) -> Segments:
        data, offsets = at.raw(segments)
        tokens, good = [], np.ones(len(segments), bool)
        for side, lengths in zip((self.a, self.b), self.lengths, strict=True):
            ids, n = side(segments)
            good &= _true(ids, n, side.bytes, lengths, data, offsets)
            tokens.append((ids, n))
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in tokens)
        ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(*ends, assume_unique=True)
        group_a, group_b = (np.searchsorted(cuts, e) for e in ends)
        in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        segment = np.searchsorted(np.cumsum(np.where(good, np.diff(offsets), 0)), cuts)
        n_groups = np.bincount(segment, minlength=len(segments))
        n_links = np.diff(np.concatenate(([0], np.cumsum(in_a * in_b)))[np.concatenate(([0], np.cumsum(n_groups)))])
        groups = self._texts(a, b, group_a, group_b, in_a, in_b, n_a + n_b)
        sizes = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
        return Segments(segments, good, sizes, groups, *self._pairs(a, b, group_a, in_a, in_b, segment[group_a], len(segments)))

    def _texts(self, a, b, group_a, group_b, in_a, in_b, n) -> pa.Array:
        """The groups of each segment as text; a group's tokens of the first side stand before those of the second."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (self.a.size + b) + last_b
        text, at_token = at.raw(self.names.take(pa.array(order)))
        bounds = np.ascontiguousarray(at_token[np.concatenate(([0], np.cumsum(n)))])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(text))])

    @staticmethod
    def _digests(groups: pa.Array, first: np.ndarray) -> list[str]:
        text, offsets = at.raw(groups)
        bounds, text = offsets[first].tolist(), memoryview(np.ascontiguousarray(text))
        return [hashlib.sha256(text[lo : hi - 1]).hexdigest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def _united(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the documents from those of their segments, how often each is linked, and their number of each document."""
        keys, times, n = self.known.keys, self.known.times, self.known.n
        span, begin = self.a.size * self.b.size, np.cumsum(n) - n
        made = np.concatenate(([0], np.cumsum(n[words])))[first]  # pairs before each document
        docs, lo = len(first) - 1, 0
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while lo < docs:
            hi = max(lo + 1, int(np.searchsorted(made, made[lo] + LINKS, "right")) - 1)
            own = words[first[lo] : first[hi]]
            doc = np.repeat(np.arange(hi - lo), np.diff(made[lo : hi + 1]))
            found, spots = np.unique(doc * span + gather(keys, begin[own], n[own]), return_inverse=True)
            parts.append((found % span, np.bincount(spots, gather(times, begin[own], n[own]), len(found)).astype(np.int64), np.bincount(found // span, minlength=hi - lo)))
            lo = hi
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _pairs(self, a, b, group_a, in_a, in_b, segment_a, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each segment in order, how often each is linked there, and their number of each segment."""
        per = in_b[group_a]  # links of each token of the first side
        begin = (np.cumsum(in_b) - in_b)[group_a]
        span = self.a.size * self.b.size
        made = np.concatenate(([0], np.cumsum(per)))
        keys, times, lo = [], [], 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(made, made[lo] + LINKS, "right")) - 1)
            n = per[lo:hi]
            ends = np.cumsum(n)
            other = b[np.repeat(begin[lo:hi] - (ends - n), n) + np.arange(ends[-1])]
            found, count = np.unique(np.repeat(segment_a[lo:hi] * span + a[lo:hi] * self.b.size, n) + other, return_counts=True)
            keys.append(found)
            times.append(count)
            lo = hi
        if len(keys) > 1:  # a segment may go on in the next part
            found, spots = np.unique(np.concatenate(keys), return_inverse=True)
            keys, times = [found], [np.bincount(spots, np.concatenate(times)).astype(np.int64)]
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(segments, np.int64)
        return keys[0] % span, times[0], np.bincount(keys[0] // span, minlength=segments)


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs in order by their distances, and how often each comes; short."""
    counts = times.astype(np.min_scalar_type(int(times.max(initial=0))))
    body = np.diff(keys, prepend=keys.dtype.type(0)).tobytes() + counts.tobytes()
    return np.array([len(keys), keys.itemsize, counts.itemsize], "<u4").tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, each = np.frombuffer(blob[:12], "<u4").tolist()
    body = pa.decompress(blob[12:], n * (width + each), "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(body, f"u{width}", n).astype(np.int64)), np.frombuffer(body, f"u{each}", n, n * width).astype(np.int64)


def _align(byte_level: str, pieces: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(byte_level, pieces)
        for table in at.batches(frames, "text", BATCH_BYTES):
            found = align(at.chunk(table, "text"))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
            yield pa.RecordBatch.from_arrays([at.chunk(table, "row_id"), at.chunk(table, "doc_id"), *(pa.array(found[c], k) for c, k in zip(names, kinds, strict=True))], ["row_id", "doc_id", *names])

    return run


def _count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, added up in the task a bounded number of pairs at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys, spots = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(spots, np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    for frame in frames:
        for blob in frame.column(0):
            keys, _ = unpack_pairs(blob.as_py())
            held.append((keys, np.ones(len(keys), np.int64)))
            size += len(keys)
            if size >= 2 * PAIRS:
                held = [added()]
                size = len(held[0][0])
                if size >= PAIRS:
                    yield rows(*held.pop())
                    size = 0
    if held:
        yield rows(*added())
    at.trim()


def _sums(known, best, width: int):
    """Sums over the pairs of each document that are known; the others are left as a list."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = known.value
        highest = best.value
        for frame in frames:
            n_best, total, rest = [], [], []
            for blob in frame.column("pairs"):
                blob = blob.as_py()
                if blob is None:
                    n_best.append(0), total.append(0), rest.append(None)
                    continue
                pair, times = unpack_pairs(blob)
                spots = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hit = keys[spots] == pair if len(keys) else np.zeros(len(pair), bool)
                n = counts[spots[hit]] if len(keys) else np.zeros(0, np.int64)
                n_best.append(int(times[hit][n == highest[pair[hit] // width]].sum()))
                total.append(int((times[hit] * n).sum()))
                rest.append(None if hit.all() else [{"pair": int(p), "times": int(t)} for p, t in zip(pair[~hit], times[~hit], strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            kept = [frame.column(c) for c in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, kind)], ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Documents of each pair of ids (pair, n), from the blobs of aligned texts."""
    parts = aligned.filter("pairs is not null").select("pairs").mapInArrow(_count, "pair bigint, n bigint")
    salted = parts.groupBy("pair", (F.spark_partition_id() % SALTS).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_level: str, pieces: str, common: int = COMMON) -> DataFrame:
    """Links between the tokens of two tokenizers, summed up a document.

    docs needs doc_id and text; other columns are not read. byte_level is the path of a tokenizers file,
    pieces that of a sentencepiece model, both on every executor; at most `common` pairs go to every task. Returns a row
    a row: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of occurrences that share a group), n_best
    (links whose pair is in most documents of all pairs of its first id, ties included), count_sum (documents of
    each link's pair, added up), groups_sha256 of the groups written as `a1,a2|b1;a3|b2,b3`. Null and empty texts, and
    texts that the tokens of one side don't give back, have zeros and an empty groups_sha256. Rows that repeat a
    doc_id, or have none, are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cluster.short_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = "row_id bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    none = rows.filter("text is null or text = ''").select("row_id", "doc_id", *(F.lit(0).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.lit("").alias("groups_sha256"), F.lit(None).cast("binary").alias("pairs"))
    aligned = cluster.cut(rows.filter("text <> ''").mapInArrow(_align(byte_level, pieces), f"{known}, pairs binary").unionByName(none))
    width = Pieces(pieces).size
    counts = cluster.cut(pair_counts(aligned))
    first = F.floor(F.col("pair") / width).cast("bigint")
    # One row a token of the first vocabulary at most.
    top = counts.groupBy(first.alias("a")).agg(F.max("n").alias("n"))
    highest = np.zeros(ByteLevel(byte_level).size, np.int64)
    for r in top.collect():
        highest[r.a] = r.n
    # The share of pairs by their count, in steps that don't depend on the number of pairs.
    step = F.floor(F.log2("n") * BINS).cast("int")
    bins = counts.groupBy(step.alias("bin")).count().orderBy(F.desc("bin")).collect()
    least, held = None, 0
    for r in bins:
        held += r["count"]
        if held > common:
            break
        least = r.bin
    frequent = counts.filter(step >= least).select("pair", "n").toArrow().sort_by("pair") if least is not None else None
    pair, n = (frequent.column(c).to_numpy() for c in ("pair", "n")) if frequent is not None else (np.zeros(0, np.int64),) * 2
    sent = spark.sparkContext.broadcast((pair, n)), spark.sparkContext.broadcast(highest)
    summed = aligned.mapInArrow(_sums(*sent, width), f"{known}, n_best bigint, count_sum bigint, rest array<struct<pair: bigint, times: bigint>>")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if held <= common:
        return summed.select(names)
    summed = cluster.cut(summed)
    open_ = summed.filter("rest is not null").select("row_id", F.explode("rest").alias("r")).select("row_id", "r.pair", "r.times")
    rare = counts.filter(step < least) if least is not None else counts
    best = top.withColumnRenamed("n", "most")
    met = open_.join(rare, "pair").join(F.broadcast(best), first == F.col("a"))
    more = met.groupBy("row_id").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"))
    out = summed.join(more, "row_id", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).select(names)
