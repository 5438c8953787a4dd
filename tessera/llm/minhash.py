"""MinHash near-duplicates with fast similarity sketches, banding and exact verification.

A text is the set of its distinct shingles of k consecutive words (A-Z lower-cased).
Fast similarity sketching fills t coordinates: in round i < t each shingle falls
into one bin chosen by a hash of the round and leaves its value there if the bin is
still empty after earlier rounds; in round t + i every shingle falls into bin i, so all
coordinates fill. Bands of r coordinates make candidates, and a candidate pair is a
link only when the full shingle sets reach the similarity.

Only components are asked for, so a large group of near copies never becomes all its
pairs: copies (equal sets) collapse first, each class is then tested against the
smallest class that shares a band with it. Classes that share a band and are still in
different components are tested by pairs where few share it, and where many do in
blocks of bounded size, which return the links that join components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm import cluster

ROWS, BANDS = 6, 42  # a pair at 0.8 shares no band with probability 3e-6
FEW = 32  # classes of a band that are tested by pairs
BLOCK = 1024  # classes of a side of a task's work
BLOCK_BYTES = 16_000_000  # of their texts, on average
MOST_BROADCAST = 500_000  # ids; some 30 MB as a hash table
BATCH_BYTES = 2_500_000
_EMPTY = np.iinfo(np.uint64).max


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and where each row's begin."""
    w = at.words(texts, lower=True)
    hashes = w.hashes()
    counts = np.diff(w.first)
    windows = at.runs(hashes, k)
    where, begin = at.within(w.first, k)
    taken = windows[where]
    short = np.flatnonzero((counts > 0) & (counts < k))
    alone = {}
    for r in short.tolist():  # the whole sequence as one shingle, unlike any of k words
        alone[r] = at.mix(at.runs(hashes[w.first[r] : w.first[r + 1]], int(counts[r])) + np.uint64(counts[r]))
    out, first = [], np.zeros(len(counts) + 1, np.int64)
    for r, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        own = alone.get(r)
        if own is None:
            own = np.sort(taken[lo:hi])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
        first[r + 1] = first[r] + len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), first


def sketch(sets: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Sketches of t coordinates, one row a set; a row of an empty set is all ones."""
    rows = len(first) - 1
    filled = np.full(rows * t, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(rows), np.diff(first))
    for i in range(2 * t):
        if not len(owner):
            break
        h = at.mix(sets + np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        # Earlier rounds win: the round stands in the upper bits.
        np.minimum.at(filled, owner * t + bins, (h >> np.uint64(12)) | np.uint64(i << 52))
        if i < 8 or i % 8 == 0 or i >= t:
            open_rows = (filled.reshape(rows, t) == _EMPTY).any(axis=1)
            if not open_rows.all():
                keep = open_rows[owner]
                sets, owner = sets[keep], owner[keep]
    return filled.reshape(rows, t)


def _signatures(k: int, rows: int, bands: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in at.batches(frames, "text", BATCH_BYTES):
            sets, first = shingles(at.chunk(table, "text"), k)
            sketches = sketch(sets, first, rows * bands)
            sizes = np.diff(first)
            keys = [_key(sets[a:b]) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            band = _bands(sketches, rows, bands)
            low = (sketches & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    at.chunk(table, "doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.diff(at.raw(at.chunk(table, "text"))[1]), pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([b if n else None for b, n in zip(band.view(np.int64), sizes.tolist(), strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if n else None for x, n in zip(low, sizes.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "n_bytes", "set_key", "bands", "low"],
            )

    return run


def _bands(sketches: np.ndarray, rows: int, bands: int) -> np.ndarray:
    s = sketches.reshape(-1, bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2]).copy()
    for j in range(rows):
        h = at.mix(h * at.ODD + s[:, :, j])
    return h


def _key(own: np.ndarray) -> bytes:
    """Name of a set of shingles."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _verifier(k: int, percent: int):
    """Rows of one centre and salt come in order, the centre's text first: only its set is held. Of the texts of a repeated id, those of other sets than the asked one fall out."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, mine = None, np.zeros(0, np.uint64)
        for table in at.batches(frames, "text", BATCH_BYTES):
            sets, first = shingles(at.chunk(table, "text"), k)
            a, b = (at.chunk(table, c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            keys = at.chunk(table, "set_key").to_pylist()
            links = []
            for r in range(table.num_rows):
                own = sets[first[r] : first[r + 1]]
                if keys[r] != _key(own):
                    continue
                if a[r] == b[r]:
                    centre, mine = a[r], own
                    continue
                assert centre == a[r], "a centre's text stands before its pairs"
                if _similar(own, mine, percent):
                    links.append(r)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(a[links], pa.int64()), pa.array(b[links], pa.int64())], ["a", "b"])

    return run


def _asked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids, where these are few enough to be sent to every task; else all, for the shuffle join that follows."""
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= MOST_BROADCAST else texts


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs of classes (a, b) whose full sets reach the similarity. docs: doc_id, text; classes: class, head, set_key.

    pairs must be a written table. A centre's text goes once to every 256 of its pairs, the
    other texts once a pair.
    """
    counted = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("shares"))
    others = pairs.join(counted, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")).drop("shares")
    centres = counted.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    named = cluster.cut(others.unionByName(centres).join(classes.select(F.col("class").alias("b"), "head", "set_key"), "b"))
    texts = _asked(docs, named.select(F.col("head").alias("doc_id")).distinct())
    rows = named.join(texts, F.col("head") == F.col("doc_id")).select("a", "b", "share", "set_key", "text")
    n = cluster.partitions(docs.sparkSession)
    ordered = rows.repartition(n, "a", "share").sortWithinPartitions("a", "share", (F.col("a") != F.col("b")), "b")
    return ordered.mapInArrow(_verifier(k, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Components of documents whose shingle sets S, T have 100 * |S & T| >= percent * |S | T|.

    docs needs doc_id (integer) and text; other columns are not read. Returns one row
    per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included), kept (doc_id = component_id). Null and wordless
    texts have no shingle and no link. Rows with a null doc_id are left out. Rows
    that repeat a doc_id are one document: all their texts are compared and joined to one
    component, whatever the order of the rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cluster.short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    schema = "doc_id bigint, n_shingles bigint, n_bytes bigint, set_key binary, bands array<bigint>, low binary"
    signed = cluster.cut(docs.mapInArrow(_signatures(k, rows, bands), schema))
    solid = signed.filter("set_key is not null")

    # A class is a set, numbered where it is written; its head is the smallest document that has it.
    heads = solid.groupBy("set_key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = cluster.cut(heads.withColumn("class", F.monotonically_increasing_id()))
    member = cluster.cut(cluster.spread_join(solid.select("doc_id", "set_key"), heads.select("set_key", "class", "copies"), ["set_key"], "copies").select("doc_id", "class"))
    sketched = solid.join(heads.select("set_key", F.col("head").alias("doc_id"), "class"), ["set_key", "doc_id"])
    sketched = cluster.cut(sketched.dropDuplicates(["set_key", "doc_id"]).select("class", "bands", "low", "n_bytes"))
    low = sketched.select("class", "low")
    spots = sketched.select("class", F.explode("bands").alias("spot"))
    shared = spots.groupBy("spot").agg(F.min("class").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = cluster.cut(spots.join(shared.select("spot", "centre"), "spot"))

    # Texts of one document are one vertex.
    several = member.select("doc_id", "class").distinct().groupBy("doc_id").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = cluster.cut(member.join(several.select("doc_id", "a"), "doc_id").filter("class <> a").select("a", F.col("class").alias("b")).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs of classes (a, b): sketches drop hopeless pairs, full sets decide."""
        near = (
            pairs.join(low.select(F.col("class").alias("a"), F.col("low").alias("x")), "a")
            .join(low.select(F.col("class").alias("b"), F.col("low").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(_sieve(rows * bands, percent), "a bigint, b bigint")
        )
        return cluster.cut(verified(cluster.cut(near), heads, docs, k, percent))

    # Each class against the smallest one that it shares a band with.
    pairs = cluster.cut(entries.filter("class <> centre").groupBy("class").agg(F.min("centre").alias("a")).select("a", F.col("class").alias("b")))
    stars = linked(pairs).unionByName(ties)

    # What is open: bands shared by classes in different components.
    part = cluster.components(stars)
    placed = entries.select("spot", "class").join(part.withColumnRenamed("id", "class"), "class", "left").select("spot", "class", F.coalesce("component_id", "class").alias("part"))
    mixed = placed.groupBy("spot").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("spot", "n")
    open_ = cluster.cut(placed.join(mixed, "spot"))

    # Bands that few classes share: their pairs. A pair is rows here, so this stays linear in the rows of open_.
    few = open_.filter(F.col("n") <= FEW)
    left, right = (few.select("spot", F.col("class").alias(x), F.col("part").alias(f"{x}_part")) for x in "ab")
    loose = left.join(right, "spot").filter("a < b and a_part <> b_part").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    links = stars.unionByName(linked(loose))

    # Bands that many share: groups around one class of each band, mostly the same in all bands of a group, compared in blocks.
    many = open_.filter(F.col("n") > FEW)
    rank = F.struct(F.xxhash64("class").alias("h"), "class")
    named = many.groupBy("spot").agg(F.min(rank).alias("c")).select("spot", F.col("c.class").alias("group"))
    grouped = cluster.cut(many.join(named, "spot").groupBy("group", "class").agg(F.first("part").alias("part")))
    if grouped.limit(1).count():
        links = links.unionByName(cluster.cut(_compared(grouped, sketched, heads, docs, k, percent, rows * bands)))

    # From classes back to documents: a component is named by the smallest head in it.
    part = cluster.components(links).withColumnRenamed("id", "class")
    of_class = cluster.cut(heads.select("class", "head").join(part, "class", "left").select("class", "head", F.coalesce("component_id", "class").alias("component")))
    least = cluster.cut(of_class.groupBy("component").agg(F.min("head").alias("component_id"), F.count(F.lit(1)).alias("classes")).filter("classes > 1"))
    joint = cluster.spread_join(of_class, least, ["component"], "classes").select("class", "component_id")
    named = cluster.cut(heads.join(joint, "class", "left").select("set_key", "copies", F.coalesce("component_id", "head").alias("component_id")))
    final = cluster.spread_join(solid.select("doc_id", "set_key"), named, ["set_key"], "copies").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _least(t: int, percent: int) -> float:
    """Equal coordinates of t that sets at the similarity reach but for five standard errors."""
    s = percent / 100
    return t * s - 5 * (t * s * (1 - s)) ** 0.5


def _sieve(t: int, percent: int):
    """Drops pairs whose sketches agree in too few coordinates."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                x, y = (np.frombuffer(b"".join(frame.column(c).to_pylist()), np.uint8).reshape(-1, t) for c in ("x", "y"))
                yield frame.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= _least(t, percent)))

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    spot = np.searchsorted(large, small)
    spot[spot == len(large)] = 0
    both = int((large[spot] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _blocks(k: int, percent: int, t: int):
    """Links that join components, between the two sides of each piece of work, or inside one side."""

    def links(table: pa.Table) -> pa.RecordBatch | None:
        side, ids, part = (at.chunk(table, c).to_numpy(zero_copy_only=False) for c in ("side", "class", "part"))
        texts, keys = at.chunk(table, "text"), table.column("set_key").to_pylist()
        lows = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, t)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        inside = not len(right)
        right = left if inside else right
        root = {int(p): int(p) for p in part}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        sets: dict[int, np.ndarray | None] = {}

        def of(r: int) -> np.ndarray | None:
            """The set of a row, or None where it is another text of the row's id."""
            if r not in sets:
                own = shingles(texts.slice(r, 1), k)[0]
                sets[r] = own if _key(own) == keys[r] else None
            return sets[r]

        found: list[tuple[int, int]] = []
        for lo in range(0, len(left), 32):
            some = left[lo : lo + 32]
            agree = (lows[some][:, None, :] == lows[right][None, :, :]).sum(axis=2)
            near = (agree >= _least(t, percent)) & (part[some][:, None] != part[right][None, :])
            if inside:
                near &= some[:, None] < right[None, :]
            for i, j in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                x, y = int(some[i]), int(right[j])
                p, q = top(int(part[x])), top(int(part[y]))
                if p == q or of(x) is None or of(y) is None:
                    continue
                if _similar(of(x), of(y), percent):
                    root[max(p, q)] = min(p, q)
                    found.append((int(ids[x]), int(ids[y])))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for frame in frames:
            keys = list(zip(*(frame.column(c).to_pylist() for c in ("group", "i", "j")), strict=True))
            begin = 0
            for r, own in enumerate(keys):
                if own != key:
                    if r > begin:
                        held.append(frame.slice(begin, r - begin))
                    if held and (out := links(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield out
                    held, key, begin = [], own, r
            if frame.num_rows > begin:
                held.append(frame.slice(begin))
        if held and (out := links(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


def _compared(grouped: DataFrame, sketched: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, t: int) -> DataFrame:
    """Links that join the components (part) of each group's members. Groups are cut into blocks of BLOCK classes and BLOCK_BYTES of text, and a task holds two at a time."""
    members = cluster.cut(grouped.join(sketched.select("class", "n_bytes", "low"), "class").join(heads.select("class", "head", "set_key"), "class"))
    most = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_bytes") / BLOCK_BYTES)
    sizes = members.groupBy("group").agg(F.ceil(most).cast("int").alias("blocks"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("group", "blocks", "n")
    placed = cluster.spread_join(members, cluster.cut(sizes), ["group"], "n").withColumn("own", F.pmod(F.xxhash64("class", F.lit(1)), F.greatest("blocks", F.lit(1))).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    work = met.select("group", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "class", "part", "low", "head", "set_key")
    texts = _asked(docs, members.select(F.col("head").alias("doc_id")).distinct())
    rows = work.join(texts, F.col("head") == F.col("doc_id")).select("group", "i", "j", "side", "class", "part", "low", "set_key", "text")
    ordered = rows.repartition(cluster.partitions(docs.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "class", "text")
    return ordered.mapInArrow(_blocks(k, percent, t), "a bigint, b bigint")
