"""Near-duplicate vectors by collision-counting projections.

Vectors of one label are projected on many random directions. On one direction a pair at the
threshold falls apart by a normal deviate of known width, so a window centred on a query and two
such widths to each side holds its near vectors with a known probability. A query's window on
the first direction, sorted, gives its candidates; a candidate collects a collision on each
direction whose window holds it too, and pairs that reach a count calibrated to the wanted
recall are verified by their cosine in double precision.

Equal vectors collapse first. The vectors of a label meet in pairs of blocks, each a piece of work of
bounded size. Only a label with more vectors than a leaf holds is cut by a tree before: each level
sorts a node along a fresh direction and halves it at the median, and vectors within half a window
of the cut go to both sides, so that a near pair stays together. Two trees over different
directions make up for pairs that one of them parts.

Links are never rows: a piece of work returns how many links each vector has in it and a
spanning forest. A pair that meets in several leaves counts in the first that both vectors have.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import cluster

DIRECTIONS = 32
WIDTH = 2.0  # of a window to each side, in standard deviations of a pair at the threshold
ROUTE_WIDTH = 2.7  # the same for the trees
GATHER_WIDTH = 5.0  # the same for the window that candidates come from: no other direction makes up for it
MISSED = 1e-6  # share of pairs at the threshold that the window for candidates and the count may lose
REACH = 3.0  # projections beyond it fall together; they are some normal deviates
SIDE = (64, 4096)  # rows of each side whose collisions are counted at a time, in a processor's cache
LEAF = 1 << 20  # vectors of a label that meet in blocks: a level of the trees copies two fifths of a node and saves a twentieth of its pairs
BLOCK = 8192  # rows of each side of a task's work
ROUTES = 32  # directions for the trees, half for each


def least_count(directions: int, inside: float, missed: float) -> int:
    """The largest count that a pair with that chance of a collision on each direction misses with probability `missed` at most."""
    below, count = 0.0, 0
    while count < directions:
        below += comb(directions, count) * inside**count * (1 - inside) ** (directions - count)
        if below > missed:
            break
        count += 1
    return count


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _unit(values: list[np.ndarray] | np.ndarray) -> np.ndarray:
    x = np.array(values, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of large components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _routes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Projections that the trees sort by."""
    for frame in frames:
        rows: list = [None] * frame.num_rows
        values = [np.array(v, np.float64) for v in frame.column("embedding").to_pylist()]
        dims = np.array([len(v) for v in values])
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            for i, r in zip(at.tolist(), _unit([values[i] for i in at]) @ _directions(dim, ROUTES, 1), strict=True):
                rows[i] = r
        yield pa.RecordBatch.from_arrays([frame.column("head"), frame.column("node"), pa.array(rows, pa.list_(pa.float64()))], ["head", "node", "routes"])


def near_pairs(x: np.ndarray, other: np.ndarray, cosine: float, within: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of other) of unit rows with at least that cosine, some at a time. within: other is x, and each pair comes once.

    Projections are counted as whole numbers of one byte: rounding down and clipping bring values nearer to each other, so no collision is lost.
    """
    apart = sqrt(2 - 2 * cosine)
    w = WIDTH * apart
    need = least_count(DIRECTIONS, erf(WIDTH / sqrt(2)), MISSED - erfc(GATHER_WIDTH / sqrt(2)))
    steps = max(1, int(64 * w / REACH))  # of a code, in a window to one side; at most 85, so that a sum of codes wraps around outside of a window only
    a = _directions(x.shape[1], DIRECTIONS, 0)
    mine, theirs = x @ a, other @ a
    to, by = np.argsort(theirs[:, 0], kind="stable"), np.argsort(mine[:, 0], kind="stable")
    first_of, first_to = mine[by, 0], theirs[to, 0]
    coded = lambda z: np.ascontiguousarray(np.clip(np.floor(z * (steps / w)) + 64, 0, 127).astype(np.uint8).T)
    mine, theirs = coded(mine[by]), coded(theirs[to])
    x, other, low = x[by], other[to], np.uint8(steps)
    gather = GATHER_WIDTH * apart
    for lo in range(0, len(x), SIDE[0]):
        own = slice(lo, lo + SIDE[0])
        first = int(np.searchsorted(first_to, first_of[lo] - gather))
        last = int(np.searchsorted(first_to, first_of[own][-1] + gather, "right"))
        least = mine[:, own] - low  # may wrap around, as the differences do
        for begin in range(max(first, lo) if within else first, last, SIDE[1]):
            end = min(begin + SIDE[1], last)
            count = np.zeros((least.shape[1], end - begin), np.uint8)
            gap, near = np.empty_like(count), np.empty(count.shape, bool)
            for i in range(DIRECTIONS):
                np.subtract(theirs[i, begin:end][None, :], least[i][:, None], out=gap)
                np.less_equal(gap, 2 * low, out=near)
                np.add(count, near.view(np.uint8), out=count)
            q, o = np.nonzero(count >= need)
            q, o = q + lo, o + begin
            if within:
                q, o = q[q < o], o[q < o]
            for at in range(0, len(q), 100_000):
                p, r = q[at : at + 100_000], o[at : at + 100_000]
                good = np.einsum("ij,ij->i", x[p], other[r]) >= cosine
                yield by[p[good]], to[r[good]]


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value that rows of a and b share, of each pair of rows."""
    top = np.iinfo(np.int64).max
    least = np.full(len(a), top)
    for i in range(a.shape[1]):
        shared = (a[:, i, None] == b).any(axis=1)
        np.minimum(least, np.where(shared, a[:, i], top), out=least)
    return least


def _work(cosine: float):
    """One pair of blocks of a leaf: of the links between the blocks, or inside where they are the same, the degrees and a spanning forest.

    A pair that meets in several leaves counts in the first that both have.
    """

    def run(key, table):
        node = key[0].as_py()
        side = table.column("side").to_numpy()
        ids, copies = table.column("head").to_numpy(), table.column("copies").to_numpy()
        x = _unit(table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        lists = table.column("leaves").to_pylist()
        leaves = None
        if (most := max(map(len, lists))) > 1:
            leaves = np.array([[*v, *v[:1] * (most - len(v))] for v in lists], np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        degree = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for p, r in near_pairs(x[left], x[right], cosine, same):
            p, r = left[p], right[r]
            if leaves is not None:
                for lo in range(0, len(p), 20_000):
                    own = slice(lo, lo + 20_000)
                    r[own][_first_common(leaves[p[own]], leaves[r[own]]) != node] = -1
                p, r = p[r >= 0], r[r >= 0]
            np.add.at(degree, p, copies[r])
            np.add.at(degree, r, copies[p])
            a, b = root[p], root[r]
            if (apart := a != b).any():
                v, low = cluster.roots(a[apart], b[apart])
                new = np.arange(len(ids))
                new[v] = low
                root = new[root]
        near, tied = np.flatnonzero(degree), np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({
            "a": pa.array(np.concatenate((ids[near], ids[tied]))),
            "b": pa.array([*[None] * len(near), *ids[root[tied]].tolist()], pa.int64()),
            "n": pa.array(np.concatenate((degree[near], np.zeros(len(tied), np.int64)))),
        })

    return run


def _leaves(heads: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """Rows (node, leaves, head, copies, embedding) so that a node has at most leaf rows, or can't be cut further; leaves: all nodes of the row's head."""
    half = ROUTE_WIDTH * sqrt(2 - 2 * cosine) / 2
    rows = heads
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > leaf).select("node", "n")
    if not large.limit(1).count():
        return rows.withColumn("leaves", F.array("node"))
    small = rows.join(large, "node", "left_anti").select("node", "head")
    routed = rows.join(large.select("node"), "node").mapInArrow(_routes, "head bigint, node bigint, routes array<double>")
    todo = cluster.cut(routed.withColumn("tree", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("node", F.xxhash64("node", "tree")))
    done = small
    for level in range(ROUTES // 2):
        here = todo.withColumn("h", F.element_at("routes", F.col("tree") * (ROUTES // 2) + level + 1))
        cuts = here.groupBy("node").agg(F.percentile_approx("h", 0.5).alias("middle"))
        split = here.join(cuts, "node")
        sides = F.filter(F.array(F.when(F.col("h") - half <= F.col("middle"), 0), F.when(F.col("h") + half > F.col("middle"), 1)), lambda s: s.isNotNull())
        todo = cluster.cut(split.withColumn("side", F.explode(sides)).withColumn("node", F.xxhash64("node", "side")).drop("h", "middle", "side"))
        large = cluster.cut(todo.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf).select("node"))
        done = done.unionByName(todo.join(large, "node", "left_anti").select("node", "head"))
        todo = todo.join(large, "node")
        if not large.limit(1).count():
            break
    else:
        done = done.unionByName(todo.select("node", "head"))
    placed = cluster.cut(done.groupBy("head").agg(F.sort_array(F.collect_set("node")).alias("leaves")))
    return rows.drop("node").join(placed, "head").withColumn("node", F.explode("leaves"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Links between vectors of one label with at least that cosine, as counts and components.

    vectors needs vec_id (integer), embedding (array of numbers) and label; other columns are not
    read. Returns one row a vec_id: vec_id, n_links (other vectors linked directly), component_id (the
    smallest vec_id reachable by links, itself included), kept (vec_id = component_id). Vectors
    with a null label, that are null, empty or zero, or hold null or non-finite components link
    with nothing; so do vectors of different lengths with each other. Rows with a null vec_id are
    left out; of rows that repeat a vec_id the smallest (label, embedding) counts. An empty table
    gives an empty result.
    """
    read = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    own = cluster.cut(read.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    valid = own.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = cluster.cut(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies")))
    heads = classes.select(F.xxhash64("label", F.size("embedding")).alias("node"), "head", "copies", "embedding")
    leaves = cluster.cut(_leaves(heads, cosine, leaf))
    # Blocks of a leaf meet in pairs; each pair of blocks is one bounded piece of work.
    blocks = leaves.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = leaves.join(blocks, "node").withColumn("own", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = met.select("node", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "head", "copies", "leaves", "embedding")
    # Rows grow with the vectors, not with their links: those are summed in the piece of work that finds them.
    # Pieces cost time, not bytes, so as many tasks as there are partitions share them.
    dealt = work.repartition(cluster.partitions(vectors.sparkSession), "node", "i", "j")
    found = cluster.cut(dealt.groupBy("node", "i", "j").applyInArrow(_work(cosine), "a bigint, b bigint, n bigint"))
    degree = found.filter("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("others"))
    links = found.filter("b is not null").select("a", "b")
    part = cluster.components(links).withColumnRenamed("id", "head")
    each = classes.join(degree, "head", "left").join(part, "head", "left").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "head").alias("component_id"))
    linked = valid.join(each, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = own.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
