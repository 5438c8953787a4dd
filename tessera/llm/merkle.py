"""A Merkle manifest of a table: leaf, root and proof of every row.

Leaves are hashed in the JVM, so texts are read once and never shuffled. Rows get their place in
their tree by one range partitioning that is written once and the counts of its parts. A tree is
then worked off in buckets of BRANCH ** HEIGHT neighbouring nodes, which are aligned: a bucket is
the whole subtree under one node. DuckDB folds a bucket inside a task, level by level, with an
ordered string_agg and sha256 over the bucket's Arrow table. The bucket roots are the nodes of the next
round, so a tree of n leaves takes log(n) / (3 * HEIGHT) rounds and no task ever holds more than
one bucket. Proofs come down the same way: each bucket is joined with the siblings above its root.
"""

from __future__ import annotations

from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import cluster

BRANCH, HEIGHT = 8, 4
WIDTH = 64  # characters of a digest
MOST_BROADCAST = 200_000  # rows of the table of parts: one a part and tree

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "tree bigint, pos bigint, n bigint, digest string"
_OUTER = "tree bigint, pos bigint, before array<string>, after array<string>, subroot string"
_FOUND = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows have one encoding; null is told apart from empty."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folds(n: int, branch: int = BRANCH) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // branch), levels + 1
    return levels


@lru_cache(1)
def _engine() -> duckdb.DuckDBPyConnection:
    """One engine a worker; a bucket takes some megabytes of it."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


class _Bucket:
    """The levels of one bucket: run_k holds the digests under each node of level k, in order, as one text."""

    def __init__(self, nodes: pa.Table, branch: int, height: int) -> None:
        self.branch, self.sql = branch, _engine().cursor()
        self.n = nodes.column("n")[0].as_py()
        self.levels = min(height, folds(self.n, branch))
        self.sql.register("nodes", nodes)
        source = "nodes"
        for k in range(1, self.levels + 1):
            self.sql.execute(f"CREATE TEMP TABLE run_{k} AS SELECT pos // {branch} AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM {source} GROUP BY pos // {branch}")
            self.sql.execute(f"CREATE TEMP VIEW level_{k} AS SELECT pos, sha256(run) AS digest FROM run_{k}")
            source = f"level_{k}"
        self.top = source

    def __enter__(self) -> _Bucket:
        return self

    def __exit__(self, *_: object) -> None:
        for k in range(self.levels, 0, -1):
            self.sql.execute(f"DROP VIEW level_{k}")
            self.sql.execute(f"DROP TABLE run_{k}")
        self.sql.unregister("nodes")
        self.sql.close()

    def root(self) -> pa.Table:
        left = -(-self.n // self.branch**self.levels)
        return self.sql.sql(f"SELECT pos, {left}::BIGINT AS n, digest FROM {self.top}").to_arrow_table()

    def siblings(self) -> str:
        """A query: each node with the digests before and after it on its way to the bucket's root."""
        spot = [f"(nodes.pos // {self.branch**k}) % {self.branch}" for k in range(self.levels)]
        before = ", ".join(f"substr(r{k + 1}.run, 1, {WIDTH} * ({s}))" for k, s in enumerate(spot))
        after = ", ".join(f"substr(r{k + 1}.run, {WIDTH} * ({s}) + {WIDTH + 1})" for k, s in enumerate(spot))
        joins = " ".join(f"JOIN run_{k} r{k} ON r{k}.pos = nodes.pos // {self.branch**k}" for k in range(1, self.levels + 1))
        return f"SELECT nodes.*, [{before}]::VARCHAR[] AS before, [{after}]::VARCHAR[] AS after FROM nodes {joins}"


def _named(table: pa.Table, schema: str, **constant: object) -> pa.Table:
    """The table's columns in the order and of the types of a schema; constants fill the others."""
    kind = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    columns = [table.column(name).cast(kind[k]) if name in table.column_names else pa.array([constant[name]] * table.num_rows, kind[k]) for name, k in fields]
    return pa.table(columns, names=[name for name, _ in fields])


def _up(branch: int, height: int):
    def run(nodes: pa.Table) -> pa.Table:
        with _Bucket(nodes.select(["pos", "n", "digest"]), branch, height) as b:
            return _named(b.root(), _NODES, tree=nodes.column("tree")[0].as_py())

    return run


def _down(branch: int, height: int):
    """Siblings of every node of a bucket up to the root of all."""

    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        with _Bucket(nodes.select(["pos", "n", "digest"]), branch, height) as b:
            b.sql.register("above", outer.select(["before", "after"]))
            found = b.sql.sql(f"SELECT s.pos, s.before || a.before AS before, s.after || a.after AS after FROM ({b.siblings()}) s, above a").to_arrow_table()
            return _named(found, _OUTER, tree=nodes.column("tree")[0].as_py(), subroot=outer.column("subroot")[0].as_py())

    return run


def _prove(branch: int, height: int):
    """Proof and recomputed root of every leaf of a bucket. `digest` is the leaf, `changed` what its row hashes to now, if that was altered."""

    def run(leaves: pa.Table, outer: pa.Table) -> pa.Table:
        with _Bucket(leaves.select(["pos", "n", "digest", "doc_id", "changed"]), branch, height) as b:
            b.sql.register("above", outer.select(["before", "after", "subroot"]))
            steps = b.levels + len(outer.column("before")[0])
            query = f"SELECT s.doc_id, s.digest, coalesce(s.changed, s.digest) AS cur, s.before || a.before AS before, s.after || a.after AS after, a.subroot FROM ({b.siblings()}) s, above a"
            for k in range(1, steps + 1):
                query = f"SELECT * REPLACE (sha256(before[{k}] || cur || after[{k}]) AS cur) FROM ({query})"
            proof = " || ".join(["''", *(f"before[{k}] || after[{k}]" for k in range(1, steps + 1))])
            found = b.sql.sql(f"SELECT doc_id, digest AS leaf, subroot, sha256({proof}) AS proof_sha256, cur AS folded_root FROM ({query})").to_arrow_table()
            return _named(found, _FOUND)

    return run


def numbered(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """rows with pos, the place (from 0) in their tree by order, and n, the size of the tree; nulls come first.

    Rows that are equal in all of these may stand in any order; they are dealt out all the same. The
    range partitioning is drawn and written once, and what follows reads its places, so that
    a task that runs twice can't number rows another way.
    """
    spark = rows.sparkSession
    keys = [*(F.col(c).asc_nulls_first() for c in (*tree, *order)), F.col("__at")]
    rows = cluster.cut(rows.withColumn("__at", F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(cluster.partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("__spot", F.monotonically_increasing_id())
    dealt = cluster.cut(dealt.drop("__at")).withColumn("__part", F.shiftright("__spot", 33))
    parts = dealt.groupBy("__part", *tree).agg(F.min("__spot").alias("__first"), F.count(F.lit(1)).alias("__own"))
    whole = Window.partitionBy(*tree) if tree else Window.partitionBy(F.lit(0))
    before = F.sum("__own").over(whole.orderBy("__part")) - F.col("__own")
    parts = cluster.cut(parts.select(*(F.col(c).alias(f"__{c}") for c in tree), F.col("__part").alias("__p"), "__first", before.alias("__before"), F.sum("__own").over(whole).alias("n")))
    on = F.col("__part") == F.col("__p")
    for c in tree:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = dealt.join(F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts, on)
    return joined.select(*(c for c in rows.columns if c != "__at"), (F.col("__spot") - F.col("__first") + F.col("__before")).alias("pos"), "n")


def _bucketed(nodes: DataFrame, branch: int, height: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("pos") / F.lit(branch**height)).cast("bigint"))


def _rounds(nodes: DataFrame, most: int, branch: int, height: int) -> list[DataFrame]:
    """Nodes of each round, the last one with one node a tree. most: nodes of the largest tree."""
    rounds = [nodes]
    while most > 1:
        nodes = _bucketed(nodes, branch, height).groupBy("tree", "bucket").applyInArrow(_up(branch, height), _NODES)
        rounds.append(nodes := cluster.cut(nodes))
        most = -(-most // branch**height)
    return rounds


def _pair(nodes: DataFrame, outer: DataFrame, step, schema: str, branch: int, height: int) -> DataFrame:
    """Buckets of nodes, each with the siblings above its root."""
    above = outer.select("tree", F.col("pos").alias("bucket"), "before", "after", "subroot")
    return _bucketed(nodes, branch, height).groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInArrow(step(branch, height), schema)


def manifest(docs: DataFrame, branch: int = BRANCH, height: int = HEIGHT) -> DataFrame:
    """Leaf, subroot, root and proof of every row of docs, and whether an altered row is found out.

    docs needs doc_id, source, lang, n_chars and text; other columns are not read. A leaf is the sha256 of
    these five, each `-` if null and else its length in bytes, a colon and the value. Leaves of one lang
    (null is a lang) in the order of doc_id are a tree, the subroots in the order of lang the tree above
    them; each `branch` nodes in a row become one until one is left, a lone last one too. Returns a row a
    row: doc_id, leaf, subroot, root, proof_sha256 (of all siblings up to the root), folded_root, verified.
    Where 3 divides crc32 of the decimal doc_id, folded_root is worked out from the row with A-Z
    of its text lower-cased, else from the row itself; verified says whether it equals root. Rows with null doc_id come
    first and are not altered; rows that repeat a doc_id stand in the order of their leaves, so equal rows
    have leaves of their own and any order of them gives the same roots. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cluster.short_batches(spark)
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    rest = [doc_id, F.col("source"), F.col("lang").cast("string"), F.col("n_chars").cast("bigint")]
    altered = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, leaf(*rest, F.translate(text, _UPPER, _LOWER)))
    rows = docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(*rest, text).alias("digest"), altered.alias("changed"))
    placed = numbered(rows, ["lang"], ["doc_id", "digest"])
    langs = numbered(placed.groupBy("lang").agg(F.max("n").alias("size")), [], ["lang"])
    trees = langs.select(F.col("lang").alias("__lang"), F.col("pos").alias("tree"))
    most = langs.agg(F.max("size"), F.count(F.lit(1))).first()
    if not most[1]:
        return spark.createDataFrame([], f"{_FOUND}, root string, verified boolean").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    known = F.broadcast(trees) if most[1] <= MOST_BROADCAST else trees
    leaves = cluster.cut(placed.join(known, F.col("lang").eqNullSafe(F.col("__lang"))).select("tree", "pos", "n", "digest", "doc_id", "changed"))
    inner = _rounds(leaves, most[0], branch, height)
    subroots = inner[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(most[1]).cast("bigint").alias("n"), "digest")
    upper = _rounds(subroots, most[1], branch, height)
    root = upper[-1].first()["digest"]
    none = F.array().cast("array<string>")
    outer = upper[-1].select("tree", "pos", none.alias("before"), none.alias("after"), F.lit("").alias("subroot"))
    for nodes in reversed(upper[:-1]):
        outer = _pair(nodes, outer, _down, _OUTER, branch, height)
    own = inner[-1].select(F.col("tree").alias("t"), F.col("digest").alias("own"))
    outer = outer.join(own, F.col("pos") == F.col("t")).select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "before", "after", F.col("own").alias("subroot"))
    for nodes in reversed(inner[1:-1]):
        outer = _pair(nodes, outer, _down, _OUTER, branch, height)
    # A table whose trees are lone leaves has no round of its own; its only bucket holds that leaf.
    found = _pair(inner[0], outer, _prove, _FOUND, branch, height)
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
