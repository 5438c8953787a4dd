"""A stored adjacency table: edges in the buckets of both their ends, so that a hop reads the frontier's buckets only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import BUCKETS, Store, Table

MOST_FRONTIER = 10_000  # entities of a frontier that are named to the scan; a larger one meets the whole table in a join

_EDGES = "entity_id string, other string, relation_id string, relation_type string, out boolean"


class Adjacency:
    """Edges (relation_id, src_entity_id, relation_type, dst_entity_id) in a folder, each once at either end."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.store = Store(spark, root, {"edges": Table(_EDGES, "entity_id", buckets), "ends": Table("relation_id string, src string, dst string", "relation_id", buckets)})

    def upsert(self, edges: DataFrame, gone: DataFrame | None = None) -> None:
        """Edges come or take the place of those with their relation_id, and those of gone (relation_id) go; only buckets of old and new ends are written."""
        base, _ = self.store.state()
        own = edges.select("relation_id", "src_entity_id", "relation_type", "dst_entity_id").dropDuplicates(["relation_id"]).persist()
        # Of gone edges only those that don't come again.
        lost = gone.select("relation_id").distinct().join(own.select("relation_id"), "relation_id", "left_anti") if gone is not None else None
        ids = own.select("relation_id")
        ids = ids.unionByName(lost) if lost is not None else ids
        old = self.store.table("ends").join(ids, "relation_id", "left_semi")
        at = lambda df, near, far, out: df.select(F.col(near).alias("entity_id"), F.col(far).alias("other"), "relation_id", "relation_type", F.lit(out).alias("out"))
        new = at(own, "src_entity_id", "dst_entity_id", True).unionByName(at(own, "dst_entity_id", "src_entity_id", False))
        # Where edges lay before: a row without a direction takes them away.
        was = old.select(F.explode(F.array("src", "dst")).alias("entity_id"), "relation_id").distinct()
        ends = own.select("relation_id", F.col("src_entity_id").alias("src"), F.col("dst_entity_id").alias("dst"), F.lit(True).alias("stays"))
        ends = ends.unionByName(lost.withColumn("stays", F.lit(False)), allowMissingColumns=True) if lost is not None else ends
        swap = lambda alive: lambda before, rows: before.join(rows.select("relation_id").distinct(), "relation_id", "left_anti").select(*before.columns).unionByName(rows.filter(alive).select(*before.columns))
        self.store.commit({"edges": (new.unionByName(was, allowMissingColumns=True), swap("out is not null")), "ends": (ends, swap("stays"))}, base)
        own.unpersist()

    def of(self, entities: DataFrame) -> DataFrame:
        """Edges at some entities (entity_id), as they are seen from there."""
        ids = [r.entity_id for r in entities.select("entity_id").distinct().limit(MOST_FRONTIER + 1).collect()]
        return self.store.lookup("edges", ids) if len(ids) <= MOST_FRONTIER else self.store.table("edges").join(entities.select("entity_id").distinct(), "entity_id", "left_semi")

    def k_hop(self, focus: DataFrame, depth: int) -> DataFrame:
        """Entities within depth edges of the focus entities (entity_id), with their distance; any depth of 1 or more."""
        reached = focus.select("entity_id", F.lit(0).alias("hops"))
        frontier = reached
        for hop in range(1, max(1, depth) + 1):
            frontier = self.of(frontier).select(F.col("other").alias("entity_id")).distinct().join(reached, "entity_id", "left_anti").withColumn("hops", F.lit(hop))
            reached = reached.unionByName(frontier)
        return reached
