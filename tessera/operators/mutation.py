"""Ledger writes as old table and new rows in, new table out.

The result replaces the table in one overwrite. Rows repeat a key in neither result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import latest


def upsert_last(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """New rows win, but for the columns `keep`, which stay as they were. order ranks new rows of one key, the winner first."""
    new = latest(new, keys, *order) if order else new.dropDuplicates(list(keys))
    a, b = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    joined = a.withColumn("__old", F.lit(True)).alias("old").join(b.withColumn("__new", F.lit(True)).alias("new"), on, "full")
    pick = lambda c: F.when(F.col("__new") & (F.col("__old").isNull() if c in keep else F.lit(True)), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return joined.select(*(pick(c) for c in old.columns))


def upsert_first(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Old rows win; of new rows of one key the first in order is added."""
    new = latest(new, keys, *order) if order else new.dropDuplicates(list(keys))
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All old rows of the keys that new has go, all new rows come."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def patch(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns take the new value where it isn't null; no row is added."""
    side = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return old.join(side, list(keys), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*old.columns)


def extend_ids(old: Column, new: Column) -> Column:
    """old with the ids of new that it lacks, in order."""
    old = F.coalesce(old, F.array().cast("array<string>"))
    return F.concat(old, F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: ~F.array_contains(old, x)))


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps' entries; those of new win."""
    empty = F.create_map().cast("map<string, string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of all shards; of rows of one key that of the earliest shard stays."""
    out = shards[0].withColumn("__shard", F.lit(0))
    for i, s in enumerate(shards[1:], 1):
        out = out.unionByName(s.withColumn("__shard", F.lit(i)), allowMissingColumns=True)
    return latest(out, keys, F.col("__shard"), *(F.col(c) for c in shards[0].columns if c not in keys and "map" not in dict(shards[0].dtypes)[c])).drop("__shard")


def fresh(units: DataFrame, stored: DataFrame, key: str = "unit_id", text: str = "text", digest: str = "text_hash") -> DataFrame:
    """Units that are not stored with the same text."""
    hashed = units.withColumn(digest, F.sha2(text, 256))
    return hashed.join(stored.select(key, digest), [key, digest], "left_anti")


def prune(stored: DataFrame, keep: DataFrame, source: str = "source_id", key: str = "unit_id") -> DataFrame:
    """Without the units of the sources in keep that keep doesn't list."""
    other = stored.join(keep.select(source).distinct(), source, "left_anti")
    return other.unionByName(stored.join(keep.select(source, key), [source, key], "left_semi")).select(*stored.columns)


#: Tables whose rows are of one source, by source_id.
OF_SOURCES = ("sources", "evidence_spans", "property_measurements", "effect_claims", "ingestion_runs", "artifacts", "extraction_claims", "numeric_facts", "unit_vectors")
#: Keys of the tables that sources share.
SHARED = {"entities": ["entity_id"], "relations": ["relation_id"], "entity_aliases": ["alias_norm", "entity_id"]}


def changes_of_deletion(ledger: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """Rows of the shared tables that change when a source is deleted, as they are afterwards, with `gone` where they go.

    The source's spans leave the lists of entities and relations. A list that this empties takes its entity along, unless that is of a
    dictionary (its id doesn't begin with `ent_`), and its relation. Relations whose ends aren't there go too, and aliases of entities that go.
    """
    spans = ledger["evidence_spans"].filter(F.col("source_id") == source_id).select(F.col("span_id").alias("id"))

    def stripped(df: DataFrame, key: str) -> DataFrame:
        ids = df.select(key, F.posexplode("evidence_span_ids").alias("i", "id"))
        # Only places in the lists come back, and the lists meet them where they lie by key.
        lost = ids.join(spans, "id", "left_semi").groupBy(key).agg(F.collect_list("i").alias("__lost"))
        left = F.array_except(F.sequence(F.lit(0), F.size("evidence_span_ids") - 1), F.col("__lost"))
        return df.join(lost, key).withColumn("evidence_span_ids", F.transform(left, lambda i: F.get("evidence_span_ids", i))).select(*df.columns)

    entities = stripped(ledger["entities"], "entity_id")
    entities = entities.withColumn("gone", (F.size("evidence_span_ids") == 0) & F.col("entity_id").startswith("ent_"))
    lost = entities.filter("gone").select("entity_id")
    alive = ledger["entities"].select("entity_id").join(lost, "entity_id", "left_anti")
    relations = ledger["relations"]
    dead = relations.join(alive, F.col("src_entity_id") == F.col("entity_id"), "left_anti").unionByName(relations.join(alive, F.col("dst_entity_id") == F.col("entity_id"), "left_anti")).dropDuplicates(["relation_id"])
    touched = stripped(relations, "relation_id").join(dead.select("relation_id"), "relation_id", "left_anti").withColumn("gone", F.size("evidence_span_ids") == 0)
    aliases = ledger["entity_aliases"].join(lost, "entity_id", "left_semi").select(*ledger["entity_aliases"].columns)
    return {"entities": entities, "relations": touched.select(*relations.columns, "gone").unionByName(dead.select(*relations.columns).withColumn("gone", F.lit(True))), "entity_aliases": aliases.withColumn("gone", F.lit(True))}


def applied(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with its changed rows as they are in changes, without those that are gone."""
    return old.join(changes.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(changes.filter(~F.col("gone")).select(*old.columns))


def delete_source(ledger: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """The ledger without one source: its rows, and what `changes_of_deletion` says of the shared tables."""
    own = {name: ledger[name].filter(~F.col("source_id").eqNullSafe(F.lit(source_id))) for name in OF_SOURCES if name in ledger}
    return dict(ledger) | own | {name: applied(ledger[name], rows, SHARED[name]) for name, rows in changes_of_deletion(ledger, source_id).items()}


def quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows with a reason as runs of status `quarantined` whose error begins with it in brackets."""
    marked = rows.withColumn("__reason", reason)
    bad = marked.filter("__reason is not null").withColumn("status", F.lit("quarantined")).withColumn("error", F.concat(F.lit("["), F.col("__reason"), F.lit("]"))).drop("__reason")
    return marked.filter("__reason is null").drop("__reason"), bad
