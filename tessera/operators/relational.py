"""Ranking, counting and ordered selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark limits the window to one row a task and key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def first_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Sort and limit together: each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def list_sources(sources: DataFrame, spans: DataFrame, measurements: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its numbers of spans and measurements and the status of its latest run.

    Both sides are counted before they are joined, so their rows are never paired with each other.
    """
    n_spans = counts(spans, "source_id", name="evidence_count")
    n_measured = counts(measurements, "source_id", name="measurement_count")
    last = latest(runs.select("source_id", "status", "created_at", "run_id"), ["source_id"], F.col("created_at").desc(), F.col("run_id").desc()).select("source_id", F.col("status").alias("run_status"))
    out = sources
    for side in (n_spans, n_measured, last):
        out = out.join(side, "source_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("evidence_count", "measurement_count")})


def search_entities(entities: DataFrame, aliases: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Entities whose key or alias is or holds the key: equal keys first, then equal aliases, then the rest."""
    hit = aliases.filter(F.col("alias_norm").contains(key)).groupBy("entity_id").agg(F.min(F.when(F.col("alias_norm") == key, 1).otherwise(2)).alias("by_alias"))
    found = entities.join(hit, "entity_id", "left").filter(F.col("by_alias").isNotNull() | F.col("canonical_key").contains(key))
    rank = F.when(F.col("canonical_key") == key, 0).otherwise(F.coalesce("by_alias", F.lit(2)))
    return top(found.select("entity_id", "entity_type", "canonical_name", "evidence_count", rank.cast("bigint").alias("rank")), limit, F.col("rank"), F.col("evidence_count").desc(), "canonical_name", "entity_id")


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have each value of each of the columns, in one pass; nulls don't count."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return counts(df.select(F.explode(pairs).alias("x")).select("x.*").filter("value is not null"), "facet", "value")


def listed(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of each key as a sorted list `items` of structs: what is asked for is the list itself."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))


def free_text(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Rows whose columns, joined by a space, hold the query without regard to case; an empty query keeps all."""
    return df.filter(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).contains(query.strip().lower()))


def within_budget(df: DataFrame, keys: Sequence[str], size: str, budget: int, *order: Column) -> DataFrame:
    """The longest prefix of each key whose sizes sum to the budget at most; the first row is always in."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(size).over(w)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    # Sizes are not negative, so once the sum is over the budget it stays over.
    return df.withColumn("__in", (used <= budget) | first).filter("__in").drop("__in")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 1234) -> DataFrame:
    """Exactly n rows, the same for the same seed."""
    return top(df, n, F.xxhash64(key, F.lit(seed)), F.col(key))


def shard(df: DataFrame, key: str, count: int, index: int) -> DataFrame:
    """One of `count` shares of the rows, dealt by a hash of the key."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(count)) == index)


def ordinal_shard(df: DataFrame, order: Sequence[str], count: int, index: int) -> DataFrame:
    """One of `count` shares of the rows, dealt in turn in the given order, without one task that sees all rows.

    Rows are range-partitioned by the order; each partition starts at the number of rows before it.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = {r.p: r.n for r in spread.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts, before = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(before)]
        before += sizes[p]
    if not starts:
        return df.filter("false")
    ordinal = own + F.element_at(F.create_map(*starts), part)
    return spread.filter(ordinal % count == index).drop("__id")


def metric_map(text: Column) -> Column:
    """The numbers of a JSON object by name, booleans as 0 and 1; other values have no place in it."""
    read = F.from_json(text, "map<string, string>")
    number = lambda v: F.when(v.isin("true", "false"), (v == "true").cast("double")).otherwise(v.try_cast("double"))
    return F.map_filter(F.transform_values(read, lambda k, v: number(v)), lambda k, v: v.isNotNull())


def content_dedup(df: DataFrame, content: str, *order: Column) -> DataFrame:
    """The first of the rows with equal content."""
    return latest(df.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)), ["content_hash"], *order)


def metric_means(results: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Mean of each metric over the maps that have it."""
    return results.select(F.explode(metrics).alias("metric", "value")).filter("value is not null").groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def reason_codes(runs: DataFrame, error: str = "error") -> DataFrame:
    """Runs by the code in brackets that their error begins with, else `unknown`."""
    code = F.nullif(F.regexp_extract(F.coalesce(error, F.lit("")), r"^\[([^\]]*)\]", 1), F.lit(""))
    return runs.groupBy(F.coalesce(code, F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def append_unseen(first: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """first in its order, then the rows of more that it lacks, in theirs. Both have key and rank."""
    fresh = more.join(first.select(key), key, "left_anti")
    both = first.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
    return both.withColumn("position", F.struct("part", "rank"))


def evidence_of(rows: DataFrame, spans: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """Spans that any of the rows lists."""
    return spans.join(rows.select(F.explode(ids).alias("span_id")).distinct(), "span_id", "left_semi")
