"""Views over the driver's tables that have the ledger's shape, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows on all cores, for work that costs far more than a shuffle; a table of enough files stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source a document; its label follows the document's marks."""
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 0, "confidential").when(F.col("quality").isNotNull(), "internal").otherwise("public")
    return docs.select("doc_id", "source", "lang").join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("title"), F.lit("text").alias("document_type"), label.alias("security_label"),
        (F.col("doc_id") % 70 + 1955).cast("bigint").alias("year"), F.col("lang").alias("geography"),
    )


SOURCES = """sources AS (
    SELECT d.doc_id AS source_id, d.source AS title, 'text' AS document_type,
        CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 0 THEN 'confidential' WHEN quality IS NOT NULL THEN 'internal' ELSE 'public' END AS security_label,
        CAST(d.doc_id % 70 + 1955 AS BIGINT) AS year, d.lang AS geography
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of the documents that are no headings."""
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "visible_text"))
    kept = lines.filter((F.trim("visible_text") != "") & ~F.trim("visible_text").startswith("#"))
    return kept.select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("span_id"), F.col("doc_id").alias("source_id"), F.col("line").cast("bigint").alias("block"), "visible_text")


SPANS = r"""spans AS (
    SELECT doc_id * 1000000 + i - 1 AS span_id, doc_id AS source_id, CAST(i - 1 AS BIGINT) AS block, w[i] AS visible_text
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL))
    WHERE trim(w[i], ' ') <> '' AND NOT starts_with(trim(w[i], ' '), '#')
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion runs: the events of a user are the runs of a source."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), "value", "props")


RUNS = "runs AS (SELECT event_id AS run_id, user_id AS source_id, event_type AS status, ts AS created_at, value, props FROM events)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: the lines of an order are what was measured in an experiment."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("experiment_id"), F.col("l_partkey").alias("property_id"), F.col("l_suppkey").alias("material_id"), F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("direction"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


MEASUREMENTS = """measurements AS (
    SELECT l_orderkey AS experiment_id, l_partkey AS property_id, l_suppkey AS material_id, l_linenumber AS line, l_extendedprice AS value,
        l_returnflag AS method, l_linestatus AS direction, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of five types, with a number that stands for the length of their evidence list."""
    parts = (("region", "r_regionkey", "r_name", "0"), ("nation", "n_nationkey", "n_name", "n_regionkey"), ("customer", "c_custkey", "c_name", "c_nationkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"), ("part", "p_partkey", "p_name", "p_size"))
    frames = [
        table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}_"), F.col(k).cast("string")).alias("entity_id"), F.lit(t).alias("entity_type"), F.lower(n).alias("canonical_key"), F.col(n).alias("canonical_name"), F.expr(e).cast("bigint").alias("evidence_count"))
        for t, k, n, e in parts
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


ENTITIES = "entities AS (" + " UNION ALL ".join(
    f"SELECT '{t}_' || {k} AS entity_id, '{t}' AS entity_type, lower({n}) AS canonical_key, {n} AS canonical_name, CAST({e} AS BIGINT) AS evidence_count FROM {t}"
    for t, k, n, e in (("region", "r_regionkey", "r_name", "0"), ("nation", "n_nationkey", "n_name", "n_regionkey"), ("customer", "c_custkey", "c_name", "c_nationkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"), ("part", "p_partkey", "p_name", "p_size"))
) + ")"


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as aliases of the parts."""
    return table(spark, sf_dir, "part").select(F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("alias_norm"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entity_id"))


ALIASES = "aliases AS (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS alias_norm, 'part_' || p_partkey AS entity_id FROM part)"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between the entities."""
    of = lambda t, a, b: table(spark, sf_dir, t).select(a.alias("src_entity_id"), b.alias("dst_entity_id"))
    name = lambda t, k: F.concat(F.lit(f"{t}_"), F.col(k).cast("string"))
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()  # numbers, which are far shorter than names
    made = pairs.select(name("part", "l_partkey").alias("src_entity_id"), name("supplier", "l_suppkey").alias("dst_entity_id"))
    found = (
        of("nation", name("nation", "n_nationkey"), name("region", "n_regionkey")).withColumn("relation_type", F.lit("PART_OF"))
        .unionByName(of("customer", name("customer", "c_custkey"), name("nation", "c_nationkey")).withColumn("relation_type", F.lit("LOCATED_IN")))
        .unionByName(of("supplier", name("supplier", "s_suppkey"), name("nation", "s_nationkey")).withColumn("relation_type", F.lit("LOCATED_IN")))
        .unionByName(made.withColumn("relation_type", F.lit("PRODUCED_BY")))
    )
    return found.select(F.concat_ws(":", "src_entity_id", "relation_type", "dst_entity_id").alias("relation_id"), "src_entity_id", "relation_type", "dst_entity_id")


RELATIONS = """relations AS (
    SELECT src_entity_id || ':' || relation_type || ':' || dst_entity_id AS relation_id, * FROM (
        SELECT 'nation_' || n_nationkey AS src_entity_id, 'PART_OF' AS relation_type, 'region_' || n_regionkey AS dst_entity_id FROM nation
        UNION ALL SELECT 'customer_' || c_custkey, 'LOCATED_IN', 'nation_' || c_nationkey FROM customer
        UNION ALL SELECT 'supplier_' || s_suppkey, 'LOCATED_IN', 'nation_' || s_nationkey FROM supplier
        UNION ALL SELECT DISTINCT 'part_' || l_partkey, 'PRODUCED_BY', 'supplier_' || l_suppkey FROM lineitem
    )
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric facts: the measures of each line, one a row."""
    m = measurements(spark, sf_dir)
    wide = F.array(*(F.struct(F.lit(p).alias("prop"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for p, c, u in (("quantity", "quantity", "pcs"), ("price", "value", "usd"), ("discount", "discount", ""), ("tax", "tax", ""))))
    return m.select(F.col("experiment_id").alias("span_id"), F.concat(F.lit("part_"), F.col("property_id").cast("string")).alias("subject"), F.explode(wide).alias("f")).select("span_id", "subject", "f.*")


FACTS = MEASUREMENTS + """, facts AS (
    SELECT experiment_id AS span_id, 'part_' || property_id AS subject, u.prop AS prop, u.value AS value, u.unit AS unit FROM (
        SELECT experiment_id, property_id, unnest([
            {'prop': 'quantity', 'value': CAST(quantity AS DOUBLE), 'unit': 'pcs'}, {'prop': 'price', 'value': CAST(value AS DOUBLE), 'unit': 'usd'},
            {'prop': 'discount', 'value': CAST(discount AS DOUBLE), 'unit': ''}, {'prop': 'tax', 'value': CAST(tax AS DOUBLE), 'unit': ''}]) AS u FROM measurements)
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer sentences and the text that each one cites: a turn and the one before it."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("cited", before).filter((F.col("role") == "assistant") & F.col("cited").isNotNull()).select("conv_id", "turn", F.col("text").alias("sentence"), "cited")


TURNS = """turns AS (
    SELECT conv_id, turn, text AS sentence, cited FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS cited FROM conversations)
    WHERE role = 'assistant' AND cited IS NOT NULL
)"""
