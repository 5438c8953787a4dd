"""More of the catalogue: evidence records, extraction, attribution, indexing, answers and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.functions import dates, numbers
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import analytics, answers, extraction, graph, qa, resolution, retrieval
from tessera.operators import relational as R
from tessera.plans import adapters as A
from tessera.queries import long, query
from tessera.sources import files


def key(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# --- counts and lists -------------------------------------------------------------------------------------------


@query(f"""WITH {A.SOURCES} SELECT 'geography' AS facet, geography AS value, count(*) AS n FROM sources WHERE geography IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'document_type', document_type, count(*) FROM sources GROUP BY 2 UNION ALL SELECT 'security_label', security_label, count(*) FROM sources GROUP BY 2""")
def facet_counts(spark, d):
    return R.facets(A.sources(spark, d), ["geography", "document_type", "security_label"])


@query(f"WITH {A.RUNS} SELECT status, count(*) AS n FROM runs GROUP BY 1")
def ingest_counters(spark, d):
    return R.counts(A.runs(spark, d), "status")


@query(f"""WITH {A.FACTS} SELECT span_id, string_agg(CASE WHEN unit = '' THEN prop ELSE subject END || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || unit, ';' ORDER BY CASE WHEN unit = '' THEN prop ELSE subject END, CAST(round(value * 100) AS BIGINT), unit) AS facts FROM facts GROUP BY 1""")
def fact_list_per_span(spark, d):
    facts = A.facts(spark, d).select("span_id", F.when(F.col("unit") == "", F.col("prop")).otherwise(F.col("subject")).alias("subject"), F.round(F.col("value") * 100).cast("bigint").alias("value"), "unit")
    listed = R.listed(facts, ["span_id"], ["subject", "value", "unit"])
    return listed.select("span_id", F.array_join(F.transform("items", lambda x: F.concat(x["subject"], F.lit("="), x["value"].cast("string"), x["unit"])), ";").alias("facts"))


@query("SELECT l_suppkey AS material_id, l_returnflag AS property_id, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS experiments FROM lineitem GROUP BY 1, 2")
def experiment_ids_per_key(spark, d):
    line = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("material_id"), F.col("l_returnflag").alias("property_id"), F.col("l_orderkey").cast("string").alias("id")).distinct()
    return R.listed(line, ["material_id", "property_id"], ["id"]).select("material_id", "property_id", F.array_join(F.transform("items", lambda x: x["id"]), ",").alias("experiments"))


@query("""WITH c AS (SELECT s.m, p.r, count(l_orderkey) > 0 AS covered FROM (SELECT DISTINCT c_nationkey AS m FROM customer) s CROSS JOIN (SELECT DISTINCT p_type AS r FROM part) p
        LEFT JOIN (SELECT c_nationkey, p_type, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey) x ON x.c_nationkey = s.m AND x.p_type = p.r GROUP BY 1, 2)
    SELECT m AS material_id, count(*) FILTER (WHERE covered) AS covered, count(*) FILTER (WHERE NOT covered) AS gaps FROM c GROUP BY 1""")
def gap_counts(spark, d):
    of = lambda t, c, name: A.table(spark, d, t).select(F.col(c).alias(name)).distinct()
    line, orders, customers, parts = (A.table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    done = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"]).join(parts, line["l_partkey"] == parts["p_partkey"])
    done = done.select(F.col("c_nationkey").alias("material_id"), F.col("p_type").alias("regime_type"), F.lit("any").alias("property_id"))
    one = spark.range(1).select(F.lit("any").alias("property_id"))
    return analytics.coverage(of("customer", "c_nationkey", "material_id"), of("part", "p_type", "regime_type"), one, done).drop("cells")


@query(f"""WITH {A.SOURCES} SELECT source_id FROM sources WHERE contains(lower(concat_ws(' ', title, document_type, geography, CAST(year AS VARCHAR))), 'en 19') AND security_label IN ('public', 'internal') AND geography IN ('en', 'fr')""")
def source_text_filter(spark, d):
    rows = A.sources(spark, d)
    found = R.free_text(rows, ["title", "document_type", "geography", "year"], "EN 19")
    return found.filter(F.col("security_label").isin("public", "internal") & F.col("geography").isin("en", "fr")).select("source_id")


@query("""SELECT o_orderkey, o_clerk, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END NULLS LAST, o_orderstatus DESC, o_orderkey) AS BIGINT) AS position
    FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority AS o_clerk FROM orders) QUALIFY position <= 40""")
def nulls_last_order(spark, d):
    from pyspark.sql import Window

    o = A.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("page"), "o_orderstatus", F.col("o_orderpriority").alias("o_clerk"))
    order = [F.col("page").asc_nulls_last(), F.desc("o_orderstatus"), F.col("o_orderkey")]
    return R.top(o, 40, *order).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("o_orderkey", "o_clerk", "position")  # 40 rows


@query("""WITH l AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind, CASE o_orderkey % 3 WHEN 0 THEN o_custkey ELSE o_orderkey % 5 END AS first, CASE o_orderkey % 3 WHEN 1 THEN (o_custkey % 7) * 10000 + o_orderkey % 100 ELSE 0 END AS second, o_custkey % 50 AS source_id FROM orders)
    SELECT o_orderkey, source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY kind, first, second, o_orderkey) AS BIGINT) AS position FROM l""")
def document_order(spark, d):
    from pyspark.sql import Window

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    locator = F.when(k % 3 == 0, F.concat(F.lit("section:text:block_"), c.cast("string"))).when(k % 3 == 1, F.concat(F.lit("table_"), (c % 7).cast("string"), F.lit(":row_"), (k % 100).cast("string"))).otherwise("page")
    rows = A.table(spark, d, "orders").select("o_orderkey", (c % 50).alias("source_id"), graph.document_order(locator, k % 5).alias("place"))
    return rows.select("o_orderkey", "source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("place", "o_orderkey")).cast("bigint").alias("position"))


@query("SELECT CAST(d AS BIGINT) AS shard, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS d FROM documents) WHERE d = 1 GROUP BY 1")
def ordinal_shard(spark, d):
    return R.ordinal_shard(A.table(spark, d, "documents").select("doc_id"), ["doc_id"], 4, 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).cast("bigint").alias("shard"), "n")


@query("SELECT metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT unnest(['k', 'flag']) AS metric, unnest([CAST(l_quantity AS DOUBLE), CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END]) AS v FROM lineitem) GROUP BY 1")
def boolean_metric_means(spark, d):
    shown = F.concat(F.lit('{"k": '), F.col("l_quantity").cast("double").cast("string"), F.lit(', "flag": '), (F.col("l_linenumber") % 2 == 0).cast("string"), F.lit(', "name": "x", "none": null}'))
    maps = A.table(spark, d, "lineitem").select(R.metric_map(shown).alias("metrics"))
    return R.metric_means(maps).select("metric", F.round("mean", 6).alias("mean"), "n")


# --- experiments and answers ------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS experiment_id, l_partkey AS property_id, l_suppkey AS source_id, l_linenumber AS line, l_extendedprice AS value, CASE WHEN l_tax > 0.04 THEN 'increase' ELSE 'decrease' END AS direction, 's' || l_orderkey || ',s' || l_linenumber AS evidence_ids
    FROM lineitem WHERE l_linenumber % 2 = 0""")
def measurements_with_effects(spark, d):
    line = A.table(spark, d, "lineitem")
    keys = ["experiment_id", "property_id", "source_id"]
    named = line.select(F.col("l_orderkey").alias("experiment_id"), F.concat_ws(":", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").alias("property_id"), F.col("l_suppkey").alias("source_id"), "l_partkey", "l_linenumber", "l_extendedprice", "l_tax")
    own = named.select(*keys, "l_partkey", F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("value"), F.array(key("s", "experiment_id")).alias("supporting_span_ids"))
    effects = named.filter("l_linenumber % 2 = 0").select(*keys, F.when(F.col("l_tax") > 0.04, "increase").otherwise("decrease").alias("direction"), F.array(key("s", "experiment_id"), key("s", "l_linenumber")).alias("supporting_span_ids"))
    return analytics.experiments(own, effects).select("experiment_id", F.col("l_partkey").alias("property_id"), "source_id", "line", "value", "direction", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("SELECT p_partkey AS experiment_id, p_name || ': ' || lower(p_brand) || ' — increase, ' || p_type || ': ' || p_size || ' HV' || CASE WHEN p_partkey % 2 = 0 THEN ', Δ ' || p_size || '.5 HV' ELSE '' END || '.' AS sentence, 'fact:' || p_partkey || ':' || lower(p_type) AS fact FROM part")
def answer_sentences(spark, d):
    p = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("experiment_id"), F.col("p_name").alias("material_name"), F.lower("p_brand").alias("regime_summary"), F.lit("increase").alias("direction"), F.col("p_type").alias("property_name"), F.lower("p_type").alias("property_id"),
        F.col("p_size").cast("double").alias("value"), F.lit("HV").alias("unit"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 0.5).cast("double").alias("delta_value"), F.array(F.lit("s1")).alias("evidence_ids"),
    )
    return qa.answer_sentences(p).select("experiment_id", "sentence", F.col("fact_ids")[0].alias("fact"))


@query("SELECT p_partkey AS experiment_id, CASE WHEN p_size % 2 = 0 THEN p_partkey % 7 || '>s' || p_size || '>' || p_partkey || '>' || p_brand || '>' || p_size || '>' || lower(p_type) END AS path FROM part")
def graph_path(spark, d):
    size = F.col("p_size")
    ids = F.when(size % 2 == 0, F.array(key("s", "p_size"), F.lit("more"))).otherwise(F.array().cast("array<string>"))
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("experiment_id"), (F.col("p_partkey") % 7).alias("source_id"), F.col("p_brand").alias("material_id"), size.alias("regime_id"), F.lower("p_type").alias("property_id"), ids.alias("evidence_ids"))
    return qa.graph_path(p).select("experiment_id", F.array_join("nodes", ">").alias("path"))


@query("SELECT p_partkey AS experiment_id, p_name AS material_name, p_type AS property_name FROM part WHERE trim(p_name) <> '' AND trim(p_type) <> '' ORDER BY p_partkey LIMIT 1")
def eval_probe(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("experiment_id"), F.col("p_name").alias("material_name"), F.col("p_type").alias("property_name"))
    return qa.probe(p)


@query("""SELECT experiment_id, CAST(mat + prop + reg + num AS BIGINT) AS score FROM (SELECT p_partkey AS experiment_id,
        CASE WHEN p_size = 30 THEN 6 ELSE 4 END AS mat, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END AS prop,
        CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS reg, CASE WHEN p_size = 30 THEN 1 ELSE 0 END + CASE WHEN p_size = 45 THEN 1 ELSE 0 END AS num FROM part)""")
def experiment_scores_of_alloys(spark, d):
    q = qa.compile_question("hardness of ni30cu, 45 h of aging")
    p = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("experiment_id"), F.concat(F.lit("Ni-"), F.col("p_size").cast("string"), F.lit("Cu")).alias("material_name"), F.when(F.col("p_partkey") % 3 == 0, "vickers_hardness").otherwise("grain").alias("property_id"), F.lit("").alias("property_name"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "Старение ").otherwise("x "), F.col("p_size").cast("string"), F.lit(" h")).alias("regime_summary"),
    )
    return p.select("experiment_id", long(qa.score(q), "score"))


@query("SELECT span_id, source_id FROM (SELECT l_orderkey AS span_id, l_suppkey AS source_id, bool_or(l_returnflag = 'A' AND l_quantity <= 20) AS s_ok, bool_or(l_returnflag = 'A') AS s_any, bool_or(l_returnflag = 'N' AND l_quantity >= 5) AS c_ok, bool_or(l_returnflag = 'N') AS c_any FROM lineitem GROUP BY 1, 2) WHERE (s_ok OR NOT s_any) AND (c_ok OR NOT c_any)")
def subject_constraints(spark, d):
    asked = C.parse("сульфаты не более 20 мг/л, а хлориды не менее 5 мг/дм³")
    flag = F.col("l_returnflag")
    fact = F.struct(F.when(flag == "A", "сульфаты").when(flag == "N", "хлориды").otherwise("прочее").alias("subject"), F.col("l_quantity").cast("double").alias("value"), F.lit("мг/л").alias("unit"))
    rows = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("span_id"), F.col("l_suppkey").alias("source_id")).agg(F.collect_list(fact).alias("facts"))
    return rows.filter(C.facts_pass(F.col("facts"), asked)).select("span_id", "source_id")


@query("SELECT lower(split_part(o_orderpriority, '-', 2)) || ':' || CASE WHEN o_custkey % 1000 >= 10 THEN CAST(o_custkey % 1000 AS VARCHAR) ELSE '' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def regime_buckets(spark, d):
    o = A.table(spark, d, "orders")
    regime = F.concat(F.lit("regime_"), F.lower(F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(2))), F.lit("_"), (F.col("o_custkey") % 1000).cast("string"))
    return R.counts(o.select(numbers.regime_bucket(regime).alias("bucket")), "bucket")


@query("""WITH e AS (SELECT conv_id AS question_id, turn AS sentence_id, unnest([turn + 100, turn % 5]) AS span_id, unnest([0, 1]) AS i FROM conversations),
        f AS (SELECT question_id, span_id, min(sentence_id * 10 + i) AS place FROM e GROUP BY 1, 2)
    SELECT question_id, span_id, row_number() OVER (PARTITION BY question_id ORDER BY place, span_id) AS number FROM f""")
def citation_numbers(spark, d):
    t = A.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("sentence_id"), F.array(F.col("turn") + 100, F.col("turn") % 5).alias("span_ids"))
    return answers.citation_numbers(t).select("question_id", "span_id", long("number", "number"))


@query("""WITH t AS (SELECT conv_id AS question_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
    SELECT question_id, sha256(string_agg('[' || turn || '] ' || CASE WHEN turn % 2 = 0 THEN 'label: ' ELSE '' END || substr(coalesce(text, ''), 1, 320), chr(10) ORDER BY turn)) AS digest FROM t WHERE rn <= 12 GROUP BY 1""")
def prompt_packets(spark, d):
    t = A.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("span_id"), F.coalesce("text", F.lit("")).alias("visible_text"), F.when(F.col("turn") % 2 == 0, "label").alias("source_label"))
    return answers.packet(t, F.col("span_id")).select("question_id", F.sha2("packet", 256).alias("digest"))


@query("""SELECT turn % 4 AS kind, CASE WHEN turn % 4 = 0 THEN 'no_citation' WHEN turn % 4 = 1 THEN 'unknown_span' ELSE 'numbers' END AS reason, count(*) AS n FROM conversations WHERE turn % 4 < 3 GROUP BY 1, 2""")
def gated_sentences(spark, d):
    turn = F.col("turn")
    t = A.table(spark, d, "conversations").select(
        F.col("conv_id").alias("question_id"), turn.alias("sentence_id"), F.when(turn % 4 == 2, "it took 7 h").otherwise("it took 5 h").alias("sentence"),
        F.when(turn % 4 == 0, F.array().cast("array<int>")).when(turn % 4 == 1, F.array(F.lit(-1))).otherwise(F.array(turn.cast("int"))).alias("span_ids"),
    )
    spans = A.table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), turn.cast("int").alias("span_id"), F.lit("after 5 h of work").alias("visible_text"))
    _, dropped = answers.gate(t, spans)
    return R.counts(dropped.select((F.col("sentence_id") % 4).alias("kind"), "reason"), "kind", "reason")


@query("SELECT p_partkey, substr(p_name, 1, 80) || CASE WHEN p_size % 2 = 0 THEN ', ' || (2000 + p_size % 20) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ', ru' ELSE '' END AS label FROM part")
def source_labels(spark, d):
    size = F.col("p_size")
    return A.table(spark, d, "part").select("p_partkey", answers.source_label(F.col("p_name"), F.when(size % 2 == 0, 2000 + size % 20), F.when(size % 3 == 0, F.lit("ru"))).alias("label"))


@query("""WITH p AS (SELECT l_suppkey AS m, l_orderkey AS a, lead(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS b FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))
    SELECT m, a, b FROM p WHERE b IS NOT NULL AND (m IN (2, 3) OR a % 50 = 0 OR b % 50 = 0)""")
def relevant_conflicts(spark, d):
    from pyspark.sql import Window

    done = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("material_id"), F.col("l_orderkey").alias("a")).distinct()
    pairs = done.withColumn("b", F.lead("a").over(Window.partitionBy("material_id").orderBy("a"))).filter("b is not null")
    pairs = pairs.select("material_id", F.struct(F.col("a").alias("experiment_id")).alias("a"), F.struct(F.col("b").alias("experiment_id")).alias("b"))
    chosen = done.select(F.when(F.col("material_id").isin(2, 3), F.col("material_id")).otherwise(-1).alias("material_id"), F.when(F.col("a") % 50 == 0, F.col("a")).otherwise(-1).alias("experiment_id"))
    return answers.relevant_conflicts(pairs, chosen, False).select(F.col("material_id").alias("m"), F.col("a.experiment_id").alias("a"), F.col("b.experiment_id").alias("b"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z])(widge|rings)') OR regexp_matches(lower(p_name), '(^|[^a-z])ring([^a-z]|$)')")
def relevant_gaps(spark, d):
    p = A.table(spark, d, "part")
    return answers.relevant_gaps(p, F.col("p_name"), "what of WIDGETry or a ring?", False).select("p_partkey")


# --- extraction -------------------------------------------------------------------------------------------------


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    line = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    of = lambda prefix, c, kind, score, origin: line.select(key("s", "l_orderkey").alias("span_id"), key(prefix, c).alias("text"), F.lit(kind).alias("entity_type"), F.lit(score).alias("confidence"), F.lit(origin).alias("origin"))
    return extraction.mention_union(of("Part ", "l_partkey", "material", 0.95, "rule"), of("PART ", "l_partkey", "material", 0.8, "model"), of("Unit ", "l_suppkey", "equipment", 0.7, "ner"))


@query("SELECT origin, count(*) AS n FROM (SELECT 'rule' AS origin FROM lineitem UNION ALL SELECT 'model' FROM lineitem UNION ALL SELECT 'ner' FROM lineitem) GROUP BY 1")
def mention_union(spark, d):
    return R.counts(_mentions(spark, d), "origin")


_PIPE = """m AS (SELECT DISTINCT 's' || l_orderkey AS span, CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey ELSE 'new part ' || l_partkey END AS e, 'material' AS k FROM lineitem UNION SELECT DISTINCT 's' || l_orderkey, 'new unit ' || l_suppkey, 'equipment' FROM lineitem)"""


@query(f"""WITH {_PIPE}, s AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY span) <= 12), x AS (SELECT a.e AS a, b.e AS b, count(DISTINCT a.span) AS n FROM s a JOIN s b USING (span) WHERE a.k = 'material' AND b.k = 'equipment' GROUP BY 1, 2)
    SELECT 'mentions' AS what, count(*) AS n FROM m UNION ALL SELECT 'created', count(DISTINCT e) FROM m WHERE starts_with(e, 'new') UNION ALL SELECT 'evidence', count(*) FROM m UNION ALL SELECT 'edges', count(*) FROM x UNION ALL SELECT 'spans of edges', CAST(sum(n) AS BIGINT) FROM x""")
def span_pipeline(spark, d):
    parts = A.table(spark, d, "part").filter("p_partkey % 2 = 0")
    entities = parts.select(key("p", "p_partkey").alias("entity_id"), F.lit("material").alias("entity_type"), key("part ", "p_partkey").alias("canonical_key"))
    aliases = spark.createDataFrame([], "alias_norm string, entity_id string")
    out = extraction.span_pipeline([_mentions(spark, d)], entities, aliases)
    sizes = {"mentions": out.resolved, "created": out.created, "evidence": out.evidence.select(F.explode("spans").alias("span"))}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in sizes.items()]
    # Edges are made once for both of their counts.
    edges = out.edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.size("evidence_span_ids")), F.lit(0)).cast("bigint").alias("spans of edges"))
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(edges.unpivot([], ["edges", "spans of edges"], "what", "n"))


@query("""SELECT 's' || l_orderkey AS span_id, 'p' || l_partkey AS src_entity_id, 'USED_EQUIPMENT' AS relation_type, 'u' || l_suppkey AS dst_entity_id, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2, 3, 4""")
def typed_edges(spark, d):
    line = A.table(spark, d, "lineitem")
    span = key("s", "l_orderkey").alias("span_id")
    ends = line.select(span, F.lit("material").alias("entity_type"), key("part ", "l_partkey").alias("key"), key("p", "l_partkey").alias("entity_id")).unionByName(line.select(span, F.lit("equipment").alias("entity_type"), key("unit ", "l_suppkey").alias("key"), key("u", "l_suppkey").alias("entity_id"))).distinct()
    kind = F.when(F.col("l_linenumber") % 2 == 0, "USED_EQUIPMENT").otherwise("UNKNOWN_TYPE")
    stated = line.select(span, F.lit("material").alias("src_type"), key("part ", "l_partkey").alias("src_key"), kind.alias("relation_type"), F.lit("equipment").alias("dst_type"), key("unit ", "l_suppkey").alias("dst_key"))
    found = graph.typed_edges(stated, ends, extraction.RELATION_TYPES)
    return R.counts(found, "span_id", "src_entity_id", "relation_type", "dst_entity_id")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return A.spans(spark, d).select(F.col("source_id").cast("string").alias("source_id"), "span_id", F.lower("visible_text").alias("canonical"))


@query(f"WITH {A.SPANS} SELECT CAST(source_id AS VARCHAR) AS source_id, k AS key, count(*) AS n FROM spans, (SELECT unnest(['the ', 'der', 'qqq']) AS k) WHERE contains(lower(visible_text), k) GROUP BY 1, 2")
def packet_attribution(spark, d):
    spans = _words(spark, d)
    keys = spans.select("source_id").distinct().withColumn("key", F.explode(F.array(F.lit("the "), F.lit("der"), F.lit("qqq"), F.lit(""))))
    return R.counts(graph.attribute_entities(spans, keys), "source_id", "key")


@query(f"WITH {A.SPANS} SELECT CAST(source_id AS VARCHAR) AS source_id, min(span_id) AS span_id FROM spans WHERE contains(lower(visible_text), 'the ') OR contains(lower(visible_text), 'der') GROUP BY 1")
def relation_attribution(spark, d):
    spans = _words(spark, d)
    relations = spans.select("source_id").distinct().withColumns({"src_key": F.lit("the "), "relation_type": F.lit("USES_MATERIAL"), "dst_key": F.lit("der")})
    return graph.attribute_relations(spans, relations, "span_id").select("source_id", "span_id")


@query("""SELECT src, kind, dst FROM (SELECT 'm' || l_partkey AS src, 'DESCRIBED_IN' AS kind, 'pub' || l_orderkey AS dst FROM lineitem UNION SELECT 'pub' || o_orderkey, 'AUTHORED_BY', 'c' || o_custkey FROM orders)""")
def publication_links(spark, d):
    orders, line = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    publications = orders.select(F.col("o_orderkey").alias("source_id"), key("pub", "o_orderkey").alias("publication_id"))
    mentions = line.select(F.col("l_orderkey").alias("source_id"), F.lit("material").alias("entity_type"), key("m", "l_partkey").alias("entity_id")).unionByName(line.select(F.col("l_orderkey").alias("source_id"), F.lit("team").alias("entity_type"), key("t", "l_suppkey").alias("entity_id")))
    authors = orders.select(F.col("o_orderkey").alias("source_id"), key("c", "o_custkey").alias("entity_id"))
    return extraction.publication_links(publications, mentions, authors).select(F.col("src_entity_id").alias("src"), F.col("relation_type").alias("kind"), F.col("dst_entity_id").alias("dst"))


@query("SELECT l_orderkey AS span_id, l_linenumber AS start, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2")
def offset_dedup(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("span_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.lit("material").alias("entity_type"), F.col("l_quantity").alias("score"), F.col("l_partkey").cast("string").alias("text"))
    return resolution.best_offsets(rows).select("span_id", "start", "score")


@query("SELECT matched_by, count(DISTINCT k) AS keys FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'key' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'semantic' ELSE 'created' END AS matched_by, p_partkey AS k FROM part) GROUP BY 1")
def semantic_resolution(spark, d):
    # Names of the third kind hold a digit and names of the second kind don't: these alone may merge by their vectors.
    k = F.col("p_partkey")
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    name = F.when(k % 3 == 1, F.concat(F.lit("name "), letters(k))).otherwise(F.concat(F.lit("part "), k.cast("string")))
    rows = A.table(spark, d, "part").select(k, name.alias("text"), F.lit("material").alias("entity_type"), F.lit(0.9).alias("confidence"), F.array(F.when(k % 2 == 0, 1.0).otherwise(0.0), F.when(k % 2 == 0, 0.0).otherwise(1.0)).alias("vec"))
    mentions = resolution.best_mentions(rows.select(k.alias("span_id"), "text", "entity_type", "confidence"))
    known = rows.filter("p_partkey % 3 = 0").select(key("p", "p_partkey").alias("entity_id"), "entity_type", T.canonical_key(F.col("text")).alias("canonical_key"), F.lit(None).cast("array<double>").alias("vec"))
    one = spark.range(1).select(F.lit("by vector").alias("entity_id"), F.lit("material").alias("entity_type"), F.lit("zz").alias("canonical_key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    vectors = rows.select("entity_type", T.canonical_key(F.col("text")).alias("key"), "vec")
    found, _, _ = resolution.resolve(mentions, known.unionByName(one), spark.createDataFrame([], "alias_norm string, entity_id string"), vectors)
    return found.groupBy("matched_by").agg(F.countDistinct("key").alias("keys"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'alias' ELSE 'created' END AS matched_by, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1")
def learned_aliases(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("span_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "alias ").otherwise("made "), F.col("c_nationkey").cast("string")).alias("text"), F.lit("nation").alias("entity_type"), F.lit(0.9).alias("confidence"))
    nations = A.table(spark, d, "nation").select(key("n", "n_nationkey").alias("entity_id"), F.lit("nation").alias("entity_type"), F.lower("n_name").alias("canonical_key"), key("alias ", "n_nationkey").alias("alias_norm"))
    found, _, _ = resolution.resolve(resolution.best_mentions(c), nations, nations.select("alias_norm", "entity_id"))
    learned = resolution.learned_aliases(found).join(found.select(F.col("key").alias("alias_norm"), "matched_by").distinct(), "alias_norm")
    return R.counts(learned, "matched_by")


# --- index ------------------------------------------------------------------------------------------------------


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = A.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("unit_id"), (F.col("item_id") % 7).cast("string").alias("source_id"), "text", F.col("item_id").alias("i"))
    # Stored: one in three is as it was, one in three has another text, one in three is gone from the units.
    stored = items.select("unit_id", "source_id", F.sha2(F.when(F.col("i") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("text_hash"), F.array(F.lit(0.0), F.lit(9.0)).alias("vec"))
    return items.filter("i % 3 < 2").drop("i"), stored


@query("SELECT CAST(item_id AS VARCHAR) AS unit_id, sha256(text) AS text_hash, item_id % 3 = 0 AS kept FROM benchmark WHERE item_id % 3 < 2")
def index_upsert(spark, d):
    found = retrieval.index(*_units(spark, d))
    return found.select("unit_id", "text_hash", (F.size("vec") == 2).alias("kept"))


@query("SELECT CAST(item_id % 7 AS VARCHAR) AS source_id, count(*) AS n FROM benchmark WHERE item_id % 3 < 2 GROUP BY 1")
def reindex(spark, d):
    units, stored = _units(spark, d)
    return R.counts(retrieval.index(units, retrieval.index(units, stored)), "source_id")


@query("SELECT CAST(item_id AS VARCHAR) AS unit_id FROM benchmark WHERE item_id % 7 = 3 AND CAST(item_id AS VARCHAR) > '2' ORDER BY 1 LIMIT 1024")
def vector_scroll(spark, d):
    _, stored = _units(spark, d)
    return retrieval.scroll(stored, "3", "2").select("unit_id")


@query(r"SELECT item_id, CAST(count(DISTINCT w) AS BIGINT) AS terms, CAST(count(*) AS BIGINT) AS words FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark) GROUP BY 1")
def sparse_vectors(spark, d):
    counts = A.table(spark, d, "benchmark").select("item_id", V.sparse_counts(F.col("text")).alias("m")).filter(F.size("m") > 0)
    return counts.select("item_id", long(F.size("m"), "terms"), long(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x), "words"))


@query("SELECT 0 + p AS load, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS p FROM customer) GROUP BY 1")
def merged_views(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey")
    views = [c.withColumn("load", F.lit(0).cast("int")), c.filter("c_custkey % 2 = 0").withColumn("load", F.lit(1).cast("int"))]
    return R.counts(graph.merge_views(views, ["c_custkey"]), "load")


# --- readers ----------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\r\n|[\n\r]')), ' ') AS line FROM documents WHERE text IS NOT NULL) WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY 1""")
def text_lines(spark, d):
    lines = files.text_spans(A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text"))
    return lines.groupBy(F.col("path").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("visible_text")).alias("chars"))


@query("SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'not_a_number:duration_h' WHEN l_linenumber % 4 = 1 THEN 'empty:unit' WHEN l_linenumber % 4 = 2 THEN 'unknown_effect' ELSE 'good' END AS reason, count(*) AS n, round(sum(CASE WHEN l_linenumber % 4 = 3 THEN l_tax * 100 ELSE 0 END), 2) AS delta FROM lineitem GROUP BY 1")
def experiment_decode(spark, d):
    n = F.col("l_linenumber") % 4
    text_of = {
        "experiment_id": F.col("l_orderkey").cast("string"), "material": F.lit("Ni"), "regime": F.lit("aging"), "temperature_c": F.lit("700"), "duration_h": F.when(n == 0, "long").otherwise("8"), "atmosphere": F.lit("air"),
        "property": F.lit("hardness"), "method": F.lit("HV10"), "baseline_value": F.lit("210"), "treated_value": (210 + F.round(F.col("l_tax") * 100)).cast("int").cast("string"), "unit": F.when(n == 1, "").otherwise("HV"), "effect": F.when(n == 2, "better").otherwise("increase"),
    }
    good, bad = files.decode_experiments(A.table(spark, d, "lineitem").select(*(text_of[c].alias(c) for c in files.EXPERIMENT_COLUMNS)))
    rows = good.select(F.lit("good").alias("reason"), "delta_value").unionByName(bad.select("reason", F.lit(0.0).alias("delta_value")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("delta_value"), 2).alias("delta"))


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'bad_name' WHEN c_custkey % 5 = 1 THEN 'unsupported_type' WHEN c_custkey % 5 = 2 THEN 'empty' WHEN c_custkey % 5 = 3 THEN 'too_large' ELSE 'good' END AS error, count(*) AS n FROM customer GROUP BY 1")
def upload_checks(spark, d):
    n = F.col("c_custkey") % 5
    name = F.when(n == 0, F.concat(F.lit("a/"), F.col("c_name"), F.lit(".csv"))).when(n == 1, F.concat("c_name", F.lit(".exe"))).otherwise(F.concat("c_name", F.lit(".CSV")))
    size = F.when(n == 2, 0).when(n == 3, files.MOST_BYTES + 1).otherwise(10)
    return R.counts(A.table(spark, d, "customer").select(F.coalesce(files.upload_errors(name, size), F.lit("good")).alias("error")), "error")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1990 + p_size % 20 WHEN p_size % 3 = 1 THEN 2001 ELSE 2015 END AS year FROM part")
def source_years(spark, d):
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.concat(F.lit("report_"), (1990 + size % 20).cast("string"), F.lit(".pdf"))).otherwise("report.pdf")
    head = F.when(size % 3 == 1, "Норильск, 12 мая 2001 г.").otherwise("no date here")
    return A.table(spark, d, "part").select("p_partkey", long(dates.source_year(name, head, F.lit("2015-02-03")), "year"))


@query("SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'сульфаты' ELSE 'хлориды' END AS subject, 'содержание, мг/л' AS prop, 'мг/л' AS unit, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def tall_table_facts(spark, d):
    headers = F.array(*map(F.lit, ("Показатель", "Содержание, мг/л", "Примечание")))
    values = F.array(F.when(F.col("l_linenumber") % 2 == 0, "Сульфаты").otherwise("Хлориды"), F.translate(F.col("l_quantity").cast("string"), ".", ","), F.lit("5 проб"))
    rows = A.spread(A.table(spark, d, "lineitem").select("l_linenumber", "l_quantity")).select(headers.alias("headers"), values.alias("values"))
    each = numbers.facts_of_rows(rows).select(F.explode("facts").alias("f")).select("f.*")
    return each.groupBy("subject", "prop", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT c_custkey, replace(replace(lower(c_name || ' Ёж'), 'ё', 'е'), '-', '') AS form, CAST(len(list_distinct(regexp_extract_all(replace(replace(lower(c_name || ' Ёжики'), 'ё', 'е'), '-', ''), '[a-zа-я]{5,}'))) AS BIGINT) AS words FROM customer")
def question_forms(spark, d):
    c = A.table(spark, d, "customer")
    return c.select("c_custkey", T.question_form(F.concat("c_name", F.lit(" Ёж"))).alias("form"), long(F.size(T.content_tokens(T.question_form(F.concat("c_name", F.lit(" Ёжики"))))), "words"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Иванов И. И.;J. Smith' ELSE '' END AS names FROM part")
def author_names(spark, d):
    head = F.when(F.col("p_size") % 2 == 0, "Иванов И. И., J. Smith, институт").otherwise("Иванов И. И., J. Smith")
    return A.table(spark, d, "part").select("p_partkey", F.array_join(T.authors(head), ";").alias("names"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'internal' WHEN c_custkey % 3 = 1 THEN 'public' ELSE 'restricted' END AS label FROM customer")
def labels_or_fail(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select("c_custkey", T.label_or_fail(F.when(k % 3 == 1, " PUBLIC ").when(k % 3 == 2, "Restricted")).alias("label"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
def checked_dimensions(spark, d):
    v = A.table(spark, d, "embeddings")
    dims = v.select(F.size("embedding").alias("n")).first().n
    return v.select("vec_id", long(F.size(V.of_dims(F.col("embedding"), dims)), "dims"))


@query("""SELECT entity_id, CAST(rank AS BIGINT) AS rank FROM (SELECT 'c' || c_custkey AS entity_id, c_custkey % 10 + CASE c_custkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 500 ELSE 0 END AS rank FROM customer ORDER BY 2 DESC, 1 LIMIT 9) UNION ALL SELECT 'focus', 0""")
def boosted_types(spark, d):
    k = F.col("c_custkey")
    c = A.table(spark, d, "customer").select(key("c", "c_custkey").alias("entity_id"), F.when(k % 3 == 0, "person").when(k % 3 == 1, "publication").otherwise("material").alias("entity_type"), (k % 10).alias("evidence_count"))
    focus = spark.range(1).select(F.lit("focus").alias("entity_id"), F.lit("material").alias("entity_type"), F.lit(0).cast("bigint").alias("evidence_count"))
    edges = c.select(F.lit("focus").alias("src_entity_id"), F.col("entity_id").alias("dst_entity_id"))
    nodes, _ = graph.neighbourhood(c.unionByName(focus), edges, "focus", 1, 10)
    return nodes.select("entity_id", long("rank", "rank"))


@query("SELECT n_nationkey, CAST(len(string_split('a,b,' || lower(n_name), ',')) AS BIGINT) AS cells FROM nation")
def generic_table_rows(spark, d):
    rows = A.table(spark, d, "nation").select(F.col("n_nationkey"), F.lit("a").alias("x"), F.lit(" ").alias("empty"), F.col("n_name"))
    found = files.generic_rows(rows)
    return found.select(F.col("values")[0].cast("int").alias("n_nationkey"), long(F.size(T.unlabelled(F.col("visible_text"))), "cells"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'utf-8' WHEN c_custkey % 3 = 1 THEN 'utf-8-sig' ELSE 'cp1251' END AS encoding, count(*) AS n, count(*) FILTER (WHERE true) AS whole FROM customer GROUP BY 1")
def decoded_texts(spark, d):
    k = F.col("c_custkey")
    word = F.concat(F.lit("никель "), F.col("c_name"))
    body = F.when(k % 3 == 0, F.encode(word, "UTF-8")).when(k % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(word, "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("EDE8EAE5EBFC20")), F.encode(F.col("c_name"), "UTF-8")))
    read = A.table(spark, d, "customer").select(word.alias("word"), files.decoded(body).alias("x"))
    return read.groupBy(F.col("x.encoding").alias("encoding")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.text") == F.col("word")).alias("whole"))

