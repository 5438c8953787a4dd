"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the SQL twins.

Each query applies one operator, or a few, to the views of `tessera.plans.adapters`. The twin is SQL over the
same tables, written on its own from the operator's meaning.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.functions import dates, numbers, verify
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.lineage import cut
from tessera.operators import analytics, graph, mutation, qa, resolution, retrieval
from tessera.operators import relational as R
from tessera.plans import adapters as A
from tessera.sources import files
from tessera.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)


# --- ledger reads -----------------------------------------------------------------------------------------------


@query(f"""WITH {A.SOURCES}, {A.SPANS}, {A.MEASUREMENTS}, {A.RUNS}
    SELECT s.*, coalesce(e.n, 0) AS evidence_count, coalesce(m.n, 0) AS measurement_count, r.status AS run_status
    FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM spans GROUP BY 1) e USING (source_id)
    LEFT JOIN (SELECT material_id AS source_id, count(*) AS n FROM measurements GROUP BY 1) m USING (source_id)
    LEFT JOIN (SELECT source_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, run_id DESC) = 1) r USING (source_id)""")
def list_sources(spark, d):
    return R.list_sources(A.sources(spark, d), A.spans(spark, d), A.measurements(spark, d).withColumnRenamed("material_id", "source_id"), A.runs(spark, d))


@query(f"WITH {A.RUNS} SELECT source_id, run_id, status, created_at FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, run_id DESC) = 1")
def latest_run_status(spark, d):
    return R.latest(A.runs(spark, d).select("source_id", "run_id", "status", "created_at"), ["source_id"], F.desc("created_at"), F.desc("run_id"))


@query(f"WITH {A.MEASUREMENTS} SELECT m.experiment_id, m.property_id, m.line, m.value, m.method, o.o_orderstatus AS effect, o.o_totalprice AS treated_value FROM measurements m JOIN orders o ON o.o_orderkey = m.experiment_id")
def experiment_rows(spark, d):
    effects = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_orderstatus").alias("effect"), F.col("o_totalprice").alias("treated_value"))
    return A.measurements(spark, d).select("experiment_id", "property_id", "line", "value", "method").join(effects, "experiment_id")


@query(f"WITH {A.ENTITIES}, {A.ALIASES} SELECT a.alias_norm, e.entity_type, count(*) AS n, min(e.entity_id) AS entity_id FROM aliases a JOIN entities e USING (entity_id) GROUP BY 1, 2")
def alias_index(spark, d):
    return A.aliases(spark, d).join(A.entities(spark, d), "entity_id").groupBy("alias_norm", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id"))


@query(f"""WITH {A.ENTITIES}, {A.ALIASES}
    SELECT entity_id, entity_type, canonical_name, evidence_count, CAST(min(rank) AS BIGINT) AS rank FROM (
        SELECT e.*, CASE WHEN e.canonical_key = 'ring' THEN 0 WHEN a.alias_norm = 'ring' THEN 1 ELSE 2 END AS rank
        FROM entities e LEFT JOIN aliases a USING (entity_id) WHERE contains(e.canonical_key, 'ring') OR contains(a.alias_norm, 'ring'))
    GROUP BY 1, 2, 3, 4 ORDER BY rank, evidence_count DESC, canonical_name, entity_id LIMIT 20""")
def search_entities(spark, d):
    return R.search_entities(A.entities(spark, d), A.aliases(spark, d), "ring")


@query(f"WITH {A.ENTITIES} SELECT entity_id, entity_type, canonical_name FROM entities WHERE entity_id = 'part_17'")
def point_lookup(spark, d):
    return A.entities(spark, d).filter(F.col("entity_id") == "part_17").select("entity_id", "entity_type", "canonical_name").limit(1)


@query(f"WITH {A.SPANS} SELECT * FROM spans WHERE source_id IN (3, 5, 8)")
def spans_of_sources(spark, d):
    return A.spans(spark, d).filter(F.col("source_id").isin(3, 5, 8))


@query(f"""WITH {A.SPANS}, {A.ENTITIES}, {A.ALIASES}, {A.RELATIONS}
    SELECT 'sources' AS name, count(*) AS n FROM documents UNION ALL SELECT 'spans', count(*) FROM spans UNION ALL SELECT 'entities', count(*) FROM entities
    UNION ALL SELECT 'aliases', count(*) FROM aliases UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'measurements', count(*) FROM lineitem""")
def corpus_counts(spark, d):
    tables = {"sources": A.table(spark, d, "documents"), "spans": A.spans(spark, d), "entities": A.entities(spark, d), "aliases": A.aliases(spark, d), "relations": A.relations(spark, d), "measurements": A.measurements(spark, d)}
    counted = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query(f"WITH {A.ENTITIES} SELECT entity_type, count(*) AS n FROM entities GROUP BY 1")
def count_by_type(spark, d):
    return R.counts(A.entities(spark, d), "entity_type").orderBy(F.desc("n"), "entity_type")


@query(f"WITH {A.RELATIONS} SELECT relation_type, count(*) AS n FROM relations GROUP BY 1")
def count_by_relation(spark, d):
    return R.counts(A.relations(spark, d), "relation_type").orderBy(F.desc("n"), "relation_type")


@query(f"WITH {A.FACTS} SELECT subject, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, subject LIMIT 20")
def top20_subjects(spark, d):
    return R.top(R.counts(A.facts(spark, d), "subject"), 20, F.desc("n"), F.col("subject"))


@query(f"WITH {A.FACTS} SELECT CASE WHEN unit = '' THEN '—' ELSE unit END AS unit, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, unit LIMIT 20")
def top20_units(spark, d):
    units = A.facts(spark, d).select(F.when(F.col("unit") == "", "—").otherwise(F.col("unit")).alias("unit"))
    return R.top(R.counts(units, "unit"), 20, F.desc("n"), F.col("unit"))


@query(f"WITH {A.RUNS} SELECT CASE WHEN value > 20 THEN status ELSE 'unknown' END AS reason, count(*) AS n FROM runs GROUP BY 1")
def reason_codes(spark, d):
    error = F.when(F.col("value") > 20, F.concat(F.lit("["), F.col("status"), F.lit("] it failed"))).when(F.col("value") > 10, "it failed")
    return R.reason_codes(A.runs(spark, d).withColumn("error", error))


@query("""SELECT 'k' AS metric, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL HAVING count(*) > 0""")
def eval_metric_means(spark, d):
    maps = A.table(spark, d, "events").select(F.from_json("props", "map<string, double>").alias("metrics"))
    return R.metric_means(maps).select("metric", F.round("mean", 6).alias("mean"), "n")


@query("SELECT event_type AS run, max(ts) AS created_at FROM events GROUP BY 1 ORDER BY created_at DESC, run LIMIT 1")
def latest_eval_run(spark, d):
    return R.top(A.table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.max("ts").alias("created_at")), 1, F.desc("created_at"), F.col("run"))


@query(f"WITH {A.RUNS} SELECT run_id, source_id, status, created_at FROM runs ORDER BY created_at DESC, run_id LIMIT 20")
def recent_runs(spark, d):
    return R.top(A.runs(spark, d).select("run_id", "source_id", "status", "created_at"), 20, F.desc("created_at"), F.col("run_id"))


@query(f"WITH {A.ENTITIES} SELECT entity_id, canonical_name, evidence_count FROM entities ORDER BY evidence_count DESC, entity_id LIMIT 20")
def entities_by_evidence(spark, d):
    return R.top(A.entities(spark, d).select("entity_id", "canonical_name", "evidence_count"), 20, F.desc("evidence_count"), F.col("entity_id"))


@query(f"WITH {A.SPANS} SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY block) <= 3")
def head_spans(spark, d):
    return R.first_n(A.spans(spark, d), ["source_id"], 3, F.col("block"))


@query(f"""WITH {A.SPANS} SELECT span_id, source_id FROM (
        SELECT *, sum(length(visible_text)) OVER (PARTITION BY source_id ORDER BY block) AS used, row_number() OVER (PARTITION BY source_id ORDER BY block) AS rn FROM spans)
    WHERE used <= 800 OR rn = 1""")
def packet_prefix(spark, d):
    sized = A.spans(spark, d).withColumn("size", F.char_length("visible_text"))
    return R.within_budget(sized, ["source_id"], "size", 800, F.col("block")).select("span_id", "source_id")


@query(f"WITH {A.SPANS} SELECT source_id, count(*) AS spans, array_to_string(list_sort(list(DISTINCT block // 10)), ',') AS pages FROM spans GROUP BY 1")
def evidence_by_source(spark, d):
    paged = A.spans(spark, d).withColumn("page", F.expr("block div 10"))
    return paged.groupBy("source_id").agg(F.count(F.lit(1)).alias("spans"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark, d):
    return R.content_dedup(A.table(spark, d, "documents").select("doc_id", "text").filter("text is not null"), "text", F.col("doc_id")).select("content_hash", "doc_id")


@query()
def seeded_sample(spark, d):
    return R.seeded_sample(A.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


# --- filters and scopes -----------------------------------------------------------------------------------------


@query(f"WITH {A.SOURCES} SELECT source_id, security_label FROM sources WHERE security_label IN ('public', 'internal')")
def label_filter(spark, d):
    allowed = qa.compile_question("", labels=["public", "internal", "restricted"], floor=["public", "internal"]).labels
    return A.sources(spark, d).filter(F.col("security_label").isin(*allowed)).select("source_id", "security_label")


@query(f"WITH {A.SOURCES} SELECT source_id, year, geography FROM sources WHERE year BETWEEN 2018 AND 2022 AND geography = 'fr'")
def geo_year_scope(spark, d):
    q = qa.compile_question("2018-2022", geography="fr")
    return A.sources(spark, d).filter(qa.in_scope(q)).select("source_id", "year", "geography")


def _experiments(spark, d):
    p = A.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("experiment_id"), (F.col("p_partkey") % 7).alias("source_id"), F.col("p_name").alias("material_name"), F.lower("p_type").alias("property_id"), F.col("p_type").alias("property_name"),
        F.concat(F.col("p_brand"), F.lit(" at "), (F.col("p_size") * 10).cast("string")).alias("regime_summary"), F.col("p_brand").alias("regime_id"), F.col("p_retailprice").alias("value"),
    )


@query("""SELECT p_partkey AS experiment_id, p_name AS material_name FROM part
    WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AND contains(lower(p_type), 'econ') AND CAST(p_partkey % 7 AS VARCHAR) IN ('1', '4')""")
def structured_filters(spark, d):
    q = qa.compile_question("", {"material": ["Ring", "bolt"], "property": ["ECON"], "source_ids": ["1", "4"]})
    return _experiments(spark, d).filter(qa.matches_filters(q)).select("experiment_id", "material_name")


@query("""SELECT experiment_id, CAST(score AS BIGINT) AS score FROM (
        SELECT p_partkey AS experiment_id, 6 * CAST(contains('vickers red widget at 280', regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')) AS INT)
            + CASE WHEN p_size * 10 = 280 THEN 1 ELSE 0 END AS score FROM part)""")
def experiment_scores(spark, d):
    q = qa.Question("Vickers red widget at 280")
    return _experiments(spark, d).select("experiment_id", long(qa.score(q), "score"))


@query()
def select_experiments(spark, d):
    return qa.select_experiments(qa.compile_question("redwidget economy", {"material": ["red"]}), _experiments(spark, d)).select("experiment_id", "material_name", long("score", "score"))


@query(f"""WITH {A.SPANS} SELECT s.* FROM spans s WHERE s.span_id IN (SELECT unnest([doc_id * 1000000, doc_id * 1000000 + 2]) FROM labels WHERE quality = 0)""")
def evidence_semijoin(spark, d):
    rows = A.table(spark, d, "labels").filter("quality = 0").select(F.array(F.col("doc_id") * 1_000_000, F.col("doc_id") * 1_000_000 + 2).alias("evidence_ids"))
    return R.evidence_of(rows, A.spans(spark, d))


@query("""WITH a AS (SELECT doc_id AS span_id, doc_id AS rank FROM labels WHERE quality = 0), b AS (SELECT doc_id AS span_id, doc_id * 2 AS rank FROM labels WHERE toxic = 1)
    SELECT span_id, CAST(0 AS BIGINT) AS part, rank FROM a UNION ALL SELECT span_id, 1, rank FROM b WHERE span_id NOT IN (SELECT span_id FROM a)""")
def append_unseen(spark, d):
    marks = A.table(spark, d, "labels")
    first = marks.filter("quality = 0").select(F.col("doc_id").alias("span_id"), F.col("doc_id").alias("rank"))
    more = marks.filter("toxic = 1").select(F.col("doc_id").alias("span_id"), (F.col("doc_id") * 2).alias("rank"))
    return R.append_unseen(first, more, "span_id").select("span_id", long("part", "part"), "rank")


@query(f"WITH {A.FACTS} SELECT span_id, count(*) AS n, round(sum(value), 2) AS total FROM facts GROUP BY 1")
def facts_per_span(spark, d):
    return A.facts(spark, d).groupBy("span_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_LIMITS = [C.Constraint("<=", 10.0, "pcs"), C.Constraint(">=", 60000.0, "usd")]


@query(f"""WITH {A.FACTS} SELECT span_id FROM facts GROUP BY span_id
    HAVING coalesce(bool_or(value <= 10) FILTER (WHERE unit = 'pcs'), true) AND coalesce(bool_or(value >= 60000) FILTER (WHERE unit = 'usd'), true)""")
def constraint_drop(spark, d):
    facts = A.facts(spark, d)
    return qa.drop_violating(facts.select("span_id").distinct(), facts, _LIMITS)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity <= 20 AND l_quantity >= 5")
def numeric_constraint_rows(spark, d):
    asked = C.parse("сульфаты от 5 до 20 мг/л", subjects=False)
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return rows.filter(C.row_passes(F.col("l_quantity"), F.lit("мг/дм³"), asked))


# --- text, numbers, dates ---------------------------------------------------------------------------------------

_UNITS = ("мг/дм³", "mg/dm3", "MG / L", "°С", "°C", "г/дм3", "kWh/t", "HV", "m3/h", "кг/м³")
_UNIT_NAMES = ("мг/л", "мг/л", "мг/л", "c", "c", "г/л", "квтч/т", "hv", "м3/ч", "г/л")


@query("SELECT u AS unit, count(*) AS n FROM (SELECT [" + ", ".join(f"'{u}'" for u in _UNIT_NAMES) + "][CAST(p_partkey % 10 AS INT) + 1] AS u FROM part) GROUP BY 1")
def unit_normalize(spark, d):
    written = F.get(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    return A.table(spark, d, "part").groupBy(numbers.unit(written).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def _wide(spark, d):
    headers = F.array(*map(F.lit, ("Sample", "Quantity, mg/l", "Price (rub)", "Place (Finland)")))
    cells = F.array(F.col("l_returnflag"), F.translate(F.col("l_quantity").cast("string"), ".", ","), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("7"))
    return A.spread(A.table(spark, d, "lineitem")).select("l_orderkey", headers.alias("headers"), cells.alias("cells"))


@query("""SELECT subject, prop, unit, count(*) AS n, round(sum(value), 2) AS total FROM (
        SELECT lower(l_returnflag) AS subject, unnest([{'prop': 'quantity', 'unit': 'мг/л', 'value': l_quantity}, {'prop': 'price', 'unit': 'rub', 'value': l_extendedprice}, {'prop': 'place', 'unit': '', 'value': 7.0}], recursive := true) FROM lineitem)
    GROUP BY 1, 2, 3""")
def wide_table_facts(spark, d):
    # The header `Sample` names a subject but no header names a value, so the row is wide.
    each = numbers.facts_of_rows(_wide(spark, d), "headers", "cells").select(F.explode("facts").alias("f")).select("f.*")
    return each.groupBy("subject", "prop", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT p_partkey, 'name: ' || p_name || ' | brand: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' | size: ' || p_size ELSE '' END AS visible_text, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS pairs FROM part")
def labelled_row_text(spark, d):
    headers = F.array(*map(F.lit, ("name", "brand", "size")))
    cells = F.array("p_name", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(""))
    line = T.labelled(headers, cells)
    return A.table(spark, d, "part").select("p_partkey", line.alias("visible_text"), long(F.size(T.unlabelled(line)), "pairs"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')) AS digest FROM documents")
def visible_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(T.visible_text(F.col("text")), 256).alias("digest"))


@query("SELECT c_custkey, lower(c_mktsegment) || '-30сu ' || CAST(c_custkey % 5 AS VARCHAR) AS raw, lower(c_mktsegment) || '-30cu ' || CAST(c_custkey % 5 AS VARCHAR) AS key FROM customer")
def canonical_key(spark, d):
    raw = F.concat(F.lower("c_mktsegment"), F.lit("-30сu "), (F.col("c_custkey") % 5).cast("string"))
    messy = F.concat(F.lit("«"), F.translate(F.upper(raw), "-", "—"), F.lit(" ».  "))
    return A.table(spark, d, "customer").select("c_custkey", raw.alias("raw"), T.canonical_key(messy).alias("key"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS token FROM customer")
def slug(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"), T.compact(F.col("c_name")).alias("token"))


def _stem_sql(x: str) -> str:
    tests = " ".join(f"WHEN ends_with({x}, '{e}') AND length({x}) > {len(e) + 4} THEN substr({x}, 1, length({x}) - {len(e)})" for e in T.RU_ENDINGS)
    return f"CASE WHEN length({x}) <= 4 OR regexp_full_match({x}, '[0-9]+') THEN {x} {tests} ELSE {x} END"


@query(f"""SELECT t AS term, count(*) AS n FROM (
        SELECT {_stem_sql('w')} AS t FROM (SELECT replace(lower(unnest(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-zА-Яа-яЁё]{{2,}}'))), 'ё', 'е') AS w FROM documents))
    WHERE t NOT IN ({", ".join(f"'{w}'" for w in T.RU_STOP_WORDS)}) GROUP BY 1""")
def stemmed_terms(spark, d):
    words = A.spread(A.table(spark, d, "documents").select("text")).select(F.explode(T.raw_tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    terms = words.select(T.stem(F.col("w")).alias("term"), "n").filter(~F.col("term").isin(*T.RU_STOP_WORDS))
    return terms.groupBy("term").agg(F.sum("n").alias("n"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, strftime(CASE WHEN o_orderkey % 4 = 3 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS date FROM orders""")
def date_from_text(spark, d):
    o = A.table(spark, d, "orders")
    day, month, year = F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate"), F.year("o_orderdate").cast("string")
    ru = F.get(F.array(*map(F.lit, ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"))), month - 1)
    en = F.get(F.array(*map(F.lit, ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"))), month - 1)
    kinds = (F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat_ws(" ", day, ru, year, F.lit("г.")), F.concat_ws(" ", en, year))
    written = F.concat(F.lit("order 1899 of "), F.get(F.array(*kinds), (F.col("o_orderkey") % 4).cast("int")), F.lit(" in 12 parts"))
    return o.select("o_orderkey", dates.date_of(written).alias("x")).select("o_orderkey", long("x.year", "year"), "x.date")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders")
def year_from_filename(spark, d):
    name = F.concat(F.lit("report_1900_v2_"), F.year("o_orderdate").cast("string"), F.lit("_120199.pdf"))
    return A.table(spark, d, "orders").select("o_orderkey", long(dates.year_of_filename(name), "year"))


def _any_sql(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{n}')" for n in names) + ")"


@query(f"""SELECT doc_id, CASE WHEN {_any_sql(T.RU_PLACES)} AND {_any_sql(T.FOREIGN_PLACES)} THEN 'mixed' WHEN {_any_sql(T.RU_PLACES)} THEN 'ru' WHEN {_any_sql(T.FOREIGN_PLACES)} THEN 'foreign'
        WHEN cyr + lat <= 40 THEN NULL WHEN cyr >= lat THEN 'ru' ELSE 'foreign' END AS geography
    FROM (SELECT doc_id, lower(text) AS low, len(regexp_extract_all(lower(text), '[а-яё]')) AS cyr, len(regexp_extract_all(lower(text), '[a-z]')) AS lat FROM documents)""")
def geography(spark, d):
    return A.spread(A.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.geography(F.col("text")).alias("geography"))


# --- verification -----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity IN (5, 7, l_tax * 100) OR l_quantity = CAST(l_discount * 100 AS INT) AS ok FROM lineitem")
def numbers_supported(spark, d):
    whole = lambda c: F.col(c).cast("decimal(18,1)").cast("string")
    line = A.table(spark, d, "lineitem")
    sentence = F.concat(F.lit("it took "), F.translate(whole("l_quantity"), ".", ","), F.lit(" units"))
    cited = F.array(F.lit("between 5 and 7.0"), F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit(" tax")), F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" off")))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", verify.numbers_supported(sentence, cited).alias("ok"))


_NOT_SQL = "len(list_intersect(regexp_extract_all(replace(lower({}), 'ё', 'е'), '[a-zа-яё]+'), [" + ", ".join(f"'{n}'" for n in verify.NEGATIONS) + "])) > 0"


@query(f"WITH {A.TURNS} SELECT conv_id, turn, {_NOT_SQL.format('sentence')} AND NOT ({_NOT_SQL.format('cited')}) AS flipped FROM turns")
def negation_flip(spark, d):
    t = A.turns(spark, d)
    return t.select("conv_id", "turn", verify.contradicts(F.col("sentence"), F.array("cited")).alias("flipped"))


_WORDS_SQL = "list_filter(regexp_extract_all(replace(lower({}), 'ё', 'е'), '[a-zа-яё]{{4,}}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in verify.COMMON) + "], w))"


@query(f"""WITH {A.TURNS}, w AS (SELECT *, {_WORDS_SQL.format('sentence')} AS own, list_transform(regexp_extract_all(replace(lower(cited), 'ё', 'е'), '[a-zа-яё]{{4,}}'), lambda x: substr(x, 1, 5)) AS begins FROM turns)
    SELECT conv_id, turn, len(own) = 0 OR (len(list_filter(own, lambda x: list_contains(begins, substr(x, 1, 5)))) >= 0.6 * len(own) AND NOT ({_NOT_SQL.format('sentence')} AND NOT ({_NOT_SQL.format('cited')}))) AS ok FROM w""")
def semantic_support(spark, d):
    return A.turns(spark, d).select("conv_id", "turn", verify.supported(F.col("sentence"), F.array("cited")).alias("ok"))


@query(f"""WITH {A.TURNS}, w AS (SELECT *, {_WORDS_SQL.format('sentence')} AS own, list_transform(regexp_extract_all(replace(lower(cited), 'ё', 'е'), '[a-zа-яё]{{4,}}'), lambda x: substr(x, 1, 5)) AS begins FROM turns),
    v AS (SELECT conv_id, turn, turn % 4 = 3 AS bare, turn % 3 = 0 AS leaks,
        NOT (len(own) = 0 OR (len(list_filter(own, lambda x: list_contains(begins, substr(x, 1, 5)))) >= 0.6 * len(own) AND NOT ({_NOT_SQL.format('sentence')} AND NOT ({_NOT_SQL.format('cited')})))) AS bad FROM w)
    SELECT conv_id AS answer_id, round(1 - count(*) FILTER (WHERE bare) / count(*), 6) AS citation_coverage, count(*) FILTER (WHERE bare) AS unsupported_claims,
        count(*) FILTER (WHERE NOT bare AND leaks) AS label_leaks, CAST(0 AS BIGINT) AS numeric_mismatches, count(*) FILTER (WHERE NOT bare AND bad) AS semantic_unsupported FROM v GROUP BY 1""")
def verify_answers(spark, d):
    t = A.turns(spark, d)
    span = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    sentences = t.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("sentence_id"), "sentence", F.when(F.col("turn") % 4 != 3, F.array(span)).otherwise(F.array().cast("array<string>")).alias("span_ids"), F.lit("").alias("fact_numbers"))
    spans = t.select(span.alias("span_id"), F.col("cited").alias("visible_text"), F.when(F.col("turn") % 3 == 0, "restricted").otherwise("public").alias("security_label"))
    return analytics.verify_answers(sentences, spans, ["public"]).withColumn("citation_coverage", F.round("citation_coverage", 6))


# --- analytics --------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT l_suppkey, l_partkey, l_returnflag, l_orderkey, l_linenumber, l_shipdate, l_extendedprice AS value,
        CASE WHEN l_quantity < 17 THEN 'HV10' WHEN l_quantity < 34 THEN 'HV30' ELSE '' END AS method, CASE WHEN l_discount < 0.03 THEN 'increase' WHEN l_discount < 0.06 THEN 'decrease' ELSE 'unknown' END AS direction,
        row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem)
    SELECT type, count(*) AS n FROM (SELECT CASE WHEN a.direction <> b.direction AND a.direction <> 'unknown' AND b.direction <> 'unknown' THEN 'contradictory_direction'
            WHEN a.method <> '' AND b.method <> '' AND a.method <> b.method THEN 'method_mismatch'
            WHEN a.method <> '' AND a.method = b.method AND abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) > 0.15 THEN 'numeric_disagreement' END AS type
        FROM e a JOIN e b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND a.pos < b.pos WHERE a.l_orderkey <> b.l_orderkey)
    WHERE type IS NOT NULL GROUP BY 1""")
def conflicts(spark, d):
    line = A.table(spark, d, "lineitem")
    order = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = line.select(
        F.col("l_suppkey").alias("material_id"), F.col("l_partkey").alias("property_id"), F.row_number().over(order).alias("pos"), F.col("l_orderkey").alias("experiment_id"), F.lit(0).alias("source_id"),
        F.when(F.col("l_discount") < 0.03, "increase").when(F.col("l_discount") < 0.06, "decrease").otherwise("unknown").alias("direction"),
        F.when(F.col("l_quantity") < 17, "HV10").when(F.col("l_quantity") < 34, "HV30").otherwise("").alias("method"), F.col("l_extendedprice").alias("value"), F.lit("hv").alias("unit"),
    )
    return analytics.conflicts(rows, ["material_id", "property_id"], "pos").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.material_id, p.regime_type, b.property_id, coalesce(x.n, 0) AS experiments, coalesce(x.n, 0) > 0 AS covered
    FROM (SELECT DISTINCT c_mktsegment AS material_id FROM customer) s CROSS JOIN (SELECT DISTINCT o_orderpriority AS regime_type FROM orders) p CROSS JOIN (SELECT DISTINCT p_brand AS property_id FROM part) b
    LEFT JOIN (SELECT c_mktsegment AS m, o_orderpriority AS r, p_brand AS q, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) x
    ON x.m = s.material_id AND x.r = p.regime_type AND x.q = b.property_id""")
def gap_matrix(spark, d):
    of = lambda t, c, name: A.table(spark, d, t).select(F.col(c).alias(name)).distinct()
    line = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders, customers, parts = (A.table(spark, d, t) for t in ("orders", "customer", "part"))
    done = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"]).join(parts, line["l_partkey"] == parts["p_partkey"])
    done = done.select(F.col("c_mktsegment").alias("material_id"), F.col("o_orderpriority").alias("regime_type"), F.col("p_brand").alias("property_id"))
    return analytics.gap_matrix(of("customer", "c_mktsegment", "material_id"), of("orders", "o_orderpriority", "regime_type"), of("part", "p_brand", "property_id"), done)


@query(f"WITH {A.SOURCES}, {A.SPANS} SELECT s.source_id, CASE WHEN security_label = 'internal' AND year > 2000 THEN 'high' WHEN security_label = 'internal' OR coalesce(n, 0) > 10 THEN 'medium' ELSE 'low' END AS confidence FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM spans GROUP BY 1) e USING (source_id)")
def confidence_levels(spark, d):
    n = R.counts(A.spans(spark, d), "source_id")
    rows = A.sources(spark, d).join(n, "source_id", "left")
    return rows.select("source_id", analytics.confidence(F.col("security_label") == "internal", F.col("year") > 2000, F.coalesce("n", F.lit(0)) > 10).alias("confidence"))


# --- graph ------------------------------------------------------------------------------------------------------

_BOTH = f"{A.RELATIONS}, steps AS (SELECT src_entity_id AS a, dst_entity_id AS b FROM relations UNION SELECT dst_entity_id, src_entity_id FROM relations)"
_HOPS = _BOTH + ", h0 AS (SELECT 'supplier_3' AS e), h1 AS (SELECT DISTINCT b AS e FROM steps JOIN h0 ON a = e WHERE b NOT IN (SELECT e FROM h0)), h2 AS (SELECT DISTINCT b AS e FROM steps JOIN h1 ON a = e WHERE b NOT IN (SELECT e FROM h0) AND b NOT IN (SELECT e FROM h1))"


def _focus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("supplier_3",)], "entity_id string")


@query(f"WITH {_HOPS} SELECT e AS entity_id, CAST(0 AS BIGINT) AS hops FROM h0 UNION ALL SELECT e, 1 FROM h1")
def khop_1(spark, d):
    return graph.k_hop(A.relations(spark, d), _focus(spark), 1).select("entity_id", long("hops", "hops"))


@query(f"WITH {_HOPS} SELECT e AS entity_id, CAST(0 AS BIGINT) AS hops FROM h0 UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2")
def khop_2(spark, d):
    return graph.k_hop(A.relations(spark, d), _focus(spark), 5).select("entity_id", long("hops", "hops"))


@query(f"WITH {A.RELATIONS} SELECT * FROM relations WHERE src_entity_id IN (SELECT 'supplier_' || s_suppkey FROM supplier UNION ALL SELECT 'nation_' || n_nationkey FROM nation WHERE n_regionkey < 2) AND dst_entity_id IN (SELECT 'nation_' || n_nationkey FROM nation WHERE n_regionkey < 2)")
def induced_edges(spark, d):
    nodes = A.entities(spark, d).filter((F.col("entity_type") == "supplier") | ((F.col("entity_type") == "nation") & (F.col("evidence_count") < 2)))
    return graph.induced(A.relations(spark, d), nodes).select("relation_id", "src_entity_id", "relation_type", "dst_entity_id")


@query(f"""WITH {_HOPS}, {A.ENTITIES} SELECT entity_id, rank FROM (SELECT entity_id, evidence_count AS rank FROM h1 JOIN entities ON e = entity_id ORDER BY evidence_count DESC, entity_id LIMIT 19)
    UNION ALL SELECT entity_id, evidence_count FROM entities WHERE entity_id = 'supplier_3'""")
def boosted_rank(spark, d):
    nodes, _ = graph.neighbourhood(A.entities(spark, d), A.relations(spark, d), "supplier_3", 1, 20)
    return nodes.select("entity_id", long("rank", "rank"))


@query("""SELECT 'order_' || o_orderkey AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'decision' ELSE 'publication' END AS entity_type,
        CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '' END AS sort_key
    FROM orders WHERE o_orderkey % 3 < 2 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 < 2)""")
def timeline(spark, d):
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "decision").when(k % 3 == 1, "publication").otherwise("material")
    rows = o.select(F.concat(F.lit("order_"), k.cast("string")).alias("entity_id"), kind.alias("entity_type"), F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(k % 5 == 1, F.year("o_orderdate")).alias("year"))
    return graph.timeline(rows).select("entity_id", "entity_type", "sort_key")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS span_id, 'p' || l_partkey AS entity_id, 'material' AS entity_type FROM lineitem UNION SELECT DISTINCT l_orderkey, 's' || l_suppkey, 'equipment' FROM lineitem)
    SELECT a.entity_id AS src_entity_id, 'USED_EQUIPMENT' AS relation_type, b.entity_id AS dst_entity_id, count(DISTINCT a.span_id) AS spans FROM m a JOIN m b USING (span_id) WHERE a.entity_type = 'material' AND b.entity_type = 'equipment' GROUP BY 1, 2, 3""")
def cooccurrence_edges(spark, d):
    line = A.table(spark, d, "lineitem")
    of = lambda c, p, kind: line.select(F.col("l_orderkey").alias("span_id"), F.concat(F.lit(p), F.col(c).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"))
    found = graph.co_occurrence(of("l_partkey", "p", "material").unionByName(of("l_suppkey", "s", "equipment")), most=None)
    return found.select("src_entity_id", "relation_type", "dst_entity_id", long(F.size("evidence_span_ids"), "spans"))


# --- writes -----------------------------------------------------------------------------------------------------


def _old_new(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 75).alias("c_custkey"), F.lower("c_mktsegment").alias("c_mktsegment"), (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return c, new


_OLD_NEW = "o AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer), n AS (SELECT c_custkey + 75 AS c_custkey, lower(c_mktsegment) AS c_mktsegment, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_custkey % 3 = 0)"


@query(f"WITH {_OLD_NEW} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert_last(spark, d):
    old, new = _old_new(spark, d)
    return mutation.upsert_last(old, new, ["c_custkey"], keep=["c_nationkey"])


@query(f"WITH {_OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def upsert_first(spark, d):
    return mutation.upsert_first(*_old_new(spark, d), ["c_custkey"])


@query(f"WITH {_OLD_NEW} SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def replace_by_key(spark, d):
    return mutation.replace_by_key(*_old_new(spark, d), ["c_custkey"])


@query(f"WITH {_OLD_NEW} SELECT o.c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, o.c_nationkey FROM o LEFT JOIN n USING (c_custkey)")
def partial_update(spark, d):
    return mutation.patch(*_old_new(spark, d), ["c_custkey"], ["c_mktsegment"])


@query(f"WITH {_OLD_NEW} SELECT * FROM (SELECT *, 0 AS s FROM o UNION ALL SELECT *, 1 FROM n) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s) = 1".replace("SELECT * FROM (SELECT", "SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT"))
def merge_shards(spark, d):
    return mutation.merge_shards(list(_old_new(spark, d)), ["c_custkey"])


@query("SELECT p_partkey, 'a,' || p_brand || CASE WHEN p_type = 'a' THEN '' ELSE ',' || p_type END AS ids FROM part")
def append_ids(spark, d):
    old = F.array(F.lit("a"), F.col("p_brand"))
    return A.table(spark, d, "part").select("p_partkey", F.array_join(mutation.extend_ids(old, F.array(F.lit("a"), F.col("p_type"))), ",").alias("ids"))


@query("SELECT p_partkey, 'new' AS a, p_brand AS b, p_type AS c FROM part")
def merge_metadata(spark, d):
    merged = mutation.merge_maps(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("p_brand")), F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.col("p_type")))
    return A.table(spark, d, "part").select("p_partkey", merged.alias("m")).select("p_partkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


def _ledger(spark, d):
    line = A.table(spark, d, "lineitem")
    # The ledger is a table that is written once; its entities and relations have the same lists.
    keys = line.select("l_partkey", "l_orderkey").repartition("l_partkey").groupBy("l_partkey").agg(F.collect_set("l_orderkey").alias("keys"))
    ids = cut(keys.select("l_partkey", F.array_sort(F.transform("keys", lambda k: F.concat(F.lit("s"), k.cast("string")))).alias("evidence_span_ids")))
    entity = F.concat(F.when(F.col("l_partkey") % 2 == 0, "ent_").otherwise("dict_"), F.col("l_partkey").cast("string"))
    edges = ids.withColumn("next", F.col("l_partkey") + 1)
    name = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "ent_").otherwise("dict_"), F.col(c).cast("string"))
    spans = A.table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("span_id"), F.when(F.col("o_custkey") % 50 < 45, "gone").otherwise("stays").alias("source_id"))
    return {
        "evidence_spans": spans, "entities": ids.select(entity.alias("entity_id"), "evidence_span_ids"),
        "relations": edges.select(F.col("l_partkey").alias("relation_id"), name("l_partkey").alias("src_entity_id"), name("next").alias("dst_entity_id"), "evidence_span_ids"),
        "entity_aliases": ids.select(F.col("l_partkey").alias("alias_norm"), entity.alias("entity_id")),
    }


@query("""WITH k AS (SELECT l_partkey AS p, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) FILTER (WHERE o_custkey % 50 >= 45) AS left_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    e AS (SELECT * FROM k WHERE left_ > 0 OR p % 2 = 1), r AS (SELECT * FROM k WHERE left_ > 0 AND p IN (SELECT p FROM e) AND p + 1 IN (SELECT p FROM e))
    SELECT 'entities' AS name, count(*) AS n, CAST(sum(left_) AS BIGINT) AS ids FROM e UNION ALL SELECT 'relations', count(*), CAST(coalesce(sum(left_), 0) AS BIGINT) FROM r UNION ALL SELECT 'aliases', count(*), 0 FROM e""")
def cascade_delete(spark, d):
    out = mutation.delete_source(_ledger(spark, d), "gone")
    sized = lambda t, name: out[t].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("evidence_span_ids")), F.lit(0)).cast("bigint").alias("ids")).select(F.lit(name).alias("name"), "n", "ids")
    return sized("entities", "entities").unionByName(sized("relations", "relations")).unionByName(out["entity_aliases"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("aliases").alias("name"), "n", F.lit(0).cast("bigint").alias("ids")))


@query("SELECT doc_id AS unit_id FROM documents WHERE doc_id % 3 <> 0")
def hash_skip(spark, d):
    units = A.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    stored = units.filter("unit_id % 3 < 2").select("unit_id", F.when(F.col("unit_id") % 3 == 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("!")), 256)).alias("text_hash"))
    return mutation.fresh(units, stored).select("unit_id")


@query("SELECT doc_id AS unit_id, source AS source_id FROM documents WHERE source <> 'src1' OR doc_id % 3 = 0")
def prune_stale(spark, d):
    stored = A.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("source_id"))
    return mutation.prune(stored, stored.filter("source_id = 'src1' and unit_id % 3 = 0"))


@query("SELECT page_id, '[' || CASE WHEN page_id % 4 = 0 THEN 'empty' ELSE 'too_large' END || ']' AS error FROM pages WHERE page_id % 4 < 2")
def quarantine(spark, d):
    page = F.col("page_id")
    _, bad = mutation.quarantine(A.table(spark, d, "pages").select("page_id"), F.when(page % 4 == 0, "empty").when(page % 4 == 1, "too_large"))
    return bad.select("page_id", "error")


# --- retrieval --------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    v = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"))
    return v.filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), "vec"), v


_KNN = """knn AS (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])) DESC, u.vec_id) AS rank FROM embeddings q, embeddings u WHERE q.vec_id % 20 = 0 QUALIFY rank <= {k})"""


@query(f"WITH {_KNN.format(k=5)} SELECT query_id, unit_id, round(score, 6) AS score, rank FROM knn")
def knn_cosine(spark, d):
    return retrieval.nearest(*_vectors(spark, d), 5).select("query_id", "unit_id", F.round("score", 6).alias("score"), long("rank", "rank"))


_BM25 = """w AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    st AS (SELECT count(*) AS units, avg(len(w)) AS mean FROM w), t AS (SELECT unit_id, len(w) AS length, unnest(w) AS term FROM w), tf AS (SELECT unit_id, term, any_value(length) AS length, count(*) AS tf FROM t GROUP BY 1, 2),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query_id, unit_id, sum(ln(1 + (units - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s QUALIFY rank <= {k})"""


def _bm25(spark, d, k):
    items = A.table(spark, d, "benchmark").filter("item_id % 20 = 0")
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("term"))
    return retrieval.bm25(asked, A.spread(A.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")), k)


@query(f"WITH {_BM25.format(k=10)} SELECT query_id, rank, round(score, 4) AS score FROM bm")
def sparse_search(spark, d):
    return _bm25(spark, d, 10).select("query_id", long("rank", "rank"), F.round("score", 4).alias("score"))


@query(f"""WITH {_KNN.format(k=50)}, l AS (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY u.vec_id) AS rank FROM embeddings q JOIN embeddings u ON q.label = u.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 50),
    f AS (SELECT query_id, unit_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, unit_id, rank FROM knn UNION ALL SELECT * FROM l) GROUP BY 1, 2)
    SELECT query_id, unit_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS r FROM f) WHERE r <= 10""")
def rrf_hybrid(spark, d):
    q, v = _vectors(spark, d)
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "label")
    # A query's list is the first 50 of its label, so no more of a label meet its queries.
    heads = R.first_n(e.filter("label is not null"), ["label"], 50, F.col("unit_id"))
    same = e.filter("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), "label").join(heads, "label").select("query_id", "unit_id", (-F.col("unit_id").cast("double")).alias("score"))
    fused = retrieval.fuse([retrieval.nearest(q, v, 50), retrieval.ranked(same, 50)], 10)
    return fused.select("query_id", "unit_id", F.round("score", 6).alias("score"))


@query()
def lexical_rerank(spark, d):
    hits = _bm25(spark, d, retrieval.RERANK_POOL)
    docs, items = A.table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"), A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return retrieval.rerank(hits.join(docs, "unit_id").join(items, "query_id"), 10).select("query_id", "unit_id", F.round("lexical", 4).alias("lexical"), long("position", "position"))


@query()
def hybrid_search(spark, d):
    spans = A.spans(spark, d).join(A.sources(spark, d).select("source_id", "title", "security_label"), "source_id").withColumn("span_type", F.lit("text"))
    asked = A.table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = retrieval.hybrid(asked, retrieval.units(spans.drop("title"), A.sources(spark, d)), spans, ["public", "internal"])
    return hits.select("query_id", "span_id", long("position", "position"), F.round("lexical", 4).alias("lexical"))


@query(r"SELECT item_id, CAST(32 AS BIGINT) AS dims, CAST(CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}_]') THEN 1 ELSE 0 END AS DOUBLE) AS norm FROM benchmark")
def hash_embeddings(spark, d):
    items = A.table(spark, d, "benchmark").select("item_id", V.hash_embedding(F.col("text")).alias("vec"))
    return items.select("item_id", long(F.size("vec"), "dims"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query("SELECT vec_id, CAST(list_max(list_transform(embedding, lambda x: abs(CAST(round(greatest(-127, least(127, CAST(x AS DOUBLE) / 0.5 * 127))) AS BIGINT)))) AS BIGINT) AS most FROM embeddings")
def int8_vectors(spark, d):
    q = V.int8(F.col("embedding").cast("array<double>"), F.lit(0.5))
    return A.table(spark, d, "embeddings").select("vec_id", long(F.array_max(F.transform(q, F.abs)), "most"))


# --- resolution -------------------------------------------------------------------------------------------------


@query(f"""WITH {A.SPANS}, a AS (SELECT unnest(['the', 'and', 'that', 'nicht', 'sur', 'para']) AS alias)
    SELECT alias AS text, count(*) AS n FROM (SELECT DISTINCT span_id, alias FROM spans, a WHERE list_contains(regexp_extract_all(lower(visible_text), '[\\p{{L}}\\p{{N}}_]+'), alias)) GROUP BY 1""")
def dictionary_mentions(spark, d):
    names = spark.createDataFrame([(w, "term", w) for w in ("the", "and", "that", "nicht", "sur", "para")], "alias_norm string, entity_type string, alias string")
    return R.counts(resolution.dictionary_mentions(A.spans(spark, d), names), "text")


@query("""WITH m AS (SELECT c_custkey AS span_id, CASE WHEN c_custkey % 3 = 0 THEN 'nation_' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'alias ' || c_nationkey ELSE 'new ' || (c_custkey % 11) END AS key, c_custkey % 3 AS k FROM customer)
    SELECT CASE k WHEN 0 THEN 'key' WHEN 1 THEN 'alias' ELSE 'created' END AS matched_by, count(*) AS n, count(DISTINCT key) AS entities FROM m GROUP BY 1""")
def resolve_ladder(spark, d):
    k = F.col("c_custkey")
    written = F.when(k % 3 == 0, F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"))).when(k % 3 == 1, F.concat(F.lit("«Alias "), F.col("c_nationkey").cast("string"), F.lit("»"))).otherwise(F.concat(F.lit("new "), (k % 11).cast("string")))
    mentions = resolution.best_mentions(A.table(spark, d, "customer").select(k.alias("span_id"), written.alias("text"), F.lit("nation").alias("entity_type"), F.lit(0.9).alias("confidence")))
    nations = A.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.lit("nation").alias("entity_type"), T.canonical_key(F.col("n_name")).alias("canonical_key"), F.concat(F.lit("alias "), F.col("n_nationkey").cast("string")).alias("alias_norm"))
    found, _, _ = resolution.resolve(mentions, nations, nations.select("alias_norm", "entity_id"))
    return found.groupBy("matched_by").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"))


@query()
def closest_names(spark, d):
    return qa.closest_names(A.table(spark, d, "part").select(F.col("p_name").alias("material_name")), ["redwidgit", "smalring"])


@query("SELECT DISTINCT p_name AS material_name FROM part WHERE p_name <> 'blue bolt' ORDER BY 1 LIMIT 2")
def suggestions(spark, d):
    return qa.suggestions(A.table(spark, d, "part").select(F.col("p_name").alias("material_name")), "what of bluebolt")


@query()
def sentence_chunks(spark, d):
    chunks = A.table(spark, d, "documents").select("doc_id", F.posexplode(qa.sentence_chunks(F.col("text"))).alias("i", "c"))
    return chunks.select("doc_id", long("i", "i"), long("c.offset", "offset"), long(F.char_length("c.chunk"), "length"))


@query()
def html_main_text(spark, d):
    return A.spread(A.table(spark, d, "pages").select("page_id", "html")).select("page_id", files.html_title(F.col("html")).alias("title"), F.sha2(files.html_text(F.col("html")), 256).alias("digest"), long(F.char_length(files.html_text(F.col("html"))), "length"))


@query()
def packed_blocks(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", files.packed_lines(F.split("text", "\n")).alias("blocks"))
    return docs.select("doc_id", long(F.size("blocks"), "blocks"), long(F.coalesce(F.array_max(F.transform("blocks", F.char_length)), F.lit(0)), "longest"))


# --- streams ----------------------------------------------------------------------------------------------------


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run of a query in the folder that the cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="tessera-run-")
    return f"{root}/{name}-{spark.sparkContext.applicationId}-{next(_runs)}"


def _drained(spark: SparkSession, df: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives until its source is used up, as a table in the shared folder."""
    run = run_folder(spark, name)
    df.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{run}/out")


def _count():
    n = 0
    while True:
        yield n
        n += 1


_runs = _count()

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark, d):
    return ingest.event_time(spark.readStream.schema(_EVENTS).parquet(f"{d}/events.parquet*"), late="1 day")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    """Sessions of a user's events that follow each other within two hours; the same operator runs on streams."""
    events = ingest.event_time(A.table(spark, d, "events").select("user_id", "ts"))
    return ingest.sessions(events, "user_id", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("first"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_ingest_dedup(spark, d):
    """Events by id: ids repeat within the watermark only, so each comes once."""
    return _drained(spark, ingest.deduplicated(_events(spark, d), ["event_id"]).select("event_id", "user_id"), "dedup", "append")


from tessera import queries_records, queries_stored  # noqa: E402, F401  they add the rest of the catalogue
