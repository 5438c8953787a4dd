"""The ledger as one object: ingest, questions, search, graph, gaps, statistics and deletion over bucketed tables.

A commit rewrites the buckets that it touches (`tessera.store`), so the cost of adding or deleting a source doesn't grow with the
number of the others. Readers follow the last complete commit, so a lost job changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import ship
from tessera.functions import dates, numbers
from tessera.functions import text as T
from tessera.operators import analytics, answers, extraction, graph, mutation, qa, resolution, retrieval
from tessera.operators import relational as R
from tessera.plans.schemas import BUCKET_KEYS, LEDGER
from tessera.sources import files
from tessera.store import BUCKETS, Store, Table


@dataclass
class Answer:
    experiments: DataFrame
    sentences: DataFrame
    evidence: DataFrame
    conflicts: DataFrame
    verification: DataFrame
    confidence: str
    follow_ups: DataFrame


class Ledger:
    """labels: those that this deployment may show; a question may narrow them and never widen them. buckets: of each table; a ledger keeps the number that it began with."""

    def __init__(self, spark: SparkSession, root: str, labels: tuple[str, ...] = T.LABELS, buckets: int = BUCKETS) -> None:
        ship(spark)
        self.spark, self.root, self.labels = spark, root.rstrip("/"), labels
        self.store = Store(spark, self.root, {name: Table(schema, BUCKET_KEYS[name], buckets) for name, schema in LEDGER.items()})

    # --- tables -------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Writes tables whole as the next commit."""
        self.store.replace(tables)

    def _claim(self, n: int):
        return self.store._path("log", f"{n:012d}.claim")

    def release(self) -> bool:
        """Takes away the claim on the next commit that a killed writer left; whether there was one."""
        return self.store.release()

    def _put(self, new: dict[str, DataFrame], key: str = "source_id") -> None:
        """Rows of the sources in new take the place of those that were there; only these sources' buckets are read and written."""

        def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
            known = [c for c in old.columns if c in rows.columns]
            return old.join(rows.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(rows.select(*known), allowMissingColumns=True)

        self.store.commit({name: (df, merge) for name, df in new.items()})

    # --- ingest -------------------------------------------------------------------------------------------------

    def _sources(self, found: DataFrame, kind: str, label: str) -> DataFrame:
        name = F.regexp_extract("path", "[^/]*$", 0)
        return found.select(
            T.stable_id("src_", F.sha2("content", 256), length=32).alias("source_id"), F.col("path"), name.alias("title"), F.lit(kind).alias("document_type"), F.sha2("content", 256).alias("raw_sha256"),
            T.label_or_fail(F.lit(label)).alias("security_label"), F.current_timestamp().alias("created_at"), files.decoded("content")["text"].alias("text"),
        )

    def _write_sources(self, sources: DataFrame, spans: DataFrame, more: dict[str, DataFrame], headers: DataFrame | None = None) -> None:
        """sources may have page_date, the date that a page or file states of itself."""
        page_date = F.coalesce("page_date", F.lit("")) if "page_date" in sources.columns else F.lit("")
        dated = sources.join(extraction.heads(spans, headers), "source_id", "left").withColumns({"year": dates.source_year(F.col("title"), F.coalesce("head", F.lit("")), page_date), "geography": T.geography(F.coalesce("head", F.lit("")))})
        runs = dated.select(T.stable_id("run_", F.col("source_id"), F.col("created_at")).alias("run_id"), "source_id", F.when(F.col("head").isNull(), "quarantined").otherwise("completed").alias("status"), F.lit("ledger").alias("stage"), F.when(F.col("head").isNull(), "[no_text] nothing to read").alias("error"), "created_at")
        self._put({"sources": dated, "evidence_spans": spans, "ingestion_runs": runs, **more})

    def add_texts(self, path: str, label: str = "internal") -> None:
        """Text and Markdown files; equal files are one source."""
        found = files.scan(self.spark, path, ["txt", "md"])
        sources = self._sources(found, "text", label).dropDuplicates(["source_id"]).cache()
        lines = files.text_spans(sources.withColumn("path", F.col("source_id")), "text").withColumnRenamed("path", "source_id")
        locator = F.concat(F.lit("section:text:block_"), F.lpad(F.col("ordinal").cast("string"), 3, "0"))
        spans = lines.select(
            T.stable_id("evs_", F.col("source_id"), locator, T.visible_text(F.col("visible_text"))).alias("span_id"), "source_id", "ordinal", F.lit("text").alias("span_type"), "visible_text",
            F.struct(locator.alias("stable_locator"), F.create_map().cast("map<string, string>").alias("extra")).alias("locator"), F.lit("validated_rule").alias("validation_status"), F.lit(0.98).alias("evidence_confidence"), F.lit(label).alias("security_label"),
        )
        self._write_sources(sources, spans, {})
        sources.unpersist()

    def add_tables(self, path: str, label: str = "internal") -> None:
        """CSV files with a header each, every file a source: labelled rows and their facts; of the experiment schema also measurements and effects."""
        found = files.scan(self.spark, path, ["csv"])
        sources = self._sources(found, "table", label).dropDuplicates(["source_id"]).cache()
        read = files.csv_rows(found.join(sources.select("path"), "path", "left_semi")).join(sources.select("path", "source_id"), "path")
        locator = F.concat(F.lit("table_001:row_"), F.lpad(F.col("ordinal").cast("string"), 3, "0"))
        rows = read.withColumn("visible_text", T.labelled(F.col("headers"), F.col("values"))).filter("visible_text <> ''")
        rows = rows.withColumn("span_id", T.stable_id("evs_", F.col("source_id"), locator, T.visible_text(F.col("visible_text")))).cache()
        spans = rows.select("span_id", "source_id", "ordinal", F.lit("table_row").alias("span_type"), "visible_text", F.struct(locator.alias("stable_locator"), F.create_map().cast("map<string, string>").alias("extra")).alias("locator"), F.lit("validated_rule").alias("validation_status"), F.lit(0.95).alias("evidence_confidence"), F.lit(label).alias("security_label"))
        each = numbers.facts_of_rows(rows).select("source_id", "span_id", F.explode("facts").alias("f")).select("source_id", "span_id", "f.*")
        more = {"numeric_facts": each.withColumns({"fact_id": T.stable_id("fact_", F.col("span_id"), F.col("subject"), F.col("prop"), F.col("value"), F.col("unit")), "confidence": F.lit(0.95)})}
        # Of repeated headers the first counts.
        cell = lambda name: F.get("values", (F.array_position("headers", name) - 1).cast("int"))
        whole = F.forall(F.array(*map(F.lit, files.EXPERIMENT_COLUMNS)), lambda c: F.array_contains(F.col("headers"), c))
        good, _ = files.decode_experiments(rows.filter(whole).select("span_id", "source_id", *(cell(c).alias(c) for c in files.EXPERIMENT_COLUMNS)))
        own = good.withColumns({"property_id": T.slug(F.col("property")), "ids": F.array("span_id"), "regime_id": F.concat(F.lit("reg_"), T.slug(F.col("regime")), F.lit("_"), F.col("temperature_c").cast("int").cast("string"))})
        more["property_measurements"] = own.select(T.stable_id("meas_", F.col("span_id")).alias("measurement_id"), "source_id", "experiment_id", "property_id", F.col("property").alias("property_name"), F.col("treated_value").alias("value"), "unit", F.col("treated_value").cast("string").alias("original_value"), "method", F.col("ids").alias("supporting_span_ids"))
        more["effect_claims"] = own.select(
            T.stable_id("eff_", F.col("span_id")).alias("effect_id"), "source_id", "experiment_id", F.concat(F.lit("mat_"), T.canonical_key(F.col("material"))).alias("material_id"), F.col("material").alias("material_name"), "regime_id",
            F.concat_ws(" ", "regime", numbers.shown(F.col("temperature_c")), numbers.shown(F.col("duration_h")), "atmosphere").alias("regime_summary"), "property_id", F.col("effect").alias("direction"), "delta_value", F.col("unit").alias("delta_unit"), F.col("ids").alias("supporting_span_ids"),
        )
        self._write_sources(sources, spans, more, rows.groupBy("source_id").agg(F.array_join(F.first("headers"), " ").alias("header")))
        rows.unpersist()
        sources.unpersist()

    # --- extraction and index -----------------------------------------------------------------------------------

    def extract(self, more: list[DataFrame] | None = None, relations: DataFrame | None = None) -> None:
        """Entities, aliases and edges of all spans: the dictionary's mentions and those of more (span_id, text, entity_type, confidence, origin), resolved.

        relations holds stated edges of spans, as `graph.typed_edges` takes them. Doing it again changes nothing.
        """
        base, _ = self.store.state()
        entities, aliases = self.table("entities"), self.table("entity_aliases")
        names = aliases.join(entities.select("entity_id", "entity_type"), "entity_id").select("alias_norm", "entity_type", "alias").unionByName(entities.select(F.col("canonical_key").alias("alias_norm"), "entity_type", F.col("canonical_name").alias("alias"))).dropDuplicates(["alias_norm", "entity_type"])
        spans = self.table("evidence_spans")
        found = extraction.span_pipeline([resolution.dictionary_mentions(spans, names), *(more or [])], entities, aliases, relations)
        ids = F.coalesce("evidence_span_ids", F.array().cast("array<string>"))
        seen = entities.join(found.evidence.withColumnRenamed("spans", "__spans"), "entity_id").withColumn("evidence_span_ids", mutation.extend_ids(ids, F.col("__spans"))).drop("__spans")
        made = found.created.join(found.evidence, "entity_id").select("entity_id", "entity_type", F.col("key").alias("canonical_key"), "canonical_name", F.col("spans").alias("evidence_span_ids"), F.lit("extracted").alias("validation_status"), F.current_timestamp().alias("created_at"))
        edges = found.edges.withColumn("relation_id", T.stable_id("rel_", F.col("src_entity_id"), F.col("relation_type"), F.col("dst_entity_id")))
        shaped = lambda df, name: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], LEDGER[name]).schema))
        edges = shaped(edges.withColumns({"validation_status": F.lit("extracted"), "created_at": F.current_timestamp()}), "relations")

        def grown(old: DataFrame, new: DataFrame) -> DataFrame:
            """Edges that are there get the spans that they lack."""
            more = new.select("relation_id", F.col("evidence_span_ids").alias("__spans"))
            kept = old.join(more, "relation_id", "left").withColumn("evidence_span_ids", mutation.extend_ids(F.col("evidence_span_ids"), F.col("__spans"))).drop("__spans")
            return kept.unionByName(new.join(old.select("relation_id"), "relation_id", "left_anti").select(*old.columns))

        self.store.commit({
            "entities": (seen.unionByName(shaped(made, "entities")), lambda old, new: mutation.upsert_last(old, new, ["entity_id"])),
            "entity_aliases": (shaped(found.aliases, "entity_aliases"), lambda old, new: mutation.upsert_first(old, new, ["alias_norm", "entity_id"], [F.col("alias")])),
            "relations": (edges, grown),
        }, base)

    def reindex(self) -> None:
        """Vectors of all units: those with a new text are worked out, those without a unit go, the others stay as they are."""
        base, _ = self.store.state()
        units = retrieval.units(self.table("evidence_spans"), self.table("sources"))
        stored = self.table("unit_vectors")
        hashed = units.select("unit_id", "source_id", F.sha2("text", 256).alias("text_hash"))
        keys = ["unit_id", "source_id", "text_hash"]
        differs = hashed.join(stored.select(*keys), keys, "left_anti").select("source_id").unionByName(stored.select(*keys).join(hashed, keys, "left_anti").select("source_id")).distinct()
        changed = differs.join(units.select("source_id", "unit_id", "text"), "source_id", "left")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            sources = new.select("source_id").distinct()
            return old.join(sources, "source_id", "left_anti").select(*old.columns).unionByName(retrieval.index(new.filter("unit_id is not null"), old.join(sources, "source_id", "left_semi")).select(*old.columns))

        self.store.commit({"unit_vectors": (changed, merge)}, base)

    def delete_source(self, source_id: str) -> None:
        """Takes a source away; of the shared tables only buckets of rows that change are written again."""
        base, _ = self.store.state()
        one = self.spark.range(1).select(F.lit(source_id).alias("source_id"))
        without = lambda old, new: old.filter(~F.col("source_id").eqNullSafe(F.lit(source_id)))
        shared = mutation.changes_of_deletion({name: self.table(name) for name in ("evidence_spans", *mutation.SHARED)}, source_id)
        self.store.commit({name: (one, without) for name in mutation.OF_SOURCES} | {name: (rows, lambda old, new, name=name: mutation.applied(old, new, mutation.SHARED[name])) for name, rows in shared.items()}, base)

    # --- reads --------------------------------------------------------------------------------------------------

    def sources(self) -> DataFrame:
        own = self.table("sources").select("source_id", "title", "document_type", "security_label", "created_at", "year", "geography")
        return R.list_sources(own, self.table("evidence_spans"), self.table("property_measurements"), self.table("ingestion_runs")).orderBy(F.desc("created_at"), "title", "source_id")

    def evidence(self, source_id: str) -> DataFrame:
        spans = self.table("evidence_spans").filter((F.col("source_id") == source_id) & F.col("security_label").isin(*self.labels))
        return spans.withColumn("place", graph.document_order(F.col("locator.stable_locator"), F.col("page"))).orderBy("place", "span_id").drop("place")

    def runs(self, source_id: str) -> DataFrame:
        return self.table("ingestion_runs").filter(F.col("source_id") == source_id).orderBy(F.desc("created_at"), "run_id")

    def experiments(self) -> DataFrame:
        m, e = self.table("property_measurements"), self.table("effect_claims")
        keys = ["experiment_id", "property_id", "source_id"]
        return analytics.experiments(m.select(*keys, "property_name", "value", "unit", "method", "supporting_span_ids"), e.select(*keys, "material_id", "material_name", "regime_id", "regime_summary", "direction", "delta_value", "supporting_span_ids"))

    def conflicts(self) -> DataFrame:
        rows = self.experiments().withColumns({"bucket": numbers.regime_bucket(F.col("regime_id")), "method": F.lower(F.trim("method")), "unit": numbers.unit(F.col("unit")), "pos": F.concat_ws(":", "experiment_id", "source_id")})
        return analytics.conflicts(rows, ["material_id", "property_id", "bucket"], "pos")

    def ask(self, question: str, filters: dict[str, list[str]] | None = None, labels: list[str] | None = None, now_year: int = 2026) -> Answer:
        q = qa.compile_question(question, filters, labels, self.labels, now_year)
        q.alloys |= self.aliased(question)
        meta = self.table("sources").select("source_id", "year", "geography")
        spans = self.table("evidence_spans").filter(F.col("security_label").isin(*q.labels))
        rows = self.experiments().join(meta, "source_id", "left").filter(qa.in_scope(q))
        rows = rows.filter(qa.C.row_passes(F.col("value"), F.col("unit"), q.constraints)) if q.constraints else rows
        seen = rows.join(spans.select("source_id").distinct(), "source_id", "left_semi")  # nothing of sources that may not be shown
        chosen = qa.select_experiments(q, seen).cache()
        evidence = R.evidence_of(chosen, spans)
        sentences = qa.answer_sentences(chosen)
        shown = sentences.select(F.lit(1).alias("answer_id"), F.col("experiment_id").alias("sentence_id"), "sentence", "span_ids", "fact_numbers")
        some = chosen.limit(1).count() > 0
        level = "high" if some and (q.alloys or q.property) else "medium" if some else "low"
        asks = any(cue in qa.plain(question) for cue in ("противор", "conflict", "метод", "method"))
        follow = qa.suggestions(seen, question) if some or not q.alloys else qa.closest_names(seen, sorted(q.alloys))
        return Answer(chosen, sentences, evidence, answers.relevant_conflicts(self.conflicts(), chosen, asks), analytics.verify_answers(shown, evidence, list(q.labels)), level, follow)

    def aliased(self, question: str) -> set[str]:
        """Materials that a question names by an alias, as compact names."""
        written = sorted({m.lower() for m in qa.re.findall(r"(?<!\w)[a-zа-яё]{1,8}\d{1,3}[a-zа-яё0-9]*(?!\w)", question.lower())})
        if not written:
            return set()
        hits = self.table("entity_aliases").filter(F.col("alias_norm").isin(written)).join(self.table("entities").filter("entity_type = 'material'"), "entity_id")
        return {r.token for r in hits.select(T.compact(F.col("canonical_name")).alias("token")).distinct().collect() if r.token}

    def retrieve(self, question: str, labels: list[str] | None = None, k: int = 10) -> DataFrame:
        """Spans by words and vectors, best first."""
        allowed = list(qa.compile_question(question, None, labels, self.labels).labels)
        asked = self.spark.createDataFrame([(1, question)], "query_id int, question string")
        spans = self.table("evidence_spans")
        units = retrieval.units(spans, self.table("sources"))
        known = retrieval.index(units, self.table("unit_vectors")).select("unit_id", "vec")
        return retrieval.hybrid(asked, units.join(known, "unit_id"), spans, allowed, k).orderBy("position")

    def record(self, question: str, answer: Answer, latency_ms: int = 0) -> None:
        """Adds a run with its counters; runs have ids of their own."""
        counters = answer.verification.select(F.create_map(*(x for c in answer.verification.columns[1:] for x in (F.lit(c), F.col(c).cast("double")))).alias("verification"))
        run = self.spark.range(1).select(F.expr("uuid()").alias("run_id"), F.lit(question).alias("question"), F.lit(latency_ms).alias("latency_ms"), F.current_timestamp().alias("created_at")).join(counters.limit(1), F.lit(True), "left")
        self.commit({"answer_runs": self.table("answer_runs").unionByName(run, allowMissingColumns=True)})

    # --- graph and statistics -----------------------------------------------------------------------------------

    def entities(self) -> DataFrame:
        return self.table("entities").withColumn("evidence_count", F.coalesce(F.size("evidence_span_ids"), F.lit(0)))

    def search(self, text: str, limit: int = 20) -> DataFrame:
        key = self.spark.range(1).select(T.canonical_key(F.lit(text)).alias("k")).first().k
        return R.search_entities(self.entities(), self.table("entity_aliases"), key, max(1, min(100, limit)))

    def by_type(self, kind: str, limit: int = 100) -> DataFrame:
        return R.top(self.entities().filter(F.col("entity_type") == kind), limit, F.desc("evidence_count"), F.col("entity_id"))

    def neighbourhood(self, entity_id: str, depth: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return graph.neighbourhood(self.entities(), self.table("relations"), entity_id, depth, max(1, min(500, limit)))

    def timeline(self) -> DataFrame:
        return graph.timeline(self.entities().withColumns({"date": F.col("metadata")["date"], "year": F.col("metadata")["year"]}))

    def gaps(self) -> DataFrame:
        """Cells of the curated dictionaries; ids of extracted entities begin with `ent_` and don't take part."""
        curated = self.table("entities").filter(~F.col("entity_id").startswith("ent_"))
        of = lambda kind, name: curated.filter(F.col("entity_type") == kind).select(F.col("entity_id").alias(name))
        regimes = of("regime", "regime_type").withColumn("regime_type", F.regexp_replace("regime_type", "^regime_", ""))
        done = self.experiments().withColumn("regime_type", F.regexp_replace(F.regexp_replace("regime_id", "^reg(ime)?_", ""), "_[0-9]+$", ""))
        return analytics.gap_matrix(of("material", "material_id"), regimes, of("property", "property_id"), done)

    def statistics(self) -> dict[str, DataFrame]:
        count = lambda t, c: R.counts(self.table(t), c).orderBy(F.desc("n"), c)
        return {
            "entities": count("entities", "entity_type"), "relations": count("relations", "relation_type"), "labels": count("sources", "security_label"),
            "quarantine": R.reason_codes(self.table("ingestion_runs").filter("status = 'quarantined'")), "units": R.top(R.counts(self.table("numeric_facts"), "unit"), 20, F.desc("n"), F.col("unit")),
            "subjects": R.top(R.counts(self.table("numeric_facts"), "subject"), 20, F.desc("n"), F.col("subject")),
        }
