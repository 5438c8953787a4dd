"""Extraction by pluggable models, and what is made of its results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.lineage import cut
from tessera.operators import graph, relational, resolution

# What an extraction may name.
ENTITY_TYPES = (
    "material", "process", "regime", "condition", "property", "equipment", "facility", "experiment", "method", "team",
    "person", "expert", "laboratory", "organization", "location", "technology_solution", "economic_indicator",
    "conclusion", "recommendation", "limitation", "decision", "value", "publication", "patent", "standard",
)
RELATION_TYPES = (
    "MADE_OF", "USES_MATERIAL", "APPLIES_REGIME", "OPERATES_AT_CONDITION", "HAS_MEASUREMENT", "HAS_ECONOMIC_INDICATOR",
    "OF_PROPERTY", "PRODUCED_EFFECT", "PRODUCES_OUTPUT", "SHOWS_EFFECT", "USED_EQUIPMENT", "PERFORMED_BY",
    "AUTHORED_BY", "EXPERT_IN", "MEMBER_OF", "SUPPORTED_BY", "VALIDATED_BY", "FROM_DOCUMENT", "DERIVED_FROM",
    "CONTRADICTS", "HAS_LIMITATION", "RECOMMENDED_FOR", "SIMILAR_TO", "CONCLUDES", "DESCRIBED_IN",
)
PAYLOAD = (
    "entities array<struct<text: string, entity_type: string>>, "
    "relations array<struct<src_text: string, src_type: string, relation_type: string, dst_text: string, dst_type: string>>"
)


def paced(call: Callable[[list[str]], list], batch: int = 32, per_second: float | None = None, attempts: int = 5) -> Callable[[list[str]], list]:
    """A model call on batches, not more often than per_second in a task, tried again when it fails; one result a text, in order."""

    def run(texts: list[str]) -> list:
        out: list = []
        last = 0.0
        for lo in range(0, len(texts), batch):
            some = texts[lo : lo + batch]
            for attempt in range(attempts):
                if per_second:
                    time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                    last = time.monotonic()
                try:
                    got = call(some)
                    if len(got) != len(some):
                        raise ValueError(f"{len(some)} texts gave {len(got)} results")
                    break
                except Exception:
                    if attempt + 1 == attempts:
                        raise
            out += got
        return out

    return run


def modelled(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list]], out: str, kind: str) -> DataFrame:
    """df with the result of a model for each text. make builds the model, once a task."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` {kind}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.assign(**{out: model(frame[text].fillna("").tolist())})

    return df.mapInPandas(run, schema)


def payloads(answers: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Answers that fit the payload, parsed, with entities and relations of known types only; and the others as rejected."""
    read = answers.withColumn("payload", F.from_json(answer, PAYLOAD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fits = F.col("payload").isNotNull() & F.col("payload._bad").isNull() & F.col("payload.entities").isNotNull()
    good = read.filter(fits).withColumn("entities", F.filter("payload.entities", lambda e: e["entity_type"].isin(*ENTITY_TYPES) & (T.canonical_key(e["text"]) != "")))
    good = good.withColumn("relations", F.filter(F.coalesce("payload.relations", F.array().cast("array<struct<src_text: string, src_type: string, relation_type: string, dst_text: string, dst_type: string>>")), lambda r: r["relation_type"].isin(*RELATION_TYPES)))
    return good.drop("payload"), read.filter(~F.coalesce(fits, F.lit(False))).drop("payload").withColumn("status", F.lit("rejected"))


#: Blocks of a text and rows of a table that its head is made of, and its characters.
HEAD_BLOCKS, HEAD_ROWS, HEAD_CHARACTERS = 20, 5, 3000


def heads(spans: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """The beginning of each source (source_id, head), from which its year and place are told.

    spans: source_id, ordinal, span_type, visible_text. The first blocks of its text, or the header line (headers: source_id, header) and
    the first rows of its table, one space between them. Only these few spans of a source ever meet in one place.
    """
    order = Window.partitionBy("source_id").orderBy("ordinal", "visible_text")
    first = spans.select("source_id", "ordinal", "span_type", "visible_text").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEAD_BLOCKS)
    first = first.filter((F.col("span_type") == "text") | (F.col("place") <= HEAD_ROWS)).select("source_id", "place", "visible_text")
    if headers is not None:
        first = first.unionByName(headers.select("source_id", F.lit(0).alias("place"), F.col("header").alias("visible_text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "visible_text"))), lambda x: x["visible_text"])
    return first.filter("visible_text <> ''").groupBy("source_id").agg(F.substring(F.array_join(parts, " "), 1, HEAD_CHARACTERS).alias("head"))


def mention_union(*found: DataFrame) -> DataFrame:
    """Mentions (span_id, text, entity_type, confidence, origin) of a dictionary, a recogniser and a model together."""
    columns = ["span_id", "text", "entity_type", "confidence", "origin"]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in found])


@dataclass
class Extracted:
    resolved: DataFrame  # mentions with entity_id and matched_by
    created: DataFrame  # new entities: entity_id, entity_type, key, canonical_name
    evidence: DataFrame  # entity_id, spans
    aliases: DataFrame
    edges: DataFrame  # src_entity_id, relation_type, dst_entity_id, evidence_span_ids, confidence
    review: DataFrame


def span_pipeline(found: list[DataFrame], entities: DataFrame, aliases: DataFrame, relations: DataFrame | None = None, vectors: DataFrame | None = None) -> Extracted:
    """From mentions to a graph: union, the best mention a span and key, resolution, stated and co-occurrence edges.

    relations holds stated edges of spans (span_id, src_type, src_key, relation_type, dst_type, dst_key). An edge
    that is both stated and seen has all its spans and the higher confidence. Mentions and their entities are written once, as all outputs come from them.
    """
    mentions = cut(resolution.best_mentions(mention_union(*found)))
    resolved, created, review = resolution.resolve(mentions, entities, aliases, vectors)
    resolved = cut(resolved)
    created = resolution.created(resolved)
    # Ids of new entities end with a digest, which is most of what an edge moves.
    seen = graph.co_occurrence(resolved.select("span_id", T.packed(F.col("entity_id")).alias("entity_id"), "entity_type"))
    seen = seen.withColumns({c: T.unpacked(F.col(c)) for c in ("src_entity_id", "dst_entity_id")}).withColumn("confidence", F.lit(0.6))
    edges = seen
    if relations is not None:
        each = seen.select("src_entity_id", "relation_type", "dst_entity_id", "confidence", F.explode("evidence_span_ids").alias("span_id"))
        each = each.unionByName(graph.typed_edges(relations, resolved, RELATION_TYPES).select(*each.columns))
        edges = each.groupBy("src_entity_id", "relation_type", "dst_entity_id").agg(F.sort_array(F.collect_set("span_id")).alias("evidence_span_ids"), F.max("confidence").alias("confidence"))
    evidence = resolved.groupBy("entity_id").agg(F.sort_array(F.collect_set("span_id")).alias("spans"))
    return Extracted(resolved, created, evidence, resolution.learned_aliases(resolved), edges, review)


#: Rows that a task of `publication_links` holds at most, if keys are spread evenly and a source has one publication.
ROWS_A_TASK = 2_000_000


def publication_links(publications: DataFrame, mentions: DataFrame, authors: DataFrame) -> DataFrame:
    """Edges of a source's publication (source_id, publication_id): what it describes and who wrote it.

    Inputs are counted first: as they grow, their joins and edges go to more tasks, not to larger ones. A source's repeats go
    no further than its join. The kinds differ, so the edges of each are made distinct alone. Sorts find the repeats, and the join
    shares theirs; maps would hold all edges in the task that makes them and again in the one that gets them, as few repeat.
    """
    described = mentions.filter(F.col("entity_type").isin("material", "regime", "property"))
    rows = reduce(DataFrame.unionByName, [df.select("source_id") for df in (publications, described, authors)]).count()
    tasks = max(rows // ROWS_A_TASK + 1, publications.sparkSession.sparkContext.defaultParallelism)
    published = publications.select("source_id", "publication_id").repartition(tasks, "source_id")

    def edges(found: DataFrame, src: str, kind: str, dst: str) -> DataFrame:
        each = relational.latest(found.select("source_id", "entity_id").repartition(tasks, "source_id"), ["source_id", "entity_id"], F.col("source_id"))
        ends = each.join(published, "source_id").select(src, dst).repartition(tasks, src, dst)
        once = relational.latest(ends, [src, dst], F.col(src))
        return once.select(F.col(src).alias("src_entity_id"), F.lit(kind).alias("relation_type"), F.col(dst).alias("dst_entity_id"))

    return edges(described, "entity_id", "DESCRIBED_IN", "publication_id").unionByName(edges(authors, "publication_id", "AUTHORED_BY", "entity_id"))
