"""Entity resolution over a batch of mentions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V

# Cosines from which a mention merges, and from which it is shown for review.
MERGE, REVIEW = 0.90, 0.80
MOST_ALIASES = 500_000  # aliases of one automaton, some 100 bytes each in every Python worker


def _found(names):
    """Aliases in canonical texts by one pass of an automaton. names: a broadcast of (what a text must hold, room for an ending, alias, type)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        own: dict[str, list[tuple[int, str, str]]] = {}
        for must, room, alias, kind in names.value:
            own.setdefault(must, []).append((room, alias, kind))
        for must, entries in own.items():
            machine.add_word(must, (len(must), entries))
        machine.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        for frame in frames:
            rows, texts, kinds = [], [], []
            for r, text in enumerate(frame.column("canonical").to_pylist()):
                seen = set()
                for last, (size, entries) in machine.iter(text):
                    begin = last + 1 - size
                    if begin and word(text[begin - 1]):
                        continue
                    tail = 0  # letters up to the end of the word
                    while tail < 4 and last + 1 + tail < len(text) and word(text[last + 1 + tail]):
                        tail += 1
                    seen.update((alias, kind) for room, alias, kind in entries if tail <= room)
                rows += [r] * len(seen)
                for alias, kind in sorted(seen):
                    texts.append(alias)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([frame.column("span_id").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(kinds, pa.string())], ["span_id", "text", "entity_type"])

    return run


def dictionary_mentions(spans: DataFrame, aliases: DataFrame) -> DataFrame:
    """Spans (span_id, visible_text) and the aliases (alias_norm, entity_type, alias) that occur in them as words.

    Each text is read once by an automaton of all aliases. They are counted first: beyond MOST_ALIASES
    they are dealt by a hash to groups, each with an automaton and a pass of its own. `text.mention_pattern` says what an occurrence is.
    """
    norm = F.col("alias_norm")
    room = F.when(norm.rlike("[0-9a-z]"), 0).when(F.length(norm) > 4, 3).otherwise(2)
    known = aliases.filter(F.length(norm) >= 3).select("alias_norm", T.mention_stem(norm).alias("must"), room.alias("room"), "alias", "entity_type").distinct()
    texts = spans.select("span_id", F.coalesce(T.canonical_key(F.col("visible_text")), F.lit("")).alias("canonical"))
    schema = types.StructType([types.StructField("span_id", spans.schema["span_id"].dataType), types.StructField("text", types.StringType()), types.StructField("entity_type", types.StringType())])
    groups = -(-known.count() // MOST_ALIASES)
    passes = [texts.limit(0).select("span_id", F.lit("").alias("text"), F.lit("").alias("entity_type"))]
    for g in range(groups):
        some = known.filter(F.pmod(F.xxhash64("alias_norm"), F.lit(groups)) == g) if groups > 1 else known
        names = [(r.must, r.room, r.alias, r.entity_type) for r in some.select("must", "room", "alias", "entity_type").collect()]  # about MOST_ALIASES
        if names:
            passes.append(texts.mapInArrow(_found(spans.sparkSession.sparkContext.broadcast(names)), schema))
    found = reduce(DataFrame.unionByName, passes).distinct()
    return found.select("span_id", "text", "entity_type", F.lit(0.95).alias("confidence"), F.lit("rule").alias("origin"))


def best_mentions(mentions: DataFrame) -> DataFrame:
    """The most confident mention of each (span, type, key). Mentions hardly repeat in a task, so they move as they are and get their keys afterwards."""
    moved = mentions.select("span_id", "entity_type", "text", "confidence").repartition("span_id")
    keyed = moved.withColumn("key", T.canonical_key(F.col("text")))
    # Blank keys are known by the aggregate: a filter on the column would go below the shuffle and make keys there too.
    best = keyed.groupBy("span_id", "entity_type", "key").agg(F.max(F.struct("confidence", "text", "key")).alias("m")).filter("m.key <> ''")
    return best.select("span_id", "entity_type", "key", "m.text", "m.confidence")


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities of mentions (span_id, entity_type, key, text), new entities, and pairs to review.

    Steps, each for what the one before left: equal key, equal alias, nearest vector of the type at MERGE or
    more (keys of four characters and more without digits), a new entity a (type, key). Types never mix. vectors
    holds (entity_type, key, vec) of mentions, and entities a vec, where the third step is wanted.
    """
    by_key = entities.groupBy("entity_type", F.col("canonical_key").alias("key")).agg(F.min("entity_id").alias("by_key"))
    by_alias = aliases.join(entities.select("entity_id", "entity_type"), "entity_id").groupBy("entity_type", F.col("alias_norm").alias("key")).agg(F.min("entity_id").alias("by_alias"))
    keys = mentions.select("entity_type", "key").distinct().join(by_key, ["entity_type", "key"], "left").join(by_alias, ["entity_type", "key"], "left")
    review = None
    if vectors is not None:
        open_ = keys.filter(F.col("by_key").isNull() & F.col("by_alias").isNull() & (F.length("key") >= 4) & ~F.col("key").rlike("[0-9]")).select("entity_type", "key").join(vectors, ["entity_type", "key"])
        near = open_.join(entities.filter("vec is not null").select("entity_type", "entity_id", F.col("vec").alias("other")), "entity_type").select("entity_type", "key", "entity_id", V.cosine(F.col("vec"), F.col("other")).alias("score")).filter(F.col("score") >= REVIEW)
        best = near.groupBy("entity_type", "key").agg(F.max_by(F.struct("entity_id", "score"), F.struct("score", "entity_id")).alias("m")).select("entity_type", "key", "m.*")
        review = best.filter(F.col("score") < MERGE)
        keys = keys.join(best.filter(F.col("score") >= MERGE).select("entity_type", "key", F.col("entity_id").alias("by_vector")), ["entity_type", "key"], "left")
    else:
        keys = keys.withColumn("by_vector", F.lit(None).cast("string"))
        review = keys.filter("false").select("entity_type", "key", F.col("by_vector").alias("entity_id"), F.lit(0.0).alias("score"))
    made = T.stable_id("", F.col("entity_type"), F.col("key"), length=24)
    step = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_vector").isNotNull(), "semantic").otherwise("created")
    settled = keys.select("entity_type", "key", F.coalesce("by_key", "by_alias", "by_vector", F.concat(F.lit("ent_"), F.col("entity_type"), F.lit("_"), made)).alias("entity_id"), step.alias("matched_by"))
    found = mentions.join(settled, ["entity_type", "key"])
    return found, created(found), review


def created(found: DataFrame) -> DataFrame:
    """New entities among resolved mentions, by the name of the first span."""
    return found.filter("matched_by = 'created'").groupBy("entity_id", "entity_type", "key").agg(F.min_by("text", "span_id").alias("canonical_name"))


def learned_aliases(found: DataFrame) -> DataFrame:
    """Aliases that resolution taught: keys that matched otherwise than as a key."""
    return found.filter("matched_by <> 'key'").select(F.col("key").alias("alias_norm"), "entity_id", F.col("text").alias("alias"), F.lit("learned").alias("source")).dropDuplicates(["alias_norm", "entity_id"])


def best_offsets(entities: DataFrame) -> DataFrame:
    """Of recognised (span_id, start, end, entity_type, score) the best score each."""
    w = Window.partitionBy("span_id", "start", "end", "entity_type").orderBy(F.col("score").desc(), "text")
    return entities.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
