"""Curated dictionaries as entities and aliases."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


def dictionary(spark: SparkSession, entries: Mapping[str, Iterable[Mapping[str, object]]]) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases of entries by type; an entry has id, name and aliases. An id keeps its first entry.

    Dictionaries are written by hand and small; they are loaded on the driver from whatever format they are in.
    """
    rows = [(str(e["id"]), kind, str(e["name"]), [str(a) for a in e.get("aliases") or ()]) for kind, own in entries.items() for e in own]
    table = spark.createDataFrame(rows, "entity_id string, entity_type string, canonical_name string, aliases array<string>").dropDuplicates(["entity_id"])
    entities = table.select("entity_id", "entity_type", T.canonical_key(F.col("canonical_name")).alias("canonical_key"), "canonical_name", F.lit(1.0).alias("confidence"), F.lit("validated_manual").alias("validation_status"))
    names = table.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("alias"))
    aliases = names.select(T.canonical_key(F.col("alias")).alias("alias_norm"), "entity_id", "alias", F.lit("dictionary").alias("source"))
    return entities, aliases.filter("alias_norm <> ''").dropDuplicates(["alias_norm", "entity_id"])
