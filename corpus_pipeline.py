"""A training-corpus pipeline: score quality, drop near copies, cut repeated passages, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import cluster, minhash, mixing, packing, quality, substring
from tessera.llm import queries as q


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.score(docs, q.table(spark, sf_dir, "labels"), carry=True).filter("predicted = 1").select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; documents without an id stay. Of rows that repeat an id, one of each text stays."""
    kept = minhash.near_duplicates(docs, k=5, percent=80).filter("kept").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(0)))
    known = docs.join(kept, "doc_id", "left_semi").withColumn("__first", first).filter("__first = 1").drop("__first")
    return known.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id also has are cut; other texts stay as they are."""
    cut = substring.remove_repeats(docs, min_words=50, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics are near their target shares."""
    return mixing.sample(docs, list(q.MIX), q.MIX, q.MIX_SHARE, also=q.topics(spark, sf_dir)).filter("selected").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the sample."""
    return packing.pack(docs, q.tokenizer_path(), window=1024, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # the classifier and the tokenizer can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cluster.cut(docs)
    return docs
