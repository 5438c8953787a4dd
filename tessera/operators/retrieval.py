"""Hybrid retrieval: nearest vectors, sparse terms, rank fusion and lexical reranking.

The published formulas are used: BM25 with k1 1.2 and b 0.75, its inverse document frequency
ln(1 + (N - df + 0.5) / (df + 0.5)), and reciprocal rank fusion 1 / (60 + rank).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import mutation

K1, B, FUSE = 1.2, 0.75, 60
RERANK_POOL = 30
MOST_TERMS = 20_000  # terms of all queries that are named in a plan
MOST_QUERIES = 100_000  # rows of the query side sent to every task; more are joined by a shuffle
CELLS = 4_000_000  # scores that a task holds at a time
MOST_VECTORS = 10_000  # query vectors sent to every task at a time; more go in blocks


def _blocks(asked, k: int, embed: Callable[[list[str]], np.ndarray] | None = None):
    """The k best units of a batch of rows for each query, ties included, without those below the k-th of an earlier batch.

    asked: a broadcast of {dimensions: (query numbers, unit vectors)}. Queries go in parts of some CELLS scores. embed: makes the vectors of rows that hold text.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = {dims: np.full(len(numbers), -np.inf) for dims, (numbers, _) in asked.value.items()}  # what each query's k-th unit so far has
        for frame in frames:
            if embed:
                own = embed([x or "" for x in frame.column("text").to_pylist()])
                length = np.sqrt((own * own).sum(axis=1))
                sizes = np.where(length > 0, own.shape[1], -1)
                flat = np.divide(own, length[:, None], out=own, where=length[:, None] > 0).ravel()
                first = np.arange(len(own) + 1) * own.shape[1]
            else:
                sizes = np.diff(frame.column("vec").offsets.to_numpy())
                flat, first = frame.column("vec").flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            for dims, (numbers, vectors) in asked.value.items():
                rows = np.flatnonzero(sizes == dims)
                if not len(rows):
                    continue
                x = flat[(first[rows][:, None] + np.arange(dims)).ravel()].reshape(-1, dims)
                step = max(1, CELLS // len(rows))
                for lo in range(0, len(numbers), step):
                    floor = floors[dims][lo : lo + step]
                    # Sums of the same numbers may differ in the last digits by their place in a block.
                    score = np.round(x @ vectors[lo : lo + step].T, 12)
                    if len(rows) > k:
                        np.maximum(floor, np.partition(score, len(rows) - k, axis=0)[len(rows) - k], out=floor)
                    at, q = np.nonzero(score >= floor)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[lo : lo + step][q], pa.int32()), frame.column("unit_id").take(pa.array(rows[at])), pa.array(score[at, q])], ["q", "unit_id", "score"])

    return run


def nearest(queries: DataFrame, units: DataFrame, k: int, most: int = MOST_VECTORS, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """The k units of largest cosine for each query. queries: query_id, vec (a stated set); units: unit_id, vec.

    Every unit is compared with every query where it lies, in blocks; each task keeps k rows a query before the shuffle.
    Queries are counted first: beyond `most` they go by a hash of their id in blocks of about that many, one after the other.
    With embed, units hold text in place of vec, and vectors are made where they are compared and don't leave the task.
    Vectors without a direction, with components that are no finite numbers, or of other dimensions than a query's are not found. Scores count to 12 places.
    """
    spark = units.sparkSession
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ready = lambda df, key: df.select(F.col(key), F.col("vec").cast("array<double>").alias("vec")).filter(finite(F.col("vec"))).withColumn("vec", V.unit(F.col("vec"))).filter("vec is not null")
    asked, rows = ready(queries, "query_id"), units.select("unit_id", "text") if embed else ready(units, "unit_id")
    blocks = -(-asked.count() // most) or 1
    parts = []
    for b in range(blocks):
        some = (asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).collect()  # about `most`
        sets: dict[int, tuple[list[int], list]] = {}
        for i, r in enumerate(some):
            for held, x in zip(sets.setdefault(len(r.vec), ([], [])), (i, r.vec), strict=True):
                held.append(x)
        sent = spark.sparkContext.broadcast({dims: (np.array(i), np.array(v)) for dims, (i, v) in sets.items()})
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(some)], types.StructType([types.StructField("q", types.IntegerType()), types.StructField("query_id", asked.schema["query_id"].dataType)]))
        schema = types.StructType([types.StructField("q", types.IntegerType()), types.StructField("unit_id", rows.schema["unit_id"].dataType), types.StructField("score", types.DoubleType())])
        parts.append(ranked(rows.mapInArrow(_blocks(sent, k, embed), schema).join(F.broadcast(names), "q").select("query_id", "unit_id", "score"), k))
    return reduce(DataFrame.unionAll, parts)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "unit_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def term_counts(units: DataFrame, text: Column, key: str = "unit_id") -> DataFrame:
    """(unit, term, tf, length) of each text."""
    words = units.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    each = words.select(key, F.size("words").alias("length"), F.explode("words").alias("term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """The k best units for each query. queries: query_id, term (distinct, a stated, small set); units: unit_id, text.

    Statistics are of all units; only postings of asked terms are scored.
    """
    wanted = [r.term for r in queries.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    words = units.select("unit_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    sized = words.select("unit_id", F.size("words").alias("length"), "words")
    stats = sized.agg(F.count(F.lit(1)).alias("units"), F.avg("length").alias("mean"))
    each = sized.select("unit_id", "length", F.explode("words").alias("term"))
    each = each.filter(F.col("term").isin(wanted)) if len(wanted) <= MOST_TERMS else each.join(queries.select("term").distinct(), "term", "left_semi")
    asked = each.groupBy("unit_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    # Every count is above 0: named here, all columns are read and both readers share one shuffle.
    df = asked.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("length") > 0)).alias("df"))
    idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # df has a row a term of the queries, stats is one row.
    side = F.broadcast if len(wanted) <= MOST_TERMS else (lambda x: x)
    posted = asked.join(side(df), "term").crossJoin(F.broadcast(stats)).select("unit_id", "term", weight.alias("w"))
    few = queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    return ranked(posted.join(F.broadcast(queries) if few else queries, "term").groupBy("query_id", "unit_id").agg(F.sum("w").alias("score")), k)


def fuse(legs: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, unit_id, rank)."""
    every = legs[0].select("query_id", "unit_id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "unit_id", "rank"))
    return ranked(every.groupBy("query_id", "unit_id").agg(F.sum(1.0 / (FUSE + F.col("rank"))).alias("score")), k)


def lexical_score(q: Column, d: Column, raw: Column, body: Column) -> Column:
    """Weighted overlap of stemmed words and numbers, with a bonus for phrases and for shared numbers.

    q, d: tokens of the question and of the text; raw: the question's stems with stop words; body: the text. They are
    read many times, so they should be columns, not expressions.
    """
    weight = lambda t: F.when(t.rlike("^[0-9]+$"), 6.0).when(F.length(t) >= 7, 2.5).when(F.length(t) >= 5, 1.5).otherwise(1.0)
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    overlap = F.aggregate(F.array_intersect(q, d), F.lit(0.0), lambda s, t: s + weight(t) * F.least(times(q, t), times(d, t)))
    pairs = F.when(F.size(raw) > 1, F.zip_with(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(1))), F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    flat = F.translate(F.lower(body), "ё", "е")
    phrases = F.size(F.filter(pairs, lambda p: (F.length(p) >= 7) & flat.contains(p)))
    figures = F.size(F.filter(F.array_intersect(q, d), lambda t: t.rlike("^[0-9]+$")))
    score = overlap / F.sqrt((F.size(q) * F.size(d)).cast("double")) + 0.35 * phrases + 0.5 * figures
    return F.when(F.size(d) == 0, 0.0).when(F.size(q) > 0, score)


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates (query_id, question, unit_id, text, rank); ties keep their rank, and a question without words keeps the order."""
    asked = candidates.select("query_id", "question").distinct().select("query_id", T.tokens(F.col("question")).alias("q"), F.transform(T.raw_tokens(F.col("question")), T.stem).alias("raw"))
    split = candidates.withColumn("d", T.tokens(F.col("text"))).join(asked, "query_id")
    scored = split.withColumn("lexical", F.coalesce(lexical_score(F.col("q"), F.col("d"), F.col("raw"), F.col("text")), F.lit(0.0))).drop("q", "d", "raw")
    w = Window.partitionBy("query_id").orderBy(F.col("lexical").desc(), "rank", "unit_id")
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def rejoin(hits: DataFrame, spans: DataFrame, allowed: list[str]) -> DataFrame:
    """Hits with their spans, in the order of the hits, without spans whose label isn't allowed now."""
    return hits.join(spans.filter(F.col("security_label").isin(*allowed)), hits["unit_id"] == spans["span_id"])


def units(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """What is indexed of spans: the source's title, a line end and the text, with the fields that searches filter by. Blank spans have no unit."""
    own = spans.join(sources.select("source_id", "title"), "source_id").filter(F.trim("visible_text") != "")
    return own.select(F.col("span_id").alias("unit_id"), F.concat_ws("\n", "title", "visible_text").alias("text"), "source_id", "security_label", "span_type")


def index(units: DataFrame, stored: DataFrame) -> DataFrame:
    """Vectors of units (unit_id, source_id, text): stored ones where the text is the same, new ones else; units that are gone have none."""
    hashed = units.select("unit_id", "source_id", "text", F.sha2("text", 256).alias("text_hash"))
    kept = stored.select("unit_id", "text_hash", "vec").join(hashed.select("unit_id", "source_id", "text_hash"), ["unit_id", "text_hash"])
    new = mutation.fresh(units.select("unit_id", "source_id", "text"), stored).withColumn("vec", V.hash_embedding(F.col("text")))
    columns = ["unit_id", "source_id", "text_hash", "vec"]
    return kept.select(*columns).unionByName(new.select(*columns))


def scroll(stored: DataFrame, source_id: str, after: str | None = None, page: int = 1024) -> DataFrame:
    """The next page of a source's units, in the order of their ids."""
    own = stored.filter(F.col("source_id") == source_id)
    return (own if after is None else own.filter(F.col("unit_id") > after)).orderBy("unit_id").limit(page)


def hybrid(queries: DataFrame, indexed: DataFrame, spans: DataFrame, allowed: list[str], k: int = 10) -> DataFrame:
    """The k best spans of each query (query_id, question) by words and hashed vectors together, reranked by their words.

    Labels are filtered before both rankings, as no filter passes through them, and again when the hits meet the
    spans as they are now. Both legs rank max(100, 5 k) units. indexed: what `units` gives, with vec where vectors are stored.
    """
    pool = max(100, 5 * k)
    seen = indexed.filter(F.col("security_label").isin(*allowed))
    asked = queries.select("query_id", V.hash_embedding(F.col("question")).alias("vec"))
    dense = nearest(asked, seen.select("unit_id", "vec"), pool) if "vec" in indexed.columns else nearest(asked, seen.select("unit_id", "text"), pool, embed=V.embedded)
    terms = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("term"))
    found = fuse([dense, bm25(terms, seen.select("unit_id", "text"), pool)], RERANK_POOL)
    rows = rejoin(found, spans, allowed).join(queries, "query_id").withColumn("text", F.col("visible_text"))
    return rerank(rows, k)
