"""What queries move between tasks."""

import random

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import analytics, retrieval
from tessera.operators.term_index import TermIndex, bags, words


def stages(spark):
    sc = spark.sparkContext
    seen = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (seen.apply(i) for i in range(seen.size()))}


def moved(spark, work):
    """Bytes that work sends through shuffles."""
    sc = spark.sparkContext
    settle = lambda: sc._jsc.sc().listenerBus().waitUntilEmpty()
    settle()
    before = stages(spark)
    work()
    settle()
    return sum(n for k, n in stages(spark).items() if k not in before)


def test_term_index_moves_texts_and_postings_once(spark, tmp_path):
    """Units that are replaced take their frequencies away without their terms being stored or moved again."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=12))
    rows = lambda: spark.createDataFrame([(f"u{i}", " ".join(word() for _ in range(80))) for i in range(400)], "unit_id string, text string").repartition(4).cache()
    first, second = rows(), rows()
    size = first.agg(F.sum(F.length("text"))).first()[0] + second.agg(F.sum(F.length("text"))).first()[0]
    index = TermIndex(spark, str(tmp_path / "index"), buckets=4)
    assert moved(spark, lambda: (index.upsert(first), index.upsert(second))) < 6.5 * size  # 8.0 when terms were stored by unit, 5.5 without
    want = {r.term: r.n for r in second.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    got = {r.term: r.n for r in index.store.table("terms").groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0").collect()}
    assert got == want and index.store.table("dead").count() == 400


def test_bags(spark):
    texts = ["", None, "...", "b a B c a", "one", "x1 x1 X1"]
    got = bags(spark.createDataFrame(list(enumerate(texts)), "unit_id int, text string")).orderBy("unit_id").collect()
    assert [(r.length, r.terms, r.tfs) for r in got] == [(0, "", []), (0, "", []), (0, "", []), (5, "a b c", [2, 2, 1]), (1, "one", [1]), (3, "x1", [3])]


def test_bm25_counts_words_once(spark):
    """Frequencies come from the shuffle that the postings come from."""
    rows = [(i, " ".join(f"w{i * j % 11}" for j in range(1 + i % 9))) for i in range(200)]
    units = spark.createDataFrame(rows, "unit_id int, text string").repartition(3)
    found = retrieval.bm25(spark.createDataFrame([(1, "w1"), (1, "w2"), (2, "w3")], "query_id int, term string"), units, 5)
    assert len(found.collect()) == 10
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert sum("Exchange hashpartitioning(unit_id" in x and ", term" in x and "ReusedExchange" not in x for x in plan.splitlines()) == 1


def test_nearest_makes_vectors_in_the_scan(spark):
    """Texts are embedded where they are compared, with the hits of stored vectors; texts without words aren't found."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=r.randint(1, 9)))) for i in range(300)] + [(900, ""), (901, None), (902, "...")]
    units = spark.createDataFrame(rows, "unit_id int, text string").repartition(3)
    asked = units.filter("unit_id % 30 = 0").select(F.col("unit_id").alias("query_id"), V.hash_embedding(F.col("text")).alias("vec"))
    hits = lambda df: {(x.query_id, x.rank): (x.unit_id, round(x.score, 9)) for x in df.collect()}
    want = hits(retrieval.nearest(asked, units.select("unit_id", V.hash_embedding(F.col("text")).alias("vec")), 400))
    assert hits(retrieval.nearest(asked, units, 400, embed=V.embedded)) == want and len(want) == 10 * 300


def test_lone_rows_of_conflicts_move_once(spark):
    """Rows without a partner in their group aren't sent to the joins."""
    x = F.xxhash64("id").cast("string")
    e = spark.range(0, 4000, 1, 3).select(F.col("id").alias("m"), F.col("id").alias("pos"), x.alias("experiment_id"), F.lit(0).alias("source_id"), F.lit("increase").alias("direction"), F.lit("HV10").alias("method"), F.col("id").cast("double").alias("value"), F.lit("hv").alias("unit")).cache()
    found = []
    once = moved(spark, lambda: e.repartition("m").write.format("noop").mode("overwrite").save())
    assert moved(spark, lambda: found.append(analytics.conflicts(e, ["m"], "pos").count())) < 2 * once
    pair = e.filter("pos < 2").withColumns({"m": F.lit(-1).cast("bigint"), "pos": F.col("pos") + 5000})
    assert analytics.conflicts(e.unionByName(pair), ["m"], "pos").count() == 1 and found == [0]
