"""Stored indexes against searches that read everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, retrieval
from tessera.operators.adjacency import Adjacency
from tessera.operators.term_index import TermIndex
from tessera.operators.vector_index import VectorIndex


def cloud(n=1600, dims=24, centres=40, seed=3):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((centres, dims))
    x = middle[r.integers(0, centres, n)] + 0.6 * r.standard_normal((n, dims))
    return x


@pytest.fixture(scope="module")
def vectors(spark):
    x = cloud()
    return spark.createDataFrame([(f"u{i:05d}", f"s{i % 9}", "public" if i % 3 else "internal", v.tolist()) for i, v in enumerate(x)], "unit_id string, source_id string, security_label string, vec array<double>").repartition(4).cache()


def asked(units):
    return units.filter("int(substring(unit_id, 2)) % 32 = 0").select(F.col("unit_id").alias("query_id"), "vec")


def hits(df):
    return {(r.query_id, r["rank"]): (r.unit_id, round(r.score, 6)) for r in df.collect()}


def test_vector_index(spark, vectors, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"), buckets=8)
    index.build(vectors)
    want = hits(retrieval.nearest(asked(vectors), vectors.select("unit_id", "vec"), 10))
    assert hits(index.search(asked(vectors), 10, exact=True)) == want
    got = hits(index.search(asked(vectors), 10))
    by = lambda found: {(q, u) for (q, _), (u, _) in found.items()}
    assert len(by(got) & by(want)) / len(want) >= 0.9
    compared, every = index.compared(asked(vectors))
    assert compared < 0.5 * every
    one = asked(vectors).limit(1)
    read = index.store.lookup("lists", [0]).inputFiles()
    assert len(read) < len(index.store.table("lists").inputFiles()) and len(hits(index.search(one, 3))) == 3
    # Blocks of queries, labels, and queries that can't find anything.
    assert hits(index.search(asked(vectors), 10, exact=True, most=7)) == want
    public = index.search(asked(vectors), 5, exact=True, labels=["public"])
    assert hits(public) == hits(retrieval.nearest(asked(vectors), vectors.filter("security_label = 'public'").select("unit_id", "vec"), 5))
    odd = spark.createDataFrame([("a", [0.0] * 24), ("b", None), ("c", [1.0])], "query_id string, vec array<double>")
    assert index.search(odd, 3).collect() == [] and index.search(asked(vectors).limit(0), 3).collect() == []


def test_vector_index_is_kept_up(spark, vectors, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"), buckets=8)
    some = vectors.filter("int(substring(unit_id, 2)) < 500")
    index.build(some)
    files = index.store.state()[1]["lists"]
    moved = some.filter("unit_id = 'u00007'").withColumn("vec", F.transform("vec", lambda x: -x)).unionByName(vectors.filter("unit_id = 'u01599'"))
    index.upsert(moved, some.filter("unit_id = 'u00008'").select("unit_id"))
    now = some.filter("unit_id not in ('u00007', 'u00008')").unionByName(moved)
    assert hits(index.search(asked(vectors), 10, exact=True)) == hits(retrieval.nearest(asked(vectors), now.select("unit_id", "vec"), 10))
    after = index.store.state()[1]["lists"]
    assert 1 <= sum(files.get(b) != p for b, p in after.items()) <= 4
    index.upsert(moved)  # again: the same rows
    assert index.store.table("lists").count() == index.store.table("units").count() == now.count()


def test_vector_index_of_nothing(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"), buckets=2)
    none = spark.createDataFrame([("z", [0.0, 0.0]), ("n", None)], "unit_id string, vec array<double>")
    one = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vec array<double>")
    index.build(none)
    assert index.search(one, 3).collect() == []
    index.upsert(one.withColumnRenamed("query_id", "unit_id"))
    assert hits(index.search(one, 3)) == {("q", 1): ("q", 1.0)}
    with pytest.raises(ValueError):
        index.build(one.withColumnRenamed("query_id", "unit_id").unionByName(spark.createDataFrame([("y", [1.0])], "unit_id string, vec array<double>")))


def texts(n=400, seed=6):
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    return [(f"d{i:04d}", " ".join([*(r.choice(common) for _ in range(r.randint(0, 40))), *(r.choice(rare) for _ in range(r.randint(0, 4)))])) for i in range(n)]


def bm25(spark, rows, asked, k):
    return {(r.query_id, r["rank"]): (r.unit_id, round(r.score, 9)) for r in retrieval.bm25(asked, spark.createDataFrame(rows, "unit_id string, text string"), k).collect()}


def test_term_index(spark, tmp_path):
    """Equal to the search over the texts after additions, changes, deletions and a compaction, with fewer candidates."""
    rows = texts()
    asked = spark.createDataFrame([(1, "r5"), (1, "r7"), (1, "c1"), (1, "c2"), (2, "c3"), (2, "c4"), (3, "r9"), (3, "none"), (4, "none"), (5, "r5"), (5, "c1"), (5, "c2"), (5, "c3"), (5, "r12"), (5, "r13")], "query_id int, term string").repartition(2)
    frame = lambda some: spark.createDataFrame(some, "unit_id string, text string")
    same = lambda now: {q: v for q, v in hits9(index.search(asked, 5)).items()} == bm25(spark, now, asked, 5)
    hits9 = lambda df: {(r.query_id, r["rank"]): (r.unit_id, round(r.score, 9)) for r in df.collect()}
    index = TermIndex(spark, str(tmp_path / "index"), buckets=4)
    assert index.search(asked, 5).collect() == []
    index.upsert(frame(rows[:300]).repartition(3))
    assert same(rows[:300])
    some, every = index.touched(asked, 5)
    assert some < every
    before = index.store.state()[1]["postings"]
    changed = [("d0003", "r5 r5 r7 c1"), ("d0004", None), ("d0005", "r9"), *rows[300:]]
    index.upsert(frame(changed), frame([("d0010", ""), ("absent", "")]).select("unit_id"))
    now = list((dict(rows) | {k: v or "" for k, v in changed}).items())
    now = [x for x in now if x[0] != "d0010"]
    assert same(now)
    assert all(p.startswith(before[b]) for b, p in index.store.state()[1]["postings"].items() if b in before)  # old postings stay where they are
    version = index.store.versions()[-1]
    index.upsert(frame(changed))  # the same texts: no new postings
    assert index.store.table("postings", version).count() == index.store.table("postings").count()
    index.compact()
    assert index.store.table("dead").count() == 0 and same(now)
    index.upsert(None, frame(now).select("unit_id"))
    assert index.search(asked, 5).collect() == []


def test_appended_parts_are_compacted(spark, tmp_path):
    from tessera.store import Store, Table

    store = Store(spark, str(tmp_path / "s"), {"t": Table("k int", "k", 1)})
    for i in range(4):
        store.commit({"t": (spark.createDataFrame([(i,)], "k int"), None)})
    assert store.state()[1]["t"][0].count("|") == 3 and store.compact("t", parts=3) == 1 and store.compact("t", parts=3) == 0
    assert sorted(r.k for r in store.table("t").collect()) == [0, 1, 2, 3] and store.vacuum(1) == 4


def test_adjacency(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"r{i}", f"e{r.randrange(150)}", "t", f"e{r.randrange(150)}") for i in range(300)] + [("loop", "e1", "t", "e1")]
    frame = lambda some: spark.createDataFrame(some, "relation_id string, src_entity_id string, relation_type string, dst_entity_id string")
    kept = Adjacency(spark, str(tmp_path / "graph"), buckets=8)
    kept.upsert(frame(rows))
    moved = [("r5", "e1", "t", "new"), ("more", "new", "t", "far")]
    before = kept.store.state()[1]["edges"]
    kept.upsert(frame(moved), frame(rows[7:8]).select("relation_id"))
    assert sum(before[b] != p for b, p in kept.store.state()[1]["edges"].items()) < 8
    now = frame([x for x in rows if x[0] not in ("r5", "r7")] + moved)
    for ids in (["e1"], ["e2", "e3"], ["unknown"]):
        focus = spark.createDataFrame([(i,) for i in ids], "entity_id string")
        for depth in (1, 2):
            want = {(x.entity_id, x.hops) for x in graph.k_hop(now, focus, depth).collect()}
            assert {(x.entity_id, x.hops) for x in kept.k_hop(focus, depth).collect()} == want
    one = spark.createDataFrame([("e1",)], "entity_id string")
    assert len({f.rsplit("/", 2)[1] for f in kept.of(one).inputFiles()}) == 1
    assert kept.store.table("ends").count() == len(rows)


def test_vector_scans_are_bounded(monkeypatch):
    """A batch against many queries holds some CELLS scores at a time, and gives the same rows in parts of eight queries."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from tessera.operators import vector_index

    r = np.random.default_rng(5)
    x, asked = r.standard_normal((4000, 8)), r.standard_normal((9999, 8))
    cells = r.integers(0, 20, len(x)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(cells), pa.array([str(i) for i in range(len(x))]), pa.array(x.tolist(), pa.list_(pa.float64()))], ["cell", "unit_id", "vec"])
    sent = lambda n: SimpleNamespace(value=(asked[:n], {c: np.packbits(np.ones(n, bool)) for c in range(20)}))
    tracemalloc.start()
    for _ in vector_index._scanned(sent(9999), True, 5)([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6  # all scores together are 320 MB
    monkeypatch.setattr(vector_index, "CELLS", 100)
    got = {}
    for b in vector_index._scanned(sent(19), True, 5)([batch.slice(0, 1500), batch.slice(1500)]):
        for q, u, s in zip(*(b.column(c).to_pylist() for c in ("q", "unit_id", "score")), strict=True):
            got.setdefault(q, []).append((-s, int(u)))
    for q in range(19):
        assert [u for _, u in sorted(got[q])[:5]] == np.argsort(-(x @ asked[q]), kind="stable")[:5].tolist()
