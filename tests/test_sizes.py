"""What operators hold and move as tables grow: plans, and rows that leave a task."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.functions import numbers
from tessera.operators import answers, extraction, graph, mutation, qa, resolution, retrieval
from tessera.operators.adjacency import Adjacency
from tessera.plans import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_nearest_sends_few_rows(monkeypatch):
    """A task sends some k rows a query, however small the parts that scores are worked out in."""
    r = np.random.default_rng(2)
    x, asked = r.standard_normal((4000, 6)), r.standard_normal((60, 6))
    monkeypatch.setattr(retrieval, "CELLS", 600)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 1000)), pa.array(x[lo : lo + 1000].tolist(), pa.list_(pa.float64()))], ["unit_id", "vec"]) for lo in range(0, 4000, 1000)]
    got = {}
    for b in retrieval._blocks(SimpleNamespace(value={6: (np.arange(60), asked)}), 5)(iter(batches)):
        for q, u, s in zip(*(b.column(c).to_pylist() for c in ("q", "unit_id", "score")), strict=True):
            got.setdefault(q, []).append((-s, u))
    assert sum(map(len, got.values())) < 60 * 5 * 3
    for q in range(60):
        assert [u for _, u in sorted(got[q])[:5]] == np.argsort(-(x @ asked[q]), kind="stable")[:5].tolist()


def test_relevant_conflicts_make_conflicts_once(spark):
    rows = spark.createDataFrame([(1, 10, 5), (2, 20, 6), (3, 30, 7), (3, 31, 8), (3, 31, 8), (None, None, 9)], "m int, x int, y int")
    made = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("m"))).select(F.col("m").alias("material_id"), F.struct(F.col("x").alias("experiment_id")).alias("a"), F.struct(F.col("y").alias("experiment_id")).alias("b"))
    chosen = spark.createDataFrame([(1, 8), (1, 10), (None, None), (7, 20)], "material_id int, experiment_id int")
    found = answers.relevant_conflicts(made, chosen, False)
    assert plan(found).count("Scan ExistingRDD[m#") == 1
    assert sorted((r.material_id, r.a[0], r.b[0]) for r in found.collect()) == [(1, 10, 5), (2, 20, 6), (3, 31, 8)]


def test_co_occurrence_shuffles_spans_once(spark):
    rows = [(1, "m", "material"), (1, "m", "material"), (1, "q", "equipment"), (1, "t", "team"), (2, "m", "material"), (2, "q", "equipment"), (3, "m", "material"), (3, "m", "equipment"), (4, "c", "decision"), (4, "c", "conclusion"), (4, "m", "material")]
    rows += [(5, f"m{i}", "material") for i in range(12)] + [(5, "q", "equipment")]
    df = spark.createDataFrame(rows, "span_id int, entity_id string, entity_type string")
    found = graph.co_occurrence(df)
    assert shuffles(found) <= 2
    got = {(r.src_entity_id, r.relation_type, r.dst_entity_id): r.evidence_span_ids for r in found.collect()}
    assert got == {("m", "USED_EQUIPMENT", "q"): [1, 2], ("m", "PERFORMED_BY", "t"): [1], ("m", "CONCLUDES", "c"): [4]}


def test_deletion_reads_lists_once(spark):
    """Lists come apart once; repeated and null ids stay where they are."""
    spans = spark.createDataFrame([("a", "gone"), ("b", "gone"), ("b", "gone"), ("c", "stays")], "span_id string, source_id string")
    entities = spark.createDataFrame([("ent_1", ["c", "a", None, "c", "x"]), ("ent_2", ["a", "b"]), ("dict_3", ["b"]), ("ent_4", ["c"]), ("ent_5", [])], "entity_id string, evidence_span_ids array<string>")
    none = spark.createDataFrame([], "relation_id string, src_entity_id string, dst_entity_id string, evidence_span_ids array<string>")
    changed = mutation.changes_of_deletion({"evidence_spans": spans, "entities": entities, "relations": none, "entity_aliases": spark.createDataFrame([], "alias_norm string, entity_id string")}, "gone")["entities"]
    assert plan(changed).count("Generate posexplode") == 1
    assert {r.entity_id: (r.evidence_span_ids, r.gone) for r in changed.collect()} == {"ent_1": (["c", None, "c", "x"], False), "ent_2": ([], True), "dict_3": ([], False)}


def test_constraints_move_flags_only(spark, monkeypatch):
    """Facts of a span are never listed, and null values, units and other subjects count as before."""
    monkeypatch.setattr(qa, "cut", lambda df: df)
    rows = [(1, "a", 5.0, "x"), (1, "a", 50.0, "x"), (2, "a", 50.0, "x"), (3, "a", None, "x"), (4, "a", None, "x"), (4, "a", 50.0, "x"), (5, "b", 50.0, None), (6, "a", float("nan"), "x"), (7, "c", 1.0, "y"), (8, "c", 9.0, "y"), (9, None, 1.0, "y")]
    facts = spark.createDataFrame(rows, "span_id int, subject string, value double, unit string")
    spans = spark.createDataFrame([(i,) for i in range(1, 11)], "span_id int")
    asked = [C.Constraint("<=", 10.0, "x"), C.Constraint(">=", 5.0, "y", "c")]
    kept = qa.drop_violating(spans, facts, asked)
    assert "collect_list" not in plan(kept)
    bad = facts.groupBy("span_id").agg(F.collect_list(F.struct("subject", "value", "unit")).alias("facts")).filter(~C.facts_pass(F.col("facts"), asked))
    assert {r.span_id for r in kept.collect()} == set(range(1, 11)) - {r.span_id for r in bad.collect()} == {1, 3, 4, 5, 8, 9, 10}
    assert qa.drop_violating(spans.filter("span_id = 2"), facts, asked).count() == 1


def test_edges_of_a_pipeline_are_listed_once(spark):
    """Without stated edges the lists of co-occurrence are the edges' lists: two shuffles, no second listing."""
    found = spark.createDataFrame([("s1", "Part 1", "material", 0.9, "rule"), ("s1", "Unit 2", "equipment", 0.7, "ner"), ("s2", "Part 1", "material", 0.9, "rule"), ("s2", "unit 2", "equipment", 0.7, "ner")], "span_id string, text string, entity_type string, confidence double, origin string")
    none = spark.createDataFrame([], "entity_id string, entity_type string, canonical_key string")
    out = extraction.span_pipeline([found], none, spark.createDataFrame([], "alias_norm string, entity_id string"))
    assert shuffles(out.edges) <= 2
    (edge,) = out.edges.collect()
    assert edge.evidence_span_ids == ["s1", "s2"] and edge.confidence == 0.6


def test_edges_move_as_lists(spark, monkeypatch):
    """A source end moves with the list of its other ends, tasks grow with the mentions, and ends that are nearly everywhere go in parts."""
    monkeypatch.setattr(graph, "MENTIONS_A_TASK", 20)
    rows = [(s, x, kind) for s in range(60) for x, kind in (("steel", "material"), (f"m{s % 50}", "material"), (f"q{s % 7}", "equipment"), ("q9", "equipment"))]
    found = graph.co_occurrence(spark.createDataFrame(rows, "span_id int, entity_id string, entity_type string"))
    tree = plan(found)
    assert 0 <= tree.index("Generate explode(ends") < tree.index("Exchange hashpartitioning(src_entity_id") and f", {240 // 20 + 1}), REPARTITION_BY_NUM" in tree
    want = {}
    for s in range(60):
        for a in ("steel", f"m{s % 50}"):
            for b in (f"q{s % 7}", "q9"):
                want.setdefault((a, b), []).append(s)
    got = found.collect()
    assert len(got) == len(want) and {(r.src_entity_id, r.dst_entity_id): r.evidence_span_ids for r in got} == want


def test_mentions_get_keys_after_they_moved(spark):
    rows = [(1, "Part 1", "material", 0.9), (1, "PART 1", "material", 0.9), (1, "part 1", "material", 0.8), (1, "«»", "material", 0.9), (2, None, "material", 0.9), (2, "Part 1", "material", None), (2, "part 1", "material", 0.1)]
    best = resolution.best_mentions(spark.createDataFrame(rows, "span_id int, text string, entity_type string, confidence double"))
    above, below = plan(best).split("Exchange hashpartitioning(span_id", 1)
    assert "lower(" in above and "lower(" not in below and "Exchange" not in below
    assert sorted((r.span_id, r.key, r.text, r.confidence) for r in best.collect()) == [(1, "part 1", "Part 1", 0.9), (2, "part 1", "part 1", 0.1)]


def test_edges_that_come_are_shuffled_once(spark, sf, tmp_path):
    """Names are made after pairs of numbers became distinct, and a new edge isn't looked for among gone ones."""
    made = plan(adapters.relations(spark, sf))
    assert "Exchange hashpartitioning(l_partkey" in made
    edges = spark.createDataFrame([("r1", "a", "t", "b"), ("r2", "b", "t", "c")], "relation_id string, src_entity_id string, relation_type string, dst_entity_id string")
    kept = Adjacency(spark, str(tmp_path / "g"), buckets=2)
    kept.upsert(edges)
    kept.upsert(edges.filter("relation_id = 'r1'").withColumn("dst_entity_id", F.lit("d")), spark.createDataFrame([("r1",), ("r2",), ("absent",)], "relation_id string"))
    assert sorted((r.entity_id, r.other, r.relation_id) for r in kept.store.table("edges").collect()) == [("a", "d", "r1"), ("d", "a", "r1")]
    assert [(r.relation_id, r.src, r.dst) for r in kept.store.table("ends").collect()] == [("r1", "a", "d")]


def test_wide_rows_spell_no_unit(spark, monkeypatch):
    """The unit of a row is worked out only where the row is tall."""
    monkeypatch.setattr(numbers, "unit", lambda c: F.raise_error(F.lit("read")).cast("string"))
    row = spark.sql("select array(named_struct('h', 'Sample', 'role', 'subject', 'unit', '', 'prop', 'sample'), named_struct('h', 'Price, usd', 'role', 'other', 'unit', 'usd', 'prop', 'price')) as known, array('A b', '7,5') as cells")
    (found,) = row.select(numbers.facts_of_cells(F.col("known"), F.col("cells"))).first()[0]
    assert tuple(found) == ("a b", "A b", "price", 7.5, "usd")


def test_publication_links_go_to_more_tasks(spark, monkeypatch):
    """More rows go to more tasks, no map holds a task's edges, and repeats, nulls and unknown sources are as in a plain union."""
    monkeypatch.setattr(extraction, "ROWS_A_TASK", 3, raising=False)
    publications = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (2, "q"), (3, None), (None, "r")], "source_id int, publication_id string")
    found = [(1, "m", "material"), (1, "m", "material"), (1, "t", "team"), (2, "m", "regime"), (2, "n", "property"), (2, None, "material"), (2, None, "material"), (3, "m", "material"), (9, "m", "material"), (None, "m", "material"), (1, "x", None)]
    mentions = spark.createDataFrame(found, "source_id int, entity_id string, entity_type string")
    wrote = [(1, "c"), (2, "c"), (2, "p"), (3, "c"), (3, "c"), (8, "c"), (None, "c")]
    edges = extraction.publication_links(publications, mentions, spark.createDataFrame(wrote, "source_id int, entity_id string"))
    tasks = (6 + 9 + 7) // 3 + 1
    assert plan(edges).count(f", {tasks}), REPARTITION_BY_NUM") >= 4 and "HashAggregate" not in plan(edges)
    want = {(e, "DESCRIBED_IN", p) for s, e, k in found for t, p in publications.collect() if s == t is not None and k in ("material", "regime", "property")}
    want |= {(p, "AUTHORED_BY", e) for s, e in wrote for t, p in publications.collect() if s == t is not None}
    got = [tuple(r) for r in edges.select("src_entity_id", "relation_type", "dst_entity_id").collect()]
    assert len(got) == len(set(got)) == 12 and set(got) == want
