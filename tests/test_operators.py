import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import analytics, graph, mutation, qa, resolution, retrieval
from tessera.operators import relational as R
from tessera.sources import files
from tessera.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_is_idempotent_and_keeps_old_columns(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v int, made int")
    new = spark.createDataFrame([("b", 3, 30), ("c", 4, 40)], "k string, v int, made int")
    once = mutation.upsert_last(old, new, ["k"], keep=["made"])
    assert rows(once, "k", "v", "made") == [("a", 1, 10), ("b", 3, 20), ("c", 4, 40)]
    assert rows(mutation.upsert_last(once, new, ["k"], keep=["made"]), "k", "v", "made") == rows(once, "k", "v", "made")
    assert rows(mutation.upsert_first(old, new, ["k"]), "k", "v") == [("a", 1), ("b", 2), ("c", 4)]


def test_merge_shards_first_wins(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert rows(mutation.merge_shards([a, b], ["k"]), "k", "v") == [("x", 1), ("y", 3)]


def test_delete_source_cascades(spark):
    ledger = {
        "evidence_spans": spark.createDataFrame([("s1", "gone"), ("s2", "kept")], "span_id string, source_id string"),
        "entities": spark.createDataFrame([("ent_a", ["s1"]), ("ent_b", ["s1", "s2"]), ("dict_c", ["s1"])], "entity_id string, evidence_span_ids array<string>"),
        "relations": spark.createDataFrame([("r1", "ent_a", "ent_b", ["s2"]), ("r2", "ent_b", "dict_c", ["s1"]), ("r3", "ent_b", "dict_c", ["s1", "s2"])], "relation_id string, src_entity_id string, dst_entity_id string, evidence_span_ids array<string>"),
        "entity_aliases": spark.createDataFrame([("a", "ent_a"), ("b", "ent_b")], "alias_norm string, entity_id string"),
    }
    out = mutation.delete_source(ledger, "gone")
    assert [(r.entity_id, r.evidence_span_ids) for r in out["entities"].orderBy("entity_id").collect()] == [("dict_c", []), ("ent_b", ["s2"])]
    assert [(r.relation_id, r.evidence_span_ids) for r in out["relations"].collect()] == [("r3", ["s2"])]
    assert rows(out["entity_aliases"], "alias_norm") == [("b",)]


def test_conflicts(spark):
    base = "m string, pos int, experiment_id string, source_id string, direction string, method string, value double, unit string"
    e = spark.createDataFrame(
        [("m", 1, "e1", "s", "increase", "hv", 100.0, "hv"), ("m", 2, "e2", "s", "decrease", "hv", 100.0, "hv"), ("m", 3, "e3", "s", "increase", "hb", 100.0, "hv"),
         ("m", 4, "e4", "s", "increase", "hv", 115.0, "hv"), ("m", 5, "e5", "s", "increase", "hv", 130.0, "gpa"), ("n", 6, "e6", "s", "decrease", "hv", 1.0, "hv")], base,
    )
    got = {(r.a.pos, r.b.pos): r.type for r in analytics.conflicts(e, ["m"], "pos").collect()}
    assert got[1, 2] == "contradictory_direction" and got[1, 3] == "method_mismatch"
    assert (1, 4) not in got  # 15 of 115 is below the threshold
    assert (1, 5) not in got and (4, 5) not in got  # units differ
    assert got[3, 4] == "method_mismatch"


def test_conflicts_against_every_pair(spark):
    """The sweep finds the pairs that a look at all of them finds: negative values, zeros, ties, nulls, borders."""
    import random

    r = random.Random(7)
    rows_ = [
        (r.choice(["m", "n", None]), i, f"e{r.randrange(40)}", r.choice(["s", "t", None]), r.choice(["increase", "decrease", "unknown", None]), r.choice(["hv", "hb", "", None]), r.choice([None, 0.0, 85.0, 100.0, -85.0, -100.0, r.uniform(-50, 50), r.uniform(90, 110)]), r.choice(["hv", "gpa", None]))
        for i in range(160)
    ]
    e = spark.createDataFrame(rows_, "m string, pos int, experiment_id string, source_id string, direction string, method string, value double, unit string")
    side = lambda x: e.select("m", F.struct(*e.columns[1:]).alias(x))
    pairs = side("a").join(side("b"), "m").filter("a.pos < b.pos and not (a.experiment_id = b.experiment_id and a.source_id <=> b.source_id)")
    found = lambda df: sorted((r.m, r.a.pos, r.b.pos, r.type) for r in df.collect())
    want = found(pairs.withColumn("type", analytics.conflict_type("a", "b")).filter("type is not null"))
    assert found(analytics.conflicts(e, ["m"], "pos")) == want and len({w[3] for w in want}) == 3


def test_rows_that_agree_make_no_pairs(spark):
    """A group of 100 000 rows within the threshold of each other, and one row beyond it."""
    e = spark.range(100_000).selectExpr("'m' as m", "id as pos", "string(id) as experiment_id", "'s' as source_id", "'increase' as direction", "'hv' as method", "100 + id / 100000D as value", "'hv' as unit")
    one = spark.createDataFrame([("m", -1, "x", "s", "increase", "hv", 85.2, "hv")], "m string, pos int, experiment_id string, source_id string, direction string, method string, value double, unit string")
    assert analytics.conflicts(e, ["m"], "pos").count() == 0
    # 85.2 is too far below 100.2353 and what lies above that.
    assert analytics.conflicts(e.unionByName(one), ["m"], "pos").count() == sum(1 - 85.2 / (100 + i / 100_000) > 0.15 for i in range(100_000))


def test_gap_matrix_covers_every_cell(spark):
    col = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    done = spark.createDataFrame([("m1", "r1", "p1"), ("m1", "r1", "p1"), ("m9", "r1", "p1")], "material_id string, regime_type string, property_id string")
    cells = analytics.gap_matrix(col("material_id", "m1", "m2"), col("regime_type", "r1"), col("property_id", "p1", "p2"), done).collect()
    assert len(cells) == 4 and sum(c.covered for c in cells) == 1 and max(c.experiments for c in cells) == 2


def test_coverage_counts_what_the_matrix_holds(spark):
    import random

    r = random.Random(2)
    col = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    m, g, p = col("material_id", *(f"m{i}" for i in range(6)), "m1"), col("regime_type", *(f"r{i}" for i in range(300))), col("property_id", *(f"p{i}" for i in range(150)))
    done = spark.createDataFrame([(f"m{r.randrange(8)}", f"r{r.randrange(310)}", f"p{r.randrange(155)}") for _ in range(3000)] * 2 + [("m0", None, "p1"), (None, "r1", "p1")], "material_id string, regime_type string, property_id string")
    want = {x.material_id: (x.covered, x.gaps) for x in analytics.gap_counts(analytics.gap_matrix(m.distinct(), g, p, done), "material_id").collect()}
    got = analytics.coverage(m, g, p, done).collect()
    assert {x.material_id: (x.covered, x.gaps) for x in got} == want and len(got) == 6 and all(a + b == 45_000 for a, b in want.values())
    assert {(x.covered, x.gaps) for x in analytics.coverage(m, g.limit(0), p, done).collect()} == {(0, 0)}


def test_verify_answers(spark):
    s = spark.createDataFrame([(1, 1, "hardness is 245", ["x"], ""), (1, 2, "no citation", [], ""), (1, 3, "value 7", ["y"], "7"), (1, 4, "value", ["nowhere"], "")], "answer_id int, sentence_id int, sentence string, span_ids array<string>, fact_numbers string")
    spans = spark.createDataFrame([("x", "hardness is 999", "public"), ("y", "value", "restricted")], "span_id string, visible_text string, security_label string")
    r = analytics.verify_answers(s, spans, ["public"]).first()
    assert (r.citation_coverage, r.unsupported_claims, r.label_leaks, r.numeric_mismatches) == (0.75, 1, 2, 1)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src_entity_id string, dst_entity_id string")
    focus = spark.createDataFrame([("a",)], "entity_id string")
    assert rows(graph.k_hop(edges, focus, 9), "entity_id", "hops") == [("a", 0), ("b", 1), ("c", 2)]
    entities = spark.createDataFrame([("a", "material", 1), ("b", "material", 5), ("c", "person", 0), ("d", "material", 9)], "entity_id string, entity_type string, evidence_count int")
    nodes, kept = graph.neighbourhood(entities, edges, "b", 1, 2)
    assert rows(nodes, "entity_id") == [("b",), ("c",)]  # a person before a material with more evidence
    assert rows(kept, "src_entity_id", "dst_entity_id") == [("b", "c")]
    assert graph.neighbourhood(entities, edges, "unknown")[0].count() == 0
    crowd = spark.createDataFrame([("s", f"e{i}", "material" if i else "equipment") for i in range(13)] + [("t", "m", "material"), ("t", "q", "equipment")], "span_id string, entity_id string, entity_type string")
    assert rows(graph.co_occurrence(crowd), "src_entity_id", "relation_type", "dst_entity_id") == [("m", "USED_EQUIPMENT", "q")]


def test_crowded_spans_give_all_edges(spark, sf, tmp_path, monkeypatch):
    """No span is too crowded for the query; blocks of a crowded span give the same edges as one list, null spans, repeats and all."""
    from tessera.queries import QUERIES

    lines = [(1, i, i + 100) for i in range(8)] + [(2, 0, 100), (2, 0, 100)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.src_entity_id, r.dst_entity_id): r.spans for r in QUERIES["cooccurrence_edges"](spark, str(tmp_path)).collect()}
    assert got == {(f"p{i}", f"s{j + 100}"): 1 + (i == j == 0) for i in range(8) for j in range(8)}

    kinds = ["material", "equipment", "decision", "conclusion", "team", None]
    found = [(s, f"e{i * 7 % 31}", kinds[(i + s) % 6]) for s, n in ((1, 90), (2, 40), (3, 5), (4, 12)) for i in range(n)] + [(None, "e1", "material"), (None, "e2", "team")] * 9 + [(5, None, "team"), (5, "e1", "material")] * 20
    df = spark.createDataFrame(found, "span_id int, entity_id string, entity_type string")
    relation = {(a, b): kind for a, b, kind in graph.CO_OCCURRENCE}
    want = {}
    for s, a, ka in set(found):
        for t, b, kb in set(found):
            if s == t and (ka, kb) in relation and None not in (a, b) and a != b:
                want.setdefault((a, relation[ka, kb], b), set()).update({s} - {None})
    for listed, few in ((64, 500_000), (4, 500_000), (4, 0)):
        monkeypatch.setattr(graph, "LISTED", listed)
        monkeypatch.setattr(graph, "FEW_CROWDED", few)
        edges = graph.co_occurrence(df, most=None).collect()
        assert len(edges) == len(want) and {(r.src_entity_id, r.relation_type, r.dst_entity_id): set(r.evidence_span_ids) for r in edges} == want


def test_resolution(spark):
    mentions = spark.createDataFrame([(1, "material", "медь", "Медь"), (2, "material", "cuni30", "CuNi30"), (3, "process", "медь", "медь"), (4, "material", "медъ", "медъ")], "span_id int, entity_type string, key string, text string")
    entities = spark.createDataFrame([("m1", "material", "медь", [1.0, 0.0]), ("m2", "material", "ni-30cu", [0.0, 1.0])], "entity_id string, entity_type string, canonical_key string, vec array<double>")
    aliases = spark.createDataFrame([("cuni30", "m2")], "alias_norm string, entity_id string")
    vectors = spark.createDataFrame([("material", "медъ", [1.0, 0.1])], "entity_type string, key string, vec array<double>")
    found, made, review = resolution.resolve(mentions, entities, aliases, vectors)
    got = {r.span_id: (r.matched_by, r.entity_id) for r in found.collect()}
    assert got[1] == ("key", "m1") and got[2] == ("alias", "m2") and got[4] == ("semantic", "m1")
    assert got[3][0] == "created" and got[3][1].startswith("ent_process_")
    assert made.count() == 1 and review.count() == 0


def test_no_mention_is_lost(spark, monkeypatch):
    """The same as the pattern alone for every text and alias."""
    import re as regex

    aliases = ["на дне", "ni-30cu", "cu", "медь", "сплав медь", "в до", "три-на", "а-б-в", "печь"]
    texts = ["на дно", "на дне моря", "лежит на днем", "сплав ni-30cu и cu", "меди и медью", "сплавом медью", "сплав меди", "в доме", "три-нац", "а-б-вг", "печами", "печь."]
    spans = spark.createDataFrame(list(enumerate(texts)), "span_id int, visible_text string")
    names = spark.createDataFrame([(a, "x", a) for a in aliases], "alias_norm string, entity_type string, alias string")
    keys = {r.span_id: r.k for r in spans.select("span_id", T.canonical_key(F.col("visible_text")).alias("k")).collect()}
    patterns = {r.alias: r.p for r in names.select("alias", T.mention_pattern(F.col("alias_norm")).alias("p")).collect()}
    want = {(i, a) for i, k in keys.items() for a, p in patterns.items() if len(a) >= 3 and regex.search(p.replace(r"[\p{L}\p{N}_]", r"\w"), k)}
    assert (0, "на дне") in want and len(want) > 8
    for most in (resolution.MOST_ALIASES, 2):
        monkeypatch.setattr(resolution, "MOST_ALIASES", most)
        assert {(r.span_id, r.text) for r in resolution.dictionary_mentions(spans, names).collect()} == want


def test_many_aliases_and_odd_texts(spark):
    """100 000 aliases in one pass; nulls, empty and long texts, repeated aliases and spans."""
    names = spark.range(100_000).selectExpr("concat('alloy-', id) as alias_norm", "'material' as entity_type", "concat('Alloy-', id) as alias")
    names = names.unionByName(names.limit(5)).unionByName(spark.createDataFrame([(None, "material", "x"), ("ab", "material", "ab")], "alias_norm string, entity_type string, alias string"))
    texts = [(i, f"mix of alloy-{i * 7}, Alloy-{i * 11 + 1}x and (alloy-{99_999 - i})") for i in range(300)]
    spans = spark.createDataFrame([*texts, (5, texts[5][1]), (1000, None), (1001, ""), (1002, "alloy-1 " * 50_000 + "alloy-77777")], "span_id int, visible_text string")
    want = {(i, f"Alloy-{n}") for i, _ in texts for n in (i * 7, 99_999 - i)} | {(1002, "Alloy-1"), (1002, "Alloy-77777")}
    found = resolution.dictionary_mentions(spans, names).collect()
    assert {(r.span_id, r.text) for r in found} == want and len(found) == len(want)
    assert resolution.dictionary_mentions(spans, names.limit(0)).collect() == []


def test_mentions_start_at_words(spark):
    spans = spark.createDataFrame([(1, "пробы руды из карьера"), (2, "оборудование цеха"), (3, "сплав Ni-30Cr"), (4, "сплав Ni–30Cu.")], "span_id int, visible_text string")
    aliases = spark.createDataFrame([("руда", "material", "руда"), ("ni-30cu", "material", "Ni-30Cu")], "alias_norm string, entity_type string, alias string")
    assert rows(resolution.dictionary_mentions(spans, aliases), "span_id", "text") == [(4, "Ni-30Cu")]
    longer = spark.createDataFrame([("рудник", "facility", "рудник")], "alias_norm string, entity_type string, alias string")
    text = spark.createDataFrame([(1, "на рудниках севера"), (2, "сруднику")], "span_id int, visible_text string")
    assert rows(resolution.dictionary_mentions(text, longer), "span_id") == [(1,)]


def test_retrieval(spark):
    units = spark.createDataFrame([("u1", "copper nickel matte"), ("u2", "nickel"), ("u3", "slag")], "unit_id string, text string")
    hits = retrieval.bm25(spark.createDataFrame([(1, "nickel"), (1, "copper")], "query_id int, term string"), units, 5)
    assert [r.unit_id for r in hits.orderBy("rank").collect()] == ["u1", "u2"]
    other = spark.createDataFrame([(1, "u2", 1), (1, "u3", 2)], "query_id int, unit_id string, rank int")
    assert [r.unit_id for r in retrieval.fuse([hits, other], 3).orderBy("rank").collect()] == ["u2", "u1", "u3"]
    candidates = spark.createDataFrame([(1, "твердость 245", "a", "про другое", 1), (1, "твердость 245", "b", "твердость сплава 245 HV", 2)], "query_id int, question string, unit_id string, text string, rank int")
    assert [r.unit_id for r in retrieval.rerank(candidates, 2).orderBy("position").collect()] == ["b", "a"]


def test_questions(spark):
    assert qa.alloys_in("Что с Ni-30Cu и CO2, Al2O3?") == {"ni30cu"}
    assert qa.compile_question("", labels=["restricted"], floor=["public"]).labels == ()
    e = spark.createDataFrame(
        [("e1", 1, "Ni-30Cu", "vickers_hardness", "Vickers hardness", "aging 700 8", "reg_aging_700", 245.0), ("e2", 1, "Ni-30Cr", "density", "Density", "annealing", "reg_anneal", 8.0)],
        "experiment_id string, source_id int, material_name string, property_id string, property_name string, regime_summary string, regime_id string, value double",
    )
    pick = lambda text, **f: [r.experiment_id for r in qa.select_experiments(qa.compile_question(text, f), e).collect()]
    assert pick("твердость по Виккерсу Ni-30Cu при 700") == ["e1"]
    assert pick("что с Cu-90Fe?") == []
    assert pick("ничего общего") == []
    assert pick("", material=["ni-30cr"]) == ["e2"]
    assert qa.chunk_text("One. Two. Six.", 10) == [(0, "One. Two. "), (5, "Two. Six.")]  # a sentence of overlap
    assert qa.chunk_text("One. Two. Three.", 10) == [(0, "One. Two. "), (10, "Three.")]  # none where it doesn't fit
    assert "".join(c for _, c in qa.chunk_text("x" * 25, 10)) == "x" * 25


def test_packet_prefix(spark):
    df = spark.createDataFrame([("a", 1, 900), ("a", 2, 1), ("b", 1, 300), ("b", 2, 300), ("b", 3, 300), ("b", 4, 1)], "k string, i int, n int")
    assert rows(R.within_budget(df, ["k"], "n", 800, F.col("i")), "k", "i") == [("a", 1), ("b", 1), ("b", 2)]


def test_decode_and_archives(spark, tmp_path):
    assert files.decode_bytes("твердость".encode("cp1251")) == ("твердость", "cp1251")
    assert files.decode_bytes("﻿x".encode()) == ("x", "utf-8-sig")
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "hello")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("../evil.txt", "x")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("ok.txt", "fine")
    (tmp_path / "a.zip").write_bytes(outer.getvalue())
    got = {r.path.rpartition("!/")[2]: (r.content, r.reason) for r in files.expand(files.scan(spark, str(tmp_path), ["zip"])).collect()}
    assert got["../evil.txt"] == (None, "unsafe_path")
    assert bytes(got["deep.txt"][0]) == b"hello" and bytes(got["ok.txt"][0]) == b"fine"


def test_experiment_tables(spark, tmp_path):
    head = "experiment_id,material,regime,temperature_c,duration_h,atmosphere,property,method,baseline_value,treated_value,unit,effect"
    (tmp_path / "e.csv").write_text(head + "\nexp_low,Ni-30Cu,aging,700,8,air,Vickers hardness,HV10,210,245,HV,increase\nbad,Ni,aging,hot,8,air,x,y,1,2,HV,increase\n")
    good, bad = files.read_experiments(spark, str(tmp_path / "e.csv"))
    assert [(r.experiment_id, r.delta_value) for r in good.collect()] == [("exp_low", 35.0)]
    assert [r.reason for r in bad.collect()] == ["not_a_number:temperature_c"]
    (tmp_path / "f.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_experiments(spark, str(tmp_path / "f.csv"))
    assert [r.visible_text for r in files.generic_rows(spark.read.option("header", True).csv(str(tmp_path / "f.csv"))).collect()] == ["a: 1 | b: 2"]


def test_lines_and_html(spark):
    df = spark.createDataFrame([("p", "# head\n\n one \ntwo")], "path string, text string")
    assert rows(files.text_spans(df, "text"), "ordinal", "visible_text") == [(2, "one"), (3, "two")]
    page = spark.createDataFrame([("<title>T</title><script>x()</script><nav>menu</nav><p>a &amp; b</p><p>c</p>",)], "html string")
    assert page.select(files.html_text(F.col("html")).alias("x")).first().x.split() == ["T", "a", "&", "b", "c"]
    blocks = spark.range(1).select(files.packed_lines(F.array(*map(F.lit, ("aaaa", "bb", "c"))), 7).alias("x")).first().x
    assert blocks == ["aaaa bb", "c"]
    assert spark.range(1).select(files.packed_lines(F.array(*map(F.lit, ("  a  ", "", " ", "b")))).alias("x")).first().x == ["a b"]


def test_public_addresses():
    to = lambda a: lambda host, port: [(0, 0, 0, "", (a, port))]
    assert files.is_public("https://example.org/x", to("93.184.216.34"))
    assert not files.is_public("https://example.org/x", to("10.0.0.1"))
    assert not files.is_public("ftp://example.org/x", to("93.184.216.34"))


def test_upload_checks(spark):
    df = spark.createDataFrame([("a.csv", 5), ("x/y.csv", 5), ("a.exe", 5), ("a.csv", 0), ("a.csv", 10**9), ("n" * 161 + ".csv", 1)], "name string, length long")
    assert [r.e for r in df.select(files.upload_errors(F.col("name"), F.col("length")).alias("e")).collect()] == [None, "bad_name", "unsupported_type", "empty", "too_large", "bad_name_length"]


def test_streamed_upserts(spark, tmp_path):
    src, table, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    merge = lambda old, batch: mutation.upsert_last(old, batch, ["k"])
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(f"{src}/1")
    run = lambda: ingest.upsert_stream(spark.readStream.schema("k string, v int").parquet(f"{src}/*"), table, state, merge).awaitTermination()
    run()
    spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int").write.parquet(f"{src}/2")
    run()
    assert rows(ingest.version(spark, table, 1), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]


def test_nearest_in_blocks_of_queries_gives_the_same_rows(spark):
    queries = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "query_id int, vec array<double>")
    units = spark.createDataFrame([(i, [float(i), 2.0, float(i % 4)]) for i in range(12)], "unit_id int, vec array<double>")
    rows = lambda most: sorted((r.query_id, r["rank"], r.unit_id, round(r.score, 9)) for r in retrieval.nearest(queries, units, 3, most).collect())
    assert len(rows(100)) == 120 and rows(7) == rows(100)
    assert retrieval.nearest(queries.limit(0), units, 3).collect() == []


def test_gap_matrix_is_the_same_beyond_the_bound_of_its_broadcast(spark, monkeypatch):
    col = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    done = spark.createDataFrame([("m1", "r1", "p1")], "material_id string, regime_type string, property_id string")
    cells = lambda: sorted(map(tuple, analytics.gap_matrix(col("material_id", "m1", "m2"), col("regime_type", "r1"), col("property_id", "p1", "p2"), done).collect()))
    want = cells()
    monkeypatch.setattr(analytics, "MOST_ENTRIES", 0)
    assert len(want) == 4 and cells() == want
