from tessera.ledger import Ledger
from tessera.operators import answers, extraction
from tessera.sources.dictionaries import dictionary

HEAD = "experiment_id,material,regime,temperature_c,duration_h,atmosphere,property,method,baseline_value,treated_value,unit,effect\n"


def test_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "exp_low,Ni-30Cu,aging,700,8,air,Vickers hardness,HV10,210,245,HV,increase\nexp_high,Ni-30Cu,aging,700,8,air,Vickers hardness,HV10,210,320,HV,increase\n")
    (tmp_path / "report_2019.md").write_text("# Title\nKola practice\n\nNi-30Cu gets harder\n")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_tables(str(tmp_path / "a.csv"))
    ledger.add_texts(str(tmp_path / "report_2019.md"), label="restricted")
    ledger.add_texts(str(tmp_path / "report_2019.md"), label="restricted")  # again: nothing new
    listed = {r.title: r for r in ledger.sources().collect()}
    assert (listed["a.csv"].evidence_count, listed["a.csv"].measurement_count, listed["a.csv"].run_status) == (2, 2, "completed")
    assert (listed["report_2019.md"].evidence_count, listed["report_2019.md"].year, listed["report_2019.md"].geography) == (2, 2019, "ru")
    assert [r.visible_text for r in ledger.evidence(listed["report_2019.md"].source_id).collect()] == ["Kola practice", "Ni-30Cu gets harder"]

    got = ledger.ask("твердость Ni-30Cu не более 250 HV")
    assert [r.experiment_id for r in got.experiments.collect()] == ["exp_low"]
    assert got.confidence == "high" and got.evidence.count() == 1
    check = got.verification.first()
    assert (check.citation_coverage, check.label_leaks, check.numeric_mismatches) == (1.0, 0, 0)
    assert ledger.ask("что с Cu-90Fe?").confidence == "low"
    assert [r.type for r in ledger.conflicts().collect()] == ["numeric_disagreement"]
    assert Ledger(spark, str(tmp_path / "ledger"), ("public",)).ask("Ni-30Cu").evidence.count() == 0

    entities, aliases = dictionary(spark, {"material": [{"id": "mat_ni-30cu", "name": "Ni-30Cu", "aliases": ["МН30"]}], "regime": [{"id": "regime_aging", "name": "aging"}, {"id": "regime_cold_rolling", "name": "cold rolling"}], "property": [{"id": "vickers_hardness", "name": "Vickers hardness"}]})
    empty = {t: ledger.table(t) for t in ("entities", "entity_aliases")}
    ledger.commit({t: empty[t].unionByName(new, allowMissingColumns=True) for t, new in (("entities", entities), ("entity_aliases", aliases))})
    assert [r.entity_id for r in ledger.search("мн30").collect()] == ["mat_ni-30cu"]
    assert {(r.regime_type, r.covered) for r in ledger.gaps().collect()} == {("aging", True), ("cold_rolling", False)}
    assert ledger.neighbourhood("mat_ni-30cu")[0].count() == 1 and ledger.by_type("material").count() == 1
    assert {r.security_label: r.n for r in ledger.statistics()["labels"].collect()} == {"internal": 1, "restricted": 1}

    assert [r.experiment_id for r in ledger.ask("твердость МН30 не менее 300 HV").experiments.collect()] == ["exp_high"]
    assert ledger.retrieve("who gets harder").first().visible_text == "Ni-30Cu gets harder"
    assert ledger.retrieve("who gets harder", ["public"]).count() == 0
    ledger.reindex()
    vectors = {r.unit_id: r.vec for r in ledger.table("unit_vectors").collect()}
    assert len(vectors) == 4 and ledger.retrieve("who gets harder").first().visible_text == "Ni-30Cu gets harder"
    ledger.record("твердость?", got)
    assert ledger.table("answer_runs").first().verification["citation_coverage"] == 1.0

    for _ in range(2):  # again: nothing new
        ledger.extract()
        found = {r.entity_id: (r.canonical_key, len(r.evidence_span_ids or [])) for r in ledger.table("entities").collect()}
        assert found["mat_ni-30cu"] == ("ni-30cu", 3) and found["vickers_hardness"][1] == 2 and len(found) == 4
        assert {(r.src_entity_id, r.relation_type, r.dst_entity_id, len(r.evidence_span_ids)) for r in ledger.table("relations").collect()} == {("mat_ni-30cu", "HAS_MEASUREMENT", "vickers_hardness", 2), ("mat_ni-30cu", "APPLIES_REGIME", "regime_aging", 2)}
    new = ledger.table("evidence_spans").filter("span_type = 'text'").selectExpr("span_id", "'Kola works' AS text", "'facility' AS entity_type", "0.7D AS confidence", "'model' AS origin")
    ledger.extract([new])
    made = ledger.table("entities").filter("canonical_name = 'Kola works'").first()
    assert made.entity_id.startswith("ent_facility_") and len(made.evidence_span_ids) == 2

    ledger.delete_source(listed["a.csv"].source_id)
    assert ledger.table("unit_vectors").count() == 2
    assert [r.title for r in ledger.sources().collect()] == ["report_2019.md"] and ledger.experiments().count() == 0
    assert ledger.table("entities").filter("not entity_id like 'ent_%'").count() == 4  # dictionaries stay


def test_every_table_file_is_a_source(spark, tmp_path):
    (tmp_path / "one.csv").write_text(HEAD + "e1,Ni-30Cu,aging,700,8,air,Vickers hardness,HV10,210,245,HV,increase\n")
    (tmp_path / "two.csv").write_text('Показатель,"Значение, мг/л",\nСульфаты,"12,5",x\n,,\nХлориды\n')
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_tables(str(tmp_path))
    listed = {r.title: r for r in ledger.sources().collect()}
    assert {t: (r.evidence_count, r.measurement_count) for t, r in listed.items()} == {"one.csv": (1, 1), "two.csv": (2, 0)}
    own = listed["two.csv"].source_id
    assert [(r.ordinal, r.visible_text) for r in ledger.evidence(own).select("locator.stable_locator", "visible_text").selectExpr("int(right(stable_locator, 3)) AS ordinal", "visible_text").collect()] == [(2, "Показатель: Сульфаты | Значение, мг/л: 12,5"), (4, "Показатель: Хлориды")]
    assert [(r.subject, r.value, r.unit) for r in ledger.table("numeric_facts").filter(f"source_id = '{own}'").collect()] == [("сульфаты", 12.5, "мг/л")]


def test_two_writers_take_no_commit_of_each_other(spark, tmp_path):
    import pytest

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    claim, fs = ledger._claim(1)
    assert fs.createNewFile(claim)
    with pytest.raises(RuntimeError):
        ledger.commit({"entities": ledger.table("entities")})
    assert ledger.table("entities").count() == 0 and ledger.release()
    ledger.commit({"entities": ledger.table("entities")})


def test_gate(spark):
    s = spark.createDataFrame([(1, 1, "value is 5", ["x"]), (1, 2, "value is 6", ["x"]), (1, 3, "value", ["y"]), (1, 4, "value", []), (2, 1, "value is 5", ["x"])], "question_id int, sentence_id int, sentence string, span_ids array<string>")
    spans = spark.createDataFrame([(1, "x", "the value is 5"), (2, "x", "the value is 5")], "question_id int, span_id string, visible_text string")
    good, bad = answers.gate(s, spans)
    assert {r.sentence_id: r.reason for r in bad.collect()} == {2: "numbers", 3: "unknown_span", 4: "no_citation"}
    fallback = s.filter("sentence_id = 4")
    out = {r.question_id: r.mode for r in answers.composed((good, bad), fallback).collect()}
    assert out == {1: "deterministic", 2: "llm"}
    assert {(r.question_id, r.span_id): r.number for r in answers.citation_numbers(s).collect()} == {(1, "x"): 1, (1, "y"): 2, (2, "x"): 1}
    packets = answers.packet(spans.withColumn("source_label", answers.source_label(spans.visible_text, spans.question_id, spans.span_id)), spans.span_id)
    assert packets.filter("question_id = 1").first().packet == "[x] the value is 5, 1, x: the value is 5"


def test_models(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "id int, text string")
    make = lambda: extraction.paced(lambda texts: [len(t) for t in texts], batch=2)
    assert {r.id: r.n for r in extraction.modelled(df, "text", make, "n", "int").collect()} == {1: 1, 2: 0, 3: 3}
    tries = []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return texts

    assert extraction.paced(flaky)(["x"]) == ["x"] and len(tries) == 3
    a = spark.createDataFrame([('{"entities": [{"text": "slag", "entity_type": "material"}, {"text": "x", "entity_type": "dragon"}], "relations": []}',), ("not json",), ("{}",)], "answer string")
    good, bad = extraction.payloads(a)
    assert [[e.text for e in r.entities] for r in good.collect()] == [["slag"]] and bad.count() == 2
