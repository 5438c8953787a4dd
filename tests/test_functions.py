from pyspark.sql import functions as F

from tessera.functions import constraints as C
from tessera.functions import dates, numbers, verify
from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, c, **values):
    """A column's value over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(c.alias("x")).first().x


def test_units(spark):
    for written, name in (("мг/дм³", "мг/л"), ("мг/дм3", "мг/л"), ("MG / L", "мг/л"), ("°С", "c"), ("°C", "c"), ("HV", "hv"), ("", "")):
        assert one(spark, numbers.unit(F.col("u")), u=written) == name


def test_canonical_key(spark):
    key = lambda x: one(spark, T.canonical_key(F.col("x")), x=x)
    assert key("Ni-30Сu") == key("Ni–30Cu") == "ni-30cu"  # the first has a Cyrillic С
    assert key("«Медный  штейн».") == "медный штейн"
    assert key("МН30") == "мн30"
    assert key("Мёд") == "мед"


def test_plain_words_are_their_own_key(spark):
    """The short way for plain words gives what the long way gives."""
    for x, want in (("CuNi30 Alloy", "cuni30 alloy"), ("-Ab-", "-ab-"), (" Ab", "ab"), ("A  b", "a b"), ("", ""), ("A.", "a"), (None, None)):
        assert spark.createDataFrame([(x,)], "x string").select(T.canonical_key(F.col("x"))).first()[0] == want


def test_packed_ids(spark):
    ids = [None, "", "p1", "ent_material_" + "a0" * 12, "_" + "0" * 24, "ж_" + "ab" * 12, "ent_x_" + "A0" * 12, "x\n_" + "1" * 24, "_" + "0" * 24 + "\n", "\x01abc"]
    got = spark.createDataFrame([(x,) for x in ids], "id string").select("id", T.packed(F.col("id")).alias("p")).select("id", "p", T.unpacked(F.col("p")).alias("back")).collect()
    assert [r.back for r in got] == ids and len({r.p and bytes(r.p) for r in got}) == len(ids)
    assert len(got[3].p) == 1 + 12 + len("ent_material_")


def test_dates(spark):
    date = lambda x: tuple(one(spark, dates.date_of(F.col("x")), x=x))
    assert date("от 12 марта 2023 г.") == (2023, "2023-03-12")
    assert date("on 2021-06-30 there") == (2021, "2021-06-30")
    assert date("3.4.2019") == (2019, "2019-04-03")
    assert date("March 2020") == (2020, "2020-03-01")
    assert date("heated to 1963 K") == (None, None)
    assert date("2019 г.") == (2019, None)
    assert date("1890-01-01 then 2001-02-03") == (2001, "2001-02-03")
    name = lambda x: one(spark, dates.year_of_filename(F.col("x")), x=x)
    assert name("slag_depletion_2018_final.pdf") == 2018
    assert name("report_v2.docx") is None
    assert name("x_120199.pdf") is None


def test_time_scope():
    scope = lambda q: dates.time_scope(q, 2026)
    assert scope("за последние 5 лет") == (2021, None)
    assert scope("last 3 years") == (2023, None)
    assert scope("с 2019 года") == (2019, None)
    assert scope("до 2015 года") == (None, 2015)
    assert scope("2018–2022") == (2018, 2022)
    for q in ("опыты 2019", "нагрев до 2000 градусов", "раствор с 2019 мг/л"):
        assert scope(q) == (None, None)


def test_geography(spark):
    where = lambda x: one(spark, T.geography(F.col("x")), x=x)
    assert where("Обзор практики Финляндии") == "foreign"
    assert where("Kola smelter") == "ru"
    assert where("Kola and Outokumpu") == "mixed"
    assert where("Ж" * 41) == "ru"
    assert where("short") is None


def test_row_facts(spark):
    facts = lambda h, v: one(spark, numbers.row_facts(F.array(*map(F.lit, h)), F.array(*map(F.lit, v))))
    wide = facts(["Проба", "Сульфаты, мг/л", "Хлориды, мг/л", "Сухой остаток (мг/дм3)"], ["вода", "280", "210,5", "950"])
    assert [(f.subject, f.prop, f.value, f.unit) for f in wide] == [("вода", "сульфаты", 280.0, "мг/л"), ("вода", "хлориды", 210.5, "мг/л"), ("вода", "сухой остаток", 950.0, "мг/л")]
    tall = facts(["Показатель", "Значение", "Ед.изм."], ["Сульфаты", "250", "mg/L"])
    assert [(f.subject, f.prop, f.value, f.unit) for f in tall] == [("сульфаты", "значение", 250.0, "мг/л")]
    assert facts(["a", "b"], ["x", "y"]) == []
    assert facts([], []) == []


def test_labelled(spark):
    line = T.labelled(F.array(*map(F.lit, ("h", "", "u"))), F.array(*map(F.lit, (" 1 ", "2", ""))))
    assert one(spark, line) == "h: 1"
    pairs = one(spark, T.unlabelled(F.lit("a: 1 | plain | b: c: d")))
    assert [tuple(p) for p in pairs] == [("a", "1"), ("b", "c: d")]


def test_constraints(spark):
    assert C.parse("до 2020 года") == []
    assert C.parse("от 100 до 300 мг/л") == [C.Constraint(">=", 100.0, "мг/л"), C.Constraint("<=", 300.0, "мг/л")]
    bound = C.parse("сульфаты, хлориды от 200 до 300 мг/л, сухой остаток ≤1000 мг/дм³")
    assert {(c.subject, c.op, c.value) for c in bound} == {(s, o, v) for s in ("сульфаты", "хлориды") for o, v in ((">=", 200.0), ("<=", 300.0))} | {("сухой остаток", "<=", 1000.0)}
    limit = C.parse("≤1000 мг/дм³")
    for value, unit, ok in ((1500.0, "мг/л", False), (1500.0, "HV", True), (900.0, "mg/l", True), (None, "мг/л", True)):
        got = spark.createDataFrame([(value, unit)], "v double, u string").select(C.row_passes(F.col("v"), F.col("u"), limit).alias("x")).first().x
        assert got is ok
    facts = F.array(F.struct(F.lit("сульфаты").alias("subject"), F.lit(1200.0).alias("value"), F.lit("мг/л").alias("unit")))
    assert one(spark, C.facts_pass(facts, [C.Constraint("<=", 1000.0, "мг/л", "сульфаты")])) is False
    assert one(spark, C.facts_pass(facts, [C.Constraint("<=", 1000.0, "мг/л", "хлориды")])) is True


def test_verification(spark):
    ok = lambda f, s, *cited: one(spark, f(F.lit(s), F.array(*map(F.lit, cited)).cast("array<string>")))
    assert ok(verify.numbers_supported, "hardness 245", "value 245.0")
    assert not ok(verify.numbers_supported, "hardness 999", "value 245")
    assert ok(verify.numbers_supported, "доля 0,5", "share 0.50")
    assert ok(verify.contradicts, "не превышает предел", "превышает предел")
    assert ok(verify.contradicts, "старение снижает твердость", "старение повышает твердость")
    assert not ok(verify.contradicts, "старение повышает твердость", "старение повышает твердость")
    assert ok(verify.supported, "старение повышает твердость сплава", "твердость сплава при старении повышается")
    assert not ok(verify.supported, "совершенно другой разговор", "твердость сплава")


def test_stems_and_authors(spark):
    stem = lambda w: one(spark, T.stem(F.lit(w)))
    assert stem("растворами") == "раствор"
    assert stem("руда") == "руда"
    assert stem("12345") == "12345"
    names = one(spark, T.authors(F.lit("Иванов А. Б., J. Smith, U.S. Steel; Институт металлургии")))
    assert names == ["Иванов А. Б.", "J. Smith"]
    assert one(spark, T.authors(F.lit("Иванов А. Б. без места работы"))) == []


def test_vectors(spark):
    v = one(spark, V.hash_embedding(F.lit("nickel copper matte")))
    assert len(v) == V.DIMS and abs(sum(x * x for x in v) - 1) < 1e-9
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, V.sparse_counts(F.lit("a b a"))) == {"a": 2.0, "b": 1.0}
