"""Numbers, units and facts of table rows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.core import let
from tessera.functions.text import canonical_key

# Fixed values. Spellings of one physical unit.
UNIT_SPELLINGS = {
    "мг/дм3": "мг/л", "мг/l": "мг/л", "mg/l": "мг/л", "mg/dm3": "мг/л", "г/дм3": "г/л", "g/l": "г/л", "кг/м3": "г/л",
    "m3/h": "м3/ч", "°с": "c", "°c": "c", "℃": "c", "с": "c", "гр/т": "г/т", "g/t": "г/т", "квт·ч/т": "квтч/т",
    "kwh/t": "квтч/т", "mkg/l": "мкг/л",
}
# Words in brackets of a header that are no units.
NOT_UNITS = (
    "japan", "russia", "australia", "belgium", "germany", "china", "anhuichina", "txusa", "000t", "kazakhstan",
    "canada", "finland", "norway", "sweden", "usa", "uk", "france", "italy", "spain", "poland", "india", "brazil",
    "mexico", "chile", "peru", "zambia", "congo", "morocco", "south africa", "new caledonia", "indonesia",
    "philippines", "zimbabwe", "botswana", "namibia", "mongolia", "iran", "turkey", "korea", "ukraine", "belarus",
    "arctic", "siberia", "ural", "kola",
)
NOT_IN_UNITS = ("japan", "russia", "china", "germany", "korea", "australia", "belgium", "canada", "finland")
# A unit holds one of these.
UNIT_PARTS = (
    "мг", "г", "кг", "т", "мл", "л", "м3", "м²", "м", "мм", "см", "км", "па", "кпа", "мпа", "бар", "атм", "руб", "долл",
    "$", "eur", "usd", "час", "ч", "мин", "сут", "год", "лет", "мес", "%", "град", "°", "c", "k", "f", "ppm", "ppb",
    "вт", "квт", "мвт", "дж", "кал", "гц", "мкг", "нг", "моль", "ммоль", "экв", "mg", "g", "kg", "t", "ml", "l", "m",
    "mm", "cm", "km", "pa", "kpa", "mpa", "bar", "atm", "rub", "h", "min", "day", "year", "mo", "kv", "kw", "mw", "j",
    "cal", "ug", "ng", "mol", "mmol", "eq", "отн", "ед", "раз", "доля", "tier", "class",
)
UNIT_HEADERS = ("ед.изм", "единиц", "unit", "размерн")
VALUE_HEADERS = ("значен", "содержан", "концентрац", "value", "content", "concentration")
SUBJECT_HEADERS = (
    "показател", "компонент", "параметр", "вещество", "элемент", "ион", "материал", "образец", "проба", "metric",
    "parameter", "component", "material", "sample", "element",
)

MOST_HEADERS = 10_000  # distinct headers sent to every task; more are joined by a shuffle
# Numbers and units as tables write them.
NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"
_IN_HEADER = r"[,(]\s*([^,()]+?)\s*\)?$"


def _one_of(names: tuple[str, ...]) -> str:
    """A pattern for any of the names, so that a text is searched once."""
    return "|".join("\\" + n if n in "$." else n.replace(".", "\\.") for n in names)


def unit(c: Column) -> Column:
    """One spelling for each unit: lower case, no spaces, plain digits for superscripts."""
    flat = F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\x{a0}]+", ""), "³²", "32")
    known = F.create_map(*(F.lit(x) for pair in UNIT_SPELLINGS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, flat), flat)


def is_unit(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return (c != "") & (F.length(c) <= 20) & ~low.isin(*NOT_UNITS) & ~low.rlike(_one_of(NOT_IN_UNITS)) & low.rlike(_one_of(UNIT_PARTS))


def first_number(c: Column) -> Column:
    """The first number of a text, with a point or a comma; null if none."""
    found = F.regexp_extract(F.translate(c, " ", " "), NUMBER, 0)
    return F.translate(found, ",", ".").try_cast("double")


def unit_of_header(header: Column) -> Column:
    """The unit after the last comma or bracket of a header, empty if there is none."""
    found = unit(F.regexp_extract(header, _IN_HEADER, 1))
    return F.when(is_unit(found), found).otherwise("")


def header_role(header: Column) -> Column:
    low = F.lower(header)
    return F.when(low.rlike(_one_of(UNIT_HEADERS)), "unit").when(low.rlike(_one_of(VALUE_HEADERS)), "value").when(low.rlike(_one_of(SUBJECT_HEADERS)), "subject").otherwise("other")


def header_cells(headers: Column) -> Column:
    """What each header says of its column: array<struct<h, role, unit, prop>>. It costs far more than a row, and a table has one header."""
    cell = lambda h: F.struct(
        h.alias("h"), header_role(h).alias("role"), unit_of_header(h).alias("unit"),
        F.coalesce(F.nullif(canonical_key(F.trim(F.regexp_replace(h, _IN_HEADER, ""))), F.lit("")), F.lit("value")).alias("prop"),
    )
    return F.transform(F.transform(headers, lambda h: F.coalesce(h, F.lit(""))), cell)


_FACTS = "array<struct<subject: string, subject_label: string, prop: string, value: double, unit: string>>"


def row_facts(headers: Column, values: Column) -> Column:
    """Facts of a table row, of its headers and values; of many rows with one header, `facts_of_rows` reads the header once."""
    return facts_of_cells(header_cells(headers), values)


def facts_of_rows(rows: DataFrame, headers: str = "headers", values: str = "values", out: str = "facts") -> DataFrame:
    """rows with the facts of each, every distinct header read once."""
    known = rows.select(F.col(headers).alias("__headers")).distinct().withColumn("__cells", header_cells(F.col("__headers")))
    if known.limit(MOST_HEADERS + 1).count() <= MOST_HEADERS:
        known = F.broadcast(known)
    return rows.join(known, F.col(headers) == F.col("__headers")).withColumn(out, facts_of_cells(F.col("__cells"), F.col(values))).drop("__headers", "__cells")


def facts_of_cells(known: Column, values: Column) -> Column:
    """Facts of a table row as array<struct<subject, subject_label, prop, value, unit>>. known: what header_cells gives.

    With a subject column and a value column the row is one fact; else the first cell without a
    number names the subject and each other cell with a number is a fact of its column.
    """
    cell = lambda x, i: F.struct(i.alias("i"), x["h"]["h"].alias("h"), x["v"].alias("v"), x["h"]["role"].alias("role"), first_number(x["v"]).alias("n"), x["h"]["unit"].alias("unit"), x["h"]["prop"].alias("prop"))
    bare = F.struct(F.lit("").alias("h"), F.lit("other").alias("role"), F.lit("").alias("unit"), F.lit("value").alias("prop"))
    pairs = F.zip_with(known, values, lambda h, v: F.struct(F.coalesce(h, bare).alias("h"), F.trim(F.coalesce(v, F.lit(""))).alias("v")))

    def roles(cells: Column) -> Column:
        first = lambda test: F.get(F.filter(cells, test), F.lit(0))
        of_role = lambda role: first(lambda x: x["role"] == role)
        return F.struct(cells.alias("cells"), of_role("subject").alias("subject"), of_role("value").alias("value"), of_role("unit")["v"].alias("unit"), first(lambda x: x["n"].isNull() & (x["v"] != "")).alias("name"))

    def named(r: Column) -> Column:
        tall = r["subject"].isNotNull() & r["value"].isNotNull()
        label = F.when(tall, r["subject"]["v"]).otherwise(r["name"]["v"])
        return F.struct(r.alias("r"), tall.alias("tall"), label.alias("label"), canonical_key(label).alias("key"))

    def facts(x: Column) -> Column:
        r = x["r"]
        fact = lambda prop, n, u: F.struct(x["key"].alias("subject"), x["label"].alias("subject_label"), prop.alias("prop"), n.alias("value"), u.alias("unit"))
        own = let(unit(r["unit"]), lambda u: F.when(u != "", F.when(is_unit(u), u).otherwise("")))
        written = F.when(r["unit"] != "", F.coalesce(own, r["value"]["unit"])).otherwise(r["value"]["unit"])
        whole = F.coalesce(F.nullif(canonical_key(r["value"]["h"]), F.lit("")), F.lit("value"))
        one = F.when((x["label"] != "") & r["value"]["n"].isNotNull(), F.array(fact(whole, r["value"]["n"], written)))
        columns = F.filter(r["cells"], lambda c: (c["i"] != r["name"]["i"]) & (F.trim(c["h"]) != "") & c["n"].isNotNull())
        many = F.when(r["name"].isNotNull(), F.transform(columns, lambda c: fact(c["prop"], c["n"], c["unit"])))
        return F.coalesce(F.when(x["tall"], one).otherwise(many).cast(_FACTS), F.array().cast(_FACTS))

    return let(F.transform(pairs, cell), lambda cells: let(roles(cells), lambda r: let(named(r), facts)))


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text, comma as point and without trailing zeros after it."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda n: F.translate(n, ",", "."))
    return F.array_distinct(F.transform(found, lambda n: F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)))


def relative_delta(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude; null where both are 0 or one is null."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull() & (top > 0), F.abs(a - b) / top)


def regime_bucket(regime: Column) -> Column:
    """Kind of a regime and its first number of two to four digits."""
    token = F.regexp_replace(F.regexp_replace(regime, "^reg_", ""), "^regime_", "")
    return F.concat(F.regexp_extract(token, "^[^_0-9]*", 0), F.lit(":"), F.regexp_extract(token, "[0-9]{2,4}", 0))


def shown(value: Column) -> Column:
    """A number as text without a trailing `.0`."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
