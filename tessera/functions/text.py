"""Text normalisation and identity as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. White space as Python's \s sees it, for Java patterns that know ASCII only.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
DASHES = "‐‑‒–—―−_"
EDGE = "\"'«»„“”()[]{}.,:;!?"
# Cyrillic letters and the Latin ones that look the same.
HOMOGLYPHS = ("авекмнорстух", "abekmhopctyx")
RU_STOP_WORDS = ("без", "для", "или", "как", "какая", "какие", "какой", "над", "при", "про", "что", "это")
# Endings that the light stemmer takes off, the longest first.
RU_ENDINGS = (
    "иями", "ями", "ами", "ого", "ему", "ими", "ыми", "иях", "ах", "ях", "ов", "ев", "ия", "ий", "ый", "ой", "ая", "ое",
    "ые", "ых", "ам", "ям", "ом", "ем", "ие", "ии", "и", "ы", "а", "я", "е", "у", "ю",
)
# Places and organisations that tell whose practice a document describes. Names of companies are the caller's to add.
RU_PLACES = (
    "россия", "российск", "рф", "норильск", "мончегорск", "заполярн", "кольск", "гмк", "norilsk", "kola", "россии",
    "оао", "пао", "фгуп", "санкт-петербург", "москва", "екатеринбург",
)
FOREIGN_PLACES = (
    "finland", "aalto", "sweden", "norway", "canada", "sudbury", "long harbour", "australia", "china", "japan",
    "germany", "usa", "united states", "south africa", "финлянд", "швеци", "канад", "австрал", "китай", "япони",
    "герман", "уэльва", "huelva", "outokumpu", "vale", "glencore", "boliden",
)
LABELS = ("public", "internal", "confidential", "restricted")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def visible_text(c: Column) -> Column:
    """White-space runs as one space, edges trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))


def stable_id(prefix: str, *parts: Column, length: int = 40) -> Column:
    """A key from content: hex of a SHA-256 over the parts. A null part is unlike every text."""
    joined = F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


_HASHED = r"_[0-9a-f]{24}\z"


def packed(c: Column) -> Column:
    """An id as bytes, the 24 hexadecimal digits at the end of a made one as 12; `unpacked` gives it back."""
    made = F.concat(F.lit(b"\x01"), F.unhex(F.right(c, F.lit(24))), F.encode(F.substring(c, F.lit(1), F.length(c) - 24), "utf-8"))
    return F.when(c.rlike(_HASHED), made).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "utf-8")))


def unpacked(c: Column) -> Column:
    made = F.concat(F.decode(F.substring(c, F.lit(14), F.length(c)), "utf-8"), F.lower(F.hex(F.substring(c, F.lit(2), F.lit(12)))))
    return F.when(F.substring(c, F.lit(1), F.lit(1)) == F.lit(b"\x01"), made).otherwise(F.decode(F.substring(c, F.lit(2), F.length(c)), "utf-8"))


_NOT_PLAIN = "[^a-z0-9 -]|  |^ | $"
_NOT_PLAIN_CASED = "[^A-Za-z0-9 -]|  |^ | $"


def canonical_key(c: Column) -> Column:
    """The key that mentions of one entity share: case, dashes, edge punctuation, ё and look-alike letters folded."""
    flat = F.translate(F.lower(c), DASHES + "ё", "-" * len(DASHES) + "е")
    edge = "[" + SPACE[1:-1] + "".join("\\" + x for x in EDGE) + "]+"
    bare = F.regexp_replace(flat, f"^{edge}|{edge}$", "")
    words = F.split(F.regexp_replace(bare, f"{SPACE}+", " "), " ", -1)
    # Plain words with single spaces are their own key, and nothing else is worked out for them.
    return F.when(~c.rlike(_NOT_PLAIN_CASED), F.lower(c)).when(~flat.rlike(_NOT_PLAIN), flat).otherwise(F.array_join(F.transform(words, fold_lookalikes), " "))


def fold_lookalikes(word: Column) -> Column:
    """Cyrillic look-alikes become Latin where a word mixes both scripts."""
    return F.when(word.rlike("[а-яё]") & word.rlike("[a-z]"), F.translate(word, *HOMOGLYPHS)).otherwise(word)


def slug(c: Column) -> Column:
    """Lower-case Latin letters and digits, other runs as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def compact(c: Column) -> Column:
    """Only Latin letters and digits, lower case: the form in which alloy names are compared."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def question_form(c: Column) -> Column:
    """Lower case, ё folded, hyphens taken out."""
    return F.translate(F.lower(c), "ё-", "е")


def stem(word: Column) -> Column:
    """A word without the longest Russian ending that leaves five letters; ё folded. Numbers and short words stay."""
    # The shortest start of five letters or more leaves the longest ending.
    return F.regexp_replace(F.translate(F.lower(word), "ё", "е"), f"^(.{{5,}}?)(?:{'|'.join(RU_ENDINGS)})$", "$1")


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9A-Za-zА-Яа-яЁё]{2,}"), F.lit(0))


def tokens(c: Column) -> Column:
    """Stemmed words and numbers of two characters or more, without stop words, repeats kept."""
    return F.filter(F.transform(raw_tokens(c), stem), lambda t: ~t.isin(*RU_STOP_WORDS))


def content_tokens(c: Column) -> Column:
    """Distinct words of five letters or more of a text in question form."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-zа-я]{5,}"), F.lit(0)))


def prefixes(c: Column) -> Column:
    """The first five letters of each word of four letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(question_form(c), F.lit("[a-zа-я]{4,}"), F.lit(0)), lambda t: F.substring(t, 1, 5)))


def labelled(headers: Column, values: Column) -> Column:
    """`header: value` of the cells that have both, joined by ` | `."""
    cells = F.zip_with(headers, values, lambda h, v: F.struct(F.trim(h).alias("h"), F.trim(v).alias("v")))
    full = F.filter(cells, lambda x: (F.coalesce(x["h"], F.lit("")) != "") & (F.coalesce(x["v"], F.lit("")) != ""))
    return F.array_join(F.transform(full, lambda x: F.concat(x["h"], F.lit(": "), x["v"])), " | ")


def unlabelled(c: Column) -> Column:
    """The (header, value) pairs of a labelled text; segments without a colon are none."""
    pairs = F.filter(F.split(c, r" \| "), lambda s: s.contains(":"))
    return F.transform(pairs, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("header"), F.trim(F.substring(s, F.instr(s, ":") + F.lit(1), F.length(s))).alias("value")))


def geography(c: Column, ru_places: tuple[str, ...] = RU_PLACES, foreign_places: tuple[str, ...] = FOREIGN_PLACES) -> Column:
    """ru, foreign, mixed or null: named places decide, else the script of more than 40 letters."""
    low = F.lower(c)
    ru, foreign = (any_of([low.contains(p) for p in places]) for places in (ru_places, foreign_places))
    # Letters are counted as what is lost without them.
    cyrillic, latin = (F.length(low) - F.length(F.translate(low, letters, "")) for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "abcdefghijklmnopqrstuvwxyz"))
    script = F.when(cyrillic + latin <= 40, None).when(cyrillic >= latin, "ru").otherwise("foreign")
    return F.when(ru & foreign, "mixed").when(ru, "ru").when(foreign, "foreign").otherwise(script)


def label_or_fail(c: Column, default: str = "internal") -> Column:
    """A valid label in lower case; null becomes the default, and any other value fails the query."""
    label = F.lower(F.trim(F.coalesce(c, F.lit(default))))
    return F.when(label.isin(*LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unknown security label: "), label)))


# Fixed values of author lines.
AFFILIATION = (
    "@|e-?mail|удк|doi|орцид|orcid|универс|институт|лаборатор|нии([^а-яёa-z0-9_]|$)|universit|institute|laborator|"
    r"канд\.|д-р|аспирант|инженер|сотрудник|директор|researcher|engineer|professor|профессор"
)
NOT_INITIALS = ("po", "us", "uk", "eu", "un", "eg", "ie", "ps", "nb", "vs")
AUTHORS = (
    r"(?<![\p{L}\p{N}_])([А-ЯЁ][а-яё]{2,20}\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.)",
    r"(?<![\p{L}\p{N}_])([А-ЯЁ]\.\s?[А-ЯЁ]\.\s?[А-ЯЁ][а-яё]{2,20})(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])([A-Z]\.\s?(?:[A-Z]\.\s?)?[A-Z][a-z]{2,20})(?![\p{L}\p{N}_])",
)


def authors(head: Column, most: int = 12) -> Column:
    """Names with initials in the head of a document that shows an affiliation, each once, the first `most`."""
    found = F.concat(*(F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in AUTHORS))
    names = F.transform(found, lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    initials = lambda n: F.lower(F.array_join(F.regexp_extract_all(n, F.lit(r"([A-Za-zА-ЯЁа-яё])\."), F.lit(1)), ""))
    good = F.array_distinct(F.filter(names, lambda n: ~initials(n).isin(*NOT_INITIALS)))
    return F.when(F.lower(head).rlike(AFFILIATION), F.slice(good, 1, most)).otherwise(F.array().cast("array<string>"))


def mention_stem(alias_key: Column) -> Column:
    """What every text that mention_pattern finds an alias in holds: the alias, without the letter that an ending may replace."""
    return F.when(~alias_key.rlike("[0-9a-z]") & (F.length(alias_key) > 4), F.substring(alias_key, F.lit(1), F.length(alias_key) - 1)).otherwise(alias_key)


def mention_pattern(alias_key: Column) -> Column:
    """The pattern that finds an alias in a canonical text, with room for an ending if it is a Cyrillic word."""
    quoted = F.regexp_replace(alias_key, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    stemmed = F.regexp_replace(F.substring(alias_key, F.lit(1), F.length(alias_key) - 1), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    word = r"[\p{L}\p{N}_]"
    body = F.when(alias_key.rlike("[0-9a-z]"), quoted).when(F.length(alias_key) > 4, F.concat(stemmed, F.lit(word + "{0,3}"))).otherwise(F.concat(quoted, F.lit(word + "{0,2}")))
    return F.concat(F.lit(f"(?<!{word})"), body, F.lit(f"(?!{word})"))
