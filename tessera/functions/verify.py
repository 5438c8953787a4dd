"""Whether a sentence is backed by the texts it cites, as Column expressions over arrays of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import numbers_in
from tessera.functions.text import any_of

# Fixed values.
NEGATIONS = ("не", "нет", "без", "ни", "нельзя", "no", "not", "never")
RISING = ("увелич", "повыш", "возраст", "нараст", "ускор")
FALLING = ("уменьш", "сниж", "сокращ", "замедл", "убыва")
COMMON = ("быть", "были", "было", "если", "также", "чтобы", "этот", "эта", "эти", "который", "которые", "when", "with", "that", "this", "from", "have", "were", "which")
COVERED = 0.6

_WORD = "[a-zа-яё]{4,}"


def _flat(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")


def numbers_supported(sentence: Column, cited: Column) -> Column:
    """Every number of the sentence stands in a cited text."""
    return F.size(F.array_except(numbers_in(sentence), F.flatten(F.transform(cited, numbers_in)))) == 0


def negated(c: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(_flat(c), F.lit("[a-zа-яё]+"), F.lit(0)), F.array(*map(F.lit, NEGATIONS)))


def _says(c: Column, stems: tuple[str, ...]) -> Column:
    words = F.regexp_extract_all(_flat(c), F.lit(_WORD), F.lit(0))
    return F.exists(words, lambda w: any_of([w.startswith(s) for s in stems]))


def contradicts(sentence: Column, cited: Column) -> Column:
    """The sentence negates, or turns the direction, where no cited text does."""
    new_no = negated(sentence) & ~F.exists(cited, negated)
    cited_says = lambda stems: F.exists(cited, lambda t: _says(t, stems))
    up, down = cited_says(RISING), cited_says(FALLING)
    return new_no | (_says(sentence, RISING) & ~up & down) | (_says(sentence, FALLING) & ~down & up)


def supported(sentence: Column, cited: Column) -> Column:
    """Most content words of the sentence begin like words of the cited texts, and it doesn't contradict them."""
    words = F.filter(F.regexp_extract_all(_flat(sentence), F.lit(_WORD), F.lit(0)), lambda w: ~w.isin(*COMMON))
    begins = F.flatten(F.transform(cited, lambda t: F.transform(F.regexp_extract_all(_flat(t), F.lit(_WORD), F.lit(0)), lambda w: F.substring(w, 1, 5))))
    covered = F.size(F.filter(words, lambda w: F.array_contains(begins, F.substring(w, 1, 5))))
    return (F.size(words) == 0) | ((covered >= COVERED * F.size(words)) & ~contradicts(sentence, cited))
