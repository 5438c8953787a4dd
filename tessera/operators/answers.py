"""Answers: the packet a model is shown, the gate its sentences pass, and what is kept of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import verify

# What a model is shown and may say.
MOST_SPANS, MOST_CHARS, MOST_ROWS, MOST_SENTENCES = 12, 320, 10, 6


def packet(spans: DataFrame, order: Column) -> DataFrame:
    """The text of each question's first spans (question_id, span_id, visible_text, source_label), each cut to MOST_CHARS."""
    w = Window.partitionBy("question_id").orderBy(order, "span_id")
    head = spans.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= MOST_SPANS)
    line = F.concat(F.lit("["), F.col("span_id").cast("string"), F.lit("] "), F.when(F.col("source_label").isNotNull(), F.concat("source_label", F.lit(": "))).otherwise(""), F.substring("visible_text", 1, MOST_CHARS))
    return head.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("packet"))


def gate(sentences: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences of models (question_id, sentence_id, sentence, span_ids) that may stay, MOST_SENTENCES a question, and the others with a reason.

    A sentence must cite, only spans of its question, have its numbers from them and not turn what they say.
    """
    cites = sentences.select("question_id", "sentence_id", F.explode("span_ids").alias("span_id")).join(spans.select("question_id", "span_id", "visible_text"), ["question_id", "span_id"], "left")
    known = cites.groupBy("question_id", "sentence_id").agg(F.collect_list("visible_text").alias("cited"), F.count_if(F.col("visible_text").isNull()).alias("unknown"))
    rows = sentences.join(known, ["question_id", "sentence_id"], "left")
    reason = (
        F.when(F.coalesce(F.size("span_ids"), F.lit(0)) <= 0, "no_citation").when(F.col("unknown") > 0, "unknown_span")
        .when(~verify.numbers_supported(F.col("sentence"), F.col("cited")), "numbers").when(verify.contradicts(F.col("sentence"), F.col("cited")), "contradiction")
    )
    marked = rows.withColumn("reason", reason)
    w = Window.partitionBy("question_id").orderBy("sentence_id")
    good = marked.filter("reason is null").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= MOST_SENTENCES)
    return good.select(*sentences.columns), marked.filter("reason is not null").select(*sentences.columns, "reason")


def composed(model: tuple[DataFrame, DataFrame], fallback: DataFrame) -> DataFrame:
    """The model's sentences of the questions for which none was dropped, the assembled ones of the others; mode tells which."""
    good, dropped = model
    sound = good.join(dropped.select("question_id").distinct(), "question_id", "left_anti")
    rest = fallback.join(sound.select("question_id").distinct(), "question_id", "left_anti")
    return sound.withColumn("mode", F.lit("llm")).unionByName(rest.select(*sound.columns).withColumn("mode", F.lit("deterministic")))


def citation_numbers(sentences: DataFrame) -> DataFrame:
    """The number of each cited span of an answer, from 1 in the order of first mention."""
    each = sentences.select("question_id", "sentence_id", F.posexplode("span_ids").alias("i", "span_id"))
    first = each.groupBy("question_id", "span_id").agg(F.min(F.struct("sentence_id", "i")).alias("at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "span_id"))).drop("at")


def source_label(title: Column, year: Column, geography: Column) -> Column:
    """A source's title, year and geography, as far as they are known."""
    return F.nullif(F.concat_ws(", ", F.nullif(F.substring(title, 1, 80), F.lit("")), year.cast("string"), geography), F.lit(""))


def relevant_gaps(gaps: DataFrame, names: Column, question: str, all_of_them: bool) -> DataFrame:
    """Gaps whose names share the first five letters of a word with the question; all where it asks for gaps."""
    words = F.lit(question)
    return gaps if all_of_them else gaps.filter(F.arrays_overlap(T.prefixes(names), T.prefixes(words)))


def relevant_conflicts(conflicts: DataFrame, selected: DataFrame, all_of_them: bool) -> DataFrame:
    """Conflicts that share a material or an experiment with the selected rows; all where the question asks for conflicts."""
    if all_of_them:
        return conflicts
    marked = conflicts
    for i, (own, wanted) in enumerate((("material_id", "material_id"), ("a.experiment_id", "experiment_id"), ("b.experiment_id", "experiment_id"))):
        known = selected.select(F.col(wanted).alias(f"__key{i}")).distinct()
        marked = marked.join(known, F.col(own) == F.col(f"__key{i}"), "left")
    # Conflicts are made once, and what is chosen is few.
    return marked.filter("__key0 is not null or __key1 is not null or __key2 is not null").select(*conflicts.columns).distinct()
