"""Conflicts between experiments, coverage gaps and verification of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, verify
from tessera.lineage import cut

# Fixed value: a relative difference above it is a disagreement.
DISAGREE = 0.15
MOST_ENTRIES = 100_000  # rows of a dictionary sent to every task


def conflict_type(a: str, b: str) -> Column:
    """The conflict of two experiments of one group, in order of weight; null if they agree. a, b: struct columns."""
    at = lambda s, f: F.col(f"{s}.{f}")
    ways = ("increase", "decrease")
    opposite = at(a, "direction").isin(*ways) & at(b, "direction").isin(*ways) & (at(a, "direction") != at(b, "direction"))
    named = (F.coalesce(at(a, "method"), F.lit("")) != "") & (F.coalesce(at(b, "method"), F.lit("")) != "")
    methods = named & (at(a, "method") != at(b, "method"))
    far = named & (at(a, "unit") == at(b, "unit")) & (numbers.relative_delta(at(a, "value"), at(b, "value")) > DISAGREE)
    return F.when(opposite, "contradictory_direction").when(methods, "method_mismatch").when(far, "numeric_disagreement")


def conflicts(experiments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs of experiments of one group that conflict, the one of smaller order first, and their type.

    experiments needs the keys, order (unique), experiment_id, source_id, direction, method, value, unit; two rows of one experiment and
    source don't conflict. Only conflicting pairs are made: those of opposite directions and those of unlike methods by joins on what they
    differ in, those of unlike values by a sweep. Rows of one method and unit are sorted by value; the partners of a row that are too far
    below it are the first so many, and it meets them by their rank. A group whose rows agree makes no pairs.
    """
    x = F.struct(order, "experiment_id", "source_id", "direction", "method", F.col("value").cast("double").alias("value"), "unit")
    # A row that is alone in its group has no partner, so it goes no further.
    met = experiments.select(*keys, x.alias("__x")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")
    rows = cut(met.withColumn("__way", F.when(F.col("__x.direction").isin("increase", "decrease"), F.col("__x.direction")).otherwise("")))  # read by all three ways
    side = lambda df, name, *more: df.select(*keys, *more, F.col("__x").alias(name))
    opposite = side(rows.filter("__way = 'increase'"), "__p").join(side(rows.filter("__way = 'decrease'"), "__q"), keys)

    named = rows.filter("coalesce(__x.method, '') <> ''").withColumn("__method", F.col("__x.method"))
    others = named.select(*keys, F.col("__method").alias("__other"), F.col("__way").alias("__other_way")).distinct()
    aims = named.join(others, keys).filter("__method < __other and not (__way <> '' and __other_way <> '' and __way <> __other_way)")
    unlike = side(aims, "__p", "__other", "__other_way").join(side(named, "__q", F.col("__method").alias("__other"), F.col("__way").alias("__other_way")), [*keys, "__other", "__other_way"])

    alike = [*keys, "__method", "__unit"]
    values = named.withColumn("__unit", F.col("__x.unit")).filter("__unit is not null and __x.value is not null")
    value = F.col("__x.value")
    # Slightly more than what is too far below a value; the exact test follows.
    limit = F.when(value > 0, value * (1 - DISAGREE)).otherwise(value / (1 - DISAGREE)) + F.abs(value) * 1e-9
    mark = lambda at, row: F.struct(at.alias("__at"), F.lit(row).alias("__row"))
    # Both marks of a row are made after it has moved.
    marks = values.repartition(*alike).select(*alike, "__x", F.inline(F.array(mark(value, 1), mark(limit, 0))))
    upward = Window.partitionBy(*alike).orderBy("__at", "__row", f"__x.{order}").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = marks.withColumn("__rank", F.sum("__row").over(upward).cast("int"))
    below = swept.filter("__row = 0 and __rank > 0").select(*alike, F.col("__x").alias("__q"), F.explode(F.sequence(F.lit(1), F.col("__rank"))).alias("__rank"))
    far = below.join(swept.filter("__row = 1").select(*alike, "__rank", F.col("__x").alias("__p")), [*alike, "__rank"])

    made = ((opposite, "contradictory_direction"), (unlike, "method_mismatch"), (far, "numeric_disagreement"))
    pairs = reduce(DataFrame.unionByName, [df.select(*keys, "__p", "__q", F.lit(kind).alias("__kind")) for df, kind in made])
    first = F.col(f"__p.{order}") < F.col(f"__q.{order}")
    pairs = pairs.select(*keys, F.when(first, F.col("__p")).otherwise(F.col("__q")).alias("a"), F.when(first, F.col("__q")).otherwise(F.col("__p")).alias("b"), "__kind")
    pairs = pairs.filter(f"a.{order} < b.{order} and not (a.experiment_id = b.experiment_id and a.source_id <=> b.source_id)")
    # The sweep also meets pairs of opposite directions, and some within its slack.
    return pairs.withColumn("type", conflict_type("a", "b")).filter("type = __kind").drop("__kind")


def experiments(measurements: DataFrame, effects: DataFrame) -> DataFrame:
    """Measurements with the effects of the same experiment, property and source; evidence_ids is the effect's evidence as it stands."""
    keys = ["experiment_id", "property_id", "source_id"]
    return measurements.drop("supporting_span_ids").join(effects.withColumnRenamed("supporting_span_ids", "evidence_ids"), keys)


def gap_counts(matrix: DataFrame, *by: str) -> DataFrame:
    """Covered cells and gaps of a matrix, for each value of some of its columns."""
    return matrix.groupBy(*by).agg(F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("gaps"))


def coverage(materials: DataFrame, regimes: DataFrame, properties: DataFrame, experiments: DataFrame) -> DataFrame:
    """Covered cells and gaps of each material (material_id, cells, covered, gaps), without making the cells.

    A cell is a number from the places of its regime and property in their dictionaries; a material's covered cells are bitmaps, one for each
    32 768 numbers, and their counts are counts of bits. The two dictionaries are curated and small; of experiments only cells of the dictionaries
    count. `cells` holds the bitmaps (bucket, bits), which can be united with those of other experiments.
    """
    numbered = lambda df, name, place: df.select(name).distinct().withColumn(place, F.row_number().over(Window.orderBy(name)).cast("bigint") - 1)
    rows, columns = numbered(regimes, "regime_type", "__r"), numbered(properties, "property_id", "__p")
    wide = columns.count()
    each = rows.count() * wide
    sent = [F.broadcast(side) if side.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES else side for side in (rows, columns)]
    cell = F.col("__r") * wide + F.col("__p")
    done = experiments.join(sent[0], "regime_type").join(sent[1], "property_id").select("material_id", cell.alias("cell"))
    bits = done.groupBy("material_id", F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    counted = bits.groupBy("material_id").agg(F.sum(F.bitmap_count("bits")).alias("covered"), F.collect_list(F.struct("bucket", "bits")).alias("cells"))
    covered = F.coalesce("covered", F.lit(0).cast("bigint"))
    return materials.select("material_id").distinct().join(counted, "material_id", "left").select("material_id", "cells", covered.alias("covered"), (F.lit(each) - covered).alias("gaps"))


def gap_matrix(materials: DataFrame, regimes: DataFrame, properties: DataFrame, experiments: DataFrame) -> DataFrame:
    """Every cell of the three dictionaries with the experiments that cover it.

    The dictionaries are curated; they are crossed by definition, the two shorter ones in every task if their size allows.
    Experiments are grouped first.
    """
    sent = [F.broadcast(side) if side.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES else side for side in (regimes, properties)]
    cells = materials.crossJoin(sent[0]).crossJoin(sent[1])
    done = experiments.groupBy("material_id", "regime_type", "property_id").agg(F.count(F.lit(1)).alias("experiments"))
    found = cells.join(done, ["material_id", "regime_type", "property_id"], "left")
    return found.withColumn("experiments", F.coalesce("experiments", F.lit(0))).withColumn("covered", F.col("experiments") > 0)


def verify_answers(sentences: DataFrame, spans: DataFrame, allowed: list[str]) -> DataFrame:
    """Counters of each answer (answer_id, sentence_id, sentence, span_ids, fact_numbers).

    A sentence without citations is unsupported; citations of unknown or forbidden spans leak; numbers and
    meaning are checked against the known cited texts.
    """
    cites = sentences.select("answer_id", "sentence_id", F.explode_outer("span_ids").alias("span_id"))
    known = cites.join(spans.select("span_id", "visible_text", "security_label"), "span_id", "left")
    leak = F.col("span_id").isNotNull() & ~F.coalesce(F.col("security_label").isin(*allowed), F.lit(False))
    cited = known.groupBy("answer_id", "sentence_id").agg(F.collect_list("visible_text").alias("cited"), F.count_if(leak).alias("leaks"))
    rows = sentences.join(cited, ["answer_id", "sentence_id"])
    texts, has = F.col("cited"), F.size("cited") > 0
    extra = F.coalesce(F.col("fact_numbers"), F.lit(""))
    no_numbers = has & ~verify.numbers_supported(F.col("sentence"), F.concat(texts, F.array(extra)))
    no_meaning = has & ~verify.supported(F.col("sentence"), texts)
    uncited = F.coalesce(F.size("span_ids"), F.lit(0)) <= 0
    return rows.groupBy("answer_id").agg(
        (1 - F.count_if(uncited) / F.count(F.lit(1))).alias("citation_coverage"), F.count_if(uncited).alias("unsupported_claims"), F.sum("leaks").alias("label_leaks"),
        F.count_if(no_numbers).alias("numeric_mismatches"), F.count_if(no_meaning).alias("semantic_unsupported"),
    )


def confidence(selected: Column, matched: Column, evidence: Column) -> Column:
    """high for structured matches of what was asked for, medium for other grounded answers, low for none."""
    return F.when(selected & matched, "high").when(selected | evidence, "medium").otherwise("low")
