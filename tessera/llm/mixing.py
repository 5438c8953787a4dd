"""Mixing sources to target weights by iterative proportional fitting.

Token counts by source, language and topic are raked until each marginal has its target
share. A cell's weight over its tokens says how much more or less of it is wanted; the
sampling probabilities follow these ratios, capped at 1 and calibrated so that the
expected tokens meet the budget. A document is kept if a hash of its id falls below its cell's
probability, so a run can be repeated and split at will.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import cluster

ROUNDS = 100
CLOSE = 1e-9  # relative change of the weights at which raking stops
MOST_CELLS = 200_000  # raked on the driver; more are raked as a table
MOST_BROADCAST = 500_000  # ids with their values sent to every task, some 40 MB; more are joined by a shuffle
_NULL = "\ue000"  # a null value of a dimension is a value of its own, named by a private character


def tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def tempered(shares: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to a power of the given ones; below 1 it lifts small ones."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(counts: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells whose marginals have the target shares of the total. codes: each cell's value of each dimension."""
    w, total = counts.astype(np.float64), float(counts.sum())
    for _ in range(rounds):
        before = w.copy()
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, len(target))
            reach = np.where(have > 0, target, 0.0)  # values without tokens give their share to the others
            w = w * np.where(have > 0, reach / max(reach.sum(), 1e-300) * total / np.where(have > 0, have, 1), 0)[code]
        if np.abs(w - before).max(initial=0) <= CLOSE * max(total, 1):
            break
    return w


def _scale(at_most: float, expected) -> float:
    """The factor whose capped probabilities give that many expected tokens; expected(factor) grows with it."""
    high = 1.0
    while expected(high) < at_most and high < 2.0**60:
        high *= 2
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < at_most else (low, middle)
    return high


def _on_driver(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float] | float], share: float) -> DataFrame:
    rows = cells.orderBy(*dims).collect()
    counts = np.array([r.tokens for r in rows], np.float64)
    codes, wanted = [], []
    for d in dims:
        values, code = np.unique(np.array([getattr(r, d) for r in rows], object).astype(str), return_inverse=True)
        have = dict(zip(values.tolist(), np.bincount(code, counts).tolist(), strict=True))
        goal = targets[d]
        goal = tempered(have, goal) if isinstance(goal, (int, float)) else goal
        codes.append(code)
        wanted.append(np.array([goal.get(v, 0.0) for v in values.tolist()]))
    w = rake(counts, codes, wanted)
    ratio = np.divide(w, counts, out=np.ones_like(w), where=counts > 0)
    c = _scale(share * counts.sum(), lambda f: float((np.minimum(1, f * ratio) * counts).sum())) if counts.sum() else 1.0
    frame = [(*(getattr(r, d) for d in dims), float(x), float(min(1.0, c * x))) for r, x in zip(rows, ratio, strict=True)]
    return cells.sparkSession.createDataFrame(frame, ", ".join([*(f"`{d}` string" for d in dims), "weight double", "probability double"]))


def _as_table(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float] | float], share: float) -> DataFrame:
    """The same for any number of cells and values."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d in dims:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("t")).filter("t > 0")
        if isinstance(targets[d], (int, float)):
            goals[d] = cluster.cut(have.select(d, F.pow("t", F.lit(float(targets[d]))).alias("goal")))
        else:
            goals[d] = cluster.cut(have.join(spark.createDataFrame(list(targets[d].items()), f"`{d}` string, goal double"), d, "left").select(d, F.coalesce("goal", F.lit(0.0)).alias("goal")))
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(ROUNDS):
        before = w
        for d in dims:
            have = w.groupBy(d).agg(F.sum("w").alias("have")).filter("have > 0").join(goals[d], d)
            sum_ = have.agg(F.sum("goal").alias("goals"))
            factor = have.crossJoin(F.broadcast(sum_)).select(d, (F.col("goal") / F.col("goals") * F.lit(float(total)) / F.col("have")).alias("f"))  # sum_ is one row
            w = w.join(factor, d, "left").withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
        w = cluster.cut(w)
        moved = w.join(before.select(*dims, F.col("w").alias("old")), list(dims)).agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0] or 0
        if moved <= CLOSE * max(total, 1):
            break
    cells = cluster.cut(w.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)))
    c = _scale(share * total, lambda f: float(cells.agg(F.sum(F.least(F.lit(1.0), F.lit(f) * F.col("weight")) * F.col("tokens"))).first()[0])) if total else 1.0
    return cells.select(*dims, "weight", F.least(F.lit(1.0), F.lit(c) * F.col("weight")).alias("probability"))


def sample(docs: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float] | float], share: float, seed: int = 0, most_cells: int = MOST_CELLS, also: DataFrame | None = None) -> DataFrame:
    """Every document with its chance, and whether it is sampled.

    docs needs doc_id, text and the columns dims; of these, also (doc_id, a row an id, and one or
    more of dims) gives those that it has, null for ids that it lacks, whatever docs holds under their
    names. targets has for each of dims the wanted share of
    each value, or a power for shares in proportion to that power of the present ones;
    values without a target get nothing. share is the share of all tokens to keep. Returns a row
    a row: doc_id, the dims as strings, weight (wanted tokens over present ones of the cell),
    probability, selected, and row, a struct of all columns of docs. A null in
    dims is a value of its own, named U+E000 in targets and null in the result. Texts without words have no tokens and their cell's
    chance. Rows that repeat a doc_id are kept or not together, and so are those with a null one.
    """
    given = [d for d in dims if also is not None and d in also.columns]
    named = lambda d: F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(_NULL)).alias(d)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(named(d) for d in dims if d not in given), tokens(F.col("text")).alias("tokens"), row)
    if given:
        lookup = also.select(F.col("doc_id").cast("bigint").alias("also_id"), *(F.col(f"`{d}`").cast("string").alias(d) for d in given)).filter("also_id is not null")
        if lookup.count() <= MOST_BROADCAST:
            lookup = F.broadcast(lookup)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(lookup, F.col("doc_id") == F.col("also_id"), "left").drop("also_id").withColumns({d: named(d) for d in given}) if given else df

    # Texts are no part of this join: their tokens are counted before it.
    cells = cluster.cut(placed(keyed.drop("row")).groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    small = cells.limit(most_cells + 1).count() <= most_cells
    chance = _on_driver(cells, dims, targets, share) if small else cluster.cut(_as_table(cells, dims, targets, share))
    joined = placed(keyed.drop("tokens")).join(F.broadcast(chance) if small else chance, list(dims))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    shown = (F.when(F.col(d) == _NULL, None).otherwise(F.col(d)).alias(d) for d in dims)
    return joined.select("doc_id", *shown, "weight", "probability", (unit < F.col("probability")).alias("selected"), "row")
