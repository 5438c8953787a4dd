"""A stored vector index: inverted lists of int8 codes, probed by cell and rescored exactly.

Unit vectors are dealt to the cells of a k-means over a bounded sample; every vector is indexed. A row holds its code, each
component as a whole number scaled by the .99 quantile of its dimension, and the vector itself. A search reads only the buckets of
the cells that its queries probe, compares codes, and looks at the vectors of the survivors only. A search that must be exact goes on with
every cell that may still hold a better one: a cell's vectors are no further from its centre than its radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.retrieval import CELLS, MOST_VECTORS, ranked
from tessera.store import BUCKETS, Store, Table

SAMPLE = 50_000  # vectors that the cells are drawn from, the first by a hash of their id
MOST_CELLS = 16_384
ROUNDS = 8
POOL = 10  # survivors of the codes a result
RECALL, TRIALS, NEIGHBOURS = 0.95, 200, 10  # probes are drawn so that so many neighbours of the trials lie in probed cells
EXACT = 1e-9  # slack of angles, for rounding

_LISTS = "cell int, unit_id string, source_id string, security_label string, code binary, vec array<double>"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _dealt(centres: np.ndarray, bounds: np.ndarray):
    """Cell, cosine to its centre, and code of unit vectors."""

    step = max(1, CELLS // len(centres))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for lo in range(0, whole.num_rows, step):
                frame = whole.slice(lo, step)
                x = _matrix(frame.column("vec"), centres.shape[1])
                near = x @ centres.T
                cell = near.argmax(axis=1)
                code = np.clip(np.rint(x / bounds * 127), -127, 127).astype(np.int8)
                columns = [pa.array(cell, pa.int32()), *(frame.column(c) for c in ("unit_id", "source_id", "security_label")), pa.array([r.tobytes() for r in code], pa.binary()), frame.column("vec"), pa.array(near[np.arange(len(x)), cell])]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "unit_id", "source_id", "security_label", "code", "vec", "near"])

    return run


def _scanned(asked, exact: bool, most: int):
    """The `most` best rows of a batch for each query that probes their cell. asked: a broadcast of (vectors, {cell: bits of the queries}).

    Queries go in parts, so that a part has about CELLS scores with the rows of a batch, whatever the numbers of both.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, probing = asked.value
        dims = vectors.shape[1]
        floor = np.full(len(vectors), -np.inf)  # what each query's `most`-th row so far has
        for frame in frames:
            x = _matrix(frame.column("vec"), dims) if exact else np.frombuffer(b"".join(frame.column("code").to_pylist()), np.int8).reshape(-1, dims)
            cells = frame.column("cell").to_numpy()
            places = [(probing[int(c)], np.flatnonzero(cells == c)) for c in np.unique(cells) if int(c) in probing]
            step = max(1, CELLS // 8 // max(1, len(x))) * 8
            for lo in range(0, len(vectors), step):
                some = vectors[lo : lo + step]
                found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                for bits, own in places:
                    queries = np.flatnonzero(np.unpackbits(bits[lo // 8 : (lo + step) // 8], count=len(some)))
                    if not len(queries):
                        continue
                    score = x[own].astype(vectors.dtype) @ some[queries].T
                    for j, q in enumerate((queries + lo).tolist()):
                        found.setdefault(q, []).append((own, score[:, j]))
                out_q, out_row, out_s = [], [], []
                for q, parts in found.items():
                    own, score = (np.concatenate(p) for p in zip(*parts, strict=True))
                    if len(own) > most:
                        # Scores count to 12 places, and sums of the same numbers may differ in the last digits.
                        floor[q] = max(floor[q], np.partition(score, len(score) - most)[len(score) - most] - EXACT)
                    keep = score >= floor[q]  # ties stay, so that ids can order them
                    out_q.append(np.full(keep.sum(), q))
                    out_row.append(own[keep])
                    out_s.append(score[keep])
                if out_q:
                    rows = pa.array(np.concatenate(out_row), pa.int64())
                    q, s = np.concatenate(out_q), np.concatenate(out_s)
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), frame.column("cell").take(rows), frame.column("unit_id").take(rows), pa.array(s.astype(np.float64))], ["q", "cell", "unit_id", "score"])

    return run


class VectorIndex:
    """An index in a folder. Units are unit_id (string), vec, and source_id and security_label where they have them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.store = Store(spark, root, {
            "lists": Table(_LISTS, "cell", buckets), "units": Table("unit_id string, cell int", "unit_id", buckets),
            "cells": Table("cell int, centre array<double>, near double", "cell", 1), "bounds": Table("dim int, bound double", "dim", 1), "settings": Table("name string, value double", "name", 1),
        })

    # --- writes -------------------------------------------------------------------------------------------------

    def _clean(self, units: DataFrame, dims: int | None = None) -> DataFrame:
        extra = [F.col(c).cast("string").alias(c) if c in units.columns else F.lit(None).cast("string").alias(c) for c in ("source_id", "security_label")]
        own = units.select(F.col("unit_id").cast("string").alias("unit_id"), *extra, V.unit(F.col("vec").cast("array<double>")).alias("vec")).filter("vec is not null and unit_id is not null")
        return own if dims is None else own.filter(F.size("vec") == dims)

    def build(self, units: DataFrame, cells: int | None = None) -> None:
        """Draws cells from a sample and indexes every unit with a direction; unlike numbers of dimensions are an error."""
        own = self._clean(units)
        shape = own.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
        if shape.least != shape.most:
            raise ValueError(f"vectors have {shape.least} to {shape.most} dimensions")
        if not shape.n:
            self.store.replace({name: self.store.table(name).limit(0) for name in self.store.tables})
            return
        k = cells or max(1, min(MOST_CELLS, int(shape.n**0.5)))
        sample = own.orderBy(F.xxhash64("unit_id"), "unit_id").limit(SAMPLE).repartition(self.spark.sparkContext.defaultParallelism).select(array_to_vector("vec").alias("features")).persist()
        centres = np.array(KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=7).fit(sample).clusterCenters()) if k > 1 else np.array([own.select("vec").first().vec])
        sample.unpersist()
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        quantile = own.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.percentile_approx(F.abs("x"), 0.99, 1000).alias("bound"))
        bounds = {r.dim: r.bound for r in quantile.collect()}  # a row a dimension
        bound = np.array([bounds[i] or 1.0 for i in range(shape.most)])
        dealt = own.mapInArrow(_dealt(centres, bound), f"{_LISTS}, near double").persist()
        near = {r.cell: r.near for r in dealt.groupBy("cell").agg(F.min("near").alias("near")).collect()}  # a row a cell
        frame = self.spark.createDataFrame
        self.store.replace({
            "lists": dealt.drop("near"), "units": dealt.select("unit_id", "cell"),
            "cells": frame([(i, c.tolist(), float(near.get(i, 1.0))) for i, c in enumerate(centres)], self.store.tables["cells"].schema), "bounds": frame([(i, float(b)) for i, b in enumerate(bound)], self.store.tables["bounds"].schema),
        })
        dealt.unpersist()
        trials = own.orderBy(F.xxhash64("unit_id", F.lit(1)), "unit_id").limit(TRIALS).select(F.col("unit_id").alias("query_id"), "vec")
        probes = self._calibrated(trials, centres)
        self.store.replace({"settings": frame([("probes", float(probes))], self.store.tables["settings"].schema)})

    def _calibrated(self, trials: DataFrame, centres: np.ndarray) -> int:
        """The least number of probes that reach RECALL of the trials' true neighbours."""
        true = self.search(trials, NEIGHBOURS + 1, probes=1, exact=True).filter("query_id <> unit_id")
        found = true.join(self.store.table("units"), "unit_id").select("query_id", "cell").collect()
        place = {r.query_id: np.argsort(np.argsort(-(np.array(r.vec) @ centres.T), kind="stable")) for r in trials.collect()}
        ranks = sorted(int(place[r.query_id][r.cell]) + 1 for r in found)
        return ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))] if ranks else 1

    def _probes(self, probes: int | None) -> int:
        if probes is not None:
            return probes
        known = [r.value for r in self.store.table("settings").filter("name = 'probes'").collect()]
        return int(known[0]) if known else 1

    def _model(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, cosine of each cell's furthest vector to its centre, and bounds of the codes."""
        cells = sorted(self.store.table("cells").collect(), key=lambda r: r.cell)
        bounds = sorted(self.store.table("bounds").collect(), key=lambda r: r.dim)
        return np.array([r.centre for r in cells]), np.array([r.near for r in cells]), np.array([r.bound for r in bounds])

    def upsert(self, units: DataFrame, gone: DataFrame | None = None) -> None:
        """Units come or take the place of those with their ids, and units of gone (unit_id) go; only buckets of cells that they lie in or lay in are written."""
        base, _ = self.store.state()
        centres, near, bound = self._model()
        if not len(centres):
            self.build(units)
            return
        dealt = self._clean(units, centres.shape[1]).dropDuplicates(["unit_id"]).mapInArrow(_dealt(centres, bound), f"{_LISTS}, near double").persist()
        ids = dealt.select("unit_id")
        ids = ids.unionByName(gone.select(F.col("unit_id").cast("string").alias("unit_id"))).distinct() if gone is not None else ids
        # Where they lay before: a tombstone in the cell's bucket.
        old = self.store.table("units").join(ids, "unit_id", "left_semi")
        lists = dealt.drop("near").unionByName(old.select("cell", "unit_id"), allowMissingColumns=True)
        places = dealt.select("unit_id", "cell").unionByName(ids.join(dealt.select("unit_id"), "unit_id", "left_anti").select("unit_id", F.lit(None).cast("int").alias("cell")))
        furthest = {r.cell: r.near for r in dealt.groupBy("cell").agg(F.min("near").alias("near")).collect()}
        wider = [(i, centres[i].tolist(), float(v)) for i, v in furthest.items() if v < near[i]]
        swap = lambda alive: lambda was, new: was.join(new.select("unit_id").distinct(), "unit_id", "left_anti").select(*was.columns).unionByName(new.filter(alive).select(*was.columns))
        changes = {"lists": (lists, swap("vec is not null")), "units": (places, swap("cell is not null"))}
        if wider:
            changes["cells"] = (self.spark.createDataFrame(wider, self.store.tables["cells"].schema), lambda was, new: was.join(new.select("cell"), "cell", "left_anti").select(*was.columns).unionByName(new))
        self.store.commit(changes, base)
        dealt.unpersist()

    # --- reads --------------------------------------------------------------------------------------------------

    def _probed(self, vectors: np.ndarray, wanted: np.ndarray, exact: bool, most: int, labels: list[str] | None) -> DataFrame:
        """(q, cell, unit_id, score) of the best rows of the wanted cells. wanted: queries x cells."""
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        probing = {c: np.packbits(wanted[:, c]) for c in cells}  # a bit a query
        rows = self.store.lookup("lists", cells)
        rows = rows if labels is None else rows.filter(F.col("security_label").isin(*labels))
        sent = self.spark.sparkContext.broadcast((vectors if exact else vectors.astype(np.float32), probing))
        return rows.select("cell", "unit_id", "vec" if exact else "code").mapInArrow(_scanned(sent, exact, most), "q int, cell int, unit_id string, score double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, labels: list[str] | None = None, most: int = MOST_VECTORS) -> DataFrame:
        """The k units of largest cosine for each query (query_id, vec; a stated set): query_id, unit_id, score, rank.

        Looks into the `probes` cells nearest to a query, or as many as the build found to be enough for RECALL; with exact, then into every cell that may hold one of the k. Queries without a
        direction or of other dimensions find nothing. Beyond `most`, queries go in blocks.
        """
        centres, near, bound = self._model()
        nothing = queries.select("query_id", F.lit("").alias("unit_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        if not len(centres):
            return nothing
        asked = queries.select("query_id", V.unit(F.col("vec").cast("array<double>")).alias("vec")).filter("vec is not null").filter(F.size("vec") == centres.shape[1])
        blocks = -(-asked.count() // most)
        found = [self._search(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), centres, near, bound, k, self._probes(probes), exact, labels) for b in range(blocks)]
        return reduce(DataFrame.unionAll, found) if found else nothing

    def _search(self, asked: DataFrame, centres, near, bound, k: int, probes: int, exact: bool, labels: list[str] | None) -> DataFrame:
        rows = asked.collect()  # at most `most`
        kind = asked.schema["query_id"].dataType.simpleString()
        names = self.spark.createDataFrame([(i, r.query_id, r.vec) for i, r in enumerate(rows)], f"q int, query_id {kind}, asked array<double>")
        vectors = np.array([r.vec for r in rows]).reshape(-1, centres.shape[1])
        to = vectors @ centres.T
        wanted = np.zeros(to.shape, bool)
        if len(rows):
            np.put_along_axis(wanted, np.argpartition(-to, min(probes, len(centres)) - 1, axis=1)[:, :probes], True, axis=1)
        best = lambda df, n, score: ranked(df.withColumn("score", F.round(score, 12)).withColumnRenamed("q", "query_id"), n).withColumnRenamed("query_id", "q")
        survivors = best(self._probed(vectors * bound / 127, wanted, False, POOL * k, labels), POOL * k, F.col("score")).select("q", "cell", "unit_id")
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        # At most POOL * k rows a query of a bounded block.
        met = self.store.lookup("lists", cells).select("cell", "unit_id", "vec").join(F.broadcast(survivors), ["cell", "unit_id"]).join(F.broadcast(names), "q")
        top = best(met.select("q", "cell", "unit_id", V.dot(F.col("asked"), F.col("vec")).alias("score")), k, F.col("score"))
        if exact and len(rows):
            least = np.full(len(rows), -1.0)
            for r in top.filter(F.col("rank") == k).select("q", "score").collect():
                least[r.q] = r.score
            angle = lambda c: np.arccos(np.clip(c, -1, 1))
            reach = angle(to) - angle(near)[None, :] <= angle(least)[:, None] + EXACT
            top = best(self._probed(vectors, reach, True, k, labels), k, F.col("score"))
        return top.join(F.broadcast(names.select("q", "query_id")), "q").select("query_id", "unit_id", "score", "rank")

    def compared(self, queries: DataFrame, probes: int | None = None) -> tuple[int, int]:
        """Pairs of a query and a unit that a search compares by code, and all such pairs."""
        centres, _, _ = self._model()
        probes = self._probes(probes)
        sizes = {r.cell: r["count"] for r in self.store.table("lists").groupBy("cell").count().collect()}
        vectors = np.array([r.vec for r in queries.select(V.unit(F.col("vec").cast("array<double>")).alias("vec")).filter("vec is not null").collect()])
        picked = np.argpartition(-(vectors @ centres.T), min(probes, len(centres)) - 1, axis=1)[:, :probes]
        return sum(sizes.get(int(c), 0) for c in picked.ravel()), len(vectors) * sum(sizes.values())
