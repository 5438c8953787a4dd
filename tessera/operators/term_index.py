"""A stored inverted index: postings by term in blocks with their maxima, searched by BM25 without reading a text.

Postings of an upsert are added beside the older ones, in blocks dealt by a hash of the unit; a block keeps its largest
count and its shortest length, which bound what a unit in it can score. Units that change or go leave their old postings
behind, named as dead until `compact`. Document frequencies, the number of units and their length are sums of what each commit
added and took away, so they are always those of the units that are there; what a unit takes away is read from its postings.

A search is exact and stops early: the rare terms of a query give a score that its k-th best unit has at least. Terms that
together can't reach it make no candidates; of their postings only those of the others' candidates are moved, where these are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import K1, MOST_TERMS, B, ranked
from tessera.store import BUCKETS, Store, Table

BLOCK = 128  # postings of a block, on average
RARE = 0.02  # share of the units that a term of the first look may be in
SLACK = 1e-9
MOST_DEAD = 1_000_000  # dead units that are sent to every task; more are joined by a shuffle
MOST_SENT = 1_000_000  # terms of many blocks, and candidates, that are sent to every task; more are joined by a shuffle or not asked for first

_POSTINGS = "term string, version bigint, blocks int, block int, units array<struct<unit_id: string, tf: int, length: int>>, most int, least int"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bags(units: DataFrame) -> DataFrame:
    """Units (unit_id, text, more) with length, their distinct words in one string and how often each occurs, worked out in the row."""
    split = units.withColumn("__words", F.sort_array(words(F.col("text")))).drop("text").withColumn("length", F.size("__words"))
    new = lambda i: ~F.get("__words", i).eqNullSafe(F.get("__words", i - 1))
    begun = split.withColumn("__starts", F.when(F.col("length") > 0, F.filter(F.sequence(F.lit(0), F.col("length") - 1), new)).otherwise(F.array().cast("array<int>")))
    times = F.transform("__starts", lambda at, i: F.coalesce(F.get("__starts", i + 1), F.col("length")) - at)
    return begun.withColumn("terms", F.array_join(F.transform("__starts", lambda at: F.get("__words", at)), " ")).withColumn("tfs", times).drop("__words", "__starts")


class TermIndex:
    """An index in a folder. Units are unit_id (string) and text."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.store = Store(spark, root, {
            "postings": Table(_POSTINGS, "term", buckets), "terms": Table("term string, n bigint", "term", buckets),
            "units": Table("unit_id string, version bigint, text_hash string, length int", "unit_id", buckets),
            "dead": Table("unit_id string, version bigint", "unit_id", 1), "stats": Table("units bigint, length bigint", "units", 1),
        })

    # --- writes -------------------------------------------------------------------------------------------------

    def upsert(self, units: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Units come or take the place of those with their ids, and units of gone (unit_id) go. Units with the text that they had are passed over; of repeated ids the first text in order counts."""
        base, _ = self.store.state()
        version = base + 1
        known = self.store.table("units")
        if units is None:
            units = self.spark.createDataFrame([], "unit_id string, text string")
        own = units.select(F.col("unit_id").cast("string").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text")).filter("unit_id is not null").groupBy("unit_id").agg(F.min("text").alias("text"))
        # Known texts are met by the unit alone, where the texts lie already.
        seen = known.select("unit_id", F.col("text_hash").alias("seen_hash"))
        own = own.withColumn("text_hash", F.sha2("text", 256)).join(seen, "unit_id", "left").filter("seen_hash is null or seen_hash <> text_hash").drop("seen_hash")
        own = bags(own).persist()
        ids = own.select("unit_id")
        ids = ids.unionByName(gone.select(F.col("unit_id").cast("string").alias("unit_id"))).distinct() if gone is not None else ids
        old = known.join(ids, "unit_id", "left_semi").persist()

        counts = own.filter("length > 0").select("unit_id", "length", F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("term", "tf"))
        sized = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n")).persist()
        posted = self._posted(counts, sized, version)
        whole = lambda df, sign: df.agg(F.coalesce(F.sum(F.lit(sign)), F.lit(0)).cast("bigint").alias("units"), F.coalesce(F.sum(F.col("length") * sign), F.lit(0)).cast("bigint").alias("length"))
        stats = whole(own, 1).unionByName(whole(old, -1)).agg(F.sum("units").alias("units"), F.sum("length").alias("length"))
        now = own.select("unit_id", F.lit(version).alias("version"), "text_hash", "length")
        places = now.withColumn("gone", F.lit(False)).unionByName(ids.join(now.select("unit_id"), "unit_id", "left_anti").withColumn("gone", F.lit(True)), allowMissingColumns=True)

        def swapped(was: DataFrame, new: DataFrame) -> DataFrame:
            return was.join(new.select("unit_id"), "unit_id", "left_anti").select(*was.columns).unionByName(new.filter("not gone").select(*was.columns))

        added = sized.unionByName(self._lost(old)).groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0")
        self.store.commit({"postings": (posted, None), "terms": (added, None), "units": (places, swapped), "dead": (old.select("unit_id", "version"), None), "stats": (stats, None)}, base)
        for df in (own, old, sized):
            df.unpersist()

    def _lost(self, old: DataFrame) -> DataFrame:
        """What units (unit_id, version) take from the frequencies of their terms, as their postings tell; nothing is read where no unit goes."""
        few = old.limit(MOST_DEAD + 1).count()
        posted = self.store.table("postings").select("term", "version", F.explode("units.unit_id").alias("unit_id"))
        posted = posted.limit(0) if not few else posted.join(F.broadcast(old) if few <= MOST_DEAD else old, ["unit_id", "version"], "left_semi")
        return posted.groupBy("term").agg((-F.count(F.lit(1))).alias("n"))

    def _posted(self, counts: DataFrame, sized: DataFrame, version: int) -> DataFrame:
        """Blocks of counts (unit_id, term, tf, length). They move once, to where the store wants them; only terms of more than one block meet their number of blocks."""
        many = sized.filter(F.col("n") > BLOCK).select("term", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        few = many.limit(MOST_SENT + 1).count() <= MOST_SENT
        dealt = counts.join(F.broadcast(many) if few else many, "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        block = self._block(F.col("unit_id"), F.col("blocks"))
        parts = max(1, 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.store.tables["postings"].buckets)
        place = self.store.bucket("postings", F.col("term")) * parts + F.pmod(F.xxhash64("term", block), F.lit(parts)).cast("int")
        laid = dealt.withColumn("place", place).repartition("place").withColumn("block", block)
        found = laid.groupBy("place", "term", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("unit_id", "tf", "length"))).alias("units"), F.max("tf").alias("most"), F.min("length").alias("least"))
        return found.withColumns({"version": F.lit(version), "__bucket": F.floor(F.col("place") / parts).cast("int")}).drop("place")

    @staticmethod
    def _block(unit: Column, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(unit), blocks).cast("int")

    def compact(self) -> None:
        """Writes postings without the dead ones, and frequencies as one row a term."""
        base, _ = self.store.state()
        alive = self._alive(self.store.table("postings").select("term", "version", "blocks", "block", F.explode("units").alias("u")).select("term", "version", "u.*"))
        counts = alive.select("term", "unit_id", "tf", "length")
        sized = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.store.replace({"postings": self._posted(counts, sized, base + 1), "terms": sized, "units": self.store.table("units").withColumn("version", F.lit(base + 1)), "dead": self.store.table("dead").limit(0)}, base)

    # --- reads --------------------------------------------------------------------------------------------------

    def _alive(self, postings: DataFrame) -> DataFrame:
        dead = self.store.table("dead")
        few = dead.limit(MOST_DEAD + 1).count()
        return postings if not few else postings.join(F.broadcast(dead) if few <= MOST_DEAD else dead, ["unit_id", "version"], "left_anti")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Blocks of the terms asked for, their document frequencies, and the terms of each query with the most that a unit can get from each."""
        wanted = [r.term for r in queries.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        of = lambda name: self.store.lookup(name, wanted) if len(wanted) <= MOST_TERMS else self.store.table(name).join(queries.select("term").distinct(), "term", "left_semi")
        total = self.store.table("stats").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        mean = total.length / total.units if total.units else 1.0
        self._n, self._mean = total.units, mean or 1.0
        df = of("terms").groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
        blocks = of("postings")
        bound = blocks.groupBy("term").agg(F.max(self._part(F.col("most"), F.col("least"))).alias("part"))
        terms = queries.select("query_id", "term").distinct().join(df, "term").join(bound, "term").withColumn("idf", self._idf(F.col("df"))).withColumn("bound", F.col("idf") * F.col("part"))
        return blocks, df, terms.select("query_id", "term", "df", "idf", "bound")

    def _idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(float(self._n)) - df + 0.5) / (df + 0.5))

    def _part(self, tf: Column, length: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self._mean))

    def _plan(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Blocks, and the terms of each query with `least` (what its k-th best unit has at least) and `leads`: whether the term makes candidates."""
        blocks, _, terms = self._asked(queries)
        terms = terms.persist()
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
        first = terms.withColumn("place", F.row_number().over(order)).filter((F.col("place") == 1) | (F.col("df") <= RARE * self._n)).drop("place")
        seen = self._scored(first, blocks).groupBy("query_id", "unit_id").agg(F.sum("w").alias("score"))
        least = ranked(seen, k).filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
        upward = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Terms whose bounds, with those of all lower ones, stay below the k-th score make no candidates.
        planned = terms.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("sum", F.sum("bound").over(upward)).withColumn("leads", F.col("sum") >= F.col("least"))
        return blocks, planned.withColumn("others", F.sum(F.when(~F.col("leads"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy("query_id")))

    def _each(self, terms: DataFrame, blocks: DataFrame) -> DataFrame:
        """(term, unit_id, tf, length) of all postings of the terms. terms are of a stated set of queries."""
        return self._alive(blocks.select("term", "version", F.explode("units").alias("u")).select("term", "version", "u.*").join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")).drop("version")

    def _weighed(self, each: DataFrame, terms: DataFrame) -> DataFrame:
        """Postings for each query that asks for their term, with their part w of the score."""
        return each.join(F.broadcast(terms), "term").withColumn("w", F.col("idf") * self._part(F.col("tf"), F.col("length")))

    def _scored(self, terms: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, unit_id, w) of all postings of the terms."""
        return self._weighed(self._each(terms, blocks), terms)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best units for each query (query_id, term; distinct terms, a stated set): query_id, unit_id, score, rank."""
        blocks, planned = self._plan(queries, k)
        planned = planned.persist()
        each = self._each(planned, blocks)
        some = planned.filter("leads").groupBy("term").agg(F.first("df").alias("df")).agg(F.sum("df")).first()[0] or 0
        if some <= MOST_SENT:  # the other terms' postings are moved for the candidates only
            each = each.join(F.broadcast(self._candidates(self._scored(planned.filter("leads"), blocks)).select("unit_id").distinct()), "unit_id", "left_semi")
        # Postings move once, to their unit, and meet their queries there.
        return ranked(self._candidates(self._weighed(each.repartition("unit_id"), planned)).select("query_id", "unit_id", "score"), k)

    @staticmethod
    def _candidates(weighed: DataFrame) -> DataFrame:
        """Units that leading terms make candidates, with the sum of all parts given."""
        lead = F.sum(F.when(F.col("leads"), F.col("w")))
        return weighed.groupBy("query_id", "unit_id").agg(F.sum("w").alias("score"), lead.alias("lead"), F.first("least").alias("least"), F.first("others").alias("others")).filter(F.col("lead") + F.col("others") >= F.col("least"))

    def touched(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """Postings that make candidates in a search, and all postings of its queries' terms."""
        _, planned = self._plan(queries, k)
        r = planned.agg(F.sum(F.when(F.col("leads"), F.col("df")).otherwise(0)).alias("some"), F.sum("df").alias("all")).first()
        return r.some or 0, r.all or 0
