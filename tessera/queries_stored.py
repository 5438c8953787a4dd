"""More of the catalogue: tables and indexes that are stored, changed in place and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extraction, mutation
from tessera.operators import relational as R
from tessera.operators.adjacency import Adjacency
from tessera.operators.term_index import TermIndex, words
from tessera.operators.vector_index import VectorIndex
from tessera.plans import adapters as A
from tessera.queries import _BM25, _HOPS, _focus, long, query, run_folder
from tessera.store import Store, Table
from tessera.streaming import ingest

# --- bucketed tables --------------------------------------------------------------------------------------------

_TABLES = {"customer": Table("custkey bigint, name string, balance double", "custkey", 16), "orders": Table("custkey bigint, orderkey bigint, price double", "custkey", 16)}


@query("""WITH c AS (SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS balance FROM customer),
    o AS (SELECT o_custkey AS custkey, max(o_totalprice) AS top, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
    u AS (SELECT custkey, CASE WHEN o.custkey % 13 = 0 AND top IS NOT NULL THEN 'changed' ELSE name END AS name, CASE WHEN o.custkey % 13 = 0 AND top IS NOT NULL THEN top ELSE balance END AS balance FROM c LEFT JOIN o USING (custkey)
        UNION ALL SELECT custkey + 10000000, 'changed', top FROM o WHERE custkey % 13 = 0)
    SELECT 'customer' AS name, custkey AS k, 0 AS orderkey, name AS label, balance AS amount FROM u WHERE custkey % 11 <> 0
    UNION ALL SELECT 'orders', o_custkey, o_orderkey, '', o_totalprice FROM orders WHERE o_custkey % 7 <> 0
    UNION ALL SELECT 'orders', custkey, -n, '', total FROM o WHERE custkey % 7 = 0""")
def bucket_commit(spark, d):
    """A store filled, then changed by commits that rewrite only the buckets of the keys in them: upserts with new keys, rows replaced by key, deletions."""
    store = Store(spark, run_folder(spark, "bucket-commit"), _TABLES)
    orders = A.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    store.replace({"customer": A.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), "orders": orders})
    of = orders.groupBy("custkey").agg(F.max("price").alias("top"), F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))
    changed = of.filter("custkey % 13 = 0").select("custkey", F.lit("changed").alias("name"), F.col("top").alias("balance"))
    sevens = of.filter("custkey % 7 = 0").select("custkey", (-F.col("n")).alias("orderkey"), F.col("total").alias("price"))
    store.commit({
        "customer": (changed.unionByName(changed.withColumn("custkey", F.col("custkey") + 10_000_000)), lambda old, new: mutation.upsert_last(old, new, ["custkey"])),
        "orders": (sevens, lambda old, new: mutation.replace_by_key(old, new, ["custkey"])),
    })
    store.commit({"customer": (store.table("customer").filter("custkey % 11 = 0"), lambda old, new: old.join(new.select("custkey"), "custkey", "left_anti"))})
    kept, left = store.table("customer"), store.table("orders")
    zero = F.lit(0).cast("bigint")
    return kept.select(F.lit("customer").alias("name"), F.col("custkey").alias("k"), zero.alias("orderkey"), F.col("name").alias("label"), F.col("balance").alias("amount")).unionByName(
        left.select(F.lit("orders").alias("name"), F.col("custkey").alias("k"), "orderkey", F.lit("").alias("label"), F.col("price").alias("amount"))
    )


_LAST = {"last": Table("user_id bigint, ts timestamp_ntz, event_id bigint, value double", "user_id", 16)}


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, d):
    """The last event of each user, kept by a stream of micro-batches in a bucketed table."""
    run = run_folder(spark, "stream-upsert")
    events = A.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    events.repartition(3, "event_id").write.parquet(f"{run}/in")
    store = Store(spark, f"{run}/store", _LAST)

    def merge(old, new):
        return R.latest(old.unionByName(new), ["user_id"], F.desc("ts"), F.desc("event_id"))

    ingest.upsert_store(ingest.read_stream(spark, f"{run}/in", _LAST["last"].schema, files_per_trigger=1), store, "last", merge, f"{run}/state").awaitTermination()
    return store.table("last").select("user_id", "event_id", "value")


# --- indexes ----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT * FROM e WHERE vec_id % 50 <> 1)
    SELECT q.vec_id AS query_id, u.vec_id AS unit_id, round(list_cosine_similarity(q.v, u.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, u.v) DESC, u.vec_id) AS rank
    FROM e q, u WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""")
def indexed_knn(spark, d):
    """A vector index that is built, added to and taken from; the searches are exact, by the cells' radii. Recall of the quick ones is measured in the tests."""
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), F.col("embedding").alias("vec"))
    at = F.col("unit_id").cast("bigint")
    index = VectorIndex(spark, run_folder(spark, "vector-index"), buckets=16)
    index.build(vectors.filter(at % 3 < 2))
    index.upsert(vectors.filter((at % 3 == 2) & (at % 50 != 1)), vectors.filter(at % 50 == 1).select("unit_id"))
    found = index.search(vectors.filter(at % 20 == 0).select(at.alias("query_id"), "vec"), 5, exact=True)
    return found.select("query_id", F.col("unit_id").cast("bigint").alias("unit_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_BM25.format(k=10).replace('FROM documents', 'FROM documents WHERE doc_id % 50 <> 1')} SELECT query_id, rank, round(score, 4) AS score FROM bm")
def indexed_search(spark, d):
    """BM25 from a stored index that is built from part of the texts and some older ones, then brought up to date; the texts aren't read again."""
    docs = A.spread(A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), "text"))
    at = F.col("unit_id").cast("bigint")
    index = TermIndex(spark, run_folder(spark, "term-index"), buckets=16)
    index.upsert(docs.filter(at % 3 < 2).withColumn("text", F.when(at % 10 == 0, F.concat(F.lit("older words the "), F.reverse("text"))).otherwise(F.col("text"))))
    index.upsert(docs.filter(at % 50 != 1), docs.filter(at % 50 == 1).select("unit_id"))
    items = A.table(spark, d, "benchmark").filter("item_id % 20 = 0")
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return index.search(asked, 10).select("query_id", long("rank", "rank"), F.round("score", 4).alias("score"))


_KEPT = _HOPS.replace("FROM relations UNION SELECT dst_entity_id, src_entity_id FROM relations)", "FROM kept UNION SELECT dst_entity_id, src_entity_id FROM kept)").replace(", steps AS", ", kept AS (SELECT * FROM relations WHERE length(relation_id) % 5 <> 0), steps AS")


@query(f"WITH {_KEPT} SELECT e AS entity_id, CAST(0 AS BIGINT) AS hops FROM h0 UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2")
def khop_stored(spark, d):
    """Two hops over a stored adjacency table from which some edges were taken; a hop reads the buckets of its frontier."""
    edges = A.relations(spark, d)
    graph = Adjacency(spark, run_folder(spark, "adjacency"))
    graph.upsert(edges)
    graph.upsert(edges.limit(0), edges.filter("length(relation_id) % 5 = 0").select("relation_id"))
    return graph.k_hop(_focus(spark), 2).select("entity_id", long("hops", "hops"))


@query("""WITH h AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS w FROM documents)
    SELECT doc_id, sha256(left(array_to_string(CASE WHEN doc_id % 2 = 0 THEN w[1:20] ELSE list_concat(['head of ' || doc_id], w[1:5]) END, ' '), 3000)) AS head FROM h WHERE len(w) > 0 OR doc_id % 2 = 1""")
def source_heads(spark, d):
    """Heads of all documents, those of odd ids taken as tables with a header."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    lines = docs.select("source_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "visible_text")).filter(F.trim("visible_text") != "")
    spans = lines.withColumn("span_type", F.when(F.col("source_id") % 2 == 0, "text").otherwise("table_row"))
    headers = docs.filter("source_id % 2 = 1").select("source_id", F.concat(F.lit("head of "), F.col("source_id").cast("string")).alias("header"))
    return extraction.heads(spans, headers).select(F.col("source_id").alias("doc_id"), F.sha2("head", 256).alias("head"))
