"""The registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, embeddings, language, licenses, merkle, minhash, mixing, packing, phrases, quality, substring, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; the package that holds it is on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edit_fingerprints(table(spark, sf_dir, "documents"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of a document: the label of the embedding of the same id."""
    return table(spark, sf_dir, "embeddings").filter("vec_id is not null").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").cast("string").alias("topic"))


#: Shares in proportion to a power of the present ones, and the share of all tokens to keep.
MIX = {"source": 0.7, "lang": 0.6, "topic": 0.8}
MIX_SHARE = 0.6


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"), list(MIX), MIX, MIX_SHARE, also=topics(spark, sf_dir)).drop("row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=1024, end_id=0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct("licenses"), ",").alias("licenses"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), min_words=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document that its url names with the path's last number."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    named = pages.select("page_id", F.regexp_extract(urls.path_of(F.col("url")), "([0-9]{1,18})[^0-9]*$", 1).try_cast("bigint").alias("doc_id"))
    marks = named.join(labels.filter("quality is not null"), "doc_id").select("page_id", (F.col("quality") == 0).alias("bad"))
    return urls.judge(pages, marks)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_toxicity": op13_toxicity,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
# crc32 of the decimal doc_id, a bit at a time
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, b: list_reduce(list_concat([xor(x, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars", "{0}"))) + ")"

ORACLES = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT vec_id, vec_id AS other FROM embeddings
            UNION
            SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.other
        ), c AS (
            SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
        ), n AS (
            SELECT a, count(*) AS n FROM l GROUP BY a
        )
        SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
    """,
    "op6_substring_dedup": rf"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
        ), p AS MATERIALIZED (
            SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
        ), x AS MATERIALIZED (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p
        ), lost AS (
            SELECT doc_id, list(i) AS spots FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM x) WHERE doc_id > lo GROUP BY doc_id
        ), gone AS (
            SELECT doc_id, list_distinct(flatten(list_transform(spots, lambda i: range(i, i + 13)))) AS gone FROM lost
        ), k AS (
            SELECT d.doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN 0 ELSE len(gone) END AS r,
                CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept
            FROM d LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
    """,
    "op8_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
            END) AS g FROM d
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), l AS MATERIALIZED (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
            JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other
        ), c AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf,
                CASE WHEN mod(crc, 3) = 0 THEN changed ELSE leaf END AS now
            FROM (SELECT doc_id, lang, {_LEAF.format("text")} AS leaf, {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed, {_CRC} AS crc FROM documents)
        ), node AS (
            SELECT lang, 0 AS level, pos, n, leaf AS digest FROM d
            UNION ALL
            SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, level, n, pos // 8
        ), sub AS MATERIALIZED (
            SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
        ), upper AS (
            SELECT 0 AS level, pos, n, digest FROM sub
            UNION ALL
            SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, n, pos // 8
        ), run AS MATERIALIZED (
            SELECT lang, level, pos // 8 AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM node WHERE n > 1 GROUP BY ALL
        ), upper_run AS MATERIALIZED (
            SELECT level, pos // 8 AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM upper WHERE n > 1 GROUP BY ALL
        ), inside AS (
            SELECT row_number() OVER () AS r, doc_id, lang, leaf, 0 AS level, pos, n, now AS cur, '' AS proof FROM d
            UNION ALL
            SELECT r, doc_id, i.lang, leaf, i.level + 1, i.pos // 8, (n + 7) // 8, sha256(run[:64 * (i.pos % 8)] || cur || run[64 * (i.pos % 8) + 65:]), proof || run[:64 * (i.pos % 8)] || run[64 * (i.pos % 8) + 65:]
            FROM inside i JOIN run ON run.lang IS NOT DISTINCT FROM i.lang AND run.level = i.level AND run.pos = i.pos // 8 WHERE n > 1
        ), outside AS (
            SELECT r, doc_id, leaf, sub.digest AS subroot, 0 AS level, sub.pos, sub.n, cur, proof FROM inside i JOIN sub ON sub.lang IS NOT DISTINCT FROM i.lang WHERE i.n = 1
            UNION ALL
            SELECT r, doc_id, leaf, subroot, o.level + 1, o.pos // 8, (n + 7) // 8, sha256(run[:64 * (o.pos % 8)] || cur || run[64 * (o.pos % 8) + 65:]), proof || run[:64 * (o.pos % 8)] || run[64 * (o.pos % 8) + 65:]
            FROM outside o JOIN upper_run u ON u.level = o.level AND u.pos = o.pos // 8 WHERE n > 1
        )
        SELECT doc_id, leaf, subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT digest FROM upper WHERE n = 1) AS verified FROM outside WHERE n = 1
    """,
}
