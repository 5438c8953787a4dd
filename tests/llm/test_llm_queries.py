"""The registered queries against their SQL twins, and the pipeline's stages."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries as q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_twin(spark, sf, duck, name):
    assert plain(q.QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(q.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_one_row_a_document(spark, sf, name):
    df = q.QUERIES[name](spark, sf).toPandas()
    key, source = {"op1": ("vec_id", "embeddings"), "op10": ("page_id", "pages")}.get(name.split("_")[0], ("doc_id", "documents"))
    assert set(df[key]) == {r[0] for r in q.table(spark, sf, source).select(key).collect()}
    assert df[key].is_unique or name.startswith("op4")


def test_stages(spark, sf):
    docs = q.table(spark, sf, "documents").withColumns({"extra": F.lit("kept"), "topic": F.lit("kept")}).cache()
    names, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == names, name
        assert out.select("doc_id").distinct().count() == out.count() <= n
        assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.first().extra == out.first().topic == "kept"
        docs, n = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n > 0


def test_stages_of_odd_rows(spark, sf):
    rows = [(None, "a b", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27), (4, "One two three four five six", "de", "s", 27)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, docs, sf)
        if at == 1:
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "None"]
            unlike = docs.unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(1).cast("bigint")).withColumn("text", F.lit("another text of an id")))
            assert sorted(str(r.doc_id) for r in stage(spark, unlike, sf).collect()) == ["1", "1", "2", "3", "None"]
        assert out.count() <= 6


def test_pipeline_against_brute_force(spark, sf):
    """Each stage from its own input, worked out document by document."""
    import re
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    from tessera.llm import quality

    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    docs = q.table(spark, sf, "documents")
    labels = q.table(spark, sf, "labels")

    good = stages["quality_classifier"](spark, docs, sf).cache()
    scored = rows(quality.score(docs, labels))
    assert set(rows(good)) == {i for i, r in scored.items() if r.score >= 0.3}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in scored and scored[r.doc_id].held_out}
    assert sum(scored[i].predicted == y for i, y in known.items()) >= 0.9 * len(known)

    sets = {}
    for i, r in sorted(rows(good).items()):
        w = word.findall((r.text or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                p, o = top(a), top(b)
                root[max(p, o)] = min(p, o)
    apart = stages["minhash_near_dedup"](spark, good, sf).cache()
    assert set(rows(apart)) == {i for i in sets if top(i) == i}

    words = {i: word.findall(r.text or "") for i, r in sorted(rows(apart).items())}
    owner: dict = {}
    for i, w in words.items():
        for j in range(len(w) - 49):
            owner.setdefault(tuple(w[j : j + 50]), i)
    clean = stages["substring_dedup"](spark, apart, sf).cache()
    cleaned = rows(clean)
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if owner[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        want = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else rows(apart)[i].text
        assert cleaned[i].text == want and cleaned[i].n_chars == len(want)

    topics = {r.vec_id: str(r.label) for r in q.table(spark, sf, "embeddings").collect()}
    cells, tokens = {}, Counter()
    for i, r in cleaned.items():
        cells[i] = (r.source, r.lang, topics.get(i))
        tokens[cells[i]] += len(word.findall(r.text))
    weight, total = {c: float(n) for c, n in tokens.items()}, sum(tokens.values())
    for _ in range(200):
        for d, power in enumerate(q.MIX.values()):
            have, present = defaultdict(float), Counter()
            for c, n in tokens.items():
                have[c[d]] += weight[c]
                present[c[d]] += n
            goal = {v: n**power for v, n in present.items() if n}
            scale = sum(goal.values())
            weight = {c: w * goal.get(c[d], 0) / scale * total / have[c[d]] if have[c[d]] else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / n if n else 1.0 for c, n in tokens.items()}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1, mid * ratio[c]) * n for c, n in tokens.items()) < q.MIX_SHARE * total else (lo, mid)
    unit = {r.doc_id: r.u for r in clean.select("doc_id", (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(0)), 11) / F.lit(float(1 << 53))).alias("u")).collect()}
    mixed = stages["mixing"](spark, clean, sf).cache()
    chance = {i: min(1, hi * ratio[c]) for i, c in cells.items()}
    assert set(rows(mixed)) == {i for i in cells if unit[i] < chance[i]}  # no document lies at its cell's edge

    t = Tokenizer.from_file(q.tokenizer_path())
    packed = stages["packing"](spark, mixed, sf).collect()
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == {i: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in rows(mixed).items()}
