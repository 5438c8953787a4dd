"""Toxicity scores: features and calibration against plain ones, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import toxicity as tx

DOCS = "doc_id bigint, text string, lang string, score string"


def corpus(n=1500, seed=4):
    """Clean prose, and texts with one to four words of a list of their own, some disguised."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(700)]
    bad = ["grumbok", "zelwixen", "zelwixer", "zelwixan", "vorlag", "pathetic", "worthless"]
    rows = []
    for i in range(n):
        toxic = i % 8 == 3
        text = [r.choice(words) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 4) if toxic else 0):
            w = r.choice(bad)
            text.insert(r.randrange(len(text) + 1), r.choice([w, w, w.upper() + "!", w.replace("o", "0").replace("i", "1")]))
        rows.append((i, " ".join(text), "en", "x", int(toxic)))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    return spark.createDataFrame([r[:4] for r in rows], DOCS).repartition(4).cache(), spark.createDataFrame([(r[0], r[4], 1) for r in rows], "doc_id bigint, toxic int, quality int").cache(), rows


def test_held_out(spark, frames):
    docs, labels, rows = frames
    truth = {r[0]: r[4] for r in rows}
    got = tx.score(docs, labels).collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out]
    caught = [r.predicted for r in out if truth[r.doc_id]]
    assert np.mean(caught) >= 0.95 and np.mean([r.predicted for r in out if not truth[r.doc_id]]) <= 0.01
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(tx.score(docs, flipped).collect()) == sorted(got)


def test_odd_rows(spark, frames):
    docs, labels, _ = frames
    odd = [(None, "you pathetic zelwixen", "en", "x"), (90_001, None, None, None), (90_002, "", "en", "x"), (90_003, "zelwixen " * 60_000, "en", "x"), (90_004, " \n ", "en", "x"), (90_003, "zelwixen " * 60_000, "en", "x"), (90_005, "1 2 3 !!! 😀", "en", "x")]
    more = docs.unionByName(spark.createDataFrame(odd, DOCS))
    got = [r for r in tx.score(more, labels, carry=True).collect() if r.doc_id is None or r.doc_id > 90_000]
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[90_001].score == by[90_002].score == by[90_004].score and by[None].predicted == 1 and by[None].held_out is False
    assert len({r.score for r in got if r.doc_id == 90_003}) == 1 and by[90_003].row.score == "x"
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in tx.score(more, none).collect()} == {(0.0, 0)}
    assert {r.score for r in tx.score(more, labels.filter("toxic = 1")).collect()} == {1.0}
    assert tx.score(docs.limit(0), labels).count() == 0
    doubled = labels.unionByName(labels.selectExpr("doc_id", "cast(null as int) toxic", "quality")).unionByName(labels.limit(3).selectExpr("cast(null as bigint) doc_id", "toxic", "quality"))
    assert sorted(r.score for r in tx.score(docs, doubled).collect()) == sorted(r.score for r in tx.score(docs, labels).collect())


@pytest.mark.parametrize(("word", "plain", "hidden"), [("Idiot!!", "idiot", False), ("1d10t", "idiot", True), ("s.c.u.m", "scum", True), ("loooser", "loser", True), ("don't", "dont", False), ("$tup1d,", "tupid", True), ("123", "", False), ("¡Estúpido!", "estúpido", False), ("see", "see", False), ("...", "", False)])
def test_undisguised(word, plain, hidden):
    assert tx.undisguised(word) == (plain, hidden)


def test_features():
    """Every feature against one worked out word by word."""
    lexicon = {"grumbok": 2.0, "zelw*": 1.0, "zelwix*": 3.0, "abc": 0.5}
    texts = ["You GRUMBOK! a b c d e f zelwixen?", "", "abc, abc zelwa d1ng " + "x " * 9 + "grumb0k you", None, "ÉTÉ deine m*st idiot"]
    names = list(lexicon)
    model = tx.Lexicon(names, np.array([[0.0, lexicon[u]] for u in names]))
    got = tx.features(pa.array(texts), model, np.ones(len(texts), np.int64))
    again = tx.features(pa.array(texts), model, np.ones(len(texts), np.int64))
    assert np.array_equal(got, again)
    for text, row in zip(texts, got, strict=True):
        words = (text or "").split()
        n = max(1, len(words))
        plain = [tx.undisguised(w) for w in words]
        weight = [max((lexicon.get(u, 0) for u in tx.units(w)), default=0) for w, _ in plain]
        marked = [x >= tx.STRONG or w in tx.INSULTS for x, (w, _) in zip(weight, plain, strict=True)]
        address = [w in tx.ADDRESS for w, _ in plain]
        near = sum(m and any(address[max(0, i - tx.NEAR) : i + tx.NEAR + 1]) for i, m in enumerate(marked))
        ascii_ = [c for c in text or "" if ord(c) < 128]
        letters = [c for c in ascii_ if c.isalpha()]
        signs = sum(not c.isalnum() and not c.isspace() and c not in "!?" for c in ascii_)
        want = [
            math.log1p(len(words)), math.log1p(sum(x > 0 for x in weight)), sum(x > 0 for x in weight) / n, math.log1p(sum(x >= tx.STRONG for x in weight)), sum(x >= tx.STRONG for x in weight) / n,
            max(weight, default=0), sum(weight) / math.sqrt(n), sum(w in tx.INSULTS for w, _ in plain) / n, math.log1p(near), sum(address) / n,
            sum(c.isupper() for c in letters) / max(1, len(letters)), sum(len(w) > 1 and w.isupper() for w in words) / n, (text or "").count("!") / n, (text or "").count("?") / n, signs / n,
            sum(h for _, h in plain) / n, math.log1p(sum(h and m for (_, h), m in zip(plain, marked, strict=True))),
        ]
        assert np.allclose(row, want), (text, dict(zip(tx.NAMES, zip(row, want, strict=True), strict=True)))


def test_isotonic():
    """The levels are the least-squares rising fit: no two neighbouring blocks fall, each is the mean of its rows."""
    r = np.random.default_rng(3)
    raw, y, w = np.round(r.random(300), 2), (r.random(300) < 0.4).astype(float), r.random(300) + 0.1
    spots, level = tx.isotonic(raw, y, w)
    assert (np.diff(level) > 0).all() and (np.diff(spots) > 0).all()
    values = np.unique(raw)
    mean = np.array([np.average(y[raw == v], weights=w[raw == v]) for v in values])
    size = np.array([w[raw == v].sum() for v in values])
    # max over beginnings of min over ends of the mean between: the rising fit by its formula
    fit = [max(min(np.average(mean[a : b + 1], weights=size[a : b + 1]) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    assert np.allclose(np.unique(np.round(fit, 9)), np.unique(np.round(level, 9)))


def test_trees_learn_a_step():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    start, trees = tx.boost(x, y, np.ones(len(x)))
    raw = start + sum(t(x) for t in trees)
    assert ((raw > 0) == y).mean() > 0.98
