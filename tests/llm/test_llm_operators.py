"""The operators against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm import cluster, embeddings, language, licenses, minhash, mixing, packing, phrases, quality, substring, urls

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def corpus(n=120, seed=1):
    """Texts with copies, near copies, a passage that many share, and odd ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(0, 90))]
        kind = i % 6
        if kind == 1 and out:
            own = list(r.choice(out))
        elif kind == 2 and out:
            own = list(r.choice(out))
            for _ in range(2):
                if own:
                    own[r.randrange(len(own))] = r.choice(words)
        elif kind == 3:
            at_ = r.randint(0, len(own))
            own = own[:at_] + passage + own[at_:]
        out.append(own)
    texts = [r.choice([" ", "\n", "  "]).join(w) for w in out]
    odd_ = [None, "", " \n ", "x" * 50_000, "One\u00a0word two", "<|endoftext|>", "a b<|endoftext|> c<|endoftext|><|endoftext|>"]
    return [(i, t) for i, t in enumerate([*texts, *odd_])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def odd(spark):
    """Null ids, repeated rows, and extra columns named like the operators' own."""
    rows = [(None, "a b c", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, None), (3, "a b c d e f", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string").withColumns({c: F.lit(1) for c in ("n_words", "component_id", "bands", "row", "held_out", "spot", "a", "b", "length", "lang", "source")})


def test_words():
    texts = [t for _, t in corpus()]
    w = at.words(pa.array(texts), lower=True)
    for i, t in enumerate(texts):
        own = w.vocabulary.take(pa.array(w.codes[w.first[i] : w.first[i + 1]])).to_pylist()
        assert [x.decode() for x in own] == WORD.findall((t or "").translate(LOWER))
    sliced = at.words(pa.array(texts).slice(3, 7))
    assert len(sliced.first) == 8


def test_batches_keep_all_rows():
    table = pa.table({"text": pa.array(["x" * n for n in (1, 50, 3, 200, 1, 1)])})
    parts = list(at.batches(iter(table.to_batches(max_chunksize=4)), "text", 60))
    assert [len(x) for p in parts for x in p.column("text").to_pylist()] == [1, 50, 3, 200, 1, 1]
    assert all(sum(map(len, p.column("text").to_pylist())) <= 60 or p.num_rows == 1 for p in parts)


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {x.id: x.component_id for x in cluster.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)).collect()}
    linked = {v for a, b in pairs if a != b for v in (a, b)}
    assert got == {v: top(v) for v in linked}
    assert cluster.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [{}, {"leaf": 60, "block": 25}])
def test_embeddings(spark, sizes):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((200, 16))
    near = base[rng.integers(0, 200, 150)] + 0.18 * rng.standard_normal((150, 16))
    x = np.concatenate((base, near, near[:20], base[:5] * 3)).astype(np.float32)
    labels = [int(i) % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, labels, strict=True))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, x[0].tolist(), None), (n + 4, [1.0, 2.0], 0), (n + 5, [], 0), (None, x[0].tolist(), 0), (n + 6, [None] + [1.0] * 15, 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), **sizes).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near_ = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near_, False)
    part = np.arange(n)
    while True:
        new = np.minimum(part, np.where(near_, part[None, :], n).min(axis=1))
        if (new == part).all():
            break
        part = new
    assert near_.sum() > 100
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near_[i].sum(), part[i], part[i] == i)
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert None not in got and len(got) == n + 7


def planted(n, seed=5, dims=64):
    """2n vectors, n pairs among them at cosines of 0.9301 to 0.95."""
    rng = np.random.default_rng(seed)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, n, dims)))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.95, n)[:, None]
    return np.concatenate((x, c * x + np.sqrt(1 - c * c) * y))


@pytest.mark.parametrize(("n", "sizes"), [(2000, {}), (4096, {}), (6000, {"leaf": 4096, "block": 2048})])  # one block; two blocks of one leaf; trees
def test_embeddings_of_a_large_label_lose_no_pair(spark, n, sizes):
    v = planted(n)
    links = np.concatenate([(v[i : i + 1000] @ v.T >= 0.93).sum(axis=1) - 1 for i in range(0, len(v), 1000)])
    got = embeddings.near_duplicates(spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(v)], "vec_id bigint, embedding array<double>, label int"), **sizes).collect()
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == links.tolist()
    assert {(r.vec_id, r.component_id) for r in got} == {(i, i % n) for i in range(2 * n)}


def test_links_of_a_dense_group_are_no_rows():
    """Blocks of near copies return rows in proportion to their vectors."""
    rng = np.random.default_rng(0)
    v = rng.standard_normal(32) + 0.01 * rng.standard_normal((600, 32))
    table = pa.table({"side": pa.array([0] * 300 + [1] * 300, pa.int32()), "head": pa.array(range(600)), "copies": pa.array([2] * 600), "leaves": pa.array([[7]] * 600), "embedding": pa.array(v.tolist())})
    out = embeddings._work(0.93)((pa.scalar(7),), table).to_pylist()
    assert len(out) == 600 + 599
    assert {r["n"] for r in out if r["b"] is None} == {600} and {r["b"] for r in out} == {None, 0}
    meet = table.set_column(3, "leaves", pa.array([[3, 7]] * 300 + [[7, 9]] * 299 + [[3, 7]]))  # one pair of lists has an earlier leaf in common
    out = embeddings._work(0.93)((pa.scalar(7),), meet).to_pylist()
    assert {r["a"]: r["n"] for r in out if r["b"] is None} == {i: 598 if i < 300 else 600 for i in range(599)}


def test_blocks_of_a_label_need_no_tree(spark, monkeypatch):
    """A label of several leaves of the former size is compared as it is: no vector is copied by trees, and none of its pairs is met twice."""
    monkeypatch.setattr(embeddings, "_routes", None)
    v = planted(5000, dims=16)
    got = embeddings.near_duplicates(spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(v)], "vec_id bigint, embedding array<double>, label int")).collect()
    links = np.concatenate([(v[i : i + 1000] @ v.T >= 0.93).sum(axis=1) - 1 for i in range(0, len(v), 1000)])
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == links.tolist()


@pytest.mark.parametrize("cosine", [-0.5, 0.0, 0.5, 0.93, 0.999])
def test_near_pairs_come_once(cosine):
    """Codes of a byte lose no pair at any threshold, and inside a block each pair comes from one end."""
    v = planted(300, dims=24)
    v = np.concatenate((v, v[:40] + 0.002))
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= cosine), strict=True) if i < j}
    once = [tuple(sorted(x)) for p, r in embeddings.near_pairs(v, v, cosine, True) for x in zip(p.tolist(), r.tolist(), strict=True)]
    assert len(once) == len(set(once)) and set(once) == want
    both = [x for p, r in embeddings.near_pairs(v[:350], v[350:], cosine) for x in zip(p.tolist(), r.tolist(), strict=True)]
    assert len(both) == len(set(both)) and set(both) == {(i, j - 350) for i, j in want if i < 350 <= j}


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_least_count():
    assert embeddings.least_count(32, 1.0, 1e-6) == 32
    assert 0 < embeddings.least_count(32, 0.95, 1e-6) < 32


# --- 2 ----------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty):
    rows = sorted(corpus(), key=lambda r: -r[0])
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in phrases.edit_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for j, (i, _) in enumerate(rows):
        here, after = texts[j], texts[(j + 1) % len(texts)]
        k = len(here) // 3
        assert got[i].n_chars == len(here)
        assert got[i].edited_sha256 == hashlib.sha256((here[: len(here) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert phrases.edit_fingerprints(empty).count() == 0
    alone = phrases.edit_fingerprints(spark.createDataFrame([(5, "abcdef")], DOCS)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0
    assert phrases.edit_fingerprints(odd(spark)).count() == 4


def slow_names(text, levels):
    """Names of the phrases of a text at the last level, one symbol at a time."""
    mask = (1 << 64) - 1

    def mix(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    symbols, bits = list(text.encode()), 8
    for _ in range(levels):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        wide = [x if n == 1 else mix((x + 0x9E3779B97F4A7C15 * n) & mask) for x, n in runs]
        labels = [x for x, _ in runs] if bits == 8 else wide
        left = bits
        while True:
            low = [0 if i == 0 else (d := labels[i] ^ labels[i - 1], (d & -d).bit_length() - 1)[1] for i in range(len(labels))]
            labels = [2 * b + ((x >> b) & 1) for b, x in zip(low, labels, strict=True)]
            if left <= 3:
                break
            left = (2 * left - 1).bit_length()
        starts = [i for i in range(len(labels)) if i == 0 or (i + 1 < len(labels) and labels[i - 1] < labels[i] > labels[i + 1])]
        symbols = []
        for a, b in zip(starts, [*starts[1:], len(wide)], strict=True):
            total = sum(mix((x + 0x9E3779B97F4A7C15 * (j + 1)) & mask) for j, x in enumerate(wide[a:b])) + b - a
            symbols.append(mix(total & mask))
        bits = 64
    return symbols


def test_fingerprints_against_brute_force():
    r = random.Random(9)
    texts = ["", "a", "aa", "ab", "aaaaabbbbb", "x" * 3000] + ["".join(r.choice("abcé \n") for _ in range(r.randint(1, 400))) for _ in range(60)] + ["".join(r.choice("abcdefgh") for _ in range(9000))]
    texts += [t[:200] + t[260:] for t in texts[6:20]]
    for levels in (1, 2, 3):
        prints = phrases.sketches(pa.array(texts), levels, 64)
        names = [sorted({x >> 32 for x in slow_names(t, levels)}) if t else [] for t in texts]
        assert [p.tolist() for p in prints] == [n[:64] for n in names]
        for i in range(0, len(texts) - 1, 3):
            for j in (i + 1, len(texts) - 1 - i % 5):
                x, y = set(names[i]), set(names[j])
                got = phrases.likeness(prints[i], prints[j], 64)
                if len(x | y) <= 64:
                    assert got == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
                else:  # of the smallest values of the union
                    least = sorted(x | y)[:64]
                    assert got == pytest.approx(len(set(least) & x & y) / 64)


def test_phrases_do_not_depend_on_the_offset():
    r = random.Random(0)
    text = "".join(r.choice("abcdefgh ") for _ in range(6000))
    a, b, c = phrases.sketches(pa.array([text, "qq" + text, "".join(r.choice("abcdefgh ") for _ in range(6000))]))
    assert phrases.likeness(a, b) > 0.9 and phrases.likeness(a, c) < 0.1
    half = text[:3000] + "".join(r.choice("abcdefgh ") for _ in range(3000))
    assert 0.15 < phrases.likeness(a, phrases.sketches(pa.array([half]))[0]) < 0.55  # a third of the union


# --- 3 ----------------------------------------------------------------------------------------------------------


def test_rake_meets_its_marginals():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 4, 60), rng.integers(0, 3, 60)]
    counts = rng.integers(1, 50, 60)
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    w = mixing.rake(counts, codes, goals, 1000)
    for code, goal in zip(codes, goals, strict=True):
        assert np.allclose(np.bincount(code, w) / w.sum(), goal, atol=1e-6)


def test_mixing(spark, empty):
    r = random.Random(0)
    rows = [(i, "w " * r.randint(1, 30), r.choice(["a", "a", "a", "b", None]), r.choice(["en", "en", "de"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("weight", F.lit("mine"))
    goals = {"source": {"a": 0.4, "b": 0.4, "\ue000": 0.2}, "lang": 0.5}
    out = mixing.sample(df, ["source", "lang"], goals, 0.3).cache()
    assert out.count() == 3000 and out.first().row.weight == "mine"
    tokens = dict(zip((x[0] for x in rows), (len(x[1].split()) for x in rows), strict=True))
    expected = sum(x.probability * tokens[x.doc_id] for x in out.collect())
    assert abs(expected / sum(tokens.values()) - 0.3) < 1e-6
    kept = out.filter("selected").collect()
    share = Counter()
    for x in kept:
        share[x.source] += tokens[x.doc_id]
    assert abs(share["a"] / sum(share.values()) - 0.4) < 0.08 and None in share
    table = {x.doc_id: x for x in mixing.sample(df, ["source", "lang"], goals, 0.3, most_cells=1).collect()}
    for x in out.collect():
        assert math.isclose(table[x.doc_id].probability, x.probability, rel_tol=1e-5)
    assert mixing.sample(empty.withColumn("source", F.lit("a")), ["source"], {"source": 1.0}, 0.5).count() == 0
    assert mixing.sample(odd(spark), ["source"], {"source": 1.0}, 1.0).filter("selected").count() == 5


def test_mixing_by_a_column_of_another_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "mine"), (2, "a", "mine"), (2, "b", None), (3, None, "mine"), (None, "c", "mine")], "doc_id bigint, text string, topic string")
    also = spark.createDataFrame([(1, 7), (2, 8), (None, 9), (4, 9)], "doc_id bigint, topic int")
    for most in (mixing.MOST_BROADCAST, 0):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        out = mixing.sample(docs, ["topic"], {"topic": {"7": 1.0, "8": 1.0}}, 1.0, also=also).collect()
        assert sorted((str(r.doc_id), str(r.topic), str(r.row.topic), r.weight) for r in out) == [("1", "7", "mine", 1.25), ("2", "8", "None", 1.25), ("2", "8", "mine", 1.25), ("3", "None", "mine", 0.0), ("None", "None", "mine", 0.0)]


# --- 4 ----------------------------------------------------------------------------------------------------------


def test_best_fit_decreasing_is_item_by_item_best_fit():
    r = random.Random(0)
    for _ in range(30):
        window = r.choice([16, 50, 64])
        items = [r.randint(1, window) for _ in range(r.randint(1, 200))]
        bins = []
        for x in sorted(items, reverse=True):
            fits = [i for i, b in enumerate(bins) if b >= x]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= x
            else:
                bins.append(window - x)
        steps = packing.best_fit_decreasing(Counter(items), window)
        fill = defaultdict(list)
        for s in steps:
            for k in range(s.n):
                fill[s.sequence + k].append((s.offset, s.length))
        assert sum(s.n for s in steps) == len(items) and len(fill) == len(bins)
        assert sorted(window - sum(n for _, n in v) for v in fill.values()) == sorted(bins)
        for v in fill.values():
            end = 0
            for offset, n in sorted(v):
                assert offset == end
                end += n


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in corpus():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at_ = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at_ and r.doc_tokens == len(ids)
            at_ += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at_].tobytes())
        assert at_ == len(ids)
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert packing.pack(odd(spark), TOKENIZER).count() == 5


def test_encoder_gives_the_tokenizers_ids(tmp_path):
    import json

    from tokenizers import Tokenizer

    r = random.Random(1)
    signs = [*" \t\n\x0b  ab,'s1é́中<|\r\u00a0\u2003", "<|endoftext|>", "<|end", "<|endoftext|><|endoftext|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "<|endoftext|>", None, "a<|endoftext|>", "<|endoftext|>a", "wo<|endoftext|>rd", "a <|endoftext|> b", "<|<|endoftext|>|>", "x" * 5000 + "<|endoftext|>"]
    spec = json.load(open(TOKENIZER))
    two = tmp_path / "two.json"  # one added token begins another
    two.write_text(json.dumps(spec | {"added_tokens": [*spec["added_tokens"], spec["added_tokens"][0] | {"id": 60_000, "content": "<|endoftext|><|"}]}))
    stripped = tmp_path / "stripped.json"  # not cut by hand
    stripped.write_text(json.dumps(spec | {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}))
    for path in (TOKENIZER, str(two), str(stripped)):
        t = Tokenizer.from_file(path)
        for some in (texts, texts[-8:], ["plain text", None]):
            ids, n = packing._Encoder(path)(pa.array(some))
            assert len(n) == len(some)
            for own, text in zip(np.split(ids, np.cumsum(n)[:-1]), some, strict=True):
                assert own.tolist() == t.encode(text or "", add_special_tokens=False).ids


# --- 5 ----------------------------------------------------------------------------------------------------------


def test_licenses(spark, empty):
    s = licenses.SENTENCES
    mit = ". ".join(s[k] for k in ("mit-grant", "mit-notice", "mit-asis", "mit-liability"))
    apache = "\n".join((s["apache2-the-license"] + ";", s["apache2-comply"] + ".", "You may obtain a copy of the License at", "  http://www.apache.org/licenses/LICENSE-2.0", "", s["apache2-asis"] + ".", s["apache2-limits"] + "."))
    rows = [
        (1, "Some text.\nReleased under the MIT License."), (2, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit + "."), (3, apache), (4, None), (5, ""),
        (6, "The licence of the words released under the sun."), (7, "LICENSED UNDER CC BY-NC 4.0!\nwords\nLicensed under the Apache License, Version 2.0."), (8, "Copyright is a long story"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].licenses == ["MIT"] and got[2].licenses == ["MIT"] and got[3].licenses == ["Apache-2.0"]
    assert got[2].sentence_ids[:2] == ["mit-name-plain", "copyright"]
    assert got[7].licenses == ["CC-BY-NC-4.0", "Apache-2.0"]
    assert all(got[i].licenses == [] and got[i].n_sentences == 0 for i in (4, 5, 6, 8))
    text = rows[0][1]
    assert text[got[1].spans[0].start : got[1].spans[0].end] == "Released under the MIT License."
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd(spark)).count() == 5


def test_licenses_in_narrow_lines_and_own_sentences(spark):
    for name in ("mit-grant", "mit-liability", "apache2-asis"):
        for width in (16, 24, 36, 80):
            text = "Words before.\n\n" + textwrap.fill(licenses.SENTENCES[name], width, break_long_words=False, break_on_hyphens=False) + ".\n\nWords after."
            found = licenses.Recogniser().sentences(text)
            assert [x for *_, x in found] == [name], (name, width)
            assert text[found[0][0] :].startswith(licenses.SENTENCES[name].split()[0]) and text[found[0][1] :] == "Words after."
    assert all(re.search(licenses.Recogniser().hint(), x.replace(" ", "\n")) for x in licenses.SENTENCES.values())
    own = {"beer": "You can do whatever you want with this stuff"}
    rows = [(1, "Hello. You can do whatever\nyou want with this stuff."), (2, "other stuff")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, DOCS), own, (("Beerware", ("beer",)),)).collect()}
    assert got == {1: ["Beerware"], 2: []}


def test_licence_families():
    known = licenses.Recogniser()
    say = lambda text: known.licences([x for *_, x in known.sentences(text)])
    for name, stem, version in (("GNU General Public License", "GPL", "2"), ("GNU Lesser General Public License", "LGPL", "2.1"), ("GNU Affero General Public License", "AGPL", "3")):
        dotted = version if "." in version else f"{version}.0"
        notice = textwrap.fill(f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.", 70)
        rest = textwrap.fill(f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the {name} for more details.", 60)
        assert say(f"# x.c\n\n{notice}\n\n{rest}\n\ncode") == [f"{stem}-{dotted}-or-later"]
        assert say(f"Released under the {name}, version {version} or later.") == [f"{stem}-{dotted}-or-later"]
        assert say(f"Released under the {name}, version {version}.") == [f"{stem}-{dotted}"]
        assert say(f"// SPDX-License-Identifier: {stem}-{dotted}-only\ncode") == [f"{stem}-{dotted}-only"]
    s = licenses.SENTENCES
    text = lambda *keys: "\n\n".join(s[k] + "." for k in keys)
    bsd = ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liability")
    assert say("Copyright (c) 2001 Some One. All rights reserved.\n\n" + text(*bsd)) == ["BSD-3-Clause"]
    assert say(text(*bsd[:3], "rights-reserved", *bsd[4:])) == ["BSD-2-Clause"]  # a sentence between that the rule doesn't name
    assert say(text("zlib-asis", "zlib-liability", "zlib-grant") + " 1. " + text("zlib-origin") + " 2. " + text("zlib-altered") + " 3. " + text("zlib-notice")) == ["Zlib"]
    assert say(text("mit-grant", "mit-short", "mit-notice", "mit-asis", "mit-liability", "mit-grant", "mit-notice")) == ["MIT", "MIT", "MIT"]
    assert say(text("isc-grant", "isc-asis", "isc-liability")) == ["ISC"] and say("some words. " * 100_000 + text("cc0-short")) == ["CC0-1.0"]


def test_rules_against_brute_force():
    """The longest rule that follows in order from the first free identifier, tried as all choices of places."""
    from itertools import combinations

    r = random.Random(0)
    rules = [("X", ("a",)), ("Y", ("a", "b")), ("Z", ("a", "b", "c")), ("V", ("c", "a")), ("W", ("b", "b")), ("X2", ("a",))]
    known = licenses.Recogniser({x: f"sentence {x}" for x in "abcd"}, tuple(rules))
    for _ in range(400):
        ids = [r.choice("abcd") for _ in range(r.randint(0, 9))]
        free, want = list(range(len(ids))), []
        for i in range(len(ids)):
            if i not in free:
                continue
            for name, rule in sorted(rules, key=lambda x: -len(x[1])):
                later = [c for c in combinations([j for j in free if j > i], len(rule) - 1) if [ids[j] for j in (i, *c)] == list(rule)]
                later = [c for c in later if not any(ids[j] == rule[0] for j in range(i + 1, max(c, default=i)))]
                if ids[i] == rule[0] and later:
                    best = min(later)  # the nearest place of each
                    free = [j for j in free if j not in (i, *best)]
                    want.append(name)
                    break
        assert known.licences(ids) == want, ids


# --- 6 ----------------------------------------------------------------------------------------------------------


def without_repeats(rows, k):
    """{doc_id: [(words, kept words) of each row]}, window by window."""
    rows = sorted(((i, WORD.findall(t or "")) for i, t in rows), key=lambda r: r[0])
    owner, out = {}, defaultdict(list)
    for i, w in rows:
        for j in range(len(w) - k + 1):
            owner.setdefault(tuple(w[j : j + k]), i)
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if owner[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out[i].append((len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("k", "group"), [(1, 50), (5, 50), (13, 50), (13, substring.GROUP)])
def test_substrings(spark, docs, empty, k, group):
    got = {r.doc_id: r for r in substring.remove_repeats(docs, k, group=group).collect()}
    assert {i: [(r.n_words, r.kept_text)] for i, r in got.items()} == without_repeats(corpus(), k)
    for r in got.values():
        assert r.n_removed == r.n_words - len(r.kept_text.split(" ")) * (r.kept_text != "") == sum(s.end - s.first for s in r.spans)
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert substring.remove_repeats(empty, k).count() == 0


def passes(rows, k, group, slots=3):
    """The operator's passes one after the other in this process; rows that each level sent on, and the result."""
    table = lambda rows: pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows], pa.string())})
    parts = [rows[i::4] for i in range(4)]
    batches = lambda f, frames: [b for b in f(iter(frames)) if b.num_rows]
    found = pa.Table.from_batches([b for p in parts for b in batches(substring._windows(k, slots), table(p).to_batches())])
    take = lambda t, c, v: t.filter(pa.compute.equal(t[c], v)).to_batches()
    shared = pa.Table.from_batches([b for i in range(slots) for b in batches(substring._screen(slots), take(found, "task", i))])
    hits = {r["doc_id"]: r["hits"] for i in range(slots) for b in batches(substring._by_document, take(shared, "to", i)) for r in b.to_pylist()}
    sent, levels = [], []
    for p in parts:
        for b in batches(substring._zipped(["doc_id"]), table(p).to_batches()):
            mine = b.append_column("hits", pa.array([hits.get(i) for i in b.column("doc_id").to_pylist()], pa.binary()))
            sent += batches(substring._candidates(k, slots), [mine.filter(mine.column("hits").is_valid())])
    lost = []
    for level in range(len(substring.ladder(k))):
        sent = pa.Table.from_batches(sent, substring._batch(slot=[]).schema)
        lost += sent.filter(sent["slot"].is_null()).to_pylist()
        levels.append(sent["slot"].drop_null().to_pylist())
        sent = [b for i in range(slots) for b in batches(substring._trees(level, k, slots, group), take(sent, "slot", i))]
    sent = pa.Table.from_batches(sent, substring._batch(slot=[]).schema)
    assert sent["slot"].null_count == sent.num_rows
    marks = defaultdict(list)
    for r in lost + sent.to_pylist():
        marks[r["doc_id"]].append({c: r[c] for c in ("key", "first", "n")})
    out = defaultdict(list)
    kind = pa.list_(pa.struct([("key", pa.int64()), ("first", pa.int32()), ("n", pa.int32())]))
    for b in batches(substring._zipped(["doc_id"]), table(sorted(rows, key=lambda r: r[0])).to_batches()):
        mine = b.append_column("lost", pa.array([marks[i] for i in b.column("doc_id").to_pylist()], kind))
        for r in pa.Table.from_batches(batches(substring._cut(k, ["doc_id"]), [mine])).to_pylist():
            out[r["doc_id"]].append((r["n_words"], r["kept_text"]))
    return levels, out


@pytest.mark.parametrize("alike", ["none", "windows", "words"])
def test_substrings_do_not_hang_on_hashes(alike, monkeypatch):
    """The same result where all windows, or all words, have one hash."""
    if alike == "windows":
        monkeypatch.setattr(substring, "_short", lambda names: np.zeros(len(names), np.uint32))
    if alike == "words":
        monkeypatch.setattr(at.Words, "hashes", lambda self: np.zeros(len(self.codes), np.uint64))
    rows = corpus(60) + [(3, corpus(60)[4][1]), (3, corpus(60)[3][1]), (3, corpus(60)[3][1])]
    for k in (1, 4, 13):
        want = without_repeats(rows, k)
        for group in (20, 10**6):
            levels, got = passes(rows, k, group)
            assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}, (k, group)
            assert len(levels[0]) and any(levels[1:] + [[]]) == (group == 20 and k > 2)  # large groups are dealt again


def test_suffixes_are_ordered_by_their_words():
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "b", "ba", "é"]) for _ in range(r.randint(0, 40))) for _ in range(30)]
    w = at.words(pa.array(texts))
    for depth in (1, 2, 3, 5, 13):
        where, begin = at.within(w.first, depth)
        row = np.repeat(np.arange(len(texts)), np.diff(begin))
        s = substring.Suffixes(w, np.arange(len(texts)), row, np.zeros(len(texts), np.int64), where, row)
        order, node = substring.deep_nodes(s, depth)
        split = [t.encode().split() for t in texts]
        suffix = [split[i][j - w.first[i] :][:depth] for i, j in zip(row[order], where[order], strict=True)]
        assert suffix == sorted(suffix) and len({tuple(x) for x in suffix}) == node[-1]
        shared = substring.common_prefixes(w.codes, where[order], depth)
        assert all((x[: shared[i + 1]] == y[: shared[i + 1]]) and (shared[i + 1] == depth or x[shared[i + 1]] != y[shared[i + 1]]) for i, (x, y) in enumerate(zip(suffix, suffix[1:], strict=False)))


def test_substrings_odd_rows(spark):
    got = substring.remove_repeats(odd(spark), 3, carry=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(None, 0), (1, 0), (1, 0), (2, 0), (3, 6)]
    assert got[-1].row.score == "y" and got[-1].row.n_words == 1


# --- 7 ----------------------------------------------------------------------------------------------------------


def test_automaton_knows_all_substrings():
    r = random.Random(0)
    sample = "".join(r.choice("abc ") for _ in range(300))
    model = language.learn({"x": [sample]})
    own = " ".join([sample])[: language.SAMPLE_CHARS].lower()

    def parse(text):
        n = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[i : j + 1] in own:
                j += 1
            n, i = n + 1, max(j, i + 1)
        return n

    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 300))) for _ in range(40)]
    phrases_, spoken = language.parse(model, texts)
    assert phrases_[:, 0].tolist() == [parse(t) for t in texts]
    assert spoken.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_every_letter_of_a_sample_is_known():
    r = random.Random(1)
    letters = {"el": range(0x3B1, 0x3C9), "en": range(97, 123), "ko": range(0xAC00, 0xB1D0), "ru": range(0x430, 0x450), "uk": [*range(0x430, 0x450), 0x456, 0x457], "zh": range(0x4E00, 0x59B8)}
    alphabet = {k: [chr(i) for i in v if chr(i).lower() == chr(i)] for k, v in letters.items()}
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 5))) for _ in range(1500)] for k, a in alphabet.items()}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    samples = {k: [say(k, 9000 if k == "en" else 1500)] for k in words}
    model = language.learn(samples)
    own = {k: samples[k][0][: language.SAMPLE_CHARS] for k in model.names}

    def parse(text, sample):
        n, phrase = 1, ""
        for c in text:
            if phrase + c in sample:
                phrase += c
            else:
                n, phrase = n + 1, c if c in sample else ""
        return n

    texts = [(k, say(k, 25)) for k in words for _ in range(4)]
    got, spoken = language.parse(model, [t.upper() if k in ("en", "ru") else t for k, t in texts])
    assert spoken.all()
    assert got.tolist() == [[parse(t, own[k]) for k in model.names] for _, t in texts]
    assert [model.names[i] for i in (got * np.array(model.bits)).argmin(axis=1)] == [k for k, _ in texts]


def test_language(spark, empty):
    r = random.Random(0)
    sound = {"aa": "ka la ma na ti to".split(), "bb": "schu zwi fro gla pfe".split()}
    say = lambda lang, n: " ".join("".join(r.choice(sound[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, say(lang := ("aa", "bb")[i % 2], r.randint(5, 60)), lang, "s") for i in range(200)]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 ... 3", "aa", "s"), (903, say("bb", 3000), None, "s"), (None, say("aa", 9), None, "s"), (904, "中文", None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = {x.doc_id: x for x in language.identify(df).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert np.mean([got[i].lang_pred == ("aa", "bb")[i % 2] for i in held]) == 1
    assert got[903].lang_pred == "bb" and got[904].lang_pred in ("aa", "bb") and got[None].lang_pred == "aa"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert language.identify(empty.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    assert {x.lang_pred for x in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    r = random.Random(3)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(30)] for k in range(110)}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(learned.pop(), say(lang, 40), lang) for k, lang in enumerate(words) for _ in range(4 if k < 100 else 2)]
    rows += [(learned.pop(), "ok", "tiny"), (learned.pop(), "12 3", "digits")]
    words["long"] = ["".join(r.choice("qrstuvwxyz") for _ in range(6)) for _ in range(30)]
    words["mixed"] = ["".join(r.choice("äöüßéèñ") for _ in range(6)) for _ in range(30)]
    rows += [(learned.pop(), say("long", 5000), "long"), (learned.pop(), say("mixed", 1), "mixed"), (learned.pop(), say("mixed", 4000), "mixed")]
    asked = [(10_000 + i, say(lang, 30), lang) for i, lang in enumerate(sorted(words))]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t, _ in asked], "doc_id bigint, text string, lang string").repartition(3)
    assert all(len(t) > language.LONGEST for _, t, lang in rows if lang == "long")
    for all_chars, counts in ((language.ALL_CHARS, language.BATCH_COUNTS), (60_000, 500)):  # also where languages share the characters
        monkeypatch.setattr(language, "ALL_CHARS", all_chars)
        monkeypatch.setattr(language, "BATCH_COUNTS", counts)
        got = language.identify(df).collect()
        assert sorted(x.doc_id for x in got) == sorted(i for i, *_ in rows + asked)
        pred = {x.doc_id: x.lang_pred for x in got}
        assert [pred[i] for i, *_ in asked] == [lang for *_, lang in asked]


# --- 8 ----------------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_minhash(spark, docs, empty):
    want = brute_components(corpus(), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k=4).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_of_a_dense_group(spark, monkeypatch):
    """Near copies of one text, most of them unlike each other just below or above the similarity."""
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            own[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    want = brute_components(rows, 3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k=3).collect()}
    assert 1 < len({c for _, c in want.values()}) < 150
    assert got == want


def test_minhash_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark), k=4).orderBy("doc_id").collect()
    assert [(x.doc_id, x.component_id) for x in got] == [(1, 1), (1, 1), (2, 2), (3, 1)]


def test_minhash_compares_every_text_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2_000)
    r = random.Random(2)
    say = lambda n: " ".join(f"w{r.randrange(1000)}" for _ in range(n))
    near = lambda text: " ".join([*text.split()[:-1], "end"])
    one, two, three, dense = say(60), say(60), say(60), say(80).split()
    rows = [(1, one), (2, two), (2, near(one)), (3, near(two)), (4, three), (5, None), (5, near(three)), (6, ""), (7, three), (7, three), (8, None)]
    for i in range(20, 80):  # some of these repeat an id with another text
        own = list(dense)
        for _ in range(3):
            own[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows += [(i, " ".join(own))] + ([(i, say(70))] if i % 7 == 0 else [])
    sets = [(i, shingles(t, 4)) for i, t in rows]
    ids = sorted({i for i, _ in rows})
    part = {i: i for i in ids}
    links = [(a, b) for a, s in sets for b, t in sets if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    for _ in ids:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    assert [part[i] for i in (1, 2, 3, 5, 7)] == [1, 1, 1, 4, 4]
    for seed, few in ((0, 32), (1, 2), (2, 2)):
        monkeypatch.setattr(minhash, "FEW", few)
        random.Random(seed).shuffle(rows)
        got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(1 + seed), k=4).collect()
        assert sorted((x.doc_id, x.n_shingles) for x in got) == sorted((i, len(shingles(t, 4))) for i, t in rows)
        assert {x.doc_id: x.component_id for x in got} == part and all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 5000):
        common, own = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, (2, n // 4)).astype(np.uint64)
        a, b = (np.sort(np.concatenate((common, x))) for x in own)
        s = minhash.sketch(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 252)
        assert (s != minhash._EMPTY).all()
        assert abs((s[0] == s[1]).mean() - n / (n + 2 * (n // 4))) < 0.15


# --- 9 ----------------------------------------------------------------------------------------------------------


def test_quality(spark, empty):
    r = random.Random(0)
    good = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(10, 60))) + "."
    junk = lambda: " ".join(r.choice(["WIN!!", "CLICK!!", "$$$", "###", "x|y"]) + r.choice("!?%") for _ in range(r.randint(5, 40)))
    rows = [(i, good() if i % 3 else junk()) for i in range(400)] + [(900, None), (901, ""), (902, "word " * 20_000), (None, good())]
    df = spark.createDataFrame(rows, DOCS).withColumn("quality", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0), (6, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(df, labels, carry=True).collect()}
    assert len(got) == len(rows) and got[1].row.quality == "mine"
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert got[900].score == got[901].score
    assert quality.score(empty, labels).count() == 0
    assert quality.score(df, labels.limit(0)).filter("predicted = 1").count() == len(rows)


def test_votes_against_brute_force(monkeypatch):
    """Latent axes against a dense decomposition, neighbours and votes one text at a time; sampled texts that repeat are tied."""
    monkeypatch.setattr(quality, "RANK", 6)
    r = random.Random(7)
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(40)]
    texts = [" ".join(r.choice(words[:12] if i % 3 else words[12:]) for _ in range(r.randint(3, 30))) for i in range(60)]
    texts += texts[:30] + texts[3:6] * 30
    labels = np.array([int(i % 3 > 0) for i in range(len(texts))], np.float64)
    tf = np.concatenate(list(quality.counts(pa.array(texts))))
    rows = [np.flatnonzero(x) for x in tf]
    sample = quality.Sample(np.cumsum([0, *map(len, rows)]), np.concatenate(rows), np.concatenate([x[a] for x, a in zip(tf, rows, strict=True)]))
    df = (tf > 0).sum(axis=0)
    model = quality.fit(sample, labels, df, len(texts), 0.5, {0: 500, 1: 900})
    x = quality.weighted(tf.copy(), model.idf)
    x = x - x.mean(axis=0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:6]
    assert np.allclose(np.abs((model.axes.T @ axes.T).T @ (model.axes.T @ axes.T)), np.eye(6), atol=0.05)  # one space
    asked = [" ".join(r.choice(words) for _ in range(20)) for _ in range(40)] + texts[:5] + [""]
    tf = np.concatenate(list(quality.counts(pa.array(asked))))
    got = model.scores(tf)
    stands = {0.0: 500 / (labels == 0).sum(), 1.0: 900 / (labels == 1).sum()}
    for i, v in enumerate(model.latent(quality.weighted(tf.copy(), model.idf))):
        cosine = [round(float(c) * 1e6) for c in (v * model.vectors).sum(axis=1)]
        near = sorted(cosine, reverse=True)[: quality.NEIGHBOURS]
        total = vote = 0.0
        for c in set(near):
            tied = [j for j, d in enumerate(cosine) if d == c]
            for j in tied:
                w = max(c / 1e6, 0) ** quality.POWER * stands[labels[j]] * near.count(c) / len(tied)
                total, vote = total + w, vote + w * labels[j]
        want = vote / total if total > 1e-9 and asked[i] else 0.5
        assert got[i] == pytest.approx(want, abs=2e-3), i
    again = model.scores(tf[::-1])[::-1]
    assert np.allclose(again, got, atol=1e-3)


def test_quality_of_repeated_ids(spark):
    rows = [(1, "good words here"), (1, "BAD!! $$ !!"), (1, "good words here"), (2, "good words there"), (3, "BAD!! $$ ??"), (4, "good words again")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (4, 1)], "doc_id bigint, quality int")
    df = spark.createDataFrame(rows, DOCS)
    found = [sorted((x.doc_id, round(x.score, 6)) for x in quality.score(df.repartition(n), labels).collect()) for n in (1, 3)]
    assert found[0] == found[1] and len(found[0]) == 6


def test_labels_of_held_out_ids_do_not_matter(spark):
    rows = [(i, f"word{i % 7} other{i % 5} more{i}") for i in range(100)]
    df = spark.createDataFrame(rows, DOCS)
    scores = []
    for flip in (0, 1):
        labels = [(i, (i % 2) ^ (flip if zlib.crc32(str(i).encode()) % 5 == 0 else 0)) for i in range(100)]
        scores.append({x.doc_id: x.score for x in quality.score(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()})
    assert scores[0] == scores[1]


def test_scores_do_not_depend_on_the_size_of_the_sample(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("aeiounrst") for _ in range(5)) for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(40))) for i in range(1500)], DOCS).cache()
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1500)], "doc_id bigint, quality int")  # nothing in a text tells
    means = []
    for sample in (quality.SAMPLE, 100):  # by nature 9 : 1; 1 : 1
        monkeypatch.setattr(quality, "SAMPLE", sample)
        means.append(quality.score(df, labels).filter("held_out").agg(F.avg("score")).first()[0])
    assert means == pytest.approx([0.9, 0.9], abs=0.05)


# --- 10 ---------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "http://A.ORG/x?y"), (2, None), (3, "no scheme"), (4, "x://example.org/es/1"), (5, "http://m.example.org/en/1234"), (6, "http://badexample.org/en/1"), (7, "http://a.com"),
        (8, "http://a.com/fr/1"), (9, "http://a.com/de/2#x"), (10, "http://a.net?q=1"), (11, "http://org?x"), (12, ""), (13, "a://b://c/d"), (None, "http://x.net/a"), (14, "http://x.net/" + "s/" * 5000), (1, "http://A.ORG/x?y"),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("mine"))).collect()}
    rule = {i: (got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 14)}
    assert rule == {
        1: ("a.org", "/x", "org/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.org", "/es/1", "example.org/es/", "block"), 5: ("m.example.org", "/en/1234", "example.org/en/1", "block"),
        6: ("badexample.org", "/en/1", "org/", "allow"), 7: ("a.com", "", None, "allow"), 8: ("a.com", "/fr/1", "com/fr/", "allow"), 9: ("a.com", "/de/2", "com/de/", "block"), 10: ("a.net", "", None, "allow"),
        11: ("org", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("b:", "//c/d", None, "allow"),
    }
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://site.net/{('shop', 'news', 'wiki')[i % 3]}/{i}") for i in range(300)] + [(i, f"http://site.net/page{i}x/{'abc'[i % 3]}{i}") for i in range(300, 330)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 300) if i % 5], "page_id bigint, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert got[0].template == "/shop/*" and {got[i].verdict for i in range(0, 300, 3)} == {"block"}  # also the pages without a label
    assert {got[i].verdict for i in range(300) if i % 3} == {"allow"}
    assert got[300].template.startswith("/*") and got[300].verdict == "allow"


def test_rare_unlike_directories_keep_their_templates(spark):
    rows = [(i, f"http://hot.net/{'rare' if i % 100 == 0 else 'mid' if i % 100 in (1, 2) else 'main' if i % 100 < 70 else f'x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'}/{i}") for i in range(6000)]
    rows += [(i, f"http://cold.net/{'rare' if i % 100 == 0 else 'main'}/{i}") for i in range(10_000, 16_000)]
    kind = lambda url: url.split("/")[3]
    # hot.net: main and rare are bad, mid is bad in about the share of the whole node, the others are good. cold.net: rare is good, main bad.
    bad = lambda i, url: kind(url) == "main" or (kind(url) == "rare" and i < 10_000) or (kind(url) == "mid" and i // 100 % 3 > 0)
    marks = [(i, bad(i, u)) for i, u in rows if kind(u) in ("main", "rare", "mid") or i % 3 == 0]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(marks, "page_id bigint, bad boolean"), []).collect()}
    verdicts = {(i < 10_000, kind(u) if kind(u) in ("main", "rare", "mid") else "*"): set() for i, u in rows}
    for i, u in rows:
        verdicts[i < 10_000, kind(u) if kind(u) in ("main", "rare", "mid") else "*"].add(got[i].verdict)
    assert verdicts == {(True, "main"): {"block"}, (True, "rare"): {"block"}, (True, "mid"): {"block"}, (True, "*"): {"allow"}, (False, "rare"): {"allow"}, (False, "main"): {"block"}}


def test_more_than_fifty_directories_of_a_node_keep_their_templates(spark):
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(i, f"http://many.net/{name(i % 120)}/{i}") for i in range(120 * 20)]
    labels = [(i, i % 120 < 60) for i, _ in rows]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad boolean"), []).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i, b in labels if b}


def brute_templates(counts):
    """The tree of each host, node by node. counts: {(host, segments): (n, labelled, bad)}."""
    add = lambda rows: tuple(map(sum, zip(*rows, strict=True)))
    out = {}

    def grow(template, rows, level):
        out.update({k: template for k in rows if len(k[1]) == level})
        rows = {k: v for k, v in rows.items() if len(k[1]) > level}
        if not rows:
            return
        branch = {x: add([v for k, v in rows.items() if k[1][level] == x]) for x in {k[1][level] for k in rows}}
        left, kept = dict(branch), {}
        while True:
            _, labelled, bad = add(left.values()) if left else (0, 0, 0)
            share = bad / labelled if labelled else 0
            unlike = {x: v for x, v in left.items() if v[0] >= urls.SUPPORT and v[1] >= urls.LEAST_LABELS and 0 < share < 1 and abs(v[2] / v[1] - share) / math.sqrt(share * (1 - share) / v[1]) >= urls.DIFFERENT}
            if not unlike:
                break
            kept |= unlike
            left = {x: v for x, v in left.items() if x not in unlike}
        steps = defaultdict(dict)
        for x, v in kept.items():
            steps[math.floor((math.asin(math.sqrt(v[2] / v[1])) - math.asin(math.sqrt(1 - urls.LEAST_PURITY))) / (urls.DIFFERENT * math.sqrt(1 / (2 * urls.LEAST_LABELS))))][x] = v
        name = dict.fromkeys(left, "*")
        for own in steps.values():
            _, labelled, bad = add(own.values())
            share = bad / labelled
            for x, v in own.items():
                like = abs(v[2] / v[1] - share) < urls.DIFFERENT * math.sqrt(share * (1 - share) / v[1]) or v[2] / v[1] == share
                name[x] = "{" + min(own) + "+}" if len(own) > 1 and like else x
        for x in set(name.values()):
            grow(f"{template}/{x}", {k: v for k, v in rows.items() if name[k[1][level]] == x}, level + 1)

    for host in {h for h, _ in counts}:
        grow("", {k: v for k, v in counts.items() if k[0] == host}, 0)
    return out


def test_templates_and_purities_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    rows, marks = [], []
    share = defaultdict(lambda: r.choice([0.05, 0.1, 0.5, 0.9, 0.95]))
    for i in range(6000):
        host = f"h{min(r.randrange(9), 4)}.net"
        path = "/".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 2, 2, 3])))
        rows.append((i, f"http://{host}/{path}"))
        if r.random() < 0.6:
            marks.append((i, r.random() < share[host, path[:1], path[2:3] if path[:1] in "abc" else ""]))
    counts = defaultdict(lambda: (0, 0, 0))
    bad = dict(marks)
    key = lambda url: (url.split("/")[2], tuple(url.split("/", 3)[3].split("/")))
    for i, url in rows:
        n = counts[key(url)]
        counts[key(url)] = (n[0] + 1, n[1] + (i in bad), n[2] + bad.get(i, False))
    template = brute_templates(counts)
    total, host, leaf = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, (_, labelled, b) in counts.items():
        for x in (total, host[k[0]], leaf[k[0], template[k]]):
            x[0] += labelled - b
            x[1] += labelled
    near = lambda x, prior: (x[0] + urls.SMOOTHING * prior) / (x[1] + urls.SMOOTHING)
    assert any("+}" in t for t in template.values()) and any("*" in t for t in template.values())
    pages, labels = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(marks, "page_id bigint, bad boolean")
    for most in (urls.MOST_BROADCAST, 0):
        monkeypatch.setattr(urls, "MOST_BROADCAST", most)
        got = {x.page_id: x for x in urls.judge(pages, labels, []).collect()}
        assert len(got) == len(rows)
        for i, url in rows:
            k = key(url)
            purity = near(leaf[k[0], template[k]], near(host[k[0]], total[0] / total[1]))
            assert got[i].template == template[k] and got[i].purity == pytest.approx(purity), url
            assert got[i].verdict == ("block" if purity < 0.5 else "allow")
    assert 0 < sum(x.verdict == "block" for x in got.values()) < len(rows)


def test_every_licence_sentence_has_a_rule_or_is_evidence():
    """Each sentence alone gives its licence, unless it is listed as evidence; no text has two names that differ in that."""
    known = licenses.Recogniser()
    alone = {name for name, ids in ((ids[0], ids) for _, ids in licenses.RULES) if len(ids) == 1}
    for name, text in licenses.SENTENCES.items():
        found = known.licences([x for *_, x in known.sentences(f"Words.\n{text}.\nWords.")])
        assert found or name.startswith(licenses.EVIDENCE), name
        if name in alone:
            assert found, name
    say = lambda text: known.licences([x for *_, x in known.sentences(text)])
    for name, stem, versions in licenses.GNU:
        for v in versions:
            dotted = v if "." in v else f"{v}.0"
            for opening in licenses.OPENINGS:
                for ending, tail in (("", ""), (" or later", "-or-later"), (", or (at your option) any later version", "-or-later")):
                    assert say(f"{opening} the {name}, version {v}{ending}.") == [f"{stem}-{dotted}{tail}"]
    assert say("Licensed under the BSD license.") == ["BSD"]


def test_spdx_expressions():
    known = licenses.Recogniser()
    say = lambda text: known.licences([x for *_, x in known.sentences(text)])
    assert say("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;") == ["MIT", "Apache-2.0"]
    assert say("# SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) OR MIT") == ["GPL-2.0-or-later", "BSD-3-Clause", "MIT"]
    assert say("/* SPDX-License-Identifier: GPL-2.0-only WITH Unknown-exception */") == ["GPL-2.0-only"]
    assert say("SPDX-License-Identifier: Unknown") == [] == say("the SPDX-License-Identifier: Unknown OR other")
    text = "a\nSPDX-License-Identifier: MIT OR ISC\nb"
    assert [text[a:b].strip() for a, b, _ in known.sentences(text)] == ["MIT", "ISC"]


def test_sentence_lookup_against_brute_force():
    """Runs of fragments from left to right, the longest known one first, by trying every run."""
    r = random.Random(8)
    words = "a b c copyright".split()
    names = {f"s{i}": " ".join(r.choice(words[:3]) for _ in range(r.randint(1, 5))) for i in range(25)}
    known = licenses.Recogniser(names, ())
    table = {licenses.normalised(t): known.known[licenses.normalised(t)] for t in names.values()}
    for _ in range(400):
        text = "".join(r.choice(words[:3]) + r.choice([" ", " ", ", ", ". ", "\n", "\n\n", "; // ", "!\n * "]) for _ in range(r.randint(0, 14)))
        cuts = sorted({0, len(text), *(m.end() for m in re.finditer(r"(?<=[.!?;:,])\s+|\n\s*\n|[\r\n]+", text))})
        parts = [licenses._EDGE.sub(" ", text[a:b].lower()).strip() for a, b in zip(cuts, cuts[1:], strict=False)]
        parts = [p for p in parts if p]
        want, k = [], 0
        while k < len(parts):
            for n in range(len(parts) - k, 0, -1):
                if name := table.get(" ".join(parts[k : k + n])):
                    want.append(name)
                    k += n
                    break
            else:
                k += 1
        assert [x for *_, x in known.sentences(text)] == want, text


def test_licensed_documents_have_a_licence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    marked = docs.filter("text rlike '(Licensed under|Released under the|This work is licensed under) (the )?(Apache|MIT|GNU|CC)'").select("doc_id").collect()
    assert marked and all(got[r.doc_id] for r in marked)
