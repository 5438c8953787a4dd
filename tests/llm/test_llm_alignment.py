"""The alignment of tokenizers against tokenizers and sentencepiece, text by text."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.packing import _byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DRAWN = random.Random(5)
ODD = [
    " ", "  ", "a ", " a", "a  b", "   x   ", "\n", "\n\n a\n b", "\t\ta", "<|endoftext|>", "a<s>b</s>", "<unk> <0x41>", "▁", "a▁b", "a ▁b", "日本語 テスト", "😀😀 😀", "é à", "\u0000a", "a\u0000 b",
    "\r\n x\r", "(\r;\r", "x" * 3000, "ab" * 2000, "ﬁ ½ ①", "é" * 500, "the the the", "".join(DRAWN.choice("ab \n😀é▁\r\t1") for _ in range(3000)), "".join(DRAWN.choice("ab \n😀é\r\t1") for _ in range(3000)),
]


@lru_cache(1)
def models():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), _byte_characters()


def groups(text):
    """Token ids of each group, or None where the tokens don't give the text."""
    t, s, byte_of = models()
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    sizes = []
    for ids, of in ((a, lambda i: bytes(byte_of[c] for c in t.id_to_token(i))), (b, lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode())):
        pieces = [of(i) for i in ids]
        if b"".join(pieces) != (" " + text).encode():
            return None
        sizes.append(np.cumsum([len(p) for p in pieces]).tolist())
    out, i, j = [], 0, 0
    for cut in sorted(set(sizes[0]) & set(sizes[1])):
        x, y = sizes[0].index(cut) + 1, sizes[1].index(cut) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def plain(rows):
    found = [(i, groups(t) if t else None) for i, t in rows]
    links = [Counter((x, y) for a, b in g or () for x in a for y in b) for _, g in found]
    count = Counter(pair for c in links for pair in c)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, g), c in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        sums = sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items())
        out.append((i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(c.values()), *sums, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = ["".join(r.choice("abcdeéo1,.'😀") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = [r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(60)]
    return [(None if i == 4 else i // 2, t) for i, t in enumerate([None, "", *ODD, *texts, *texts[:9]])]


def test_align(spark, rows, monkeypatch):
    """Nulls, signs that tokens don't give back, special tokens as text, repeated ids and texts; with all pairs, few and no pairs at every task."""
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, pair int, n int").repartition(3)
    want = sorted(map(str, plain(rows)))
    for common in (alignment.COMMON, 40, 0):
        got = alignment.align(docs, A, B, common=common)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(str, map(tuple, got.collect()))) == want
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_small_blocks(rows, monkeypatch):
    """Links in blocks, words encoded one at a time, nothing kept between batches, and texts encoded whole: one result."""
    texts = pa.array([t for _, t in rows if t])
    aligner = alignment.Aligner(A, B)
    want = aligner(texts)
    assert want == aligner(texts)
    for name, value in (("LINKS", 7), ("JOINED", 1), ("KNOWN", 0)):
        with monkeypatch.context() as m:
            m.setattr(alignment, name, value)
            other = alignment.Aligner(A, B)
            assert other(texts) == want == other(texts)
    other = alignment.Aligner(A, B)
    other.b.by_word = False
    assert other(texts) == want


def test_counts_in_parts(spark, rows, monkeypatch):
    """What a task adds up before it passes pairs on changes no count."""
    aligner = alignment.Aligner(A, B)
    blobs = aligner(pa.array([t for _, t in rows if t]))["pairs"]
    want = Counter(int(k) for b in blobs if b for k in alignment.unpack_pairs(b)[0])
    frames = [pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], ["pairs"]) for b in blobs if b]
    for most in (5, 500, 10**6):
        monkeypatch.setattr(alignment, "PAIRS", most)
        got = Counter()
        for batch in alignment._count(iter(frames)):
            for k, n in zip(*batch.to_pydict().values(), strict=True):
                got[k] += n
        assert got == want
