"""The Merkle manifest against a plain one."""

import hashlib
import zlib

import pytest

from tessera.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, pos int, tree int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for j, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            way = [*siblings(trees[x], i), *siblings(top, j)]
            altered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((*r[:4], r[4].translate(str.maketrans(merkle._UPPER, merkle._LOWER)))) if altered else leaf(r)
            for before, after in way:
                now = digest(before, now, after)
            out.append((r[0], leaf(r), trees[x][-1][0], root, digest(*(a + b for a, b in way)), now, now == root))
    return out


def same(df, rows):
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, plain(rows)))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, height):
    """Trees of one leaf to hundreds, more trees than one run, nulls everywhere, repeated ids and rows; buckets of 8 nodes and more."""
    rows = [(i % 70 if i % 11 else None, None if i % 3 else "s", [None, "a", "ä", "z", ""][i % 5] if i < 250 else f"lang{i % 30}", i % 50, None if i % 13 == 0 else "Äb" * (i % 4)) for i in range(400)]
    rows += [(7, "s", "a", 3, "Abc")] * 5
    assert same(merkle.manifest(frame(spark, rows), height=height), rows)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, None, None, None, None)], [(None, "s", "a", 1, "X")], [(3, "s", "a", 1, "X" * 300_000), (3, "s", "a", 1, "")], [(3, "s", "a", 1, ""), (3, "s", "b", 1, "")]):
        got = merkle.manifest(frame(spark, rows))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert got.count() == 0 if not rows else same(got, rows)


def test_any_altered_byte_is_found(spark):
    rows = [(i, "s", "a", 5, f"text {i}" + "Q" * (i % 2)) for i in range(60)]
    for r in merkle.manifest(frame(spark, rows)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or r.doc_id % 2 == 0)
