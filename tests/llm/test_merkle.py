"""Operator 13 against a plain version that keeps every level of every tree."""

import hashlib
import zlib

import pytest

from tabloom.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: digest(*map(field, r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    upper = levels([trees[x][-1][0] for x in langs]) if langs else []
    out = []
    for at, lang in enumerate(langs):
        for place, row in enumerate(own[lang]):
            other = list(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                other[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
            cur, proof = leaf(other), ""
            for tree, k in ((trees[lang], place), (upper, at)):
                for nodes in tree[:-1]:
                    run, j = nodes[k // 8 * 8:k // 8 * 8 + 8], k % 8
                    proof += "".join(run[:j] + run[j + 1:])
                    cur = digest(*run[:j], cur, *run[j + 1:])
                    k //= 8
            root = upper[-1][0]
            out.append((row[0], trees[lang][0][place], trees[lang][-1][0], root, digest(proof), cur, cur == root))
    return sorted(out, key=repr)


def manifest(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "noise", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, i int")
    return sorted(map(tuple, merkle.manifest(docs.repartition(3), tamper=merkle.lowered_third, **kw).collect()), key=repr)


def made(n, lang="en", begin=0):
    return [(begin + i, f"s{i % 3}", lang, i, f"Text {'ABC' * (i % 4)} É {i}") for i in range(n)]


EDGES = [
    (None, "s", "en", 1, "No Id"), (5, None, None, None, None), (6, "", "", 0, ""), (7, "s", "de", -3, "LONG " * 50_000), (7, "s", "de", -3, "OTHER text"),
    (8, "s", "de", 4, "twice"), (8, "s", "de", 4, "twice"), (9, "s", "zh", 2, "東京"), (10, "s", "Zz", 2, "x"), (12, "s", "\U0001F600", 2, "y"),
]


@pytest.mark.parametrize("rows", [
    EDGES, made(1), made(8), made(9), made(65) + EDGES, made(1200) + made(513, "de", 5000) + EDGES, [r for i in range(70) for r in made(2, f"l{i:02}", 10 * i)],
], ids=["edges", "one", "eight", "nine", "some", "many", "langs"])
def test_manifest_against_plain_trees(spark, rows):
    assert manifest(spark, rows) == plain_manifest(rows)


def test_more_rounds_than_one(spark, monkeypatch):
    """Blocks of eight leaves, so that trees have several rounds of different heights; offsets joined by a shuffle."""
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = made(100) + made(3, "de", 1000) + made(1, "fr", 2000) + EDGES
    assert manifest(spark, rows, depth=1) == plain_manifest(rows)


def test_empty_table_and_proofs(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(empty).count() == 0
    docs = spark.createDataFrame(made(20), empty.schema)
    for r in merkle.manifest(docs, with_proofs=True).collect():
        assert digest(r["proof"]) == r["proof_sha256"] and r["verified"] and len(r["proof"]) % 64 == 0


def test_tampering_is_found(spark):
    got = manifest(spark, made(300))
    changed = {r[0] for r in got if not r[-1]}
    assert changed == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 0}
