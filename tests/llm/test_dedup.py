"""Near-duplicate and repeat operators against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import near_duplicates as plain_near
from brute import near_vectors as plain_vectors
from brute import repeats as plain_repeats
from brute import roots
from conftest import SF
from tabloom.llm import components as cc
from tabloom.llm import embedding_dedup, minhash_dedup, stages, suffix_dedup
from tabloom.llm.common import utf8


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def prose(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet tempor magna aliqua veniam quis nostrud".split()) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, chains, shared passages, short, empty, null and long texts, repeated rows, null ids."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 70)
    texts = [base] * 4 + [None, "", "   \n", "one", "one", "One two", "one  two\tthree four", "é" * 250, "é" * 250, "a" * 500, "ab" * 300]
    words = base.split()
    for k in range(25):  # a chain of near copies
        words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    texts += [prose(rng, rng.randrange(1, 40)) + " " + passage + " " + prose(rng, rng.randrange(30)) for _ in range(40)]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    texts += [base + "\n" + prose(rng, 3), base.upper(), prose(rng, 4000), passage + passage]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[5], (None, base), (None, prose(rng, 50)), (None, None)]


def frame(spark, rows):
    """With columns whose names clash with those used inside and given back."""
    return spark.createDataFrame(
        [(i, t, 1, "x", t, 2) for i, t in rows], "doc_id long, text string, node int, id string, _text string, kept int").repartition(5)


def test_near_duplicates(spark, corpus):
    got = minhash_dedup.near_duplicates(frame(spark, corpus)).collect()
    same(got, plain_near(corpus))


def test_near_duplicates_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    same(minhash_dedup.near_duplicates(frame(spark, corpus), percent=80).collect(), plain_near(corpus, 80))


def digest(df):
    return [(r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in df.collect()]


def test_repeats(spark, corpus):
    same(digest(suffix_dedup.remove_repeats(frame(spark, corpus))), plain_repeats(corpus))


def test_repeats_of_crowded_anchors(spark, corpus):
    same(digest(suffix_dedup.remove_repeats(frame(spark, corpus), block_segments=3)), plain_repeats(corpus))


def test_repeats_in_pieces(spark, corpus, monkeypatch):
    """Texts longer than a piece: the windows of all pieces together are those of the text."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    _, at = utf8(pa.array([t or "" for _, t in corpus]))
    windows = []
    for first, last, begin, end in suffix_dedup._parts(at, 200):
        for t in range(first, last):
            windows += range(max(begin, at[t]), min(end, at[t + 1]) - 199)
    assert sorted(windows) == [i for b, e in zip(at, at[1:]) for i in range(b, e - 199)]


def test_suffix_array_orders_prefixes():
    rng = np.random.default_rng(1)
    for alphabet in (2, 3, 200):
        text = np.concatenate([rng.integers(0, alphabet, 700), [255] * 40]).astype(np.uint8)
        order = suffix_dedup.suffix_array(text, 30)
        assert sorted(order) == list(range(len(text)))
        raw = text.tobytes()
        cut = [raw[i:i + 30] for i in order if i < 700]
        assert cut == sorted(cut)
        prefix = suffix_dedup.common_prefix(text, np.array([i for i in order if i < 700]), 30)
        for a, b, n in zip(cut, cut[1:], prefix):
            assert n == next((k for k in range(30) if a[k] != b[k]), 30)


def test_documents_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(minhash_dedup.near_duplicates(docs).collect(), plain_near(rows))
    same(digest(suffix_dedup.remove_repeats(docs)), plain_repeats(rows))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(470, 530)] + [(600, 600)]
    got = dict(map(tuple, cc.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()))
    want = roots(601, links)
    assert got == {n: want[n] for pair in links for n in pair}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(vectors).collect() == []


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = (base[i % 12] * (1 + i % 3) + rng.normal(size=16) * (0.05 if i % 2 else 0.2)).astype("f4").tolist()
        rows.append((i, v, i % 2))
    rows += [(i + 300, rows[7][1], 1) for i in range(5)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None, 1.0], 1), (405, [float("inf")] * 16, 1)]
    rows += [(406, rows[7][1], None), (407, [1.0, 2.0], 1), (408, [1.0, 2.0], 1), (409, [-0.0, 1.0], 0), (410, [0.0, 1.0], 0), (None, rows[7][1], 1), (None, rows[7][1], 1)]
    df = spark.createDataFrame([(*r, 0, "v") for r in rows], "vec_id long, embedding array<float>, label int, node int, v string").repartition(3)
    want = plain_vectors(rows)
    same(embedding_dedup.near_vectors(df).collect(), want)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    same(embedding_dedup.near_vectors(df).collect(), want)


def test_vector_recall(spark):
    """Random vectors of 64 components with near copies, in groups of two and of sixty."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 64))
    near = lambda v: v + rng.normal(size=64) * 0.015 * np.linalg.norm(v)
    vectors = [*base, *[near(base[i]) for i in range(200)], *[near(base[300]) for _ in range(60)]]
    rows = [(i, v.astype("f4").tolist(), i % 3 if 300 < i < 1500 else 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    want = plain_vectors([(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows])
    got = {r[0]: r[1] for r in embedding_dedup.near_vectors(df).collect()}
    total = sum(r[1] for r in want)
    assert total > 1000
    assert sum(min(got[r[0]], r[1]) for r in want) >= 0.97 * total
    assert all(got[r[0]] <= r[1] for r in want)


def test_vector_index_in_a_narrow_cone(spark):
    """Vectors of mean cosine 0.95, with planted pairs just beyond the border: few pairs are candidates, and links are found."""
    rng = np.random.default_rng(12)
    spread = rng.normal(size=(1500, 64))
    spread[:, 0] = 0
    base = np.sqrt(0.05) * embedding_dedup.unit(spread)
    base[:, 0] = np.sqrt(0.95)
    away = base[500:1000] - base[1000:]
    away -= (away * base[:500]).sum(axis=1, keepdims=True) * base[:500]
    v = np.concatenate([base, 0.9803 * base[:500] + np.sqrt(1 - 0.9803 ** 2) * embedding_dedup.unit(away)])
    cosine = v @ v.T
    assert 0.94 < cosine[:1500, :1500].mean() < 0.96
    r = embedding_dedup.reference_points(v.tolist(), 256, 0.98)[64]
    held = np.zeros((len(v), len(r.pivots)))
    np.put_along_axis(held, np.argsort(-(v @ r.pivots.T), axis=1)[:, :r.depth], 1, axis=1)
    candidates = np.triu(held @ held.T >= r.shared, 1)
    assert candidates.sum() < 0.05 * len(v) * (len(v) - 1) / 2
    wanted = np.triu(cosine >= 0.98, 1)
    assert wanted.sum() >= 500 and candidates[wanted].mean() > 0.995

    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = sum(r["n_links"] for r in embedding_dedup.near_vectors(df).collect())
    assert 0.995 * 2 * wanted.sum() < got <= 2 * wanted.sum()


def test_vector_candidates_by_both_ways(monkeypatch):
    """Counting by products and by bits finds the same pairs, in the list of their two smallest shared pivots only."""
    rng = np.random.default_rng(3)
    near = np.sort(np.argsort(rng.random((150, 12)), axis=1)[:, :6], axis=1).astype(np.int16)
    members = [(a, b, np.flatnonzero((near == a).any(axis=1) & (near == b).any(axis=1))) for b in range(12) for a in range(b)]
    table = pa.table({
        "task": np.concatenate([np.full(len(m), 12 * a + b) for a, b, m in members]),
        "last": np.concatenate([np.full(len(m), b, np.int16) for _, b, m in members]),
        "node": np.concatenate([m for *_, m in members]), "near": pa.array([near[i] for *_, m in members for i in m], pa.list_(pa.int16())),
        **{c: np.full(sum(len(m) for *_, m in members), v) for c, v in [("left", True), ("right", True), ("place", 1), ("dim", 3)]}})
    node = np.asarray(table["node"])
    wanted = sorted((i, j) for j in range(150) for i in range(j) if len(set(near[i]) & set(near[j])) >= 3)
    for dense in (2, 30, 10**6):
        monkeypatch.setattr(embedding_dedup.Tasks, "DENSE", dense)
        monkeypatch.setattr(embedding_dedup.Tasks, "PAIRS", 100)
        got = [(int(node[i]), int(node[j])) for x, y in embedding_dedup.Tasks(table, {3: (3, 2)}, 12).candidates() for i, j in zip(x, y)]
        assert sorted(got) == wanted


def test_one_row_of_each_group_stays(spark):
    """Null ids, two texts on one id, repeated rows, texts without words and columns with names of the operator's own."""
    words = [f"w{i}" for i in range(60)]
    long, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words))
    rows = [(3, long), (1, near), (1, other), (1, near), (None, long), (None, long), (None, "a b"), (None, "a b"), (7, other),
            (8, None), (8, None), (9, ""), (None, ""), (None, None), (4, "c d"), (4, "c d")]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, key int, row int").repartition(3)
    got = stages.near_duplicate_filter(spark, df, "")
    assert got.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key)
    assert got == sorted([(1, near), (1, other), (None, "a b"), (8, None), (9, ""), (None, ""), (None, None), (4, "c d")], key=key)
    assert stages.near_duplicate_filter(spark, df.limit(0), "").collect() == []
