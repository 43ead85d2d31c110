"""Byte pairs, packing and sharding against the tokenizers library and plain checks."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from tabloom.llm import bpe, packing, sharding
from tabloom.llm.queries import tokenizer_path
from tokenizers import Tokenizer

TEXTS = [
    None, "", " ", "\n\n  \t x", "hello world", "hello world", "a" * 3000, "ab" * 700, "don't I'LL we've", "<|endoftext|>", "x<|endoftext|><|endoftext|> y",
    "\0special <|endoftext|>", "日本語テスト १२३ ½ Ⅷ", "é😀👨‍👩‍👧 \u0085 \u200b", "The quick brown fox. " * 900,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, [1], "b") for i, t in enumerate(texts)], "doc_id long, text string, id int, ids array<int>, bin string").repartition(3)


def test_encoding_and_decoding(spark, library):
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(160, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(50)) for _ in range(40)]
    texts = TEXTS + odd
    path = tokenizer_path()
    coded = bpe.encode(frame(spark, texts), path)
    decoded = bpe.decode(coded, path, carry=["ids"]).collect()
    assert sorted(r["doc_id"] for r in decoded) == list(range(len(texts)))
    for r in decoded:
        want = ids_of(library, texts[r["doc_id"]])
        assert r["ids"] == want
        assert r["text"] == library.decode(want, skip_special_tokens=False) == (texts[r["doc_id"]] or "")


def test_codec_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    encoder = bpe.Encoder(bpe.Codec(tokenizer_path()))
    for text in TEXTS:
        ids, at = encoder.encode([text or "", "b" + (text or "")])
        assert ids[:at[1]].tolist() == ids_of(library, text) and ids[at[1]:].tolist() == ids_of(library, "b" + (text or ""))


def test_digests_of_given_documents(spark, library):
    from tabloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def packed_well(rows, texts, library, capacity):
    """Checks a packing; gives the number of sequences and the least that it can be."""
    by_doc, by_sequence, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, parts in by_doc.items():
        ids = np.array([*ids_of(library, texts[doc]), 0], "<u4")
        total += len(ids)
        parts.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            assert r["length"] <= capacity and (k == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids) and len(parts) == -(-len(ids) // capacity)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing(spark, library):
    rng = random.Random(2)
    texts = TEXTS + ["word " * rng.randrange(400) for _ in range(300)]
    rows = packing.pack(frame(spark, texts), tokenizer_path(), capacity=512).collect()
    n, least = packed_well(rows, texts, library, 512)
    assert n <= least * 1.03 + 1


def test_packing_of_long_white_space(spark, library):
    """Runs that tiktoken refuses do not end the job, and their ids are the library's."""
    texts = ["a" + " " * 2_000_000 + "b <|endoftext|> c", "x", "a" + "\u3000\n" * 600_000 + "b", " " * 999_999]
    n, least = packed_well(packing.pack(frame(spark, texts), tokenizer_path()).collect(), texts, library, packing.CAPACITY)
    assert n <= least + 3


def test_packing_over_many_partitions(spark, library):
    """One bin in each of 30 partitions: the tree brings them together."""
    texts = ["word " * 50 for _ in range(30)]
    docs = frame(spark, texts).repartition(30, "doc_id")
    rows = packing.pack(docs, tokenizer_path(), capacity=512).collect()
    n, least = packed_well(rows, texts, library, 512)
    assert n <= least + 1


def test_best_fit():
    bins, place, fill = packing.best_fit(np.array([5, 7, 3, 2, 2, 1]), 10)
    assert fill == [10, 10] and bins[1] == bins[2]
    assert sorted(zip(bins, place))[0] == (0, 0)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_sharding(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "x" * 5000] + ["é" * rng.randrange(400) for _ in range(2000)] + ["same"] * 700
    docs = frame(spark, texts)
    rows = sharding.shard(docs, 8, str(tmp_path / "map")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    load, slots = {}, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(8)) and max(load.values()) < 1.01 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rebalancing_moves_little_and_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    rng = random.Random(5)
    first = spark.createDataFrame([(i, "x" * rng.randrange(200)) for i in range(4000)], "doc_id long, text string")
    sharding.shard(first, 8, path)
    more = first.union(spark.createDataFrame([(i, "y" * rng.randrange(200)) for i in range(4000, 5000)], "doc_id long, text string"))
    rows = sharding.shard(more, 9, path).collect()
    assert sharding.last_version(spark, path) == 2
    old, new = ({r[1]: r[2] for r in sharding.read_map(spark, path, v).collect()} for v in (1, 2))
    moved = sum(old[k] != new[k] for k in old)
    assert moved < 0.3 * len(old)
    load = {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) < 1.03 * sum(load.values()) / 9


def test_sharding_of_repeated_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(None, "b")] * 5 + [(None, None)], "doc_id long, text string")
    rows = sharding.shard(docs, 3, str(tmp_path / "a")).collect()
    assert len(rows) == 56
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.where("false"), 3, str(tmp_path / "b")).collect() == []
