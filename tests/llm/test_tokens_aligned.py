"""Operators 11 and 12 against plain versions that use the tokenizers' own libraries."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabloom.llm import alignment, chunk_table

A_PATH, B_PATH = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(A_PATH)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


TEXTS = [
    None, "", " ", "  ", "a", "Hello world, hello  world!", "tail ", "\n\n\ttab  \n", "▁marked ▁▁text", "<s>, </s>, <unk> and <0x0A>",
    "<|endoftext|> as text", "naïve café 東京 \U0001F600\U0001F44D\x00 é", "x" * 300, "=" * 500 + " " * 300, "1234567890 " * 20, "東京都" * 60,
    "same text here", "same text here", "the the the the the",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, container string").repartition(3)


def plain_alignment(texts, tokenizer, library):
    """The contract in plain loops."""
    from tabloom.llm.bpe import Codec

    codec = Codec(A_PATH)
    token_a = lambda i: codec.token_bytes[codec.token_at[i]:codec.token_at[i + 1]].tobytes()

    def token_b(i):
        piece = library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode()

    rows, links = {}, {}
    for doc, text in enumerate(texts):
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = library.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(map(token_a, a)) != want or b"".join(map(token_b, b)) != want:
            a, b = [], []
        end_a = list(itertools.accumulate(len(token_a(i)) for i in a))
        end_b = list(itertools.accumulate(len(token_b(i)) for i in b))
        groups = []
        for end in sorted(set(end_a) & set(end_b)):
            groups.append(([], []))
        common = sorted(set(end_a) & set(end_b))
        for ids, ends, side in ((a, end_a, 0), (b, end_b, 1)):
            k = 0
            for i, end in zip(ids, ends):
                groups[k][side].append(i)
                k += end == common[k]
        links[doc] = Counter(p for g in groups for p in itertools.product(*g))
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows[doc] = [len(a), len(b), len(groups), sum(links[doc].values()), sha(shown) if groups else ""]
    held = Counter(p for found in links.values() for p in found)
    total = sum(links.values(), Counter())
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for doc, found in links.items():
        best = sum(m for p, m in found.items() if held[p] == most[p[0]])
        rows[doc][4:4] = [best, sum(m * held[p] for p, m in found.items())]
    return rows, {(*p, n, total[p]) for p, n in held.items()}


def mixed_texts(n, seed=4):
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "été", "straße", "x9", "=====", "\t", "the", "of", "東京", "don't", "\U0001F600", "", "  "]
    return [" ".join(pick.choices(words, k=pick.randint(0, 40))) for _ in range(n)]


def aligned_rows(spark, texts, **kw):
    scores, pairs = alignment.alignment(frame(spark, texts), A_PATH, B_PATH, **kw)
    got = {r["doc_id"]: list(r)[1:] for r in scores.collect()}
    return got, {tuple(r) for r in pairs.collect()}


@pytest.mark.parametrize("docs, keys, portion, wide", [(4096, 3_000_000, 1 << 19, 4096), (5, 200, 64, 4)])
def test_alignment_against_plain_loops(spark, monkeypatch, tokenizer, library, docs, keys, portion, wide):
    """Also with tiny containers, texts in parts, and groups counted over distinct ids."""
    for name, value in (("CONTAINER_DOCS", docs), ("CONTAINER_KEYS", keys), ("PORTION_CHARS", portion), ("WIDE_GROUP", wide)):
        monkeypatch.setattr(alignment, name, value)
    texts = TEXTS + mixed_texts(60)
    want, pairs = plain_alignment(texts, tokenizer, library)
    got, found = aligned_rows(spark, texts)
    assert got == want
    assert found == pairs


def test_alignment_of_few_rows(spark):
    assert aligned_rows(spark, [None, "", "▁"])[0] == {i: [0, 0, 0, 0, 0, 0, ""] for i in range(3)}
    scores, pairs = alignment.alignment(frame(spark, ["a"]).where("doc_id < 0"), A_PATH, B_PATH)
    assert scores.count() == pairs.count() == 0


def test_bitmaps_of_common_pairs():
    """Lists of gaps and packed bits, with numbers of links up to many bits, read back as they were."""
    rng = np.random.default_rng(3)
    docs = 3000
    keys = np.unique(np.concatenate([
        (np.int64(7) << 40) | (np.int64(9) << 16) | np.arange(docs), (rng.integers(0, 50, 4000) << 40) | (rng.integers(0, 9, 4000) << 16) | rng.integers(0, docs, 4000)]))
    numbers = rng.choice([1, 1, 1, 2, 3, 900], len(keys))
    total, best = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    fresh = Counter()
    import pyarrow as pa

    for t in alignment.postings(keys, numbers, docs):
        n = t.num_rows
        packed = t.column("packed").to_numpy()
        assert packed.any() or n < 40
        fresh.update({(a, b): f for a, b, f in zip(*[t.column(c).to_pylist() for c in ("a", "b")], t.column("fresh").to_pylist())})
        batch = pa.RecordBatch.from_arrays(
            [pa.nulls(n)] * 8 + [t.column(c).combine_chunks() for c in ("plane", "packed", "docs_in")] + [pa.array(np.full(n, 5)), pa.array(np.ones(n, bool))],
            [str(i) for i in range(13)])
        alignment._add_scores(batch, total, best)
    want = np.zeros(docs, np.int64)
    np.add.at(want, keys & 0xFFFF, numbers)
    assert (best == want).all() and (total == 5 * want).all()
    pair = keys >> 16
    assert fresh == Counter({(int(p >> 24), int(p & 0xFFFFFF)): int((pair == p).sum()) for p in np.unique(pair)})


def test_alignment_of_blank_runs(tokenizer):
    """Runs of white space that one library refuses are encoded by the pair index, special tokens' strings as text."""
    from tabloom.llm.bpe import Codec

    aligner = alignment.Aligner(Codec(A_PATH), chunk_table.Model(B_PATH))
    text = "<|endoftext|>" + "\n" * 1_000_100 + "end"
    assert aligner._ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunk_table_against_the_library(spark, library):
    texts = TEXTS + mixed_texts(60)
    got = {r["doc_id"]: r["ids"] for r in chunk_table.encode(frame(spark, texts), B_PATH).collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    rows = {r["doc_id"]: tuple(r)[1:] for r in chunk_table.digests(frame(spark, texts), B_PATH).collect()}
    assert rows == {i: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in got.items()}
    assert chunk_table.digests(frame(spark, texts).where("doc_id < 0"), B_PATH).count() == 0


def test_texts_in_parts_and_long_chunks(spark, monkeypatch, library):
    monkeypatch.setattr(chunk_table, "LONG_CHUNK", 16)
    monkeypatch.setattr(chunk_table, "TABLE_CHARS", 400)
    table = chunk_table.ChunkTable(model := chunk_table.Model(B_PATH))
    pick = random.Random(8)
    for _ in range(400):
        text = "".join(pick.choices("abétheing東京\U0001F600 " + model.guard, k=pick.randint(30, 120)))
        assert table.encode([" " + text])[0].tolist() == library.encode(text)
    import pyarrow as pa

    long = "many words of one text " * 30
    parts = [p for portion in chunk_table.portions(pa.array([long, None, "short"]), 50) for p in portion]
    assert len(parts) > 5 and "".join(t for row, t in parts if row == 0) == " " + long
    ids = np.concatenate([table.encode([t])[0] for row, t in parts if row == 0])
    assert ids.tolist() == library.encode(long)


def test_decoding_any_ids(library):
    model = chunk_table.Model(B_PATH)
    pick = random.Random(2)
    for _ in range(2000):
        ids = [pick.choice([pick.randint(0, 31999), pick.randint(3, 258), pick.randint(0, 3), model.mark]) for _ in range(pick.randint(0, 8))]
        assert chunk_table.decoded(model, np.array(ids, int)) == (library.decode(ids) if ids else "")
