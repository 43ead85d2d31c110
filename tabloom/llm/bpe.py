"""Byte-pair encoding and decoding by a pair occurrence index.

The words of a piece of a partition are encoded together, each distinct word once.  An index maps every pair of
neighbouring symbols that has a rank to all positions where it occurs.  Active ranks are taken in ascending order; all
occurrences of a rank are merged at once, and the pairs that arise left and right of them join the lists of their ranks.
A merge only makes pairs of higher rank, since both parts of a pair come before it in the vocabulary (checked on
loading), so every rank is met once.

The vocabulary is read from a tokenizer file in JSON whose path is a parameter.  It is sent to the tasks as one read
object of a few MB, the size of the file, whatever the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ODD, quoted, text_column

PIECE_BYTES = 1 << 22
CACHED_WORDS = 400_000  # distinct words whose ids a task remembers between pieces; forgetting them changes no result

# The pattern that splits texts into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(printable)))
    return [out[b] for b in range(256)]


class Codec:
    """Vocabulary of a byte-level tokenizer file; small and picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in characters], np.int32)
        tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        made_by = np.full(len(tokens), -1)
        made_by[self.made] = np.arange(len(merges))
        if (np.maximum(made_by[left], made_by[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before one of its parts")
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        # open addressing: a pair's slot holds its rank
        self.mask = (1 << 19) - 1
        self.slot_pair, self.slot_rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        self.probes = 0
        pairs, rank = (left << 32) | right, np.arange(len(merges), dtype=np.int32)
        while len(pairs):
            slot = self._slots(pairs, self.probes)
            _, one = np.unique(slot, return_index=True)
            one = one[self.slot_pair[slot[one]] == -1]
            self.slot_pair[slot[one]], self.slot_rank[slot[one]] = pairs[one], rank[one]
            rest = np.ones(len(pairs), bool)
            rest[one] = False
            pairs, rank = pairs[rest], rank[rest]
            self.probes += 1

    def _slots(self, pairs: np.ndarray, probe: int) -> np.ndarray:
        h = pairs.astype(np.uint64) * ODD[probe]
        return (h >> np.uint64(45)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        pairs = (left.astype(np.int64) << 32) | right
        slot = self._slots(pairs, 0)
        out = np.where(self.slot_pair[slot] == pairs, self.slot_rank[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_pair[slot] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = self._slots(pairs[open_], probe)
            hit = self.slot_pair[slot] == pairs[open_]
            out[open_[hit]] = self.slot_rank[slot[hit]]
            open_ = open_[~hit & (self.slot_pair[slot] >= 0)]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word begins (one more entry than words)."""
        size = np.array([len(w) for w in words], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = at[1:][size > 0] - 1
        after[ends] = -1
        before[at[:-1][size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(position: np.ndarray) -> None:
            rank = self.ranks(symbol[position], symbol[after[position]])
            known = rank >= 0
            position, rank = position[known], rank[known]
            if not len(position):
                return
            order = np.argsort(rank, kind="stable")
            position, rank = position[order], rank[order]
            heads = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = 0
            for end, r in zip([*heads.tolist(), len(rank)], [*rank[heads - 1].tolist(), int(rank[-1])], strict=True):
                held = index.get(r)
                if held is None:
                    index[r] = [position[begin:end]]
                    heapq.heappush(active, r)
                else:
                    held.append(position[begin:end])
                begin = end

        add(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            held = index.pop(rank)
            position = np.unique(held[0] if len(held) == 1 else np.concatenate(held))
            left, right, new = self.left[rank], self.right[rank], self.made[rank]
            follower = after[position]
            good = (symbol[position] == left) & (follower >= 0)
            good &= symbol[follower] == right
            position, follower = position[good], follower[good]
            if left == right and len(position) > 1:  # in a run of equal symbols every other pair merges
                head = np.append(True, position[1:] != follower[:-1])
                number = np.arange(len(position))
                keep = (number - number[head][np.cumsum(head) - 1]) % 2 == 0
                position, follower = position[keep], follower[keep]
            if not len(position):
                continue
            symbol[position] = new
            symbol[follower] = -1
            beyond = after[follower]
            after[position] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = position[inner]
            previous = before[position]
            add(np.concatenate([previous[previous >= 0], position[inner]]))
        alive = symbol >= 0
        return symbol[alive], np.concatenate([[0], np.cumsum(alive)])[at]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_at[ids + 1] - self.token_at[ids]
        return self.token_bytes[spread(self.token_at[ids], size)].tobytes()


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of ranges, one range after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts one piece after the other; keeps the ids of words it has met."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.split = regex.compile(WORDS).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(codec.special, key=len, reverse=True))) + ")") if codec.special else None
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for token, i in self.codec.special.items():
            self.numbers["\0special " + token]  # no word of a text: the pattern never joins a control character and letters
            self.ids = np.append(self.ids, np.int32(i))
            self.at = np.append(self.at, len(self.ids))

    def _words(self, text: str) -> list[str]:
        if self.specials is None or not any(s in text for s in self.codec.special):
            return self.split(text)
        out = []
        for part in self.specials.split(text):
            out += ["\0special " + part] if part in self.codec.special else self.split(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (one more entry than texts)."""
        if len(self.numbers) > CACHED_WORDS:
            self._forget()
        known = len(self.numbers)
        number = self.numbers.__getitem__
        words = [np.fromiter(map(number, found := self._words(t)), np.int64, len(found)) for t in texts]
        new = [w.encode("utf-8", "surrogatepass") for w in list(self.numbers)[known:]] if len(self.numbers) > known else []
        if new:
            ids, at = self.codec.encode_words(new)
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.ids = np.concatenate([self.ids, ids])
        flat = np.concatenate([*words, np.zeros(0, np.int64)])
        size = self.at[flat + 1] - self.at[flat]
        border = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]
        return self.ids[spread(self.at[flat], size)], border


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in pieces of bounded size: (first row, texts)."""
    first, held, size = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``; special tokens in a text count as tokens.

    Null and empty texts have no ids.  Repeated rows are encoded alike, an empty table gives an empty result, other
    columns are not looked at.
    """
    codec = Codec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec)
        for batch in batches:
            for first, texts in text_pieces(batch.column("text")):
                ids, at = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, len(texts)), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids))], ["id", "ids"])

    ids = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, ids array<int>").withColumnsRenamed({"id": doc_id})


def decode(coded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, carried columns) of (doc_id, ids).  Bytes that are not UTF-8 become U+FFFD; null ids give a null text."""
    codec = Codec(path)
    kept = [doc_id, *(carry or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_ids")
            texts = [None if not x.is_valid else codec.decode(np.asarray(x.values)).decode("utf-8", "replace") for x in lists]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "_text"])

    rows = coded.select(*[coded[quoted(c)].alias(f"_c{i}") for i, c in enumerate(kept)], F.col(quoted(ids)).alias("_ids"))
    kinds = [rows.schema[f"_c{i}"].dataType.simpleString() for i in range(len(kept))]
    schema = ", ".join([f"_c{i} {k}" for i, k in enumerate(kinds)] + ["_text string"])
    return rows.mapInArrow(run, schema).withColumnsRenamed({**{f"_c{i}": c for i, c in enumerate(kept)}, "_text": "text"})


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so ids never leave their task."""
    codec = Codec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec)
        for batch in batches:
            for first, texts in text_pieces(batch.column("text")):
                ids, at = encoder.encode(texts)
                own = [ids[b:e] for b, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, len(texts)), pa.array(np.diff(at)), pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in own]),
                    pa.array([hashlib.sha256(codec.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in own]),
                ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ids = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnsRenamed({"id": doc_id})
