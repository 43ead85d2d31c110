"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes.  Where tokens of both end, a group ends; every token of the one in a group is linked
with every token of the other.

* A task encodes its documents and numbers them inside containers of at most ``CONTAINER_DOCS``.  For each pair of ids it keeps
  which documents of the container hold the pair linked, as compressed bitmaps: plane k has the documents whose number of
  such links has bit k set.  Portions of a container are OR-merged (numbers of links of a document cut in two are added).
* A bitmap is written as its packed bits or as gaps of 1 to 3 bytes, whichever is shorter.
* A pair's document count is the sum of the population counts of its planes, each without the documents of lower planes; its
  number of links is the sum of population counts times 2^k.  A document is in one container only, so containers' counts add up.
* The postings, with their pair's score, return to their container and add it up for each document.

A frequent pair has one row per container and plane, so neither counting nor returning puts a pair's documents in one task.
What a task holds is bounded by one container.  Texts are encoded once; rows of documents and postings are written together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bpe import Codec, Encoder, spread
from tabloom.llm.chunk_table import MARK, ChunkTable, Model, portions
from tabloom.llm.common import cut, quoted, streamed_groups, text_column
from tabloom.llm.packing import encoder

CONTAINER_DOCS = 4096
CONTAINER_KEYS = 3_000_000  # (pair, document) keys after which a container is closed
PORTION_CHARS = 1 << 19
WIDE_GROUP = 4096           # a group with more links is counted over its distinct ids
_DOC_BITS = 16
_CONTAINER = 24             # a container's number is its task's number and, in so many bits, its own

_FACTS = ("n_a", "n_b", "n_groups", "n_links")
_DOC_SCHEMA = "pos int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING_SCHEMA = "a int, b int, plane int, fresh long, links long, packed boolean, docs_in binary"


class Aligner:
    """Encodes portions with both tokenizers and links their tokens; one for a task."""

    def __init__(self, codec: Codec, model: Model):
        self.codec = codec
        self.first = encoder(codec)
        self.table = ChunkTable(model)
        self.size_a = np.diff(codec.token_at)
        self.size_b = np.array([len(b) for b in model.bytes], np.int64)
        # the text of a group list: each id with what stands before it
        shown = [sign + str(i).encode() for sign, n in ((b";", len(self.size_a)), (b",", len(self.size_a)), (b"|", len(self.size_b)), (b",", len(self.size_b))) for i in range(n)]
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _ids(self, text: str) -> np.ndarray:
        """The library refuses very long runs of white space; the pair index of operator 4 takes these."""
        try:
            return self.first.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            plain = Codec.__new__(Codec)
            plain.__dict__.update(self.codec.__dict__, special={})
            return Encoder(plain).encode([text])[0]

    def align(self, texts: list[str]):
        """Facts of each text (n_a, n_b, n_groups, n_links), its group list, and the links: keys of pair and text with their number."""
        found = [self._ids(t) for t in texts]
        count_a = np.fromiter(map(len, found), np.int64, len(found))
        a = np.concatenate(found).astype(np.int64)
        b, at_b = self.table.encode(texts)
        b, count_b = b.astype(np.int64), np.diff(at_b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        last_a, last_b = _ends_too(end_a, end_b), _ends_too(end_b, end_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        begin_a, begin_b = _begins(last_a), _begins(last_b)
        n_a, n_b = np.diff(begin_a), np.diff(begin_b)
        at_a = np.concatenate([[0], np.cumsum(count_a)])
        group_at = group_a[at_a[:-1]]  # every text has tokens, and its end is the end of a group
        links = n_a * n_b
        facts = np.stack([count_a, count_b, np.diff(np.append(group_at, len(n_a))), np.add.reduceat(links, group_at)], axis=1)
        return facts, self._shown(a, b, group_a, group_b, begin_a, begin_b, at_a, at_b), self._links(a, b, group_a, begin_a, begin_b, links, at_a)

    def _shown(self, a, b, group_a, group_b, begin_a, begin_b, at_a, at_b) -> list[np.ndarray]:
        index_a, index_b = np.arange(len(a)), np.arange(len(b))
        which = np.empty(len(a) + len(b), np.int64)
        n = len(self.size_a)
        which[index_a + begin_b[group_a]] = a + n * (index_a != begin_a[group_a])
        which[index_b + begin_a[group_b + 1]] = b + 2 * n + len(self.size_b) * (index_b != begin_b[group_b])
        size = self.shown_size[which]
        flat = self.shown[spread(self.shown_at[which], size)]
        border = np.concatenate([[0], np.cumsum(size)])[at_a + at_b]
        return [flat[i:j] for i, j in zip(border[:-1], border[1:])]

    def _links(self, a, b, group_a, begin_a, begin_b, links, at_a) -> tuple[np.ndarray, np.ndarray]:
        text_of = np.repeat(np.arange(len(at_a) - 1), np.diff(at_a))
        wide = np.flatnonzero(links > WIDE_GROUP)
        times = np.diff(begin_b)
        times[wide] = 0
        times = times[group_a]
        other = b[spread(begin_b[group_a], times)]
        keys, number = np.unique(_key(np.repeat(a, times), other, np.repeat(text_of, times)), return_counts=True)
        parts, numbers = [keys], [number.astype(np.int64)]
        for g in wide:
            own_a, m_a = np.unique(a[begin_a[g]:begin_a[g + 1]], return_counts=True)
            own_b, m_b = np.unique(b[begin_b[g]:begin_b[g + 1]], return_counts=True)
            parts.append(_key(np.repeat(own_a, len(own_b)), np.tile(own_b, len(own_a)), text_of[begin_a[g]]))
            numbers.append(np.multiply.outer(m_a, m_b).ravel())
        return merged(parts, numbers)


def _key(a: np.ndarray, b: np.ndarray, doc) -> np.ndarray:
    return (a << 40) | (b << _DOC_BITS) | doc


def _ends_too(end: np.ndarray, other: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(other, end), len(other) - 1)
    return other[at] == end


def _begins(last: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(last) + 1])


def merged(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of keys; numbers of equal keys are added."""
    if len(keys) == 1:
        return keys[0], numbers[0]
    key, number = np.concatenate(keys), np.concatenate(numbers)
    order = np.argsort(key, kind="stable")
    key, number = key[order], number[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[head], np.add.reduceat(number, head) if len(head) else number


def gap_bytes(docs: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending document numbers of several lists (which begin at ``heads``) as gaps, 7 bits to a byte; and where each number's bytes begin."""
    gap = np.diff(docs, prepend=0)
    gap[heads] = docs[heads]
    size = 1 + (gap >= 1 << 7) + (gap >= 1 << 14)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(3):
        some = size > k
        out[at[:-1][some] + k] = ((gap[some] >> (7 * k)) & 127) | ((size[some] > k + 1) << 7)
    return out, at


def gaps_read(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers of lists whose bytes begin at ``begins``, and how many each list has."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    gap = np.add.reduceat((data & 127).astype(np.int64) << shift, first)
    head = np.searchsorted(first, begins)
    total = np.cumsum(gap)
    before = total[head] - gap[head]
    n = np.diff(np.append(head, len(gap)))
    return total - np.repeat(before, n), n


def postings(keys: np.ndarray, numbers: np.ndarray, docs: int) -> Iterator[pa.Table]:
    """Rows (a, b, plane, fresh, links, packed, docs_in) of a container's keys, by plane."""
    width = -(-docs // 8)
    plane = 0
    while len(keys) and int(numbers.max()) >> plane:
        has = (numbers >> plane) & 1 == 1
        own, fresh = keys[has], (numbers[has] & ((1 << plane) - 1)) == 0
        if len(own):
            pair, doc = own >> _DOC_BITS, own & ((1 << _DOC_BITS) - 1)
            heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            data, at = gap_bytes(doc, heads)
            count = np.diff(np.append(heads, len(own)))
            begin = at[np.append(heads, len(own))]
            packed = np.diff(begin) > width
            if packed.any():  # replace these lists by their bits
                bits = np.zeros((int(packed.sum()), width * 8), np.uint8)
                bits[np.repeat(np.cumsum(packed) - 1, count)[np.repeat(packed, count)], doc[np.repeat(packed, count)]] = 1
                size = np.where(packed, width, np.diff(begin))
                new = np.concatenate([[0], np.cumsum(size)])
                out = np.empty(new[-1], np.uint8)
                out[spread(new[:-1][packed], size[packed])] = np.packbits(bits, axis=1).ravel()
                out[spread(new[:-1][~packed], size[~packed])] = data[spread(begin[:-1][~packed], size[~packed])]
                data, begin = out, new
            lists = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)])
            yield pa.table({
                "a": (pair[heads] >> 24).astype(np.int32), "b": (pair[heads] & 0xFFFFFF).astype(np.int32), "plane": np.full(len(heads), plane, np.int32),
                "fresh": np.add.reduceat(fresh.astype(np.int64), heads), "links": count.astype(np.int64) << plane, "packed": packed, "docs_in": lists.cast(pa.binary())})
        plane += 1


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written rows of documents (container, pos, doc_id, facts, group list's digest) and of postings (container, pair, plane, bitmap).

    Texts that are null, empty, or hold the second tokenizer's marker character (whose bytes would not come back) have no tokens.
    """
    rows = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"container long, id {kind}, {_DOC_SCHEMA}, {_POSTING_SCHEMA}"
    return cut(rows.mapInArrow(_scan(Codec(path_a), Model(path_b)), schema), "aligned").withColumnsRenamed({"id": doc_id})


def _scan(codec: Codec, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(codec, model)
        container = Container(TaskContext.get().partitionId() << _CONTAINER)
        for batch in batches:
            names, texts = batch.column("id"), batch.column("text")
            for begin in range(0, batch.num_rows, CONTAINER_DOCS):
                some = texts.slice(begin, CONTAINER_DOCS)
                if container.docs + len(some) > CONTAINER_DOCS:
                    yield from container.closed()
                base = container.docs
                container.add_docs(names.slice(begin, CONTAINER_DOCS))
                for portion in portions(some, PORTION_CHARS, without=MARK):
                    row = np.array([r for r, _ in portion], np.int64) + base
                    container.add(row, *aligner.align([t for _, t in portion]))
                if container.held > CONTAINER_KEYS:
                    yield from container.closed()
        yield from container.closed()

    return run


class Container:
    """Documents of a task that are counted together."""

    def __init__(self, number: int):
        self.number = number
        self._empty()

    def _empty(self) -> None:
        self.docs, self.held = 0, 0
        self.names: list[pa.Array] = []
        self.facts: list[np.ndarray] = []
        self.digest: dict[int, object] = {}
        self.keys: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []

    def add_docs(self, names: pa.Array) -> None:
        self.names.append(names)
        self.facts.append(np.zeros((len(names), len(_FACTS)), np.int64))
        self.docs += len(names)

    def add(self, row: np.ndarray, facts: np.ndarray, shown: list[np.ndarray], links: tuple[np.ndarray, np.ndarray]) -> None:
        """A portion's texts; ``row`` has the place of each one's document."""
        base = self.docs - len(self.facts[-1])
        np.add.at(self.facts[-1], row - base, facts)
        for r, text in zip(row.tolist(), shown, strict=True):
            if r in self.digest:
                self.digest[r].update(text)
            else:
                self.digest[r] = hashlib.sha256(text[1:])
        keys, numbers = links
        mask = (1 << _DOC_BITS) - 1
        keys = (keys & ~mask) | row[keys & mask]
        if len(np.unique(row)) < len(row):  # a long document came in several texts
            keys, numbers = merged([keys, keys[:0]], [numbers, numbers[:0]])
        self.keys.append(keys)
        self.numbers.append(numbers)
        self.held += len(keys)

    def closed(self) -> Iterator[pa.RecordBatch]:
        """All rows of the container, which is empty afterwards."""
        if not self.docs:
            return
        names = pa.concat_arrays(self.names)
        facts = np.concatenate(self.facts)
        out = {"container": np.full(self.docs, self.number), "id": names, "pos": np.arange(self.docs, dtype=np.int32)}
        out |= {c: facts[:, i] for i, c in enumerate(_FACTS)}
        out["groups_sha256"] = pa.array([self.digest[i].hexdigest() if i in self.digest else "" for i in range(self.docs)], pa.string())
        schema = pa.schema([("container", pa.int64()), ("id", names.type), ("pos", pa.int32()), *[(c, pa.int64()) for c in _FACTS],
                            ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("fresh", pa.int64()),
                            ("links", pa.int64()), ("packed", pa.bool_()), ("docs_in", pa.binary())])
        yield from _wide(out, self.docs, schema)
        if self.keys:
            keys, numbers = merged(self.keys, self.numbers)
            for rows in postings(keys, numbers, self.docs):
                part = {c: rows.column(c).combine_chunks() for c in rows.column_names}
                yield from _wide(part | {"container": np.full(rows.num_rows, self.number)}, rows.num_rows, schema)
        self.number += 1
        self._empty()


def _wide(columns: dict, n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=20_000)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, docs, links) of every linked pair: in how many documents, and how often."""
    return found.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("fresh").alias("docs"), F.sum("links").alias("links"))


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scores of documents, and the pairs with their counts.

    Scores: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.  Null and empty
    texts, and texts with the marker character, have zeros and the empty digest.  Repeated rows are documents of their own; an
    empty table gives an empty result; other columns are not looked at.  Very long texts are aligned in parts.
    """
    found = aligned(docs, path_a, path_b, doc_id, text)
    pairs = pair_counts(found)
    # as many rows as the first tokenizer has ids, at most
    best = F.broadcast(pairs.groupBy("a").agg(F.max("docs").alias("most")))
    scored = pairs.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("is_best"))
    sent = found.where("a IS NOT NULL").select("container", "a", "b", "plane", "packed", "docs_in").join(scored, ["a", "b"])
    kept = [F.col(c) for c in ("pos", quoted(doc_id), *_FACTS, "groups_sha256")]
    of_docs = found.where("a IS NULL").select("container", *kept, *[F.lit(None).cast(t).alias(c) for c, t in _SENT])
    of_pairs = sent.select("container", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("pos", doc_id, *_FACTS, "groups_sha256")], *[c for c, _ in _SENT])
    both = of_docs.union(of_pairs).repartition("container").sortWithinPartitions("container", F.col("pos").asc_nulls_last())
    names = {c: f"_{i}" for i, c in enumerate(both.columns)}
    kind = found.schema[doc_id].dataType.simpleString()
    scores = both.withColumnsRenamed(names).mapInArrow(
        _returned, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return scores.withColumnsRenamed({"id": doc_id}), pairs


_SENT = (("plane", "int"), ("packed", "boolean"), ("docs_in", "binary"), ("docs", "long"), ("is_best", "boolean"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the scores of each container's postings by document."""
    for group in streamed_groups(batches, ["_0"], 1):
        pos = group.column(1)
        n = len(pos) - pos.null_count
        own = group.slice(0, n)
        total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in group.slice(n).to_batches(max_chunksize=50_000):
            _add_scores(batch, total, best)
        columns = [own.column(i) for i in range(2, 8)]
        yield from pa.table(
            [*columns[:5], pa.array(best), pa.array(total), columns[5]],
            names=["id", *_FACTS, "n_best", "count_sum", "groups_sha256"]).to_batches(max_chunksize=10_000)


def _add_scores(batch: pa.RecordBatch, total: np.ndarray, best: np.ndarray) -> None:
    plane = batch.column(8).to_numpy()
    packed = batch.column(9).to_numpy(zero_copy_only=False)
    lists = batch.column(10)
    score = batch.column(11).to_numpy() << plane
    hit = batch.column(12).to_numpy(zero_copy_only=False).astype(np.int64) << plane
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64)
    data = np.frombuffer(lists.buffers()[2], np.uint8)
    size = np.diff(offsets)
    gaps, bits = np.flatnonzero(~packed), np.flatnonzero(packed)
    if len(gaps):
        begin = np.cumsum(size[gaps]) - size[gaps]
        doc, n = gaps_read(data[spread(offsets[:-1][gaps], size[gaps])], begin)
        np.add.at(total, doc, np.repeat(score[gaps], n))
        np.add.at(best, doc, np.repeat(hit[gaps], n))
    for i in bits:
        doc = np.flatnonzero(np.unpackbits(data[offsets[i]:offsets[i + 1]]))
        total[doc] += score[i]
        best[doc] += hit[i]
