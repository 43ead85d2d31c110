"""Best-fit packing of token sequences, hierarchical.

* Every input partition encodes its documents, cuts the long ones into pieces and packs its pieces by best-fit decreasing.
  What it needs in memory is a few numbers for each piece; the result is written once, so numbers given to bins are final.
* Bins that nothing could join are done.  The others are items of the next round: eight packings meet in one task and their bins
  are best-fitted into each other; and so on up the tree.
* Best-fit leaves a packing with one bin at most that is half full or less, and two fuller bins never fit together.  So a
  tree of n packings has fewer than 2 n merges in all, and a task need not pass on more hosts than there are packings:
  what moves after the first round depends on the number of packings, not of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bpe import WORDS, Codec, Encoder, text_pieces
from tabloom.llm.common import cut, quoted, streamed_groups, text_column

CAPACITY, END_ID, FAN_IN = 2048, 0, 8
PIECE_BYTES = 1 << 21
_PACKING = 40  # a bin's number is its packing's number and, in so many bits, its own


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of a document.

    A document's tokens are its ids and an end token (id 0).  Documents of more than ``capacity`` tokens are cut so that all
    pieces but the first are full.  ``start`` counts the document's tokens before the piece, ``offset`` the tokens before it
    in its sequence; the pieces of a sequence follow each other without gaps and hold ``capacity`` tokens at most.

    Null and empty texts are one end token.  Repeated rows are packed one by one.  An empty table gives an empty result; other
    columns are not looked at.  Which sequence a piece gets depends on how the input is split.
    """
    rows = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = cut(
        rows.mapInArrow(
            _packed(Codec(path), capacity), f"id {kind}, piece int, start long, length long, crc long, bin long, offset long, fill long"),
        "packed")
    moved = _merged(pieces.where("offset = 0").select("bin", "fill"), capacity)
    placed = pieces.join(F.broadcast(moved), "bin", "left") if moved is not None else pieces.withColumns({"host": F.lit(None), "shift": F.lit(0)})
    return placed.select(
        F.col("id").alias(doc_id), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.coalesce("host", "bin").cast("long").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))


def encoder(codec: Codec) -> tiktoken.Encoding:
    """The same vocabulary in the faster of the installed libraries; special tokens count as tokens."""
    special = set(codec.special.values())
    ranks = {
        codec.token_bytes[codec.token_at[i]:codec.token_at[i + 1]].tobytes(): i
        for i in range(len(codec.token_at) - 1) if i not in special}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=codec.special)


def ids_of(coder: tiktoken.Encoding, codec: Codec, text: str) -> np.ndarray:
    """Ids of a text.  The library refuses texts with 999,999 or more white-space characters in a row; the pair index takes these."""
    try:
        ids = coder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        ids, _ = Encoder(codec).encode([text])
    return np.asarray(ids, "<u4")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and place in it of each item, and the fill of each bin; larger items first."""
    bins, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room left
    some = 0  # bit r is set where room[r] has a bin
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], place[i] = b, fill[b]
        fill[b] += size
        left -= size
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins, place, fill


def _packed(codec: Codec, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(codec)
        ids, document, start, length, crc = [], [], [], [], []
        n = 0
        for batch in batches:
            ids.append(batch.column("id"))
            for first, texts in text_pieces(batch.column("text"), PIECE_BYTES):
                for k, text in enumerate(texts):
                    tokens = np.append(ids_of(coder, codec, text), np.array([END_ID], "<u4"))
                    begin, end = 0, len(tokens) % capacity or capacity
                    while begin < len(tokens):
                        document.append(n + first + k)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(zlib.crc32(tokens[begin:end]))
                        begin, end = end, end + capacity
            n += batch.num_rows
        if not n:
            return
        size, document = np.array(length), np.array(document)
        bins, place, fill = best_fit(size, capacity)
        head = np.append(True, document[1:] != document[:-1])
        piece = np.arange(len(size)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        names = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
        number = (TaskContext.get().partitionId() << _PACKING) + bins
        columns = [
            names.take(pa.array(document)), pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()), pa.array(size),
            pa.array(crc, pa.int64()), pa.array(number), pa.array(place), pa.array(np.array(fill)[bins])]
        table = pa.Table.from_arrays(columns, ["id", "piece", "start", "length", "crc", "bin", "offset", "fill"])
        yield from table.to_batches(max_chunksize=10_000)

    return run


def _merged(bins: DataFrame, capacity: int) -> DataFrame | None:
    """(bin, host, shift): where the content of merged bins goes; None if there are no bins."""
    facts = bins.agg(F.min("fill"), F.max(F.shiftright("bin", _PACKING))).first()
    if facts[0] is None:
        return None
    least, tasks = facts[0], facts[1] + 1
    # fuller bins can take in nothing, not even the emptiest bin
    open_ = bins.where(F.col("fill") + least <= capacity).withColumn("task", F.shiftright("bin", _PACKING))
    moved = None
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        grouped = open_.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long"))
        step = cut(
            grouped.repartition("task").sortWithinPartitions("task")
            .mapInArrow(_round(capacity, tasks), "task long, bin long, fill long, host long, shift long"), "merged-bins")
        now = step.where("host IS NOT NULL").select("bin", "host", "shift")
        if moved is None:
            moved = now
        else:
            on = now.select(F.col("bin").alias("_bin"), F.col("host").alias("_host"), F.col("shift").alias("_shift"))
            moved = moved.join(on, moved["host"] == on["_bin"], "left").select(
                "bin", F.coalesce("_host", "host").alias("host"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")).union(now)
        open_ = step.where("host IS NULL").select("task", "bin", "fill")
    return moved if moved is not None else bins.select("bin", F.col("bin").alias("host"), F.lit(0).cast("long").alias("shift")).where("false")


def _round(capacity: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed_groups(batches, ["task"], 1):
            task, number, fill = (table.column(c).to_numpy() for c in ("task", "bin", "fill"))
            order = np.argsort(number)
            task, number, fill = task[order], number[order], fill[order]
            for t in np.unique(task):
                own = np.flatnonzero(task == t)
                bins, place, total = best_fit(fill[own], capacity)
                first = np.flatnonzero(place == 0)
                host = np.empty(len(total), np.int64)
                host[bins[first]] = number[own[first]]
                shifted = np.flatnonzero(place > 0)
                total = np.array(total)
                small = total <= capacity // 2
                hosts = np.flatnonzero(~small)
                on = np.concatenate([np.flatnonzero(small), hosts[np.argsort(total[hosts], kind="stable")][:tasks]])
                n, m = len(shifted), len(on)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + m, t)), pa.array(np.concatenate([number[own[shifted]], host[on]])),
                    pa.array(np.concatenate([fill[own[shifted]], total[on]])),
                    pa.array(np.concatenate([host[bins[shifted]], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                    pa.array(np.concatenate([place[shifted], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                ], ["task", "bin", "fill", "host", "shift"])

    return run
