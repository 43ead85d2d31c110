"""Exact substring deduplication: bytes of strings that start in two places are removed.

A suffix array of a whole corpus does not fit in a task, so suffixes are first brought together by anchors.

* The anchor of a window of ``min_bytes`` bytes is its leftmost run of ``GRAM`` bytes with the smallest hash.  Equal windows have
  equal anchors at equal places, so windows only have to be compared under one anchor.  Consecutive windows with one
  anchor form a *segment*; a text has about one segment for each 70 bytes, and only these rows are shuffled.
* Segments with equal bytes are counted.  Every window of a segment that occurs twice is repeated; the segment need not be compared.
* The distinct segments of an anchor with several are compared by their suffixes: a two-stage sort (``suffix_array``)
  followed by the common prefixes of neighbours.
* An anchor with more than ``BLOCK_SEGMENTS`` distinct segments (a passage in very many contexts) is cut in two: windows that
  start far before the anchor and windows that start near it.  Each half shares more bytes, which become its new name; halves
  are counted again, until no group is too large.  At the end a half is a single window, so this ends, drops
  nothing, and never brings a large group together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import (
    CHUNK_BYTES, ODD, SubstringHash, cut, mixed, pieces, quoted, signed, streamed_groups, text_column, utf8,
)

MIN_BYTES, GRAM = 200, 64
BLOCK_BYTES, BLOCK_SEGMENTS = 1 << 19, 4096
_PLACE = np.uint64(21)  # bits of a position in a piece


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES,
                   block_segments: int = BLOCK_SEGMENTS, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, carried columns), one row per row of ``docs``.

    Texts are UTF-8 bytes.  A byte goes if it lies in a string of ``min_bytes`` bytes that also starts anywhere else, in
    another or the same text; all copies go.  Strings are judged on the input and do not cross texts.  ``n_spans`` counts the
    maximal runs that went, ``kept`` are the bytes that stay, put together; a character may be cut.  With ``as_text`` they are a
    string without the rests of such characters.

    Null and empty texts give zero bytes and an empty ``kept``; texts shorter than ``min_bytes`` stay as they are.  Repeated
    rows are two texts, so both lose all long enough bytes.  An empty table gives an empty result.  Other columns, whatever
    their names, are not looked at unless they are named in ``carry``.
    """
    carried = carry or []
    keyed = docs.select(
        docs[quoted(doc_id)].alias("_id"), text_column(docs, text).alias("_text"),
        *[docs[quoted(c)].alias(f"_c{i}") for i, c in enumerate(carried)])
    keyed = keyed.withColumn("_key", F.xxhash64("_id", "_text")).withColumn("_len", F.octet_length("_text"))
    spans = repeated_spans(keyed.select("_key", "_len", "_text"), min_bytes, block_segments)
    spans = spans.groupBy(F.col("_key").alias("_k"), F.col("_len").alias("_l")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    joined = keyed.join(spans, (keyed["_key"] == spans["_k"]) & (keyed["_len"] == spans["_l"]), "left").drop("_key", "_len", "_k", "_l")
    fields = {f.name: f.dataType.simpleString() for f in keyed.schema}
    schema = ", ".join([
        f"_id {fields['_id']}", "n_bytes long", "n_removed long", "n_spans long", "kept string" if as_text else "kept binary", *[f"_c{i} {fields[f'_c{i}']}" for i in range(len(carried))]])
    names = {"_id": doc_id, **{f"_c{i}": c for i, c in enumerate(carried)}}
    return joined.mapInArrow(_removed(len(carried), as_text), schema).withColumnsRenamed(names)


def repeated_spans(keyed: DataFrame, min_bytes: int = MIN_BYTES, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """(_key, _len, lo, hi): byte ranges that go, of (_key, _len, _text); they may overlap."""
    found = cut(
        keyed.where(F.col("_len") >= min_bytes).mapInArrow(
            _anchored(min_bytes), "anchor long, segment long, n int, _key long, _len int, at int, starts int, before int"),
        "segments")
    inside = found.where("anchor IS NULL").select("_key", "_len", F.col("at").alias("lo"), (F.col("at") + F.col("starts") + min_bytes - 1).alias("hi"))
    often = found.where("anchor IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1").select("anchor")
    shared = cut(found.where("anchor IS NOT NULL").join(often, "anchor"), "shared-segments")
    counted, resolved = _counted(shared, min_bytes)
    places = counted.where("n_segments > 1").select("anchor", "n", "n_segments", "least.*")
    by_text = places.groupBy(F.col("_key").alias("_k"), F.col("_len").alias("_l")).agg(
        F.collect_list(F.struct("anchor", "n", "n_segments", "at", "starts", "before")).alias("_places"))
    texts = keyed.join(by_text, (keyed["_key"] == by_text["_k"]) & (keyed["_len"] == by_text["_l"])).drop("_k", "_l")
    segments = cut(texts.mapInArrow(_segments(min_bytes), _SEGMENT), "open-segments")
    spans = [inside, resolved]
    width = 1 << int(min_bytes).bit_length()
    while True:
        small, large = segments.where(F.col("n_segments") <= block_segments), segments.where(F.col("n_segments") > block_segments)
        compared = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
            _compared(min_bytes), "_key long, _len int, lo int, hi int")
        spans.append(compared)
        if large.isEmpty():
            break
        width //= 2
        segments, more = _halved(large, min_bytes, width)
        spans.append(more)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


_SEGMENT = "anchor long, n long, n_segments long, _key long, _len int, at int, starts int, before int, bytes binary"


def _counted(rows: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Distinct segments of each anchor with their number, and the ranges of segments that occur more than once."""
    place = F.struct("_key", "_len", "at", "starts", "before")
    segments = rows.groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.min(place).alias("least"))
    kinds = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("times")).where("times > 1")
    counted = cut(segments.join(kinds.drop("times"), "anchor"), "counted-segments")
    twice = counted.where("n > 1").select("anchor", "segment")
    resolved = rows.join(twice, ["anchor", "segment"]).select(
        "_key", "_len", F.col("at").alias("lo"), (F.col("at") + F.col("starts") + min_bytes - 1).alias("hi"))
    return counted, resolved


def _halved(large: DataFrame, min_bytes: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Segments of crowded anchors cut into halves that are named by the bytes all their windows share."""
    halves = cut(large.mapInArrow(_half(min_bytes, width), "segment long, " + _SEGMENT), "halves")
    times = halves.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1").select("anchor")
    kept = cut(halves.join(times, "anchor"), "shared-halves")
    counted, resolved = _counted(kept.drop("n_segments", "bytes"), min_bytes)
    open_ = counted.where("n_segments > 1").select("anchor", "segment", F.col("n").alias("_n"), F.col("n_segments").alias("_kinds"), F.col("least").alias("_least"))
    place = F.struct("_key", "_len", "at", "starts", "before")
    again = (
        kept.join(open_, ["anchor", "segment"]).where(place == F.col("_least"))
        .select("anchor", F.col("_n").alias("n"), F.col("_kinds").alias("n_segments"), "_key", "_len", "at", "starts", "before", "bytes")
    )
    return cut(again, "open-halves"), resolved


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position."""
    n = len(data) - GRAM + 1
    wide = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        wide |= data[k:k + len(wide)].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out += (wide[k:k + n] ^ ODD[40 + k]) * ODD[60 + k]
        out ^= out >> np.uint64(29)
    return mixed(out)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:len(x)] = x
    rows = rows.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def _parts(at: np.ndarray, min_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of texts: (first text, last text, begin, end); a long text is cut into pieces that overlap by a window."""
    for first, last in pieces(at):
        begin, end = int(at[first]), int(at[last])
        if last == first + 1:
            for b in range(begin, max(begin + 1, end - min_bytes + 1), CHUNK_BYTES):
                yield first, last, b, min(end, b + CHUNK_BYTES + min_bytes - 1)
        else:
            yield first, last, begin, end


def _anchored(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("_text"))
            key, length = np.asarray(batch.column("_key")), np.asarray(batch.column("_len"))
            for first, last, begin, end in _parts(at, min_bytes):
                borders = np.clip(at[first:last + 1], begin, end) - begin
                found = anchors(data[begin:end], borders, min_bytes)
                if found is None:
                    continue
                anchor, segment, n, start, starts, before, named = found
                text = np.searchsorted(borders, start, side="right") - 1
                place = start + begin - at[first + text]
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(anchor), mask=~named), pa.array(signed(segment), mask=~named), pa.array(n.astype(np.int32)),
                    pa.array(key[first + text]), pa.array(length[first + text]), pa.array(place.astype(np.int32)),
                    pa.array(starts.astype(np.int32)), pa.array(before.astype(np.int32)),
                ], ["anchor", "segment", "n", "_key", "_len", "at", "starts", "before"])

    return run


def anchors(data: np.ndarray, borders: np.ndarray, min_bytes: int):
    """Segments of a piece: anchor, hash of the bytes, count, first window, number of windows, bytes before the anchor.

    Equal segments of one piece come once, with their count; the others follow as unnamed ranges.
    """
    if len(data) < min_bytes:
        return None
    hashes = gram_hashes(data)
    low = (np.uint64(1) << _PLACE) - np.uint64(1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_minimum(keys, min_bytes - GRAM + 1) & low).astype(np.int64)
    room = np.zeros(len(chosen) + 1, bool)
    for b, e in zip(borders[:-1], borders[1:], strict=True):
        if e - b >= min_bytes:
            room[b:e - min_bytes + 1] = True
    room = room[:-1]
    new = room.copy()
    new[1:] &= (chosen[1:] != chosen[:-1]) | ~room[:-1]
    closes = room.copy()
    closes[:-1] &= (chosen[1:] != chosen[:-1]) | ~room[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(closes) + 1
    if not len(start):
        return None
    at = chosen[start]
    anchor, before, starts = hashes[at], at - start, stop - start
    segment = SubstringHash(data).of(start, stop + min_bytes - 1) ^ mixed(before.astype(np.uint64) * ODD[50] + ODD[51])
    one, times = _distinct(anchor, segment)
    named = np.zeros(len(start), bool)
    named[one] = True
    n = np.zeros(len(start), np.int64)
    n[one] = times
    rest = np.flatnonzero(~named)
    if len(rest):
        follows = np.zeros(len(rest), bool)
        follows[1:] = start[rest[1:]] == stop[rest[:-1]]
        heads = np.flatnonzero(~follows)
        tails = np.append(heads[1:], len(rest)) - 1
        run_start, run_stop = start[rest[heads]], stop[rest[tails]]
    else:
        run_start = run_stop = np.zeros(0, np.int64)
    none = np.zeros(len(run_start), np.uint64)
    join = lambda a, b: np.concatenate([a[one], b])
    return (
        join(anchor, none), join(segment, none), join(n, none.astype(np.int64)), join(start, run_start), join(starts, run_stop - run_start),
        join(before, none.astype(np.int64)), np.arange(len(one) + len(none)) < len(one),
    )


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct pair, and how often the pair occurs."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.append(heads, len(order)))


def _segments(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("_text"))
            lists = batch.column("_places")
            own = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            place = lists.flatten()
            begin = at[own] + np.asarray(place.field("at"))
            end = begin + np.asarray(place.field("starts")) + min_bytes - 1
            names = ["anchor", "n", "n_segments", "_key", "_len", "at", "starts", "before"]
            for i in range(0, len(own), 8192):
                part = slice(i, i + 8192)
                taken = pa.array([data[b:e].tobytes() for b, e in zip(begin[part], end[part], strict=True)], pa.binary())
                sliced = place.slice(i, 8192)
                rows = pa.array(own[part])
                columns = [batch.column(c).take(rows) if c in ("_key", "_len") else sliced.field(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, taken], [*names, "bytes"])

    return run


def _compared(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed_groups(batches, ["anchor"], BLOCK_BYTES // (min_bytes + GRAM)):
            table = table.combine_chunks()
            anchor = np.asarray(table.column("anchor"))
            n = np.asarray(table.column("n"))
            segments = table.column("bytes").to_pylist()
            starts, at = np.asarray(table.column("starts")), np.asarray(table.column("at"))
            again = repeated_windows(segments, starts, anchor, min_bytes)
            owner = np.repeat(np.arange(len(n)), starts)
            again &= n[owner] == 1  # segments that occur twice have been taken out already
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
            head = again.copy()
            head[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
            tail = again.copy()
            tail[:-1] &= ~again[1:] | (owner[1:] != owner[:-1])
            head, tail = np.flatnonzero(head), np.flatnonzero(tail)
            if len(head):
                rows = owner[head]
                lo, hi = at[rows] + offset[head], at[rows] + offset[tail] + min_bytes
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.asarray(table.column("_key"))[rows]), pa.array(np.asarray(table.column("_len"))[rows]),
                    pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                ], ["_key", "_len", "lo", "hi"])

    return run


def repeated_windows(segments: list[bytes], starts: np.ndarray, anchor: np.ndarray, min_bytes: int) -> np.ndarray:
    """For each window of each segment, whether an equal one is in another segment of the same anchor."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff" * (min_bytes + 8), np.uint8)
    size = np.array([len(s) + 1 for s in segments])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(segments)), starts)
    window = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(len(owner))
    number = np.full(len(text), -1, np.int64)
    number[window] = np.arange(len(window))
    order = suffix_array(text, min_bytes)
    order = order[number[order] >= 0]
    prefix = common_prefix(text, order, min_bytes)
    same = (prefix >= min_bytes) & (anchor[owner[number[order[1:]]]] == anchor[owner[number[order[:-1]]]])
    out = np.zeros(len(window), bool)
    out[number[order[1:][same]]] = True
    out[number[order[:-1][same]]] = True
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    Only suffixes that are smaller than their successor are sorted directly.  The others are induced by one scan over
    the buckets of first bytes: when a suffix is met, the one before it, if it is larger, takes the next place in its
    own bucket.  ``text`` must end with ``depth`` bytes that are larger than any other.
    """
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    end_of_run = np.flatnonzero(differs)
    run = np.searchsorted(end_of_run, np.arange(n))
    rises = np.append(text[:-1] < text[1:], False)
    smaller = rises[end_of_run[run]]  # than the successor; equal bytes follow the end of their run
    direct = np.flatnonzero(smaller[:n - depth])
    direct = direct[_sorted_windows(text, direct, depth)]
    count = np.bincount(text, minlength=256)
    placed = [[] for _ in range(256)]  # induced suffixes, in order
    direct_of = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    out = np.empty(n, np.int64)
    filled = 0
    for byte in range(256):
        if not count[byte]:
            continue
        # suffixes of this bucket induced by earlier ones come first, then those they induce in the same bucket
        wave = np.concatenate(placed[byte]) if placed[byte] else np.zeros(0, np.int64)
        if byte == text[-1]:
            wave = np.concatenate([[n - 1], wave])
        own = []
        while len(wave):
            own.append(wave)
            wave = _induce(text, smaller, wave, byte, placed)
        own.append(direct_of[byte])
        _induce(text, smaller, direct_of[byte], byte, placed)
        own = np.concatenate(own)
        out[filled:filled + len(own)] = own
        filled += len(own)
    return out[:filled]


def _induce(text: np.ndarray, smaller: np.ndarray, met: np.ndarray, byte: int, placed: list[list[np.ndarray]]) -> np.ndarray:
    """Puts the larger predecessors of suffixes into their buckets; gives back those of the same bucket."""
    before = met[met > 0] - 1
    before = before[~smaller[before]]
    first = text[before]
    same = before[first == byte]
    other = before[first != byte]
    if len(other):
        order = np.argsort(text[other], kind="stable")
        other = other[order]
        first = text[other]
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        for b, part in zip(first[heads], np.split(other, heads[1:]), strict=True):
            placed[b].append(part)
    return same


def text_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number that orders like them."""
    wide = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        wide |= text[k:k + len(wide)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return wide


def _sorted_windows(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order of the windows at some positions: by eight bytes at a time, going on only where they are equal."""
    wide = text_words(text)
    order = np.argsort(wide[at], kind="stable")
    value = wide[at[order]]
    group = np.cumsum(np.append(False, value[1:] != value[:-1]))
    for k in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        value = wide[np.minimum(at[order[tied]] + k, len(wide) - 1)]
        again = np.lexsort((value, group[tied]))
        order[tied] = order[tied][again]
        value, kin = value[again], group[tied]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        split = np.append(False, (value[1:] != value[:-1]) & (kin[1:] == kin[:-1]))
        new[tied[split]] = True
        group = np.cumsum(new)
    return order


def common_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of neighbours, ``depth`` at most."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    wide = text_words(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = wide[x] ^ wide[y]
        same = np.where(differ == 0, 8, 0)
        for k in range(7, 0, -1):
            same = np.where((differ != 0) & (same == 0) & ((differ >> np.uint64(64 - 8 * k)) == 0), k, same)
        out[live] += same
        live = live[(same == 8) & (out[live] < depth)]
    return np.minimum(out, depth)


def _half(min_bytes: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ["segment", *batch.schema.names]}
            for row in batch.to_pylist():
                whole, far = row["bytes"], row["before"]
                near = far - row["starts"] + 1  # bytes from the last window's start to the anchor
                for low in range(near // width * width, far + 1, width):
                    bottom, top = max(near, low), min(far, low + width - 1)
                    part = whole[far - top:far - bottom + min_bytes]
                    core = whole[far - low:far - (low + width - 1) + min_bytes]  # what all these windows share
                    out["anchor"].append(_name(core, low))
                    out["segment"].append(_name(part, top))
                    out["at"].append(row["at"] + far - top)
                    out["starts"].append(top - bottom + 1)
                    out["before"].append(top)
                    out["bytes"].append(part)
                    for c in ("n", "n_segments", "_key", "_len"):
                        out[c].append(row[c])
            schema = pa.schema([pa.field("segment", pa.int64()), *batch.schema])
            yield pa.RecordBatch.from_pydict({c: out[c] for c in schema.names}, schema)

    return run


def _name(data: bytes, place: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=b"%d" % place).digest(), "little", signed=True)


def _removed(n_carried: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("_text"))
            lists = batch.column("_spans")
            removed, runs, kept = [], [], []
            for i in range(batch.num_rows):
                text = data[at[i]:at[i + 1]]
                spans = lists[i]
                if spans.is_valid:
                    lo, hi = merged(np.asarray(spans.values.field("lo")), np.asarray(spans.values.field("hi")))
                    edge = np.zeros(len(text) + 1, np.int8)
                    edge[lo], edge[hi] = 1, -1
                    stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
                    removed.append(int((hi - lo).sum()))
                    runs.append(len(lo))
                    kept.append(text[stays].tobytes())
                else:
                    removed.append(0)
                    runs.append(0)
                    kept.append(text.tobytes())
            columns = [
                batch.column("_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), *[batch.column(f"_c{i}") for i in range(n_carried)]]
            yield pa.RecordBatch.from_arrays(
                columns, ["_id", "n_bytes", "n_removed", "n_spans", "kept", *[f"_c{i}" for i in range(n_carried)]])

    return run


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that overlap or touch."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order].astype(np.int64), np.maximum.accumulate(hi[order]).astype(np.int64)
    head = np.append(True, lo[1:] > reach[:-1])
    return lo[head], reach[np.append(head[1:], True)]
