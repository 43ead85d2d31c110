"""Small helpers of the corpus operators: written tables, Arrow text access, hashing of words and shingles in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import scratch_path

CHUNK_BYTES = 1 << 20  # texts are worked on in pieces of about this size, so memory does not grow with a batch
SHINGLE_WORDS = 5
BATCH_ROWS = 2000


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later failures reread files instead of recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows for this session: the rows are whole texts, of which a worker and its JVM hold copies."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def text_column(df: DataFrame, text: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(df[quoted(text)].cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string() if not pa.types.is_large_binary(column.type) else column.type), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, at


def pieces(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, at least one text each."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


# Any fixed random numbers do: they only have to be the same on every machine.
_RANDOM = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _RANDOM.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the base and of its inverse, kept for one worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n > 4 * CHUNK_BYTES:
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


class SubstringHash:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        self.up, self.down = Powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def word_ranges(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the words (``[^\\x20\\x09-\\x0D]+``) of texts, and the number of words of each.

    ``data`` holds the bytes of the texts and ``at`` their borders, from 0.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = ~separator[data]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.diff(np.searchsorted(begin, at))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts after A-Z are lower-cased, and the number of words of each."""
    begin, end, counts = word_ranges(data, at)
    return lowered_hash(data).of(begin, end), counts


def lowered_hash(data: np.ndarray) -> SubstringHash:
    """Hashes of byte ranges that do not tell A-Z from a-z."""
    return SubstringHash(data, _LOWER_BYTE)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, and the number for each text.

    A text of fewer words gives its whole sequence as one shingle; one without words gives none.
    """
    out = np.zeros(len(words), np.uint64)
    border = np.concatenate([[0], np.cumsum(counts)])
    full = np.zeros(len(words), bool)
    long = len(words) - size + 1
    if long > 0:
        for k in range(size):
            out[:long] += words[k:k + long] * ODD[k]
        text_of = np.repeat(np.arange(len(counts)), counts)
        full[:long] = text_of[:long] == text_of[size - 1:]
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        begin, end = border[k], border[k + 1]
        out[begin:begin + 1] = (words[begin:end] * ODD[:end - begin]).sum(keepdims=True) + ODD[size + counts[k]:][:1]
        full[begin] = True
    return mixed(out[full]), np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text: (first text, last text, sets), piece by piece."""
    data, at = utf8(column)
    for first, last in pieces(at):
        own = at[first:last + 1]
        words, counts = word_hashes(data[own[0]:own[-1]], own - own[0])
        hashes, counts = shingle_hashes(words, counts, size)
        yield first, last, [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: str | None = None) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by ``keys``, several small groups together: about ``rows`` rows (or, with
    ``size``, about that sum of a column) at a time.  Only a single group may be larger."""
    held, amount = [], 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = 0
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
        last = tuple(c[-1] for c in columns)
        weight = np.cumsum(np.asarray(batch.column(size)) if size else np.ones(batch.num_rows, np.int64))
        for border in np.flatnonzero(change):
            so_far = amount + (weight[border - 1] if border else 0) - (weight[begin - 1] if begin else 0)
            if so_far >= rows:
                if border > begin:
                    held.append(batch.slice(begin, border - begin))
                yield pa.Table.from_batches(held)
                held, amount, begin = [], 0, border
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
            amount += int(weight[-1] - (weight[begin - 1] if begin else 0))
    if held:
        yield pa.Table.from_batches(held)
