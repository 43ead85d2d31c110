"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers and the characters up to the next marker.  No piece of the models taken here holds
a marker behind another character (checked on loading), so no piece crosses a chunk's border and a chunk has the same
ids wherever it stands.  A task numbers the chunks of its texts, segments each distinct one once, and joins the ids back
by the chunk's number at every position.  Texts never leave their task and nothing is shuffled.

What a task holds is bounded: texts are worked on in portions of 1 MB, cut where a new chunk begins; the table is
forgotten beyond ``TABLE_CHARS``; a chunk longer than ``LONG_CHUNK`` is segmented in parts, cut between characters that are
neighbours in no piece.  Only a run of over ``LONG_CHUNK`` characters without such a place is segmented whole.

The model file's path is a parameter.  The file's bytes (half a MB, whatever the data) go to the tasks.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tabloom.llm.bpe import spread
from tabloom.llm.common import quoted, text_column

MARK = "▁"
PORTION_CHARS = 1 << 20
TABLE_CHARS = 1 << 22  # characters of chunks whose ids a task remembers; forgetting them changes no result
LONG_CHUNK = 4096
CHUNKS = regex.compile(" *[^ ]+| +").findall
# a new chunk and, for byte-level tokenizers, a new word begin at a blank between two letters
WORD_BORDER = regex.compile(r"(?<=\p{L}) (?=\p{L})")


class Model:
    """A SentencePiece model file: its bytes and what each id stands for; small and picklable."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.proto)
        kinds = spec.SentencePiece
        normal = [p.piece for p in spec.pieces if p.type == kinds.NORMAL]
        plain = spec.normalizer_spec
        if plain.precompiled_charsmap or not plain.add_dummy_prefix or plain.remove_extra_whitespaces or not plain.escape_whitespaces:
            raise ValueError("the model must leave texts as they are, but for the marker that it puts before them")
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined pieces and markers behind words are not supported")
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a marker behind another character")
        self.bytes = [_bytes_of(p, kinds) for p in spec.pieces]
        self.is_byte = np.array([p.type == kinds.BYTE for p in spec.pieces])
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.mark = next(i for i, p in enumerate(spec.pieces) if p.piece == MARK)
        self.pairs = np.unique([_pair(ord(a), ord(b)) for p in normal for a, b in zip(p, p[1:])])
        used = set("".join(normal))
        self.guard = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)


def _bytes_of(piece, kinds) -> bytes:
    """What an id adds to a decoded text; the unknown piece adds a question mark of its own."""
    if piece.type == kinds.BYTE:
        return bytes([int(piece.piece[1:-1], 16)])
    if piece.type == kinds.CONTROL:
        return b""
    return (" ⁇ " if piece.type == kinds.UNKNOWN else piece.piece.replace(MARK, " ")).encode()


def _pair(a, b):
    return (a << 21) | b


class _Numbers(dict):
    """Gives each new chunk the next number."""

    def __missing__(self, chunk: str | bytes) -> int:
        self[chunk] = number = len(self)
        return number


class ChunkTable:
    """Ids of chunks, by number; one for a task.  ``readable``: also their decimals and what they decode to."""

    def __init__(self, model: Model, readable: bool = False):
        self.model, self.readable = model, readable
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        self.before = len(self.library.encode(model.guard))
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.chars = 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.shown: list[str] = []    # ids in decimals, joined by commas
        self.decoded: list[bytes] = []

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the chunks of each text, which begins with a blank; all are in the table afterwards."""
        if self.chars > TABLE_CHARS:
            self._forget()
        known, number = len(self.number), self.number.__getitem__
        out = [np.fromiter(map(number, own), np.int64, len(own)) for own in map(self._chunks, texts)]
        if len(self.number) > known:
            self._add(list(itertools.islice(self.number, known, None)))
        return out

    def _chunks(self, text: str) -> list[str | bytes]:
        """Chunks without the blank that each begins with; a later part of a long chunk as bytes."""
        text = text.replace(MARK, " ")
        found = text[1:].split(" ") if "  " not in text else [c[1:] for c in CHUNKS(text)]
        if len(max(found, key=len)) <= LONG_CHUNK:
            return found
        return [part for c in found for part in (self._parts(c) if len(c) > LONG_CHUNK else [c])]

    def _parts(self, chunk: str) -> list[str | bytes]:
        """A long chunk, cut between characters that are neighbours in no piece."""
        points = np.frombuffer((MARK + chunk.replace(" ", MARK)).encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = _pair(points[:-1], points[1:])
        slot = np.minimum(np.searchsorted(self.model.pairs, pairs), len(self.model.pairs) - 1)
        free = np.flatnonzero(self.model.pairs[slot] != pairs)
        free = free[free > 0]
        cuts, last = [0], 0
        for at in range(LONG_CHUNK, len(chunk), LONG_CHUNK):
            k = np.searchsorted(free, at)
            if k < len(free) and free[k] > last:
                last = int(free[k])
                cuts.append(last)
        parts = [chunk[b:e] for b, e in zip(cuts, [*cuts[1:], len(chunk)])]
        return [parts[0], *[p.encode() for p in parts[1:]]]

    def _add(self, chunks: list[str | bytes]) -> None:
        """Segments new chunks.  The library puts the marker before each; a later part of a long chunk stands behind a
        character that no piece holds, whose ids go again."""
        found = self.library.encode([c if isinstance(c, str) else self.model.guard + c.decode() for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if not c:
                found[k] = [self.model.mark]
            elif isinstance(c, bytes):
                found[k] = found[k][self.before:]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        if self.readable:
            held = self.model.bytes
            self.shown += [",".join(map(str, own)) for own in found]
            self.decoded += [b"".join([held[i] for i in own]) for own in found]
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (one more entry than texts)."""
        numbers = self.numbers(texts)
        flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        size = self.at[flat + 1] - self.at[flat]
        border = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(own) for own in numbers])]).astype(np.int64)]
        return self.ids[spread(self.at[flat], size)], border


def portions(texts: pa.Array, limit: int = PORTION_CHARS, without: str | None = None) -> Iterator[list[tuple[int, str]]]:
    """(row, part of its text) in lists of about ``limit`` characters.  A text gets a blank in front; long ones are cut at blanks
    between letters.  Null and empty texts have no part, nor have those that hold ``without``."""
    held, size = [], 0
    for row in range(len(texts)):
        text = texts[row].as_py()
        if not text or (without and without in text):
            continue
        text = " " + text
        at = 0
        while at < len(text):
            found = WORD_BORDER.search(text, at + limit) if len(text) - at > limit else None
            end = found.start() if found else len(text)
            held.append((row, text[at:end]))
            size += end - at
            at = end
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``, as the library encodes without begin and end ids.

    Null and empty texts have no ids.  The marker's own character counts as a blank, as in the library.  Repeated rows are
    encoded alike, an empty table gives an empty result, other columns are not looked at.
    """
    model = Model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for portion in portions(batch.column("text")):
                ids, at = table.encode([t for _, t in portion])
                for k, (row, _) in enumerate(portion):
                    parts[row].append(ids[at[k]:at[k + 1]])
            own = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]
            border = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate([*own, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(border, pa.array(flat))], ["id", "ids"])

    rows = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnsRenamed({"id": doc_id})


# U+FFFD for every byte that is not part of UTF-8
codecs.register_error("tabloom-each-byte", lambda e: ("\ufffd", e.start + 1))


def decoded(model: Model, ids: np.ndarray) -> str:
    """Text of any ids: the first marker goes, control ids add nothing, each byte that is not UTF-8 becomes U+FFFD."""
    out: list[str] = []
    first = True
    for is_byte, run in itertools.groupby(ids.tolist(), model.is_byte.__getitem__):
        if is_byte:
            out.append(b"".join([model.bytes[i] for i in run]).decode("utf-8", "tabloom-each-byte"))
            first = False
            continue
        for i in run:
            piece = model.bytes[i]
            out.append((piece.removeprefix(b" ") if first and i != model.unknown else piece).decode())
            first = first and not piece
    return "".join(out)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so ids never leave their task.

    ``ids_sha256`` is of the decimal ids joined by commas.  Nulls, empty, long and repeated texts, empty tables and other columns
    are treated as by ``encode``; a text without ids decodes to the empty text.
    """
    model = Model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, readable=True)
        for batch in batches:
            n = batch.num_rows
            tokens = np.zeros(n, np.int64)
            shown, texts = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for portion in portions(batch.column("text")):
                numbers = table.numbers([t for _, t in portion])
                sizes = np.diff(table.at)
                for (row, _), found in zip(portion, numbers, strict=True):
                    later = bool(tokens[row])
                    tokens[row] += int(sizes[found].sum())
                    own = found.tolist()
                    ids = ",".join([table.shown[i] for i in own])
                    shown[row].update(("," + ids if later else ids).encode())
                    back = b"".join([table.decoded[i] for i in own])
                    texts[row].update(back if later else back[1:])  # the first piece begins with the marker put there
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(tokens), pa.array([h.hexdigest() for h in shown], pa.string()),
                pa.array([h.hexdigest() for h in texts], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnsRenamed({"id": doc_id})
