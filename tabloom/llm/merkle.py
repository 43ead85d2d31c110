"""Merkle manifest of a dataset by time-forward processing.

Leaves are digests of rows.  The leaves of a tree (one for each value of ``tree``) lie in key order; every ``FAN`` nodes in a row
make a parent, until one is left, the tree's subroot.  Subroots, in order of their tree's value, make the root likewise.

* Leaves are ordered by a range sort over (tree, key), so a tree with most of the rows is spread like any other; their numbers
  are places in their partition plus the partition's offset.
* Up: nodes are labelled (tree, block, level, number).  The shuffle sorts digests by the label of the block that receives
  them, and inside a block (``FAN ** BLOCK_LEVELS`` leaves of a tree) a priority queue ordered by label hands each digest to its parent.
  A block's root is a leaf of the next round; rounds are written, and each is ``FAN ** BLOCK_LEVELS`` times smaller.
* Down: the sweep runs in reverse.  A block receives its root's path to the top, a queue ordered by descending label
  extends it from parent to child, and so every leaf gets the suffix of its proof.

A task holds one block.  Texts are read once and never shuffled; what is sorted is a digest of 32 bytes or two for each row.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tabloom.llm.common import cut, quoted

FAN_BITS = 3
FAN = 1 << FAN_BITS
BLOCK_LEVELS = 3
BROADCAST_ROWS = 200_000  # offsets of partitions up to this many are sent everywhere, more are joined by a shuffle
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Chain = tuple  # (place in its run, the run's digests, the chain of the parent), or () at the top


def digest(*parts: bytes) -> bytes:
    """Hexadecimal SHA-256 of the parts in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: str | None) -> bytes:
    if value is None:
        return b"-"
    raw = value.encode()
    return b"%d:%s" % (len(raw), raw)


def lowered_third(key: str | None, values: list[str | None]) -> list[str | None]:
    """The test of a manifest: where 3 divides the key's checksum, the last field has its A-Z lower-cased."""
    if key is None or values[-1] is None or zlib.crc32(key.encode()) % 3:
        return values
    return [*values[:-1], values[-1].encode().lower().decode()]


def leaves(docs: DataFrame, key: str, tree: str, fields: tuple[str, ...], tamper: Callable | None) -> DataFrame:
    """(id, tree, leaf, altered), written: ``altered`` is the leaf of the tampered row where that differs."""
    n = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, altered = [], []
            columns = [batch.column(i) for i in range(3, 3 + n)]
            for k, name in enumerate(batch.column(2)):
                row = [c[k].as_py() for c in columns]
                found.append(hashlib.sha256(b"".join(map(field, row))).digest())
                other = tamper(name.as_py(), row) if tamper else row
                altered.append(None if other == row else hashlib.sha256(b"".join(map(field, other))).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(altered, pa.binary())], ["id", "tree", "leaf", "altered"])

    text = lambda c: docs[quoted(c)].cast("string")
    # a missing value comes before all others, which are compared byte by byte
    rows = docs.select(
        docs[quoted(key)].alias("id"), F.coalesce(F.concat(F.lit("="), text(tree)), F.lit("")).alias("tree"), text(key).alias("name"),
        *[text(c).alias(f"f{i}") for i, c in enumerate(fields)])
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, tree string, leaf binary, altered binary")
    return cut(found.withColumn("row", F.monotonically_increasing_id()), "leaves")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``, the place of a row in its tree, and ``n``, the tree's number of rows; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column("tree").to_pylist():
                place = place + 1 if tree == last else 0
                last = tree
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([task] * len(places), pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "task", "place"])

    keys = ["tree", *order]
    ascending = [F.col(k).asc_nulls_first() for k in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["task long", "place long"])
    placed = cut(rows.repartitionByRange(*ascending).sortWithinPartitions(*ascending).mapInArrow(run, schema), "ordered")
    # at most one row for each partition and one for each tree
    sizes = placed.groupBy("tree", "task").agg(F.count(F.lit(1)).alias("_size"))
    of_tree = Window.partitionBy("tree")
    offsets = cut(sizes.select(
        "tree", "task", F.sum("_size").over(of_tree).alias("n"),
        (F.sum("_size").over(of_tree.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_offset")), "offsets")
    small = offsets.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(offsets) if small else offsets, ["tree", "task"])
    return joined.withColumn("i", F.col("_offset") + F.col("place")).drop("task", "place", "_offset")


def levels(n: int, most: int) -> int:
    """Levels above ``n`` leaves, of the ``most`` in one block."""
    k = 0
    while k < most and FAN ** k < n:
        k += 1
    return k


def swept_up(found: list[bytes], height: int) -> list[list[bytes]]:
    """Digests of a block's nodes, level by level.  Messages to parents are taken in the order of the parents' labels."""
    nodes = [found, *[[] for _ in range(height)]]
    queue = [(1, k // FAN, k, d) for k, d in enumerate(found)] if height else []  # in order, so a heap
    while queue:
        level, number = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, number):
            children.append(heapq.heappop(queue)[3])
        nodes[level].append(digest(*children))
        if level < height:
            heapq.heappush(queue, (level + 1, number // FAN, number, nodes[level][-1]))
    return nodes


def swept_down(nodes: list[list[bytes]], proof: bytes, chain: Chain) -> list[tuple[bytes, Chain]]:
    """Proof (siblings in a row, level by level) and chain of each of a block's leaves, given those of its root."""
    height = len(nodes) - 1
    out: list = [None] * len(nodes[0])
    queue = [(-height, 0, proof, chain)]
    while queue:
        level, number, proof, chain = heapq.heappop(queue)
        if not level:
            out[number] = proof, chain
            continue
        first = number * FAN
        run = nodes[-level - 1][first:first + FAN]
        for k in range(len(run)):
            message = (level + 1, first + k, b"".join(run[:k] + run[k + 1:]) + proof, (k, run, chain))
            if level == -1:
                out[first + k] = message[2:]
            else:
                heapq.heappush(queue, message)
    return out


def packed(chain: Chain) -> bytes:
    out = []
    while chain:
        k, run, chain = chain
        out.append(bytes([k, len(run)]) + bytes.fromhex(b"".join(run).decode()))
    return b"".join(out)


def unpacked(path: bytes) -> tuple[bytes, Chain]:
    """Proof and chain of a written path."""
    steps, at = [], 0
    while at < len(path):
        k, n = path[at], path[at + 1]
        steps.append((k, [path[at + 2 + 32 * j:at + 34 + 32 * j].hex().encode() for j in range(n)]))
        at += 2 + 32 * n
    proof = b"".join(b"".join(run[:k] + run[k + 1:]) for k, run in steps)
    chain: Chain = ()
    for k, run in reversed(steps):
        chain = (k, run, chain)
    return proof, chain


def folded(leaf: bytes, chain: Chain) -> bytes:
    """The root that follows from a leaf and its siblings."""
    while chain:
        k, run, chain = chain
        leaf = digest(*run[:k], leaf, *run[k + 1:])
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """Rows of each (tree, block), which are the first two columns of a sorted stream."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for (tree, block), own in itertools.groupby(rows, lambda r: r[:2]):
        yield tree, block, list(own)


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Rounds of (tree, i, n, digest): the given one, then block roots, until every tree has one node."""
    size = FAN ** depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in _blocks(batches):
            n = rows[0][3]
            root = swept_up([r[4].hex().encode() for r in rows], levels(n, depth))[-1][0]
            yield pa.RecordBatch.from_arrays([
                pa.array([tree], pa.string()), pa.array([block], pa.int64()), pa.array([-(-n // size)], pa.int64()),
                pa.array([bytes.fromhex(root.decode())], pa.binary())], ["tree", "i", "n", "digest"])

    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = rounds[-1].select("tree", _block(depth).alias("block"), "i", "n", "digest")
        rounds.append(cut(
            below.repartition("tree", "block").sortWithinPartitions("tree", "block", "i").mapInArrow(run, "tree string, i long, n long, digest binary"),
            "tree-round"))
        most = -(-most // size)
    return rounds


def _block(depth: int) -> Column:
    return F.shiftright("i", depth * FAN_BITS)


def descended(rounds: list[DataFrame], depth: int, tops: DataFrame, carry: list[str], finish: Callable, schema: str) -> DataFrame:
    """Paths of the leaves, from (tree, i, path, subroot, root) of each tree's last node.

    ``finish`` makes a result row of (a leaf's carried columns, its digest, subroot, root, proof, chain).
    """
    parents = tops
    for k, nodes in reversed(list(enumerate(rounds))):
        own = carry if k == 0 else []
        kinds = {c: nodes.schema[c].dataType for c in own}
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        above = parents.select("tree", F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("n"),
                               none("digest", "binary"), "path", "subroot", "root", *[none(f"_{c}", kinds[c]) for c in own])
        below = nodes.select("tree", _block(depth).alias("block"), "i", "n", "digest", *[none(c, "binary") for c in ("path", "subroot", "root")],
                             *[F.col(c).alias(f"_{c}") for c in own])
        rows = above.union(below).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
        if k == 0:
            return rows.mapInArrow(_down(finish, depth), schema)
        parents = cut(rows.mapInArrow(_down(None, depth), "tree string, i long, path binary, subroot binary, root binary"), "tree-paths")


def _down(finish: Callable | None, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("i", pa.int64()), *[(c, pa.binary()) for c in ("path", "subroot", "root")]])
        for tree, _, (top, *rows) in _blocks(batches):
            path, subroot, root = top[5:8]
            nodes = swept_up([r[4].hex().encode() for r in rows], levels(rows[0][3], depth))
            found = swept_down(nodes, *unpacked(path))
            if finish is None:
                out = [(tree, r[2], packed(chain), subroot, root) for r, (_, chain) in zip(rows, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            else:
                yield finish([(r[8:], leaf, subroot, root, *x) for r, leaf, x in zip(rows, nodes[0], found, strict=True)])

    return run


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS,
             tamper: Callable | None = None, with_proofs: bool = False, depth: int = BLOCK_LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    A leaf is the digest of the row's fields, each ``-`` if null, else its length in bytes, a colon and its value.  ``tamper`` takes the
    key and the values of the fields and gives those that a leaf is checked with: ``folded_root`` is what follows from it and
    the siblings, ``verified`` whether that is the root.  ``with_proofs`` adds ``proof``, the siblings' digests in a row.
    ``depth``: levels of a tree in one block.

    Nulls: a null key comes first in its tree; rows without a tree's value are a tree of their own, before all others.  Rows with
    equal keys are ordered by their leaves, equal rows in any order.  Empty and very long texts are values like others.  An
    empty table gives an empty result; columns that are not fields are not looked at.
    """
    found = leaves(docs, key, tree, fields, tamper).withColumn("digest", F.col("leaf"))
    rows = numbered(found, ["id", "leaf", "row"]).drop("leaf", "row")
    rounds = climbed(rows, depth)
    subroots = rounds[-1].select("tree", "digest")

    # the subroots are leaves of one more tree
    upper = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest"), ["id"])
    upper_rounds = climbed(upper, depth)
    top = upper_rounds[-1].select("tree", "i", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def of_tree(found: list) -> pa.RecordBatch:
        out = [(carried[0], 0, packed(chain), bytes.fromhex(leaf.decode()), root) for carried, leaf, _, root, _, chain in found]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["tree", "i", "path", "subroot", "root"])

    tops = cut(descended(upper_rounds, depth, top, ["id"], of_tree, "tree string, i long, path binary, subroot binary, root binary"), "subroots")
    kind = rows.schema["id"].dataType
    arrow_kind = to_arrow_type(kind)

    def of_row(found: list) -> pa.RecordBatch:
        out = []
        for (name, altered), leaf, subroot, root, proof, chain in found:
            back = folded(altered.hex().encode() if altered is not None else leaf, chain).decode()
            out.append((name, leaf.decode(), subroot.hex(), root.hex(), hashlib.sha256(proof).hexdigest(), back, back == root.hex(), proof.decode()))
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
        kinds = [arrow_kind, *[pa.string()] * 5, pa.bool_(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays(columns if with_proofs else columns[:-1], names if with_proofs else names[:-1])

    schema = f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descended(rounds, depth, tops, ["id", "altered"], of_row, schema + (", proof string" if with_proofs else "")).withColumnsRenamed({"id": key})
