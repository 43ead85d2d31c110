"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points ("pivots"), named by their rank in the order from rare to common.  Two
vectors are candidates when they share enough of them.  Postings hold ids only: shared pivots are counted first, and vectors
are fetched for rows that have a candidate.  These are verified by their cosine in double precision.

* Equal vectors of one label are one class with a weight, so copies cost one row.
* The number of pivots grows with the square root of the number of classes, up to ``MOST_PIVOTS``.  How many are looked at
  and how many must be shared is measured on the sample: sampled vectors are turned until their cosine is just ``at_least``,
  and all but ``LOST`` of these border cases must share that many.  Data that lie close together so get longer descriptions.
  Where nothing can be asked for, all vectors of a label are one list, and the result is exact.
* Vectors that share ``s`` of ``k`` pivots share two of the rarest ``k - s + 2``, so an inverted list is named by two pivots (by
  one where pairs would be too many).  A pair is counted in the list of its two smallest shared pivots only.
* A list is cut into blocks of ``BLOCK`` vectors and all pairs of blocks are worked on in tasks of their own.  A block pair gives
  back link counts for each vector and a spanning forest of its links: rows in proportion to members, not to pairs.

Pivots come from a bounded sample of the vectors (four times their number, with the smallest hashes); those linked with an
earlier one are left out, as a group of near copies must not take all pivots nearby.  Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ODD, cut, mixed, quoted, signed, streamed_groups
from tabloom.llm.components import components, of_root
from tabloom.operators.ranking import lookup

LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
DEPTHS = (8, 16, 32, 64)   # how many of the nearest pivots may describe a vector
PASSING = 0.005        # the smallest depth is taken at which fewer unlinked pairs are candidates
LOST = 0.001          # border cases that may share fewer pivots than are asked for
TURNED = 4000          # border cases measured
MOST_LISTS = 128       # lists of a vector, beyond which lists are named by one pivot
BLOCK = 512
NODE = "struct<h1: long, h2: long>"


class Reference(NamedTuple):
    """Pivots of one length of vectors, from rare to common, and how descriptions by them are compared."""

    pivots: np.ndarray
    depth: int   # pivots that describe a vector
    shared: int  # pivots that candidates share
    named: int   # pivots that name a list


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 at_least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows are compared when their labels are equal and not null and their vectors have one length, and are linked with a
    cosine of ``at_least`` or more.  ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that
    links lead to, ``kept`` marks that row.

    Vectors that are null, empty, all zero or hold a null or non-finite component have no links, as have rows with a null
    label; they are kept.  Repeated rows and equal vectors are linked with each other.  A null id is never the smallest while
    another one is there and is not kept.  An empty table gives an empty result; other columns are not looked at.
    """
    rows = vectors.select(
        vectors[quoted(vec_id)].alias("id"), vectors[quoted(label)].cast("string").alias("label"),
        vectors[quoted(vector)].cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & whole, F.lit(False))
    # 0.0 and -0.0 are one value, as are vectors that differ in it only
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("v", F.when(usable, plain)).withColumn(
        "node", F.when(usable, F.struct(F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2"))))
    classes = cut(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("id")),
        "vectors")
    found = cut(_links(classes, at_least), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b IS NOT NULL"))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = (
        of_root(named, smallest, ["component_id"]).join(counts, "node", "left")
        .select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    out = rows.select("id", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links(classes: DataFrame, at_least: float) -> DataFrame:
    """(a, null, n): n other rows linked with class a; (a, b, null): links that connect all linked classes."""
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, 5 * isqrt(classes.count()) // 2))
    sample = classes.orderBy("node.h1", "node.h2").limit(4 * pivots).select("v").toArrow().column("v").to_pylist()
    references = reference_points(sample, pivots, at_least)
    described = cut(
        classes.select("node", F.xxhash64("label", F.size("v")).alias("place"), "weight", "v").mapInArrow(
            _described(references),
            f"node {NODE}, place long, weight long, v array<double>, near array<smallint>, lists array<struct<list: long, last: smallint>>"),
        "described")
    posted = described.select("node", "place", F.size("v").alias("dim"), "near", F.inline("lists"))
    sizes = cut(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "lists")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    task = F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other"))
    paired = (
        lookup(posted, sizes, ["list"], ["blocks"], total, None).where("blocks IS NOT NULL")
        .withColumn("block", block).withColumn("other", other)
        .select(
            task.alias("task"), "last", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"),
            "node", "place", "dim", "near")
    )
    asked = {dim: (r.shared, r.named) for dim, r in references.items()}
    candidates = cut(
        paired.repartition("task").sortWithinPartitions("task")
        .mapInArrow(_candidates(asked, pivots), f"task long, last smallint, left boolean, right boolean, node {NODE}"),
        "candidates")
    fetched = candidates.join(described.select("node", "place", F.size("v").alias("dim"), "near", "weight", "v"), "node")
    return (
        fetched.repartition("task").sortWithinPartitions("task")
        .mapInArrow(_verified(at_least, asked, pivots), f"a {NODE}, b {NODE}, n long")
    )


def reference_points(sample: list[list[float]], pivots: int, at_least: float) -> dict[int, Reference]:
    """Reference points by length of vector, ``pivots`` at most."""
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for dim, rows in by_length.items():
        rows = unit(np.array(rows))
        taken: list[int] = []
        for i in range(len(rows)):
            if len(taken) < pivots and (not taken or (rows[taken] @ rows[i]).max() < at_least):
                taken.append(i)
        out[dim] = _measured(rows, rows[taken], at_least)
    return out


def _measured(rows: np.ndarray, points: np.ndarray, at_least: float) -> Reference:
    random = np.random.Generator(np.random.PCG64(len(rows)))
    one, two, three = random.integers(0, len(rows), (3, TURNED))
    x, away = rows[one], rows[two] - rows[three]
    away = away - (away * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    turned = at_least * x + np.sqrt(1 - at_least ** 2) * away / np.maximum(length, 1e-9)
    apart = (x * rows[two]).sum(axis=1) < at_least
    near, near_turned, near_other = (np.argsort(-(v @ points.T), axis=1, kind="stable") for v in (x, turned, rows[two]))
    best = None
    for depth in DEPTHS:
        depth = min(depth, len(points))
        own = _held(near[:, :depth], len(points))
        kept = (own & _held(near_turned[:, :depth], len(points))).sum(axis=1)
        shared = int(np.quantile(kept, LOST))
        passing = float(((own & _held(near_other[:, :depth], len(points))).sum(axis=1) >= shared)[apart].mean()) if apart.any() else 0.0
        if best is None or passing < best[0]:
            best = passing, depth, shared, own.sum(axis=0)
        if passing < PASSING:
            break
    _, depth, shared, times = best
    named = min(shared, 2)
    if named == 2 and comb(depth - shared + 2, 2) > MOST_LISTS:
        named = 1
    return Reference(points[np.argsort(times, kind="stable")], depth, shared, named)


def _held(near: np.ndarray, pivots: int) -> np.ndarray:
    held = np.zeros((len(near), pivots), bool)
    np.put_along_axis(held, near, True, axis=1)
    return held


def _described(references: dict[int, Reference]):
    none = Reference(np.zeros((0, 0)), 0, 0, 0)  # a length that is not in the sample: one list for all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.asarray(whole.column("v").value_lengths())
            for dim in np.unique(lengths):
                r = references.get(int(dim), none)
                batch = whole.take(pa.array(np.flatnonzero(lengths == dim)))
                n, place = batch.num_rows, np.asarray(batch.column("place")).view(np.uint64)
                near = np.zeros((n, 0), np.int64)
                if r.depth:
                    v = unit(np.asarray(batch.column("v").flatten()).reshape(n, dim))
                    near = np.sort(np.argsort(-(v @ r.pivots.T), axis=1, kind="stable")[:, :r.depth], axis=1)
                names = np.array(list(combinations(range(r.depth - r.shared + r.named), r.named)), np.int64)
                name, last = place[:, None] * ODD[400] + np.zeros(len(names), np.uint64), np.full((n, len(names)), -1, np.int16)
                for i in range(r.named):
                    part = near[:, names[:, i]]
                    name = mixed(name + (part.astype(np.uint64) + np.uint64(1)) * ODD[401 + i])
                    last = part.astype(np.int16)
                lists = pa.StructArray.from_arrays([pa.array(signed(name.ravel())), pa.array(last.ravel())], ["list", "last"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("node"), batch.column("place"), batch.column("weight"), batch.column("v"),
                    pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * r.depth, pa.array(near.ravel().astype(np.int16))),
                    pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(names), lists),
                ], ["node", "place", "weight", "v", "near", "lists"])

    return run


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Tasks:
    """Whole block pairs of inverted lists, some at a time, as numpy columns."""

    PAIRS = 1 << 17  # pairs counted at once
    DENSE = 64       # from this size on, the pairs of a block pair are counted by a matrix product

    def __init__(self, table: pa.Table, asked: dict[int, tuple[int, int]], pivots: int):
        table = table.combine_chunks()
        self.column = {c: pa.concat_arrays(table.column(c).chunks) for c in table.column_names}
        task = np.asarray(self.column["task"])
        self.heads = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        self.ends = np.append(self.heads[1:], len(task))
        self.left, self.right, self.place, self.last, self.dim = (np.asarray(self.column[c]) for c in ("left", "right", "place", "last", "dim"))
        shared, named = np.array([asked.get(d, (0, 0)) for d in self.dim.tolist()]).T
        self.shared, self.named = shared, named
        near, depth = np.asarray(self.column["near"].flatten()), np.asarray(self.column["near"].value_lengths())
        words = -(-pivots // 64)
        self.held = np.zeros((len(task), 64 * words), bool)
        self.held[np.repeat(np.arange(len(task)), depth), near] = True
        self.bits = np.packbits(self.held, axis=1, bitorder="little").view(np.uint64)
        upto = np.tri(64 * words + 1, 64 * words, -1, dtype=bool)  # row i: pivots before i
        self.before = np.packbits(upto, axis=1, bitorder="little").view(np.uint64)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y), x before y, that share enough pivots and have their smallest shared ones in the name of their list."""
        sizes = self.ends - self.heads
        for begin, end in zip(self.heads[sizes >= self.DENSE], self.ends[sizes >= self.DENSE], strict=True):
            held = self.held[begin:end, self.held[begin:end].any(axis=0)].astype(np.float32)
            first = self.held[begin:end, :self.last[begin] + 1].astype(np.float32)
            found = (held @ held.T >= self.shared[begin]) & (first @ first.T == self.named[begin])
            x, y = np.nonzero(np.triu(found, 1))
            yield self._met(begin + x, begin + y)
        small = sizes < self.DENSE
        rows = np.repeat(self.ends[small], sizes[small])
        x = np.flatnonzero(np.repeat(small, sizes))
        times = rows - x - 1
        total = np.cumsum(times)
        for begin in range(0, int(total[-1]) if len(total) else 0, self.PAIRS):
            at = np.arange(begin, min(begin + self.PAIRS, total[-1]))
            who = np.searchsorted(total, at, side="right")
            a = x[who]
            b = a + 1 + at - (total[who] - times[who])
            common = self.bits[a] & self.bits[b]
            enough = np.bitwise_count(common).sum(axis=1) >= self.shared[a]
            own = np.bitwise_count(common & self.before[self.last[a] + 1]).sum(axis=1) == self.named[a]
            yield self._met(a[enough & own], b[enough & own])

    def _met(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = (self.left[x] & self.right[y] | self.left[y] & self.right[x]) & (self.place[x] == self.place[y])
        return x[met], y[met]


def _candidates(asked: dict[int, tuple[int, int]], pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed_groups(batches, ["task"], 2 * BLOCK):
            tasks = Tasks(table, asked, pivots)
            some = np.zeros(table.num_rows, bool)
            for x, y in tasks.candidates():
                some[x] = some[y] = True
            if some.any():
                keep = pa.array(np.flatnonzero(some))
                names = ["task", "last", "left", "right", "node"]
                yield pa.RecordBatch.from_arrays([tasks.column[c].take(keep) for c in names], names)

    return run


def _verified(at_least: float, asked: dict[int, tuple[int, int]], pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed_groups(batches, ["task"], 2 * BLOCK):
            tasks = Tasks(table, asked, pivots)
            weight, node, values = np.asarray(tasks.column["weight"]), tasks.column["node"], np.asarray(tasks.column["v"].flatten())
            at = np.cumsum(tasks.dim, dtype=np.int64) - tasks.dim
            root = np.arange(table.num_rows)
            others = np.zeros(table.num_rows, np.int64)
            a, b = [], []
            for x, y in tasks.candidates():
                x, y = linked(values, at, tasks.dim, x, y, at_least)
                np.add.at(others, x, weight[y])
                np.add.at(others, y, weight[x])
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    while root[j] != j:
                        root[j] = j = root[root[j]]
                    if i != j:
                        root[max(i, j)] = min(i, j)
                        a.append(max(i, j))
                        b.append(min(i, j))
            counted = np.flatnonzero(others)
            if len(counted):
                who = pa.array(np.concatenate([counted, np.array(a, np.int64)]))
                other = pa.array([None] * len(counted) + b, pa.int64())
                number = pa.array([*others[counted].tolist(), *[None] * len(a)], pa.int64())
                yield pa.RecordBatch.from_arrays([node.take(who), node.take(other), number], ["a", "b", "n"])

    return run


def linked(values: np.ndarray, at: np.ndarray, dims: np.ndarray, x: np.ndarray, y: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a cosine of ``at_least`` or more; each vector's unit form is made once."""
    keep = np.zeros(len(x), bool)
    for dim in np.unique(dims[x]):
        own = np.flatnonzero(dims[x] == dim)
        rows, number = np.unique(np.concatenate([x[own], y[own]]), return_inverse=True)
        v = unit(values[at[rows][:, None] + np.arange(dim)])
        one, two = number[:len(own)], number[len(own):]
        step = max(1, (1 << 21) // int(dim))
        for begin in range(0, len(own), step):
            part = slice(begin, begin + step)
            keep[own[part]] = np.einsum("ij,ij->i", v[one[part]], v[two[part]]) >= at_least
    return x[keep], y[keep]
