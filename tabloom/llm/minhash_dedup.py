"""Near-duplicate documents by min-max hashing.

One pass over the texts gives each document the number of its distinct shingles, a fingerprint of its whole set and its
bands.  Under every permutation both the smallest and the largest value are kept, so 50 hash evaluations of a shingle
give a signature of 100 values; five values make a band.

* Documents with equal sets form a class and are one node from there on: a group of copies costs one row.
* Classes that share a band are joined, through the smallest class of the band, into clusters.  Every candidate pair
  lies inside a cluster.  Classes in a cluster get their full sets, and all pairs of a cluster are compared exactly
  inside tasks, block by block: a block pair holds at most twice ``BLOCK`` sets, and gives back a spanning forest of
  its links, so rows stay in proportion to members however large the cluster is.
* The links' connected components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ODD, cut, mixed, quoted, shingle_sets, signed, streamed_groups, text_column
from tabloom.llm.components import components, of_root

PERMUTATIONS, BAND = 50, 5
BANDS = 2 * PERMUTATIONS // BAND
BLOCK = 256


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document's set are its distinct runs of five words,
    or its whole sequence if that is shorter.  Documents are linked with 100 * intersection >= percent * union.
    ``component_id`` is the smallest id that links lead to, the document's own included; ``kept`` marks that document.

    Null and empty texts, and texts of white space only, have no set, are linked with nothing and are kept.  Rows with
    equal texts are linked, whatever their ids; of repeated rows with one id each is marked as kept.  A null id is
    never the smallest while another one is there, and a component of null ids has a null component and keeps nothing.
    An empty table gives an empty result; other columns are not looked at.
    """
    signed_docs, found = _grouped(docs, doc_id, text, percent)
    smallest = found.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = of_root(found, smallest, ["component_id"]).select("node", "component_id")
    out = signed_docs.select("id", "n", "node").join(of_class, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component of ``near_duplicates`` stays.

    It is the row with the smallest id and, among texts on one id, the smallest hash; a null id comes last.  Ids decide
    nothing else: two texts on one id are kept or dropped each for itself.  Rows whose texts are null or hold no words stay,
    one for each id and text, and all of them where the id is null.  An empty table gives an empty result.
    """
    signed_docs, found = _grouped(docs, doc_id, text, percent)
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one")
    stay = found.groupBy("root").agg(one).select("one.id", "one.key", F.lit(False).alias("alone")).unionByName(
        signed_docs.where("n = 0").select("id", "key", F.col("id").isNull().alias("alone")).distinct())
    named = lambda id, key: [id.isNull().alias("none"), F.coalesce(id.cast("string"), F.lit("")).alias("name"), key.alias("key")]
    keys = ["none", "name", "key"]
    rows = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), *named(docs[quoted(doc_id)], F.xxhash64(text_column(docs, text))))
    kept = rows.join(stay.select(*named(F.col("id"), F.col("key")), "alone"), keys)
    return kept.where("NOT alone").dropDuplicates(keys).unionByName(kept.where("alone")).select("row.*")


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (node, id, key, root) of each distinct set: its first row and its component."""
    ids = docs.select(F.col(quoted(doc_id)).alias("id"), text_column(docs, text).alias("text"))
    signed_docs = cut(signatures(ids), "minhash")
    some = signed_docs.where("n > 0")
    classes = cut(
        some.groupBy("node").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"), F.first("bands").alias("bands"))
        .select("node", "least.id", "least.key", "bands"),
        "minhash-classes")
    roots = components(verified_links(ids, classes, percent))
    return signed_docs, classes.select("node", "id", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def signatures(ids: DataFrame) -> DataFrame:
    """(id, key, n, node, bands) of (id, text); ``node`` names the set, ``key`` the text."""
    kind = ids.schema["id"].dataType.simpleString()
    keyed = ids.select("id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(
        _signatures, f"id {kind}, key long, n long, node struct<h1: long, h2: long>, bands array<long>")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        sizes, h1, h2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        bands = np.zeros((rows, BANDS), np.uint64)
        for first, last, sets in shingle_sets(batch.column("text")):
            size = np.array([len(s) for s in sets])
            sizes[first:last] = size
            there = first + np.flatnonzero(size)
            if not len(there):
                continue
            values = np.concatenate(sets)
            begin = (np.cumsum(size) - size)[size > 0]
            h1[there] = np.add.reduceat(mixed(values * ODD[20]), begin)
            h2[there] = np.add.reduceat(mixed(values * ODD[21]), begin)
            signature = np.empty((2 * PERMUTATIONS, len(there)), np.uint64)
            for k in range(PERMUTATIONS):
                permuted = (values ^ ODD[100 + k]) * ODD[200 + k]
                signature[2 * k] = np.minimum.reduceat(permuted, begin)
                signature[2 * k + 1] = np.maximum.reduceat(permuted, begin)
            for band in range(BANDS):
                own = signature[band * BAND:(band + 1) * BAND]
                bands[there, band] = mixed((own * ODD[300:300 + BAND, None]).sum(axis=0) + ODD[320 + band])
        node = pa.StructArray.from_arrays([pa.array(signed(h1)), pa.array(signed(h2))], ["h1", "h2"])
        flat = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * BANDS, pa.array(signed(bands.ravel())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), pa.array(sizes), node, flat], ["id", "key", "n", "node", "bands"])


def verified_links(ids: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes that connect all whose sets are similar enough."""
    members = classes.select("node", F.posexplode("bands").alias("band", "value"))
    first = members.groupBy("band", "value").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = members.join(first, ["band", "value"]).where(F.col("node") != F.col("leader")).select(
        F.col("node").alias("a"), F.col("leader").alias("b"))
    clusters = components(stars)
    texts = ids.select(F.col("id"), F.xxhash64("text").alias("key"), "text")
    wanted = clusters.join(classes.select("node", F.col("id").alias("wanted_id"), F.col("key").alias("wanted_key")), "node")
    wanted_text = (
        texts.join(wanted, (texts["key"] == wanted["wanted_key"]) & texts["id"].eqNullSafe(wanted["wanted_id"]))
        .select("root", "node", "text")
    )
    sets = cut(
        wanted_text.mapInArrow(_sets, "root struct<h1: long, h2: long>, node struct<h1: long, h2: long>, values array<long>")
        .dropDuplicates(["node"]), "minhash-sets")
    blocks = sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    paired = (
        sets.join(blocks, "root").withColumn("block", block).withColumn("other", other)
        .select(
            F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
            (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "node", "values")
    )
    return (
        paired.repartition("task").sortWithinPartitions("task")
        .mapInArrow(_compared(percent), "a struct<h1: long, h2: long>, b struct<h1: long, h2: long>")
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, sets in shingle_sets(batch.column("text")):
            own = batch.slice(first, last - first)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.ListArray.from_arrays(at, pa.array(signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([own.column("root"), own.column("node"), values], ["root", "node", "values"])


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed_groups(batches, ["task"], 2 * BLOCK):
            table = table.combine_chunks()
            task = np.asarray(table.column("task"))
            node = pa.concat_arrays(table.column("node").chunks)
            lists = pa.concat_arrays(table.column("values").chunks)
            values, at = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            left, right = np.asarray(table.column("left")), np.asarray(table.column("right"))
            a, b = [], []
            for own in np.split(np.arange(len(task)), np.flatnonzero(task[1:] != task[:-1]) + 1):
                for x, y in forest([values[at[i]:at[i + 1]] for i in own], left[own], right[own], percent):
                    a.append(own[x])
                    b.append(own[y])
            if a:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])

    return run


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between left and right members, as a spanning forest of those that are similar enough."""
    size = np.array([len(s) for s in sets])
    shared = intersections(sets)
    union = size[:, None] + size[None, :] - shared
    linked = (100 * shared >= percent * union) & left[:, None] & right[None, :]
    np.fill_diagonal(linked, False)
    linked |= linked.T
    out, seen = [], np.zeros(len(sets), bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            queue.extend(new)
            out += [(x, y) for y in new]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by a matrix product over the values that occur twice or more."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column, owner = (np.cumsum(often) - 1)[column][often[column]], owner[often[column]]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for begin in range(0, int(often.sum()), width):
        own = slice(*np.searchsorted(column, [begin, begin + width]))
        part = np.zeros((n, width), np.float32)
        part[owner[own], column[own] - begin] = 1
        shared += part @ part.T
    shared = shared.astype(np.int64)
    np.fill_diagonal(shared, [len(s) for s in sets])
    return shared
