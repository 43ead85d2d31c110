"""Sharding through a fixed number of virtual slots.

A record's virtual slot is a hash of its id and text; there are always ``SLOTS`` of them.  Bytes are added up per slot (at most
``SLOTS`` numbers, whatever the data), and a map from slots to shards is kept as a table with versions.  Rebalancing writes a new
version that moves as few slots as it can; records never have to be hashed again.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.common import quoted, text_column

SLOTS = 1 << 14
OVERHEAD = 16
TOLERANCE = 0.005  # a shard may exceed the mean by this share before slots move
MAP_SCHEMA = "version int, virtual_slot int, shard int, n_bytes long"


def virtual_slot(*keys) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def balanced(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slots dealt out from the largest to the smallest, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(SLOTS), key=lambda k: (-sizes.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalanced(old: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The old map with as few slots moved as bring every shard near the mean.  Slots of shards that are gone always move."""
    out = dict(old)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot in range(SLOTS):
        shard = out.get(slot, -1)
        if 0 <= shard < shards:
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    limit = sum(sizes.values()) / shards * (1 + tolerance)
    for shard in range(shards):
        # the largest slot that does not take the shard below the mean goes first: few moves
        for slot in sorted(held[shard], key=lambda k: (-sizes.get(k, 0), k)):
            size = sizes.get(slot, 0)
            if load[shard] > limit and size and load[shard] - size >= limit * (1 - 2 * tolerance) / (1 + tolerance):
                load[shard] -= size
                homeless.append(slot)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda k: (-sizes.get(k, 0), k)):
        x, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (x + sizes.get(slot, 0), shard))
    return out


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot; ``SLOTS`` rows at most reach the driver."""
    return {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("n_bytes")).collect()}


def write_map(spark: SparkSession, path: str, mapping: dict[int, int], sizes: dict[int, int]) -> int:
    """Adds a version to the stored map and gives its number; older versions stay readable."""
    version = last_version(spark, path) + 1
    rows = [(version, slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(mapping.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return version


def last_version(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0] or 0


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = last_version(spark, path) if version is None else version
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of each row."""
    rows = docs.select(docs[quoted(doc_id)].alias("id"), docs[quoted(text)].cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("id", size.alias("size"), crc.alias("text_crc32")).withColumn(
        "virtual_slot", virtual_slot("id", "text_crc32", "size"))


def shard(docs: DataFrame, shards: int, map_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row of ``docs`` in one of the shards.

    Law ``bytes``: shards are nearly equal in size (UTF-8 bytes of the text and 16).  ``slot`` numbers a shard's rows from 0 without
    gaps.  ``grown_shard`` is null under this law.  The map is stored in ``map_path``: the first call deals the slots out, later
    ones edit the last version.

    A null text has no bytes and the checksum of an empty one.  Null ids are hashed like others.  Repeated rows lie in one virtual
    slot and have slots one after the other.  An empty table gives an empty result; other columns are not looked at.  Texts longer
    than a shard's mean size cannot be evened out.
    """
    spark = docs.sparkSession
    rows = records(docs, doc_id, text)
    sizes = slot_bytes(rows)
    if last_version(spark, map_path):
        old = {r["virtual_slot"]: r["shard"] for r in read_map(spark, map_path).collect()}
        mapping = rebalanced(old, sizes, shards)
        changed = mapping != old
    else:
        mapping, changed = balanced(sizes, shards), True
    if changed:
        write_map(spark, map_path, mapping, sizes)
    table = read_map(spark, map_path).select("virtual_slot", "shard")
    # equal rows are counted first, so that a hot row does not meet in one task; then rows are numbered inside their virtual
    # slot, and slots inside their shard
    counted = rows.groupBy("virtual_slot", "id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("virtual_slot").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        table.join(totals, "virtual_slot", "left").fillna(0, ["total"])
        .withColumn("start", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    )
    before = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "virtual_slot")
    first = F.col("start") + F.col("before")
    return placed.select(
        F.col("id").alias(doc_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot")
