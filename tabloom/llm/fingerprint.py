"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Shingles are hashed once.  The highest bits of a hash choose one of ``BINS`` bins and the smallest hash of a bin stands for it.
An empty bin borrows from a full one: every bin orders all bins by a hash of the two numbers, and the first full one
in that order lends its value, so the choice is even and the same in every document with these full bins (optimal
densification).  Of each value the lowest ``BITS`` bits are stored; as unequal values agree in them by chance with
probability 2^-BITS, likeness is corrected for it.

Texts are brought next to their successors by one shuffle: ids are cut into ranges at quantiles, each range is ordered
by itself, and the last document of a range gets the first one of the following range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.common import SHINGLE_WORDS, quoted, text_column

BINS, BITS = 128, 8
_BIN_BITS = BINS.bit_length() - 1
RANGES_PER_PARTITION = 8


def with_signature(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds ``out``, an array of ``BINS`` bytes (empty where the text has no words).

    Shingles are runs of ``words`` words of the lower-cased text; a shorter text is one shingle.  Every step is a column of
    its own, so that the lambdas of the next read it and do not compute it again.
    """
    kept = df.columns
    tokens = F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")
    df = df.select(*kept, F.transform(tokens, lambda w: F.xxhash64(w)).alias("_w"))
    run = F.transform(
        F.sequence(F.lit(0), F.size("_w") - words),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(words)]))
    shingles = F.when(F.size("_w") >= words, run).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<long>"))
    df = df.select(*kept, F.sort_array(shingles).alias("_s"))
    # in a sorted array the first hash of each bin is its smallest
    first = F.filter("_s", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col("_s"), i - 1))))
    df = df.select(*kept, first.alias("_m"))
    df = df.select(*kept, F.transform("_m", _bin).alias("_b"), F.transform("_m", _low).alias("_v"))
    lent = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda j: F.get(
            F.col("_v"),
            F.coalesce(F.nullif(F.array_position("_b", j), F.lit(0).cast("long")), F.array_position("_b", _lender(j))).cast("int") - 1))
    signature = F.when(F.size("_v") == BINS, F.col("_v")).when(F.size("_v") > 0, lent).otherwise(F.col("_v"))
    return df.select(*kept, signature.alias(out))


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 64 - _BIN_BITS) + BINS // 2).cast("int")


def _low(x: Column) -> Column:
    """The lowest bits, shifted to fit into a signed byte."""
    return (x.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << (BITS - 1))).cast("byte")


def _lender(j: Column) -> Column:
    """The full bin that comes first in the order of bin j."""
    # the bin's number replaces the lowest bits of the hash, so the smallest hash also names its bin
    order = F.transform("_b", lambda b: F.shiftleft(F.shiftright(F.xxhash64(j * BINS + b), _BIN_BITS), _BIN_BITS).bitwiseOR(b.cast("long")))
    return F.array_min(order).bitwiseAND(F.lit(BINS - 1)).cast("int")


def packed(signature: str) -> Column:
    """The signature as hexadecimal digits, two for each bin."""
    digits = F.transform(signature, lambda x: F.lpad(F.hex(x.cast("int") + (1 << (BITS - 1))), BITS // 4, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two signatures, from 0 to 1; of two empty ones 1, of one empty one 0."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -BITS
    share = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(share, F.lit(0.0)))
    )


def with_next(rows: DataFrame, id: str, tie: str, add: Callable[[DataFrame], DataFrame], take: list[str]) -> DataFrame:
    """``add(rows)`` and ``next_<column>``: what the following row in the order of ``id`` (a number; nulls first) and ``tie`` holds.

    The last row is followed by the first.  ``add`` makes columns of single rows; it is given the rows that begin a range
    once more, and no others.
    """
    buckets = RANGES_PER_PARTITION * max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(id).cast("double")
    cuts = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
    cuts = cuts or [0.0]  # any border serves where there are no numbers
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranged = rows.withColumn("_x", F.coalesce(key, F.lit(float("-inf"))))
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_range", handleInvalid="keep").transform(ranged).drop("_x")
    # numbers of ranges: at most as many rows as there are ranges
    follows = ranged.groupBy("_range").agg(F.min(F.struct(id, tie)).alias("_first")).withColumn(
        "_before", F.coalesce(
            F.lag("_range").over(Window.orderBy("_range")),
            F.max("_range").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = ranged.join(F.broadcast(follows), "_range").where(F.col("_first") == F.struct(id, tie)).drop("_first", "_range").dropDuplicates(["_before"])
    first = add(first).select(F.col("_before").alias("_of"), *[F.col(c).alias(f"_first_{c}") for c in take])
    added = add(ranged)
    order = Window.partitionBy("_range").orderBy(F.col(id).asc_nulls_first(), tie)
    led = added.withColumns({f"next_{c}": F.lead(c).over(order) for c in take})
    joined = led.join(first, led["_range"] == first["_of"], "left")
    return joined.select(*[c for c in added.columns if c != "_range"], *[F.coalesce(f"next_{c}", f"_first_{c}").alias(f"next_{c}") for c in take])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs``.

    The edited text is the text without its last quarter of code points (rounded down) and, in their place, as many from
    the beginning of the next document, or all it has.  The next document has the following id, the last one is followed by
    the first; rows with one id are in the order of a hash of the text, and null ids come first.

    Null and empty texts have the empty fingerprint, which is like the empty one only.  Equal texts have equal fingerprints and
    likeness 1.  A single row is its own next document.  An empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(docs[quoted(doc_id)].alias("id"), text_column(docs, text).alias("text")).withColumn("tie", F.xxhash64("text"))
    paired = with_next(rows, "id", "tie", lambda df: with_signature(df, "text", "signature"), ["text", "signature"])
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    paired = paired.select(
        "id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", likeness("signature", "next_signature").alias("near_next"))
    out = with_signature(paired, "edited", "edited_signature")
    return out.select(
        F.col("id").alias(doc_id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed("signature").alias("fingerprint"),
        packed("edited_signature").alias("edited_fingerprint"), likeness("signature", "edited_signature").alias("near_edited"), "near_next")
