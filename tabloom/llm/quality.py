"""Quality by perplexity under an n-gram model of trusted text.

The model is interpolated modified Kneser-Ney over UTF-8 bytes, of order ``ORDER``.  N-grams of all trusted texts are counted: each task
adds up its own, the sums are grouped by n-gram.  Probabilities come from joins of count tables, sharded by hash: of an n-gram
with its context, and of an n-gram with the next shorter one.  Lower orders count the different bytes that stand before.

The table is then dealt into shards by the byte before the predicted one, so that one shard holds everything that a
position can ask for.  A shard has ``SHARD_ENTRIES`` entries at most unless a single byte needs more (then 256^(ORDER-1) bound it), is sent
to the tasks, and documents pass by it without a shuffle, adding up their log probabilities: a table too large for one shard costs
more passes, not more memory.

Documents whose perplexity lies outside of what their language's trusted documents show are rejected: above a high quantile of those held
out from counting, or below a low quantile of all, since the counted ones and texts like them cost less.  Every distinct trusted text counts once, however many documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ODD, cut, mixed, pieces, quoted, text_column, utf8

ORDER = 5
SHARD_ENTRIES = 1 << 21
HELD_OUT = 5                    # one trusted text of so many is not counted and gives the thresholds
LOW, HIGH = 0.002, 0.998        # quantiles of trusted texts: of all, and of those held out
MARGIN = 0.05                   # of the logarithm of perplexity, beyond these two
PRIOR_BYTES = 100               # a text counts as if so many bytes at its language's mean stood before it
LEAST_TRUSTED = 30              # a language with fewer held-out trusted documents takes the thresholds of all
_GRID = 1000                    # log perplexity is counted in steps of 1 / _GRID
_FLUSH = 1 << 20


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes that end at each position from ``n - 1`` on, as one number with the last byte lowest."""
    out = np.zeros(max(len(data) - n + 1, 0), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[k:k + len(out)]
    return out


def counted(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each ``ORDER`` bytes in a row occur in texts that begin with ``ORDER - 1`` zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for first, last in pieces(at):
                padded, _ = _padded(data, at[first:last + 1])
                new, times = np.unique(_complete(padded), return_counts=True)
                gram, inverse = np.unique(np.concatenate([gram, new]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n, times]), len(gram)).astype(np.int64)
                if len(gram) > _FLUSH:
                    yield _batch(gram, n)
                    gram, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(gram):
            yield _batch(gram, n)

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _batch(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], ["gram", "n"])


def _padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zero bytes before each, and for each byte of the result whether it is of a text."""
    own = data[at[0]:at[-1]]
    size = np.diff(at)
    out = np.zeros(len(own) + (ORDER - 1) * len(size), np.uint8)
    place = np.arange(len(own)) + np.repeat((ORDER - 1) * np.arange(1, len(size) + 1), size)
    out[place] = own
    real = np.zeros(len(out), bool)
    real[place] = True
    return out, real


def _complete(padded_and_real: np.ndarray) -> np.ndarray:
    gram = grams(padded_and_real, ORDER)
    return gram[(gram & np.uint64(255)) != 0]


def model(counts: DataFrame) -> DataFrame:
    """(kind, length, gram, value): log probabilities of seen n-grams (kind 0) and log weights of contexts (kind 1)."""
    by_order = {ORDER: cut(counts, "grams")}
    for n in range(ORDER - 1, 0, -1):
        # how many different bytes stand before; 8 bits less at the top
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1))
        by_order[n] = cut(by_order[n + 1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    discounts = {n: _discounts(by_order[n]) for n in by_order}
    below, tables = None, []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts[n]
        own = by_order[n].withColumn("context", F.shiftright("gram", 8))
        c = F.col("n")
        discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        contexts = own.groupBy("context").agg(
            F.sum("n").alias("total"),
            (F.sum(F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)) / F.sum("n")).alias("weight"))
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)) if n > 1 else F.lit(0).cast("long")
        rows = own.join(contexts, "context").withColumn("shorter", shorter)
        rest = F.lit(1 / 256) if below is None else F.col("p_below")
        if below is not None:
            rows = rows.join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("p_below")), "shorter")
        p = cut(rows.select("gram", (F.greatest(c - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * rest).alias("p")), "model")
        tables.append(p.select(F.lit(0).alias("kind"), F.lit(n).alias("length"), "gram", F.log("p").alias("value")))
        tables.append(contexts.select(F.lit(1).alias("kind"), F.lit(n - 1).alias("length"), F.col("context").alias("gram"), F.log("weight").alias("value")))
        below = p
    return cut(reduce(DataFrame.unionByName, tables), "model-table")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more often, from the numbers of those seen one to four times."""
    row = counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(x or 0, 1) for x in row)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))


class Table:
    """A shard of the model: values by (kind, length, gram), open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, last: np.ndarray):
        self.last = last  # which bytes before the predicted one are of this shard
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.key, self.value = np.zeros(self.size, np.uint64), np.zeros(self.size, np.float32)
        self.probes = 0
        keys, values = keys.astype(np.uint64), values.astype(np.float32)
        while len(keys):
            slot = self._slot(keys, self.probes)
            _, one = np.unique(slot, return_index=True)
            one = one[self.key[slot[one]] == 0]
            self.key[slot[one]], self.value[slot[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values = keys[rest], values[rest]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * ODD[400 + probe % 100]) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 where not)."""
        slot = self._slot(keys, 0)
        there = self.key[slot]
        hit = there == keys
        value = np.where(hit, self.value[slot], np.float32(0))
        open_ = np.flatnonzero(~hit & (there != 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = self._slot(keys[open_], probe)
            there = self.key[slot]
            found = there == keys[open_]
            hit[open_[found]], value[open_[found]] = True, self.value[slot[found]]
            open_ = open_[~found & (there != 0)]
        return hit, value

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram after the others: the longest seen n-gram, times the weights of longer contexts."""
        out = np.zeros(len(gram), np.float32)
        open_ = np.arange(len(gram))
        for n in range(ORDER, 0, -1):
            own = gram[open_] & np.uint64((1 << (8 * n)) - 1)
            hit, value = self.find(entry_key(0, n, own))
            out[open_[hit]] += value[hit]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            out[open_] += self.find(entry_key(1, n - 1, own >> np.uint64(8)))[1]
        out[open_] += np.float32(np.log(1 / 256))
        return out


def entry_key(kind: int, length: int, gram: np.ndarray) -> np.ndarray:
    return gram.astype(np.uint64) | np.uint64((1 << 63) | (kind << 60) | (length << 50))


def shards(table: DataFrame, most: int = SHARD_ENTRIES) -> list[Table]:
    """The model as tables of bounded size, one after the other.

    An n-gram belongs to its last byte but one, a context to its last byte; what has neither goes into every shard.
    """
    byte = F.when(F.col("length") + F.col("kind") < 2, F.lit(-1)).otherwise(
        F.when(F.col("kind") == 0, F.shiftright("gram", 8)).otherwise(F.col("gram")).bitwiseAND(F.lit(255))).cast("int")
    dealt = table.withColumn("byte", byte)
    sizes = {r["byte"]: r["n"] for r in dealt.groupBy("byte").agg(F.count(F.lit(1)).alias("n")).collect()}  # 257 rows at most
    key = F.col("gram").bitwiseOR(F.shiftleft(F.col("kind").cast("long"), 60)).bitwiseOR(F.shiftleft(F.col("length").cast("long"), 50)).bitwiseOR(
        F.lit(-(1 << 63)))
    groups, held = [[]], 0
    for b in range(256):
        n = sizes.get(b, 0)
        if held and held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(b)
        held += n
    out = []
    for group in groups:
        rows = dealt.where(F.col("byte").isin(-1, *group)).select(key.alias("key"), F.col("value").cast("float")).toArrow()
        keys = rows["key"].to_numpy().view(np.uint64)
        last = np.zeros(256, bool)
        last[group] = True
        out.append(Table(keys, rows["value"].to_numpy(), last))
    return out


def perplexities(docs: DataFrame, tables: list[Table], text: str = "text") -> DataFrame:
    """The columns of ``docs`` by place (_c0, _c1, ...), ``_p``, the log probability of the whole text, and ``_n``, its bytes."""
    rows = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]).withColumns({"_p": F.lit(0.0), "_n": F.lit(0).cast("long")})
    for shard in tables:
        rows = rows.mapInArrow(_scored(shard, docs.columns.index(text)), rows.schema)
    return rows


def _scored(shard: Table, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(place).cast(pa.string()))
            total = np.zeros(batch.num_rows)
            for first, last in pieces(at):
                own = at[first:last + 1]
                padded, real = _padded(data, own)
                gram = grams(padded, ORDER)
                document = np.repeat(np.arange(last - first), np.diff(own))
                asked = real[ORDER - 1:]
                gram = gram[asked]
                mine = shard.last[(gram >> np.uint64(8)).astype(np.uint8)]
                total[first:last] += np.bincount(document[mine], shard.log_probability(gram[mine]), last - first)
            held = np.asarray(batch.column("_p")) + total
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(held), pa.array(np.diff(at))], batch.schema.names)

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted")).distinct()


def _key(text: Column) -> Column:
    """Names a text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _held_out(key: str) -> Column:
    return F.pmod(F.xxhash64(f"{key}.h1"), F.lit(HELD_OUT)) == 0


def distinct_trusted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text): each distinct text of the trusted documents that are counted, once."""
    named = docs.select(docs[quoted(doc_id)].alias("_id"), text_column(docs, text).alias("text")).withColumn("_key", _key(F.col("text")))
    trusted = trusted_ids(labels)
    # keys find one document of each text first, so that texts move once, and are not sorted for it
    held = named.select("_id", "_key").join(trusted, F.col("_id") == F.col("_trusted"), "left_semi").where(~_held_out("_key"))
    of_id = held.groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("times"))
    one = cut(of_id.groupBy("_key").agg(F.min(F.struct("_id", "times")).alias("one")).select("_key", "one.*"), "trusted-texts")
    once = named.join(one.where("times = 1").hint("shuffle_hash"), ["_id", "_key"], "left_semi").select("text")
    repeated = one.where("times > 1")
    if repeated.isEmpty():
        return once
    return once.union(named.join(repeated.hint("shuffle_hash"), ["_id", "_key"], "left_semi").dropDuplicates(["_key"]).select("text"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, perplexity, low, high, good), one row per row of ``docs``.

    ``labels`` (doc_id, quality) name the trusted documents, those of quality 1; four of five of their distinct texts are counted and
    the others give the mean and the upper threshold; all give the lower one, each once a language.  ``perplexity`` is per byte, of the text and ``PRIOR_BYTES`` bytes at the mean of its language's trusted text, so
    that a few words alone decide nothing.  ``good`` says that it lies between the thresholds of the language: too high means
    text that is unlike trusted text, too low means repetition.

    Null and empty texts have the mean of their language and are good.  Documents with a null language or one with too few trusted
    documents take the thresholds of all.  Without trusted documents everything is good.  Rows with one id are trusted together,
    null ids never.  An empty table gives an empty result; other columns are not looked at.
    """
    id, language = docs.columns.index(doc_id), docs.columns.index(lang)
    return _judged(docs, labels, doc_id, text, lang).select(
        F.col(f"_c{id}").alias(doc_id), F.col(f"_c{language}").alias(lang), F.exp("_cost").alias("perplexity"),
        F.exp("_low").alias("low"), F.exp("_high").alias("high"), F.col("_good").alias("good"))


def good_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judged`` finds good."""
    kept = _judged(docs, labels, doc_id, text, lang, with_text=True).where("_good")
    return kept.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _judged(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, with_text: bool = False) -> DataFrame:
    trusted = trusted_ids(labels)
    learnt = distinct_trusted(docs, labels, doc_id, text)
    keyed = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    place = docs.columns.index(text)
    keyed = keyed.withColumn("_key", _key(text_column(keyed, f"_c{place}")))
    scores = perplexities(keyed, shards(model(counted(learnt))), f"_c{place}").withColumnRenamed(f"_c{len(docs.columns)}", "_key")
    scores = cut(scores if with_text else scores.drop(f"_c{docs.columns.index(text)}"), "perplexities")
    language = F.coalesce(F.col(f"_c{docs.columns.index(lang)}").cast("string"), F.lit(""))
    known = scores.select(F.col(f"_c{docs.columns.index(doc_id)}").alias("_id"), language.alias("_lang"), "_p", "_n", "_key")
    base = cut(
        known.where("_n > 0").join(trusted, F.col("_id") == F.col("_trusted"), "left_semi")
        .dropDuplicates(["_lang", "_key"]).select("_lang", "_p", "_n", _held_out("_key").alias("_held")),
        "trusted-perplexities")
    by_lang, overall = thresholds(base)

    def pick(i: int) -> Column:
        value = F.lit(float(overall[i]))
        for name, span in by_lang.items():
            value = F.when(language == name, F.lit(float(span[i]))).otherwise(value)
        return value

    return scores.withColumns({"_cost": _cost(pick(0)), "_low": pick(1), "_high": pick(2)}).withColumn(
        "_good", F.col("_cost").between(F.col("_low"), F.col("_high")))


def _cost(mean: Column) -> Column:
    """Logarithm of perplexity, drawn to the mean where the text is short."""
    return (-F.col("_p") + PRIOR_BYTES * mean) / (F.col("_n") + PRIOR_BYTES)


def thresholds(base: DataFrame) -> tuple[dict[str, tuple[float, float, float]], tuple[float, float, float]]:
    """(mean, low, high) of the log perplexity of trusted texts: by language, and of all.

    Quantiles are exact on a grid of 1 / ``_GRID``: values are counted, and at most a few thousand counts per language are read.
    """
    held = base.where("_held")
    means = held.groupBy("_lang").agg(
        (-F.sum("_p") / F.sum("_n")).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("_n").alias("bytes")).collect()
    if not means:
        return {}, (0.0, float("-inf"), float("inf"))
    overall = sum(r["mean"] * r["bytes"] for r in means) / sum(r["bytes"] for r in means)
    large = {r["_lang"]: r["mean"] for r in means if r["n"] >= LEAST_TRUSTED}
    mean = F.lit(float(overall))
    for name, m in large.items():
        mean = F.when(F.col("_lang") == name, F.lit(float(m))).otherwise(mean)
    cell = F.round(_cost(mean) * _GRID).cast("long")
    cells = base.groupBy("_lang", "_held", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()

    def span(rows: list, mean: float) -> tuple[float, float, float]:
        def at(q: float, rows: list) -> int:
            counts = sorted((r["cell"], r["n"]) for r in rows)
            n = np.cumsum([c[1] for c in counts])
            return counts[int(np.searchsorted(n, q * n[-1]))][0]

        return mean, at(LOW, rows) / _GRID - MARGIN, at(HIGH, [r for r in rows if r["_held"]]) / _GRID + MARGIN

    return {name: span([r for r in cells if r["_lang"] == name], m) for name, m in large.items()}, span(cells, overall)
