"""Sentiment: existing labels, candidate columns, scoring, annotation."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import labels as lb
from tabloom.functions import text as tx
from tabloom.functions.sampling import sample_per_column
from tabloom.operators.facts import physical_classes, unpivoted
from tabloom.operators.ranking import lookup, quoted_col
from tabloom.session import written
from tabloom.settings import DEFAULTS, NEGATIVE_WORDS, POSITIVE_WORDS, Settings

# ------------------------------------------------------------------- scorers


class Scorer(Protocol):
    """Scores cleaned texts.

    ``columnar`` scorers are Column expressions: scoring every row costs less
    than a shuffle.  Others score each distinct text once.
    """

    columnar: bool

    def score(self, texts: DataFrame, column: str) -> DataFrame:
        """Adds ``_raw_label`` and ``_raw_score``."""

    def opinion(self, texts: DataFrame, column: str) -> DataFrame:
        """Adds ``_is_opinion`` and ``_opinion_score``."""


@dataclass(frozen=True)
class LexiconScorer:
    positive: tuple[str, ...] = POSITIVE_WORDS
    negative: tuple[str, ...] = NEGATIVE_WORDS
    columnar: bool = field(default=True, init=False)

    def _counts(self, c: Column) -> tuple[Column, Column]:
        return tx.token_hits(c, self.positive), tx.token_hits(c, self.negative)

    def score(self, texts: DataFrame, column: str) -> DataFrame:
        pos, neg = self._counts(quoted_col(column))
        p, q = F.col("_pos"), F.col("_neg")
        counted = texts.withColumns({"_pos": pos, "_neg": neg})
        return counted.withColumns({
            "_raw_label": F.when(p > q, "positive").when(q > p, "negative").otherwise("neutral"),
            "_raw_score": F.when(p + q > 0, F.abs(p - q) / (p + q)).otherwise(F.lit(0.0)),
        }).drop("_pos", "_neg")

    def opinion(self, texts: DataFrame, column: str) -> DataFrame:
        pos, neg = self._counts(quoted_col(column))
        p, q = F.col("_pos"), F.col("_neg")
        counted = texts.withColumns({"_pos": pos, "_neg": neg})
        return counted.withColumns({
            "_is_opinion": (p + q > 0).cast("int"),
            "_opinion_score": F.when(p + q > 0, F.abs(p - q) / (p + q)).otherwise(F.lit(0.0)),
        }).drop("_pos", "_neg")


# ----------------------------------------------------------- existing labels


def existing_label_facts(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(column, non_null, matched_frac, is_existing) of the string columns."""
    names = [
        c for c, k in physical_classes(df).items()
        if k == "string" and not c.endswith(("_sentiment_num", "_sentiment_confidence"))
    ]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, non_null long, matched_frac double, is_existing boolean")
    return (
        unpivoted(df, names)
        .groupBy("column")
        .agg(
            F.count("value").alias("non_null"),
            F.avg(lb.is_label(F.col("value")).cast("int")).alias("matched_frac"),
        )
        .withColumn(
            "is_existing",
            F.coalesce(
                (F.col("non_null") >= cfg.existing_min_rows) & (F.col("matched_frac") >= cfg.existing_share),
                F.lit(False),
            ),
        )
    )


def append_secondary(record: dict, existing: list[str]) -> dict:
    """Existing label columns join the secondary targets (may exceed two)."""
    out = {**record, "secondary": list(record.get("secondary") or [])}
    for c in existing:
        if c not in out["secondary"] and c != out.get("primary"):
            out["secondary"].append(c)
    return out


# ---------------------------------------------------------- candidate columns


def text_sample(df: DataFrame, keys: list[str], columns: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """(column, _k..., value): seeded sample of the non-null cells per column."""
    safe = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[quoted_col(k).alias(s) for k, s in zip(keys, safe)])
    cells = unpivoted(keyed, columns, safe).where("value is not null")
    # written: 500 cells a column, which several measures read
    return written(sample_per_column(cells, cfg.sample_rows, safe, cfg.sample_seed), "text-sample")


def sampled_text_facts(sample: DataFrame, vocabulary, cfg: Settings = DEFAULTS) -> DataFrame:
    """(column, avg_words, unique_word_ratio, keyword_signal) of a text sample."""
    hit = (tx.token_hits(F.col("value"), vocabulary) > 0).cast("int")
    rows = sample.groupBy("column").agg(
        F.avg(tx.word_count(F.col("value"))).alias("avg_words"),
        (F.avg(hit) > cfg.keyword_share).alias("keyword_signal"),
    )
    ratio = (
        sample.select("column", F.explode(tx.words(F.col("value"))).alias("w"))
        .groupBy("column")
        .agg((F.count_distinct("w") / F.count("w")).alias("r"))
    )
    return (
        rows.join(F.broadcast(ratio), "column", "left")  # one row per column
        .withColumn("unique_word_ratio", F.coalesce("r", F.lit(0.0)))
        .drop("r")
    )


def candidate_rule() -> Column:
    words, ratio = F.col("avg_words"), F.col("unique_word_ratio")
    code_like = (words < 1.5) & (ratio > 0.9)
    return ~code_like & ((words >= 2.0) | F.col("keyword_signal"))


def non_null_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and of present cells of each column; one scan that reads no values where the format knows them."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted_col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(columns)}


def candidates(df: DataFrame, keys: list[str], vocabulary, skip: set[str] = frozenset(),
               cfg: Settings = DEFAULTS) -> DataFrame:
    """Facts of every string column plus ``non_null_count`` and ``is_candidate``.  ``skip`` holds the
    columns profiled as datetime."""
    names = [c for c, k in physical_classes(df).items() if k == "string" and c not in skip]
    facts = sampled_text_facts(text_sample(df, keys, names, cfg), vocabulary, cfg)
    _, present = non_null_counts(df, names)
    counts = F.create_map(*[F.lit(x) for pair in present.items() for x in pair])
    return facts.withColumns({"non_null_count": counts[F.col("column")], "is_candidate": candidate_rule()})


def opinion_gate(sample: DataFrame, scorer: Scorer, cfg: Settings = DEFAULTS) -> DataFrame:
    """(column, opinion_frac, mean_conf, passes) over a text sample."""
    scored = scorer.opinion(sample, "value")
    return (
        scored.groupBy("column")
        .agg(
            F.avg(F.col("_is_opinion")).alias("opinion_frac"),
            F.coalesce(F.avg(F.when(F.col("_is_opinion") == 1, F.col("_opinion_score"))), F.lit(0.0)).alias("mean_conf"),
        )
        .withColumn("passes", F.col("opinion_frac") >= cfg.opinion_share)
    )


# ---------------------------------------------------------------- annotation


def distinct_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(clean, n, key): every distinct cleaned text over all columns, once.

    Repeated texts are combined before the shuffle.
    """
    cells = unpivoted(df, columns).select(tx.clean_text(F.col("value")).alias("clean"))
    counted = cells.groupBy("clean").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("key", tx.value_key(F.col("clean")))


def score_distinct(df: DataFrame, columns: list[str], scorer: Scorer) -> DataFrame:
    return scorer.score(distinct_texts(df, columns), "clean")


def row_label(raw: Column, score: Column, cfg: Settings = DEFAULTS) -> Column:
    known = F.coalesce(lb.canonical_label(raw), F.lit("neutral"))
    return F.when(score < cfg.min_confidence, "neutral").otherwise(known)


def annotate(df: DataFrame, columns: list[str], scorer: Scorer, cfg: Settings = DEFAULTS) -> DataFrame:
    """Adds ``<c>_sentiment``, ``_sentiment_num`` and ``_sentiment_confidence``.

    A columnar scorer is a projection.  Any other scorer sees each distinct
    cleaned text once and its result is looked up per row.
    """
    out = df
    if scorer.columnar:
        for c in columns:
            out = out.withColumn("_clean", tx.clean_text(quoted_col(c)))
            out = scorer.score(out, "_clean")
            out = _label_columns(out, c, cfg).drop("_clean")
        return out
    scored = score_distinct(df, columns, scorer).select(F.col("key").alias("_key"), "_raw_label", "_raw_score", "n")
    distinct = written(scored, "scored-texts")  # or every column, and both branches of its lookup, would run the scorer again
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.approx_count_distinct(quoted_col(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    size = sum(totals[f"d{i}"] for i in range(len(columns)))
    for c in columns:
        keyed = out.withColumn("_key", tx.value_key(tx.clean_text(quoted_col(c))))
        out = lookup(keyed, distinct, ["_key"], ["_raw_label", "_raw_score"], totals["rows"] * len(columns), size)
        out = _label_columns(out, c, cfg).drop("_key")
    return out


def _label_columns(df: DataFrame, c: str, cfg: Settings) -> DataFrame:
    label = row_label(F.col("_raw_label"), F.col("_raw_score"), cfg)
    return (
        df.withColumn(f"{c}_sentiment", label)
        .withColumn(f"{c}_sentiment_num", lb.label_code(quoted_col(f"{c}_sentiment")))
        .withColumn(f"{c}_sentiment_confidence", F.col("_raw_score"))
        .drop("_raw_label", "_raw_score")
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(label, n, share) of the non-null values."""
    counts = (
        df.where(quoted_col(column).isNotNull())
        .groupBy(quoted_col(column).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def resolve_sentiment_column(columns: list[str], existing: list[dict] = (), named: list[str] = ()) -> str | None:
    """Which column to report: recorded ones first, then by suffix, then by name."""
    if existing:
        for field_name in ("numeric_version", "column"):
            if existing[0].get(field_name) in columns:
                return existing[0][field_name]
    if named and named[0] in columns:
        return named[0]
    for suffix in ("_sentiment_num", "_sentiment"):
        for c in columns:
            if c.endswith(suffix):
                return c
    for c in ("content_sentiment_num", "content_sentiment", "sentiment_num", "sentiment"):
        if c in columns:
            return c
    return None


def enrich(df: DataFrame, keys: list[str], record: dict, scorer: Scorer | None = None,
           skip: set[str] = frozenset(), cfg: Settings = DEFAULTS):
    """Whole sentiment stage: (enriched table, sentiment record, targets record)."""
    scorer = scorer or LexiconScorer()
    vocabulary = getattr(scorer, "positive", POSITIVE_WORDS) + getattr(scorer, "negative", NEGATIVE_WORDS)
    meta = {"candidates": [], "analyzed": [], "skipped": [], "existing_sentiment": []}
    existing = [r["column"] for r in existing_label_facts(df, cfg).where("is_existing").collect()]
    existing = [c for c in df.columns if c in existing]
    if existing:
        out = df.withColumns({f"{c}_num": lb.existing_label_code(quoted_col(c)) for c in existing})
        meta["existing_sentiment"] = [{"column": c, "numeric_version": f"{c}_num", "kind": "text"} for c in existing]
        meta["note"] = "existing_sentiment_used"
        return out, meta, append_secondary(record, existing)
    names = [c for c, k in physical_classes(df).items() if k == "string" and c not in skip]
    if not names:
        return df, meta, record
    sample = text_sample(df, keys, names, cfg)
    facts = sampled_text_facts(sample, vocabulary, cfg).withColumn("is_candidate", candidate_rule())
    gate = opinion_gate(sample, scorer, cfg)
    rows = {r["column"]: r for r in facts.join(F.broadcast(gate), "column").collect()}
    n_rows, present = non_null_counts(df, names)
    chosen = []
    for c in names:
        r = rows.get(c)
        if r is None or not r["is_candidate"]:
            continue
        meta["candidates"].append({**{k: r[k] for k in ("column", "avg_words", "unique_word_ratio", "keyword_signal")}, "non_null_count": present[c]})
        found = {"column": c, "opinion_frac": r["opinion_frac"], "mean_conf": r["mean_conf"]}
        if r["passes"]:
            added = [f"{c}_sentiment", f"{c}_sentiment_num", f"{c}_sentiment_confidence"]
            meta["analyzed"].append({**found, "rows_processed": n_rows, "added_columns": added})
            chosen.append(c)
        else:
            meta["skipped"].append(found)
    return annotate(df, chosen, scorer, cfg), meta, record

