"""The whole analysis: profile, title, clean, sentiment, features, relations, report."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import cleaning, features, profile, relations, responses, sentiment
from tabloom.operators.cleaning import validate_targets
from tabloom.operators.facts import physical_classes
from tabloom.session import scratch_path
from tabloom.settings import DEFAULTS, Settings
from tabloom.sources import csv
from tabloom.sources.store import ResultStore, files_digest, table_digest

RELATIONS_SCHEMA = (
    "seq int, parent_a string, parent_b string, feature_a string, feature_b string, method string, "
    "effect_size double, p_value double, n long, direction string, priority_weight int, "
    "adjusted_p_value double, significant_fdr boolean, rank_score double"
)


ROW = "_tabloom_row"  # key given to a table that has none


def analyze_csv(spark: SparkSession, path: str, primary: str, secondary=(), task: str = "classification",
                name: str = "table", out: str | None = None, multi_line: bool | None = None, **options) -> dict[str, DataFrame]:
    """:func:`analyze` of a CSV file or folder.

    Rows are numbered in file order, and the numbered table is written once so
    that the numbers never change afterwards.  It is made anew when a file's name, size or time has changed.
    """
    out = out or scratch_path(spark, name)

    def build():
        typed = csv.infer_types(csv.read_csv(spark, path, multi_line=multi_line))
        return typed.withColumn(ROW, F.monotonically_increasing_id())

    source = ResultStore(spark, out).stage("source", build, [files_digest(spark, path)], {"multi_line": multi_line})
    return analyze(source.table, [ROW], primary, secondary, task, name, out, version=source.digest, **options)


def analyze(df: DataFrame, keys: list[str], primary: str, secondary=(), task: str = "classification",
            name: str = "table", out: str | None = None, scorer=None, epoch_units: dict[str, str] | None = None,
            response: str | None = None, export: str | None = None, cfg: Settings = DEFAULTS, version: str | None = None) -> dict[str, DataFrame]:
    """Runs every stage on one table; a stage is read back, not redone, if all that it depends on is the same.

    That is the table, the settings that it uses and the stages before it.  The table is told by ``version`` (a snapshot's name, say) or
    else by a digest of its rows, which costs one scan.  With ``export``, the cleaned, enriched and feature tables are also
    written there as CSV, a folder each.

    ``keys`` identify a row and give its order.  Wide stage tables are written
    once and re-read, so each decision scans files rather than the chain before.
    """
    secondary = validate_targets(df.columns, primary, list(secondary), task)
    spark = df.sparkSession
    store = ResultStore(spark, out or scratch_path(spark, name))
    body = [c for c in df.columns if c not in keys or c in (primary, *secondary)]
    shown = [c for c in df.columns if c != ROW]
    source = version or table_digest(df)
    rules = asdict(cfg)

    first_profile = store.stage("profile", lambda: profile.profile(df, keys, shown), [source], [keys])
    tags = {r["column"]: r["dtype"] for r in first_profile.table.select("column", "dtype").collect()}
    title = store.stage("title", lambda: profile.title_corpus({name: df.drop(ROW)}), [source], [name])

    def build_clean():
        cleaned, dropped, record = cleaning.clean(
            df, keys, name, primary, secondary, task, epoch_units,
            [c for c, t in tags.items() if t == "datetime" and dict(df.dtypes)[c] == "string"], cfg)
        return cleaned, {"targets": record, "dropped": dropped}

    clean = store.stage("cleaned", build_clean, [source, first_profile], [keys, name, primary, secondary, task, epoch_units, rules])
    cleaned, dropped = clean.table, clean.records["dropped"]
    # cleaning may have found that a column is a date, or is none
    kinds = physical_classes(cleaned)
    repaired = {c: k for c, k in kinds.items() if k == "datetime" or (k == "numeric" and tags.get(c) == "datetime")}
    profiled = first_profile
    if repaired:
        tags.update(repaired)
        fixed = F.create_map(*[F.lit(x) for pair in repaired.items() for x in pair])
        profiled = store.stage("profile_repaired", lambda: first_profile.table.withColumn("dtype", F.coalesce(fixed[F.col("column")], F.col("dtype"))),
                               [first_profile, clean])

    def build_enriched():
        enriched, meta, updated = sentiment.enrich(
            cleaned, keys, clean.records["targets"], scorer, {c for c, t in tags.items() if t == "datetime"} | set(keys), cfg)
        return enriched, {"sentiment": meta, "targets": updated}

    rich = store.stage("enriched", build_enriched, [clean, profiled], [keys, rules, _named(scorer)])
    enriched, record, found = rich.table, rich.records["targets"], rich.records["sentiment"]
    targets = [t for t in [record["primary"], *record["secondary"]] if t in enriched.columns]
    # a row key that was an identifier column only orders rows; it is no feature
    model_columns = [c for c in enriched.columns if c not in dropped and (c in body or c not in keys)]

    def build_features():
        table, meta = features.engineer(enriched.select(*[f"`{c}`" for c in model_columns]), tags, targets, cfg)
        return table, {"meta": meta}

    raw = store.stage("features_raw", build_features, [rich, profiled], [model_columns, targets, rules])

    def build_meta():
        kept, meta = features.prune(raw.table, raw.records["meta"], targets)
        return None, {"meta": {**meta, "columns": kept.columns}}

    pruned = store.stage("features", build_meta, [raw], [targets])
    meta = pruned.records["meta"]
    table = raw.table.select(*[f"`{c}`" for c in meta["columns"]])
    links = [tuple(link) for link in meta["lineage"]]

    def build_relations():
        facts = relations.type_facts(table)
        kinds = {f["column"]: f["kind"] for f in facts}
        reps = relations.representatives(table.columns, kinds, links, found.get("existing_sentiment", ()))
        numeric = {c for c, t in tags.items() if t == "numeric"}
        pairs = relations.plan_pairs(table, reps, facts, record["primary"], record["secondary"], numeric, cfg)
        if not pairs:
            return spark.createDataFrame([], RELATIONS_SCHEMA)
        computed = relations.compute(table, pairs, kinds, cfg, facts)
        ranked = relations.rank(computed, record["primary"], record["secondary"], cfg)
        return ranked.select(*[part.split()[0] for part in RELATIONS_SCHEMA.split(", ")])

    related = store.stage("relations", build_relations, [pruned, profiled], [record["primary"], record["secondary"], rules])
    ranked = related.table
    n_rows = profiled.table.agg(F.max("n_rows")).first()[0]

    def build_selected():
        good = relations.quality(ranked, n_rows, cfg)
        picked = relations.select(good, record["primary"], record["secondary"])
        chosen = ranked.where(F.col("seq").isin([r["seq"] for r in picked]))
        return relations.sentences(chosen)

    selected = store.stage("selected", build_selected, [related], [n_rows, rules]).table
    column = sentiment.resolve_sentiment_column(table.columns, found.get("existing_sentiment", ()))
    counts = sentiment.distribution(table, column) if column else None
    result = {
        "profile": profiled.table, "title": title.table, "cleaned": cleaned, "enriched": enriched, "features": table,
        "relations": ranked, "selected": selected, "summary": relations.summary_document(selected, n_rows, cfg),
        "report": responses.report_facts(profiled.table, counts, selected),
    }
    if counts is not None:
        result["sentiment"] = counts
    if export:
        for stage in ("cleaned", "enriched", "features"):
            csv.write_csv(result[stage], f"{export.rstrip('/')}/{stage}")
    if response is not None:
        text = spark.createDataFrame([(response,)], "response string")
        split = responses.split_responses(text, "response")
        result["response"] = split.withColumn("summary", responses.sanitize_summary(F.col("summary")))
    return result


def _named(scorer) -> object:
    """What tells one scorer from another: its class with its ``version``, or else with its settings.  A scorer that holds
    anything but plain values and has no version is taken for another one in every run."""
    if scorer is None:
        return None
    held = vars(scorer)
    version = getattr(scorer, "version", None)
    if version is None and not all(isinstance(v, (str, int, float, tuple, list, dict, type(None))) for v in held.values()):
        version = uuid.uuid4().hex
    return [type(scorer).__qualname__, version or held]
