"""Queries of the corpus operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    alignment, bpe, chunk_table, embedding_dedup, fingerprint, merkle, minhash_dedup, oracle_sql, packing, quality, sharding, suffix_dedup, toxicity, url_filter,
)
from tabloom.llm.common import small_batches
from tabloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_minhash_dedup": oracle_sql.OP3, "op10_embedding_dedup": oracle_sql.OP10, "op13_merkle": oracle_sql.OP13}
SHARDS = 40


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# The rules that op1 is asked to apply, from the task: action, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each page's url."""
    rules = [*[url_filter.host_rule(*r) for r in URL_RULES], *url_filter.PATTERNS]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


ORACLES["op1_url_filter"] = """
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages
), fitted AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?(ads|track)[.-]') THEN 'block' ELSE 'allow' END AS verdict
FROM fitted"""


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of each document once repeated 200-byte strings are gone."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the text that they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document, and whether its language's thresholds let it pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs, table(spark, sf_dir, "labels"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place in it of each document."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS, scratch_path(spark, "slot-map"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place in it of each piece of each document."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def held_out(id: str) -> Column:
    """Documents whose labels no model sees."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in each document, and the corpus-wide counts of its links."""
    scores, _ = alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return scores


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces of each document and of the text that they decode to."""
    return chunk_table.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and whether its tampered form would pass."""
    return merkle.manifest(table(spark, sf_dir, "documents"), tamper=merkle.lowered_third)
