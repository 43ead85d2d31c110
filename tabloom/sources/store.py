"""Stage tables and small JSON records under one result folder, addressed by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom import __version__
from tabloom.operators.ranking import quoted_col


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def _of_hashes(h: Column) -> list[Column]:
    """Count, exclusive or, and sums of two parts that are short enough for any number of rows."""
    return [F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFF)), F.sum(F.shiftright(h, 16).bitwiseAND(0xFFFF))]


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order; one scan."""
    row = F.xxhash64(*[quoted_col(c).cast("string") for c in df.columns])
    return digest(df.dtypes, list(df.select(row.alias("h")).agg(*_of_hashes(F.col("h"))).first()))


def files_digest(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files under a path; none of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    h = F.xxhash64("path", "length", "modificationTime")
    return digest(path, list(files.select(h.alias("h")).agg(*_of_hashes(F.col("h"))).first()))


@dataclass(frozen=True)
class Stage:
    """A finished stage: its digest, its table (None if it has records only) and its records."""

    name: str
    digest: str
    table: DataFrame | None
    records: dict = field(default_factory=dict)
    reused: bool = False


class ResultStore:
    """``<root>/<stage>/<digest>`` as Parquet and ``<root>/manifest/<stage>/<digest>`` as JSON.

    A stage's digest covers its name, its settings, the version of the library and the digests of the stages before it, the
    first of which is the input's.  Its manifest is written after its table.  So a stage is read back only if everything
    that it was made from is the same; where anything differs, it and all stages after it are made anew.  Results of
    other inputs and settings stay beside it, and a run that was stopped in the middle of a write leaves no manifest.
    Folders whose digest no run names any more may be deleted by whoever owns the result folder.

    A written stage also cuts the plan: a lost executor re-reads files instead of recomputing earlier stages.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def stage(self, name: str, build: Callable[[], object], after: list[Stage | str] = (), settings: object = None) -> Stage:
        """The stage, built unless it is there.

        ``build`` gives a DataFrame, or (DataFrame or None, records).  ``after``: the stages, or digests of inputs, that it reads.
        """
        key = digest(name, __version__, settings, [s if isinstance(s, str) else s.digest for s in after])
        found = self._manifest(name, key)
        path = f"{self.root}/{name}/{key}"
        reused = found is not None
        if not reused:
            built = build()
            table, records = built if isinstance(built, tuple) else (built, {})
            if table is not None:
                table.write.mode("overwrite").parquet(path)
            found = {"stage": name, "digest": key, "table": table is not None, "settings": settings, "records": records}
            line = self.spark.createDataFrame([(json.dumps(found, default=str),)], "value string")
            line.coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{name}/{key}")
            found = json.loads(json.dumps(found, default=str))
        return Stage(name, key, self.spark.read.parquet(path) if found["table"] else None, found["records"], reused)

    def _manifest(self, name: str, key: str) -> dict | None:
        try:
            row = self.spark.read.text(f"{self.root}/manifest/{name}/{key}").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(row["value"]) if row else None


CORPUS_SCHEMA = T.StructType([
    T.StructField("csv_data_summary", T.StringType()), T.StructField("title", T.StringType()),
])


def write_corpus(corpus: DataFrame, path: str) -> None:
    """JSON lines of (csv_data_summary, title)."""
    corpus.select("csv_data_summary", "title").write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS_SCHEMA).json(path)
