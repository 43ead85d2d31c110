"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tuned(builder):
    """Settings the library expects; everything else is left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call-site capture per Column call: it costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, inside the folder the cluster shares.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    temporary folder serves a local session (as in unit tests); on a cluster
    that is an error, since executors do not share such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tabloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: what depends on it
    sees the same rows each time, and a lost executor rereads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
