"""Session helpers: literal tables and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def literal_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """Inline table.

    Built from Arrow, so Catalyst sees a local relation with its true size and can broadcast it on
    its own size check.
    """
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for what a query writes: the session's own setting, else a temp folder in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="epilimnia-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: made once, however many times it is used."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
