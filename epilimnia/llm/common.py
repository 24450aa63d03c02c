"""Helpers shared by the operators of this subpackage: tables, the shared folder, label folds, logistic calibration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: White space of words and of text normalisation (fixed value of the contracts).
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            root = set_already.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of settled tables that nothing reads any more: what was made from them is settled too."""
    for table in tables:
        remove(table.sparkSession, table.settled_at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this subpackage wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, usable: Column, bounds: dict[int, int], max_chars: int
) -> pd.DataFrame:
    """``label, text, mix`` of at most ``bounds[label]`` labelled documents of at most ``max_chars`` characters, for the driver.

    The ids are chosen first, by a hash (``mix``), among the label rows that pass ``usable``; so the side that is broadcast never
    exceeds the sum of the bounds, and texts don't move. An id with several labels counts with the highest.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(column).isin(*bounds)).groupBy("doc_id").agg(F.max(column).alias("label"))
    mixed = known.select("doc_id", "label", F.xxhash64(F.lit(column), "doc_id").alias("mix"))
    chosen = reduce(DataFrame.unionAll, [mixed.where(F.col("label") == v).orderBy("mix").limit(n) for v, n in bounds.items()])
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", "mix")
    return rows.orderBy("label", "mix", "text").limit(sum(bounds.values())).toPandas()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last one: intercept) of a ridge logistic regression, by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + penalty * w
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def keep_rows(docs: DataFrame, decider: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """The rows for whose texts the decider, made once in each task, gives True; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(np.asarray(decide(texts), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def per_text(
    docs: DataFrame, maker: Callable[[], Callable[[list[str | None]], list[pa.Array]]], columns: str, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The ``carry`` columns as they are, and ``columns`` that the function made once in each task gives for a list of texts."""
    chosen = docs.select(*carry, "text")
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = maker()
        for batch in batches:
            made = work(batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=names)

    schema = StructType([*chosen.schema.fields[:n], *_parse_datatype_string(columns)])
    names = schema.names
    return chosen.mapInArrow(run, schema)
