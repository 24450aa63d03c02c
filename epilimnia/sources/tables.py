"""Sources and sinks: delimited or Parquet tables with explicit types, no type inference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("Reservoir", "Layer", "Event", "Method", "site_id", "variable", "method", "Notes")
INT_COLUMNS = ("Site", "Rep", "ID", "year", "Year", "RECORD", "length")
DATE_COLUMNS = ("Date", "HOxOn", "HOxOff", "start", "end")
TIME_COLUMNS = ("DateTime", "datetime")


def column_type(name: str) -> T.DataType:
    """Type of a column by naming convention: fixed names first, flags INT, everything else DOUBLE."""
    if name in TEXT_COLUMNS:
        return T.StringType()
    if name in INT_COLUMNS or name.startswith("Flag_"):
        return T.IntegerType()
    if name in DATE_COLUMNS:
        return T.DateType()
    if name in TIME_COLUMNS:
        return T.TimestampType()
    return T.DoubleType()


def sensor_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, column_type(n)) for n in names])


def _format(path: str, format: str | None) -> str:
    """``csv`` or ``parquet``: as told, else by the path's suffix."""
    if format is None:
        name = path.rstrip("/").lower().removesuffix(".gz").removesuffix("*")
        format = "parquet" if name.endswith(".parquet") else "csv" if name.endswith((".csv", ".txt")) else None
    if format not in ("csv", "parquet"):
        raise ValueError(f"name the format of {path}: csv or parquet")
    return format


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, format: str | None = None,
    damaged: str | None = None, strict: bool = False,
) -> DataFrame:
    """Read delimited or Parquet files (A1); columns of several files meet by name.

    Without a schema the header line gives the names and ``column_type`` the types. Empty fields and
    ``NA`` are NULL; non-finite numbers become NULL. A file whose header differs from what its path's first
    file or the schema says raises an error instead of being read by position.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {_format(p, format) for p in paths}
    if kinds == {"parquet"}:
        return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    if len(kinds) > 1:
        raise ValueError("files of different formats")
    reader = spark.read.option("header", True).option("nullValue", "NA").option("enforceSchema", False)
    if strict:
        reader = reader.option("mode", "FAILFAST")
    extra = [T.StructField(damaged, T.StringType())] if damaged else []
    if damaged or strict:  # else only the fields that a query uses are looked at
        reader = reader.option("columnPruning", False)
    if damaged:
        reader = reader.option("columnNameOfCorruptRecord", damaged)
    if schema is not None:
        return _clean(reader.schema(T.StructType([*schema.fields, *extra])).csv(paths), damaged)
    headers: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        headers.setdefault(tuple(reader.csv(p).columns), []).append(p)
    typed = {names: T.StructType([*sensor_schema(names).fields, *extra]) for names in headers}
    parts = [_clean(reader.schema(typed[names]).csv(same), damaged) for names, same in headers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _clean(df: DataFrame, damaged: str | None = None) -> DataFrame:
    clean = {}
    for f in df.schema.fields:
        if f.name == damaged:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            clean[f.name] = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, T.DoubleType):
            clean[f.name] = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return df.withColumns(clean)


def damaged_lines(df: DataFrame, damaged: str, keys: Sequence[str] = ()) -> DataFrame:
    """Number of rows, of damaged lines, and of rows without any value, for instance by ``source_file``."""
    values = [F.col(f"`{c}`") for c in df.columns if c not in (damaged, *keys, "source_file")]
    empty = reduce(and_, [c.isNull() for c in values], F.lit(True))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(damaged).alias("damaged"), F.count(F.when(empty, F.lit(1))).alias("empty")
    )


def read_many(
    spark: SparkSession, paths: Sequence[str], same_header: bool = False, damaged: str | None = None, strict: bool = False
) -> DataFrame:
    """Several files appended by column name, with their path in ``source_file`` (A4); ``damaged`` and ``strict`` as in ``read_table``."""
    if same_header:
        return read_table(spark, list(paths), damaged=damaged, strict=strict).withColumn("source_file", F.input_file_name())
    parts = [read_table(spark, p, damaged=damaged, strict=strict).withColumn("source_file", F.input_file_name()) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def as_df(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """Path or table (A3)."""
    return source if isinstance(source, DataFrame) else read_table(spark, source)


def with_current(historic: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Historic table plus an optional current one (A5)."""
    return historic if current is None else historic.unionByName(current, allowMissingColumns=True)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Treatment intervals: Reservoir, HOxOn, HOxOff (A2)."""
    return read_table(spark, path).select("Reservoir", "HOxOn", "HOxOff")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Dated events: Reservoir, Date, Event, ID (A2)."""
    return read_table(spark, path).select("Reservoir", "Date", "Event", "ID")


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """Recorded stratified periods: year, length, start, end, site_id, method (A2)."""
    return read_table(spark, path)


def write_table(df: DataFrame, path: str | None, partition_by: Sequence[str] = (), format: str | None = None) -> DataFrame:
    """Write when a path is given and hand the table back (A7), as the suffix or ``format`` says."""
    if path is not None:
        writer = df.write.mode("overwrite").partitionBy(*partition_by)
        if _format(path, format) == "csv":
            writer.option("header", True).option("nullValue", "NA").csv(path)
        else:
            writer.parquet(path)
    return df


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Save as a table of the catalogue that is bucketed and sorted by ``keys`` (A7), and read it back.

    Tables with equal buckets join and exclude each other on these keys, or aggregate by them, without moving rows; use
    ``join_buckets``. Rows of one key lie in one bucket, so give keys without a hot value, and as many buckets as make files that
    a task can sort.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def join_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Sort-merge join of two bucketed tables on their bucket keys; NULL keys match nothing."""
    return left.join(right.hint("merge"), list(keys), how)


def write_sorted(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> str:
    """Write Parquet files whose names follow ``order``, sorted inside (G1). Ranges are cut by a sample, so files are about even."""
    ranges = df.repartitionByRange(*([files] if files else []), *order)
    ranges.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return path


def read_sorted(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """Rows of ``write_sorted`` with their place in the order, from 1.

    The place is that within the file plus the rows of all earlier files: one row for each file is summed, no row is sorted or moved.
    """
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = spark.read.parquet(path).select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(starts, "__file").withColumn(position, F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")
