"""Live daily means with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import daily_mean_gated


def daily_mean_stream(
    sdf: DataFrame, keys: Sequence[str], ts: str, col: str, delay: str, min_n: int, date: str = "Date"
) -> DataFrame:
    """Streaming form of the gated daily mean (L1), for update or append mode.

    In append mode a day is emitted once the watermark has passed its end, in update mode with each batch that changes it; rows
    later than ``delay`` are dropped. State is one running sum and count per key and open day. ``run_updates`` is a sink for
    update mode whose open days are there too; with append mode ``with_open_days`` closes the last days at the end.
    """
    rows = sdf.where(F.col(col).isNotNull()).withWatermark(ts, delay)
    daily = rows.groupBy(*keys, F.window(ts, "1 day")).agg(
        F.avg(col).alias("__mean"), F.count(F.lit(1)).alias("__n")
    )
    return daily.select(
        *keys,
        F.to_date("window.start").alias(date),
        F.when(F.col("__n") >= min_n, F.col("__mean")).alias(col),
    )


def with_open_days(
    closed: DataFrame, rows: DataFrame, keys: Sequence[str], ts: str, col: str, min_n: int, date: str = "Date"
) -> DataFrame:
    """The stream's days and, by one batch pass, the days still open when it ended (L1 equals E2).

    A day of all keys is emitted when the watermark passes its end, so the open days are those after the last
    one emitted. ``rows`` is the stream's source, read as a table.
    """
    last = F.coalesce(closed.agg(F.max(date)).scalar(), F.lit("0001-01-01").cast("date"))
    rest = daily_mean_gated(rows.where(F.to_date(ts) > last), keys, ts, col, min_n, date=date)
    return closed.unionByName(rest)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available now into Parquet files and stop."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available now in update mode and stop; ``current_rows`` reads the result.

    Every batch writes the rows that it changed to a folder of its own number, over what a broken run of the same batch has
    left there, so a restart repeats nothing. Readers find whole batches only: the folder is complete when its files are committed.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def current_rows(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Of each key (series and day) the row of the last batch that changed it; open days are there as they stand."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    names = [c for c in rows.columns if c != "batch"]
    rest = [c for c in names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in names])
