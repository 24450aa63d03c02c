import uuid

from pyspark.sql import functions as F

from epilimnia.operators.aggregate import daily_mean_gated
from epilimnia.streaming.daily import daily_mean_stream, run_available, with_open_days


def test_stream_equals_batch_for_closed_days(spark, tmp_path):
    rows = spark.range(6 * 24 * 4).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"),
        F.timestamp_seconds(1577836800 + F.col("id") * 600).alias("ts"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("x"),
    )
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run_available(daily_mean_stream(stream, ["k"], "ts", "x", "1 hour", 50), str(tmp_path / "out"), str(tmp_path / f"state-{uuid.uuid4().hex}"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "Date", F.round("x", 6)).collect())
    batch = daily_mean_gated(rows, ["k"], "ts", "x", 50).where("Date < date'2020-01-04'")
    want = sorted(tuple(r) for r in batch.select("k", "Date", F.round("x", 6)).collect())
    assert got == want and len(got) == 6
    whole = with_open_days(spark.read.parquet(str(tmp_path / "out")), rows, ["k"], "ts", "x", 50)
    batch = daily_mean_gated(rows, ["k"], "ts", "x", 50)
    assert sorted(map(str, whole.select("k", "Date", F.round("x", 6)).collect())) == sorted(map(str, batch.select("k", "Date", F.round("x", 6)).collect()))
