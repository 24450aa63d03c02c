"""Series scans in small chunks and whole give the same rows, also with one hot key and NULL keys."""

import random

import pytest
from pyspark.sql import functions as F

from epilimnia.operators import aggregate, fill, grid, runs, scan


def small():
    return F.floor(F.col("t") / 7)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.3 else float(rng.randint(0, 3))
        data.append((key, i, value))
    return spark.createDataFrame(data, "k string, t long, v double").repartition(5).persist()


def result(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def by_key(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["t"]):
        out.setdefault(r["k"], []).append((r["t"], r["v"]))
    return out


def test_running_sums_match_plain_and_brute_force(rows):
    sums = {"s": F.col("v"), "n": F.lit(1).cast("long")}
    chunked = scan.running_sums(rows, ["k"], ["t"], sums, chunk=small())
    assert result(chunked) == result(scan.running_sums(rows, ["k"], ["t"], sums, bounded=True))
    want = []
    for k, seq in by_key(rows).items():
        total, dead = 0.0, False
        for i, (t, v) in enumerate(seq, 1):
            dead = dead or v is None
            total += v or 0.0
            want.append((k, t, None if dead else total, i))
    got = [(r["k"], r["t"], r["s"], r["n"]) for r in chunked.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lenient_running_sum(rows):
    a = scan.running_sums(rows, ["k"], ["t"], {"s": F.col("v")}, strict=False, chunk=small())
    b = scan.running_sums(rows, ["k"], ["t"], {"s": F.col("v")}, strict=False, bounded=True)
    assert result(a) == result(b)


def test_runs_match_brute_force(rows):
    chunked = runs.runs(rows, ["k"], ["t"], "v", chunk=small())
    assert result(chunked) == result(runs.runs(rows, ["k"], ["t"], "v", bounded=True))
    want = []
    for k, seq in by_key(rows).items():
        last = object()
        for t, v in seq:
            if v != last:
                want.append([k, v, 0, t, t])
                last = v
            want[-1][2] += 1
            want[-1][4] = t
    got = [[r["k"], r["v"], r["length"], r["start"], r["end"]] for r in chunked.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) == rows.count()


def test_null_runs(rows):
    a = runs.null_run_stats(rows, ["k"], ["t"], "v", chunk=small())
    assert result(a) == result(runs.null_run_stats(rows, ["k"], ["t"], "v", bounded=True))


@pytest.mark.parametrize("kwargs", [{"maxgap": 1}, {"maxgap": None}, {"edges": "nearest"}])
def test_interpolation(rows, kwargs):
    a = fill.interpolate(rows, ["k"], ["t"], "v", chunk=small(), **kwargs)
    b = fill.interpolate(rows, ["k"], ["t"], "v", bounded=True, **kwargs)
    assert result(a) == result(b)
    known = [v for seq in by_key(rows).values() for _, v in seq if v is not None]
    got = [r["v"] for r in a.collect() if r["v"] is not None]
    assert min(known) <= min(got) and max(got) <= max(known)


def test_fill_and_interpolate(spark, rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("t") * 600)).drop("t")
    a = fill.fill_gaps(timed, ["k"], "ts", 600, interpolated="v", maxgap=3, chunk=F.floor(F.unix_timestamp("ts") / 5000))
    b = fill.fill_gaps(timed, ["k"], "ts", 600, interpolated="v", maxgap=3, bounded=True)
    assert result(a) == result(b)
    # the same as filling first and interpolating over row positions afterwards
    two = fill.interpolate(fill.fill_gaps(timed, ["k"], "ts", 600), ["k"], ["ts"], "v", maxgap=3)
    close = lambda df: sorted(
        ((str(r["k"]), r["ts"], None if r["v"] is None else round(r["v"], 9)) for r in df.collect()), key=str
    )
    assert close(a) == close(two)
    again = fill.fill_gaps(a, ["k"], "ts", 600)
    assert again.count() == a.count()


def test_exact_quantiles_of_a_hot_group(rows):
    probs = {"q1": 0.25, "med": 0.5, "q9": 0.9}
    a = aggregate.exact_quantiles(rows, ["k"], "v", probs)
    built_in = rows.where("v IS NOT NULL").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()])
    assert result(a) == result(built_in)
    b = {r["k"]: r["MedianV"] for r in aggregate.summarise_stats(rows, ["k"], {"v": "V"}).collect()}
    assert b == {r["k"]: r["med"] for r in built_in.collect()}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double", "int"])
def test_default_chunks_follow_the_order(spark, kind):
    base = "timestamp_seconds((id - 300) * 86400 * 3)" if kind in ("date", "timestamp") else f"cast((id - 300) * 1.7 as {kind})"
    base = "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id * 3 as int))" if kind == "timestamp_ntz" else base
    df = spark.range(600).selectExpr("id", f"cast({base} AS {kind}) AS o")
    chunk = [r[0] for r in df.select(scan.order_bucket(df, [F.col("o")]).alias("c"), "id").orderBy("id").collect()]
    assert chunk == sorted(chunk) and len(set(chunk)) > 10
    with pytest.raises(ValueError):
        scan.order_bucket(df.selectExpr("cast(id as string) o"), [F.col("o")])


def test_clock_change_does_not_shift_times_without_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT 'a' k, timestamp_ntz'2020-03-08 00:00:00' ts, 0D v UNION ALL SELECT 'a', timestamp_ntz'2020-03-08 06:00:00', 6D")
        out = [r["v"] for r in fill.fill_gaps(df, ["k"], "ts", 3600, interpolated="v").orderBy("ts").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert out == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_long_gap_is_unrolled_in_blocks(spark):
    df = spark.sql("SELECT 'a' k, timestamp_seconds(0) ts, 0D v UNION ALL SELECT 'a', timestamp_seconds(60 * 20000), 20000D")
    out = fill.fill_gaps(df, ["k"], "ts", 60, interpolated="v")
    assert out.count() == 20001
    assert out.where(F.abs(F.col("v") - F.unix_timestamp("ts") / 60) > 1e-6).count() == 0


def test_profile_steps_of_a_long_profile(rows):
    df = rows.withColumn("t", F.col("t").cast("double"))
    a = runs.profile_gradient(df, ["k"], "t", ["v"], chunk=small())
    assert result(a) == result(runs.profile_gradient(df, ["k"], "t", ["v"], bounded=True))
    seq = by_key(rows)["hot"]
    got = {r["t"]: (r["next_t"], r["next_v"]) for r in a.where("k = 'hot'").collect()}
    assert got == {float(t): (float(n[0]), n[1]) if n else (None, None) for (t, _), n in zip(seq, [*seq[1:], None])}


def test_grid_of_a_long_cast(spark, monkeypatch):
    df = spark.range(300).select(
        F.lit("a").alias("k"), F.expr("date_add(date'2020-01-01', cast(id % 3 as int))").alias("d"),
        (F.floor(F.col("id") / 3) * 0.11).alias("z"), F.sqrt(F.col("id") + 1).alias("v"),
    )
    a = grid.grid_interpolate(df, ["k"], "d", "z", "v")
    monkeypatch.setattr(grid, "CHUNK", 1)
    assert result(a) == result(grid.grid_interpolate(df, ["k"], "d", "z", "v"))


def test_long_filled_series_is_spread(spark):
    df = spark.sql("SELECT 'a' k, timestamp_seconds(60 * id * id) ts, double(id * id) v FROM range(200)")
    a = fill.fill_gaps(df, ["k"], "ts", 60, interpolated="v")
    assert a.count() == 199 * 199 + 1
    assert a.where(F.abs(F.col("v") - F.unix_timestamp("ts") / 60) > 1e-6).count() == 0
