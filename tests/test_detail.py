"""Planned chunks, radix quantiles, interval sweeps, steps, bands, stream sink, sinks and damaged input on small tables."""

import math
import random
import statistics
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from epilimnia.functions.pvalues import t_quantile, two_sided_p
from epilimnia.operators import aggregate as A
from epilimnia.operators import fill, grid, joins, scan
from epilimnia.operators import stats as T
from epilimnia.sources import tables as IO
from epilimnia.streaming.daily import current_rows, daily_mean_stream, run_updates

MINUTES = "SELECT 1 AS k, 1700000000 + id * 60 AS o, id FROM range(20000)"  # two weeks of epoch seconds


@pytest.mark.parametrize(
    ("sql", "keys", "order"),
    [
        (MINUTES, ["k"], ["o"]),
        ("SELECT 1 AS k, id + 1000000000000 AS o, id FROM range(20000)", [], ["o"]),
        ("SELECT 1 AS k, id * id AS o, id FROM range(20000)", ["k"], ["o"]),
        ("SELECT id % 2 AS k, -0.5 * id AS o, id FROM range(20000)", ["k"], ["o"]),
        ("SELECT cast(null as int) AS k, timestamp_seconds(id * 30) AS o, id FROM range(20000)", ["k"], ["o"]),
        ("SELECT 1 AS k, date_add(date'2020-01-01', cast(id / 5000 as int)) AS o, id FROM range(20000)", [], ["o", "id"]),
        ("SELECT 1 AS k, if(id % 3 = 0, 'a', 'b') AS o, date_add(date'2020-01-01', cast(id / 10 as int)) AS d, id FROM range(20000)", [], ["o", "d", "id"]),
    ],
)
def test_no_chunk_exceeds_its_bound(spark, monkeypatch, sql, keys, order):
    monkeypatch.setattr(scan, "CHUNK_ROWS", 2_000)
    df = spark.sql(sql).repartition(4)
    rows = scan.planned_chunks(df, keys, [F.col(c) for c in order])
    sizes = [r["count"] for r in rows.groupBy(*keys, "__chunk").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2_000 and len(sizes) >= 10
    edges = rows.groupBy(*keys, "__chunk").agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b"))
    last = {}
    for r in sorted(edges.collect(), key=lambda r: r["__chunk"]):
        key = tuple(r[k] for k in keys)
        assert key not in last or last[key] < tuple(r["a"])
        last[key] = tuple(r["b"])
    got = scan.positions(df, keys, order).select("id", "position").collect()
    want = scan.positions(df, keys, order, bounded=True).select("id", "position").collect()
    assert sorted(got) == sorted(want)


def test_quantiles_of_infinite_and_close_values(spark):
    inf = math.inf
    rows = [("a", 1.0, 5), ("a", inf, 6), ("a", inf, 7), ("b", -inf, 1), ("b", 2.0, None), ("c", None, None), ("d", 1e9, 1), ("d", 1e9 + 1e-3, 1), ("d", 1e9 + 2e-3, 1)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    got = {r["k"]: (r["m"], r["q"], r["n"]) for r in A.exact_quantiles_of(df, ["k"], {"x": {"m": 0.5, "q": 0.25}, "y": {"n": 0.5}}).collect()}
    assert got["a"] == (inf, inf, 6.0) and got["b"][0] == -inf and got["b"][2] == 1.0 and "c" not in got
    assert got["d"][:2] == (1e9 + 1e-3, (1e9 + (1e9 + 1e-3)) / 2)


def test_quantiles_match_plain_python(spark):
    rng = random.Random(1)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(3000)] + [0.0] * 50
    df = spark.createDataFrame([(v, -v) for v in values], "x double, y double")
    got = A.exact_quantiles_of(df, [], {"x": {f"x{p}": p / 10 for p in range(11)}, "y": {"y5": 0.5}}).first()
    order = sorted(values)
    for p in range(11):
        at = p / 10 * (len(order) - 1)
        low, w = order[math.floor(at)], at - math.floor(at)
        assert got[f"x{p}"] == pytest.approx(low * (1 - w) + order[math.ceil(at)] * w, rel=1e-12)
    assert got["y5"] == pytest.approx(-statistics.median(values))


def test_operators_without_keys(spark):
    df = spark.sql("SELECT cast(id as double) AS v, id FROM range(11)")
    assert A.summarise_stats(df, [], {"v": "V"}).first()["MedianV"] == 5.0
    assert {r["m"] for r in A.attach_stats(df, [], {"m": F.max("v")}).collect()} == {10.0}
    assert A.having_rows(df, [], 11).count() == 11 and A.having_rows(df, [], 12).count() == 0
    points = spark.sql("SELECT date_add(date'2020-01-01', cast(id % 3 as int)) AS d, cast(floor(id / 3) as double) AS z, id * 1D AS v FROM range(12)")
    assert grid.grid_interpolate(points, [], "d", "z", "v").count() == 3 * 7


def test_wrong_depth_ends_in_bounded_memory(spark):
    points = spark.sql("SELECT 'a' AS k, date'2020-01-01' AS d, z, z AS v FROM VALUES (0D), (1D), (3000000D) AS t(z)")
    out = grid.grid_interpolate(points, ["k"], "d", "z", "v", keep_empty=False)
    assert out.count() == 6_000_001
    kept = grid.grid_interpolate(points, ["k"], "d", "z", "v", keep_empty=False, depth_range=(0, 100))
    assert sorted(r["y"] for r in kept.collect()) == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("rows", [10, 500_000])
def test_open_intervals_match_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "CHUNK_ROWS", rows)
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(4000) * 10)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    events = [(i, key(), at() if i % 17 else None) for i in range(300)]
    spans = [(key(), a := at(), a + timedelta(seconds=rng.randrange(-300, 3000))) for _ in range(60)] + [("hot", start, None), ("a", None, start)]
    df = spark.createDataFrame(events, "id long, k string, ts timestamp_ntz").repartition(3)
    iv = spark.createDataFrame(spans, "k string, a timestamp_ntz, b timestamp_ntz")
    got = {r["id"]: r["open"] for r in joins.open_intervals(df, iv, "ts", ["k"], "a", "b").collect()}
    want = {i: sum(k == q and t is not None and a is not None and b is not None and a <= t <= b for q, a, b in spans) for i, k, t in events}
    assert got == want
    assert joins.within_intervals(df, iv, "ts", ["k"], "a", "b").count() == sum(v > 0 for v in want.values())
    assert {r["id"]: r["state"] for r in joins.tag_intervals_at(df, iv, "ts", ["k"], "a", "b").collect()} == {i: "On" if v else "Off" for i, v in want.items()}


def test_steps_are_found_for_each_series(spark):
    df = spark.sql("""SELECT 'ten' AS k, timestamp_seconds(600 * id) AS ts, id * 1D AS v FROM range(100) WHERE id % 7 <> 3
      UNION ALL SELECT 'hour', timestamp_seconds(3600 * id), id FROM range(40) WHERE id % 11 <> 5 UNION ALL SELECT 'one', timestamp_seconds(5), 1""")
    assert {r["k"]: r["step"] for r in fill.series_steps(df, ["k"], "ts").collect()} == {"ten": 600.0, "hour": 3600.0}
    filled = fill.fill_gaps(df, ["k"], "ts", interpolated="v")
    assert {r["k"]: r["count"] for r in filled.groupBy("k").count().collect()} == {"ten": 100, "hour": 40, "one": 1}
    assert filled.where("v IS NULL").count() == 0
    days = spark.sql("SELECT date_add(date'2020-01-01', cast(id * 2 as int)) AS d, id AS v FROM range(10) WHERE id <> 4")
    assert fill.series_steps(days, [], "d").first()["step"] == 2
    assert fill.fill_gaps(days, [], "d").count() == 10


def test_t_quantiles(spark):
    # fixed values: two-sided 95 % and 99.9 % quantiles of the tables
    known = {(0.95, 1): 12.706204736, (0.95, 2): 4.30265273, (0.95, 10): 2.228138852, (0.95, 1000): 1.962339081, (0.999, 1): 636.619248769, (0.999, 5): 6.868826626, (0.5, 3): 0.764892328}
    for (level, df), want in known.items():
        assert spark.range(1).select(t_quantile(level, F.lit(df))).first()[0] == pytest.approx(want, rel=1e-8)
    rows = spark.sql("SELECT explode(array(1, 2, 3, 7, 30, 400, 100000)) AS df").select("df", t_quantile(0.9, F.col("df")).alias("t"))
    assert all(abs(r["p"] - 0.1) < 1e-9 for r in rows.select(two_sided_p(F.col("t"), F.col("df")).alias("p")).collect())
    line = spark.sql("SELECT 1 AS k, id AS x, id + (id % 3) AS y FROM range(12)")
    band = T.fit_line(line, "y", "x", ["k"], points=5, level=0.95).collect()
    same = T.fit_line(line, "y", "x", ["k"], points=5, quantile=2.228138851964939).collect()
    assert [(r["low"], r["high"]) for r in band] == [pytest.approx((r["low"], r["high"]), rel=1e-9) for r in same]


def test_stream_sink_after_restart_and_late_rows(spark, tmp_path):
    """Three files come one after the other, the second with late rows; the run is broken and repeated in between."""
    schema = "k string, ts timestamp, x double"
    rows = spark.range(6 * 24 * 3).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), F.timestamp_seconds(1577836800 + F.col("id") * 600).alias("ts"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("x"),
    )
    third = F.when(F.col("x") % 10 == 9, 1).otherwise((F.unix_timestamp("ts") - 1577836800) / 86400)  # some of the first day come with the second
    parts = [rows.where(third < 1), rows.where((third >= 1) & (third < 2)), rows.where((third >= 2) | third.isNull())]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: daily_mean_stream(spark.readStream.schema(schema).parquet(source), ["k"], "ts", "x", "2 days", 50)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        run_updates(stream(), out, state)
    run_updates(stream(), out, state)  # nothing new
    import shutil

    got = lambda path: sorted(map(str, current_rows(spark, path, "k string, Date date, x double", ["k", "Date"]).withColumn("x", F.round("x", 6)).collect()))
    whole = A.daily_mean_gated(rows, ["k"], "ts", "x", 50).select("k", "Date", F.round("x", 6).alias("x"))
    assert got(out) == sorted(map(str, whole.collect())) and len(got(out)) == 6
    # the last batch is run again, as after a crash before its number was noted
    again = str(tmp_path / "again")
    shutil.copytree(state, again)
    for f in (tmp_path / "again" / "commits").glob("*2*"):
        f.unlink()
    run_updates(stream(), out, again)
    assert got(out) == sorted(map(str, whole.collect()))


def test_damaged_lines_and_strict_mode(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    lines = ["Site,Depth_m,Reservoir", "1,0.5,FCR", "2,deep,FCR", "3,1.5,BVR,extra", "4,NA,"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    rows = sorted(IO.read_table(spark, path, damaged="line").collect(), key=lambda r: r["Site"])
    assert [r["line"] for r in rows] == [None, "2,deep,FCR", "3,1.5,BVR,extra", None]
    assert [(r["Site"], r["Depth_m"]) for r in rows][:2] == [(1, 0.5), (2, None)] and rows[3]["Reservoir"] is None
    counted = IO.damaged_lines(IO.read_table(spark, path, damaged="line"), "line").first()
    assert (counted["rows"], counted["damaged"]) == (4, 2)
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        IO.read_table(spark, path, strict=True).collect()


def test_bucketed_tables_join_without_exchange(spark):
    name = lambda: f"bucketed_{uuid.uuid4().hex}"
    a = IO.write_bucketed(spark.sql("SELECT id % 50 AS site, date_add(date'2020-01-01', cast(id % 20 as int)) AS day, id AS v FROM range(2000)"), name(), ["site", "day"], 4)
    b = IO.write_bucketed(spark.sql("SELECT id AS site, date_add(date'2020-01-01', cast(id % 20 as int)) AS day, id % 2 AS flag FROM range(50)"), name(), ["site", "day"], 4)
    both, rest = IO.join_buckets(a, b, ["site", "day"]), IO.join_buckets(a, b.where("flag = 1"), ["site", "day"], "left_anti")
    for df in (both, rest, both.groupBy("site", "day").count()):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plain = a.join(spark.createDataFrame(b.collect(), b.schema), ["site", "day"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, plain.collect()))
    assert both.count() + IO.join_buckets(a, b, ["site", "day"], "left_anti").count() == 2000


def test_sorted_files_are_read_back_in_order(spark, tmp_path):
    df = spark.sql("SELECT (id * 7919) % 10007 AS x, id FROM range(5000)").repartition(7)
    IO.write_sorted(df, str(tmp_path / "s"), ["x", "id"], files=5)
    back = IO.read_sorted(spark, str(tmp_path / "s")).collect()
    order = sorted((r["x"], r["id"]) for r in back)
    assert [(r["x"], r["id"]) for r in sorted(back, key=lambda r: r["position"])] == order
    assert sorted(r["position"] for r in back) == list(range(1, 5001))
    IO.write_sorted(df.where("false"), str(tmp_path / "e"), ["x"])
    assert IO.read_sorted(spark, str(tmp_path / "e")).count() == 0
