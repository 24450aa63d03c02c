"""NULL, tie, order and edge rules of the operators on small literal frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from epilimnia.functions import nulls, pvalues, scalars
from epilimnia.operators import aggregate, fill, grid, joins, quality, reshape, select, stats
from epilimnia.sources import tables


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_strict_aggregates_are_null_on_any_null(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1D), ('a', NULL), ('b', 2D), ('b', 5D) AS t(k, x)")
    out = df.groupBy("k").agg(
        nulls.strict_sum("x").alias("s"), nulls.strict_max("x").alias("hi"), nulls.strict_min("x").alias("lo"), nulls.strict_avg("x").alias("m")
    )
    assert tuples(out) == [("a", None, None, None, None), ("b", 7.0, 5.0, 2.0, 3.5)]


def test_nonfinite_becomes_null(spark):
    df = spark.sql("SELECT * FROM VALUES (1D), (double('NaN')), (double('inf')), (double('-inf')), (NULL) AS t(x)")
    assert tuples(quality.nullify_nonfinite(df, "x")) == sorted([(1.0,)] + [(None,)] * 4, key=str)


def test_half_even_and_zero_divisor(spark):
    row = spark.range(1).select(
        scalars.half_even(F.lit(0.0125), 3), scalars.half_even(F.lit(0.0135), 3), scalars.ratio(F.lit(1.0), F.lit(0.0))
    ).first()
    assert tuple(row) == (0.012, 0.014, None)


def test_text_to_number(spark):
    assert spark.range(1).select(scalars.to_number(F.lit("surface")), scalars.to_number(F.lit("1.5"))).first() == (None, 1.5)


def test_bin_edges(spark):
    xs = [-0.1, 0.0, 0.24, 0.25, 2.99, 3.0, 3.01, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(scalars.depth_bin("x", 0.25, F.lit(3.0))).collect()]
    assert got == [None, 0.0, 0.0, 0.25, 2.75, 2.75, None, None]
    other = [r[0] for r in df.select(scalars.depth_bin("x", 0.4, F.lit(3.0))).collect()]
    assert other[4] is None and other[1] == 0.0


def test_density(spark):
    four, twenty = spark.range(1).select(scalars.water_density(F.lit(4.0)), scalars.water_density(F.lit(20.0))).first()
    assert four == pytest.approx(1000.0, abs=1e-3) and twenty == pytest.approx(998.23, abs=5e-3)


def test_leap_day_has_no_overlay_in_a_common_year(spark):
    day = F.lit("2020-02-29").cast("date")
    assert spark.range(1).select(scalars.overlay_day(day, 2001), scalars.overlay_day(day, 2024)).first() == (
        None, dt.date(2024, 2, 29),
    )


def test_selectors_ignore_case(spark):
    df = spark.sql("SELECT 1 DateTime, 2 Flag_X_1, 3 X_1, 4 Y_2, 5 flagged")
    assert select.cols(df, contains=["FLAG"]) == ["Flag_X_1", "flagged"]
    assert select.cols(df, any_of=["DateTime"], contains=["x_1"], exclude=["flag"]) == ["DateTime", "X_1"]
    assert select.cols_between(df, "X_1", "flagged") == ["X_1", "Y_2", "flagged"]
    assert select.cols_at(df, 1, 3) == ["DateTime", "X_1"]
    with pytest.raises(ValueError):
        select.rename(df, {"none": "x"})
    assert select.select_like(df.select("X_1", "DateTime", "Flag_X_1", "Y_2", "flagged"), df).columns == df.columns


def test_natural_join_matches_nulls(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 'x'), (NULL, 'y'), (3, 'z'), (3, 'zz') AS t(k, a)")
    b = spark.sql("SELECT * FROM VALUES (1, 'p'), (NULL, 'q'), (4, 'r'), (3, 's'), (3, 't') AS t(k, b)")
    want = [(1, "x", "p"), (3, "z", "s"), (3, "z", "t"), (3, "zz", "s"), (3, "zz", "t"), (4, None, "r"), (None, "y", "q")]
    assert tuples(joins.natural_join(a, b, "full")) == sorted(want, key=str)
    assert tuples(joins.natural_join(a, b, "inner")) == sorted((w for w in want if w[1] and w[2]), key=str)
    same = joins.natural_join(a.select("k"), b.select("k"), "full")
    assert sorted(map(str, (r[0] for r in same.collect()))) == sorted(["1", "None", "3", "3", "3", "3", "4"])


def test_flags(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0), (2, 9), (3, NULL), (4, 5) AS t(i, f)")
    assert [r.i for r in quality.drop_flagged(df, [9, 5], ["f"]).collect()] == [1]
    assert [r.i for r in quality.drop_flagged(df, [9, 5], ["f"], null_ok=True).orderBy("i").collect()] == [1, 3]


def test_time_bounds(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2020-01-01 00:00:00'), (timestamp'2020-01-02 00:00:00'), (timestamp'2020-01-02 10:00:00') AS t(ts)")
    assert quality.between_time(df, "ts", "2020-01-01", "2020-01-02").count() == 1
    assert quality.between_time(df, "ts", dt.date(2020, 1, 1), dt.date(2020, 1, 2), closed="both").count() == 2


def test_ties_are_kept(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, 1), ('a', 1, 2), ('a', 2, 3), ('b', NULL, 4), ('b', NULL, 5), (NULL, 7, 6) AS t(k, x, i)")
    for bounded in (False, True):
        assert sorted(r.i for r in aggregate.slice_min(df, ["k"], "x", bounded).collect()) == [1, 2, 4, 5, 6]
        assert sorted(r.i for r in aggregate.having_rows(df, ["k"], 2, bounded).collect()) == [1, 2, 3, 4, 5]


def test_gate_counts(spark):
    df = spark.sql("SELECT 'a' k, timestamp'2020-01-01 10:00:00' ts, x FROM VALUES (1D), (3D), (NULL) AS t(x)")
    gate = lambda n, nulls: aggregate.daily_mean_gated(df, ["k"], "ts", "x", n, nulls).first()["x"]
    assert (gate(2, False), gate(3, False), gate(3, True)) == (2.0, None, 2.0)


def test_layer_rules_last_wins_on_the_boundary(spark):
    df = spark.sql("SELECT * FROM VALUES ('FCR', 4D), ('BVR', 5D), ('BVR', 4D), ('X', 1D), ('FCR', NULL) AS t(s, z)")
    got = dict(((r.s, r.z), r.Layer) for r in select.layer_of(df, "s", "z", {"FCR": 4.0, "BVR": 5.0}).collect())
    assert got == {("FCR", 4.0): "Hypolimnion", ("BVR", 5.0): "Hypolimnion", ("BVR", 4.0): "Epilimnion", ("X", 1.0): None, ("FCR", None): None}
    trap = df.where("z = 5").select(select.layer_at("z", 5.0)).first()[0]
    assert trap == "Epilimnion"


def test_swap_modes(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 2D, 1D, 2D, 1D), (2, 1D, 2D, 1D, 3D), (3, 1D, 2D, 3D, 1D), (4, 1D, 1D, 1D, 1D), (5, NULL, 1D, 2D, 1D) AS t(i, a, b, c, d)")
    df = df.withColumns({"d1": F.col("a") - F.col("b"), "d2": F.col("c") - F.col("d")})
    pairs = {"d1": ("a", "b"), "d2": ("c", "d")}
    both = select.unswap(df, pairs, "both").select("i", "a", "b", "c", "d", "d1", "d2")
    assert tuples(both) == [(1, 2.0, 1.0, 2.0, 1.0, 1.0, 1.0), (2, 2.0, 1.0, 3.0, 1.0, 1.0, 2.0)]
    each = select.unswap(df, {"d1": ("a", "b")}, "each").select("i", "a", "b", "d1")
    assert tuples(each) == [(1, 2.0, 1.0, 1.0), (2, 2.0, 1.0, 1.0), (3, 2.0, 1.0, 1.0)]
    assert sorted(r.i for r in select.unswap(df, {"d1": ("a", "b")}, "each", keep_zero=True).collect()) == [1, 2, 3, 4]


def test_intervals_against_brute_force(spark):
    day = dt.date(2019, 12, 1)
    intervals = [("a", day, day + dt.timedelta(130)), ("a", day + dt.timedelta(100), day + dt.timedelta(140)), ("b", day, day),
                 ("b", day + dt.timedelta(63), day + dt.timedelta(64)), (None, day, day + dt.timedelta(1)), ("a", day + dt.timedelta(9), day)]
    iv = spark.createDataFrame(intervals, "k string, s date, e date")
    rows = [(k, day + dt.timedelta(i)) for i in range(-3, 200) for k in ("a", "b", "c", None)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, d date")
    inside = lambda k, d: d is not None and any(k == x and s <= d <= e for x, s, e in intervals)
    tagged = joins.tag_intervals(df, iv, "d", ["k"], "s", "e")
    assert tuples(tagged) == sorted(((k, d, "On" if inside(k, d) else "Off") for k, d in rows), key=str)
    kept = joins.within_windows(df, iv, "d", ["k"], "s", "e")
    assert tuples(kept) == sorted(((k, d) for k, d in rows if inside(k, d)), key=str)


def test_days_before_1970_are_covered(spark):
    iv = spark.sql("SELECT 'a' k, date'1969-11-01' s, date'1970-01-05' e")
    df = spark.sql("SELECT 'a' k, explode(sequence(date'1969-10-30', date'1970-01-08')) d")
    assert joins.within_windows(df, iv, "d", ["k"], "s", "e").count() == 66


def test_reshape_round_trip(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1D, NULL), (2, NULL, 4D) AS t(i, V_a_1, V_b_2)")
    long = reshape.to_long(df, ["i"], prefix="V_")
    assert tuples(long) == sorted([(1, "a_1", 1.0), (1, "b_2", None), (2, "a_1", None), (2, "b_2", 4.0)], key=str)
    assert tuples(reshape.to_wide(long, ["i"], "variable", "observation", ["a_1", "b_2"])) == tuples(df)
    split = reshape.to_long(df, ["i"], ["v", "n", "p"], sep="_")
    wide = reshape.to_wide(split, ["i"], ["v", "n", "p"], "observation", [("V", "a", 1), ("V", "b", 2)], fill=0.0)
    assert wide.columns == ["i", "V_a_1", "V_b_2"] and tuples(wide) == [(1, 1.0, 0.0), (2, 0.0, 4.0)]
    with pytest.raises(ValueError):
        reshape.to_long(df, ["i"], ["v", "n"], sep="_")
    with pytest.raises(Exception, match="wrong number of name parts"):
        reshape.split_name(long, "variable", ["a"], "_").collect()


def test_stacking(spark):
    a, b = spark.sql("SELECT 1 x, 2 y"), spark.sql("SELECT 3 y, 4 z")
    assert tuples(select.stack(a, b)) == [(1, 2, None), (None, 3, 4)]
    with pytest.raises(Exception):
        select.stack_strict(a, b).collect()
    with pytest.raises(ValueError):
        select.add_rows(a, b)


def test_global_maximum_keeps_ties(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 5), (2, 7), (3, 7), (4, NULL) AS t(i, x)")
    assert sorted(r.i for r in quality.where_max(df, "x").collect()) == [2, 3]


def test_interpolation_gap_limit(spark):
    data = [(i, v) for i, v in enumerate([None, 1.0] + [None] * 12 + [14.0] + [None] * 13 + [28.0, None])]
    df = spark.createDataFrame(data, "i int, v double")
    got = {r.i: r.v for r in fill.interpolate(df, [], ["i"], "v", maxgap=12).collect()}
    assert got[0] is None and got[29] is None and got[5] == pytest.approx(5.0) and got[20] is None
    near = {r.i: r.v for r in fill.interpolate(df, [], ["i"], "v", edges="nearest").collect()}
    assert near[0] == 1.0 and near[29] == 28.0 and near[20] == pytest.approx(20.0)


@pytest.mark.parametrize("nu", [1, 2, 3, 10, 11, 399, 400, 401, 1000])
def test_p_values_against_numeric_integration(spark, nu):
    for t in (0.0, 0.5, 2.0, 5.0, 12.0):
        got = spark.range(1).select(pvalues.two_sided_p(F.lit(t), F.lit(nu))).first()[0]
        norm = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        n = 4000  # Simpson on [0, t]
        f = lambda x: norm * (1 + x * x / nu) ** (-(nu + 1) / 2)
        h = t / n
        area = h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1)) if t else 0.0
        assert got == pytest.approx(1 - 2 * area, abs=2e-8)


@pytest.mark.parametrize(
    "t, nu, p",
    [
        (12.0, 60, 1.3786322641817738e-17), (5.0, 400, 8.594825129118688e-07), (5.0, 401, 8.58648736907e-07), (10.0, 401, 3.62058935629e-21),
        (15.0, 500, 2.9001023164859657e-42), (40.0, 1, 0.015912179824051628), (40.0, 2, 0.0006244146721847406), (0.001, 1, 0.9993633804398389),
        (1.5, 4, 0.208), (12.706204736432095, 1, 0.05), (1.959963984540054, 10**12, 0.05), (0.0, 7, 1.0),
    ],
)
def test_small_p_values_keep_their_digits(spark, t, nu, p):
    assert spark.range(1).select(pvalues.two_sided_p(F.lit(t), F.lit(nu))).first()[0] == pytest.approx(p, rel=1e-9)


def test_p_values_are_never_negative(spark):
    df = spark.range(1, 60).selectExpr("id * 0.7 AS t", "id").crossJoin(spark.sql("SELECT explode(array(1, 2, 5, 60, 399, 400, 401, 10000)) AS nu"))
    assert df.where(~pvalues.two_sided_p(F.col("t"), F.col("nu")).between(0, 1)).count() == 0
    falling = df.withColumn("p", pvalues.two_sided_p(F.col("t"), F.col("nu")))
    assert falling.groupBy("nu").agg(F.corr("t", F.log(F.col("p") + 1e-300)).alias("c")).where("c > -0.6").count() == 0


def test_overlapping_phase_windows_last_rule_wins(spark):
    rows = spark.sql("SELECT 'a' k, timestamp'2018-05-05' ts UNION ALL SELECT 'a', timestamp'2018-05-20'")
    events = spark.sql("SELECT 'a' k, date'2018-11-01' d")
    windows = spark.sql("SELECT 'a' k, date'2018-01-01' start, date'2018-06-01' end, 'Pre' phase, 2 o UNION ALL SELECT 'a', date'2018-05-01', date'2018-05-10', 'Pre_', 1")
    by_start = joins.phase_of(rows, events, "ts", ["k"], "d", windows, ["k"])
    assert sorted(r["phase"] for r in by_start.collect()) == ["Pre", "Pre_"]
    by_rule = joins.phase_of(rows, events, "ts", ["k"], "d", windows, ["k"], rule_order="o")
    assert [r["phase"] for r in by_rule.collect()] == ["Pre", "Pre"]


def test_routing_keeps_other_rows(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('c', 3), (NULL, 4) AS t(k, v)")
    out = quality.route_by(df, "k", {"a": lambda d: d.withColumn("v", F.col("v") * 10)})
    assert sorted(r["v"] for r in out.collect()) == [2, 3, 4, 10]


def test_density_of_equal_values(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 5D), ('a', 5D), ('a', 5D), ('z', 0D), ('z', 0D), ('o', 3D) AS t(k, v)")
    peak = {r["k"]: r["density"] for r in stats.grouped_density(df, ["k"], "v", points=4).groupBy("k").agg(F.max("density").alias("density")).collect()}
    bell = lambda h: 1 / (h * math.sqrt(2 * math.pi))
    assert peak == pytest.approx({"a": bell(0.9 * 5 * 3**-0.2), "z": bell(0.9 * 2**-0.2), "o": bell(0.9 * 3)})


def test_files_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Reservoir,Depth_m,Temp_C\nFCR,1,10\n")
    (tmp_path / "b.csv").write_text("Reservoir,Temp_C,Depth_m,Extra_x\nBVR,20,2,7\n")
    out = tables.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["Reservoir"], r["Depth_m"], r["Temp_C"], r["Extra_x"]) for r in out.collect()) == [("BVR", 2.0, 20.0, 7.0), ("FCR", 1.0, 10.0, None)]
    with pytest.raises(Exception):
        tables.read_table(spark, f"{tmp_path}/*.csv").collect()


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_format_argument_round_trip(spark, tmp_path, format):
    df = spark.sql("SELECT 'FCR' Reservoir, 1D Depth_m")
    tables.write_table(df, f"{tmp_path}/out", format=format)
    assert [tuple(r) for r in tables.read_table(spark, f"{tmp_path}/out", format=format).collect()] == [("FCR", 1.0)]
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        tables.write_table(df, f"{tmp_path}/other")


def test_large_groups_need_no_long_series(spark):
    p = spark.range(1).select(pvalues.two_sided_p(F.lit(1.959963984540054), F.lit(10**12))).first()[0]
    assert p == pytest.approx(0.05, abs=1e-9)


def test_regression_of_a_known_line(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2.1D), (2D, 3.9D), (3D, 6.2D), (4D, 7.8D), (5D, NULL) AS t(x, y)")
    row = stats.linear_fit(df, "y", "x", summary=True).first()
    assert row["slope"] == pytest.approx(1.94) and row["intercept"] == pytest.approx(0.15) and row["n"] == 4
    assert row["slope_p"] == pytest.approx(2 * 0.00109, abs=2e-4) and row["df"] == 2
    line = stats.fit_line(df, "y", "x", [], points=4).collect()
    assert sorted(round(r["fit"], 6) for r in line) == [2.09, 4.03, 5.97, 7.91]


def test_paired_t(spark):
    # season rates by year: iron and manganese at both sites
    rates = [
        (2018, 0.209, 1.196, 0.019, 0.033), (2019, 0.661, 1.398, 0.011, 0.033), (2020, 0.276, 1.676, 0.005, 0.021),
        (2021, 0.775, 1.776, 0.00712359, 0.01952869), (2022, 0.867, 1.849, 0.020, 0.029), (2023, 0.819, 1.017, 0.014, 0.068),
    ]
    rows = [(y, "BVR", a, c) for y, a, b, c, d in rates] + [(y, "FCR", b, d) for y, a, b, c, d in rates]
    df = spark.createDataFrame(rows, "Year int, Reservoir string, FeFlux double, MnFlux double")
    out = {r["measure"]: r for r in stats.paired_t(df, "Year", "Reservoir", "FCR", "BVR", ["FeFlux", "MnFlux"]).collect()}
    assert out["FeFlux"]["t"] == pytest.approx(5.440, abs=5e-4) and out["FeFlux"]["p"] == pytest.approx(0.0028, abs=5e-5)
    assert out["MnFlux"]["t"] == pytest.approx(3.129, abs=5e-4) and out["MnFlux"]["p"] == pytest.approx(0.0260, abs=5e-5)


def test_density_integrates_to_about_one(spark):
    df = spark.range(3000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 1000 / 10).alias("x"))
    out = stats.grouped_density(df, ["k"], "x", points=200).orderBy("x").collect()
    area = sum((a["density"] + b["density"]) / 2 * (b["x"] - a["x"]) for a, b in zip(out, out[1:]))
    assert len(out) == 200 and 0.93 < area <= 1.0


def test_grid_reproduces_a_bilinear_surface(spark):
    start = dt.date(2020, 3, 1)
    casts = [(0, [0.1, 1.7, 4.1, 6.0]), (9, [0.1, 2.0, 6.0]), (21, [0.1, 3.3, 6.0])]
    f = lambda x, z: 2 + 0.5 * x - 1.5 * z + 0.25 * x * z
    rows = [("a", start + dt.timedelta(x), z, f(x, z)) for x, zs in casts for z in zs]
    rows += [("a", start, 0.1, f(0, 0.1) + 2), ("a", start, 0.1, f(0, 0.1) - 2), ("a", start, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, d date, z double, v double")
    out = grid.grid_interpolate(df, ["k"], "d", "z", "v").collect()
    assert len(out) == 22 * 12
    for r in out:
        assert r["z"] == pytest.approx(f((r["x"] - start).days, r["y"]), abs=1e-9)


def test_grid_is_null_outside_the_casts(spark):
    df = spark.sql("SELECT * FROM VALUES (date'2020-01-01', 0D, 1D), (date'2020-01-01', 2D, 3D), (date'2020-01-05', 0D, 5D), (date'2020-01-05', 1D, 6D) AS t(d, z, v)").withColumn("k", F.lit(1))
    cells = {(r["x"].day, r["y"]): r["z"] for r in grid.grid_interpolate(df, ["k"], "d", "z", "v").collect()}
    assert cells[(1, 2.0)] == 3.0 and cells[(3, 2.0)] is None and cells[(3, 0.5)] == pytest.approx(3.5)
    assert grid.grid_interpolate(df, ["k"], "d", "z", "v", keep_empty=False).count() == sum(v is not None for v in cells.values())
