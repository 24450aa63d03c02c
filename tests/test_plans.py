"""Domain plans on literal fixtures."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epilimnia import settings as S
from epilimnia.operators.select import stack
from epilimnia.plans import chemistry, fluxes, sensors, series, stratification
from epilimnia.session import literal_table
from epilimnia.sources import tables

# fixed values: treatment intervals of the treated site
INTERVALS = """Reservoir,HOxOn,HOxOff
FCR,2018-04-23,2018-07-30
FCR,2018-08-09,2018-09-10
FCR,2019-06-03,2019-06-17
FCR,2019-07-08,2019-07-19
FCR,2019-08-05,2019-08-19
FCR,2019-09-02,2019-12-01
FCR,2020-06-29,2020-07-12
FCR,2020-07-13,2020-07-22
FCR,2020-07-23,2020-09-11
FCR,2020-09-25,2020-12-02
FCR,2021-06-11,2021-06-26
FCR,2021-06-30,2021-07-08
FCR,2021-07-12,2021-07-14
FCR,2021-07-26,2021-09-06
FCR,2021-09-14,2021-12-06
FCR,2022-03-22,2022-03-24
FCR,2022-03-29,2022-04-03
FCR,2022-05-19,2022-06-14
FCR,2022-06-21,2022-08-26
FCR,2022-08-29,2022-10-01
FCR,2022-10-03,2022-12-12
FCR,2023-03-06,2023-05-29
FCR,2023-05-31,2023-08-21
FCR,2023-08-23,2023-12-04
"""
# fixed values: turnover days
TURNOVERS = """Reservoir,Date,Event,ID
FCR,2018-10-21,TO,1
BVR,2018-10-21,TO,2
FCR,2019-10-24,TO,3
BVR,2019-10-30,TO,4
FCR,2020-11-02,TO,5
BVR,2020-11-02,TO,6
FCR,2021-11-03,TO,7
BVR,2021-11-05,TO,8
FCR,2022-10-20,TO,9
BVR,2022-10-19,TO,10
FCR,2023-11-02,TO,11
BVR,2023-11-02,TO,12
"""


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("control")
    (folder / "intervals.csv").write_text(INTERVALS)
    (folder / "events.csv").write_text(TURNOVERS)
    return folder


@pytest.fixture(scope="module")
def intervals(spark, files):
    return tables.read_intervals(spark, str(files / "intervals.csv"))


@pytest.fixture(scope="module")
def events(spark, files):
    return tables.read_events(spark, str(files / "events.csv"))


def test_first_onset_of_seven_days(intervals):
    out = chemistry.treatment_onset(intervals).orderBy("Year").collect()
    want = ["2018-04-23", "2019-06-03", "2020-06-29", "2021-06-11", "2022-05-19", "2023-03-06"]
    assert [str(r["HOxOn"]) for r in out] == want
    tie = stack(intervals, intervals)
    assert chemistry.treatment_onset(tie).count() == 12


def test_interval_columns(intervals):
    rows = chemistry.treatment_intervals(intervals).collect()
    assert sorted(int(r["Group"]) for r in rows) == list(range(1, 25))
    assert {(r["DOYon"], r["DOYoff"]) for r in rows if r["Year"] == 2018} == {(113, 211), (221, 253)}


def test_reading_tables(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    (tmp_path / "s.csv").write_text(
        "Reservoir,Site,DateTime,Temp_C_1,Flag_Temp_C_1\nFCR,50,2020-01-01 00:10:00,NA,0\n,50,2020-01-01T00:20:00Z,NaN,NA\nBVR,50,,1.5,7\n"
    )
    df = tables.read_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "int", "timestamp", "double", "int"]
    assert [r["Temp_C_1"] for r in df.collect()] == [None, None, 1.5]
    assert [r["Reservoir"] for r in df.collect()] == ["FCR", None, "BVR"]
    assert df.where("DateTime is not null").count() == 2
    (tmp_path / "t.csv").write_text("Reservoir,Site,DateTime,pH\nFCR,50,2020-01-01 00:10:00,7\n")
    both = tables.read_many(spark, [path, str(tmp_path / "t.csv")])
    assert both.count() == 4 and {"pH", "Temp_C_1", "source_file"} <= set(both.columns)
    assert tables.read_many(spark, [path, path], same_header=True).count() == 6
    assert tables.as_df(spark, df) is df and tables.as_df(spark, path).count() == 3
    assert tables.with_current(df).count() == 3 and tables.with_current(df, df).count() == 6
    tables.write_table(df, str(tmp_path / "out.csv"))
    assert tables.read_table(spark, str(tmp_path / "out.csv")).count() == 3
    tables.write_table(df, str(tmp_path / "out.parquet"), ["Site"])
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 3
    assert tables.write_table(df, None) is df


def profile_year(spark, year, warm_from, warm_to, site="FCR", skip=()):
    """Two depths per day; warm on top inside [warm_from, warm_to], else even."""
    rows, d = [], day(f"{year}-01-01")
    while d.year == year:
        if str(d) not in skip:
            top = 20.0 if day(warm_from) <= d <= day(warm_to) else 8.0
            rows += [(site, d, 0.1, top), (site, d, 5.0, None), (site, d, 9.0, 8.0)]
        d += dt.timedelta(1)
    return spark.createDataFrame(rows, "site_id string, datetime date, depth_m double, observation double")


def test_known_stratified_year(spark):
    a = profile_year(spark, 2019, "2019-03-15", "2019-11-01", skip=("2019-06-10", "2019-06-11"))
    b = profile_year(spark, 2019, "2019-07-01", "2019-07-20", "BVR")
    out = {r["site_id"]: r for r in stratification.stratified_periods(a.unionByName(b)).collect()}
    assert (out["FCR"]["start"], out["FCR"]["end"], out["FCR"]["length"]) == (day("2019-03-15"), day("2019-11-01"), 232)
    # the longest run of any kind is unstratified here, the stratified one is still found
    assert (out["BVR"]["start"], out["BVR"]["length"]) == (day("2019-07-01"), 20)
    compare = stratification.period_compare(stratification.stratified_periods(a.unionByName(b)))
    assert sorted(tuple(r) for r in compare.collect()) == [(2019, "end", 305, 201), (2019, "start", 74, 182)]


def test_missing_days_between_unlike_states_end_a_run(spark):
    a = profile_year(spark, 2019, "2019-03-15", "2019-11-01", skip=("2019-03-13", "2019-03-14"))
    flags = {r["datetime"]: r["strat"] for r in stratification.daily_stratification(a).collect()}
    assert len(flags) == 365 and flags[day("2019-03-13")] == pytest.approx(1 / 3) and flags[day("2019-03-14")] == pytest.approx(2 / 3)
    assert stratification.stratified_periods(a).first()["start"] == day("2019-03-15")


def test_years_need_enough_days(spark):
    a = profile_year(spark, 2019, "2019-03-15", "2019-11-01")
    keep = lambda n: a.where(F.dayofyear("datetime") <= n)
    assert stratification.stratified_periods(keep(299)).count() == 0
    assert stratification.stratified_periods(keep(300)).count() == 1


def test_threshold_and_sign(spark):
    rows = [("A", day("2020-01-01"), 0.1, 10.0), ("A", day("2020-01-01"), 9.0, 9.0), ("B", day("2020-01-01"), 0.1, 9.0), ("B", day("2020-01-01"), 9.0, 10.0)]
    df = spark.createDataFrame(rows, "site_id string, datetime date, depth_m double, observation double")
    flag = lambda limit: {r["site_id"]: r["strat"] for r in stratification.daily_stratification(df, limit).collect()}
    assert flag(0.01) == {"A": 1.0, "B": 0.0} and flag(0.1) == {"A": 0.0, "B": 0.0}


def test_turnover(spark):
    a = profile_year(spark, 2019, "2019-03-15", "2019-11-01")
    extra = literal_table(spark, S.EXTRA_TURNOVERS, S.TURNOVER_SCHEMA)
    out = stratification.turnover_dates(stratification.mixed_days(stratification.daily_stratification(a)), extra)
    assert sorted((r["Reservoir"], str(r["datetime"]), str(r["MDay"])) for r in out.collect()) == [
        ("BVR", "2018-10-24", "2001-10-24"), ("BVR", "2019-11-02", "2001-11-02"), ("FCR", "2019-11-02", "2001-11-02"),
    ]


def test_buoyancy(spark):
    d = day("2020-06-01")
    rows = [("FCR", d, 0.1, 20.0), ("FCR", d, 1.0, 18.0), ("FCR", d, 10.0, 8.0), ("BVR", d, 0.0, None), ("BVR", d, 1.0, 9.0), ("X", d, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "site_id string, datetime date, depth_m double, observation double")
    rho = lambda t: 1000 * (1 - (t + 288.9414) * (t - 3.9863) ** 2 / (508929.2 * (t + 68.12963)))
    want = 9.81 / rho(20) * (rho(18) - rho(20)) / 0.9
    out = {r["site_id"]: r["bf"] for r in stratification.buoyancy_daily(df).collect()}
    assert out["FCR"] == pytest.approx(want) and out["BVR"] is None and "X" not in out


OFFSETS = [
    {"Reservoir": "BVR", "Site": 50, "Position": 1.0, S.OFFSET_BEFORE: 4.0, S.OFFSET_AFTER: 3.0},
    {"Reservoir": "BVR", "Site": 50, "Position": 2.0, S.OFFSET_BEFORE: 2.0, S.OFFSET_AFTER: None},
]
OFFSET_SCHEMA = pa.schema(
    [("Reservoir", pa.string()), ("Site", pa.int32()), ("Position", pa.float64()), (S.OFFSET_BEFORE, pa.float64()), (S.OFFSET_AFTER, pa.float64())]
)


def string_frame(spark):
    rows = [
        ("BVR", 50, "2021-04-05 00:00:00", 3.5, 10.0, 11.0, 1.0),  # still the old offsets
        ("BVR", 50, "2021-04-05 00:10:00", 3.5, 12.0, 13.0, 2.0),  # the new ones
        ("BVR", 50, "2021-04-06 00:00:00", 6.004, None, 14.0, 3.0),
        ("BVR", 50, "2021-04-06 00:10:00", None, 1.0, 1.0, 4.0),
    ]
    df = spark.createDataFrame(rows, "Reservoir string, Site int, t string, Depth_m_13 double, ThermistorTemp_C_1 double, ThermistorTemp_C_2 double, EXOTemp_C_1 double")
    return df.select("Reservoir", "Site", F.col("t").cast("timestamp").alias("DateTime"), *df.columns[3:])


def test_sensor_depths(spark):
    df, offsets = string_frame(spark), literal_table(spark, OFFSETS, OFFSET_SCHEMA)
    out = sensors.sensor_depths(df, offsets)
    got = sorted((str(r["DateTime"]), r["Position"], r["sensor_depth"], r["depth_bin"], r["observation"]) for r in out.collect())
    assert got == [
        ("2021-04-05 00:00:00", 1.0, -0.5, None, 10.0),
        ("2021-04-05 00:00:00", 2.0, 1.5, 1.5, 11.0),
        ("2021-04-05 00:10:00", 1.0, 0.5, 0.5, 12.0),
    ]
    same = sensors.sensor_depths(df, offsets, moved_on=None).where("Position = 2")
    assert sorted(r["rounded_depth"] for r in same.collect()) == [1.5, 1.5, 4.0]


def test_sensor_depths_wide(spark):
    df, offsets = string_frame(spark), literal_table(spark, OFFSETS, OFFSET_SCHEMA)
    out = sensors.sensor_depths(df, offsets, wide=True)
    assert out.columns == df.columns
    got = [(r["ThermistorTemp_C_1"], r["ThermistorTemp_C_2"], r["EXOTemp_C_1"]) for r in out.orderBy("DateTime").collect()]
    assert got == [(None, 11.0, 1.0), (12.0, None, 2.0), (None, None, 3.0), (None, None, 4.0)]


def test_names_must_have_three_parts(spark):
    df = string_frame(spark).withColumn("RDO_mgL_9_adjusted", F.lit(1.0))
    with pytest.raises(ValueError, match="adjusted"):
        sensors.sensor_depths(df, literal_table(spark, OFFSETS, OFFSET_SCHEMA))


def test_profiles_gate_and_null_rows(spark):
    rows = [("FCR", 50, f"2020-01-0{d} 00:{m}0:00", 5.0 if d == 1 else None, 4.0) for d, n in ((1, 3), (2, 3), (3, 2)) for m in range(n)]
    df = spark.createDataFrame(rows, "Reservoir string, Site int, t string, ThermistorTemp_C_surface double, ThermistorTemp_C_1 double")
    df = df.withColumn("DateTime", F.col("t").cast("timestamp")).drop("t")
    rules = {"FCR": sensors.HISTORIC_RULES["FCR"]}
    out = {(str(r["datetime"])[-1], r["depth_m"]): r["observation"] for r in sensors.temperature_profiles(df, historic_rules=rules).collect()}
    assert out == {("1", 0.1): 5.0, ("1", 1.0): 4.0, ("2", 0.1): None, ("2", 1.0): 4.0, ("3", 0.1): None, ("3", 1.0): None}
    current = sensors.temperature_profiles(df, df, historic_rules=rules, current_rules={"FCR": sensors.ProfileRule(False, 3)})
    extra = [r for r in current.collect()]
    assert len(extra) == 6 + 4  # days without any value are left out of the current part


def test_sensor_targets(spark):
    rows = [
        ("FCR", 50, "2020-01-01 00:00:00", 1.0, 0, 8.0, 5.0, 0),
        ("FCR", 50, "2020-01-01 00:30:00", 4.0, 4, 8.5, 6.0, 1),
        ("FCR", 50, "2020-01-01 00:40:00", 9.0, 9, None, 7.0, 0),
        ("FCR", 40, "2020-01-01 00:50:00", 9.0, 0, 1.0, 1.0, 0),
    ]
    df = spark.createDataFrame(
        rows, "Reservoir string, Site int, t string, EXOTemp_C_1 double, Flag_EXOTemp_C_1 int, RDO_mgL_9_adjusted double, ThermistorTemp_C_9 double, Flag_ThermistorTemp_C_9 int"
    ).withColumn("DateTime", F.col("t").cast("timestamp")).drop("t")
    out = sensors.sensor_targets(df)
    got = {}
    for r in out.collect():
        got.setdefault((r["variable"], r["depth_m"]), {})[r["datetime"].minute] = r["observation"]
    assert got[("Temp_C", 1.6)] == {0: 1.0, 10: 2.0, 20: 3.0, 30: 4.0}
    assert got[("DO_mgL", 9.0)][20] == pytest.approx(8.0 + 0.5 * 2 / 3)
    assert got[("Temp_C", 9.0)] == pytest.approx({0: 5.0, 10: 5.5, 20: 6.0, 30: 6.5, 40: 7.0})
    raw = sensors.sensor_targets(df, interpolate_gaps=False)
    assert raw.count() == out.count() and raw.where("observation is null").count() == 2 + 2 + 3
    parts = sensors.sensor_targets([df.where("minute(DateTime) < 20"), df.where("minute(DateTime) >= 20")])
    assert parts.where("variable = 'Temp_C' and depth_m = 1.6").count() == 2


def test_sample_targets(spark):
    rows = [("FCR", 50, 1.0, 1, 2.0, 0), ("FCR", 50, 1.0, 2, 4.0, 9), ("FCR", 50, 1.0, 3, None, 0), ("BVR", 50, 1.0, 1, 7.0, None)]
    df = spark.createDataFrame(rows, "Reservoir string, Site int, Depth_m double, Rep int, TFe_mgL double, Flag_TFe_mgL int").withColumn("DateTime", F.lit("2020-01-01").cast("timestamp"))
    # every value meets the flags of all replicates of its sample
    assert [(r["site_id"], r["observation"]) for r in sensors.sample_targets(df).collect()] == [("FCR", 3.0)]
    assert [(r["site_id"], r["observation"]) for r in sensors.sample_targets(df, match_rep=True).collect()] == [("FCR", 2.0)]


def metals_frame(spark):
    rows = [
        ("FCR", 50, "2020-03-11", 9.0, 3.0, 1.0, 0.30, 0.10, 0), ("FCR", 50, "2020-04-10", 9.0, 2.0, 1.0, 0.10, 0.13, 0),
        ("FCR", 50, "2020-07-01", 9.0, 5.0, 4.0, 0.90, 0.30, 0), ("FCR", 50, "2020-07-01", 4.0, 2.0, 1.0, 0.0, 0.0, 0),
        ("FCR", 50, "2020-11-02", 9.0, 1.0, 0.5, 0.40, 0.20, 0), ("FCR", 50, "2020-12-31", 9.0, 2.0, 1.5, 0.40, 0.20, None),
        ("BVR", 50, "2020-07-01", 4.0, 1.0, 2.0, 0.40, 0.20, 0), ("BVR", 50, "2020-07-01", 4.0, 2.0, 1.0, 0.40, 0.20, 68),
        ("FCR", 50, "2017-07-01", 9.0, 2.0, 1.0, 0.40, 0.20, 0),
    ]
    df = spark.createDataFrame(rows, "Reservoir string, Site int, t string, Depth_m double, TFe_mgL double, SFe_mgL double, TMn_mgL double, SMn_mgL double, Flag_TFe_mgL int")
    return df.withColumns({"DateTime": F.col("t").cast("timestamp"), "Flag_SFe_mgL": F.lit(0), "Flag_TMn_mgL": F.lit(0), "Flag_SMn_mgL": F.lit(0)}).drop("t")


def test_metals(spark, intervals, events):
    m = chemistry.metals_qc(metals_frame(spark)).persist()
    assert m.count() == 5  # old, flagged, NULL-flagged and implausible rows are gone
    four = m.where("Depth_m = 4").first()
    assert four["Layer"] == "Hypolimnion" and four["STMn"] is None and four["AvgSTFe"] == pytest.approx((0.8 + 0.5) / 2)
    state = {r["HOx"]: r["AvgSTFe"] for r in chemistry.ratio_by_state(m, intervals).collect()}
    assert state == {"On": round((0.8 + 0.5 + 0.5) / 3, 3), "Off": 0.417}
    year = chemistry.year_metals(m, 2020, events)
    assert year.where("TMn_mgL = 0.13 and SMn_mgL = 0.10").count() == 1 and year.where("MnDiff = 0").count() == 0
    points = chemistry.release_points(year, "2020-03-11").collect()
    assert sorted(r["Mn_mgL"] for r in points) == [0.13, 0.3, 0.9]
    fit = chemistry.release_rate(m, 2020, "2020-03-11", events).first()
    assert fit["n"] == 3 and fit["slope"] > 0 and fit["df"] == 1
    windows = literal_table(spark, S.ACTIVE_WINDOWS, S.ACTIVE_SCHEMA)
    assert [(r["MaxTFe_mgL"], r["MaxTMn_mgL"]) for r in chemistry.season_maximum(m, windows).collect()] == [(5.0, 0.9)]


def test_onset_oxygen_and_maximum(spark, intervals):
    log = spark.sql("SELECT 'FCR' Reservoir, 50 Site, t DateTime, x RDOsat_percent_9_adjusted FROM VALUES (timestamp'2020-06-29 01:00:00', 80D), (timestamp'2020-06-29 02:00:00', 90D), (timestamp'2020-06-30 02:00:00', 1D) AS v(t, x)")
    hand = spark.sql("SELECT 'FCR' Reservoir, 50 Site, timestamp'2018-04-23 09:45:00' DateTime, z Depth_m, 70D DOsat_percent FROM VALUES (9D), (8D) AS v(z)")
    m = chemistry.metals_qc(metals_frame(spark))
    windows = literal_table(spark, S.ACTIVE_WINDOWS, S.ACTIVE_SCHEMA)
    out = chemistry.onset_vs_max(log, hand, m, chemistry.treatment_onset(intervals), windows)
    got = {r["Year"]: (r["AvgDOsat_percent_9"], r["MaxTFe_mgL"]) for r in out.collect()}
    assert got == {2018: (70.0, None), 2020: (85.0, 5.0)}


def test_flux_season(spark, events):
    rows = [
        ("FCR", "2018-07-21", 8.0), ("FCR", "2018-07-22", 8.0), ("FCR", "2018-10-20", 8.0), ("FCR", "2018-10-21", 8.0), ("FCR", "2018-09-01", 4.0),
        ("BVR", "2018-07-31", 8.0), ("BVR", "2018-08-01", 8.0), ("BVR", "2019-10-29", 10.0), ("BVR", "2019-10-30", 10.0), ("FCR", "2024-05-01", 8.0),
        ("FCR", "2019-06-03", 5.0),
    ]
    df = spark.createDataFrame(rows, "Reservoir string, d string, Depth_m double").select(
        "Reservoir", F.col("d").cast("date").alias("Date"), "Depth_m", F.lit(10.0).alias("Duration_days"), F.lit(0.5).alias("TFeFlux_gm2d"), F.lit(0.01).alias("TMnFlux_gm2d")
    )
    twin = df.withColumns({"TFeFlux_gm2d": F.lit(1.5), "Duration_days": F.lit(20.0)})
    windows = literal_table(spark, S.PHASE_WINDOWS, S.PHASE_SCHEMA)
    average = fluxes.average_fluxes(df.unionByName(twin), events, windows).persist()
    phase = {(r["Reservoir"], str(r["Date"])): (r["TO"], r["Layer"]) for r in average.collect()}
    assert phase[("FCR", "2018-07-21")] == ("Pre_", "Hypolimnion") and phase[("FCR", "2018-07-22")][0] == "Pre"
    assert phase[("FCR", "2018-10-21")][0] == "Post" and phase[("FCR", "2018-09-01")] == ("Pre_", "Epilimnion")
    assert phase[("BVR", "2018-07-31")][0] is None and phase[("BVR", "2018-08-01")][0] == "Pre"
    assert phase[("BVR", "2019-10-29")][0] == "Pre" and phase[("BVR", "2019-10-30")][0] == "Post"
    assert phase[("FCR", "2024-05-01")][0] is None and phase[("FCR", "2019-06-03")] == ("Pre", "Epilimnion")
    season = fluxes.flux_season(fluxes.cumulative_fluxes(average))
    got = {(r["Reservoir"], r["Year"]): (r["CumulFe_gm2"], r["Duration_days"], r["FeFlux"]) for r in season.collect()}
    assert got == {("FCR", 2018): (30.0, 30.0, 1.0), ("BVR", 2018): (15.0, 15.0, 1.0), ("BVR", 2019): (15.0, 15.0, 1.0)}
    active = literal_table(spark, S.ACTIVE_WINDOWS, S.ACTIVE_SCHEMA)
    only = fluxes.flux_season(fluxes.cumulative_fluxes(average, active))
    assert {(r["Reservoir"], r["Year"]) for r in only.collect()} == {("FCR", 2018), ("BVR", 2018), ("BVR", 2019)}
    assert fluxes.long_season(season).where("Metal = 'Iron' and Metal_order = 1").count() == 3
    assert fluxes.long_cumulative(fluxes.cumulative_fluxes(average)).count() == 8
    table = fluxes.flux_table(average)
    assert {(r["Layer"], r["MedianFeFlux"]) for r in table.collect()} == {("Hypolimnion", 1.0), ("Epilimnion", 1.0)}
    oxygen = spark.sql("SELECT 'FCR' Reservoir, 50 Site, 2018 Year, 70D AvgDOsat_percent_9")
    assert fluxes.rates_with_oxygen(season, oxygen).first()["FeFlux"] == 1.0


def test_oxygen_stack_has_breaks_and_no_duplicates(spark):
    log = spark.sql("SELECT 'BVR' Reservoir, 50 Site, t DateTime, x FROM VALUES (timestamp'2020-06-29 01:00:00', 8D), (timestamp'2020-06-30 02:00:00', NULL), (timestamp'2017-06-30 02:00:00', 1D) AS v(t, x)")
    one = series.OxygenSource(log, "x", "13", "m", "2018-01-01")
    breaks = literal_table(spark, S.OXYGEN_BREAKS, S.BREAKS_SCHEMA)
    out = series.oxygen_daily([one, one], breaks).collect()
    assert sorted((str(r["Date"]), r["DO_mgL"]) for r in out) == [("2020-01-01", None), ("2020-05-15", None), ("2020-06-29", 8.0)]


def test_handheld_oxygen_windows(spark):
    df = spark.sql("SELECT s Reservoir, 50 Site, timestamp(d) DateTime, z Depth_m, 5D DO_mgL FROM VALUES ('FCR', '2018-08-18', 9D), ('FCR', '2018-08-19', 9D), ('BVR', '2018-05-04', 10D), ('BVR', '2018-05-04', 9D), ('BVR', '2020-03-14', 10D) AS v(s, d, z)")
    assert sorted((r["Reservoir"], r["Depth_m"], str(r["Date"])) for r in series.oxygen_handheld(df).collect()) == [
        ("BVR", "10", "2018-05-04"), ("BVR", "10", "2020-03-14"), ("FCR", "9", "2018-08-18"),
    ]


def test_weather(spark):
    df = spark.sql("SELECT t DateTime, 10D AirTemp_C_Average, r Rain_Total_mm, 2D WindSpeed_Average_m_s FROM VALUES (timestamp'2019-12-31 23:50:00', 5D), (timestamp'2020-12-31 00:00:00', 5D), (timestamp'2020-12-31 01:00:00', NULL), (timestamp'2024-01-01 00:00:00', 1D) AS v(t, r)")
    out = {str(r["Date"]): r for r in series.weather_daily(df).collect()}
    assert set(out) == {"2019-12-31", "2020-12-31"}
    assert out["2019-12-31"]["Rain_Total_sum_cm"] == 0.5 and out["2020-12-31"]["Rain_Total_sum_cm"] is None
    assert str(out["2020-12-31"]["ddate"]) == "1970-12-31" or str(out["2020-12-31"]["ddate"]) == "1971-01-01"
    assert series.weather_long(series.weather_daily(df), "Rain_Total_sum_cm").count() == 2


def test_casts(spark):
    cast = lambda rows: spark.createDataFrame(rows, "Reservoir string, t string, Depth_m double, Temp_C double, pH double").select(
        "Reservoir", F.lit(50).alias("Site"), F.col("t").cast("timestamp").alias("DateTime"), "Depth_m", "Temp_C", "pH", F.lit(0).alias("Flag_Temp_C")
    )
    ctd = cast([("FCR", "2020-05-01 10:00:00", 1.0, 10.0, None), ("FCR", "2020-05-01 09:00:00", 2.0, 9.0, None), ("FCR", "2020-05-01 10:00:00", 0.0, 9.0, 7.0)])
    hand = cast([("BVR", "2020-05-01 10:00:00", 0.0, 3.0, 7.0), ("BVR", "2020-02-29 10:00:00", 0.0, 3.0, 7.0), ("FCR", "2020-05-02 10:00:00", 1.0, None, 7.0)])
    a, b = series.profile_casts(ctd), series.handheld_casts(hand)
    assert "Flag_Temp_C" not in a.columns
    out = series.merge_casts(a, b, ["Temp_C"])
    assert sorted((r["Reservoir"], str(r["Date"])) for r in out.collect()) == [("BVR", "2020-02-28"), ("FCR", "2020-05-01"), ("FCR", "2020-05-01")]
    # by site the other site's cast of that day stays; rows without pH claim no day
    assert series.merge_casts(a, b, ["Temp_C"], ["Reservoir", "Date"]).count() == 4
    assert series.merge_casts(a, b, ["pH"], drop_null_before=True).count() == 3
    first = {(r["Reservoir"], str(r["Date"])): r for r in series.cast_days(out).collect()}
    assert first[("FCR", "2020-05-01")]["DateTime"].hour == 9 and str(first[("BVR", "2020-02-28")]["MDay"]) == "2001-02-28"


def test_heatmap_grid_limits(spark):
    rows = [("FCR", "2020-05-01", z, 40.0 - 10 * z) for z in (0.0, 1.0, 2.0)] + [("FCR", "2020-05-03", z, 20.0) for z in (0.0, 2.0)]
    df = spark.createDataFrame(rows, "Reservoir string, t string, Depth_m double, Temp_C double").withColumn("DateTime", F.col("t").cast("timestamp"))
    out = series.heatmap_grid(df, ["Temp_C"]).collect()
    assert len(out) == 3 * 4
    cell = {(r["x"].day, r["y"]): (r["z"], r["z_shown"]) for r in out}
    assert cell[(1, 0.5)] == (35.0, None) and cell[(2, 2.0)] == (20.0, 20.0) and cell[(2, 0.5)] == (27.5, 27.5)
