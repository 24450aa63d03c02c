"""Queries of operators at the resolution of times, found steps, bands, sinks and damaged input; further domain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import fill as G
from ..operators import joins as J
from ..operators import scan as O
from ..operators import stats as T
from ..plans import chemistry as C
from ..plans import fluxes as X
from ..plans import series as W
from ..plans import stratification as Z
from ..session import ensure_checkpoint_dir
from ..sources import tables as IO
from .base import Tables, query, r, rounded
from .domain import (
    CTD_SQL,
    CUMULATIVE_SQL,
    AVERAGE_SQL,
    HAND_SQL,
    INTERVALS_SQL,
    OXYGEN_SQL,
    PERIODS_SQL,
    PROFILES_SQL,
    QC_KEPT_SQL,
    SHIFT,
    WINDOWS_SQL,
    active_windows,
    average_fluxes,
    intervals,
    metals,
    profiles,
    scratch,
    shifted,
    site,
)
from .series import FIT_SQL, rho_sql

# --- ordered scans -------------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS n, round(sum(value) OVER w, 2) AS total
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WINDOW w AS (ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)
""")
def cumulate_epoch(t: Tables) -> DataFrame:
    """One series of the whole table in the order of epoch seconds, cut into planned chunks (F2)."""
    rows = t("events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "value")
    sums = {"n": F.lit(1).cast("long"), "total": F.col("value")}
    return rounded(O.running_sums(rows, [], ["s", "event_id"], sums).select("event_id", "n", "total"), "total", digits=2)


MIXED_SQL = """SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN time_bucket(INTERVAL 10 MINUTE, ts) ELSE date_trunc('hour', ts) END AS h, avg(value) AS v FROM events GROUP BY ALL"""
STEPS_SQL = f"""m AS ({MIXED_SQL}), nx AS (SELECT *, lead(h) OVER (PARTITION BY event_type ORDER BY h) AS h2 FROM m),
 st AS (SELECT event_type, CAST(epoch(h2 - h) AS DOUBLE) AS step FROM nx WHERE h2 IS NOT NULL GROUP BY event_type, step QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, step) = 1)"""


def mixed_series(t: Tables) -> DataFrame:
    """Series of ten minutes and of hours, with gaps."""
    ten = F.col("event_type").isin("view", "click")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    slot = F.when(ten, F.window("ts", "10 minutes")["start"].cast("timestamp_ntz")).otherwise(hour)
    rows = t("events").select("event_type", "ts", "value")
    return rows.groupBy("event_type", slot.alias("h")).agg(F.avg("value").alias("v"))


@query(f"WITH {STEPS_SQL} SELECT * FROM st")
def steps_found(t: Tables) -> DataFrame:
    """The step of each series from its own lags."""
    return G.series_steps(mixed_series(t), ["event_type"], "h")


@query(f"""WITH {STEPS_SQL},
 g AS (SELECT nx.event_type, unnest(generate_series(h, coalesce(h2 - INTERVAL 1 MICROSECOND, h), to_seconds(step))) AS q, h, v FROM nx JOIN st USING (event_type))
SELECT event_type, q AS h, round(CASE WHEN q = h THEN v END, 6) AS v FROM g""")
def fill_gaps_found(t: Tables) -> DataFrame:
    """Each series filled at the step found for it."""
    return rounded(G.fill_gaps(mixed_series(t), ["event_type"], "h"), "v")


# --- bands ---------------------------------------------------------------------------------------

# the t quantile has a closed form for 1, 2 and 4 degrees of freedom
QUANTILE_SQL = """CASE n WHEN 3 THEN tan(pi() / 2 * 0.95) WHEN 4 THEN 0.95 * sqrt(2 / (1 - 0.95 * 0.95))
 ELSE 2 * sqrt(cos(acos(sqrt(4 * 0.975 * 0.025)) / 3) / sqrt(4 * 0.975 * 0.025) - 1) END"""
BAND_ROWS_SQL = """SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y FROM lineitem WHERE l_orderkey IN (
 SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) IN (3, 4, 6) AND min(l_linenumber) < max(l_linenumber))"""


@query(f"""WITH f AS ({FIT_SQL.format(keys="l_orderkey", y="y", x="l_linenumber", table=f"({BAND_ROWS_SQL})")}),
m AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM ({BAND_ROWS_SQL}) GROUP BY ALL),
p AS (SELECT f.*, unnest([lo, (lo + hi) / 2, hi]) AS px FROM f JOIN m USING (l_orderkey))
SELECT l_orderkey, CAST(px AS DOUBLE) AS x, round(a + b * px, 6) AS fit, round({QUANTILE_SQL} * s * sqrt(1.0 / n + (px - mx) * (px - mx) / sxx), 4) AS half FROM p""")
def fit_band(t: Tables) -> DataFrame:
    """Confidence bands of small groups, each by its own t quantile."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"))
    sizes = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")
    )
    wanted = sizes.where(F.col("n").isin(3, 4, 6) & (F.col("lo") < F.col("hi")))
    band = T.fit_line(J.join_on(lines, wanted.select("l_orderkey"), ["l_orderkey"], "left_semi"), "y", "l_linenumber", ["l_orderkey"], points=3, level=0.95)
    half = (F.col("high") - F.col("low")) / 2
    return band.select("l_orderkey", "x", r("fit").alias("fit"), r(half, 4).alias("half"))


# --- intervals at the resolution of times --------------------------------------------------------

OUTAGES_SQL = "SELECT user_id, ts AS a, ts + to_microseconds(CAST(value * 60e6 AS BIGINT)) AS b FROM events WHERE event_type = 'error'"


def outages(t: Tables) -> DataFrame:
    """Overlapping intervals of seconds to hours."""
    length = F.make_dt_interval(secs=(F.col("value") * 60).cast("decimal(18,6)"))
    return t("events").where("event_type = 'error'").select("user_id", F.col("ts").alias("a"), (F.col("ts") + length).alias("b"))


@query(f"""WITH i AS ({OUTAGES_SQL}), n AS (SELECT event_id, count(i.a) AS k FROM events e LEFT JOIN i ON i.user_id = e.user_id AND e.ts BETWEEN i.a AND i.b GROUP BY ALL)
SELECT event_id, CAST(k AS BIGINT) AS open, CASE WHEN k > 0 THEN 'On' ELSE 'Off' END AS state FROM n""")
def interval_tag_times(t: Tables) -> DataFrame:
    """How many intervals hold each row's time, and whether any does."""
    rows = J.open_intervals(t("events").select("event_id", "user_id", "ts"), outages(t), "ts", ["user_id"], "a", "b")
    tagged = J.tag_intervals_at(rows, outages(t), "ts", ["user_id"], "a", "b")
    return tagged.select("event_id", "open", "state")


@query(f"""WITH i AS ({OUTAGES_SQL}) SELECT event_id, ts FROM events e WHERE EXISTS (SELECT 1 FROM i WHERE e.ts BETWEEN i.a AND i.b AND i.user_id % 50 = e.user_id % 50)""")
def interval_semi_times(t: Tables) -> DataFrame:
    """Rows whose time lies in an interval of their group."""
    group = (F.col("user_id") % 50).alias("g")
    rows = t("events").select("event_id", "ts", group)
    return J.within_intervals(rows, outages(t).select(group, "a", "b"), "ts", ["g"], "a", "b").select("event_id", "ts")


# --- sources and sinks ---------------------------------------------------------------------------


def damaged_input(t: Tables) -> list[str]:
    """Two delimited files: every fiftieth line of the first has text for a price; the second has a new column."""
    broken, even = F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") % 2 == 0
    price = F.when(broken, F.concat(F.lit("x"), "o_orderkey")).otherwise(F.col("o_totalprice").cast("string"))
    first, second = scratch(t, "first"), scratch(t, "second")
    IO.write_table(t("orders").where(even).select("o_orderkey", "o_custkey", price.alias("o_totalprice")), first)
    IO.write_table(t("orders").where(~even).select("o_totalprice", "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("Notes")), second)
    return [first, second]


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS notes, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey || ',' || o_custkey || ',x' || o_orderkey END AS line FROM orders""")
def damaged_files(t: Tables) -> DataFrame:
    """Damaged lines are kept with their text, and a column of only some files is NULL elsewhere (A1, A4)."""
    rows = IO.read_many(t.spark, damaged_input(t), damaged="line")
    return rows.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_totalprice", F.col("Notes").alias("notes"), "line")


@query("""SELECT o_orderkey % 2 = 0 AS first, CAST(count(*) AS BIGINT) AS rows, CAST(count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) AS BIGINT) AS damaged, CAST(0 AS BIGINT) AS empty FROM orders GROUP BY ALL""")
def damaged_counts(t: Tables) -> DataFrame:
    """Rows and damaged lines of each file (A1)."""
    rows = IO.read_many(t.spark, damaged_input(t), damaged="line").withColumn("first", F.col("source_file").contains("first-"))
    return IO.damaged_lines(rows, "line", ["first"])


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS extra FROM orders""")
def merged_schemas(t: Tables) -> DataFrame:
    """Parquet files of which one has a further column (A4)."""
    even = F.col("o_orderkey") % 2 == 0
    paths = [scratch(t, n).removesuffix(".csv") + ".parquet" for n in ("old", "new")]
    IO.write_table(t("orders").where(even).select("o_orderkey", "o_totalprice"), paths[0])
    IO.write_table(t("orders").where(~even).select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("extra")), paths[1])
    return IO.read_table(t.spark, paths)


BUCKETS = 8


def bucketed(t: Tables, df: DataFrame, keys: list[str]) -> DataFrame:
    return IO.write_bucketed(df, f"epilimnia_{uuid.uuid4().hex}", keys, BUCKETS)


def bucketed_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    obs = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    flags = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("flag"))
    return bucketed(t, obs, ["k"]), bucketed(t, flags, ["k"])


@query("""SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderstatus AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'""")
def bucketed_flags(t: Tables) -> DataFrame:
    """Observations with their flags from bucketed tables: no rows move."""
    obs, flags = bucketed_sides(t)
    return IO.join_buckets(obs, flags.where("flag <> 'F'"), ["k"])


@query("""SELECT l_orderkey AS k, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS total FROM lineitem
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY ALL""")
def bucketed_anti(t: Tables) -> DataFrame:
    """Keys without an excluding row, then a sum by key, from bucketed tables."""
    obs, flags = bucketed_sides(t)
    kept = IO.join_buckets(obs, flags.where("flag = 'F'"), ["k"], "left_anti")
    return kept.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS position FROM orders""")
def sorted_positions(t: Tables) -> DataFrame:
    """Written in order and read back with each row's place (G1)."""
    path = f"{ensure_checkpoint_dir(t.spark)}/sorted-{uuid.uuid4().hex}"
    IO.write_sorted(t("orders").select("o_orderkey", "o_orderdate"), path, ["o_orderdate", "o_orderkey"], files=BUCKETS)
    return IO.read_sorted(t.spark, path).select("o_orderkey", "position")


# --- domain --------------------------------------------------------------------------------------


@query(f"""{PERIODS_SQL} SELECT "year", CAST(length AS INT) AS length, "start", "end", site_id, 'sensor' AS method FROM pe""")
def control_periods(t: Tables) -> DataFrame:
    """Stratified periods recorded in a control file and read back (A2)."""
    path = scratch(t, "periods")
    IO.write_table(Z.stratified_periods(profiles(t)).withColumn("method", F.lit("sensor")), path)
    return IO.read_periods(t.spark, path)


@query(f"""SELECT DISTINCT Reservoir, DateTime, "Year", TRY_CAST('2001-' || strftime("Date", '%m-%d') AS DATE) AS "MDay" FROM ({QC_KEPT_SQL})""")
def sample_days(t: Tables) -> DataFrame:
    """Sampling times with their overlay day (K9)."""
    return C.sample_days(C.metals_rows(metals(t)))


ACTIVE_RATES_SQL = f"""SELECT Reservoir, "Year" AS y, round_even(max(CumulFe_gm2) / sum(Duration_days), 3) AS fe, round_even(max(CumulMn_gm2) / sum(Duration_days), 3) AS mn
 FROM ({CUMULATIVE_SQL.format(AVERAGE_SQL, f'AND EXISTS (SELECT 1 FROM {WINDOWS_SQL} WHERE w.y = "Year" AND "Date" BETWEEN a AND b)')}) GROUP BY ALL"""


@query(f"""WITH o AS ({OXYGEN_SQL}),
on_ AS (SELECT Reservoir, HOxOn FROM ({INTERVALS_SQL}) WHERE HOxOff - HOxOn >= 7 QUALIFY rank() OVER (PARTITION BY Reservoir, year(HOxOn) ORDER BY HOxOn) = 1),
l AS (SELECT Reservoir, Site, CAST(DateTime AS DATE) AS HOxStart, avg(sat) AS v FROM o WHERE Reservoir = 'FCR' GROUP BY ALL),
a AS (SELECT Reservoir, Site, HOxStart, v, CAST(year(HOxStart) AS INT) AS y FROM l WHERE (Reservoir, HOxStart) IN (SELECT (Reservoir, HOxOn) FROM on_)),
h AS (SELECT Reservoir, Site, CAST(DateTime AS DATE) AS HOxStart, sat AS v, CAST(year(DateTime) AS INT) AS y FROM o WHERE Reservoir = 'FCR' AND DateTime = TIMESTAMP '2018-04-23' AND Depth_m = 9),
d AS (SELECT coalesce(a.Reservoir, h.Reservoir) AS Reservoir, coalesce(a.Site, h.Site) AS Site, coalesce(a.HOxStart, h.HOxStart) AS HOxStart, coalesce(a.v, h.v) AS v, coalesce(a.y, h.y) AS y
 FROM a FULL JOIN h ON a.Reservoir = h.Reservoir AND a.Site = h.Site AND a.HOxStart = h.HOxStart AND a.v = h.v AND a.y = h.y),
s AS (SELECT * FROM ({ACTIVE_RATES_SQL}) WHERE Reservoir = 'FCR' AND y >= 2018)
SELECT coalesce(s.Reservoir, d.Reservoir) AS Reservoir, CAST(coalesce(s.y, d.y) AS INT) AS "Year", fe AS "FeFlux", mn AS "MnFlux", Site, HOxStart, round(v, 6) AS "AvgDOsat_percent_9"
FROM s FULL JOIN d ON d.Reservoir = s.Reservoir AND d.y = s.y""")
def active_rates_at_onset(t: Tables) -> DataFrame:
    """Rates of the treatment season next to oxygen on the day treatment began."""
    oxygen = t("lineitem").select(
        site("l_suppkey").alias("Reservoir"), F.lit(50).alias("Site"), shifted("l_shipdate").alias("DateTime"),
        (F.col("l_linenumber") + 2).cast("double").alias("Depth_m"), (F.col("l_quantity") * 2).alias("DOsat_percent"),
    ).where(F.col("Reservoir") == S.TREATED)
    onset = C.treatment_onset(intervals(t))
    at_onset = C.oxygen_at_onset(oxygen, oxygen, onset, col="DOsat_percent", handheld_at="2018-04-23 00:00:00")
    season = X.flux_season(X.cumulative_fluxes(average_fluxes(t), active_windows(t)))
    return rounded(X.rates_with_oxygen(season, at_onset), "AvgDOsat_percent_9")


# --- casts of pH and turbidity -------------------------------------------------------------------

PH_CTD_SQL = CTD_SQL.replace("l_quantity AS Temp_C", "CASE WHEN l_partkey % 5 <> 0 THEN 6 + l_quantity / 25 END AS pH, l_extendedprice / 600 AS Turbidity_NTU, l_quantity AS Temp_C")
PH_HAND_SQL = HAND_SQL.replace("o_totalprice / 20000 AS Temp_C", "6 + o_totalprice / 200000 AS pH, o_totalprice / 20000 AS Temp_C")


def ph_profiles(t: Tables) -> DataFrame:
    every_fifth = shifted("l_shipdate") - F.make_dt_interval(days=F.unix_date(F.to_date("l_shipdate")) % 5)
    return W.profile_casts(t("lineitem").select(
        site("l_suppkey").alias("Reservoir"), F.lit(50).alias("Site"), every_fifth.alias("DateTime"),
        (F.col("l_linenumber") - 1).cast("double").alias("Depth_m"), F.when(F.col("l_partkey") % 5 != 0, 6 + F.col("l_quantity") / 25).alias("pH"),
        (F.col("l_extendedprice") / 600).alias("Turbidity_NTU"),
    ))


@query(f"""WITH c AS (SELECT Reservoir, Site, DateTime, Depth_m, pH, CAST(DateTime AS DATE) AS d FROM ({PH_CTD_SQL}) WHERE DateTime > TIMESTAMP '2018-01-01' AND DateTime < TIMESTAMP '2023-12-31' AND Depth_m > 0 AND pH IS NOT NULL),
 h AS (SELECT Reservoir, Site, DateTime, Depth_m, pH, CAST(DateTime AS DATE) AS d FROM ({PH_HAND_SQL}) WHERE DateTime >= TIMESTAMP '2018-01-01' AND DateTime <= TIMESTAMP '2023-12-31'),
 m AS (SELECT * FROM c UNION ALL SELECT * REPLACE (CASE WHEN d = DATE '2020-02-29' THEN DATE '2020-02-28' ELSE d END AS d) FROM h WHERE d NOT IN (SELECT d FROM c))
SELECT Reservoir, Site, DateTime, Depth_m, round(pH, 6) AS "pH", d AS "Date", CAST(year(DateTime) AS INT) AS "Year" FROM m""")
def casts_ph(t: Tables) -> DataFrame:
    """pH casts: only complete profiler rows claim a day (K7)."""
    hand = t("orders").select(
        site("o_custkey").alias("Reservoir"), F.lit(50).alias("Site"), shifted("o_orderdate").alias("DateTime"),
        (F.col("o_orderkey") % 5).cast("double").alias("Depth_m"), (6 + F.col("o_totalprice") / 200000).alias("pH"),
    )
    return rounded(W.merge_casts(ph_profiles(t), W.handheld_casts(hand), ["pH"], drop_null_before=True), "pH")


@query(f"""SELECT Reservoir, Site, DateTime, Depth_m, round(Turbidity_NTU, 6) AS "Turbidity_NTU", CAST(DateTime AS DATE) AS "Date", CAST(year(DateTime) AS INT) AS "Year" FROM ({PH_CTD_SQL})
 WHERE DateTime > TIMESTAMP '2018-01-01' AND DateTime < TIMESTAMP '2023-12-31' AND Depth_m > 0 AND Turbidity_NTU <= 100""")
def casts_turbidity(t: Tables) -> DataFrame:
    """Turbidity casts within the sensor's limit (K7)."""
    return rounded(W.turbidity_casts(ph_profiles(t)), "Turbidity_NTU")


@query(f"""WITH pr AS (SELECT site_id, datetime, depth_m - 1 AS depth_m, CASE WHEN NOT (site_id = 'BVR' AND datetime = DATE '2022-06-21' AND depth_m = 1) THEN observation END AS observation
  FROM ({PROFILES_SQL}) WHERE year(datetime) >= 2021),
 l AS (SELECT *, lead(depth_m) OVER w AS z2, lead(observation) OVER w AS o2 FROM pr WINDOW w AS (PARTITION BY site_id, datetime ORDER BY depth_m)),
 n AS (SELECT site_id, datetime, 9.81 * ({rho_sql('o2')} - {rho_sql('observation')}) / ({rho_sql('observation')} * (z2 - depth_m)) AS n2 FROM l WHERE z2 IS NOT NULL),
 bf AS (SELECT site_id, datetime, CASE WHEN count(n2) = count(*) THEN round(max(n2), 10) END AS bf FROM n GROUP BY ALL)
SELECT datetime, max(CASE WHEN site_id = 'FCR' THEN bf END) AS "FCR", max(CASE WHEN site_id = 'BVR' THEN bf END) AS "BVR" FROM bf GROUP BY ALL""")
def buoyancy_compared(t: Tables) -> DataFrame:
    """Buoyancy of the two sites in the compared years, without the wrong reading."""
    rows = Z.comparable_profiles(profiles(t).withColumn("depth_m", F.col("depth_m") - 1))
    return Z.by_site(rounded(Z.buoyancy_daily(rows), "bf", digits=10), ["datetime"], "bf")
