"""Domain plans on stand-in inputs derived from the given tables.

orders and lineitem are moved by whole days so that their seven years start in 2018; two sites are told
apart by key parity. Stand-ins keep all rows of their table; where every day would be taken, days are moved
by an expression instead. Windows and sites of the study are the plans' own filters.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import select as P
from ..operators.runs import profile_gradient
from ..operators.scan import positions
from ..operators.stats import paired_t as paired
from ..plans import chemistry as C
from ..plans import fluxes as X
from ..plans import sensors as N
from ..plans import series as W
from ..plans import stratification as Z
from ..session import ensure_checkpoint_dir, literal_table
from ..sources import tables as IO
from ..sources.tables import read_table, write_table
from ..streaming.daily import daily_mean_stream as stream_op
from ..streaming.daily import current_rows, run_updates
from .base import Tables, query, r, rounded
from .relational import MISSING
from .series import FIT_SQL, P_SQL, rho_sql

SHIFT = 8401


def site(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, F.lit("FCR")).otherwise(F.lit("BVR"))


def site_sql(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 0 THEN 'FCR' ELSE 'BVR' END"


def shifted(ts: str) -> Column:
    return F.col(ts) + F.expr(f"INTERVAL {SHIFT} DAYS")


def shifted_day(ts: str) -> Column:
    return F.date_add(F.to_date(ts), SHIFT)


# --- chemistry -----------------------------------------------------------------------------------

METALS_SQL = f"""SELECT {site_sql('l_suppkey')} AS Reservoir, CAST(50 AS INT) AS Site, l_shipdate + INTERVAL {SHIFT} DAY AS DateTime,
 CAST(l_linenumber + 2 AS DOUBLE) AS Depth_m, l_extendedprice / 10000 AS TFe_mgL, l_quantity / 5 AS SFe_mgL, l_tax * 10 AS TMn_mgL, l_discount * 5 AS SMn_mgL,
 CASE WHEN l_partkey % 19 = 0 THEN 8 WHEN l_partkey % 23 = 0 THEN 68 WHEN l_partkey % 29 = 0 THEN NULL ELSE 0 END AS Flag_TFe_mgL,
 CASE WHEN l_orderkey % 31 = 0 THEN 8 ELSE 1 END AS Flag_TMn_mgL FROM lineitem"""
QC_SQL = f"""SELECT *, CAST(year(DateTime) AS INT) AS "Year", CAST(DateTime AS DATE) AS "Date" FROM (
 SELECT *, TFe_mgL - SFe_mgL AS FeDiff, TMn_mgL - SMn_mgL AS MnDiff, SFe_mgL / nullif(TFe_mgL, 0) AS STFe, SMn_mgL / nullif(TMn_mgL, 0) AS STMn,
  CASE WHEN Depth_m >= CASE WHEN Reservoir = 'FCR' THEN 4 ELSE 5 END THEN 'Hypolimnion' ELSE 'Epilimnion' END AS Layer
 FROM ({METALS_SQL}) WHERE Flag_TFe_mgL NOT IN (8, 68) AND Flag_TMn_mgL NOT IN (8, 68))"""
QC_KEPT_SQL = f"""SELECT * FROM (SELECT *, avg(STFe) OVER g AS AvgSTFe, avg(STMn) OVER g AS AvgSTMn FROM ({QC_SQL})
 WINDOW g AS (PARTITION BY Reservoir, Site, "Date", Layer)) WHERE FeDiff >= -0.02 AND MnDiff >= -0.06"""


def metals(t: Tables) -> DataFrame:
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    iron = F.when(part % 19 == 0, 8).when(part % 23 == 0, 68).when(part % 29 == 0, F.lit(None)).otherwise(0)
    return t("lineitem").select(
        site("l_suppkey").alias("Reservoir"),
        F.lit(50).alias("Site"),
        shifted("l_shipdate").alias("DateTime"),
        (F.col("l_linenumber") + 2).cast("double").alias("Depth_m"),
        (F.col("l_extendedprice") / 10000).alias("TFe_mgL"),
        (F.col("l_quantity") / 5).alias("SFe_mgL"),
        (F.col("l_tax") * 10).alias("TMn_mgL"),
        (F.col("l_discount") * 5).alias("SMn_mgL"),
        iron.alias("Flag_TFe_mgL"),
        F.lit(0).alias("Flag_SFe_mgL"),
        F.when(order % 31 == 0, 8).otherwise(1).alias("Flag_TMn_mgL"),
        F.lit(0).alias("Flag_SMn_mgL"),
    )


@query(f"""SELECT Reservoir, DateTime, Depth_m, TFe_mgL, SMn_mgL, Layer, "Year", round(FeDiff, 6) AS FeDiff, round(MnDiff, 6) AS MnDiff,
 round(AvgSTFe, 6) AS AvgSTFe, round(AvgSTMn, 6) AS AvgSTMn FROM ({QC_KEPT_SQL})""")
def metals_qc(t: Tables) -> DataFrame:
    names = ["Reservoir", "DateTime", "Depth_m", "TFe_mgL", "SMn_mgL", "Layer", "Year"]
    return C.metals_qc(metals(t)).select(*names, *[r(c).alias(c) for c in ("FeDiff", "MnDiff", "AvgSTFe", "AvgSTMn")])


@query(f"""SELECT Reservoir, DateTime, Depth_m, round(SFe_mgL / nullif(TFe_mgL, 0), 6) AS Fe_ratio, round(SMn_mgL / nullif(TMn_mgL, 0), 6) AS Mn_ratio FROM (
 SELECT Reservoir, DateTime, Depth_m, greatest(TFe_mgL, SFe_mgL) AS TFe_mgL, least(TFe_mgL, SFe_mgL) AS SFe_mgL, greatest(TMn_mgL, SMn_mgL) AS TMn_mgL, least(TMn_mgL, SMn_mgL) AS SMn_mgL
 FROM ({QC_SQL}) WHERE (FeDiff > 0 AND MnDiff > 0) OR (FeDiff < 0 AND MnDiff < 0))""")
def metal_ratios(t: Tables) -> DataFrame:
    out = C.metal_ratios(C.metals_for_grid(metals(t)))
    return rounded(out.select("Reservoir", "DateTime", "Depth_m", "Fe_ratio", "Mn_ratio"), "Fe_ratio", "Mn_ratio")


INTERVALS_SQL = f"""SELECT {site_sql('o_custkey')} AS Reservoir, CAST(o_orderdate AS DATE) + {SHIFT} AS HOxOn,
 CAST(o_orderdate AS DATE) + {SHIFT} + CAST(o_orderkey % 30 AS INT) AS HOxOff, o_totalprice AS price FROM orders"""


def intervals(t: Tables) -> DataFrame:
    on = shifted_day("o_orderdate")
    return t("orders").select(
        site("o_custkey").alias("Reservoir"), on.alias("HOxOn"), F.date_add(on, (F.col("o_orderkey") % 30).cast("int")).alias("HOxOff"),
        F.col("o_totalprice").alias("price"), "o_orderkey", "o_custkey",
    )


@query(f"""SELECT o_custkey, CAST(year(HOxOn) AS INT) AS "Year", HOxOn FROM (
 SELECT o_custkey, CAST(o_orderdate AS DATE) + {SHIFT} AS HOxOn, CAST(o_orderkey % 30 AS INT) AS len FROM orders) WHERE len >= 7
 QUALIFY rank() OVER (PARTITION BY o_custkey, year(HOxOn) ORDER BY HOxOn) = 1""")
def treatment_onset(t: Tables) -> DataFrame:
    return C.treatment_onset(intervals(t), site="o_custkey")


@query(f"""SELECT CAST(row_number() OVER (ORDER BY Reservoir, HOxOn, HOxOff, o_orderkey) AS BIGINT) AS g, o_orderkey FROM (
 SELECT {site_sql('o_custkey')} AS Reservoir, CAST(o_orderdate AS DATE) AS HOxOn, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS HOxOff, o_orderkey FROM orders)""")
def row_ids(t: Tables) -> DataFrame:
    return positions(intervals(t), [], ["Reservoir", "HOxOn", "HOxOff", "o_orderkey"], "g").select("g", "o_orderkey")


STATE_INTERVALS_SQL = f"""SELECT Reservoir, CAST(date_trunc('quarter', HOxOn) AS DATE) + k AS HOxOn, CAST(date_trunc('quarter', HOxOn) AS DATE) + k + n AS HOxOff FROM (
 SELECT Reservoir, HOxOn, CAST(HOxOff - HOxOn AS INT) AS n, CAST(CAST(round_even(price, 0) AS BIGINT) % 10 AS INT) AS k FROM ({INTERVALS_SQL}))"""


def state_intervals(t: Tables) -> DataFrame:
    """All intervals, moved to the beginning of their quarter so that some days stay without treatment."""
    start = F.date_add(F.trunc("HOxOn", "quarter"), (F.bround("price").cast("long") % 10).cast("int"))
    return intervals(t).select("Reservoir", start.alias("HOxOn"), F.date_add(start, F.date_diff("HOxOff", "HOxOn")).alias("HOxOff"))


@query(f"""WITH iv AS ({STATE_INTERVALS_SQL})
SELECT Reservoir, Layer, HOx, round_even(avg(SFe_mgL / nullif(TFe_mgL, 0)), 3) AS AvgSTFe, round_even(avg(SMn_mgL / nullif(TMn_mgL, 0)), 3) AS AvgSTMn FROM (
 SELECT *, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.Reservoir = m.Reservoir AND m."Date" BETWEEN HOxOn AND HOxOff) THEN 'On' ELSE 'Off' END AS HOx
 FROM ({QC_KEPT_SQL}) m WHERE Layer = 'Hypolimnion') GROUP BY ALL""")
def ratio_by_state(t: Tables) -> DataFrame:
    return C.ratio_by_state(C.metals_rows(metals(t)), state_intervals(t))


EVENTS_SQL = f"""SELECT Reservoir, "Year", min("Date") AS "Date" FROM (
 SELECT {site_sql('o_custkey')} AS Reservoir, CAST(o_orderdate AS DATE) + {SHIFT} AS "Date", year(CAST(o_orderdate AS DATE) + {SHIFT}) AS "Year" FROM orders)
 WHERE dayofyear("Date") > 290 GROUP BY ALL"""


def turnover_events(t: Tables) -> DataFrame:
    rows = t("orders").select(site("o_custkey").alias("Reservoir"), shifted_day("o_orderdate").alias("Date"))
    return rows.where(F.dayofyear("Date") > 290).groupBy("Reservoir", F.year("Date").alias("Year")).agg(F.min("Date").alias("Date"))


RELEASE_SQL = f"""SELECT m."Year", greatest(TMn_mgL, SMn_mgL) AS y, CAST(m."Date" - DATE '1970-01-01' AS DOUBLE) AS x
 FROM ({QC_KEPT_SQL}) m JOIN ({EVENTS_SQL}) e ON e.Reservoir = m.Reservoir AND e."Year" = m."Year"
 WHERE m."Year" = 2020 AND MnDiff <> 0 AND Layer = 'Hypolimnion' AND m.Reservoir = 'FCR' AND Depth_m = 9 AND m."Date" < e."Date" AND m."Date" >= DATE '2020-03-11'"""


@query(f"""WITH f AS ({FIT_SQL.format(keys='"Year"', y="y", x="x", table=f"({RELEASE_SQL})")}),
g AS (SELECT *, n - 2 AS df, b / (s / sqrt(sxx)) AS t FROM f), h AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM g)
SELECT "Year", CAST(n AS BIGINT) AS n, round(b, 8) AS slope, round(a, 5) AS intercept, round(s, 6) AS residual_error, round(t, 4) AS slope_t, round({P_SQL}, 5) AS slope_p FROM h""")
def release_rate(t: Tables) -> DataFrame:
    out = C.release_rate(C.metals_rows(metals(t)), 2020, "2020-03-11", turnover_events(t))
    return out.select(
        "Year", "n", r("slope", 8).alias("slope"), r("intercept", 5).alias("intercept"), r("residual_error").alias("residual_error"),
        r("slope_t", 4).alias("slope_t"), r("slope_p", 5).alias("slope_p"),
    )


RATES = [(2020, "2020-03-11", "Mn"), (2020, "2020-03-11", "Fe"), (2023, "2023-03-20", "Mn"), (2023, "2023-03-20", "Fe")]
RATES_SQL = " UNION ALL ".join(
    f"SELECT '{metal}' AS metal, * FROM (" + RELEASE_SQL.replace("2020-03-11", start).replace('"Year" = 2020', f'"Year" = {year}').replace(
        "greatest(TMn_mgL, SMn_mgL) AS y", "TFe_mgL AS y" if metal == "Fe" else "greatest(TMn_mgL, SMn_mgL) AS y") + ")"
    for year, start, metal in RATES
)


@query(f"""WITH f AS ({FIT_SQL.format(keys='metal, "Year"', y="y", x="x", table=f"({RATES_SQL})")})
SELECT metal, "Year", CAST(n AS BIGINT) AS n, round(b, 8) AS slope, round(a, 5) AS intercept, round(b / (s / sqrt(sxx)), 4) AS slope_t FROM f""")
def release_rates(t: Tables) -> DataFrame:
    """Both metals and both years."""
    rows, events = C.metals_rows(metals(t)), turnover_events(t)
    parts = [C.release_rate(rows, year, start, events, metal).withColumn("metal", F.lit(metal)) for year, start, metal in RATES]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        "metal", "Year", "n", r("slope", 8).alias("slope"), r("intercept", 5).alias("intercept"), r("slope_t", 4).alias("slope_t")
    )


WINDOWS_SQL = "(VALUES " + ", ".join(
    f"({w['Year']}, DATE '{w['start']}', DATE '{w['end']}')" for w in S.ACTIVE_WINDOWS
) + ") AS w(y, a, b)"


def active_windows(t: Tables) -> DataFrame:
    return literal_table(t.spark, S.ACTIVE_WINDOWS, S.ACTIVE_SCHEMA)


OXYGEN_SQL = f"""SELECT {site_sql('l_suppkey')} AS Reservoir, CAST(50 AS INT) AS Site, l_shipdate + INTERVAL {SHIFT} DAY AS DateTime,
 CAST(l_linenumber + 2 AS DOUBLE) AS Depth_m, l_quantity * 2 AS sat FROM lineitem"""


@query(f"""WITH o AS ({OXYGEN_SQL}),
on_ AS (SELECT Reservoir, HOxOn, year(HOxOn) AS y FROM ({INTERVALS_SQL}) WHERE HOxOff - HOxOn >= 7 QUALIFY rank() OVER (PARTITION BY Reservoir, year(HOxOn) ORDER BY HOxOn) = 1),
l AS (SELECT Reservoir, Site, CAST(DateTime AS DATE) AS HOxStart, avg(sat) AS v FROM o GROUP BY ALL),
a AS (SELECT Reservoir, Site, HOxStart, v, CAST(year(HOxStart) AS INT) AS y FROM l WHERE (Reservoir, HOxStart) IN (SELECT (Reservoir, HOxOn) FROM on_)),
h AS (SELECT Reservoir, Site, CAST(DateTime AS DATE) AS HOxStart, sat AS v, CAST(year(DateTime) AS INT) AS y FROM o WHERE Reservoir = 'FCR' AND DateTime = TIMESTAMP '2018-04-23' AND Depth_m = 9),
d AS (SELECT coalesce(a.Reservoir, h.Reservoir) AS Reservoir, coalesce(a.Site, h.Site) AS Site, coalesce(a.HOxStart, h.HOxStart) AS HOxStart, coalesce(a.v, h.v) AS v, coalesce(a.y, h.y) AS y
 FROM a FULL JOIN h ON a.Reservoir = h.Reservoir AND a.Site = h.Site AND a.HOxStart = h.HOxStart AND a.v = h.v AND a.y = h.y),
m AS (SELECT Reservoir, Site, "Year" AS y, max(TFe_mgL) AS fe, max(TMn_mgL) AS mn FROM ({QC_KEPT_SQL}) JOIN {WINDOWS_SQL} ON w.y = "Year" AND "Date" BETWEEN a AND b
 WHERE Depth_m = 9 AND Reservoir = 'FCR' GROUP BY ALL)
SELECT coalesce(d.Reservoir, m.Reservoir) AS Reservoir, coalesce(d.Site, m.Site) AS Site, CAST(coalesce(d.y, m.y) AS INT) AS "Year", HOxStart, round(v, 6) AS AvgDOsat_percent_9,
 round(fe, 6) AS MaxTFe_mgL, round(mn, 6) AS MaxTMn_mgL FROM d FULL JOIN m ON m.Reservoir = d.Reservoir AND m.Site = d.Site AND m.y = d.y""")
def onset_vs_max(t: Tables) -> DataFrame:
    oxygen = t("lineitem").select(
        site("l_suppkey").alias("Reservoir"), F.lit(50).alias("Site"), shifted("l_shipdate").alias("DateTime"),
        (F.col("l_linenumber") + 2).cast("double").alias("Depth_m"), (F.col("l_quantity") * 2).alias("DOsat_percent"),
    )
    onset = C.treatment_onset(intervals(t))
    rows = C.oxygen_at_onset(oxygen, oxygen, onset, col="DOsat_percent", handheld_at="2018-04-23 00:00:00")
    maxima = C.season_maximum(C.metals_rows(metals(t)), active_windows(t))
    out = C.natural_join(rows, maxima, "full")
    return rounded(out, "AvgDOsat_percent_9", "MaxTFe_mgL", "MaxTMn_mgL")


# --- fluxes --------------------------------------------------------------------------------------

TRAPS_SQL = f"""SELECT {site_sql('o_custkey')} AS Reservoir, CAST(o_orderdate AS DATE) + {SHIFT} AS "Date", CAST(3 + o_orderkey % 7 AS DOUBLE) AS Depth_m,
 CAST(7 + o_custkey % 3 AS DOUBLE) AS dur, o_totalprice / 100000 AS fe, CASE WHEN o_orderkey % 41 <> 0 THEN o_totalprice / 10000000 END AS mn FROM orders"""
AVERAGE_SQL = f"""SELECT a.*, CASE WHEN a."Date" >= e."Date" THEN 'Post' WHEN a."Date" < e."Date" THEN CASE WHEN a."Year" = 2018 THEN p.ph ELSE 'Pre' END END AS "TO"
FROM (SELECT Reservoir, "Date", Depth_m, CASE WHEN Depth_m <= 5 THEN 'Epilimnion' ELSE 'Hypolimnion' END AS Layer, CAST(year("Date") AS INT) AS "Year",
  avg(dur) AS Duration_days, avg(fe) AS AvgTFeFlux_gm2d, avg(mn) AS AvgTMnFlux_gm2d FROM ({TRAPS_SQL}) WHERE mn IS NOT NULL GROUP BY ALL) a
LEFT JOIN ({EVENTS_SQL}) e ON e.Reservoir = a.Reservoir AND e."Year" = a."Year"
LEFT JOIN (VALUES {", ".join(f"('{w['Reservoir']}', '{w['Layer']}', DATE '{w['start']}', DATE '{w['end']}', '{w['phase']}')" for w in S.PHASE_WINDOWS)}) AS p(s, l, x, y, ph)
 ON p.s = a.Reservoir AND p.l = a.Layer AND a."Date" BETWEEN p.x AND p.y"""
CUMULATIVE_SQL = """SELECT *, sum(AvgTFeFlux_gm2d * Duration_days) OVER w AS CumulFe_gm2, sum(AvgTMnFlux_gm2d * Duration_days) OVER w AS CumulMn_gm2, sum(Duration_days) OVER w AS CumulDuration_days
 FROM ({}) WHERE "TO" = 'Pre' AND Layer = 'Hypolimnion' {} WINDOW w AS (PARTITION BY Reservoir, Layer, "Year" ORDER BY "Date", Depth_m ROWS UNBOUNDED PRECEDING)"""


def average_fluxes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    traps = t("orders").select(
        site("o_custkey").alias("Reservoir"), shifted_day("o_orderdate").alias("Date"), (3 + k % 7).cast("double").alias("Depth_m"),
        (7 + F.col("o_custkey") % 3).cast("double").alias("Duration_days"), (F.col("o_totalprice") / 100000).alias("TFeFlux_gm2d"),
        F.when(k % 41 != 0, F.col("o_totalprice") / 10000000).alias("TMnFlux_gm2d"),
    )
    windows = literal_table(t.spark, S.PHASE_WINDOWS, S.PHASE_SCHEMA)
    return X.average_fluxes(traps, turnover_events(t), windows)


@query(f"""SELECT Reservoir, "Date", Depth_m, Layer, "Year", "TO", round(Duration_days, 6) AS Duration_days, round(AvgTFeFlux_gm2d, 6) AS fe, round(AvgTMnFlux_gm2d, 6) AS mn FROM ({AVERAGE_SQL})""")
def flux_phases(t: Tables) -> DataFrame:
    return average_fluxes(t).select(
        "Reservoir", "Date", "Depth_m", "Layer", "Year", "TO", r("Duration_days").alias("Duration_days"),
        r("AvgTFeFlux_gm2d").alias("fe"), r("AvgTMnFlux_gm2d").alias("mn"),
    )


@query(f"""SELECT Reservoir, "Date", Depth_m, "Year", round(CumulFe_gm2, 5) AS fe, round(CumulMn_gm2, 7) AS mn, round(CumulDuration_days, 5) AS days FROM ({CUMULATIVE_SQL.format(AVERAGE_SQL, "")})""")
def flux_cumulative(t: Tables) -> DataFrame:
    out = X.cumulative_fluxes(average_fluxes(t))
    return out.select(
        "Reservoir", "Date", "Depth_m", "Year", r("CumulFe_gm2", 5).alias("fe"), r("CumulMn_gm2", 7).alias("mn"),
        r("CumulDuration_days", 5).alias("days"),
    )


SEASON_SQL = """SELECT Reservoir, Layer, "Year", round(max(CumulFe_gm2), 4) AS CumulFe_gm2, round(max(CumulMn_gm2), 6) AS CumulMn_gm2, round(sum(Duration_days), 4) AS Duration_days, max("Date") AS "Date",
 round_even(max(CumulFe_gm2) / sum(Duration_days), 3) AS FeFlux, round_even(max(CumulMn_gm2) / sum(Duration_days), 3) AS MnFlux FROM ({}) GROUP BY ALL"""


def season_out(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "CumulFe_gm2", "Duration_days", digits=4), "CumulMn_gm2", digits=6)


@query(SEASON_SQL.format(CUMULATIVE_SQL.format(AVERAGE_SQL, "")))
def flux_season(t: Tables) -> DataFrame:
    return season_out(X.flux_season(X.cumulative_fluxes(average_fluxes(t))))


@query(SEASON_SQL.format(CUMULATIVE_SQL.format(AVERAGE_SQL, f"""AND EXISTS (SELECT 1 FROM {WINDOWS_SQL} WHERE w.y = "Year" AND "Date" BETWEEN a AND b)""")))
def flux_season_active(t: Tables) -> DataFrame:
    return season_out(X.flux_season(X.cumulative_fluxes(average_fluxes(t), active_windows(t))))


@query(f"""SELECT Reservoir, Layer, "Year", round_even(avg(AvgTFeFlux_gm2d), 3) AS MeanFeFlux, round_even(median(AvgTFeFlux_gm2d), 3) AS MedianFeFlux, round_even(min(AvgTFeFlux_gm2d), 3) AS MinFeFlux, round_even(max(AvgTFeFlux_gm2d), 3) AS MaxFeFlux,
 round_even(avg(AvgTMnFlux_gm2d), 3) AS MeanMnFlux, round_even(median(AvgTMnFlux_gm2d), 3) AS MedianMnFlux, round_even(min(AvgTMnFlux_gm2d), 3) AS MinMnFlux, round_even(max(AvgTMnFlux_gm2d), 3) AS MaxMnFlux
FROM ({AVERAGE_SQL}) WHERE "TO" = 'Pre' GROUP BY ALL""")
def flux_table(t: Tables) -> DataFrame:
    return X.flux_table(average_fluxes(t))


@query(f"""SELECT Reservoir, "Date", Depth_m, "Year", CASE k WHEN 'fe' THEN 'Iron' ELSE 'Manganese' END AS Metal, CAST(CASE k WHEN 'fe' THEN 1 ELSE 2 END AS INT) AS Metal_order, round(v, 6) AS Fluxes_gm2d FROM (
 SELECT Reservoir, "Date", Depth_m, "Year", 'fe' AS k, AvgTFeFlux_gm2d AS v FROM ({AVERAGE_SQL}) UNION ALL SELECT Reservoir, "Date", Depth_m, "Year", 'mn', AvgTMnFlux_gm2d FROM ({AVERAGE_SQL}))""")
def flux_long(t: Tables) -> DataFrame:
    out = X.long_fluxes(average_fluxes(t)).select("Reservoir", "Date", "Depth_m", "Year", "Metal", "Metal_order", "Fluxes_gm2d")
    return rounded(out, "Fluxes_gm2d")


SITE_RATES_SQL = f"""SELECT Reservoir, "Year" AS y, round_even(max(CumulFe_gm2) / sum(Duration_days), 3) AS fe, round_even(max(CumulMn_gm2) / sum(Duration_days), 3) AS mn
 FROM ({CUMULATIVE_SQL.format(AVERAGE_SQL, "")}) GROUP BY ALL"""


@query(f"""WITH s AS (SELECT Reservoir, y, unnest(['FeFlux', 'MnFlux']) AS measure, unnest([fe, mn]) AS v FROM ({SITE_RATES_SQL})),
y AS (SELECT measure, y, max(CASE WHEN Reservoir = 'FCR' THEN v END) - max(CASE WHEN Reservoir = 'BVR' THEN v END) AS d FROM s GROUP BY ALL),
a AS (SELECT measure, count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(d) - 1 AS df FROM y GROUP BY measure), h AS (SELECT *, m * sqrt(n) / sd AS t, atan(abs(m * sqrt(n) / sd) / sqrt(df)) AS th FROM a)
SELECT measure, CAST(n AS BIGINT) AS pairs, CAST(df AS INT) AS df, round(m, 6) AS mean_difference, round(t, 5) AS t, round({P_SQL}, 6) AS p FROM h""")
def flux_paired_t(t: Tables) -> DataFrame:
    """Season rates of the two sites, paired by year."""
    season = X.flux_season(X.cumulative_fluxes(average_fluxes(t)))
    out = paired(season, "Year", "Reservoir", "FCR", "BVR", ["FeFlux", "MnFlux"])
    return out.select("measure", "pairs", "df", r("mean_difference").alias("mean_difference"), r("t", 5).alias("t"), r("p").alias("p"))


@query(f"""WITH o AS (SELECT Reservoir, CAST(year(DateTime) AS INT) AS y, round(avg(sat), 6) AS v FROM ({METALS_SQL.replace("l_tax * 10 AS TMn_mgL", "l_tax * 10 AS TMn_mgL, l_quantity * 2 AS sat")}) WHERE Reservoir = 'FCR' GROUP BY ALL),
 s AS (SELECT * FROM ({SITE_RATES_SQL}) WHERE Reservoir = 'FCR' AND y >= 2018)
SELECT coalesce(s.Reservoir, o.Reservoir) AS Reservoir, CAST(coalesce(s.y, o.y) AS INT) AS "Year", fe AS "FeFlux", mn AS "MnFlux", v AS "AvgDOsat_percent_9"
FROM s FULL JOIN o ON o.Reservoir = s.Reservoir AND o.y = s.y""")
def rates_with_oxygen(t: Tables) -> DataFrame:
    season = X.flux_season(X.cumulative_fluxes(average_fluxes(t)))
    rows = metals(t).where(F.col("Reservoir") == "FCR").groupBy("Reservoir", F.year("DateTime").alias("Year"))
    oxygen = rows.agg(r(F.avg(F.col("SFe_mgL") * 10)).alias("AvgDOsat_percent_9"))
    return X.rates_with_oxygen(season, oxygen)


@query(f"""SELECT Reservoir, "Date", "Year", Depth_m, "TO", 'Total' AS "Type", round(greatest(TMn_mgL, SMn_mgL), 6) AS "Mn_mgL" FROM ({{0}}) UNION ALL
 SELECT Reservoir, "Date", "Year", Depth_m, "TO", 'Soluble', round(least(TMn_mgL, SMn_mgL), 6) FROM ({{0}})""".format(f"""SELECT m.*, CASE WHEN m."Date" >= e."Date" THEN 'Post' WHEN m."Date" < e."Date" THEN 'Pre' END AS "TO"
 FROM ({QC_KEPT_SQL}) m LEFT JOIN ({EVENTS_SQL}) e ON e.Reservoir = m.Reservoir AND e."Year" = m."Year" WHERE m."Year" = 2023 AND MnDiff <> 0 AND Layer = 'Hypolimnion'"""))
def year_metals_long(t: Tables) -> DataFrame:
    rows = C.long_metal(C.year_metals(C.metals_rows(metals(t)), 2023, turnover_events(t)), "Mn")
    return rounded(rows.select("Reservoir", "Date", "Year", "Depth_m", "TO", "Type", "Mn_mgL"), "Mn_mgL")


# --- stratification ------------------------------------------------------------------------------

PROFILES_SQL = f"""SELECT {site_sql('l_suppkey')} AS site_id, CAST(l_shipdate AS DATE) + {SHIFT} AS datetime, CAST(l_linenumber AS DOUBLE) AS depth_m,
 avg(CASE WHEN l_partkey % 37 <> 0 THEN l_quantity / 10 + CASE WHEN month(CAST(l_shipdate AS DATE) + {SHIFT}) BETWEEN 4 AND 10 THEN (8 - l_linenumber) * 2 ELSE 0 END END) AS observation
 FROM lineitem GROUP BY ALL"""
STRAT_SQL = f"""WITH pr AS ({PROFILES_SQL}),
 en AS (SELECT site_id, datetime, arg_min(observation, depth_m) AS tt, arg_max(observation, depth_m) AS tb FROM pr WHERE observation IS NOT NULL GROUP BY ALL),
 fl AS (SELECT site_id, datetime, CASE WHEN {rho_sql('tb')} - {rho_sql('tt')} > 0.1 AND tt > tb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM en),
 cal AS (SELECT site_id, CAST(unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 DAY)) AS DATE) AS datetime FROM pr GROUP BY site_id),
 p AS (SELECT cal.site_id, cal.datetime, fl.v, row_number() OVER (PARTITION BY cal.site_id ORDER BY cal.datetime) AS i FROM cal LEFT JOIN fl ON fl.site_id = cal.site_id AND fl.datetime = cal.datetime),
 q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1 FROM p
  WINDOW a AS (PARTITION BY site_id ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY site_id ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 st AS (SELECT site_id, datetime, year(datetime) AS y, coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1) AS strat FROM q)"""
PERIODS_SQL = f"""{STRAT_SQL},
 k AS (SELECT * FROM st QUALIFY count(*) OVER (PARTITION BY site_id, y) >= 300),
 c AS (SELECT *, CASE WHEN strat IS DISTINCT FROM lag(strat) OVER (PARTITION BY site_id, y ORDER BY datetime) THEN 1 ELSE 0 END AS step FROM k),
 d AS (SELECT *, sum(step) OVER (PARTITION BY site_id, y ORDER BY datetime) AS run FROM c),
 e AS (SELECT site_id, y, run, strat, count(*) AS n, min(datetime) AS s, max(datetime) AS f FROM d GROUP BY ALL),
 pe AS (SELECT CAST(y AS INT) AS "year", CAST(n AS BIGINT) AS length, s AS "start", f AS "end", site_id FROM e WHERE strat = 1
  QUALIFY row_number() OVER (PARTITION BY site_id, y ORDER BY n DESC, run) = 1)"""


def profiles(t: Tables) -> DataFrame:
    warm = F.when(F.month(shifted_day("l_shipdate")).between(4, 10), (8 - F.col("l_linenumber")) * 2).otherwise(0)
    temperature = F.when(F.col("l_partkey") % 37 != 0, F.col("l_quantity") / 10 + warm)
    return t("lineitem").groupBy(
        site("l_suppkey").alias("site_id"), shifted_day("l_shipdate").alias("datetime"), F.col("l_linenumber").cast("double").alias("depth_m")
    ).agg(F.avg(temperature).alias("observation"))


@query(f"{STRAT_SQL} SELECT site_id, datetime, round(strat, 6) AS strat FROM st")
def daily_stratification(t: Tables) -> DataFrame:
    return Z.daily_stratification(profiles(t)).select("site_id", "datetime", r("strat").alias("strat"))


@query(f"{PERIODS_SQL} SELECT * FROM pe")
def stratified_periods(t: Tables) -> DataFrame:
    return Z.stratified_periods(profiles(t))


@query(f"""{PERIODS_SQL}, l AS (SELECT "year", site_id, 'start' AS name, dayofyear("start") AS v FROM pe UNION ALL SELECT "year", site_id, 'end', dayofyear("end") FROM pe)
SELECT "year", name, CAST(max(CASE WHEN site_id = 'FCR' THEN v END) AS INT) AS "FCR", CAST(max(CASE WHEN site_id = 'BVR' THEN v END) AS INT) AS "BVR" FROM l GROUP BY ALL""")
def period_compare(t: Tables) -> DataFrame:
    return Z.period_compare(Z.stratified_periods(profiles(t)))


@query(f"""{STRAT_SQL}, m AS (SELECT site_id AS Reservoir, datetime, CAST(y AS INT) AS "Year" FROM st WHERE strat = 0 AND dayofyear(datetime) > 200),
 a AS (SELECT * FROM m QUALIFY rank() OVER (PARTITION BY Reservoir, "Year" ORDER BY datetime) = 1
  UNION ALL SELECT 'BVR', DATE '2018-10-24', 2018 UNION ALL SELECT 'BVR', DATE '2019-11-02', 2019)
SELECT Reservoir, datetime, "Year", TRY_CAST('2001-' || strftime(datetime, '%m-%d') AS DATE) AS "MDay" FROM a WHERE datetime < DATE '2024-01-01'""")
def turnover_dates(t: Tables) -> DataFrame:
    extra = literal_table(t.spark, S.EXTRA_TURNOVERS, S.TURNOVER_SCHEMA)
    return Z.turnover_dates(Z.mixed_days(Z.daily_stratification(profiles(t))), extra)


BUOYANCY_SQL = f"""WITH pr AS ({PROFILES_SQL}), l AS (SELECT *, lead(depth_m) OVER w AS z2, lead(observation) OVER w AS o2 FROM pr WINDOW w AS (PARTITION BY site_id, datetime ORDER BY depth_m)),
 n AS (SELECT site_id, datetime, 9.81 * ({rho_sql('o2')} - {rho_sql('observation')}) / ({rho_sql('observation')} * (z2 - depth_m)) AS n2 FROM l WHERE z2 IS NOT NULL),
 bf AS (SELECT site_id, datetime, CASE WHEN count(n2) = count(*) THEN round(max(n2), 10) END AS bf FROM n GROUP BY ALL)"""


@query(f"""WITH pr AS ({PROFILES_SQL}) SELECT site_id, datetime, depth_m, lead(depth_m) OVER w AS next_depth_m, round(lead(observation) OVER w, 6) AS next_observation FROM pr
 WINDOW w AS (PARTITION BY site_id, datetime ORDER BY depth_m)""")
def layer_steps(t: Tables) -> DataFrame:
    rows = profile_gradient(profiles(t), ["site_id", "datetime"], "depth_m", ["observation"])
    return rounded(rows.drop("observation"), "next_observation")


@query(f"{BUOYANCY_SQL} SELECT * FROM bf")
def buoyancy_daily(t: Tables) -> DataFrame:
    return rounded(Z.buoyancy_daily(profiles(t)), "bf", digits=10)


@query(f"""{BUOYANCY_SQL} SELECT datetime, max(CASE WHEN site_id = 'FCR' THEN bf END) AS "FCR", max(CASE WHEN site_id = 'BVR' THEN bf END) AS "BVR" FROM bf GROUP BY ALL""")
def buoyancy_by_site(t: Tables) -> DataFrame:
    return Z.by_site(rounded(Z.buoyancy_daily(profiles(t)), "bf", digits=10), ["datetime"], "bf")


# --- sensors -------------------------------------------------------------------------------------

STRING_SQL = f"""SELECT {site_sql('user_id')} AS Reservoir, CAST(50 AS INT) AS Site, ts AS DateTime, 2 + value % 6 AS Depth_m,
 CASE WHEN event_id % 9 <> 0 THEN value % 30 END AS c1, value % 25 AS c2, value % 20 AS c3, value % 12 AS c4 FROM events"""
STRING_COLUMNS = {"ThermistorTemp_C_1": "c1", "ThermistorTemp_C_2": "c2", "ThermistorTemp_C_4": "c3", "RDO_mgL_4": "c4"}
OFFSETS = [
    {"Reservoir": s, "Site": 50, "Position": p, S.OFFSET_BEFORE: p * 0.75 - 0.5, S.OFFSET_AFTER: p * 0.5 + (0.25 if s == "BVR" else 0.0)}
    for s in ("FCR", "BVR")
    for p in (1.0, 2.0, 4.0)
]
OFFSET_SCHEMA = pa.schema(
    [("Reservoir", pa.string()), ("Site", pa.int32()), ("Position", pa.float64()), (S.OFFSET_BEFORE, pa.float64()), (S.OFFSET_AFTER, pa.float64())]
)
OFFSET_SQL = "CASE WHEN DateTime <= TIMESTAMP '2024-01-15' THEN p * 0.75 - 0.5 ELSE p * 0.5 + CASE WHEN Reservoir = 'BVR' THEN 0.25 ELSE 0 END END"


def sensor_string(t: Tables) -> DataFrame:
    v = F.col("value")
    return t("events").select(
        site("user_id").alias("Reservoir"), F.lit(50).alias("Site"), F.col("ts").alias("DateTime"), (2 + v % 6).alias("Depth_m"),
        F.when(F.col("event_id") % 9 != 0, v % 30).alias("ThermistorTemp_C_1"), (v % 25).alias("ThermistorTemp_C_2"),
        (v % 20).alias("ThermistorTemp_C_4"), (v % 12).alias("RDO_mgL_4"),
    )


def offset_table(t: Tables) -> DataFrame:
    return literal_table(t.spark, OFFSETS, OFFSET_SCHEMA)


LONG_STRING_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT Reservoir, Site, DateTime, Depth_m, '{n.split('_')[0]}' AS variable, {float(n.split('_')[2])}::DOUBLE AS p, {c} AS observation FROM s" for n, c in STRING_COLUMNS.items()
) + ") WHERE observation IS NOT NULL"


@query(f"""WITH s AS ({STRING_SQL}), l AS (SELECT *, Depth_m - ({OFFSET_SQL}) AS sd, (SELECT ceil(max(Depth_m)) FROM s) AS top FROM ({LONG_STRING_SQL}))
SELECT Reservoir, Site, DateTime, variable, p AS "Position", round(observation, 6) AS observation, round(sd, 6) AS sensor_depth,
 CASE WHEN sd < 0 OR sd > top THEN NULL WHEN sd = top THEN top - 0.25 ELSE floor(sd / 0.25) * 0.25 END AS depth_bin FROM l""")
def sensor_depths(t: Tables) -> DataFrame:
    out = N.sensor_depths(sensor_string(t), offset_table(t), moved_on="2024-01-15")
    return rounded(
        out.select("Reservoir", "Site", "DateTime", "variable", "Position", "observation", "sensor_depth", "depth_bin"), "observation", "sensor_depth"
    )


@query(f"""WITH s AS ({STRING_SQL}) SELECT Reservoir, Site, DateTime, round(Depth_m, 6) AS Depth_m, {", ".join(
    f"CASE WHEN Depth_m - ({OFFSET_SQL.replace('p *', n.split('_')[2] + ' *')}) >= 0 THEN round({c}, 6) END AS {n}" for n, c in STRING_COLUMNS.items())} FROM s""")
def sensor_depths_wide(t: Tables) -> DataFrame:
    out = N.sensor_depths(sensor_string(t), offset_table(t), moved_on="2024-01-15", wide=True)
    return rounded(out, "Depth_m", *STRING_COLUMNS)


@query(f"""WITH s AS ({STRING_SQL}), bv AS (SELECT *, Depth_m - ({OFFSET_SQL}) AS sd, (SELECT ceil(max(Depth_m)) FROM s WHERE Reservoir = 'BVR') AS top FROM ({LONG_STRING_SQL}) WHERE Reservoir = 'BVR' AND variable = 'ThermistorTemp'),
 bb AS (SELECT DateTime, observation, CASE WHEN sd < 0 OR sd > top THEN NULL WHEN sd = top THEN top - 0.25 ELSE floor(sd / 0.25) * 0.25 END AS z FROM bv),
 fc AS (SELECT DateTime, 1.0::DOUBLE AS z, c1 AS o FROM s WHERE Reservoir = 'FCR' UNION ALL SELECT DateTime, 2.0, c2 FROM s WHERE Reservoir = 'FCR' UNION ALL SELECT DateTime, 4.0, c3 FROM s WHERE Reservoir = 'FCR')
SELECT CAST(DateTime AS DATE) AS datetime, 'BVR' AS site_id, z AS depth_m, CASE WHEN count(*) >= 8 THEN round(avg(observation), 6) END AS observation, 'Temp_C_mean' AS variable FROM bb WHERE z IS NOT NULL GROUP BY ALL
UNION ALL SELECT CAST(DateTime AS DATE), 'FCR', z, CASE WHEN count(*) >= 3 THEN round(avg(o), 6) END, 'Temp_C_mean' FROM fc GROUP BY ALL
UNION ALL SELECT CAST(DateTime AS DATE) + 30, 'FCR', z, CASE WHEN count(*) >= 160 THEN round(avg(o), 6) END, 'Temp_C_mean' FROM fc WHERE o IS NOT NULL GROUP BY ALL""")
def temperature_profiles(t: Tables) -> DataFrame:
    historic = sensor_string(t)
    current = historic.withColumn("DateTime", F.col("DateTime") + F.expr("INTERVAL 30 DAYS"))
    out = N.temperature_profiles(
        historic,
        current,
        offset_table(t),
        {"FCR": N.ProfileRule(False, 3, True), "BVR": N.ProfileRule(True, 8)},
        {"FCR": N.ProfileRule(False, 160)},
        moved_on="2024-01-15",
    )
    return rounded(out, "observation")


SLOT = "time_bucket(INTERVAL 10 MINUTE, ts)"
WIDE_SQL = f"""SELECT {SLOT} AS datetime, {site_sql('user_id')} AS site_id, avg(value) FILTER (event_type = 'view') AS t, avg(value) FILTER (event_type = 'click') AS c,
 avg(value) FILTER (event_type = 'error') AS o, avg(value) FILTER (event_type = 'signup') AS b, avg(value) FILTER (event_type = 'purchase') AS s, avg(user_id) AS h, CAST(count(*) % 4 AS INT) AS f1, CAST(max(event_id) % 11 AS INT) AS f2, CAST(max(event_id) % 3 AS INT) AS f3 FROM events GROUP BY ALL"""
TARGETS_SQL = f"""WITH w AS ({WIDE_SQL}),
 a AS (SELECT datetime, site_id, CASE site_id WHEN 'FCR' THEN 1.6 ELSE 1.5 END::DOUBLE AS z, 'Temp_C' AS k, t AS v FROM w WHERE f1 NOT IN (9, 7, 2, 1, 5, 3)
  UNION ALL SELECT datetime, site_id, CASE site_id WHEN 'FCR' THEN 1.6 ELSE 1.5 END, 'Chla_ugL', c FROM w WHERE f2 NOT IN (9, 7, 2, 1, 5, 3)
  UNION ALL SELECT datetime, site_id, CASE site_id WHEN 'FCR' THEN 1.6 ELSE 1.5 END, 'SpCond_uScm', s FROM w WHERE f1 NOT IN (9, 7, 2, 1, 5, 3)
  UNION ALL SELECT datetime, site_id, CASE site_id WHEN 'FCR' THEN 1.6 ELSE 1.5 END, 'fDOM_QSU', h FROM w WHERE f2 NOT IN (9, 7, 2, 1, 5, 3)
  UNION ALL SELECT datetime, site_id, 9, 'DO_mgL', o FROM w UNION ALL SELECT datetime, site_id, 9, 'Temp_C', b FROM w WHERE f3 = 0),
 o AS (SELECT * FROM a WHERE v IS NOT NULL),
 sp AS (SELECT site_id, z, k, unnest(generate_series(min(datetime), max(datetime), INTERVAL 10 MINUTE)) AS datetime FROM o GROUP BY site_id, z, k),
 p AS (SELECT sp.*, o.v, row_number() OVER (PARTITION BY sp.site_id, sp.z, sp.k ORDER BY sp.datetime) AS i FROM sp LEFT JOIN o ON o.site_id = sp.site_id AND o.z = sp.z AND o.k = sp.k AND o.datetime = sp.datetime),
 q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1 FROM p
  WINDOW a AS (PARTITION BY site_id, z, k ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY site_id, z, k ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""{TARGETS_SQL} SELECT datetime, site_id, z AS depth_m, k AS variable,
 CASE WHEN v IS NOT NULL THEN round(v, 6) WHEN i1 - i0 - 1 <= 12 THEN round(v0 + (v1 - v0) * (i - i0) / (i1 - i0), 6) END AS observation FROM q""")
def sensor_targets(t: Tables) -> DataFrame:
    slot = F.window("ts", "10 minutes")["start"]
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    wide = t("events").groupBy(slot.alias("DateTime"), site("user_id").alias("Reservoir")).agg(
        mean("view").alias("EXOTemp_C_1"), mean("click").alias("EXOChla_ugL_1"), mean("error").alias("RDO_mgL_9_adjusted"),
        mean("purchase").alias("EXOSpCond_uScm_1"), F.avg("user_id").alias("EXOfDOM_QSU_1"),
        (F.count(F.lit(1)) % 4).cast("int").alias("Flag_EXOSpCond_uScm_1"), (F.max("event_id") % 11).cast("int").alias("Flag_EXOfDOM_QSU_1"),
        mean("signup").alias("ThermistorTemp_C_9"), F.lit(1.0).alias("ThermistorTemp_C_surface"),
        (F.count(F.lit(1)) % 4).cast("int").alias("Flag_EXOTemp_C_1"), (F.max("event_id") % 11).cast("int").alias("Flag_EXOChla_ugL_1"),
        (F.max("event_id") % 3).cast("int").alias("Flag_ThermistorTemp_C_9"), F.lit(50).alias("Site"),
    )
    return rounded(N.sensor_targets(wide), "observation")


SAMPLE_SQL = f"""SELECT {site_sql('l_suppkey')} AS site_id, CAST(l_shipdate AS DATE) AS datetime, CAST(l_linenumber AS DOUBLE) AS depth_m, CASE WHEN l_orderkey % 53 <> 0 THEN l_partkey % 2 END AS rep,
 l_extendedprice / 1000 AS a, CASE WHEN l_tax > 0 THEN l_tax END AS b, CAST(l_quantity % 6 AS INT) AS fa, CASE WHEN l_discount > 0 THEN CAST(l_orderkey % 10 AS INT) END AS fb FROM lineitem"""


@query(f"""WITH s AS ({SAMPLE_SQL}), o AS (SELECT site_id, datetime, depth_m, rep, 'TFe_mgL' AS variable, a AS v FROM s UNION ALL SELECT site_id, datetime, depth_m, rep, 'TMn_mgL', b FROM s),
 f AS (SELECT site_id, datetime, depth_m, 'TFe_mgL' AS variable, fa AS f FROM s UNION ALL SELECT site_id, datetime, depth_m, 'TMn_mgL', fb FROM s)
SELECT site_id, datetime, depth_m, variable, round(avg(v), 6) AS observation, 'sample' AS method FROM o JOIN f USING (site_id, datetime, depth_m, variable)
WHERE v IS NOT NULL AND rep IS NOT NULL AND f NOT IN (9, 5, 2) GROUP BY ALL""")
def sample_targets(t: Tables) -> DataFrame:
    return rounded(N.sample_targets(sample_rows(t)), "observation")


def sample_rows(t: Tables) -> DataFrame:
    return t("lineitem").select(
        site("l_suppkey").alias("Reservoir"), F.lit(50).alias("Site"), F.to_date("l_shipdate").alias("DateTime"),
        F.col("l_linenumber").cast("double").alias("Depth_m"), F.when(F.col("l_orderkey") % 53 != 0, F.col("l_partkey") % 2).alias("Rep"),
        (F.col("l_extendedprice") / 1000).alias("TFe_mgL"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("TMn_mgL"),
        (F.col("l_quantity") % 6).cast("int").alias("Flag_TFe_mgL"),
        F.when(F.col("l_discount") > 0, (F.col("l_orderkey") % 10).cast("int")).alias("Flag_TMn_mgL"),
    )


@query(f"""SELECT site_id, datetime, depth_m, variable, round(avg(v), 6) AS observation, 'sample' AS method FROM (
 SELECT site_id, datetime, depth_m, 'TFe_mgL' AS variable, a AS v, fa AS f FROM ({SAMPLE_SQL}) UNION ALL SELECT site_id, datetime, depth_m, 'TMn_mgL', b, fb FROM ({SAMPLE_SQL}))
WHERE v IS NOT NULL AND f NOT IN (9, 5, 2) GROUP BY ALL""")
def sample_targets_own_flag(t: Tables) -> DataFrame:
    return rounded(N.sample_targets(sample_rows(t), match_rep=True), "observation")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS "DateTime",
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS variable FROM orders""")
def csv_round_trip(t: Tables) -> DataFrame:
    """Written as delimited text and read back with types taken from the names and a given schema."""
    rows = t("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.col("o_orderdate").cast("timestamp").alias("DateTime"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("variable"),
    )
    path = f"{ensure_checkpoint_dir(t.spark)}/orders-{uuid.uuid4().hex}.csv"
    write_table(rows, path)
    back = read_table(t.spark, path, rows.schema)
    return back.withColumn("DateTime", F.col("DateTime").cast("timestamp_ntz"))


def scratch(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}.csv"


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 2 = 0 AS even FROM orders")
def read_many_files(t: Tables) -> DataFrame:
    """Two delimited files with the same columns in another order, appended by name (A3, A4)."""
    even = F.col("o_orderkey") % 2 == 0
    a, b = scratch(t, "even"), scratch(t, "odd")
    write_table(t("orders").where(even).select("o_orderkey", "o_custkey", "o_totalprice"), a)
    write_table(t("orders").where(~even).select("o_totalprice", "o_custkey", "o_orderkey"), b)
    rows = IO.read_many(t.spark, [a, b])
    return rows.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_totalprice", F.col("source_file").contains("even-").alias("even")
    )


@query(f"""SELECT Reservoir, HOxOn, HOxOff FROM ({INTERVALS_SQL})""")
def control_intervals(t: Tables) -> DataFrame:
    """Treatment intervals through their control file (A2)."""
    path = scratch(t, "intervals")
    write_table(intervals(t).select("HOxOff", "Reservoir", "HOxOn", F.col("price").alias("unused")), path)
    return IO.read_intervals(t.spark, path)


@query(f"""SELECT Reservoir, "Date", 'Turnover' AS "Event", CAST("Year" - 2017 AS INT) AS "ID" FROM ({EVENTS_SQL})""")
def control_events(t: Tables) -> DataFrame:
    """Dated events through their control file (A2)."""
    path = scratch(t, "events")
    write_table(turnover_events(t).withColumns({"Event": F.lit("Turnover"), "ID": F.col("Year") - 2017}), path)
    return IO.read_events(t.spark, path)


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, NULL, o_totalprice FROM orders""")
def current_appended(t: Tables) -> DataFrame:
    """A historic path and a current table without one of its columns (A3, A5), in the historic order."""
    path = scratch(t, "historic").removesuffix(".csv") + ".parquet"
    historic = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_table(historic, path)
    current = t("orders").select("o_totalprice", (-F.col("o_orderkey")).alias("o_orderkey"))
    return P.select_like(IO.with_current(IO.as_df(t.spark, path), current), historic)


# --- casts, oxygen, weather ----------------------------------------------------------------------

CTD_SQL = f"""SELECT {site_sql('l_suppkey')} AS Reservoir, CAST(50 AS INT) AS Site, l_shipdate + to_days(CAST({SHIFT} - (CAST(l_shipdate AS DATE) - DATE '1970-01-01') % 5 AS INT)) AS DateTime, CAST(l_linenumber - 1 AS DOUBLE) AS Depth_m,
 l_quantity AS Temp_C, CASE WHEN l_discount > 0.01 THEN l_discount * 100 END AS DO_mgL FROM lineitem"""
HAND_SQL = f"""SELECT {site_sql('o_custkey')} AS Reservoir, CAST(50 AS INT) AS Site, o_orderdate + INTERVAL {SHIFT} DAY AS DateTime, CAST(o_orderkey % 5 AS DOUBLE) AS Depth_m,
 o_totalprice / 20000 AS Temp_C, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice / 40000 END AS DO_mgL FROM orders"""
MERGED_SQL = f"""WITH c AS (SELECT *, CAST(DateTime AS DATE) AS d FROM ({CTD_SQL}) WHERE DateTime > TIMESTAMP '2018-01-01' AND DateTime < TIMESTAMP '2023-12-31' AND Depth_m > 0),
 h AS (SELECT *, CAST(DateTime AS DATE) AS d FROM ({HAND_SQL}) WHERE DateTime >= TIMESTAMP '2018-01-01' AND DateTime <= TIMESTAMP '2023-12-31'),
 m AS (SELECT * FROM c UNION ALL SELECT * REPLACE (CASE WHEN d = DATE '2020-02-29' THEN DATE '2020-02-28' ELSE d END AS d) FROM h WHERE d NOT IN (SELECT d FROM c)),
 k AS (SELECT Reservoir, Site, DateTime, Depth_m, Temp_C, DO_mgL, d AS "Date", CAST(year(DateTime) AS INT) AS "Year" FROM m WHERE Temp_C IS NOT NULL AND DO_mgL IS NOT NULL)"""


def merged(t: Tables) -> DataFrame:
    # profiles lie on every fifth day, so the others are left to the handheld
    every_fifth = shifted("l_shipdate") - F.make_dt_interval(days=F.unix_date(F.to_date("l_shipdate")) % 5)
    ctd = t("lineitem").select(
        site("l_suppkey").alias("Reservoir"), F.lit(50).alias("Site"), every_fifth.alias("DateTime"),
        (F.col("l_linenumber") - 1).cast("double").alias("Depth_m"), F.col("l_quantity").alias("Temp_C"),
        F.when(F.col("l_discount") > 0.01, F.col("l_discount") * 100).alias("DO_mgL"),
    )
    hand = t("orders").select(
        site("o_custkey").alias("Reservoir"), F.lit(50).alias("Site"), shifted("o_orderdate").alias("DateTime"),
        (F.col("o_orderkey") % 5).cast("double").alias("Depth_m"), (F.col("o_totalprice") / 20000).alias("Temp_C"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / 40000).alias("DO_mgL"),
    )
    return W.merge_casts(W.profile_casts(ctd), W.handheld_casts(hand), ["Temp_C", "DO_mgL"])


@query(f"""{MERGED_SQL} SELECT * REPLACE (round(Temp_C, 6) AS Temp_C, round(DO_mgL, 6) AS DO_mgL) FROM k""")
def merge_casts(t: Tables) -> DataFrame:
    return rounded(merged(t), "Temp_C", "DO_mgL")


@query(f"""{MERGED_SQL} SELECT Reservoir, "Date", min(DateTime) AS DateTime, arg_min("Year", DateTime) AS "Year", TRY_CAST('2001-' || strftime("Date", '%m-%d') AS DATE) AS "MDay" FROM k GROUP BY ALL""")
def cast_days(t: Tables) -> DataFrame:
    return W.cast_days(merged(t))


@query(f"""{MERGED_SQL}, u AS (SELECT Reservoir, "Year" AS yr, CAST(DateTime AS DATE) AS x, Depth_m AS d, 'Temp_C' AS var, Temp_C AS v FROM k UNION ALL SELECT Reservoir, "Year", CAST(DateTime AS DATE), Depth_m, 'DO_mgL', DO_mgL FROM k),
p AS (SELECT Reservoir, yr, var, x, d, avg(v) AS v FROM u GROUP BY ALL),
fr AS (SELECT Reservoir, yr, var, min(d) AS d0, max(d) AS d1 FROM p GROUP BY ALL),
lv AS (SELECT Reservoir, yr, var, d0, unnest(generate_series(0, CAST(floor((d1 - d0) / 0.5 + 1e-10) AS BIGINT))) AS j FROM fr),
sg AS (SELECT *, lead(d) OVER w AS d2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY Reservoir, yr, var, x ORDER BY d)),
z1 AS (SELECT s.Reservoir, s.yr, s.var, s.x, j, d0, CASE WHEN d2 IS NULL THEN v ELSE v + (v2 - v) * (d0 + j * 0.5 - d) / (d2 - d) END AS z
 FROM sg s JOIN lv USING (Reservoir, yr, var) WHERE d0 + j * 0.5 >= d AND (d0 + j * 0.5 < d2 OR (d2 IS NULL AND d0 + j * 0.5 <= d))),
nx AS (SELECT *, lead(x) OVER w AS x2, lead(z) OVER w AS z2 FROM z1 WINDOW w AS (PARTITION BY Reservoir, yr, var, j ORDER BY x)),
dy AS (SELECT *, CAST(unnest(generate_series(x, CASE WHEN x2 IS NULL THEN x ELSE x2 - 1 END, INTERVAL 1 DAY)) AS DATE) AS q FROM nx),
g AS (SELECT Reservoir, CAST(yr AS INT) AS "Year", var AS variable, q AS x, d0 + j * 0.5 AS y, CASE WHEN x2 IS NULL THEN z ELSE z + (z2 - z) * CAST(q - x AS DOUBLE) / CAST(x2 - x AS DOUBLE) END AS z FROM dy)
SELECT Reservoir, "Year", variable, x, y, round(z, 6) AS z, TRY_CAST('2001-' || strftime(x, '%m-%d') AS DATE) AS "MDay",
 CASE WHEN z BETWEEN -1 AND CASE variable WHEN 'Temp_C' THEN 30 ELSE 16 END THEN round(z, 6) END AS z_shown FROM g WHERE y > 0.1""")
def heatmap_grid(t: Tables) -> DataFrame:
    return rounded(W.heatmap_grid(merged(t), ["Temp_C", "DO_mgL"]), "z", "z_shown")


LOGGERS = (("view", "FCR", "9"), ("click", "BVR", "13"), ("error", "BVR", "10"), ("purchase", "FCR", "1.6"), ("signup", "BVR", "1.5"))


@query(" UNION ALL ".join(
    f"""SELECT '{s}' AS Reservoir, CAST(user_id % 3 AS INT) AS Site, CAST(ts AS DATE) AS "Date", CAST(2024 AS INT) AS "Year", '{z}' AS Depth_m, round(avg(value), 6) AS "DO_mgL", 'logger' AS "Method"
 FROM events WHERE event_type = '{k}' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-29' GROUP BY ALL""" for k, s, z in LOGGERS)
 + """ UNION ALL SELECT 'BVR', 50, DATE '2020-01-01', 2020, '10', NULL, 'edi.725.5' UNION ALL SELECT 'BVR', 50, DATE '2020-05-15', 2020, '10', NULL, 'edi.198.13'""")
def oxygen_daily(t: Tables) -> DataFrame:
    def logger(kind: str, name: str) -> DataFrame:
        return t("events").where(F.col("event_type") == kind).select(
            F.lit(name).alias("Reservoir"), (F.col("user_id") % 3).cast("int").alias("Site"), F.col("ts").alias("DateTime"), "value"
        )

    sources = [W.OxygenSource(logger(k, s), "value", z, "logger", "2024-01-03") for k, s, z in LOGGERS]
    breaks = literal_table(t.spark, S.OXYGEN_BREAKS, S.BREAKS_SCHEMA)
    return rounded(W.oxygen_daily(sources, breaks, until="2024-01-28"), "DO_mgL")


@query(f"""WITH h AS ({METALS_SQL.replace('l_linenumber + 2', 'l_linenumber + 3')}), d AS (SELECT *, CAST(DateTime AS DATE) AS x FROM h)
SELECT Reservoir, Site, x AS "Date", CAST(year(x) AS INT) AS "Year", CAST(CAST(Depth_m AS INT) AS VARCHAR) AS Depth_m, SFe_mgL AS "DO_mgL", 'edi.198.13' AS "Method" FROM d
WHERE (Reservoir = 'BVR' AND Depth_m = 10 AND x BETWEEN DATE '2018-05-04' AND DATE '2018-12-05') OR (Reservoir = 'BVR' AND Depth_m = 10 AND x BETWEEN DATE '2019-05-18' AND DATE '2020-03-14')
 OR (Reservoir = 'FCR' AND Depth_m = 9 AND x < DATE '2018-08-19')""")
def oxygen_handheld(t: Tables) -> DataFrame:
    rows = metals(t).withColumns({"Depth_m": F.col("Depth_m") + 1, "DO_mgL": F.col("SFe_mgL")})
    return W.oxygen_handheld(rows)


WEATHER_SQL = """SELECT CAST(ts AS DATE) AS "Date", avg(value % 40) AS air, avg(value % 9) AS wind, CASE WHEN count(rain) = count(*) THEN sum(rain) / 10 END AS rain
 FROM (SELECT *, CASE WHEN event_id % 997 <> 0 THEN value % 3 END AS rain FROM events) GROUP BY ALL"""


def weather(t: Tables) -> DataFrame:
    v = F.col("value")
    rows = t("events").select(
        F.col("ts").alias("DateTime"), (v % 40).alias("AirTemp_C_Average"), F.when(F.col("event_id") % 997 != 0, v % 3).alias("Rain_Total_mm"),
        (v % 9).alias("WindSpeed_Average_m_s"),
    )
    return W.weather_daily(rows, "2024-01-01", "2025-01-01")


@query(f"""SELECT "Date", CAST(dayofyear("Date") AS INT) AS "DOY", CAST(year("Date") AS INT) AS "Year", DATE '1970-01-01' + CAST(dayofyear("Date") - 1 AS INT) AS ddate, variable, round(obs, 6) AS obs
FROM (SELECT "Date", 'AirTemp_C_Average' AS variable, air AS obs FROM ({WEATHER_SQL}) UNION ALL SELECT "Date", 'WindSpeed_Average_m_s', wind FROM ({WEATHER_SQL}) UNION ALL SELECT "Date", 'Rain_Total_sum_cm', rain FROM ({WEATHER_SQL}))""")
def weather_daily(t: Tables) -> DataFrame:
    return rounded(W.weather_long(weather(t)), "obs")


@query(f"""WITH v AS (SELECT *, CAST(ts AS DATE) AS day FROM ({MISSING.format(13)}) WHERE value IS NOT NULL),
 d AS (SELECT site, event_type, day, count(*) AS n, avg(value) AS m FROM v GROUP BY ALL)
SELECT site, event_type, day, CASE WHEN n >= 30 THEN round(m, 6) END AS value FROM d""")
def daily_mean_stream(t: Tables) -> DataFrame:
    """Gated daily mean as a stream over the events file, open days included."""
    base = ensure_checkpoint_dir(t.spark)
    schema = t("events").schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    columns = (
        "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 2).cast("int").alias("site"),
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"),
    )
    rows = source.select(*columns)
    out = f"{base}/stream-{uuid.uuid4().hex}"
    run_updates(stream_op(rows, ["site", "event_type"], "ts", "value", "2 hours", 30, "day"), f"{out}/rows", f"{out}/state")
    daily = current_rows(t.spark, f"{out}/rows", "site int, event_type string, day date, value double", ["site", "event_type", "day"])
    return rounded(daily, "value")
