"""Ordered operators, gap filling, statistics and physics on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import depth_bin, water_density
from ..operators import aggregate as A
from ..operators import fill as G
from ..operators import runs as N
from ..operators import scan as O
from ..operators import stats as T
from ..operators.grid import grid_interpolate as grid_op
from .base import Tables, query, r, rounded


@query("""
WITH o AS (SELECT year(o_orderdate) AS y, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 5000 <> 4999 THEN o_totalprice END AS x FROM orders)
SELECT o_orderkey,
 CASE WHEN count(*) OVER w = count(x) OVER w THEN round(sum(x) OVER w, 2) END AS total,
 CAST(count(*) OVER w AS BIGINT) AS n
FROM o WINDOW w AS (PARTITION BY y ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def cumulate(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5000 != 4999, F.col("o_totalprice"))
    rows = t("orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), price.alias("x"))
    out = O.running_sums(rows, ["y"], ["o_orderdate", "o_orderkey"], {"total": F.col("x"), "n": F.lit(1).cast("long")})
    return rounded(out.select("o_orderkey", "total", "n"), "total", digits=2)


@query("""
WITH li AS (SELECT n_name, CAST(year(l_shipdate) AS INT) AS y, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity AS days, l_extendedprice / 1000 AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT *, sum(x * days) OVER w AS cum FROM li
 WINDOW w AS (PARTITION BY n_name, y ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
SELECT n_name, y, round(max(cum), 3) AS cum, sum(days) AS days, max(d) AS d, round(max(cum) / sum(days), 3) AS rate FROM c GROUP BY ALL
""")
def season_summary(t: Tables) -> DataFrame:
    li = t("lineitem").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    li = li.join(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    rows = li.select(
        "n_name", F.year("l_shipdate").alias("y"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_partkey",
        "l_suppkey", F.col("l_quantity").alias("days"), (F.col("l_extendedprice") / 1000).alias("x"),
    )
    order = ["d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = O.running_sums(rows, ["n_name", "y"], order, {"cum": F.col("x") * F.col("days")})
    out = A.season_summary(rows, ["n_name", "y"], "d", "days", {"cum": "rate"}, digits=3)
    return rounded(out, "cum", digits=3)


DAILY_SQL = """SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderdate AS DATE) AS d,
 CAST(CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= count(*) FILTER (o_orderstatus = 'O') THEN 1 ELSE 0 END AS INT) AS state
 FROM orders GROUP BY ALL"""
RUNS_SQL = f"""WITH a AS ({DAILY_SQL}),
 b AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY y ORDER BY d) OR row_number() OVER (PARTITION BY y ORDER BY d) = 1 THEN 1 ELSE 0 END AS step FROM a),
 c AS (SELECT *, sum(step) OVER (PARTITION BY y ORDER BY d) AS run FROM b),
 e AS (SELECT y, CAST(run AS BIGINT) AS run_id, state, CAST(count(*) AS BIGINT) AS length, min(d) AS "start", max(d) AS "end" FROM c GROUP BY ALL)"""


def daily_state(t: Tables) -> DataFrame:
    """One row per day, so the series below are bounded by the calendar."""
    fin, open_ = (F.count(F.when(F.col("o_orderstatus") == s, F.lit(1))) for s in ("F", "O"))
    return t("orders").groupBy(F.year("o_orderdate").alias("y"), F.to_date("o_orderdate").alias("d")).agg(
        F.when(fin >= open_, F.lit(1)).otherwise(F.lit(0)).alias("state")
    )


@query(f"{RUNS_SQL} SELECT * FROM e")
def rle_runs(t: Tables) -> DataFrame:
    return N.runs(daily_state(t), ["y"], ["d"], "state", bounded=True)


@query(f"""{RUNS_SQL} SELECT y, length, "start", "end" FROM e WHERE state = 1 AND y IN (SELECT y FROM a GROUP BY y HAVING count(*) >= 300)
 QUALIFY row_number() OVER (PARTITION BY y ORDER BY length DESC, run_id) = 1""")
def longest_run(t: Tables) -> DataFrame:
    rows = A.having_rows(daily_state(t), ["y"], 300, bounded=True)
    return N.longest_run(N.runs(rows, ["y"], ["d"], "state", bounded=True), ["y"], "state", 1)


HOURLY_SQL = "SELECT user_id, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL"
FILLED_SQL = f"""WITH o AS ({HOURLY_SQL}),
 sp AS (SELECT user_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM o GROUP BY user_id),
 f AS (SELECT sp.user_id, sp.h, o.v FROM sp LEFT JOIN o ON o.user_id = sp.user_id AND o.h = sp.h)"""
BRACKET_SQL = f"""{FILLED_SQL},
 p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h) AS i FROM f),
 q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1 FROM p
  WINDOW a AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def hourly(t: Tables) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return t("events").groupBy("user_id", hour.alias("h")).agg(F.avg("value").alias("v"))


def hourly_filled(t: Tables) -> DataFrame:
    return G.fill_gaps(hourly(t), ["user_id"], "h", 3600)


@query(f"{FILLED_SQL} SELECT user_id, h, round(v, 6) AS v FROM f")
def fill_gaps_hourly(t: Tables) -> DataFrame:
    return rounded(hourly_filled(t), "v")


@query(f"""{FILLED_SQL}, g AS (SELECT *, v IS NULL AS m, CASE WHEN (v IS NULL) IS DISTINCT FROM lag(v IS NULL) OVER (PARTITION BY user_id ORDER BY h) THEN 1 ELSE 0 END AS s FROM f),
 k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY h) AS run FROM g),
 e AS (SELECT user_id, run, m, count(*) AS n FROM k GROUP BY ALL)
SELECT user_id, CAST(coalesce(max(CASE WHEN m THEN n END), 0) AS BIGINT) AS longest_null_run,
 CAST(count(CASE WHEN NOT m THEN 1 END) AS BIGINT) AS observed_runs FROM e GROUP BY ALL""")
def null_run_stats(t: Tables) -> DataFrame:
    # a filled series has one row per hour, so a month bounds a chunk and nothing needs to be counted
    return N.null_run_stats(hourly_filled(t), ["user_id"], ["h"], "v", chunk=F.trunc(F.col("h").cast("date"), "month"))


@query(f"""{BRACKET_SQL} SELECT user_id, h,
 CASE WHEN v IS NOT NULL THEN round(v, 6) WHEN i1 - i0 - 1 <= 12 THEN round(v0 + (v1 - v0) * (i - i0) / (i1 - i0), 6) END AS v FROM q""")
def interpolate_maxgap(t: Tables) -> DataFrame:
    return rounded(G.fill_gaps(hourly(t), ["user_id"], "h", 3600, interpolated="v", maxgap=12), "v")


EDGE_SQL = """WITH cal AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d, s FROM
  (SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders) GROUP BY s),
 x AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, avg(CASE WHEN o_totalprice > 200000 THEN o_totalprice END) AS v FROM orders GROUP BY ALL),
 p AS (SELECT cal.s, cal.d, x.v, row_number() OVER (PARTITION BY cal.s ORDER BY cal.d) AS i FROM cal LEFT JOIN x ON x.s = cal.s AND x.d = cal.d)"""


@query("""WITH x AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL),
 c AS (SELECT s, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM x GROUP BY s)
SELECT c.s, c.d, CAST(x.n AS BIGINT) AS n FROM c LEFT JOIN x ON x.s = c.s AND x.d = c.d""")
def densify_daily(t: Tables) -> DataFrame:
    rows = t("orders").groupBy(F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return G.densify_daily(rows, ["s"], "d")


@query(f"""{EDGE_SQL}, q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1 FROM p
  WINDOW a AS (PARTITION BY s ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY s ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT s, d, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1), 4) AS v FROM q""")
def interpolate_edges(t: Tables) -> DataFrame:
    high = F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))
    daily = t("orders").groupBy(F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d")).agg(F.avg(high).alias("v"))
    return rounded(G.densify_daily(daily, ["s"], "d", interpolated="v", edges="nearest", bounded=True), "v", digits=4)


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS v FROM orders),
 p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM x),
 q AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1 FROM p
  WINDOW a AS (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT o_orderkey, round(CASE WHEN v IS NOT NULL THEN v WHEN i1 - i0 - 1 <= 2 THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 4) AS v FROM q""")
def interpolate_rows(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", value.alias("v"))
    out = G.interpolate(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "v", maxgap=2)
    return rounded(out.select("o_orderkey", "v"), "v", digits=4)


# --- physics and bins ----------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN x < 0 OR x > m THEN NULL WHEN x = m THEN m - 0.25 ELSE floor(x / 0.25) * 0.25 END AS bin
FROM (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN -value ELSE value END AS x, (SELECT ceil(max(value)) FROM events) AS m FROM events)
""")
def depth_bins(t: Tables) -> DataFrame:
    e = t("events")
    top = e.agg(F.ceil(F.max("value")).cast("double")).scalar()
    x = F.when(F.col("event_id") % 101 == 0, -F.col("value")).otherwise(F.col("value"))
    return e.select("event_id", depth_bin(x, 0.25, top).alias("bin"))


def rho_sql(x: str) -> str:
    return f"(1000 * (1 - ({x} + 288.9414) * ({x} - 3.9863) * ({x} - 3.9863) / (508929.2 * ({x} + 68.12963))))"


@query(f"SELECT event_id, round({rho_sql('(value % 30)')}, 6) AS rho FROM events")
def density_profile(t: Tables) -> DataFrame:
    return t("events").select("event_id", r(water_density(F.col("value") % 30)).alias("rho"))


# --- statistics ----------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept
FROM lineitem GROUP BY ALL
""")
def linear_fit(t: Tables) -> DataFrame:
    out = T.linear_fit(t("lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag", "l_linestatus"])
    return rounded(out, "slope", "intercept")


# exact two-sided p from the finite series, term by term, for any integer number of degrees of freedom
P_SQL = """CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * coalesce((SELECT sum(exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2) + (2 * j + 1) * ln(cos(th))))
   FROM (SELECT unnest(generate_series(0, (df - 3) // 2)) AS j)), 0))
 ELSE 1 - sin(th) * (SELECT sum(exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1) + 2 * j * ln(cos(th)))) FROM (SELECT unnest(generate_series(0, (df - 2) // 2)) AS j)) END"""

FIT_SQL = """SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) AS s FROM (
 SELECT {keys}, count(*) AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, avg({x}) AS mx,
 regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a FROM {table} WHERE {y} IS NOT NULL AND {x} IS NOT NULL GROUP BY {keys}) WHERE n > 2"""


@query(f"""
WITH f AS ({FIT_SQL.format(keys="l_suppkey", y="l_discount", x="l_quantity", table="lineitem")}),
g AS (SELECT *, n - 2 AS df, b / (s / sqrt(sxx)) AS t, a / (s * sqrt(1.0 / n + mx * mx / sxx)) AS ta FROM f),
h AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM g)
SELECT l_suppkey, CAST(n AS BIGINT) AS n, CAST(df AS INT) AS df, round(b, 8) AS slope, round(a, 8) AS intercept,
 round(sxy * sxy / (sxx * syy), 6) AS r_squared, round(s, 6) AS residual_error, round(t, 4) AS slope_t,
 round(ta, 4) AS intercept_t, round(t * t, 3) AS f_statistic, round({P_SQL}, 5) AS slope_p
FROM h
""")
def linear_fit_summary(t: Tables) -> DataFrame:
    out = T.linear_fit(t("lineitem"), "l_discount", "l_quantity", ["l_suppkey"], summary=True).where(F.col("n") > 2)
    return out.select(
        "l_suppkey", "n", "df", r("slope", 8).alias("slope"), r("intercept", 8).alias("intercept"),
        r("r_squared").alias("r_squared"), r("residual_error").alias("residual_error"), r("slope_t", 4).alias("slope_t"),
        r("intercept_t", 4).alias("intercept_t"), r("f_statistic", 3).alias("f_statistic"), r("slope_p", 5).alias("slope_p"),
    )


@query(f"""
WITH f AS ({FIT_SQL.format(keys="l_linenumber", y="l_discount", x="l_quantity", table="lineitem")}),
m AS (SELECT l_linenumber, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL),
g AS (SELECT l_linenumber, unnest(generate_series(0, 79)) AS i FROM f),
p AS (SELECT f.*, lo + (hi - lo) * i / 79 AS px FROM g JOIN f USING (l_linenumber) JOIN m USING (l_linenumber))
SELECT l_linenumber, round(px, 6) AS x, round(a + b * px, 6) AS fit,
 round(a + b * px - 1.96 * s * sqrt(1.0 / n + (px - mx) * (px - mx) / sxx), 6) AS low,
 round(a + b * px + 1.96 * s * sqrt(1.0 / n + (px - mx) * (px - mx) / sxx), 6) AS high
FROM p
""")
def fit_line(t: Tables) -> DataFrame:
    out = T.fit_line(t("lineitem"), "l_discount", "l_quantity", ["l_linenumber"], quantile=1.96)
    return rounded(out, "x", "fit", "low", "high")


@query(f"""
WITH y AS (SELECT year(o_orderdate) AS y, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS d1,
  avg(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS d2 FROM orders GROUP BY ALL),
l AS (SELECT 'price' AS measure, d1 AS d FROM y UNION ALL SELECT 'cust', d2 FROM y),
a AS (SELECT measure, count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(d) - 1 AS df FROM l GROUP BY ALL),
h AS (SELECT *, m * sqrt(n) / sd AS t, atan(abs(m * sqrt(n) / sd) / sqrt(df)) AS th FROM a)
SELECT measure, CAST(n AS BIGINT) AS pairs, CAST(df AS INT) AS df, round(m, 4) AS mean_difference, round(t, 5) AS t, round({P_SQL}, 6) AS p FROM h
""")
def paired_t(t: Tables) -> DataFrame:
    rows = t("orders").select(
        F.year("o_orderdate").alias("y"), "o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust")
    )
    out = T.paired_t(rows, "y", "o_orderstatus", "F", "O", ["price", "cust"])
    return out.select(
        "measure", "pairs", "df", r("mean_difference", 4).alias("mean_difference"), r("t", 5).alias("t"), r("p").alias("p")
    )


@query(f"""
WITH s AS (SELECT event_type AS k, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL),
b AS (SELECT *, 0.9 * CASE WHEN q3 > q1 THEN least(sd, (q3 - q1) / 1.34) ELSE sd END * pow(n, -0.2) AS h, (hi - lo) / 127 AS step FROM s),
x AS (SELECT b.k, least(floor((value - lo) / step), 126) AS i, (value - lo) / step AS p FROM events JOIN b ON b.k = event_type),
w AS (SELECT k, i, sum(1 - (p - i)) AS l, sum(p - i) AS rt FROM x GROUP BY ALL),
nodes AS (SELECT k, i, l AS m FROM w UNION ALL SELECT k, i + 1, rt FROM w),
g AS (SELECT b.*, unnest(generate_series(0, 127)) AS gi FROM b)
SELECT g.k AS event_type, round(lo + gi * step, 5) AS x, round(sum(m * exp(-pow((gi - i) * step / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density
FROM g JOIN nodes USING (k) GROUP BY g.k, gi, lo, step, n, h
""")
def density_grid(t: Tables) -> DataFrame:
    out = T.grouped_density(t("events"), ["event_type"], "value", points=128)
    return out.select("event_type", r("x", 5).alias("x"), r("density", 8).alias("density"))


@query("""
WITH p AS (SELECT event_type AS k, CAST(ts AS DATE) AS x, floor(value) / 10 AS d, avg(value) AS v FROM events GROUP BY ALL),
fr AS (SELECT k, min(d) AS d0, max(d) AS d1, min(x) AS x0, max(x) AS x1 FROM p GROUP BY k),
lv AS (SELECT k, d0, x0, x1, unnest(generate_series(0, CAST(floor((d1 - d0) / 0.5 + 1e-10) AS BIGINT))) AS j FROM fr),
sg AS (SELECT *, lead(d) OVER w AS d2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY k, x ORDER BY d)),
z1 AS (SELECT s.k, s.x, j, CASE WHEN d2 IS NULL THEN v ELSE v + (v2 - v) * (d0 + j * 0.5 - d) / (d2 - d) END AS z
 FROM sg s JOIN lv ON lv.k = s.k AND d0 + j * 0.5 >= d - 5e-11 AND (d0 + j * 0.5 < d2 - 5e-11 OR (d2 IS NULL AND d0 + j * 0.5 <= d + 5e-11))),
nx AS (SELECT *, lead(x) OVER w AS x2, lead(z) OVER w AS z2 FROM z1 WINDOW w AS (PARTITION BY k, j ORDER BY x)),
sp AS (SELECT k, j, d0, CAST(unnest(generate_series(x0, x1, INTERVAL 1 DAY)) AS DATE) AS x FROM lv)
SELECT sp.k AS event_type, sp.x, round(d0 + sp.j * 0.5, 4) AS y,
 round(CASE WHEN nx.x2 IS NULL THEN nx.z ELSE nx.z + (nx.z2 - nx.z) * CAST(sp.x - nx.x AS DOUBLE) / CAST(nx.x2 - nx.x AS DOUBLE) END, 6) AS z
FROM sp LEFT JOIN nx ON nx.k = sp.k AND nx.j = sp.j AND sp.x >= nx.x AND (sp.x < nx.x2 OR (nx.x2 IS NULL AND sp.x = nx.x))
""")
def grid_interpolate(t: Tables) -> DataFrame:
    rows = t("events").select("event_type", "ts", (F.floor("value") / 10).alias("d"), "value")
    out = grid_op(rows, ["event_type"], "ts", "d", "value")
    return out.select("event_type", "x", r("y", 4).alias("y"), r("z", 6).alias("z"))
