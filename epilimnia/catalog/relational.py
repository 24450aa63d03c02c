"""Projection, filter, join, set and reshape operators on the given tables."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even, overlay_day, part, year_day_as_date
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import reshape as R
from ..operators import select as P
from ..session import literal_table
from .base import Tables, query, r, rounded


@query("""
SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL
""")
def daily_mean(t: Tables) -> DataFrame:
    return rounded(A.daily_mean(t("events"), ["event_type"], "ts", "value", "day"), "value")


def with_missing(t: Tables, every: int = 13) -> DataFrame:
    """events with a site and injected NULLs."""
    return t("events").select(
        "event_id",
        "ts",
        "event_type",
        (F.col("user_id") % 2).cast("int").alias("site"),
        F.when(F.col("event_id") % every != 0, F.col("value")).alias("value"),
    )


MISSING = """SELECT event_id, ts, event_type, CAST(user_id % 2 AS INT) AS site,
 CASE WHEN event_id % {} <> 0 THEN value END AS value FROM events"""


@query(f"""
SELECT site, event_type, CAST(ts AS DATE) AS day, CAST(count(value) AS BIGINT) AS n,
 CASE WHEN count(value) >= 30 THEN round(avg(value), 6) END AS value
FROM ({MISSING.format(13)}) WHERE value IS NOT NULL GROUP BY ALL
""")
def daily_mean_gated(t: Tables) -> DataFrame:
    out = A.daily_mean_gated(with_missing(t), ["site", "event_type"], "ts", "value", 30, date="day", n="n")
    return rounded(out, "value")


@query(f"""
SELECT site, event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n,
 CASE WHEN count(*) >= 33 THEN round(avg(value), 6) END AS value
FROM ({MISSING.format(13)}) GROUP BY ALL
""")
def daily_mean_gated_rows(t: Tables) -> DataFrame:
    out = A.daily_mean_gated(with_missing(t), ["site", "event_type"], "ts", "value", 33, True, date="day", n="n")
    return rounded(out, "value")


@query(f"""
SELECT event_type, CAST(ts AS DATE) AS day,
 CASE WHEN count(value) = count(*) THEN round(sum(value), 4) END AS total
FROM ({MISSING.format(97)}) GROUP BY ALL
""")
def strict_sum_daily(t: Tables) -> DataFrame:
    rows = with_missing(t, 97).groupBy("event_type", F.to_date("ts").alias("day"))
    return rounded(rows.agg(A.strict_sum("value").alias("total")), "total", digits=4)


@query(f"""
SELECT site, CAST(ts AS DATE) AS day,
 CASE WHEN count(value) = count(*) THEN max(value) END AS hi,
 CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS mean
FROM ({MISSING.format(199)}) GROUP BY ALL
""")
def strict_max(t: Tables) -> DataFrame:
    rows = with_missing(t, 199).groupBy("site", F.to_date("ts").alias("day"))
    return rounded(rows.agg(A.strict_max("value").alias("hi"), A.strict_avg("value").alias("mean")), "mean")


@query("""
SELECT l_returnflag, l_linestatus,
 round_even(avg(l_quantity), 3) AS MeanQty, round_even(median(l_quantity), 3) AS MedianQty,
 round_even(min(l_quantity), 3) AS MinQty, round_even(max(l_quantity), 3) AS MaxQty,
 round_even(avg(l_extendedprice), 3) AS MeanPrice, round_even(median(l_extendedprice), 3) AS MedianPrice,
 round_even(min(l_extendedprice), 3) AS MinPrice, round_even(max(l_extendedprice), 3) AS MaxPrice
FROM lineitem GROUP BY ALL
""")
def stats_summary(t: Tables) -> DataFrame:
    return A.summarise_stats(
        t("lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": "Qty", "l_extendedprice": "Price"}
    )


@query("""
SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY ALL
""")
def exact_quartiles(t: Tables) -> DataFrame:
    return rounded(A.exact_quantiles(t("events"), ["event_type"], "value", {"q1": 0.25, "q3": 0.75}), "q1", "q3")


@query("""
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def first_per_key(t: Tables) -> DataFrame:
    return A.first_per_key(t("events"), ["user_id"], ["ts", "event_id"])


@query("""
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) = 1
""")
def slice_min_ties(t: Tables) -> DataFrame:
    rows = t("orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return A.slice_min(rows, ["o_custkey"], "day")


@query("""
SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY year(o_orderdate), o_orderstatus), 4) AS deviation
FROM orders
""")
def attach_mean(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    out = A.attach_stats(rows, ["year", "o_orderstatus"], {"mean": F.avg("o_totalprice")})
    return out.select("o_orderkey", r(F.col("o_totalprice") - F.col("mean"), 4).alias("deviation"))


@query("""
SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10
""")
def having_rows(t: Tables) -> DataFrame:
    return A.having_rows(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 10)


@query("""
SELECT l_returnflag, l_linestatus, round_even(avg(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END), 3) AS share
FROM lineitem GROUP BY ALL
""")
def mean_ratio(t: Tables) -> DataFrame:
    return A.mean_ratio(t("lineitem"), ["l_returnflag", "l_linestatus"], {"share": ("l_discount", "l_tax")})


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, avg(l_quantity) AS l_quantity,
 CASE WHEN count(x) = count(*) THEN round(avg(x), 6) END AS x
FROM (SELECT *, CASE WHEN l_tax > 0 THEN l_discount END AS x FROM lineitem) GROUP BY ALL
""")
def mean_reps(t: Tables) -> DataFrame:
    rows = t("lineitem").withColumn("x", F.when(F.col("l_tax") > 0, F.col("l_discount")))
    out = A.mean_reps(rows, ["l_orderkey", "l_partkey", "l_suppkey"], ["l_quantity", "x"], strict=["x"])
    return rounded(out, "x")


@query("""
SELECT o_custkey, CAST(min(o_totalprice) AS DOUBLE) AS top, CAST(max(o_totalprice) AS DOUBLE) AS bottom,
 arg_min(o_orderkey, o_totalprice) AS o_orderkey_top, arg_max(o_orderkey, o_totalprice) AS o_orderkey_bottom
FROM orders GROUP BY ALL
""")
def profile_ends(t: Tables) -> DataFrame:
    return A.profile_ends(t("orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


# --- filters -------------------------------------------------------------------------------------


@query("""
SELECT a.user_id, a.ts, a.event_type, a.value, b.flag
FROM (SELECT user_id, ts, event_type, value FROM events) a
JOIN (SELECT user_id, ts, event_type, CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 11 AS INT) END AS flag FROM events) b
 USING (user_id, ts, event_type)
WHERE flag NOT IN (9, 7, 2, 1, 5, 3)
""")
def flag_filter_join(t: Tables) -> DataFrame:
    e = t("events")
    obs = e.select("user_id", "ts", "event_type", "value")
    flag = F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 11).cast("int"))
    flags = e.select("user_id", "ts", "event_type", flag.alias("flag"))
    return Q.drop_flagged(J.join_flags(obs, flags), [9, 7, 2, 1, 5, 3], ["flag"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, f1, f2 FROM (
 SELECT *, CAST(l_linenumber AS INT) AS f1, CASE WHEN l_quantity < 45 THEN CAST(l_quantity AS INT) END AS f2 FROM lineitem)
WHERE f1 NOT IN (2, 6) AND f2 NOT IN (2, 6)
""")
def flag_filter_wide(t: Tables) -> DataFrame:
    f2 = F.when(F.col("l_quantity") < 45, F.col("l_quantity").cast("int"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("f1"), f2.alias("f2"))
    return Q.drop_flagged(rows, [2, 6], ["f1", "f2"])


@query("""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1998-03-01'
""")
def time_window(t: Tables) -> DataFrame:
    return Q.between_time(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-03-01", "1998-03-01")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (l_returnflag = 'A' AND year(l_shipdate) = 1996 AND l_quantity BETWEEN 5 AND 20)
   OR (l_returnflag = 'R' AND year(l_shipdate) = 1998 AND l_quantity BETWEEN 30 AND 45)
""")
def any_window(t: Tables) -> DataFrame:
    year = F.year("l_shipdate")
    rules = [
        (F.col("l_returnflag") == "A") & (year == 1996) & F.col("l_quantity").between(5, 20),
        (F.col("l_returnflag") == "R") & (year == 1998) & F.col("l_quantity").between(30, 45),
    ]
    return Q.any_window(t("lineitem"), rules).select("l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax = 0 OR l_discount = 0
""")
def where_any(t: Tables) -> DataFrame:
    return Q.where_any(
        t("lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), ["l_tax", "l_discount"], lambda c: c == 0
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
def where_max(t: Tables) -> DataFrame:
    return Q.where_max(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("""
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(x) AS BIGINT) AS finite_n, round(max(x), 6) AS hi
FROM (SELECT event_type, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS x FROM events) GROUP BY ALL
""")
def nullify_nonfinite(t: Tables) -> DataFrame:
    m = F.col("event_id") % 7
    x = (
        F.when(m == 0, F.lit(float("nan")))
        .when(m == 1, F.lit(float("inf")))
        .when(m == 2, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    rows = Q.nullify_nonfinite(t("events").select("event_type", x.alias("x")), "x")
    out = rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("finite_n"), F.max("x").alias("hi")
    )
    return rounded(out, "hi")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN NULL ELSE value END AS patched,
 CASE WHEN value BETWEEN 5 AND 60 THEN value END AS censored
FROM events
""")
def patch_censor(t: Tables) -> DataFrame:
    rows = t("events").select("event_id", "event_type", "value", F.col("value").alias("patched"))
    rows = P.patch(rows, (F.col("event_type") == "error") & (F.col("value") > 100), "patched", None)
    return Q.censor(rows, "value", 5, 60, out="censored").select("event_id", "patched", "censored")


@query("""
SELECT event_id, 'error' AS branch, value * 2 AS x FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'view', value + 1 FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type IS NULL OR event_type NOT IN ('error', 'view')
""")
def route_by_site(t: Tables) -> DataFrame:
    cols = lambda x: ("event_id", F.col("event_type").alias("branch"), x.alias("x"))
    return Q.route_by(
        t("events"),
        "event_type",
        {
            "error": lambda d: d.select(*cols(F.col("value") * 2)),
            "view": lambda d: d.select(*cols(F.col("value") + 1)),
        },
        rest=lambda d: d.select(*cols(F.col("value"))),
    )


# --- labels and columns --------------------------------------------------------------------------


@query("""
SELECT p_partkey,
 CASE WHEN p_size >= 40 THEN 'big' WHEN p_size >= 20 THEN 'mid' ELSE 'small' END AS size_label,
 CASE WHEN kind = 'FCR' THEN CASE WHEN p_size >= 4 THEN 'Hypolimnion' ELSE 'Epilimnion' END
      WHEN kind = 'BVR' THEN CASE WHEN p_size >= 5 THEN 'Hypolimnion' ELSE 'Epilimnion' END END AS layer,
 CASE WHEN p_size <= 5 THEN 'Epilimnion' ELSE 'Hypolimnion' END AS trap_layer,
 CASE p_type WHEN 'ECONOMY' THEN 'Eco' WHEN 'SMALL' THEN 'Sml' WHEN 'PROMO' THEN 'Pro' END AS p_type,
 CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'PROMO' THEN 3 END AS INT) AS p_type_order
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'FCR' WHEN 1 THEN 'BVR' END AS kind FROM part)
""")
def layer_rules(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    rows = t("part").withColumn("kind", F.when(k == 0, F.lit("FCR")).when(k == 1, F.lit("BVR")))
    size = F.col("p_size")
    rows = P.label_rules(rows, "size_label", [(size >= 20, "mid"), (size >= 40, "big")], "small")
    rows = P.layer_of(rows, "kind", "p_size", {"FCR": 4.0, "BVR": 5.0}, out="layer")
    rows = rows.withColumn("trap_layer", P.layer_at("p_size", 5))
    rows = P.relabel(rows, "p_type", {"ECONOMY": "Eco", "SMALL": "Sml", "PROMO": "Pro"}, order=True)
    return rows.select("p_partkey", "size_label", "layer", "trap_layer", "p_type", "p_type_order")


SWAP_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000 AS tot, l_quantity AS sol,
 l_tax AS tot2, l_discount AS sol2, l_extendedprice / 1000 - l_quantity AS d1, l_tax - l_discount AS d2 FROM lineitem"""


def swap_rows(t: Tables) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 1000).alias("tot"), F.col("l_quantity").alias("sol"),
        F.col("l_tax").alias("tot2"), F.col("l_discount").alias("sol2"),
    ).withColumns({"d1": F.col("tot") - F.col("sol"), "d2": F.col("tot2") - F.col("sol2")})


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(tot, sol), 6) AS tot, round(least(tot, sol), 6) AS sol, round(abs(d1), 6) AS d1
FROM ({SWAP_SQL}) WHERE d1 <> 0
""")
def swap_each(t: Tables) -> DataFrame:
    out = P.unswap(swap_rows(t), {"d1": ("tot", "sol")}, "each")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "tot", "sol", "d1"), "tot", "sol", "d1")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(tot, sol), 6) AS tot, round(least(tot2, sol2), 6) AS sol2
FROM ({SWAP_SQL}) WHERE (d1 > 0 AND d2 > 0) OR (d1 < 0 AND d2 < 0)
""")
def swap_both(t: Tables) -> DataFrame:
    out = P.unswap(swap_rows(t), {"d1": ("tot", "sol"), "d2": ("tot2", "sol2")}, "both")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "tot", "sol2"), "tot", "sol2")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS c_name,
 CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def swap_where(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return P.swap_where(rows, "c_name", "c_mktsegment", F.col("c_acctbal") < 0).drop("c_acctbal")


@query("""
SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity) / 10, 4) AS l_quantity,
 round(sum(l_discount) / 10, 4) AS l_discount, round(sum(l_tax) / 10, 4) AS l_tax
FROM lineitem GROUP BY ALL
""")
def column_selectors(t: Tables) -> DataFrame:
    """Pattern, range and position selectors, tolerant rename, one transform over many columns."""
    df = t("lineitem")
    numbers = [c for c in P.cols_between(df, "l_quantity", "l_tax") if c not in P.cols(df, contains=["PRICE"])]
    rows = df.select(*P.cols(df, starts=["L_RETURN"], exclude=["status"]), *numbers)
    rows = P.rename(rows, {P.cols_at(rows, 1)[0]: "flag", "absent": "other"}, missing_ok=True)
    rows = P.apply_to(rows, numbers, lambda c: c / 10)
    out = rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in numbers])
    return rounded(out, *numbers, digits=4)


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date", CAST(year(o_orderdate) AS INT) AS "Year",
 CAST(dayofyear(o_orderdate) AS INT) AS "DOY",
 TRY_CAST('2001-' || strftime(o_orderdate, '%m-%d') AS DATE) AS mday,
 CAST(DATE '1970-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INT) AS DATE) AS ddate
FROM orders
""")
def overlay_days(t: Tables) -> DataFrame:
    rows = P.add_time_parts(t("orders"), "o_orderdate")
    return rows.select(
        "o_orderkey", "Date", "Year", "DOY", overlay_day("Date", 2001).alias("mday"), year_day_as_date("Date").alias("ddate")
    )


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, nullif(split_part(p_name, ' ', 3), '') AS third,
 split_part(p_name, ' ', -1) AS last_word, CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_no,
 TRY_CAST(p_name AS DOUBLE) AS not_a_number, round_even(p_retailprice / 8, 1) AS even
FROM part
""")
def name_parts(t: Tables) -> DataFrame:
    return t("part").select(
        "p_partkey",
        part("p_name", 1, " ").alias("first_word"),
        part("p_name", 3, " ").alias("third"),
        part("p_name", -1, " ").alias("last_word"),
        part("p_brand", 2, "#").cast("double").alias("brand_no"),
        F.col("p_name").try_cast("double").alias("not_a_number"),
        half_even(F.col("p_retailprice") / 8, 1).alias("even"),
    )


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing FROM part
""")
def split_names(t: Tables) -> DataFrame:
    return R.split_name(t("part").select("p_partkey", "p_name"), "p_name", ["colour", "thing"], " ")


# --- joins ---------------------------------------------------------------------------------------

CUSTOMERS_SQL = """SELECT nullif(c_nationkey, 3) AS k, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS sign,
 CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY ALL"""
SUPPLIERS_SQL = """SELECT nullif(s_nationkey, 5) AS k, CASE WHEN s_acctbal < 3000 THEN 'neg' ELSE 'pos' END AS sign,
 CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY ALL"""


def customer_counts(t: Tables) -> DataFrame:
    sign = F.when(F.col("c_acctbal") < 0, F.lit("neg")).otherwise(F.lit("pos"))
    return t("customer").groupBy(F.nullif("c_nationkey", F.lit(3)).alias("k"), sign.alias("sign")).agg(
        F.count(F.lit(1)).alias("customers")
    )


def supplier_counts(t: Tables) -> DataFrame:
    sign = F.when(F.col("s_acctbal") < 3000, F.lit("neg")).otherwise(F.lit("pos"))
    return t("supplier").groupBy(F.nullif("s_nationkey", F.lit(5)).alias("k"), sign.alias("sign")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )


@query(f"""
SELECT coalesce(a.k, b.k) AS k, coalesce(a.sign, b.sign) AS sign, customers, suppliers
FROM ({CUSTOMERS_SQL}) a FULL JOIN ({SUPPLIERS_SQL}) b ON a.k IS NOT DISTINCT FROM b.k AND a.sign IS NOT DISTINCT FROM b.sign
""")
def natural_full_join(t: Tables) -> DataFrame:
    return J.natural_join(customer_counts(t), supplier_counts(t), "full")


@query(f"""
SELECT a.k, a.sign, customers, suppliers
FROM ({CUSTOMERS_SQL}) a JOIN ({SUPPLIERS_SQL}) b ON a.k IS NOT DISTINCT FROM b.k AND a.sign IS NOT DISTINCT FROM b.sign
""")
def natural_inner_join(t: Tables) -> DataFrame:
    return J.natural_join(customer_counts(t), supplier_counts(t), "inner")


@query(f"""
SELECT coalesce(a.k, b.k) AS k, coalesce(a.sign, b.sign) AS sign
FROM ({CUSTOMERS_SQL}) a FULL JOIN ({SUPPLIERS_SQL}) b ON a.k IS NOT DISTINCT FROM b.k AND a.sign IS NOT DISTINCT FROM b.sign
""")
def stack_by_full_join(t: Tables) -> DataFrame:
    return J.natural_join(customer_counts(t).drop("customers"), supplier_counts(t).drop("suppliers"), "full")


@query("""
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def lookup_names(t: Tables) -> DataFrame:
    nations = t("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = t("region").withColumnRenamed("r_regionkey", "n_regionkey")
    return J.lookup(J.lookup(t("customer"), nations, ["c_nationkey"]), regions, ["n_regionkey"]).select(
        "c_custkey", "n_name", "r_name"
    )


NAME_SCHEMA = pa.schema([("event_type", pa.string()), ("new", pa.string())])


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'Temp_C' WHEN 'click' THEN 'Chla_ugL' WHEN 'error' THEN 'fDOM_QSU' END AS event_type
FROM events WHERE event_type IN ('view', 'click', 'error')
""")
def standard_names(t: Tables) -> DataFrame:
    names = {"view": "Temp_C", "click": "Chla_ugL", "error": "fDOM_QSU"}
    table = literal_table(t.spark, [{"event_type": a, "new": b} for a, b in names.items()], NAME_SCHEMA)
    return J.standardise(t("events").select("event_id", "event_type"), table, "event_type", "new")


@query("""
SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (
 SELECT CAST(l_shipdate AS DATE) - CAST((CAST(l_shipdate AS DATE) - DATE '1970-01-01') % 3 AS INT) FROM lineitem)
""")
def anti_days(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("Date"))
    day = F.to_date("l_shipdate")
    busy = t("lineitem").select(F.date_sub(day, F.unix_date(day) % 3).alias("Date"))
    return J.exclude_days(rows, busy, ["Date"]).select("o_orderkey")


YEAR_WINDOWS_SQL = """SELECT year(o_orderdate) AS y, CAST(min(o_orderdate) AS DATE) + 40 AS a, CAST(max(o_orderdate) AS DATE) - 70 AS b
 FROM orders GROUP BY ALL"""


def year_windows(t: Tables) -> DataFrame:
    return t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.date_add(F.to_date(F.min("o_orderdate")), 40).alias("a"),
        F.date_sub(F.to_date(F.max("o_orderdate")), 70).alias("b"),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE EXISTS (
 SELECT 1 FROM ({YEAR_WINDOWS_SQL}) w WHERE w.y = year(l.l_shipdate) AND CAST(l.l_shipdate AS DATE) BETWEEN a AND b)
""")
def window_semi(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.year("l_shipdate").alias("y"))
    return J.within_windows(rows, year_windows(t), "l_shipdate", ["y"], "a", "b").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query("""
WITH iv AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) + 15 AS a, CAST(o_orderdate AS DATE) + CAST(20 + o_orderkey % 100 AS INT) AS b FROM orders)
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.k = o.o_custkey AND CAST(o.o_orderdate AS DATE) BETWEEN a AND b)
 THEN 'On' ELSE 'Off' END AS state FROM orders o
""")
def interval_tag(t: Tables) -> DataFrame:
    o = t("orders")
    day = F.to_date("o_orderdate")
    intervals = o.select(
        "o_custkey", F.date_add(day, 15).alias("a"), F.date_add(day, (20 + F.col("o_orderkey") % 100).cast("int")).alias("b")
    )
    return J.tag_intervals(o, intervals, "o_orderdate", ["o_custkey"], "a", "b").select("o_orderkey", "state")


@query("""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders),
ev AS (SELECT o_orderstatus AS s, year(d) AS y, arg_max(d, (o_totalprice, o_orderkey)) AS e FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
w AS (SELECT o_orderstatus AS s, o_orderpriority AS p, min(d) AS a, min(d) + 40 AS b, 'Pre_' AS ph FROM o WHERE year(d) = 1996 GROUP BY ALL
 UNION ALL SELECT o_orderstatus, o_orderpriority, min(d) + 50, min(d) + 150, 'Pre' FROM o WHERE year(d) = 1996 GROUP BY ALL)
SELECT o_orderkey, CASE WHEN d >= e THEN 'Post' WHEN d < e THEN CASE WHEN year(d) = 1996 THEN w.ph ELSE 'Pre' END END AS phase
FROM o LEFT JOIN ev ON ev.s = o_orderstatus AND ev.y = year(d)
 LEFT JOIN w ON w.s = o_orderstatus AND w.p = o_orderpriority AND d BETWEEN a AND b
""")
def phase_tag(t: Tables) -> DataFrame:
    o = t("orders").withColumn("d", F.to_date("o_orderdate"))
    events = (
        o.where(F.col("o_orderpriority") == "1-URGENT")
        .groupBy("o_orderstatus", F.year("d").alias("y"))
        .agg(F.max_by("d", F.struct("o_totalprice", "o_orderkey")).alias("e"))
    )
    first = o.where(F.year("d") == 1996).groupBy("o_orderstatus", "o_orderpriority").agg(F.min("d").alias("m"))
    spans = F.array(
        F.struct(F.col("m").alias("start"), F.date_add("m", 40).alias("end"), F.lit("Pre_").alias("phase")),
        F.struct(F.date_add("m", 50).alias("start"), F.date_add("m", 150).alias("end"), F.lit("Pre").alias("phase")),
    )
    windows = first.select("o_orderstatus", "o_orderpriority", F.explode(spans).alias("w")).select(
        "o_orderstatus", "o_orderpriority", "w.*"
    )
    out = J.phase_of(o, events, "d", ["o_orderstatus"], "e", windows, ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", "phase")


# --- sets and shapes -----------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders")
def distinct_rows(t: Tables) -> DataFrame:
    return t("orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day")).distinct()


@query("""
SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier
""")
def stack_rows(t: Tables) -> DataFrame:
    a = t("customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    return P.stack(a, b)


@query("""
SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, o_orderstatus FROM orders GROUP BY ALL
UNION ALL SELECT DATE '1995-01-01', NULL, 'gap' UNION ALL SELECT DATE '1996-06-01', NULL, 'gap'
""")
def add_rows(t: Tables) -> DataFrame:
    rows = t("orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    breaks = [{"day": date(1995, 1, 1), "o_orderstatus": "gap"}, {"day": date(1996, 6, 1), "o_orderstatus": "gap"}]
    schema = pa.schema([("day", pa.date32()), ("o_orderstatus", pa.string())])
    return P.add_rows(rows, literal_table(t.spark, breaks, schema))


@query("""
SELECT p_partkey, 'size' AS measure, CASE WHEN p_size > 3 THEN CAST(p_size AS DOUBLE) END AS value FROM part
UNION ALL SELECT p_partkey, 'retailprice', p_retailprice FROM part
""")
def to_long(t: Tables) -> DataFrame:
    rows = t("part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size").cast("double")).alias("p_size"), "p_retailprice")
    return R.to_long(rows, ["p_partkey"], "measure", "value", prefix="p_")


@query("""
SELECT l_suppkey, 'sum' AS stat, 'qty' AS measure, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT l_suppkey, 'max', 'qty', round(max(l_quantity), 4) FROM lineitem GROUP BY ALL
UNION ALL SELECT l_suppkey, 'max', 'tax', round(max(l_tax), 4) FROM lineitem GROUP BY ALL
""")
def to_long_split(t: Tables) -> DataFrame:
    wide = t("lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("sum_C_qty"), F.max("l_quantity").alias("max_C_qty"), F.max("l_tax").alias("max_C_tax")
    )
    return rounded(R.to_long(wide, ["l_suppkey"], ["stat", "measure"], "value", sep="_C_"), "value", digits=4)


@query("""
SELECT event_id, 'value' AS variable, value AS observation, CAST(event_id % 5 AS INT) AS flag_value FROM events
UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE), CAST(user_id % 3 AS INT) FROM events
""")
def to_long_pairs(t: Tables) -> DataFrame:
    rows = t("events").select(
        "event_id", "value", "user_id", (F.col("event_id") % 5).alias("Flag_value"), (F.col("user_id") % 3).alias("Flag_user_id")
    )
    return R.to_long_pairs(rows, ["event_id"], {"value": "Flag_value", "user_id": "Flag_user_id"})


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{x}' THEN value END) AS {x}" for x in TYPES) + " FROM events GROUP BY ALL")
def to_wide(t: Tables) -> DataFrame:
    return R.to_wide(t("events"), ["user_id"], "event_type", "value", TYPES)


@query(
    "SELECT CAST(ts AS DATE) AS day, "
    + ", ".join(
        f"max(CASE WHEN event_type = '{x}' AND user_id % 2 = {s} THEN value END) AS value_{x}_{s}, "
        f"max(CASE WHEN event_type = '{x}' AND user_id % 2 = {s} THEN event_id END) AS event_id_{x}_{s}"
        for x in TYPES for s in (0, 1)
    )
    + " FROM events GROUP BY ALL"
)
def to_wide_multi(t: Tables) -> DataFrame:
    rows = t("events").withColumns({"day": F.to_date("ts"), "site": F.col("user_id") % 2})
    cells = R.cell_names(TYPES, [0, 1])
    return R.to_wide(rows, ["day"], ["event_type", "site"], ["value", "event_id"], cells)
