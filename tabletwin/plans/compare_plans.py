"""Registered comparison / inspection queries (AG16-AG24) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabletwin.functions.numeric import round_doubles, sql_round_half_up
from tabletwin.operators import compare as CMP
from tabletwin.plans.registry import query
from tabletwin.plans.sqlgen import union_all
from tabletwin.plans.tables import table

HIST_COLS = ["l_extendedprice", "l_quantity", "l_discount"]
DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def histogram_sql(src: str, cols: list[str], k: int) -> str:
    long = union_all([f"SELECT '{c}' AS column_name, {c}::DOUBLE AS x FROM {src} WHERE {c} IS NOT NULL" for c in cols])
    return f"""WITH long AS ({long}),
mm AS (SELECT column_name, min(x) AS mn, max(x) AS mx FROM long GROUP BY 1),
mm2 AS (SELECT column_name, mn, mx,
  CASE WHEN mx = mn THEN mn - (CASE WHEN mn = 0 THEN 0.001 ELSE abs(mn) * 0.001 END) ELSE mn END AS lo0,
  CASE WHEN mx = mn THEN mx + (CASE WHEN mx = 0 THEN 0.001 ELSE abs(mx) * 0.001 END) ELSE mx END AS hi0 FROM mm),
mm3 AS (SELECT *, (hi0 - lo0) / {k} AS w FROM mm2),
counts AS (SELECT l.column_name, CAST(CASE WHEN mx = mn THEN {(k + 1) // 2} ELSE greatest(1, least({k}, ceil((x - mn) / w))) END AS INTEGER) AS bin,
  count(*) AS count FROM long l JOIN mm3 m ON l.column_name = m.column_name GROUP BY 1, 2),
grid AS (SELECT column_name, lo0, w, CAST(unnest(range(1, {k + 1})) AS INTEGER) AS bin FROM mm3)
SELECT g.column_name, g.bin, lo0 + (g.bin - 1) * w AS lo, lo0 + g.bin * w AS hi, coalesce(c.count, 0) AS count
FROM grid g LEFT JOIN counts c ON g.column_name = c.column_name AND g.bin = c.bin"""


@query("histogram_equal_width", histogram_sql("lineitem", HIST_COLS, 15))
def histogram_equal_width(spark, sf):
    return CMP.histogram(table(spark, sf, "lineitem"), HIST_COLS, 15)


@query("histogram_20bins", histogram_sql("orders", ["o_totalprice"], 20))
def histogram_20bins(spark, sf):
    return CMP.histogram(table(spark, sf, "orders"), ["o_totalprice"], 20)


def describe_sql(src: str, cols: list[str], alias: str = "value") -> str:
    stats = [("count", "count({c})::DOUBLE"), ("mean", "avg({c}::DOUBLE)"), ("std", "stddev_samp({c}::DOUBLE)"),
             ("min", "min({c}::DOUBLE)"), ("25%", "quantile_cont({c}::DOUBLE, 0.25)"), ("50%", "quantile_cont({c}::DOUBLE, 0.5)"),
             ("75%", "quantile_cont({c}::DOUBLE, 0.75)"), ("max", "max({c}::DOUBLE)")]
    parts = []
    for c in cols:
        for i, (s, e) in enumerate(stats):
            parts.append(f"SELECT '{c}' AS column_name, '{s}' AS stat, {i} AS stat_order, {sql_round_half_up(e.format(c=c), 2)} AS {alias} FROM {src}")
    return union_all(parts)


@query("describe_numeric", describe_sql("lineitem", DESC_COLS))
def describe_numeric(spark, sf):
    return CMP.describe(table(spark, sf, "lineitem"), DESC_COLS)


@query("top_values", """SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS count,
  row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders WHERE o_custkey IS NOT NULL
  GROUP BY o_custkey QUALIFY rank <= 25""")
def top_values(spark, sf):
    return CMP.top_values(table(spark, sf, "orders"), "o_custkey", 25)


@query("top_values_15", """SELECT o_orderpriority AS value, count(*) AS count,
  row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank FROM orders WHERE o_orderpriority IS NOT NULL
  GROUP BY o_orderpriority QUALIFY rank <= 15""")
def top_values_15(spark, sf):
    return CMP.top_values(table(spark, sf, "orders"), "o_orderpriority", 15)


@query("label_counts", """SELECT CASE WHEN toxic = 0 THEN 'No Claim' WHEN toxic = 1 THEN 'Claim' ELSE CAST(toxic AS VARCHAR) END AS label,
  count(*) AS count FROM labels GROUP BY 1""")
def label_counts(spark, sf):
    return CMP.label_counts(table(spark, sf, "labels"), "toxic", {0: "No Claim", 1: "Claim"})


ORDERS = [("o_orderkey", "bigint", "num"), ("o_custkey", "bigint", "num"), ("o_orderstatus", "string", "cat"),
          ("o_totalprice", "double", "num"), ("o_orderdate", "timestamp", "cat"), ("o_orderpriority", "string", "cat")]


def _inspect_sql() -> str:
    parts = []
    for i, (c, t, k) in enumerate(ORDERS):
        txt = f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if t == "timestamp" else f"CAST({c} AS VARCHAR)"
        if k == "num":
            parts.append(f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, count(DISTINCT {c}) AS n_unique, "
                         f"count(*) - count({c}) AS n_null, round(avg({c}::DOUBLE), 6) AS mean, NULL::VARCHAR AS mode FROM orders")
        else:
            parts.append(f"SELECT '{c}', {i}, '{t}', count(DISTINCT {c}), count(*) - count({c}), NULL::DOUBLE, "
                         f"(SELECT v FROM (SELECT {txt} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) "
                         f"ORDER BY n DESC, v LIMIT 1) FROM orders")
    return union_all(parts)


@query("inspect_column", _inspect_sql())
def inspect_column(spark, sf):
    return round_doubles(CMP.inspect(table(spark, sf, "orders")))


@query("inspect_quantiles", "SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS column_name, " + ", ".join(f"{sql_round_half_up(f'quantile_cont({c}::DOUBLE, {p / 100})', 2)} AS p{p}"
                                                   for p in CMP.QUANTILE_LEVELS) + " FROM lineitem"
    for c in ["l_extendedprice", "l_quantity"]]) + ")")
def inspect_quantiles(spark, sf):
    return CMP.inspect_quantiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("kpi_row", """SELECT count(*) AS n_rows, 7 AS n_columns, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS label_rate,
  count(DISTINCT o_orderpriority) AS n_o_orderpriority, count(DISTINCT o_orderstatus) AS n_o_orderstatus,
  count(DISTINCT o_custkey) AS n_o_custkey FROM orders""")
def kpi_row(spark, sf):
    o = table(spark, sf, "orders").withColumn("is_finished", (F.col("o_orderstatus") == "F").cast("int"))
    return round_doubles(CMP.kpi_row(o, "is_finished", ["o_orderpriority", "o_orderstatus", "o_custkey"]))
