"""Registered contract queries (CT1-CT15, SNK3, SNK6, CT6) and their oracle SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabletwin.operators import contract as CT
from tabletwin.plans.registry import query
from tabletwin.plans.tables import CUSTOMER_GEO_SQL, customer_geo, table
from tabletwin.session import ensure_checkpoint_dir

GEO = [("c_custkey", "numeric", True), ("c_name", "categorical", None), ("c_nationkey", "numeric", True),
       ("c_acctbal", "numeric", False), ("c_mktsegment", "categorical", None), ("n_nationkey", "numeric", True),
       ("n_name", "categorical", None), ("n_regionkey", "numeric", True), ("r_name", "categorical", None)]


def customer_bad(spark, sf):
    """customer with planted faults: out-of-range balances, unknown segments and names, a string-typed
    nation key with NULLs and non-numbers; the nation/region columns of the contract are missing."""
    from tabletwin.plans.io_plans import customer_bad_frame
    return customer_bad_frame(table(spark, sf, "customer"))


BAD_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 101 = 0 THEN 'Nobody' ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 83 = 0 THEN NULL WHEN c_custkey % 79 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
  CASE WHEN c_custkey % 97 = 0 THEN c_acctbal + 1000000 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 89 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def _contract_sql() -> str:
    parts = []
    for i, (c, kind, integer) in enumerate(GEO):
        common = (f"SELECT '{c}' AS column_name, {i} AS position, '{kind}' AS dtype, count(*) > count({c}) AS nullable, "
                  f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_fraction, ")
        if kind == "numeric":
            x = f"{c}::DOUBLE"
            m = f"greatest(abs(min({x})), abs(max({x}))) * 0.1"
            parts.append(common + f"round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(min({x}) - {m}, 6) AS check_lower, "
                         f"round(max({x}) + {m}, 6) AS check_upper, {str(integer).lower()} AS is_integer, NULL::BIGINT AS cardinality, "
                         f"NULL::VARCHAR AS allowed_value FROM s")
        else:
            parts.append(common + f"NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS check_lower, NULL::DOUBLE AS check_upper, "
                         f"NULL::BOOLEAN AS is_integer, count(DISTINCT {c}) AS cardinality, "
                         f"unnest(list(DISTINCT {c})) AS allowed_value FROM s")
    return f"WITH s AS (SELECT * FROM {CUSTOMER_GEO_SQL}), contract AS ({' UNION ALL '.join(parts)})\n"


CONTRACT_SQL = _contract_sql()
OUT_COLS = "column_name, position, dtype, nullable, null_fraction, min, max, check_lower, check_upper, is_integer, cardinality, allowed_value"


def _violations_sql() -> str:
    present = {"c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"}
    parts = []
    for c, kind, _ in GEO:
        if c not in present:
            parts.append(f"SELECT '{c}' AS column_name, 'column_in_dataframe' AS check_name, '{c}' AS failure_case, NULL::VARCHAR AS row_key")
            continue
        rule = f"(SELECT DISTINCT nullable, check_lower, check_upper FROM contract WHERE column_name = '{c}')"
        parts.append(f"SELECT '{c}', 'not_nullable', NULL::VARCHAR, CAST(c_custkey AS VARCHAR) FROM bad, {rule} r "
                     f"WHERE {c} IS NULL AND NOT r.nullable")
        if kind == "numeric":
            v = f"TRY_CAST({c} AS DOUBLE)"
            if c == "c_nationkey":
                parts.append(f"SELECT '{c}', 'coerce_dtype(''int64'')', {c}, CAST(c_custkey AS VARCHAR) FROM bad "
                             f"WHERE {c} IS NOT NULL AND {v} IS NULL")
            parts.append(f"SELECT '{c}', printf('in_range(%.6f, %.6f)', r.check_lower, r.check_upper), printf('%.6f', {v}), "
                         f"CAST(c_custkey AS VARCHAR) FROM bad, {rule} r WHERE {v} IS NOT NULL AND NOT ({v} BETWEEN r.check_lower AND r.check_upper)")
        else:
            parts.append(f"SELECT '{c}', 'isin', {c}, CAST(c_custkey AS VARCHAR) FROM bad "
                         f"WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM s WHERE {c} IS NOT NULL)")
    return CONTRACT_SQL + f", bad AS (SELECT * FROM {BAD_SQL}), v(column_name, check_name, failure_case, row_key) AS ({' UNION ALL '.join(parts)})\n"


VIOL_SQL = _violations_sql()


def _violations(spark, sf):
    return CT.check(customer_bad(spark, sf), CT.learn(customer_geo(spark, sf)), "c_custkey")


@query("contract_learn", CONTRACT_SQL + f"SELECT {OUT_COLS} FROM contract")
def contract_learn(spark, sf):
    return CT.learn(customer_geo(spark, sf))


@query("contract_numeric", CONTRACT_SQL + "SELECT column_name, min, max, check_lower, check_upper, is_integer FROM contract WHERE dtype = 'numeric'")
def contract_numeric(spark, sf):
    return CT.learn(customer_geo(spark, sf)).where("dtype = 'numeric'").select(
        "column_name", "min", "max", "check_lower", "check_upper", "is_integer")


@query("contract_categorical", CONTRACT_SQL + "SELECT column_name, cardinality, allowed_value FROM contract WHERE dtype = 'categorical'")
def contract_categorical(spark, sf):
    return CT.learn(customer_geo(spark, sf)).where("dtype = 'categorical'").select(
        "column_name", "cardinality", "allowed_value")


@query("contract_roundtrip", CONTRACT_SQL + f"SELECT {OUT_COLS} FROM contract")
def contract_roundtrip(spark, sf):
    """SNK3 + CT6: save the contract as JSON in the shared checkpoint folder, read it back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"contract-{uuid.uuid4().hex}")
    CT.save(CT.learn(customer_geo(spark, sf)), path)
    CT.save(CT.learn(customer_geo(spark, sf)).limit(0), path, mode="ignore")  # SNK6: existing output is kept
    return CT.load(spark, path)


@query("contract_self_check", CONTRACT_SQL + "SELECT NULL::VARCHAR AS column_name, NULL::VARCHAR AS check_name, "
       "NULL::VARCHAR AS failure_case, NULL::VARCHAR AS row_key WHERE false")
def contract_self_check(spark, sf):
    """A learned contract accepts the table it was learned from (extra columns allowed)."""
    g = customer_geo(spark, sf)
    return CT.check(g.withColumn("extra", F.lit(1)), CT.learn(g), "c_custkey")


@query("validate_report", VIOL_SQL + "SELECT column_name, check_name, failure_case, row_key FROM v")
def validate_report(spark, sf):
    return _violations(spark, sf)


@query("validate_range", VIOL_SQL + "SELECT * FROM v WHERE check_name LIKE 'in_range%'")
def validate_range(spark, sf):
    return _violations(spark, sf).where(F.col("check_name").startswith("in_range"))


@query("validate_allowed", VIOL_SQL + "SELECT * FROM v WHERE check_name = 'isin'")
def validate_allowed(spark, sf):
    return _violations(spark, sf).where(F.col("check_name") == "isin")


@query("validate_nulls", VIOL_SQL + "SELECT * FROM v WHERE check_name = 'not_nullable'")
def validate_nulls(spark, sf):
    return _violations(spark, sf).where(F.col("check_name") == "not_nullable")


@query("validate_coerce", VIOL_SQL + "SELECT * FROM v WHERE check_name LIKE 'coerce_dtype%'")
def validate_coerce(spark, sf):
    return _violations(spark, sf).where(F.col("check_name").startswith("coerce_dtype"))


@query("validate_missing", VIOL_SQL + "SELECT * FROM v WHERE check_name = 'column_in_dataframe'")
def validate_missing(spark, sf):
    return _violations(spark, sf).where(F.col("check_name") == "column_in_dataframe")


@query("validate_summary", VIOL_SQL + "SELECT column_name, check_name, count(*) AS n_violations FROM v GROUP BY 1, 2")
def validate_summary(spark, sf):
    return CT.summary(_violations(spark, sf))


@query("validate_report_lines", VIOL_SQL + """, o AS (SELECT *, row_number() OVER (ORDER BY column_name, check_name, row_key NULLS FIRST) AS n FROM v)
SELECT n, printf('%3d. Column: %-30s  Check: %s', n, column_name, check_name) AS line FROM o WHERE n <= 50
UNION ALL SELECT 51 AS n, printf('  ... and %d more.', count(*) - 50) AS line FROM v HAVING count(*) > 50""")
def validate_report_lines(spark, sf):
    return CT.report_lines(_violations(spark, sf), 50)


@query("validate_first", VIOL_SQL + "SELECT column_name, check_name, failure_case, row_key FROM v "
       "ORDER BY column_name, check_name, row_key NULLS FIRST, failure_case NULLS FIRST LIMIT 1")
def validate_first(spark, sf):
    """CT14: stop at the first violation (lazy=False): one row."""
    return CT.check(customer_bad(spark, sf), CT.learn(customer_geo(spark, sf)), "c_custkey", lazy=False)


@query("validate_allowed_long", VIOL_SQL + "SELECT * FROM v WHERE check_name = 'isin'")
def validate_allowed_long(spark, sf):
    """CT12 with every allowed list taken as a long one: membership by joins on the value rows alone."""
    v = CT.check(customer_bad(spark, sf), CT.learn(customer_geo(spark, sf)), "c_custkey", inline_limit=0)
    return v.where(F.col("check_name") == "isin")
