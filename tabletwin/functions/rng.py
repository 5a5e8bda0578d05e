"""Counter-based random draws.

A draw is a pure function of (seed, salt, row id): ``u = first 52 bits of md5("seed|salt|id") / 2^52``.
It does not depend on partitioning, task order or retries, so a lost executor recomputes the very same
values, and the same seed gives the same table on 1 or 1000 executors. One salt per purpose keeps the
streams independent. ``sql_uniform`` spells the same draw for DuckDB (bit-equal).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def _id(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def uniform(seed: int, salt: str, id_col) -> Column:
    """U[0,1) draw for each row, from md5 of ``seed|salt|id``."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), _id(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def uniform_between(seed: int, salt: str, id_col, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + uniform(seed, salt, id_col) * F.lit(float(hi) - float(lo))


def standard_normal(seed: int, salt: str, id_col) -> Column:
    """N(0,1) by Box-Muller on two independent draws (1-u keeps the log finite)."""
    u1 = uniform(seed, salt + ":n1", id_col)
    u2 = uniform(seed, salt + ":n2", id_col)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def exponential(seed: int, salt: str, id_col) -> Column:
    """Exp(1) by inversion."""
    return -F.log(F.lit(1.0) - uniform(seed, salt, id_col))


#: Tries of one gamma draw. Each is taken with probability above 0.95, so all fail once in 10**20 draws; then the
#: draw is the density's peak.
GAMMA_TRIES = 16


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cube(shape: float) -> tuple[float, float]:
    d = (shape if shape >= 1 else shape + 1) - 1.0 / 3.0
    return d, 1.0 / math.sqrt(9.0 * d)


def gamma(seed: int, salt: str, id_col, shape: float) -> Column:
    """Gamma(shape, 1) by rejection (Marsaglia and Tsang's cubed normal): try j draws a normal x and a uniform u of its
    own number, and the first try taken counts, so reruns agree and tails are exact. Shapes below one draw from shape + 1
    and shrink by u ** (1 / shape)."""
    d, c = _cube(shape)

    def attempt(j):
        at = F.concat_ws(":", j.cast("string"), _id(id_col).cast("string"))
        u = F.lit(1.0) - uniform(seed, salt + ":u", at)

        def judged(x):
            t = F.lit(1.0) + F.lit(c) * x
            return _with(t * t * t, lambda v: F.when(
                (v > 0) & (F.log(u) < F.lit(0.5) * x * x + F.lit(d) - F.lit(d) * v + F.lit(d) * F.log(v)), F.lit(d) * v))

        return _with(standard_normal(seed, salt, at), judged)

    taken = F.aggregate(F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)), F.lit(None).cast("double"),
                        lambda got, j: F.when(got.isNotNull(), got).otherwise(attempt(j)))
    g = F.coalesce(taken, F.lit(d))
    if shape >= 1:
        return g
    return g * F.exp(F.log(F.lit(1.0) - uniform(seed, salt + ":s", id_col)) / F.lit(shape))


def beta(seed: int, salt: str, id_col, a: float, b: float) -> Column:
    """Beta(a, b) as the share of one gamma draw in the sum of two."""
    return _with(gamma(seed, salt + ":a", id_col, a), lambda x: x / (x + gamma(seed, salt + ":b", id_col, b)))


# ---- the same draws in DuckDB SQL (oracle side) ---------------------------------------------

def sql_uniform(seed: int, salt: str, id_sql: str) -> str:
    return (
        f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', CAST({id_sql} AS VARCHAR))), 1, 13))"
        f"::BIGINT::DOUBLE / {TWO_52})"
    )


def sql_standard_normal(seed: int, salt: str, id_sql: str) -> str:
    u1 = sql_uniform(seed, salt + ":n1", id_sql)
    u2 = sql_uniform(seed, salt + ":n2", id_sql)
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * math.pi!r} * {u2}))"


def sql_exponential(seed: int, salt: str, id_sql: str) -> str:
    return f"(-ln(1.0 - {sql_uniform(seed, salt, id_sql)}))"


def sql_gamma(seed: int, salt: str, ids_sql: str, shape_sql: str) -> str:
    """(id, g) for the ids of a relation; the shape, a scalar, is at least one."""
    at = "concat_ws(':', CAST(j AS VARCHAR), CAST(id AS VARCHAR))"
    return f"""(SELECT id, arg_min(d * v, j) AS g FROM (SELECT *, pow(1.0 + x / sqrt(9.0 * d), 3) AS v FROM (
  SELECT i.id, t.j, {shape_sql} - 1.0::DOUBLE / 3.0 AS d, {sql_standard_normal(seed, salt, at)} AS x, 1.0 - {sql_uniform(seed, salt + ':u', at)} AS u
  FROM {ids_sql} i, range({GAMMA_TRIES}) t(j)))
  WHERE v > 0 AND ln(u) < 0.5 * x * x + d - d * v + d * ln(CASE WHEN v > 0 THEN v END) GROUP BY id)"""
