"""DuckDB spellings of the synthesis steps, for the oracle side of the synthesis queries. Each helper
returns a SELECT over a named input relation; they mirror ``tabletwin.operators.synth`` step by step."""

from __future__ import annotations

from tabletwin.functions.rng import sql_exponential, sql_standard_normal, sql_uniform


def ids(n_sql: str) -> str:
    return f"(SELECT range AS id FROM range(({n_sql})))"


def ranked(src: str, seed: int, salt: str, rank_col: str) -> str:
    return (f"(SELECT * EXCLUDE (_u), row_number() OVER (ORDER BY _u, id) - 1 AS {rank_col} "
            f"FROM (SELECT *, {sql_uniform(seed, salt, 'id')} AS _u FROM {src}))")


def draw(src: str, pool: str, value: str, seed: int, salt: str, out_col: str) -> str:
    """Inverse-CDF draw: pool is a relation (v, w); cumulative weights in v order; k = floor(u * W)."""
    return f"""(SELECT s.* EXCLUDE (_u, _k), c.v AS {out_col} FROM
  (SELECT d.*, {sql_uniform(seed, salt, 'd.id')} AS _u, floor({sql_uniform(seed, salt, 'd.id')} * t.W) AS _k
     FROM {src} d, (SELECT sum(w) AS W FROM {pool} WHERE w > 0) t) s
  JOIN (SELECT v, w, sum(w) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM {pool} WHERE w > 0) c
  ON s._k >= c.hi - c.w AND s._k < c.hi)"""


def key_pool(real: str, key: str) -> str:
    return (f"(SELECT CAST({key} AS VARCHAR) AS v, count(*) AS w FROM {real} WHERE {key} IS NOT NULL GROUP BY 1 "
            f"ORDER BY w DESC, v)")


def lookup(real: str, key: str, cols: list[str], row_key: str) -> str:
    return (f"(SELECT CAST({key} AS VARCHAR) AS {key}, " + ", ".join(f"arg_min({c}, {row_key}) AS {c}" for c in cols)
            + f" FROM {real} WHERE {key} IS NOT NULL GROUP BY {key})")


def finish(x: str, mn: str, mx: str, integral: bool) -> str:
    c = f"(greatest(greatest({mn}, 0), least({mx}, {x})) + 0.0)"
    return f"CAST(round_even({c}, 0) AS BIGINT)" if integral else f"round_even({c}, 1)"


def normal(seed, col):
    return sql_standard_normal(seed, f"num:{col}", "id")


def unif(seed, col):
    return sql_uniform(seed, f"num:{col}", "id")


def expo(seed, col):
    return sql_exponential(seed, f"num:{col}", "id")
