"""Small helpers that spell the oracle SQL (DuckDB dialect) for per-column statistics."""

from __future__ import annotations


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def text_sql(col: str, dtype: str) -> str:
    """DuckDB form of ``tabletwin.functions.numeric.as_text``."""
    if dtype.startswith("timestamp"):
        return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"
    if dtype == "date":
        return f"strftime({col}, '%Y-%m-%d')"
    return f"CAST({col} AS VARCHAR)"


def value_counts_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """(column, value, count) over categorical columns [(name, dtype)]."""
    return union_all([
        f"SELECT '{c}' AS column_name, {text_sql(c, t)} AS value, count(*) AS count FROM {src} WHERE {c} IS NOT NULL GROUP BY 1, 2"
        for c, t in cols])


def numeric_stats_sql(src: str, cols: list[str]) -> str:
    return union_all([
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(min({c}::DOUBLE), 6) AS min, round(max({c}::DOUBLE), 6) AS max,
  round(avg({c}::DOUBLE), 6) AS mean, round(median({c}::DOUBLE), 6) AS median, round(stddev_samp({c}::DOUBLE), 6) AS std,
  round(skewness({c}::DOUBLE), 6) AS skewness, round(kurtosis({c}::DOUBLE), 6) AS kurtosis FROM {src}"""
        for c in cols])


PCT = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def percentiles_sql(src: str, cols: list[str]) -> str:
    return union_all([
        f"SELECT '{c}' AS column_name, " + ", ".join(
            f"round(quantile_cont({c}::DOUBLE, {p / 100}), 6) AS p{p}" for p in PCT) + f" FROM {src}"
        for c in cols])


def base_sql(src: str, cols: list[tuple[str, str, str]]) -> str:
    """cols: [(name, dtype, kind)] in position order."""
    parts = []
    for i, (c, t, k) in enumerate(cols):
        parts.append(
            f"""SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, '{k}' AS type, count(*) AS n_total,
  count(*) - count({c}) AS n_missing, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_fraction,
  count(DISTINCT {text_sql(c, t) if k == 'categorical' else c + '::DOUBLE'}) AS n_unique FROM {src}""")
    return union_all(parts)


def categorical_sql(src: str, cols: list[tuple[str, str]]) -> str:
    vc = value_counts_sql(src, cols)
    return f"""SELECT column_name, count(*) AS cardinality,
  arg_min(value, (-count, value)) AS mode,
  round(max(count)::DOUBLE / sum(count), 6) AS mode_frequency,
  bool_and(value IN ('Yes', 'No')) AS is_binary,
  CASE WHEN bool_and(value IN ('Yes', 'No')) THEN round(sum(CASE WHEN value IN ('Yes', '1') THEN count ELSE 0 END)::DOUBLE / sum(count), 6) END AS positive_rate
FROM ({vc}) GROUP BY column_name"""


def top_values_sql(src: str, cols: list[tuple[str, str]], k: int) -> str:
    vc = value_counts_sql(src, cols)
    return f"""SELECT column_name, value, count, frequency, rank FROM (
  SELECT column_name, value, count, round(count::DOUBLE / sum(count) OVER (PARTITION BY column_name), 6) AS frequency,
    row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS rank
  FROM ({vc})) WHERE rank <= {k}"""
