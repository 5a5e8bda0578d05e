"""Mergeable quantile sketches (AG8 beyond the size where exact percentiles are wanted).

One KLL sketch per numeric column, made with partial aggregation, so a shuffle carries a few kilobytes per task and
column instead of value counts as long as the data. Sketches are rows of a table: kept as an artifact, and merged with
those of later data without reading the earlier data again. A quantile read from a sketch has a rank within
``RANK_ERROR`` of the wanted one (as a share of the rows; KLL's bound for this size is a third of that at 99 %).

Cases: NaN counts as null; a column without values has n = 0 and null quantiles; merging tables of no rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletwin.functions.numeric import is_numeric, nan_to_null
from tabletwin.operators.profile import PERCENTILES

#: Size of a sketch (larger: more exact) and the rank error that it is held to.
SIZE = 1000
RANK_ERROR = 0.01


def sketches(df: DataFrame, columns: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """(column_name, n, sketch) of the numeric columns: one aggregate."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in columns or df.columns if is_numeric(fields[c])]
    d = nan_to_null(df.select(*[F.col(f"`{c}`") for c in cols]))
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    row = d.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x)], *[F.kll_sketch_agg_double(v, F.lit(size)).alias(f"s{i}") for i, v in enumerate(x)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])))


def merged(tables: DataFrame, size: int = SIZE) -> DataFrame:
    """One sketch per column from the rows of several sketch tables."""
    return tables.groupBy("column_name").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantile(p: float) -> Column:
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))


def percentiles(table: DataFrame, levels=PERCENTILES) -> DataFrame:
    """(column_name, n, p<level>...) from a sketch table, without the data."""
    return table.select("column_name", "n", *[quantile(p / 100.0).alias(f"p{int(p)}") for p in levels])


def rank_errors(df: DataFrame, table: DataFrame, levels=PERCENTILES) -> DataFrame:
    """(column_name, level, value, rank_error) of a sketch table against the exact ranks in ``df``: how far the wanted rank
    lies outside the ranks that the value takes, as a share of the rows."""
    read = table.where("n > 0").select("column_name", "n", F.explode(F.array(*[
        F.struct(F.lit(int(p)).alias("level"), quantile(p / 100.0).alias("value")) for p in levels])).alias("q")).select("column_name", "n", "q.*")
    wanted = {}
    for r in read.collect():  # columns x levels numbers
        wanted.setdefault(r.column_name, []).append(r)
    aggs = [f(F.when(cond, 1)).alias(f"{tag}{i}_{r.level}") for i, (c, rows) in enumerate(wanted.items()) for r in rows
            for f, cond, tag in ((F.count, F.col(f"`{c}`").cast("double") < r.value, "a"), (F.count, F.col(f"`{c}`").cast("double") <= r.value, "b"))]
    if not aggs:
        return df.sparkSession.createDataFrame([], "column_name string, level int, value double, rank_error double")
    exact = nan_to_null(df.select(*[F.col(f"`{c}`") for c in wanted])).agg(*aggs)
    out = [F.struct(F.lit(c).alias("column_name"), F.lit(r.level).alias("level"), F.lit(r.value).alias("value"), F.greatest(
        F.lit(0.0), F.col(f"a{i}_{r.level}") / r.n - r.level / 100.0, r.level / 100.0 - F.col(f"b{i}_{r.level}") / r.n).alias("rank_error"))
        for i, (c, rows) in enumerate(wanted.items()) for r in rows]
    return exact.select(F.inline(F.array(*out)))
