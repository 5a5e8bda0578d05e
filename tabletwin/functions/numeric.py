"""Numeric Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SCALAR_TYPES = NUMERIC_TYPES + (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    """pandas' ``is_numeric_dtype``: numbers and booleans are numerical."""
    return isinstance(dt, NUMERIC_TYPES + (T.BooleanType,))


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES + (T.BooleanType,))


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that can be profiled as scalars (arrays, maps and structs are left out)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, SCALAR_TYPES)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing marker; Spark has NULL and NaN. Turn float NaN into NULL (hazard H1)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.col(f.name).cast("int").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def as_text(col: str, dt: T.DataType) -> Column:
    """String form of a value for value counts and allowed lists (timestamps in one fixed format)."""
    c = F.col(col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def clip(c: Column, lo, hi) -> Column:
    """greatest(lo, least(hi, c)); either bound may be None."""
    if hi is not None:
        c = F.least(c, hi if isinstance(hi, Column) else F.lit(float(hi)))
    if lo is not None:
        c = F.greatest(c, lo if isinstance(lo, Column) else F.lit(float(lo)))
    return c


def sample_skewness(n: Column, pop_skew: Column) -> Column:
    """Bias-corrected skewness (pandas ``skew``) from Spark's population skewness g1."""
    return F.when(n > 2, pop_skew * F.sqrt(n * (n - 1)) / (n - 2))


def sample_excess_kurtosis(n: Column, pop_kurt: Column) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurt``) from Spark's population excess kurtosis g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * pop_kurt + 6))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (presentation / oracle comparison; hazards H2, H3)."""
    return df.select([F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                      else F.col(f.name) for f in df.schema.fields])


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in double arithmetic: the same bits in every IEEE engine (display rounding)."""
    s = float(10 ** digits)
    return F.floor(c * F.lit(s) + F.lit(0.5)) / F.lit(s)


def sql_round_half_up(x: str, digits: int) -> str:
    return f"(floor(({x}) * {float(10 ** digits)} + 0.5) / {float(10 ** digits)})"
