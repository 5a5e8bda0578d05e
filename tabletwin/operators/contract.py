"""Data contract: learn per-column rules from a table and report every row that breaks one (CT1-CT15).

Learning is two aggregates (numeric min/max/null counts in one wide pass; distinct values of categorical
columns through the long (column, value) table). A contract is one long table: a column's rule fields, once for
every allowed value (once in all for columns without any). Allowed values are rows, so their number has no limit.
Checking is one narrow scan: each rule is a Column that is a violation struct or NULL, and
``explode(filter(array(...)))`` emits the violations. Membership is always tested: in allowed sets up to
``inline_limit`` values by an inline IN list, in larger ones by an anti-join on the distinct (column, value) pairs, so
no giant literal and no single task holds a big set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletwin.functions.numeric import as_text, is_integral, is_numeric, nan_to_null, scalar_columns

# Fixed value from the reference: numeric bounds widen by 10 % of the larger absolute bound.
RANGE_TOLERANCE = 0.10
INLINE_LIMIT = 1000

CONTRACT_SCHEMA = ("column_name string, position int, dtype string, nullable boolean, null_fraction double, "
                   "min double, max double, check_lower double, check_upper double, is_integer boolean, "
                   "cardinality bigint, allowed_value string")
RULE_FIELDS = ["column_name", "position", "dtype", "nullable", "null_fraction", "min", "max", "check_lower", "check_upper", "is_integer", "cardinality"]
VIOLATION_SCHEMA = "column_name string, check_name string, failure_case string, row_key string"


def allowed_values_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value): distinct non-null values of the categorical columns."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in (columns or scalar_columns(df)) if not is_numeric(fields[c])]
    if not cats:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(c, fields[c]).alias("value")) for c in cats])
    return df.select(F.inline(arr)).where(F.col("value").isNotNull()).distinct()


def learn(df: DataFrame, columns: Sequence[str] | None = None, tolerance: float = RANGE_TOLERANCE) -> DataFrame:
    """CT1-CT5: the contract's rows, bounds rounded to 6 dp (the saved form)."""
    cols = list(columns or scalar_columns(df))
    d = nan_to_null(df.select(cols))
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(c)).alias(f"c{i}"))
        if is_numeric(fields[c]):
            aggs += [F.min(F.col(c).cast("double")).alias(f"mn{i}"), F.max(F.col(c).cast("double")).alias(f"mx{i}")]
    row = d.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        num = is_numeric(fields[c])
        mn = F.col(f"mn{i}") if num else F.lit(None).cast("double")
        mx = F.col(f"mx{i}") if num else F.lit(None).cast("double")
        margin = F.greatest(F.abs(mn), F.abs(mx)) * F.lit(tolerance)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(i).alias("position"),
            F.lit("numeric" if num else "categorical").alias("dtype"),
            (F.col(f"c{i}") < F.col("_n")).alias("nullable"),
            F.round((F.col("_n") - F.col(f"c{i}")) / F.col("_n"), 6).alias("null_fraction"),
            F.round(mn, 6).alias("min"), F.round(mx, 6).alias("max"),
            F.round(mn - margin, 6).alias("check_lower"), F.round(mx + margin, 6).alias("check_upper"),
            (F.lit(is_integral(fields[c])) if num else F.lit(None).cast("boolean")).alias("is_integer")))
    base = row.select(F.inline(F.array(*structs)))
    vals = allowed_values_long(df, cols)
    card = vals.groupBy("column_name").agg(F.count(F.lit(1)).alias("cardinality"))  # one row per column
    # one row per column on the left: the allowed values are not moved
    out = base.join(card, "column_name", "left").withColumn(
        "cardinality", F.when(F.col("dtype") == "categorical", F.coalesce("cardinality", F.lit(0))).cast("bigint"))
    listed = vals.withColumnRenamed("value", "allowed_value").join(F.broadcast(out), "column_name")
    bare = out.where(F.coalesce("cardinality", F.lit(0)) == 0).withColumn("allowed_value", F.lit(None).cast("string"))
    return listed.select(*RULE_FIELDS, "allowed_value").unionByName(bare.select(*RULE_FIELDS, "allowed_value"))


def rules(contract: DataFrame) -> DataFrame:
    """One row per column: the contract without the allowed values."""
    return contract.select(*RULE_FIELDS).distinct()


def allowed_values_table(contract: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) rows of the allowed values of ``columns``."""
    return contract.where(F.col("column_name").isin(*columns) & F.col("allowed_value").isNotNull()).select(
        "column_name", F.col("allowed_value").alias("value"))


def save(contract: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: the contract as JSON lines (``mode='ignore'`` skips a finished stage, SNK6)."""
    contract.write.mode(mode).json(path)


def load(spark, path: str) -> DataFrame:
    """CT6/SRC4: read a saved contract back with its schema."""
    return spark.read.schema(CONTRACT_SCHEMA).json(path)


def _num_check_name(lo, hi) -> str:
    return f"in_range({lo:.6f}, {hi:.6f})"


def check(df: DataFrame, contract: DataFrame, row_key: str, inline_limit: int = INLINE_LIMIT,
          lazy: bool = True, include_missing: bool = True) -> DataFrame:
    """CT7-CT14: violations (column_name, check, failure_case, row_key) of ``df`` against ``contract``.

    Extra columns are allowed (strict=False). ``lazy=False`` keeps only the first violation (CT14).
    """
    spark = df.sparkSession
    # rules are one row per column; of the lists only those of at most ``inline_limit`` values come to the driver
    ordered = rules(contract).orderBy("position").collect()
    short = [r["column_name"] for r in ordered if r["cardinality"] and r["cardinality"] <= inline_limit]
    lists: dict[str, list[str]] = {c: [] for c in short}
    for r in allowed_values_table(contract, short).collect() if short else []:
        lists[r["column_name"]].append(r["value"])
    fields = {f.name: f.dataType for f in df.schema.fields}
    key = F.col(row_key).cast("string")
    viol: list[Column] = []
    missing = []
    big = []
    for r in ordered:
        c = r["column_name"]
        if c not in fields:
            missing.append((c, "column_in_dataframe", c, None))
            continue
        x = F.col(c)
        if isinstance(fields[c], (T.FloatType, T.DoubleType)):
            x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
        mk = lambda chk, case: F.struct(F.lit(c).alias("column_name"), F.lit(chk).alias("check_name"),
                                        case.cast("string").alias("failure_case"), key.alias("row_key"))
        if not r["nullable"]:
            viol.append(F.when(x.isNull(), mk("not_nullable", F.lit(None))))
        if r["dtype"] == "numeric":
            v = x.cast("double") if is_numeric(fields[c]) else F.expr(f"try_cast(`{c}` AS DOUBLE)")
            target = "int64" if r["is_integer"] else "float64"
            if not is_numeric(fields[c]):
                viol.append(F.when(x.isNotNull() & v.isNull(), mk(f"coerce_dtype('{target}')", x)))
            lo, hi = r["check_lower"], r["check_upper"]
            if lo is not None and hi is not None:
                bad = v.isNotNull() & ~v.between(F.lit(lo), F.lit(hi))
                viol.append(F.when(bad, mk(_num_check_name(lo, hi), F.format_string("%.6f", v))))
        else:
            s = as_text(c, fields[c])
            if r["cardinality"] and r["cardinality"] > 0:
                if c in lists:
                    viol.append(F.when(s.isNotNull() & ~s.isin(*sorted(lists[c])), mk("isin", s)))
                else:
                    big.append(c)
    out = None
    if viol:
        arr = F.filter(F.array(*viol), lambda e: e.isNotNull())
        src = df
        out = src.select(F.explode(arr).alias("v")).select("v.*")
    if big:
        # Large allowed sets, checked without putting a hot value in one task: distinct (column, value)
        # pairs first (map-side combine collapses a value that fills a third of the table), anti-join them
        # with the allowed list (both sides distinct), then attach the row keys of the few bad values.
        allowed = allowed_values_table(contract, big)
        arr = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(c, fields[c]).alias("value"), key.alias("row_key"))
                        for c in big])
        pairs = df.select(F.inline(arr)).where(F.col("value").isNotNull())
        if df.isStreaming:
            # a micro-batch against the static allowed list (stream-static anti-join)
            bad = pairs.join(allowed, ["column_name", "value"], "left_anti")
        else:
            bad_vals = pairs.select("column_name", "value").distinct().join(allowed, ["column_name", "value"], "left_anti")
            bad = pairs.join(bad_vals, ["column_name", "value"], "left_semi")
        bad = bad.select("column_name", F.lit("isin").alias("check_name"), F.col("value").alias("failure_case"), "row_key")
        out = bad if out is None else out.unionByName(bad)
    if missing and include_missing:
        m = spark.createDataFrame(missing, VIOLATION_SCHEMA)
        out = m if out is None else m.unionByName(out)
    if out is None:
        out = spark.createDataFrame([], VIOLATION_SCHEMA)
    if not lazy:
        out = out.orderBy("column_name", "check_name", "row_key", "failure_case").limit(1)
    return out


def summary(violations: DataFrame) -> DataFrame:
    """CT15: violations per (column, check); ``report_lines`` lists the first of them."""
    return violations.groupBy("column_name", "check_name").agg(F.count(F.lit(1)).alias("n_violations"))


def report_lines(violations: DataFrame, show: int = 50) -> DataFrame:
    """CT15: the first ``show`` violations (ordered) as numbered lines, plus an 'and N more' line."""
    from pyspark.sql import Window
    ordered = violations.orderBy("column_name", "check_name", "row_key").limit(show)
    w = Window.orderBy("column_name", "check_name", "row_key")  # at most ``show`` rows
    lines = ordered.withColumn("n", F.row_number().over(w).cast("bigint")).select(
        "n", F.format_string("%3d. Column: %-30s  Check: %s", "n", "column_name", "check_name").alias("line"))
    total = violations.agg(F.count(F.lit(1)).alias("t"))
    more = total.where(F.col("t") > show).select(
        F.lit(show + 1).cast("bigint").alias("n"), F.format_string("  ... and %d more.", F.col("t") - show).alias("line"))
    return lines.unionByName(more)


def missing_columns(df: DataFrame, contract: DataFrame) -> DataFrame:
    """CT7 alone: one row per contract column absent from ``df`` (a schema check, no data scan)."""
    have = set(df.columns)
    rows = [(r["column_name"], "column_in_dataframe", r["column_name"], None)
            for r in rules(contract).orderBy("position").collect() if r["column_name"] not in have]
    return df.sparkSession.createDataFrame(rows, VIOLATION_SCHEMA)
