"""Column profile: base counts, numeric moments, exact percentiles, value counts, mode, binary flags.

Work plan for a table of C columns (whatever its size):
  * one wide aggregate for counts and moments of every column (map-side partial aggregation);
  * one long value-count table per type family: (column, value) -> count, one shuffle. Distinct counts,
    value counts, modes, cardinalities, binary flags and contract allowed lists all come from it;
  * exact percentiles and the ECDF from the numeric value counts by a bucketed prefix sum (no reducer
    holds a column's whole value map), then a broadcast join with the C x 18 target ranks.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletwin.functions.numeric import as_text, is_integral, is_numeric, nan_to_null, scalar_columns
from tabletwin.operators.rank import part_of, prefix_sum, split_points
from tabletwin.operators.topk import top_k_per_group
from tabletwin.session import cut_lineage

# Fixed values that must equal the reference: percentile levels, value-count cap, binary value sets.
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]
VALUE_COUNT_CAP = 100
BINARY_YES_NO = ("Yes", "No")
POSITIVE_VALUES = ("Yes", "1")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    position: int
    dtype: str
    kind: str  # numerical | categorical
    integral: bool


def column_specs(df: DataFrame, columns: list[str] | None = None) -> list[ColumnSpec]:
    cols = columns or scalar_columns(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for i, c in enumerate(cols):
        dt = fields[c]
        kind = "numerical" if is_numeric(dt) else "categorical"
        dtype = "timestamp" if isinstance(dt, T.TimestampNTZType) else dt.simpleString()
        out.append(ColumnSpec(c, i, dtype, kind, is_integral(dt)))
    return out


def _long(df: DataFrame, specs: list[ColumnSpec], value_expr) -> DataFrame:
    """Unpivot the given columns to (column, value), dropping NULLs."""
    if not specs:
        return None
    arr = F.array(*[F.struct(F.lit(s.name).alias("column_name"), value_expr(s).alias("value")) for s in specs])
    return df.select(F.inline(arr)).where(F.col("value").isNotNull())


def categorical_value_counts(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame | None:
    """(column, value string, count) for the categorical columns: the long count table."""
    cats = [s for s in specs if s.kind == "categorical"]
    fields = {f.name: f.dataType for f in df.schema.fields}
    long = _long(df, cats, lambda s: as_text(s.name, fields[s.name]))
    if long is None:
        return None
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def numeric_value_counts(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame | None:
    """(column, value double, count) for the numeric columns."""
    nums = [s for s in specs if s.kind == "numerical"]
    long = _long(df, nums, lambda s: F.col(s.name).cast("double"))
    if long is None:
        return None
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


class Profiler:
    """Profile of one DataFrame. Tables are built lazily and shared between the outputs."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, top_n: int = VALUE_COUNT_CAP,
                 percentile_buckets: int = 16):
        self.source = df
        self.specs = column_specs(df, columns)
        self.df = nan_to_null(df.select([s.name for s in self.specs]))
        self.top_n = top_n
        self.percentile_buckets = percentile_buckets
        self._cat_vc = None
        self._num_vc = None
        self._num_vc_kept = False
        self._num = None

    # -- tables ---------------------------------------------------------------------------------
    @property
    def num_specs(self):
        return [s for s in self.specs if s.kind == "numerical"]

    @property
    def cat_specs(self):
        return [s for s in self.specs if s.kind == "categorical"]

    def cat_value_counts(self) -> DataFrame | None:
        if self._cat_vc is None:
            self._cat_vc = categorical_value_counts(self.df, self.specs)
        return self._cat_vc

    def num_value_counts(self) -> DataFrame | None:
        if self._num_vc is None:
            self._num_vc = numeric_value_counts(self.df, self.specs)
        return self._num_vc

    def keep_value_counts(self) -> DataFrame | None:
        """One written copy of the numeric value counts, which all later outputs of this profiler read instead of the
        rows: for rounds of fits, and for profiles that follow them."""
        if not self._num_vc_kept and self.num_value_counts() is not None:
            self._num_vc, self._num_vc_kept = cut_lineage(self.num_value_counts()), True
        return self._num_vc

    def meta(self) -> DataFrame:
        """AG1: n_rows, n_columns, ordered column list."""
        names = ",".join(s.name for s in self.specs)
        return self.df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows", F.lit(len(self.specs)).alias("n_columns"), F.lit(names).alias("columns"))

    def base(self) -> DataFrame:
        """AG2/AG3: dtype, kind, n_total, n_missing, null_fraction, n_unique per column."""
        aggs = [F.count(F.lit(1)).alias("_n")]
        for s in self.specs:
            aggs.append(F.count(F.col(s.name)).alias(f"{s.position}"))
        row = self.df.agg(*aggs)
        arr = F.array(*[F.struct(F.lit(s.name).alias("column_name"), F.lit(s.position).alias("position"),
                                 F.lit(s.dtype).alias("dtype"), F.lit(s.kind).alias("type"),
                                 F.col("_n").alias("n_total"),
                                 (F.col("_n") - F.col(f"`{s.position}`")).alias("n_missing"))
                        for s in self.specs])
        base = row.select(F.inline(arr))
        base = base.withColumn("null_fraction", F.round(F.when(F.col("n_total") > 0,
                               F.col("n_missing") / F.col("n_total")), 6))
        uniq = []
        if self.cat_value_counts() is not None:
            uniq.append(self.cat_value_counts().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique")))
        if self.num_value_counts() is not None:
            # 64-bit integers and decimals are counted in their own type: doubles merge neighbours above 2^53
            wide = [x for x in self.num_specs if x.dtype == "bigint" or x.dtype.startswith("decimal")]
            names = [x.name for x in wide]
            uniq.append(self.num_value_counts().where(~F.col("column_name").isin(names) if names else F.lit(True))
                        .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique")))
            if wide:
                text = _long(self.df, wide, lambda x: F.col(f"`{x.name}`").cast("string"))
                uniq.append(text.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique")))
        if uniq:
            u = functools.reduce(DataFrame.unionByName, uniq)
            base = base.join(u, "column_name", "left")
        else:
            base = base.withColumn("n_unique", F.lit(None).cast("bigint"))
        return base.withColumn("n_unique", F.coalesce(F.col("n_unique"), F.lit(0)).cast("bigint"))

    def moment_rows(self) -> list[dict]:
        """AG4-AG7 without the median, per numeric column, as driver-side rows (one per column: bounded).

        Two aggregate passes: the mean of every column, then power sums of (x - mean) up to the 4th
        (moments about a shift near the mean are numerically stable, and plain sums aggregate far faster
        than Spark's online central-moment aggregates). Computed once per profiler."""
        if self._num is not None:
            return self._num
        nums = self.num_specs
        if not nums:
            self._num = []
            return self._num
        xs = {s.name: F.col(s.name).cast("double") for s in nums}
        first = self.df.agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(xs.values())]).first()
        aggs = []
        for i, (c, x) in enumerate(xs.items()):
            shift = first[f"c{i}"] if first[f"c{i}"] is not None else 0.0
            d = x - F.lit(float(shift))
            aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                     F.sum(d).alias(f"s1{i}"), F.sum(d * d).alias(f"s2{i}"), F.sum(d * d * d).alias(f"s3{i}"),
                     F.sum(d * d * d * d).alias(f"s4{i}")]
        r = self.df.agg(*aggs).first()
        rows = []
        for i, c in enumerate(xs):
            n = r[f"n{i}"]
            row = {"column_name": c, "n": n, "min": r[f"mn{i}"], "max": r[f"mx{i}"], "mean": None, "std": None,
                   "std_pop": None, "skewness": None, "kurtosis": None}
            if n:
                shift = first[f"c{i}"]
                a1, a2, a3, a4 = (r[f"s{k}{i}"] / n for k in (1, 2, 3, 4))
                m2 = max(a2 - a1 * a1, 0.0)
                m3 = a3 - 3 * a1 * a2 + 2 * a1 ** 3
                m4 = a4 - 4 * a1 * a3 + 6 * a1 * a1 * a2 - 3 * a1 ** 4
                row["mean"] = shift  # Spark's own avg (first pass)
                row["std_pop"] = m2 ** 0.5
                row["std"] = (m2 * n / (n - 1)) ** 0.5 if n > 1 else None
                if m2 > 0:
                    g1 = m3 / m2 ** 1.5
                    g2 = m4 / (m2 * m2) - 3.0
                    row["skewness"] = g1 * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 else None
                    row["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else None
            rows.append(row)
        self._num = rows
        return rows

    def moments(self) -> DataFrame:
        """The moment rows as a small local DataFrame (no rescan when joined)."""
        schema = ("column_name string, n bigint, min double, max double, mean double, std double, std_pop double, "
                  "skewness double, kurtosis double")
        rows = [tuple(r[k] for k in ("column_name", "n", "min", "max", "mean", "std", "std_pop", "skewness", "kurtosis"))
                for r in self.moment_rows()]
        return self.source.sparkSession.createDataFrame(rows, schema)

    def cumulative_counts(self) -> DataFrame:
        """(column, value, count, cum_lo, cum_hi, n): counts of values below / up to each distinct value.

        The prefix sum runs per (column, part), where the parts hold about equally many distinct values each, so
        neither a column nor a crowded range of it is one task. There are as many parts as shuffle partitions (at
        least ``percentile_buckets``), so they grow in number with the cluster's setting for the data.
        """
        vc = self.num_value_counts()
        parts = max(self.percentile_buckets, int(self.source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cuts = vc.groupBy("column_name").agg(split_points(parts).alias("_cuts"))
        mm = self.moments().select("column_name", "n").join(cuts, "column_name")
        d = vc.join(F.broadcast(mm), "column_name")  # one row per profiled column: size bounded by C
        return prefix_sum(d, F.col("count"), [F.col("value")], part_of(F.col("value"), F.col("_cuts")), group_cols=["column_name"]).drop("_cuts")

    def percentiles(self, levels=PERCENTILES) -> DataFrame:
        """AG8: exact linear-interpolation percentiles (numpy default), 6 dp, one column per level.

        Each level p needs the values at ranks floor(h) and floor(h) + 1, h = (n - 1) p / 100. The C x 2L
        target ranks (a broadcast table) are matched against the cumulative value counts, and one
        conditional aggregation per column picks and interpolates them."""
        mm = self.moments().select("column_name", "n").where(F.col("n") > 0)
        tgt = mm.select("column_name", F.explode(F.array(*[F.lit(float(p)) for p in levels])).alias("p"), "n")
        h = (F.col("n") - 1) * F.col("p") / 100.0
        r0 = F.floor(h).cast("bigint")
        ranks = tgt.select("column_name", "p", F.explode(F.array(
            F.struct(F.lit(0).alias("which"), r0.alias("r")),
            F.struct(F.lit(1).alias("which"), F.least(r0 + 1, F.col("n") - 1).alias("r")))).alias("t")) \
            .select("column_name", "p", "t.*")
        cum = self.cumulative_counts()
        hit = cum.join(F.broadcast(ranks), "column_name").where((F.col("cum_lo") <= F.col("r")) & (F.col("r") < F.col("cum_hi")))
        aggs = [F.first("n").alias("n")]
        for p in levels:
            for w in (0, 1):
                aggs.append(F.max(F.when((F.col("p") == float(p)) & (F.col("which") == w), F.col("value"))).alias(f"v{w}_{p}"))
        g = hit.groupBy("column_name").agg(*aggs)
        out = []
        for p in levels:
            hh = (F.col("n") - 1) * F.lit(float(p)) / 100.0
            frac = hh - F.floor(hh)
            v0, v1 = F.col(f"v0_{p}"), F.col(f"v1_{p}")
            out.append(F.round(v0 + (v1 - v0) * frac, 6).alias(f"p{int(p)}"))
        return g.select("column_name", *out)

    def numeric(self, percentiles: DataFrame | None = None) -> DataFrame:
        """AG4-AG7 with the median from the exact percentiles (``percentiles`` if they are at hand)."""
        med = (self.percentiles([50]) if percentiles is None else percentiles.select("column_name", "p50")).withColumnRenamed("p50", "median")
        return self.moments().join(med, "column_name", "left")

    def value_counts(self, top_n: int | None = None) -> DataFrame:
        """AG9/AG10: top values per categorical column, frequency over non-null rows, 6 dp."""
        k = top_n or self.top_n
        vc = self.cat_value_counts()
        tot = vc.groupBy("column_name").agg(F.sum("count").alias("_tot"))  # C rows
        vc = vc.join(F.broadcast(tot), "column_name").withColumn("frequency", F.round(F.col("count") / F.col("_tot"), 6)).drop("_tot")
        return top_k_per_group(vc, ["column_name"], [F.col("count").desc(), F.col("value").asc()], k, split_on=F.col("value"))

    def categorical(self) -> DataFrame:
        """AG11/AG12: cardinality, mode, mode frequency, binary flag, positive rate."""
        vc = self.cat_value_counts()
        agg = vc.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("cardinality"),
            F.sum("count").alias("_tot"),
            F.min_by(F.struct(F.col("value"), F.col("count")), F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))).alias("_m"),
            F.bool_and(F.col("value").isin(*BINARY_YES_NO)).alias("is_binary"),
            F.sum(F.when(F.col("value").isin(*POSITIVE_VALUES), F.col("count")).otherwise(0)).alias("_pos"),
        )
        out = agg.select(
            "column_name", "cardinality", F.col("_m.value").alias("mode"),
            F.round(F.col("_m.count") / F.col("_tot"), 6).alias("mode_frequency"),
            "is_binary",
            F.when(F.col("is_binary"), F.round(F.col("_pos") / F.col("_tot"), 6)).alias("positive_rate"))
        names = self.source.sparkSession.createDataFrame([(s.name,) for s in self.cat_specs], "column_name string")
        # columns with no non-null value still get a row (binary by the subset rule, no mode)
        return names.join(out, "column_name", "left").select(
            "column_name", F.coalesce("cardinality", F.lit(0)).cast("bigint").alias("cardinality"), "mode", "mode_frequency",
            F.coalesce("is_binary", F.lit(True)).alias("is_binary"), "positive_rate")

    def fits(self, candidates=None) -> DataFrame:
        """FT1-FT12: the chosen distribution per numeric column: dist_name, dist_params, aic, ks_statistic, ks_pvalue."""
        from tabletwin.operators.fit import CANDIDATES
        from tabletwin.operators.fit_all import fit_all, fits_table

        rows = [r for r in fit_all(self, candidates or CANDIDATES) if r["chosen"]]
        return fits_table(self.source.sparkSession, rows).select(
            "column_name", F.col("name").alias("dist_name"), F.col("params").alias("dist_params"), "aic", "ks_statistic", "ks_pvalue")

    def table(self, fits: DataFrame | None = None) -> DataFrame:
        """AG14: one row per column with every statistic (numeric fields NULL for categorical and back), with ``fits``
        (rows of ``fits()``) also the fitted distribution."""
        base = self.base()
        out = base
        if self.num_specs:
            levels = self.percentiles()  # asked for once: the median is one of them
            num = self.numeric(levels).drop("n", "std_pop")
            out = out.join(num, "column_name", "left").join(levels, "column_name", "left")
        if fits is not None:
            out = out.join(F.broadcast(fits), "column_name", "left")  # one row a column
        if self.cat_specs:
            out = out.join(self.categorical(), "column_name", "left")
        return out.orderBy("position")


def declared_numbers(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """AG13: statistics of columns read as numeric types that are declared for them, one row per column, one job for all:
    (column_name, declared, n, min, max, mean, n_bad, error). A column with a value that its type cannot take, or that is
    not in the table, gives the text of its first error (least value) and no statistics; the others are not touched by it.
    Nulls and NaN are missing."""
    have = set(df.columns)
    aggs, rows = [], []
    for i, (name, kind) in enumerate(types.items()):
        stats = {"n": "long", "min": "double", "max": "double", "mean": "double"}
        if name in have:
            raw = F.col(f"`{name}`")
            value = raw.try_cast(kind)
            number = F.when(~F.isnan(value.cast("double")), value.cast("double"))
            bad = F.when(raw.isNotNull() & value.isNull(), raw.cast("string"))
            aggs += [f(number).alias(f"{k}{i}") for k, f in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg))]
            aggs += [F.count(bad).alias(f"bad{i}"), F.min(bad).alias(f"first{i}")]
            n_bad, fine = F.col(f"bad{i}"), F.col(f"bad{i}") == 0
            text = F.concat(n_bad.cast("string"), F.lit(f" values are not {kind}, the first is "), F.col(f"first{i}"))
            cells = [F.when(fine, F.col(f"{k}{i}")).cast(t).alias(k) for k, t in stats.items()]
            error = F.when(~fine, text)
        else:
            n_bad, error = F.lit(0), F.lit("no such column")
            cells = [F.lit(None).cast(t).alias(k) for k, t in stats.items()]
        rows.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("declared"), *cells, n_bad.cast("long").alias("n_bad"), error.alias("error")))
    return df.agg(*(aggs or [F.count(F.lit(1)).alias("rows")])).select(F.inline(F.array(*rows)))
