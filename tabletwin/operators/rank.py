"""Order-based primitives that never put a whole table in one task.

* ``prefix_sum``: running sum of a weight in a total order. Rows get a bucket that is monotone in the
  order; per-bucket totals (one small row per bucket) give each bucket its offset; the running sum then
  runs inside each bucket's window partition. One shuffle of the data, no single-partition window.
* ``global_rank``: a uniformly random permutation 0..n-1 of the rows (bucket = floor(u*B), order (u, id)).
* ``exact_sample``: exactly ``n`` rows, chosen by the permutation rank.
* ``draw_from_pool``: inverse-CDF draw of one pool row per draw row, as an equi-join on draw buckets
  plus a range filter on integer cumulative weights (exact in every engine).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletwin.functions.rng import uniform


#: Pools of at most this many rows are broadcast to the draws.
BROADCAST_POOL = 200_000


def buckets_for(n_rows: int, rows_per_bucket: int = 250_000, lo: int = 16, hi: int = 1 << 16) -> int:
    """Bucket count so a bucket's window partition stays a few hundred thousand rows."""
    return int(max(lo, min(hi, n_rows // rows_per_bucket + 1)))


def split_points(buckets: int):
    """Aggregate: values that cut the column ``value`` into about ``buckets`` parts with equally many rows each,
    wherever they lie (an outlier takes no more than its own part)."""
    levels = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx("value", levels, max(10_000, 20 * buckets))


def part_of(value: Column, splits: Column) -> Column:
    """Number of split points at or below the value: a bucket that never falls as the value grows."""
    return F.size(F.filter(splits, lambda s: s <= value))


def prefix_sum(
    df: DataFrame,
    weight: Column,
    order_cols: Sequence,
    bucket: Column | None,
    group_cols: Sequence[str] = (),
    lo_col: str = "cum_lo",
    hi_col: str = "cum_hi",
    total_col: str | None = None,
) -> DataFrame:
    """Add ``[lo_col, hi_col)``: the running weight before and after each row, per ``group_cols``.

    ``bucket`` must be non-decreasing in ``order_cols`` (within a group) for the result to follow that
    order. The per-(group, bucket) totals table has groups x buckets rows; Spark's adaptive planner
    broadcasts it when it is small and shuffles it otherwise.
    """
    g = list(group_cols)
    if bucket is None:
        # one window per group: only for tables known to be small (pools of at most a few hundred rows)
        d = df.withColumn("_tt_w", weight)
        run = Window.partitionBy(*g).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn(hi_col, F.sum("_tt_w").over(run)).withColumn(lo_col, F.col(hi_col) - F.col("_tt_w"))
        if total_col:
            d = d.withColumn(total_col, F.sum("_tt_w").over(Window.partitionBy(*g)))
        return d.drop("_tt_w")
    d = df.withColumn("_tt_b", bucket).withColumn("_tt_w", weight)
    tot = d.groupBy(*g, "_tt_b").agg(F.sum("_tt_w").alias("_tt_bt"))
    before = Window.partitionBy(*g).orderBy("_tt_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_tt_off", F.coalesce(F.sum("_tt_bt").over(before), F.lit(0)))
    if total_col:
        off = off.withColumn(total_col, F.sum("_tt_bt").over(Window.partitionBy(*g)))
    off = off.drop("_tt_bt")
    d = d.join(off, [*g, "_tt_b"])
    run = Window.partitionBy(*g, "_tt_b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(hi_col, F.col("_tt_off") + F.sum("_tt_w").over(run))
    d = d.withColumn(lo_col, F.col(hi_col) - F.col("_tt_w"))
    return d.drop("_tt_b", "_tt_w", "_tt_off")


def global_rank(df: DataFrame, u: Column, id_col: str, n_buckets: int, rank_col: str = "rank") -> DataFrame:
    """0-based rank of each row in the order (u, id). With u a fresh draw this is a random permutation."""
    d = df.withColumn("_tt_u", u)
    b = F.least(F.floor(F.col("_tt_u") * n_buckets), F.lit(n_buckets - 1)).cast("int")
    d = prefix_sum(d, F.lit(1).cast("bigint"), [F.col("_tt_u"), F.col(id_col)], b, lo_col=rank_col, hi_col="_tt_hi")
    return d.drop("_tt_u", "_tt_hi")


def exact_sample(df: DataFrame, n: int, seed: int = 42, key: str | None = None, salt: str = "sample") -> DataFrame:
    """Exactly ``min(n, count)`` rows, the same ones whatever the partitioning (AG17, FD7, SRC3): the rows
    whose (u, key) is below the cut point at rank n. No row is shuffled except those of one bucket.

    ``key`` must be unique per row (a business key); without one, a row hash of all columns is used.
    """
    if key is None:
        return _sample_rows(df, n, seed, salt)
    total = df.count()
    if n >= total:
        return df
    u = uniform(seed, salt, key)
    cut = rank_cut_points(df, u, key, [n], buckets_for(total)).get(n)
    return df.where(below(u, key, cut))


def _sample_rows(df: DataFrame, n: int, seed: int, salt: str) -> DataFrame:
    """Exactly ``min(n, count)`` rows of a table without a key, by the hash of all columns. Equal rows tie; of the
    rows equal to the one at the cut, as many as are still wanted are taken (it does not matter which)."""
    d = df.withColumn("_tt_key", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    total = d.count()
    if n >= total:
        return df
    u = uniform(seed, salt, "_tt_key")
    cut = rank_cut_points(d, u, "_tt_key", [n], buckets_for(total)).get(n)
    less = d.where(below(u, "_tt_key", cut))
    want = n - less.count()
    at_cut = d.where((u == F.lit(cut[0])) & (F.col("_tt_key") == F.lit(cut[1]))).withColumn("_tt_at", F.monotonically_increasing_id())
    if want <= 0:
        return less.drop("_tt_key")
    # one count per partition: the partitions before the last wanted row are taken whole
    per = at_cut.groupBy(F.shiftright("_tt_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect()
    last = 0
    for r in per:
        last = (r["p"] << 33) + min(want, r["c"])
        want -= min(want, r["c"])
        if want == 0:
            break
    return less.drop("_tt_key").unionByName(at_cut.where(F.col("_tt_at") < last).drop("_tt_key", "_tt_at"))


def draw_from_pool(
    draws: DataFrame,
    u: Column,
    pool: DataFrame,
    weight_col: str,
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    pool_bucket: Column | None = None,
    n_draw_buckets: int = 256,
    pool_rows: int | None = None,
) -> DataFrame:
    """Attach to every draw row one pool row, chosen with probability weight / total weight.

    Weights are integers (counts), so the cumulative bounds and the target ``floor(u * W)`` are exact.
    The pool is cut into ``[lo, hi)`` intervals; each interval is repeated over the draw buckets it
    covers (at most pool rows + draw buckets rows), and the draws join it on their bucket, so neither a
    heavy pool value nor a large pool lands in one task. A pool known to have at most ``BROADCAST_POOL``
    rows is broadcast: the draws are then neither moved nor gathered.
    """
    bucket = pool_bucket  # None: a small pool, one running window (no offsets join)
    p = pool.where(F.col(weight_col) > 0).select(*value_cols, weight_col, *[c for c in order_cols if c not in value_cols])
    p = prefix_sum(p, F.col(weight_col).cast("bigint"), [F.col(c) for c in order_cols], bucket, total_col="_tt_total")
    D = int(n_draw_buckets)
    lo_b = F.greatest(F.floor(F.col("cum_lo") / F.col("_tt_total") * D) - 1, F.lit(0))
    hi_b = F.least(F.floor(F.col("cum_hi") / F.col("_tt_total") * D) + 1, F.lit(D - 1))
    p = p.select(*value_cols, "cum_lo", "cum_hi", "_tt_total", F.explode(F.sequence(lo_b.cast("int"), hi_b.cast("int"))).alias("_tt_d"))
    d = draws.withColumn("_tt_u", u).withColumn("_tt_d", F.least(F.floor(F.col("_tt_u") * D), F.lit(D - 1)).cast("int"))
    if pool_rows is not None and pool_rows <= BROADCAST_POOL:
        p = F.broadcast(p)
    j = d.join(p, "_tt_d")
    k = F.floor(F.col("_tt_u") * F.col("_tt_total"))
    j = j.where((k >= F.col("cum_lo")) & (k < F.col("cum_hi")))
    return j.drop("_tt_d", "_tt_u", "cum_lo", "cum_hi", "_tt_total")


def rank_cut_points(df: DataFrame, u: Column, id_col: str, ranks: Sequence[int], n_buckets: int) -> dict[int, tuple]:
    """For each 0-based rank r < n, the (u, id) of the row at rank r in the order (u, id), without ranking
    every row: (1) rows per bucket floor(u*B) (B numbers to the driver), (2) a row_number window over only
    the buckets that contain a wanted rank (about n/B rows each), keeping the wanted positions.
    Rows ranked below r are exactly those with (u, id) < cut[r]."""
    B = int(n_buckets)
    d = df.select(u.alias("_tt_u"), F.col(id_col).alias("_tt_id"))
    d = d.withColumn("_tt_b", F.least(F.floor(F.col("_tt_u") * B), F.lit(B - 1)).cast("int"))
    counts = {r["_tt_b"]: r["c"] for r in d.groupBy("_tt_b").agg(F.count(F.lit(1)).alias("c")).collect()}
    before, acc = {}, 0
    for b in range(B):
        before[b] = acc
        acc += counts.get(b, 0)
    total = acc
    want = {}
    for r in ranks:
        if r < 0 or r >= total:
            continue
        b = max(bb for bb in range(B) if before[bb] <= r and counts.get(bb, 0) > 0)
        want.setdefault(b, set()).add(r - before[b] + 1)
    if not want:
        return {}
    sel = d.where(F.col("_tt_b").isin(list(want)))
    w = Window.partitionBy("_tt_b").orderBy("_tt_u", "_tt_id")
    sel = sel.withColumn("_tt_rn", F.row_number().over(w))
    cond = None
    for b, pos in want.items():
        c = (F.col("_tt_b") == b) & F.col("_tt_rn").isin(sorted(pos))
        cond = c if cond is None else (cond | c)
    rows = sel.where(cond).select("_tt_b", "_tt_rn", "_tt_u", "_tt_id").collect()  # one row per wanted rank
    cut = {before[r["_tt_b"]] + r["_tt_rn"] - 1: (r["_tt_u"], r["_tt_id"]) for r in rows}
    return {r: cut[r] for r in ranks if r in cut}


def below(u: Column, id_col: str, cut: tuple | None) -> Column:
    """(u, id) < cut, lexicographically; no cut (rank beyond the table) means every row."""
    if cut is None:
        return F.lit(True)
    cu, cid = cut
    return (u < F.lit(cu)) | ((u == F.lit(cu)) & (F.col(id_col) < F.lit(cid)))
