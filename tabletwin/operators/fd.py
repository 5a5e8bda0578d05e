"""Functional dependency mining (FD1-FD13).

Confidence of ``lhs -> rhs`` = share of lhs groups (rows with a NULL in lhs dropped) whose rhs has exactly
one distinct non-null value. Plan:

1. Candidates (FD1): HyperLogLog distinct counts for all columns in one pass; exact distinct counts only
   for columns whose estimate leaves the verdict open. There is no upper limit on distinct values unless one is given.
2. Values become 64-bit codes of their own type (integers as they are, other types by a 64-bit hash), so
   grouping is a hash aggregation and no number goes through double.
3. lhs sets go in batches: each row is expanded once per set of the batch to (set id, key codes, all rhs
   codes) and grouped by (set id, keys) with min/max of every rhs. The map-side partial aggregate reduces
   every partition to its distinct keys before the shuffle.
4. Per set: n_groups and the number of groups with min = max, per rhs. The result has C^2 rows.
5. ``discover`` goes level by level (``levelwise``): pairs that follow from a smaller exact set are not counted, and pairs
   that a sample of rows, or one in ``GROUP_PARTS`` of a set's groups, already contradicts are not counted in full.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletwin.functions.numeric import nan_to_null, scalar_columns
from tabletwin.session import cut_lineage

# Fixed values from the reference's settings.
DEFAULT_THRESHOLD = 0.95
EXACT_EPS = 1e-9
MAX_DISTINCT = 500  # the reference's limit; discovery has none unless it is passed
UNIQUE_RATIO = 0.95
DEFAULT_MAX_LHS = 1
SAMPLE_ROWS = 100_000
#: One in so many groups of a set is looked at whole before all are counted: more than this times the allowed share of mixed
#: groups there rules a pair out.
GROUP_PARTS = 8


def _code(column: str, kind: T.DataType):
    """The value as a 64-bit code: equal values, and no others, have equal codes (up to hash collisions of
    non-integers); NULL stays NULL."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return c.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # -0.0 and 0.0 are one value
    return F.when(c.isNotNull(), F.xxhash64(c))


def _coded(df: DataFrame, cols: list[str]) -> DataFrame:
    d = nan_to_null(df.select([F.col(f"`{c}`") for c in cols]))
    fields = {f.name: f.dataType for f in d.schema.fields}
    return d.select(*[_code(c, fields[c]).alias(c) for c in cols])


def _distinct_counts(coded: DataFrame, cols: Sequence[tuple[int, str]]) -> dict[int, int]:
    """Distinct non-null codes of each (number, column), as distinct (number, code) pairs."""
    pairs = coded.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in cols]))).where("v IS NOT NULL").distinct()
    return {r["i"]: r["k"] for r in pairs.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}  # one row per column


def _scan_candidates(df: DataFrame, cols: list[str], max_distinct: int | None, unique_ratio: float):
    """(n_rows, rows of (column, position, n_unique, is_candidate)). HyperLogLog estimates (5 % error) settle
    columns that are far from every limit; the others are counted exactly as distinct (column, code) pairs."""
    d = _coded(df, cols)
    est = d.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    n = est["_n"]
    top = 1.3 * unique_ratio * n if max_distinct is None else 2 * max_distinct
    near = [(i, c) for i, c in enumerate(cols) if est[f"e{i}"] <= top]
    exact = _distinct_counts(d, near) if near else {}
    rows = []
    for i, c in enumerate(cols):
        k = exact.get(i, 0) if any(j == i for j, _ in near) else None
        ok = k is not None and 1 < k < unique_ratio * n and (max_distinct is None or k <= max_distinct)
        rows.append((c, i, k, bool(ok)))
    return n, rows


def candidate_table(df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int | None = None,
                    unique_ratio: float = UNIQUE_RATIO) -> DataFrame:
    """FD1: (column_name, position, n_unique, is_candidate). n_unique is exact where it decides the outcome,
    NULL for columns whose estimate is far above the limits (they are not candidates either way)."""
    cols = list(columns or scalar_columns(df))
    _, rows = _scan_candidates(df, cols, max_distinct, unique_ratio)
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, n_unique bigint, is_candidate boolean")


CONF_SCHEMA = "lhs array<string>, rhs string, confidence double, n_groups bigint, lhs_order int, rhs_pos int"


def _expanded(coded: DataFrame, batch, rhs: Sequence[str], pos: dict[str, int], k: int, parts: int = 1) -> DataFrame:
    """(sid, k0.., r of every ``rhs``): each row once per set of the batch, without null keys; ``r`` is null where the set
    doesn't ask for it, so it takes no room in the shuffle. ``parts``: only whole groups, one in so many by their hash."""
    one = lambda i, s, r: F.struct(F.lit(i).alias("sid"), *[F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(s)], *[
        (F.col(f"`{c}`") if c in r else F.lit(None).cast("bigint")).alias(f"r{pos[c]}") for c in rhs])
    rows = F.array(*[one(*w) for w in batch])
    if parts > 1:
        rows = F.filter(rows, lambda e: F.pmod(F.xxhash64(e["sid"], *[e[f"k{j}"] for j in range(k)]), F.lit(parts)) == 0)
    return coded.select(F.explode(rows).alias("_s")).select("_s.*").where(" AND ".join(f"k{j} IS NOT NULL" for j in range(k)))


def measure(coded: DataFrame, wanted: Sequence[tuple[int, Sequence[str], Sequence[str]]], cands: Sequence[str],
            batch_size: int = 8) -> DataFrame:
    """(sid, rhs_pos, n_groups, n_det) of ``wanted`` (set id, lhs set, rhs columns): lhs sets of one size go in batches,
    one scan per batch. ``n_det`` counts the groups with exactly one distinct non-null rhs."""
    spark = coded.sparkSession
    pos = {c: i for i, c in enumerate(cands)}
    parts = []
    for k in sorted({len(s) for _, s, _ in wanted}):
        of_size = [w for w in wanted if len(w[1]) == k]
        for b in range(0, len(of_size), batch_size):
            batch = of_size[b:b + batch_size]
            rhs = [c for c in cands if any(c in r for _, _, r in batch)]
            x = _expanded(coded, batch, rhs, pos, k)
            keys = ["sid"] + [f"k{j}" for j in range(k)]
            g = x.groupBy(*keys).agg(*[(F.min(f"r{pos[c]}") == F.max(f"r{pos[c]}")).alias(f"d{pos[c]}") for c in rhs])
            per = g.groupBy("sid").agg(F.count(F.lit(1)).alias("n_groups"), *[
                F.sum(F.coalesce(F.col(f"d{pos[c]}"), F.lit(False)).cast("int")).alias(f"d{pos[c]}") for c in rhs])
            parts.append(per.select("sid", "n_groups", F.inline(F.array(*[
                F.struct(F.lit(pos[c]).alias("rhs_pos"), F.col(f"d{pos[c]}").alias("n_det")) for c in rhs]))))
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    # (set id, rhs) grid: sets x C short rows, built on the driver from the candidate list
    grid = spark.createDataFrame([(i, list(s), c, pos[c]) for i, s, r in wanted for c in r], "sid int, lhs array<string>, rhs string, rhs_pos int")
    return grid.join(per, ["sid", "rhs_pos"])


def _sets(cands: Sequence[str], max_lhs: int) -> list[tuple[str, ...]]:
    return [s for k in range(1, max_lhs + 1) for s in itertools.combinations(cands, k)]


def confidences(df: DataFrame, candidates: Sequence[str], max_lhs: int = DEFAULT_MAX_LHS,
                batch_size: int = 8) -> DataFrame:
    """(lhs array<string>, rhs, confidence, n_groups, lhs_order, rhs_pos) for every lhs set of size
    1..max_lhs over ``candidates`` and every rhs not in the set. Unrounded confidence."""
    cands = list(candidates)
    wanted = [(i, s, [c for c in cands if c not in s]) for i, s in enumerate(_sets(cands, max_lhs))]
    wanted = [w for w in wanted if w[2]]
    if not wanted:
        return df.sparkSession.createDataFrame([], CONF_SCHEMA)
    out = measure(_coded(df, cands), wanted, cands, batch_size)
    return out.select("lhs", "rhs", (F.col("n_det") / F.col("n_groups")).alias("confidence"), "n_groups",
                      F.col("sid").alias("lhs_order"), "rhs_pos")


@dataclass
class Lattice:
    """What a levelwise search did: sets whose groups were counted over the whole table, sets judged on the sample, and
    pairs that followed from smaller sets or were ruled out by the sample."""

    counted_sets: int = 0
    sampled_sets: int = 0
    implied_pairs: int = 0
    ruled_out_pairs: int = 0


def levelwise(df: DataFrame, candidates: Sequence[str], max_lhs: int, threshold: float = DEFAULT_THRESHOLD, batch_size: int = 8,
              sample_rows: int = SAMPLE_ROWS, done: Lattice | None = None, distinct: dict[str, int] | None = None) -> DataFrame:
    """The pairs of ``confidences`` that reach ``threshold``, level by level, with two exact short cuts:

    * if a set determines a column exactly, so does every larger set, as long as neither the column nor the columns
      added hold nulls: such a pair needs no count (its ``n_groups`` is null);
    * a group with two values in a sample of rows has two in the table, and the table has no more groups than rows nor
      than the product of the columns' distinct values. So the sample's mixed groups bound the confidence from above,
      and a pair whose bound is below the threshold is out. Sets of many small groups, which a sample of rows splits, are
      then judged in the same way on one in ``GROUP_PARTS`` of their groups, with all rows of these.

    ``distinct`` gives the columns' distinct values if they are known. What is left is counted over the whole table. Per level the driver takes the pairs that hold (at most sets x columns
    of a few numbers)."""
    cands = list(candidates)
    spark = df.sparkSession
    done = Lattice() if done is None else done
    if not cands:
        return spark.createDataFrame([], CONF_SCHEMA)
    pos = {c: i for i, c in enumerate(cands)}
    coded = _coded(df, cands)
    head = coded.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cands)]).first()
    n = head["n"]
    whole = {c for i, c in enumerate(cands) if head[f"c{i}"] == n}  # columns without nulls
    sample = None
    if n > 2 * sample_rows:
        if distinct is None:
            found_distinct = _distinct_counts(coded, list(enumerate(cands)))
            distinct = {c: found_distinct.get(i, 0) for i, c in enumerate(cands)}
        # rows by the hash of their values: the same sample on any partitioning
        sample = cut_lineage(coded.where(F.pmod(F.xxhash64(*[f"`{c}`" for c in cands]), F.lit(n // sample_rows)) == 0))
    order = {s: i for i, s in enumerate(_sets(cands, max_lhs))}
    exact: set[tuple[frozenset, str]] = set()
    found = []
    for k in range(1, max_lhs + 1):
        wanted = []
        for s in itertools.combinations(cands, k):
            open_rhs = []
            for c in cands:
                if c in s:
                    continue
                if c in whole and any(s[i] in whole and (frozenset(s[:i] + s[i + 1:]), c) in exact for i in range(k)):
                    exact.add((frozenset(s), c))
                    found.append((list(s), c, 1.0, None, order[s], pos[c]))
                    done.implied_pairs += 1
                else:
                    open_rhs.append(c)
            if open_rhs:
                wanted.append((order[s], s, open_rhs))
        if sample is not None and wanted:
            done.sampled_sets += len(wanted)
            groups = {i: min(float(n), float(math.prod(max(1, distinct[c]) for c in s))) for i, s, _ in wanted}
            for rows, parts in ((sample, 1), (coded, GROUP_PARTS)):
                mixed = _mixed(rows, wanted, cands, batch_size, parts)
                out = {(r.sid, r.rhs) for r in mixed.collect() if 1.0 - r.n_mixed / groups[r.sid] < threshold}
                done.ruled_out_pairs += len(out)
                wanted = [(i, s, left) for i, s, r in wanted if (left := [c for c in r if (i, c) not in out])]
                if not wanted:
                    break
        if not wanted:
            continue
        done.counted_sets += len(wanted)
        held = measure(coded, wanted, cands, batch_size).where(F.col("n_det") / F.col("n_groups") >= threshold)
        for r in held.select("sid", "lhs", "rhs", (F.col("n_det") / F.col("n_groups")).alias("c"), "n_groups", "rhs_pos").collect():
            found.append((r.lhs, r.rhs, r.c, r.n_groups, r.sid, r.rhs_pos))
            if r.c == 1.0:
                exact.add((frozenset(r.lhs), r.rhs))
    return spark.createDataFrame(found, CONF_SCHEMA)


def _mixed(rows: DataFrame, wanted, cands: Sequence[str], batch_size: int, parts: int = 1) -> DataFrame:
    """(sid, rhs, n_mixed): groups of the rows (or one in ``parts`` of them) with two different values or more of the rhs."""
    pos = {c: i for i, c in enumerate(cands)}
    found = []
    for k in sorted({len(s) for _, s, _ in wanted}):
        of_size = [w for w in wanted if len(w[1]) == k]
        for b in range(0, len(of_size), batch_size):
            batch = of_size[b:b + batch_size]
            rhs = [c for c in cands if any(c in r for _, _, r in batch)]
            x = _expanded(rows, batch, rhs, pos, k, parts)
            g = x.groupBy("sid", *[f"k{j}" for j in range(k)]).agg(*[(F.min(f"r{pos[c]}") < F.max(f"r{pos[c]}")).alias(f"m{pos[c]}") for c in rhs])
            per = g.groupBy("sid").agg(*[F.count(F.when(F.col(f"m{pos[c]}"), 1)).alias(f"m{pos[c]}") for c in rhs])
            found.append(per.select("sid", F.inline(F.array(*[F.struct(F.lit(c).alias("rhs"), F.col(f"m{pos[c]}").alias("n_mixed")) for c in rhs]))))
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out.where("n_mixed > 0")


def classify(conf: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """FD5: exact if >= 1 - 1e-9, probabilistic if >= threshold, else dropped; confidence to 6 dp."""
    kind = F.when(F.col("confidence") >= 1.0 - EXACT_EPS, F.lit("exact")) \
            .when(F.col("confidence") >= threshold, F.lit("probabilistic"))
    return conf.withColumn("kind", kind).where(F.col("kind").isNotNull()) \
               .withColumn("confidence", F.round("confidence", 6))


def rank_fds(fds: DataFrame) -> DataFrame:
    """FD6: per kind, confidence descending, ties in discovery order (lhs set, then rhs). The FD table has
    at most C^2 x sets rows, so one window per kind is small."""
    w = Window.partitionBy("kind").orderBy(F.col("confidence").desc(), "lhs_order", "rhs_pos")
    return fds.withColumn("rank", F.row_number().over(w).cast("bigint"))


def discover(df: DataFrame, columns: Sequence[str] | None = None, max_lhs: int = DEFAULT_MAX_LHS,
             threshold: float = DEFAULT_THRESHOLD, batch_size: int = 8, max_distinct: int | None = None) -> DataFrame:
    """FD1-FD6: ranked exact and probabilistic FDs of ``df``."""
    cols = list(columns or scalar_columns(df))
    _, rows = _scan_candidates(df, cols, max_distinct, UNIQUE_RATIO)
    cand = [r[0] for r in rows if r[3]]
    known = {r[0]: r[2] for r in rows if r[3]}
    return rank_fds(classify(levelwise(df, cand, max_lhs, threshold, batch_size, distinct=known), threshold))


def fd_meta(fds: DataFrame, n_rows: int, threshold: float, max_lhs: int) -> DataFrame:
    """FD8: one row of counts and settings (``n_rows`` is the analysed row count, known from step 1)."""
    return fds.agg(F.count(F.when(F.col("kind") == "exact", 1)).alias("n_exact_fds"),
                   F.count(F.when(F.col("kind") == "probabilistic", 1)).alias("n_probabilistic_fds")).select(
        "n_exact_fds", "n_probabilistic_fds", F.lit(float(threshold)).alias("confidence_threshold"),
        F.lit(int(max_lhs)).alias("max_lhs_size"), F.lit(int(n_rows)).cast("bigint").alias("n_rows_analysed"))


def fd_lines(fds: DataFrame, top: int = 15) -> DataFrame:
    """FD9: the first ``top`` FDs of each kind as text lines."""
    return fds.where(F.col("rank") <= top).select(
        "kind", "rank", F.format_string("%s -> %s  (conf=%.4f)", F.concat_ws(", ", "lhs"), F.col("rhs"),
                                        F.col("confidence")).alias("line"))


def group_by_lhs(fds: DataFrame) -> DataFrame:
    """FD10: for each lhs, the sorted list of rhs it determines."""
    return fds.groupBy(F.concat_ws(",", "lhs").alias("lhs")).agg(
        F.count(F.lit(1)).alias("n_rhs"), F.concat_ws(",", F.sort_array(F.collect_list("rhs"))).alias("rhs_list"))


def determined_by(fds: DataFrame, key: str) -> DataFrame:
    """FD11: columns ``key`` determines exactly (lhs is exactly [key])."""
    return fds.where((F.col("kind") == "exact") & (F.col("lhs") == F.array(F.lit(key)))).select("rhs")


def representative_rows(df: DataFrame, key: str, columns: Sequence[str], order_by: str) -> DataFrame:
    """FD12: one row per key value: the first occurrence in ``order_by`` order (never ``dropDuplicates``)."""
    cols = [c for c in columns if c != key]
    if not cols:
        return df.where(F.col(key).isNotNull()).select(key).distinct()
    rep = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*cols), F.col(order_by)).alias("_r"))
    return rep.select(key, "_r.*")
