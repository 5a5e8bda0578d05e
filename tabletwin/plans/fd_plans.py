"""Registered FD queries (FD1-FD13) and their oracle SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tabletwin.functions.rng import sql_uniform, uniform
from tabletwin.operators import fd as FD
from tabletwin.operators.rank import exact_sample
from tabletwin.plans.registry import query
from tabletwin.plans.tables import CUSTOMER_GEO_SQL, POLICIES_SQL, customer_geo, policies, table
from tabletwin.session import cut_lineage

GEO_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_nationkey", "n_name", "n_regionkey", "r_name"]
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "supp_band"]
SAMPLE_N = 50_000
SEED = 42


def lineitem_fd(spark, sf):
    """lineitem plus ``supp_band``: l_suppkey DIV 10, except odd orders of supplier 7 (-1). So l_suppkey ->
    supp_band holds in all but one supplier group: a probabilistic FD."""
    li = table(spark, sf, "lineitem")
    band = F.when((F.col("l_suppkey") == 7) & (F.col("l_orderkey") % 2 == 1), F.lit(-1)).otherwise(F.floor(F.col("l_suppkey") / 10))
    return li.withColumn("supp_band", band.cast("bigint"))


LI_FD_SQL = """(SELECT *, CASE WHEN l_suppkey = 7 AND l_orderkey % 2 = 1 THEN -1 ELSE l_suppkey // 10 END AS supp_band FROM lineitem)"""


def lineitem_sample(spark, sf):
    li = lineitem_fd(spark, sf).withColumn("_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    # the sample has SAMPLE_N rows: materialise it once in the shared checkpoint folder so the FD jobs
    # that follow do not redo the rank shuffle
    return cut_lineage(exact_sample(li, SAMPLE_N, seed=SEED, key="_key", salt="fd_sample").drop("_key"))


LI_SAMPLE_SQL = f"""(SELECT * EXCLUDE (_key, _u) FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber) AS _key,
  {sql_uniform(SEED, 'fd_sample', "concat_ws('-', l_orderkey, l_linenumber)")} AS _u FROM {LI_FD_SQL})
  QUALIFY row_number() OVER (ORDER BY _u, _key) <= {SAMPLE_N})"""


# ---- oracle SQL -------------------------------------------------------------------------------

def _cand_sql(cols: list[str], limit: int | None = None) -> str:
    parts = [f"SELECT '{c}' AS column_name, {i} AS position, count(DISTINCT {c}) AS k FROM s" for i, c in enumerate(cols)]
    most = "" if limit is None else f" AND u.k <= {limit}"
    return (f"SELECT u.column_name, u.position, (u.k < 0.95 * n.n AND u.k > 1{most}) AS is_candidate "
            f"FROM ({' UNION ALL '.join(parts)}) u, (SELECT count(*) AS n FROM s) n")


def fd_sql(src: str, cols: list[str], max_lhs: int = 1) -> str:
    """WITH-query yielding (lhs string, lhs_pos, rhs, rhs_pos, confidence unrounded) for candidate sets."""
    pos = {c: i for i, c in enumerate(cols)}
    pairs = []
    for k in range(1, max_lhs + 1):
        for lhs in itertools.combinations(cols, k):
            for rhs in cols:
                if rhs in lhs:
                    continue
                keys = ", ".join(lhs)
                nn = " AND ".join(f"{c} IS NOT NULL" for c in lhs)
                lpos = sum(pos[c] * (100 ** (k - 1 - j)) for j, c in enumerate(lhs))
                pairs.append(
                    f"SELECT '{','.join(lhs)}' AS lhs, [{', '.join(repr(c) for c in lhs)}] AS lhs_cols, {lpos} AS lhs_pos, '{rhs}' AS rhs, {pos[rhs]} AS rhs_pos, "
                    f"count(*) AS n_groups, sum(CASE WHEN nu = 1 THEN 1 ELSE 0 END) AS n_det "
                    f"FROM (SELECT {keys}, count(DISTINCT {rhs}) AS nu FROM s WHERE {nn} GROUP BY {keys})")
    return f"""WITH s AS (SELECT * FROM {src}), cand AS ({_cand_sql(cols)}),
pairs AS ({' UNION ALL '.join(pairs)}),
conf AS (SELECT p.lhs, p.lhs_pos, p.rhs, p.rhs_pos, p.n_det::DOUBLE / p.n_groups AS confidence FROM pairs p
  JOIN cand r ON p.rhs = r.column_name AND r.is_candidate
  WHERE (SELECT bool_and(c.is_candidate) FROM cand c WHERE list_contains(p.lhs_cols, c.column_name))),
fds AS (SELECT lhs, lhs_pos, rhs, rhs_pos, round(confidence, 6) AS confidence,
  CASE WHEN confidence >= 1 - 1e-9 THEN 'exact' ELSE 'probabilistic' END AS kind FROM conf WHERE confidence >= 0.95),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, lhs_pos, rhs_pos) AS rank FROM fds)
"""


def _fds(df, max_lhs=1):
    return FD.discover(df, max_lhs=max_lhs)


def _out(fds):
    return fds.select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence")


@query("fd_candidates", f"WITH s AS (SELECT * FROM {CUSTOMER_GEO_SQL}) SELECT column_name, is_candidate FROM ({_cand_sql(GEO_COLS, FD.MAX_DISTINCT)})")
def fd_candidates(spark, sf):
    return FD.candidate_table(customer_geo(spark, sf), max_distinct=FD.MAX_DISTINCT).select("column_name", "is_candidate")


@query("fd_confidence", fd_sql("part", PART_COLS) + "SELECT lhs, rhs, round(confidence, 6) AS confidence FROM conf")
def fd_confidence(spark, sf):
    """FD2 on part: every candidate pair with its confidence, kept or not (all are 0 here)."""
    p = table(spark, sf, "part")
    cand = [r["column_name"] for r in FD.candidate_table(p).where("is_candidate").orderBy("position").collect()]
    return FD.confidences(p, cand).select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", F.round("confidence", 6).alias("confidence"))


@query("fd_all_pairs", fd_sql(CUSTOMER_GEO_SQL, GEO_COLS) + "SELECT lhs, rhs, round(confidence, 6) AS confidence FROM conf")
def fd_all_pairs(spark, sf):
    g = customer_geo(spark, sf)
    cand = [r["column_name"] for r in FD.candidate_table(g).where("is_candidate").orderBy("position").collect()]
    return FD.confidences(g, cand).select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", F.round("confidence", 6).alias("confidence"))


@query("fd_composite", fd_sql(CUSTOMER_GEO_SQL, GEO_COLS, 2) + "SELECT lhs, rhs, confidence, kind FROM fds")
def fd_composite(spark, sf):
    """FD4: lhs sets of size 1 and 2 (no minimality pruning, as in the reference)."""
    return _fds(customer_geo(spark, sf), 2).select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence", "kind")


@query("fd_exact", fd_sql(CUSTOMER_GEO_SQL, GEO_COLS) + "SELECT lhs, rhs, confidence FROM fds WHERE kind = 'exact'")
def fd_exact(spark, sf):
    return _out(_fds(customer_geo(spark, sf)).where("kind = 'exact'"))


@query("fd_probabilistic", fd_sql(LI_FD_SQL, LI_COLS) + "SELECT lhs, rhs, confidence FROM fds WHERE kind = 'probabilistic'")
def fd_probabilistic(spark, sf):
    return _out(_fds(lineitem_fd(spark, sf)).where("kind = 'probabilistic'"))


@query("fd_ranked", fd_sql(LI_FD_SQL, LI_COLS) + "SELECT kind, rank, lhs, rhs, confidence FROM ranked")
def fd_ranked(spark, sf):
    return _fds(lineitem_fd(spark, sf)).select("kind", "rank", F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence")


@query("fd_sampled", fd_sql(LI_SAMPLE_SQL, LI_COLS) + "SELECT kind, rank, lhs, rhs, confidence FROM ranked")
def fd_sampled(spark, sf):
    """FD7 + AG17: FDs on an exact 50,000-row sample chosen by a seeded hash rank."""
    return _fds(lineitem_sample(spark, sf)).select("kind", "rank", F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence")


@query("fd_meta", fd_sql(LI_FD_SQL, LI_COLS) + """SELECT (SELECT count(*) FROM fds WHERE kind = 'exact') AS n_exact_fds,
  (SELECT count(*) FROM fds WHERE kind = 'probabilistic') AS n_probabilistic_fds, 0.95::DOUBLE AS confidence_threshold,
  1 AS max_lhs_size, (SELECT count(*) FROM s) AS n_rows_analysed""")
def fd_meta(spark, sf):
    df = lineitem_fd(spark, sf)
    fds = _fds(df)
    return FD.fd_meta(fds, df.count(), FD.DEFAULT_THRESHOLD, 1)


@query("fd_top15", fd_sql(LI_FD_SQL, LI_COLS) + """SELECT kind, rank, printf('%s -> %s  (conf=%.4f)', replace(lhs, ',', ', '), rhs, confidence) AS line
  FROM ranked WHERE rank <= 15""")
def fd_top15(spark, sf):
    return FD.fd_lines(_fds(lineitem_fd(spark, sf)), 15)


POLICY_COLS = ["model", "segment", "fuel_type", "transmission_type", "steering_type", "rear_brakes_type", "is_esc", "is_parking_camera",
               "is_tpms", "airbags", "displacement", "ncap_rating", "region_code", "region_density", "claim_status"]


@query("fd_policies_ranked", fd_sql(POLICIES_SQL, POLICY_COLS) + "SELECT kind, rank, lhs, rhs, confidence FROM ranked")
def fd_policies_ranked(spark, sf):
    """FD3, FD6 on a table with many dependencies: the whole ranking."""
    fds = FD.discover(policies(spark, sf), POLICY_COLS)
    return fds.select("kind", "rank", F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence")


@query("fd_policies_top15", fd_sql(POLICIES_SQL, POLICY_COLS) + """SELECT kind, rank, printf('%s -> %s  (conf=%.4f)', replace(lhs, ',', ', '), rhs, confidence) AS line
  FROM ranked WHERE rank <= 15""")
def fd_policies_top15(spark, sf):
    """FD9: more dependencies than lines, so the cut is made."""
    return FD.fd_lines(FD.discover(policies(spark, sf), POLICY_COLS), 15)


@query("fd_by_lhs", fd_sql(CUSTOMER_GEO_SQL, GEO_COLS) + """SELECT lhs, count(*) AS n_rhs, string_agg(rhs, ',' ORDER BY rhs) AS rhs_list
  FROM fds GROUP BY lhs""")
def fd_by_lhs(spark, sf):
    return FD.group_by_lhs(_fds(customer_geo(spark, sf)))


@query("fd_determined", fd_sql(CUSTOMER_GEO_SQL, GEO_COLS) + "SELECT rhs FROM fds WHERE kind = 'exact' AND lhs = 'n_name'")
def fd_determined(spark, sf):
    return FD.determined_by(_fds(customer_geo(spark, sf)), "n_name")


@query("fd_lookup", f"""SELECT n_name, arg_min(c_nationkey, c_custkey) AS c_nationkey, arg_min(n_nationkey, c_custkey) AS n_nationkey,
  arg_min(n_regionkey, c_custkey) AS n_regionkey, arg_min(r_name, c_custkey) AS r_name
  FROM {CUSTOMER_GEO_SQL} WHERE n_name IS NOT NULL GROUP BY n_name""")
def fd_lookup(spark, sf):
    """FD12: representative row (first by c_custkey) per n_name, over the columns n_name determines."""
    g = customer_geo(spark, sf)
    det = [r["rhs"] for r in FD.determined_by(_fds(g), "n_name").collect()]
    det = [c for c in g.columns if c in det]
    return FD.representative_rows(g, "n_name", det, "c_custkey")


BIG_COLS = ["k", "twin", "g"]
BIG_SQL = """(SELECT (1152921504606846976 + c_custkey // 10)::BIGINT AS k, (1152921504606846976 + (c_custkey // 10) * 3)::BIGINT AS twin,
  (1152921504606846976 + c_custkey % 7)::BIGINT AS g FROM customer)"""


@query("fd_big_integers", fd_sql(BIG_SQL, BIG_COLS) + "SELECT lhs, rhs, round(confidence, 6) AS confidence FROM conf")
def fd_big_integers(spark, sf):
    """FD2 on integers above 2^53 that differ in their last digits: codes keep the native type."""
    c = table(spark, sf, "customer")
    base = F.lit(1152921504606846976)
    d = c.select((base + F.floor(F.col("c_custkey") / 10)).cast("bigint").alias("k"), (base + F.floor(F.col("c_custkey") / 10) * 3).cast("bigint").alias("twin"),
                 (base + F.col("c_custkey") % 7).cast("bigint").alias("g"))
    return FD.confidences(d, BIG_COLS).select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", F.round("confidence", 6).alias("confidence"))


@query("distinct_pairs", f"SELECT DISTINCT c_mktsegment, n_regionkey FROM {CUSTOMER_GEO_SQL}")
def distinct_pairs(spark, sf):
    """FD13: distinct (a, b) pairs."""
    return customer_geo(spark, sf).select("c_mktsegment", "n_regionkey").distinct()


LATTICE_COLS = ["model", "segment", "fuel_type", "transmission_type", "airbags", "region_code", "claim_status"]
LATTICE_SRC = f"(SELECT {', '.join(LATTICE_COLS)} FROM {POLICIES_SQL})"


@query("fd_lattice", fd_sql(LATTICE_SRC, LATTICE_COLS, 3) + """SELECT lhs, rhs, confidence, kind,
  row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, len(string_split(lhs, ',')), lhs_pos, rhs_pos) AS rank FROM fds""")
def fd_lattice(spark, sf):
    """FD4 with left sides of up to three columns, searched level by level."""
    fds = FD.discover(cut_lineage(policies(spark, sf).select(*LATTICE_COLS)), max_lhs=3)
    return fds.select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", "confidence", "kind", "rank")
