"""Registered synthesis queries (SY1-SY28, PF4-PF12, JN1, JN2, JN6, AG20, AG25, AG26) with oracle SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabletwin.functions.rng import sql_gamma, sql_standard_normal, sql_uniform, standard_normal, uniform
from tabletwin.operators import compare as CMP
from tabletwin.operators import synth as SY
from tabletwin.operators.rank import buckets_for, global_rank
from tabletwin.plans import synth_sql as Q
from tabletwin.plans.registry import query
from tabletwin.plans.tables import POLICIES_SQL, policies, table
from tabletwin.session import cut_lineage, ensure_checkpoint_dir
from tabletwin.sources.stages import run_stage

SEED = 42
POL = f"(SELECT * FROM {POLICIES_SQL})"
DETERMINED = ["segment", "fuel_type", "transmission_type", "steering_type", "rear_brakes_type", "is_esc",
              "is_parking_camera", "is_tpms", "airbags", "displacement", "ncap_rating"]
DET_NUM = ["airbags", "displacement", "ncap_rating"]


def blueprint(spark, sf, fitted=("subscription_length", "customer_age"), candidates=("norm", "expon", "uniform")):
    """The blueprint of ``policies``, learned anew (FD discovery picks the model-determined columns)."""
    # a dozen passes (FDs, statistics, fits, pools) over a table that Spark derives with a join and an
    # aggregation: materialise it once in the shared checkpoint folder
    real = cut_lineage(policies(spark, sf))
    return SY.Blueprint(real, key="model", row_key="policy_id", label_col="claim_status", id_col="policy_id",
                        fitted=list(fitted), empirical={"vehicle_age": 12.0},
                        sampled={"region_code": ["region_density"]}, fit_candidates=candidates)


def n_of(spark, sf, name):
    return table(spark, sf, name).count()


def ids(spark, n):
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n // 2_000_000 + 1))


# ---- SY1-SY3, SY25 -----------------------------------------------------------------------------

@query("synth_ids", "SELECT range AS id, printf('SYN%06d', range) AS policy_id FROM range((SELECT count(*) FROM customer))")
def synth_ids(spark, sf):
    return ids(spark, policies(spark, sf).count()).select("id", F.format_string(SY.ID_FORMAT, F.col("id")).alias("policy_id"))


@query("uniform_draws", f"""SELECT range AS id, {sql_uniform(SEED, 'u', 'range')} AS u,
  round({sql_standard_normal(SEED, 'z', 'range')}, 9) AS z, {sql_uniform(7, 'u', 'range')} AS u_other_seed
  FROM range((SELECT count(*) FROM orders))""")
def uniform_draws(spark, sf):
    """SY3: seeded, partition-independent draws; another seed gives other values."""
    return ids(spark, n_of(spark, sf, "orders")).select(
        "id", uniform(SEED, "u", "id").alias("u"), F.round(standard_normal(SEED, "z", "id"), 9).alias("z"),
        uniform(7, "u", "id").alias("u_other_seed"))


@query("label_exact_rate", f"""SELECT id, CAST(lab_rank < (SELECT greatest(0, least(round_even(count(*) * 0.06, 0), count(*))) FROM orders) AS BIGINT) AS label
  FROM {Q.ranked(Q.ids('SELECT count(*) FROM orders'), SEED, 'label', 'lab_rank')}""")
def label_exact_rate(spark, sf):
    """SY25: exactly round-half-even(n * 0.06) ones at random places."""
    n = n_of(spark, sf, "orders")
    i = ids(spark, n)
    return i.select("id", SY.exact_label(i, n, 0.06, SEED).alias("label"))


@query("sample_weighted", f"""SELECT id, c_mktsegment FROM {Q.draw(Q.ids('SELECT count(*) FROM orders'),
    Q.key_pool('customer', 'c_mktsegment'), 'v', SEED, 'seg', 'c_mktsegment')}""")
def sample_weighted(spark, sf):
    """SY4/JN6: weighted draws of a category by its value counts (inverse-CDF join)."""
    c = table(spark, sf, "customer")
    pool = SY.whole_pool(c, "c_mktsegment")
    return SY.draw_categorical(ids(spark, n_of(spark, sf, "orders")), spark, pool, "c_mktsegment", SEED, "seg")


@query("sample_weighted_wide", f"""SELECT id, o_custkey FROM {Q.draw(Q.ids('SELECT count(*) FROM lineitem'),
    Q.key_pool('orders', 'o_custkey'), 'v', SEED, 'cust', 'o_custkey')}""")
def sample_weighted_wide(spark, sf):
    """SY4 over a pool of many hundred values: all of them can be drawn."""
    pool = SY.whole_pool(table(spark, sf, "orders"), "o_custkey")
    return SY.draw_categorical(ids(spark, n_of(spark, sf, "lineitem")), spark, pool, "o_custkey", SEED, "cust")


DUP_N = 777
DUP_KEY = """sha256('{"event_type":"' || event_type || '"}')"""


@query("sample_duplicates", f"""SELECT event_type, count(*) AS n FROM (SELECT event_type, {Q.sql_uniform(SEED, 'sample', DUP_KEY)} AS u, {DUP_KEY} AS k
  FROM events QUALIFY row_number() OVER (ORDER BY u, k) <= {DUP_N}) GROUP BY event_type""")
def sample_duplicates(spark, sf):
    """AG17 on a table of a few distinct rows: the rows at the cut tie, and exactly n come out."""
    from tabletwin.operators.rank import exact_sample
    e = table(spark, sf, "events").select("event_type")
    return exact_sample(e, DUP_N, seed=SEED).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- pools (PF4-PF10, SY5, SY28) ------------------------------------------------------------------

def _pool_sql(pred: str | None, exclude=(), key=None) -> str:
    conds = []
    if pred:
        conds.append(pred)
    if key:
        conds.append(f"lower(p.v) = '{key.lower()}'")
    if exclude:
        conds.append("p.v NOT IN (" + ", ".join(f"'{e}'" for e in exclude) + ")")
    keep = " AND ".join(conds) if conds else "true"
    return f"""SELECT v AS model, w AS count FROM (
  SELECT p.v, p.w, coalesce({keep}, false) AS keep FROM {Q.key_pool(POL, 'model')} p
  LEFT JOIN {Q.lookup(POL, 'model', DETERMINED, 'policy_id')} l ON p.v = l.model)
QUALIFY keep OR max(CAST(keep AS INT)) OVER () = 0"""


def _pool(spark, sf, plan):
    return blueprint(spark, sf).pool_frame(plan)


@query("pool_attr_in", _pool_sql("lower(l.fuel_type) IN ('petrol', 'diesel')"))
def pool_attr_in(spark, sf):
    return _pool(spark, sf, SY.Plan(attr_in={"fuel_type": ["Petrol", "diesel"]}))


@query("pool_attr_eq", _pool_sql("lower(l.segment) = 'b2'"))
def pool_attr_eq(spark, sf):
    return _pool(spark, sf, SY.Plan(attr_eq={"segment": "B2"}))


@query("pool_attr_min", _pool_sql("CAST(l.ncap_rating AS DOUBLE) >= 4"))
def pool_attr_min(spark, sf):
    return _pool(spark, sf, SY.Plan(attr_min={"ncap_rating": 4}))


@query("pool_flag", _pool_sql("lower(l.is_esc) IN ('yes', '1', 'true', 'y') AND lower(l.is_tpms) IN ('no', '0', 'false', 'n')"))
def pool_flag(spark, sf):
    return _pool(spark, sf, SY.Plan(flags_on=["is_esc"], flags_off=["is_tpms"]))


@query("pool_exclude", _pool_sql(None, exclude=("M3", "M4")))
def pool_exclude(spark, sf):
    return _pool(spark, sf, SY.Plan(exclude=["M3", "M4"]))


@query("pool_single_key", _pool_sql(None, key="m7"))
def pool_single_key(spark, sf):
    return _pool(spark, sf, SY.Plan(key="m7"))


@query("pool_fallback", _pool_sql("lower(l.segment) = 'z9'"))
def pool_fallback(spark, sf):
    """PF10: a filter that matches nothing gives the whole pool back."""
    return _pool(spark, sf, SY.Plan(attr_eq={"segment": "Z9"}))


@query("pool_weights", f"SELECT model, count, count::DOUBLE / sum(count) OVER () AS weight FROM ({_pool_sql('lower(l.fuel_type) IN (' + chr(39) + 'petrol' + chr(39) + ')')})")
def pool_weights(spark, sf):
    """SY5: the filtered pool renormalised by its total, which is one number."""
    p = _pool(spark, sf, SY.Plan(attr_in={"fuel_type": ["petrol"]}))
    total = p.agg(F.sum("count").alias("t")).first().t
    return p.withColumn("weight", F.col("count") / F.lit(total))


@query("available_values", f"""SELECT 'model' AS kind, model AS value FROM (SELECT DISTINCT model FROM {POL})
UNION ALL SELECT 'segment', segment FROM (SELECT DISTINCT segment FROM {POL})
UNION ALL SELECT 'fuel_type', fuel_type FROM (SELECT DISTINCT fuel_type FROM {POL})""")
def available_values(spark, sf):
    """SY28: available keys, segments and fuels (sorted lists in the reference; sets here)."""
    p = policies(spark, sf)
    return p.select(F.lit("model").alias("kind"), F.col("model").alias("value")).distinct() \
        .unionByName(p.select(F.lit("segment").alias("kind"), F.col("segment").alias("value")).distinct()) \
        .unionByName(p.select(F.lit("fuel_type").alias("kind"), F.col("fuel_type").alias("value")).distinct())


# ---- allocation (SY6-SY13, AG26) ------------------------------------------------------------------

N_POL = "SELECT count(*) FROM customer"


def _alloc_sql(allocs, rest="distribute", exclude=()) -> str:
    """SQL of ``Blueprint.key_ranges`` + ``assign_keys`` for a literal plan."""
    pool = Q.key_pool(POL, "model")
    known = f"(SELECT v FROM {pool})"
    n = f"({N_POL})"
    segs, assigned, specified = [], "0", []
    for k, kind, v in allocs:
        inpool = f"('{k}' IN {known})"
        if kind == "exclusive":
            return f"SELECT id, CASE WHEN {inpool} THEN '{k}' END AS model FROM {Q.ids(N_POL)}"
        want = f"{int(v)}" if kind == "count" else f"round_even({n} * {float(v)} / 100.0, 0)"
        c = f"(CASE WHEN {inpool} THEN greatest(0, least({want}, {n} - {assigned})) ELSE 0 END)"
        segs.append((k, assigned, f"({assigned} + {c})"))
        assigned = f"({assigned} + {c})"
        specified.append((k, inpool))
    ex_cond = ("v NOT IN (" + ", ".join(f"'{e}'" for e in exclude) + ")") if exclude else "true"
    spec_list = " OR ".join(f"(v = '{k}' AND {ip})" for k, ip in specified) or "false"
    cases = " ".join(f"WHEN alloc_rank >= {s} AND alloc_rank < {e} THEN '{k}'" for k, s, e in segs)
    base = Q.ranked(Q.ids(N_POL), SEED, "alloc", "alloc_rank")
    all_models = f"(SELECT v, w, row_number() OVER (ORDER BY w DESC, v) AS pos FROM {pool} WHERE {ex_cond})"
    others = (f"(SELECT * FROM {all_models} WHERE NOT ({spec_list}) OR NOT EXISTS "
              f"(SELECT 1 FROM {all_models} WHERE NOT ({spec_list})))")
    if rest not in ("distribute", "equal") and rest not in exclude:
        return (f"SELECT id, CASE {cases} WHEN alloc_rank >= {assigned} AND '{rest}' IN {known} THEN '{rest}' END AS model FROM {base}"
                if cases else f"SELECT id, '{rest}' AS model FROM {base}")
    if rest == "equal":
        eq = (f"(SELECT v, {assigned} + (pos - 1) * ((({n} - {assigned}) // k)) + least(pos - 1, ({n} - {assigned}) % k) AS s, "
              f"(({n} - {assigned}) // k) + CASE WHEN pos - 1 < ({n} - {assigned}) % k THEN 1 ELSE 0 END AS c "
              f"FROM (SELECT v, row_number() OVER (ORDER BY pos) AS pos, count(*) OVER () AS k FROM {others}))")
        return (f"SELECT b.id, coalesce(CASE {cases} END, e.v) AS model FROM {base} b LEFT JOIN {eq} e "
                f"ON b.alloc_rank >= {assigned} AND b.alloc_rank >= e.s AND b.alloc_rank < e.s + e.c") if cases else \
               (f"SELECT b.id, e.v AS model FROM {base} b LEFT JOIN {eq} e ON b.alloc_rank >= e.s AND b.alloc_rank < e.s + e.c")
    fixed = f"SELECT id, CASE {cases} END AS model FROM {base} WHERE alloc_rank < {assigned}" if cases else None
    tail = Q.draw(f"(SELECT id FROM {base} WHERE alloc_rank >= {assigned})", f"(SELECT v, w FROM {others})", "v", SEED, "rest", "model")
    t = f"SELECT id, model FROM {tail}"
    return f"{fixed} UNION ALL {t}" if fixed else t


def _alloc(spark, sf, plan: SY.Plan):
    bp = blueprint(spark, sf)
    n = bp.real.count()
    plan.n_rows = n
    return SY.assign_keys(ids(spark, n), bp, plan, SEED, n).select("id", "model")


A_COUNT = [("M3", "count", 100), ("M4", "count", 50)]
A_PCT = [("M3", "percent", 50), ("M4", "percent", 30), ("M1", "percent", 20)]


def _plan(allocs, **kw):
    return SY.Plan(allocations=[SY.Allocation(k, t, v) for k, t, v in allocs], **kw)


@query("alloc_count", _alloc_sql(A_COUNT))
def alloc_count(spark, sf):
    """SY6/SY13: exact counts in plan order, the rest proportional, all in random order."""
    return _alloc(spark, sf, _plan(A_COUNT))


@query("alloc_percent", _alloc_sql(A_PCT))
def alloc_percent(spark, sf):
    return _alloc(spark, sf, _plan(A_PCT))


@query("alloc_exclusive", _alloc_sql([("M3", "exclusive", None)]))
def alloc_exclusive(spark, sf):
    return _alloc(spark, sf, _plan([("M3", "exclusive", None)]))


@query("alloc_unknown", _alloc_sql([("M99", "count", 100), ("M3", "count", 10)], rest="equal"))
def alloc_unknown(spark, sf):
    """SY9: a key the data does not have is skipped."""
    return _alloc(spark, sf, _plan([("M99", "count", 100), ("M3", "count", 10)], rest="equal"))


@query("alloc_rest_named", _alloc_sql([("M3", "count", 100)], rest="M5"))
def alloc_rest_named(spark, sf):
    return _alloc(spark, sf, _plan([("M3", "count", 100)], rest="M5"))


@query("alloc_rest_equal", _alloc_sql([("M3", "count", 100)], rest="equal"))
def alloc_rest_equal(spark, sf):
    return _alloc(spark, sf, _plan([("M3", "count", 100)], rest="equal"))


@query("alloc_rest_prop", _alloc_sql([("M3", "count", 100)], exclude=("M5", "M7")))
def alloc_rest_prop(spark, sf):
    return _alloc(spark, sf, _plan([("M3", "count", 100)], exclude=["M5", "M7"]))


N_LINES = "SELECT count(*) FROM lineitem"
WIDE_POOL = Q.key_pool("orders", "o_custkey")


@query("alloc_rest_equal_wide", f"""WITH b AS (SELECT * FROM {Q.ranked(Q.ids(N_LINES), SEED, "alloc", "r")}),
named AS (SELECT min(v) AS k FROM {WIDE_POOL}),
p AS (SELECT v, row_number() OVER (ORDER BY w DESC, v) - 1 AS place, count(*) OVER () AS m FROM {WIDE_POOL} WHERE v <> (SELECT k FROM named)),
s AS (SELECT (({N_LINES}) - 100) // max(m) AS share, (({N_LINES}) - 100) % max(m) AS more FROM p)
SELECT b.id, CASE WHEN b.r < 100 THEN (SELECT k FROM named) ELSE p.v END AS o_custkey FROM b CROSS JOIN s LEFT JOIN p ON b.r >= 100
  AND p.place = CASE WHEN b.r - 100 < more * (share + 1) THEN (b.r - 100) // (share + 1) ELSE more + (b.r - 100 - more * (share + 1)) // greatest(share, 1) END""")
def alloc_rest_equal_wide(spark, sf):
    """SY6, SY11 over a key whose values grow with the data: 100 rows of the first key, the rest equally over all others."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderkey")
    bp = SY.Blueprint(o, key="o_custkey", row_key="o_orderkey", determined=[])
    n = n_of(spark, sf, "lineitem")
    first = bp.key_counts.agg(F.min("o_custkey")).first()[0]
    plan = SY.Plan(n_rows=n, allocations=[SY.Allocation(first, "count", 100)], rest="equal")
    return SY.assign_keys(ids(spark, n), bp, plan, SEED, n).select("id", "o_custkey")


@query("synth_allocation_counts", f"SELECT model, count(*) AS count FROM ({_alloc_sql([('M3', 'count', 100)], rest='equal')}) GROUP BY model")
def synth_allocation_counts(spark, sf):
    """AG26: rows per key of an equal-rest allocation (max - min <= 1 among the rest)."""
    return CMP.allocation_counts(alloc_rest_equal(spark, sf), "model")


# ---- lookup, perturbation, numeric draws, bootstrap (SY14-SY24, JN1, JN2) --------------------------

def _lookup_join_sql() -> str:
    keys = Q.draw(Q.ids(N_POL), Q.key_pool(POL, "model"), "v", SEED, "key", "model")
    return (f"(SELECT d.id, d.model, " + ", ".join(f"l.{c}" for c in DETERMINED) + f" FROM {keys} d "
            f"LEFT JOIN {Q.lookup(POL, 'model', DETERMINED, 'policy_id')} l ON d.model = l.model)")


def _keys_with_lookup(spark, sf):
    bp = blueprint(spark, sf)
    n = bp.real.count()
    df = SY.assign_keys(ids(spark, n), bp, SY.Plan(n_rows=n), SEED, n)
    look = bp.lookup.withColumn("model", F.col("model").cast("string"))
    return bp, df.join(F.broadcast(look) if bp.broadcast_lookup else look, "model", "left")


@query("fd_lookup_join", f"SELECT * FROM {_lookup_join_sql()}")
def fd_lookup_join(spark, sf):
    """SY14/JN1: keys drawn by frequency, then the key-determined columns from the representative-row lookup."""
    bp, df = _keys_with_lookup(spark, sf)
    return df.select("id", "model", *DETERMINED)


def _perturb_sql(src: str) -> str:
    cols = []
    for c in DET_NUM:
        mn, mx = f"(SELECT min({c})::DOUBLE FROM {POL})", f"(SELECT max({c})::DOUBLE FROM {POL})"
        u = sql_uniform(SEED, f"perturb:{c}", "id")
        x = f"(CAST({c} AS DOUBLE) + ((-0.02 * ({mx} - {mn})) + (0.04 * ({mx} - {mn})) * {u}))"
        cols.append(f"CAST(round_even(greatest(greatest({mn}, 0), least({mx}, {x})), 0) AS BIGINT) AS {c}")
    return f"SELECT id, model, {', '.join(cols)} FROM {src}"


@query("perturb_numeric", _perturb_sql(_lookup_join_sql()))
def perturb_numeric(spark, sf):
    """SY15: +-2 % uniform noise on the key-determined numeric columns, clipped and rounded."""
    bp, df = _keys_with_lookup(spark, sf)
    return SY.perturb(df, bp, SEED).select("id", "model", *DET_NUM)


def _stats(df, col):
    r = df.agg(F.min(F.col(col).cast("double")).alias("min"), F.max(F.col(col).cast("double")).alias("max"),
               F.avg(F.col(col).cast("double")).alias("mean"), F.stddev_samp(F.col(col).cast("double")).alias("std")).first()
    return r.asDict()


def _draw_numeric(spark, df, col, dist, integral=False):
    """A numeric column drawn from ``dist`` for every row of ``df`` (n = its row count)."""
    st = dict(_stats(df, col), integral=integral)
    n = df.count()
    return SY.with_drawn(ids(spark, n), col, dist, st, SEED).select("id", col)


def _num_sql(src: str, col: str, draw: str, integral: bool = False) -> str:
    mn, mx = f"(SELECT min({col})::DOUBLE FROM {src})", f"(SELECT max({col})::DOUBLE FROM {src})"
    return f"SELECT id, {Q.finish(draw, mn, mx, integral)} AS {col} FROM {Q.ids(f'SELECT count(*) FROM {src}')}"


def _p(expr, src):
    return f"(SELECT round({expr}, 8) FROM {src})"


@query("synth_numeric_norm", _num_sql(POL, "subscription_length",
       f"({_p('avg(subscription_length)', POL)} + {_p('stddev_pop(subscription_length)', POL)} * {Q.normal(SEED, 'subscription_length')})"))
def synth_numeric_norm(spark, sf):
    """SY16 norm: loc + scale * z (Box-Muller), clipped to [max(min, 0), max], 1 dp."""
    from tabletwin.operators.fit import fit_column
    p = policies(spark, sf)
    return _draw_numeric(spark, p, "subscription_length", fit_column(p, "subscription_length", ("norm",)))


@query("synth_numeric_expon", _num_sql("events", "value",
       f"({_p('min(value)', 'events')} + {_p('avg(value) - min(value)', 'events')} * {Q.expo(SEED, 'value')})"))
def synth_numeric_expon(spark, sf):
    """SY16 expon: loc + scale * (-ln(1 - u))."""
    from tabletwin.operators.fit import fit_column
    e = table(spark, sf, "events")
    return _draw_numeric(spark, e, "value", fit_column(e, "value", ("expon",)))


@query("synth_numeric_uniform", _num_sql("lineitem", "l_discount",
       f"({_p('min(l_discount)', 'lineitem')} + {_p('max(l_discount) - min(l_discount)', 'lineitem')} * {Q.unif(SEED, 'l_discount')})"))
def synth_numeric_uniform(spark, sf):
    """SY16 uniform: loc + scale * u."""
    from tabletwin.operators.fit import fit_column
    li = table(spark, sf, "lineitem")
    return _draw_numeric(spark, li, "l_discount", fit_column(li, "l_discount", ("uniform",)))


@query("synth_numeric_lognorm", _num_sql("events", "value",
       f"(-1.0 + {_p('exp(avg(ln(value + 1.0)))', 'events')} * exp({_p('stddev_pop(ln(value + 1.0))', 'events')} * {Q.normal(SEED, 'value')}))"))
def synth_numeric_lognorm(spark, sf):
    """SY16 lognorm (loc fixed at -1, below every value): loc + scale * exp(s * z)."""
    from tabletwin.operators.fit import fit_fixed_loc
    e = table(spark, sf, "events")
    return _draw_numeric(spark, e, "value", fit_fixed_loc(e, "value", "lognorm", -1.0))


@query("synth_numeric_fallback", f"""SELECT a.id, a.customer_age, b.subscription_length FROM
  ({_num_sql(POL, 'customer_age', f"((SELECT avg(customer_age::DOUBLE) FROM {POL}) + (SELECT stddev_samp(customer_age::DOUBLE) FROM {POL}) * {Q.normal(SEED, 'customer_age')})", True)}) a
  JOIN ({_num_sql(POL, 'subscription_length', f"((SELECT min(subscription_length) FROM {POL}) + ((SELECT max(subscription_length) FROM {POL}) - (SELECT min(subscription_length) FROM {POL})) * {Q.unif(SEED, 'subscription_length')})")}) b
  ON a.id = b.id""")
def synth_numeric_fallback(spark, sf):
    """SY17/SY18: 'empirical' (no usable fit) -> normal(mean, std); an unknown family -> uniform(min, max)."""
    p = policies(spark, sf)
    a = _draw_numeric(spark, p, "customer_age", {"name": "empirical", "params": {}}, integral=True)
    b = _draw_numeric(spark, p, "subscription_length", {"name": "weibull", "params": {"c": 1.0}})
    return a.join(b, "id")


def _boot_pool(rng=None):
    where = f"WHERE vehicle_age IS NOT NULL" + (f" AND vehicle_age BETWEEN {rng[0]} AND {rng[1]}" if rng else "")
    return f"(SELECT vehicle_age::DOUBLE AS v, count(*) AS w FROM {POL} {where} GROUP BY 1)"


def _boot_sql(rng=None):
    return Q.draw(Q.ids(N_POL), _boot_pool(rng), "v", SEED, "boot:vehicle_age", "vehicle_age")


def _boot(spark, sf, rng=None):
    bp = blueprint(spark, sf)
    n = bp.real.count()
    return bp, SY.bootstrap_draw(ids(spark, n), bp, "vehicle_age", SEED, rng)


@query("sample_empirical", f"SELECT id, vehicle_age FROM {_boot_sql()}")
def sample_empirical(spark, sf):
    """SY20: bootstrap from the real values (same law as indexing a random row)."""
    return _boot(spark, sf)[1].select("id", "vehicle_age")


@query("sample_empirical_range", f"SELECT id, vehicle_age FROM {_boot_sql((2, 5))}")
def sample_empirical_range(spark, sf):
    """SY21/PF11: bootstrap restricted to real values in [2, 5]."""
    return _boot(spark, sf, (2, 5))[1].select("id", "vehicle_age")


def _jitter_sql(src):
    mx = f"(SELECT max(vehicle_age)::DOUBLE FROM {POL})"
    u = sql_uniform(SEED, "jitter:vehicle_age", "id")
    return f"SELECT id, CAST(round_even(greatest(0.0, least({mx}, vehicle_age + (-0.1 + 0.2 * {u}))) * 12.0, 0) AS BIGINT) AS vehicle_age FROM {src}"


@query("sample_jitter", _jitter_sql(_boot_sql()))
def sample_jitter(spark, sf):
    """SY22: bootstrap, +-0.1 jitter, clip to [0, max], years -> months."""
    bp, d = _boot(spark, sf)
    return SY.jitter(d, bp, "vehicle_age", SEED, 12.0).select("id", "vehicle_age")


@query("sample_clipped", f"""SELECT id, CAST(greatest(35, least(50, customer_age)) AS BIGINT) AS customer_age FROM
  ({_num_sql(POL, 'customer_age', f"({_p('avg(customer_age::DOUBLE)', POL)} + {_p('stddev_pop(customer_age::DOUBLE)', POL)} * {Q.normal(SEED, 'customer_age')})", True)})""")
def sample_clipped(spark, sf):
    """SY23: a fitted draw clipped to a requested range (mass piles up at the bounds), age as int."""
    from tabletwin.operators.fit import fit_column
    p = policies(spark, sf)
    d = _draw_numeric(spark, p, "customer_age", fit_column(p, "customer_age", ("norm",)), integral=True)
    return d.select("id", F.greatest(F.lit(35), F.least(F.lit(50), F.col("customer_age"))).cast("bigint").alias("customer_age"))


# ---- the whole table (SY26), and comparisons on it (AG20, AG25) ----------------------------------

TABLE_PLAN = [("M3", "count", 100)]
FITTED = ["subscription_length", "customer_age"]
POL_COLS = ["policy_id", "subscription_length", "vehicle_age", "customer_age", "region_code", "region_density", "model",
            "segment", "fuel_type", "transmission_type", "steering_type", "rear_brakes_type", "is_esc",
            "is_parking_camera", "is_tpms", "airbags", "displacement", "ncap_rating", "claim_status"]


def _fit_sql(c: str) -> str:
    x = f"{c}::DOUBLE"
    n = f"count({x})"
    return f"""(SELECT name, round(loc, 8) AS loc, round(scale, 8) AS scale FROM (
  SELECT 'norm' AS name, 0 AS o, avg({x}) AS loc, stddev_pop({x}) AS scale,
         4 - 2 * (-{n} / 2 * ln(2 * pi()) - {n} * ln(stddev_pop({x})) - {n} / 2) AS aic FROM {POL}
  UNION ALL SELECT 'expon', 1, min({x}), avg({x}) - min({x}), 4 - 2 * (-{n} * ln(avg({x}) - min({x})) - {n}) FROM {POL}
  UNION ALL SELECT 'uniform', 2, min({x}), max({x}) - min({x}), 4 - 2 * (-{n} * ln(max({x}) - min({x}))) FROM {POL})
  WHERE scale > 0 ORDER BY aic, o LIMIT 1)"""


def _fitted_expr(c: str, integral: bool) -> str:
    f = _fit_sql(c)
    draw = (f"CASE (SELECT name FROM {f}) WHEN 'norm' THEN (SELECT loc FROM {f}) + (SELECT scale FROM {f}) * {Q.normal(SEED, c)} "
            f"WHEN 'expon' THEN (SELECT loc FROM {f}) + (SELECT scale FROM {f}) * {Q.expo(SEED, c)} "
            f"ELSE (SELECT loc FROM {f}) + (SELECT scale FROM {f}) * {Q.unif(SEED, c)} END")
    return Q.finish(draw, f"(SELECT min({c})::DOUBLE FROM {POL})", f"(SELECT max({c})::DOUBLE FROM {POL})", integral)


def synth_table_sql() -> str:
    n = f"({N_POL})"
    lab = Q.ranked(Q.ids(N_POL), SEED, "label", "_label_rank")
    lab = f"(SELECT id, CAST(_label_rank < (SELECT greatest(0, least(round_even({n} * 0.06, 0), {n}))) AS BIGINT) AS claim_status FROM {lab})"
    keys = f"({_alloc_sql(TABLE_PLAN, rest='equal')})"
    look = Q.lookup(POL, "model", DETERMINED, "policy_id")
    base = (f"(SELECT k.id, k.model, lb.claim_status, " + ", ".join(f"l.{c}" for c in DETERMINED) +
            f" FROM {keys} k JOIN {lab} lb ON k.id = lb.id LEFT JOIN {look} l ON k.model = l.model)")
    pert = []
    for c in DET_NUM:
        mn, mx = f"(SELECT min({c})::DOUBLE FROM {POL})", f"(SELECT max({c})::DOUBLE FROM {POL})"
        u = sql_uniform(SEED, f"perturb:{c}", "id")
        x = f"(CAST({c} AS DOUBLE) + ((-0.02 * ({mx} - {mn})) + (0.04 * ({mx} - {mn})) * {u}))"
        pert.append(f"CAST(round_even(greatest(greatest({mn}, 0), least({mx}, {x})), 0) AS BIGINT) AS {c}")
    step = (f"(SELECT * REPLACE ({', '.join(pert)}), {_fitted_expr('subscription_length', False)} AS subscription_length, "
            f"{_fitted_expr('customer_age', True)} AS customer_age FROM {base})")
    boot = Q.draw(step, _boot_pool(), "v", SEED, "boot:vehicle_age", "vehicle_age")
    mx = f"(SELECT max(vehicle_age)::DOUBLE FROM {POL})"
    ju = sql_uniform(SEED, "jitter:vehicle_age", "id")
    boot = (f"(SELECT * REPLACE (CAST(round_even(greatest(0.0, least({mx}, vehicle_age + (-0.1 + 0.2 * {ju}))) * 12.0, 0) AS BIGINT) "
            f"AS vehicle_age) FROM {boot})")
    reg = Q.draw(boot, Q.key_pool(POL, "region_code"), "v", SEED, "cat:region_code", "region_code")
    dens = Q.lookup(POL, "region_code", ["region_density"], "policy_id")
    out = f"(SELECT r.*, d.region_density, printf('SYN%06d', r.id) AS policy_id FROM {reg} r LEFT JOIN {dens} d ON r.region_code = d.region_code)"
    return f"SELECT id, {', '.join(POL_COLS)} FROM {out}"


def _synth_table(spark, sf):
    bp = blueprint(spark, sf, fitted=tuple(FITTED))
    return _generated(spark, bp, bp.real.count())


def _generated(spark, bp, n):
    plan = SY.Plan(n_rows=n, label_rate=0.06, allocations=[SY.Allocation(k, t, v) for k, t, v in TABLE_PLAN], rest="equal")
    return SY.generate(spark, bp, plan, seed=SEED)


SYNTH_TABLE_SQL = synth_table_sql()


@query("synth_table", SYNTH_TABLE_SQL)
def synth_table(spark, sf):
    """SY26: keys (100 x M3, the rest split equally) -> lookup -> perturb -> fitted columns -> bootstrap ->
    region and density -> ids -> exact 6 % label, in the real table's column order."""
    return _synth_table(spark, sf)


STAGE_INPUTS = ("customer", "nation", "region", "orders")


def learned(spark, sf, root):
    """The blueprint of ``policies`` as a saved stage under ``root``, learned only if it is not there yet."""
    def build():
        bp = blueprint(spark, sf, fitted=tuple(FITTED))
        tables, meta = SY.artifacts(bp)
        return tables, meta | {"n_rows": bp.real.count()}

    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in STAGE_INPUTS]
    return run_stage(spark, root, "blueprint", inputs, {"fitted": FITTED, "candidates": ["norm", "expon", "uniform"]}, build)


@query("synth_table_from_artifacts", SYNTH_TABLE_SQL)
def synth_table_from_artifacts(spark, sf):
    """SRC4, SY26: the blueprint is saved as a stage, found again, and the table is made from the saved profile,
    dependencies, pools and lookups alone: its plan does not read the real table."""
    root = os.path.join(ensure_checkpoint_dir(spark), f"stages-{uuid.uuid4().hex}")
    learned(spark, sf, root)
    saved = learned(spark, sf, root)
    if not saved.reused:
        raise RuntimeError("a finished stage ran again")
    return _generated(spark, SY.SavedBlueprint(saved), saved.meta["n_rows"])


OVERLAP_COLS = ["model", "customer_age", "region_code", "subscription_length", "fuel_type", "segment", "airbags"]


@query("overlap_rate", f"""WITH s AS (SELECT DISTINCT {', '.join(OVERLAP_COLS)} FROM ({SYNTH_TABLE_SQL})),
b AS (SELECT * FROM s INTERSECT SELECT {', '.join(OVERLAP_COLS)} FROM {POL})
SELECT (SELECT count(*) FROM s) AS n_synthetic, (SELECT count(*) FROM b) AS n_copied,
  (SELECT count(*) FROM b)::DOUBLE / (SELECT count(*) FROM s) AS copied_rate""")
def overlap_rate(spark, sf):
    """AG25: share of distinct synthetic tuples that also occur in the real table."""
    return CMP.overlap_rate(_synth_table(spark, sf), policies(spark, sf), OVERLAP_COLS)


def _cmp_sql() -> str:
    from tabletwin.plans.compare_plans import describe_sql
    s = describe_sql("synthetic_rows", FITTED, "synthetic")
    r = describe_sql("real_rows", FITTED, "real")
    return f"""WITH synthetic_rows AS MATERIALIZED ({SYNTH_TABLE_SQL}), real_rows AS MATERIALIZED (SELECT * FROM {POL}),
s AS MATERIALIZED ({s}), r AS MATERIALIZED ({r})
SELECT s.column_name, s.stat, s.stat_order, s.synthetic, r.real,
  floor(((s.synthetic - r.real) / CASE WHEN r.real <> 0 THEN r.real END * 100) * 10.0 + 0.5) / 10.0 AS difference_pct
FROM s JOIN r ON s.column_name = r.column_name AND s.stat = r.stat"""


@query("compare_describe", _cmp_sql())
def compare_describe(spark, sf):
    """AG20/JN5: describe of synthetic and real side by side with the difference in %."""
    # both sides are read several times: made once, into the shared checkpoint folder
    return CMP.compare_describe(cut_lineage(_synth_table(spark, sf).select(*FITTED)), cut_lineage(policies(spark, sf).select(*FITTED)), FITTED)


# ---- SRC3 and the gamma / beta draws ------------------------------------------------------------

@query("real_sample", f"""SELECT policy_id, CAST(round(vehicle_age * 12) AS BIGINT) AS vehicle_age, customer_age, model, claim_status FROM
  (SELECT *, {sql_uniform(SEED, 'real_sample', 'policy_id')} AS _u FROM {POL})
  QUALIFY row_number() OVER (ORDER BY _u, policy_id) <= 2000""")
def real_sample(spark, sf):
    """SRC3/AG17: an exact 2,000-row seeded sample of the real table for comparison, vehicle age in months."""
    from tabletwin.operators.rank import exact_sample
    s = exact_sample(policies(spark, sf), 2000, seed=SEED, key="policy_id", salt="real_sample")
    return s.select("policy_id", F.round(F.col("vehicle_age") * 12).cast("bigint").alias("vehicle_age"),
                    "customer_age", "model", "claim_status")


@query("synth_numeric_gamma_beta")
def synth_numeric_gamma_beta(spark, sf):
    """SY16 gamma and beta: draws for the fitted
    gamma of events.value and beta of lineitem.l_discount, one draw per source row."""
    from tabletwin.operators.fit import fit_column
    out = []
    for name, src, col in (("gamma", "events", "value"), ("beta", "lineitem", "l_discount")):
        df = table(spark, sf, src)
        dist = fit_column(df, col, (name,))
        st = dict(_stats(df, col), integral=False)
        d = SY.with_drawn(ids(spark, df.count()), col, dist, st, SEED)
        out.append(d.select("id", F.lit(name).alias("family"), F.col(col).alias("x")))
    return out[0].unionByName(out[1])


def _moments_sql(src, col):
    return f"(SELECT avg({col}::DOUBLE) AS m, var_pop({col}::DOUBLE) AS v, min({col}::DOUBLE) AS mn, max({col}::DOUBLE) AS mx, count(*) AS n FROM {src})"


GAMMA_SRC = _moments_sql("lineitem", "l_quantity")
GAMMA_SHAPE = f"(SELECT round(m * m / v, 6) FROM {GAMMA_SRC})"


@query("synth_numeric_gamma", f"""SELECT id, {Q.finish(f"((SELECT round(v / m, 6) FROM {GAMMA_SRC}) * g)", f"(SELECT mn FROM {GAMMA_SRC})", f"(SELECT mx FROM {GAMMA_SRC})", False)} AS l_quantity
FROM {sql_gamma(SEED, 'num:l_quantity', Q.ids('SELECT count(*) FROM lineitem'), GAMMA_SHAPE)}""")
def synth_numeric_gamma(spark, sf):
    """SY16 gamma (loc 0, shape and scale from mean and variance): numbered tries, replayed in the oracle."""
    li = table(spark, sf, "lineitem")
    r = li.agg(F.avg("l_quantity").alias("m"), F.var_pop("l_quantity").alias("v")).first()
    return _draw_numeric(spark, li, "l_quantity", {"name": "gamma", "params": {"a": round(r.m * r.m / r.v, 6), "loc": 0.0, "scale": round(r.v / r.m, 6)}})


BETA_SRC = f"(SELECT (m - mn) / (mx - mn) AS m, v / ((mx - mn) * (mx - mn)) AS v, mn, mx FROM {_moments_sql('orders', 'o_totalprice')})"
BETA_A, BETA_B = (f"(SELECT round({x} * (m * (1 - m) / v - 1), 6) FROM {BETA_SRC})" for x in ("m", "(1 - m)"))


@query("synth_numeric_beta", f"""SELECT id, {Q.finish(f"((SELECT mn FROM {BETA_SRC}) + (SELECT mx - mn FROM {BETA_SRC}) * (ga.g / (ga.g + gb.g)))", f"(SELECT mn FROM {BETA_SRC})", f"(SELECT mx FROM {BETA_SRC})", False)} AS o_totalprice
FROM {sql_gamma(SEED, 'num:o_totalprice:a', Q.ids('SELECT count(*) FROM orders'), BETA_A)} ga
JOIN {sql_gamma(SEED, 'num:o_totalprice:b', Q.ids('SELECT count(*) FROM orders'), BETA_B)} gb USING (id)""")
def synth_numeric_beta(spark, sf):
    """SY16 beta over the column's range (a and b from mean and variance): the share of one gamma draw in two."""
    o = table(spark, sf, "orders")
    r = o.agg(F.avg("o_totalprice").alias("m"), F.var_pop("o_totalprice").alias("v"), F.min("o_totalprice").alias("mn"), F.max("o_totalprice").alias("mx")).first()
    span = r.mx - r.mn
    m, v = (r.m - r.mn) / span, r.v / (span * span)
    k = m * (1 - m) / v - 1
    return _draw_numeric(spark, o, "o_totalprice", {"name": "beta", "params": {"a": round(m * k, 6), "b": round((1 - m) * k, 6), "loc": r.mn, "scale": span}})
