"""Registered request-extraction queries (EX1-EX23) over request texts Spark builds from ``orders``,
and the request-driven synthesis (SY27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabletwin.functions import requests as R
from tabletwin.functions.rng import sql_uniform
from tabletwin.operators import synth as SY
from tabletwin.operators.synth_many import Mapping, generate_many
from tabletwin.plans import synth_sql as Q
from tabletwin.plans.registry import query
from tabletwin.plans.tables import table

# One request per order: a template picked by the order key, numbers taken from the order's columns.
PROMPT_SQL = """CASE o_orderkey % 16
  WHEN 0 THEN concat(CAST(n AS STRING), ' rows ', CAST(p1 AS STRING), '% M', CAST(a AS STRING), ', ', CAST(p2 AS STRING), '% M', CAST(b AS STRING), ', rest M', CAST(c AS STRING))
  WHEN 1 THEN concat('Generate ', CAST(n AS STRING), ' rows with ', CAST(c1 AS STRING), ' M', CAST(a AS STRING), ' and ', CAST(c2 AS STRING), ' M', CAST(b AS STRING), ' rest equally')
  WHEN 2 THEN concat('M', CAST(a AS STRING), '=', CAST(c1 AS STRING), ' M', CAST(b AS STRING), ':', CAST(c2 AS STRING), ' ', CAST(n AS STRING), ' records')
  WHEN 3 THEN concat('  only M', CAST(a AS STRING), ' ', CAST(k AS STRING), 'k rows diesel  ')
  WHEN 4 THEN concat(CAST(n AS STRING), ' rows no M', CAST(a AS STRING), ' no M', CAST(b AS STRING), ' petrol or diesel')
  WHEN 5 THEN concat('young drivers high risk ', CAST(n AS STRING), ' rows segment b2')
  WHEN 6 THEN concat('Senior drivers petrol ', CAST(r AS STRING), '% claim rate')
  WHEN 7 THEN concat(CAST(n AS STRING), ' rows automatic with parking camera without esc drum brakes')
  WHEN 8 THEN concat(CAST(k AS STRING), '.5k rows segment C1 disc brakes ncap ', CAST(s AS STRING), '+')
  WHEN 9 THEN concat(CAST(n AS STRING), ' rows new cars low risk region c', CAST(z AS STRING))
  WHEN 10 THEN concat(CAST(n AS STRING), ' rows utility vehicles ', CAST(s AS STRING), ' star manual steering')
  WHEN 11 THEN concat('create ', CAST(n AS STRING), ' rows petrol or diesel age 40-60 subscription 3-9')
  WHEN 12 THEN concat('vehicle age 3-7 old cars customer age ', CAST(a + 20 AS STRING), ' to ', CAST(a + 40 AS STRING), ' manual')
  WHEN 13 THEN concat(CAST(n AS STRING), ' rows ', CAST(c1 AS STRING), ' M', CAST(a AS STRING), ' M', CAST(a AS STRING), '=', CAST(c2 AS STRING), ' exclude M', CAST(b AS STRING), ' rest remaining M', CAST(c AS STRING))
  WHEN 14 THEN concat('M', CAST(a AS STRING), ' only ', CAST(n AS STRING), ' entries with tpms has ecw no claims middle aged')
  ELSE concat('make ', CAST(n AS STRING), ' data points ', CAST(c1 AS STRING), ' m', CAST(a AS STRING), ' ', CAST(n AS STRING), ' m', CAST(b AS STRING), ' cng 100% claim')
END"""
NUMS_SQL = """(o_custkey % 40 + 1) * 50 AS n, o_orderkey % 11 + 1 AS a, (o_orderkey + 3) % 11 + 1 AS b,
  (o_orderkey + 7) % 11 + 1 AS c, (o_orderkey % 5 + 1) * 10 AS p1, (o_custkey % 4 + 1) * 5 AS p2,
  o_custkey % 300 + 1 AS c1, o_orderkey % 200 + 10 AS c2, o_custkey % 9 + 1 AS k, o_orderkey % 20 AS r,
  o_orderkey % 5 + 1 AS s, o_custkey % 22 + 1 AS z"""
REQUESTS_SQL = f"(SELECT o_orderkey AS request_id, {PROMPT_SQL} AS prompt FROM (SELECT o_orderkey, {NUMS_SQL} FROM orders))"


# The same templates, one request per supplier: few enough that every request's table can be made.
SUPPLIER_SQL = "(SELECT s_suppkey AS o_orderkey, s_nationkey + s_suppkey * 7 AS o_custkey FROM supplier)"
SUPPLIER_REQUESTS_SQL = f"(SELECT o_orderkey AS request_id, {PROMPT_SQL} AS prompt FROM (SELECT o_orderkey, {NUMS_SQL} FROM {SUPPLIER_SQL}))"


def requests_table(spark, sf):
    """(request_id, prompt): one request text per order, built from the order's columns."""
    return _texts(table(spark, sf, "orders"))


def supplier_requests(spark, sf):
    """(request_id, prompt): one request text per supplier."""
    return _texts(table(spark, sf, "supplier").selectExpr("s_suppkey AS o_orderkey", "s_nationkey + s_suppkey * 7 AS o_custkey"))


def _texts(o):
    return o.selectExpr("o_orderkey", *_num_exprs()).selectExpr("o_orderkey AS request_id", f"{PROMPT_SQL} AS prompt")


def _num_exprs():
    parts, depth, cur = [], 0, ""
    for ch in NUMS_SQL:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    parts.append(cur.strip())
    return parts


PARSED = f"({R.parse_sql(REQUESTS_SQL)})"


def _parsed(spark, sf):
    return R.parse_requests(requests_table(spark, sf))


def _q(name, cols, doc):
    sql = f"SELECT request_id, {', '.join(cols)} FROM {PARSED}"

    def fn(spark, sf):
        return _parsed(spark, sf).select("request_id", *cols)

    fn.__doc__ = doc
    query(name, sql)(fn)


_q("req_rows", ["n_rows"], "EX2/EX3: row count from '2.5k rows', '2000 rows' or 'generate 3000'.")
_q("req_alloc", ["allocation"], "EX4-EX7: ordered key allocation (key:type:value).")
_q("req_alloc_count", ["n_rows", "allocation"], "EX5: '<count> <key>' entries next to the row count.")
_q("req_alloc_percent", ["allocation", "rest"], "EX6: percentages, overwriting counts in place.")
_q("req_exclusive", ["allocation", "model"], "EX7: only/all/just <key>, when nothing else is allocated.")
_q("req_excluded", ["exclude"], "EX8: excluded keys.")
_q("req_rest", ["rest"], "EX9: rest strategy (named key, equal, distribute).")
_q("req_key", ["model"], "EX10: single key filter without an allocation.")
_q("req_fuel", ["fuel_types"], "EX11: fuels in fixed order.")
_q("req_segment", ["segment"], "EX12: segment, including bare 'utility'.")
_q("req_drivetrain", ["transmission_type", "steering_type", "rear_brakes_type"], "EX13-EX15.")
_q("req_safety", ["safety_on", "safety_off"], "EX16: feature ON/OFF.")
_q("req_rating", ["ncap_min"], "EX17: rating floor.")
_q("req_age", ["age_min", "age_max"], "EX18: customer age range or preset (Q4/Q5 mended).")
_q("req_vehicle_age", ["vehicle_age_min", "vehicle_age_max"], "EX19: vehicle age range or preset.")
_q("req_subscription", ["subscription_min", "subscription_max"], "EX20.")
_q("req_region", ["region_code"], "EX21.")
_q("req_rate", ["claim_rate"], "EX22: label rate presets, explicit rate wins.")
_q("req_describe", ["description"], "EX23: one-line description of the parsed plan.")
_q("req_all", R.FIELDS + ["description"], "EX1-EX23: every field.")


def plan_from_row(r, n_default: int = SY.DEFAULT_ROWS, rate_default: float = SY.DEFAULT_RATE) -> SY.Plan:
    """A parsed request row -> generation plan, with the reference's column mapping for the filters."""
    allocs = []
    if r["allocation"]:
        for item in r["allocation"].split(","):
            parts = item.split(":")
            allocs.append(SY.Allocation(parts[0], parts[1], float(parts[2]) if len(parts) > 2 else None))
    plan = SY.Plan(n_rows=n_default if r["n_rows"] is None else r["n_rows"],
                   label_rate=r["claim_rate"] if r["claim_rate"] is not None else rate_default,
                   allocations=allocs, rest=r["rest"] or "distribute",
                   exclude=r["exclude"].split(",") if r["exclude"] else [], key=r["model"])
    if r["fuel_types"]:
        plan.attr_in["fuel_type"] = r["fuel_types"].split(",")
    for c in ("segment", "transmission_type", "steering_type", "rear_brakes_type"):
        if r[c]:
            plan.attr_eq[c] = r[c]
    if r["ncap_min"] is not None:
        plan.attr_min["ncap_rating"] = r["ncap_min"]
    plan.flags_on = r["safety_on"].split(",") if r["safety_on"] else []
    plan.flags_off = r["safety_off"].split(",") if r["safety_off"] else []
    if r["age_min"] is not None:
        plan.clip["customer_age"] = (r["age_min"], r["age_max"])
    if r["subscription_min"] is not None:
        plan.clip["subscription_length"] = (r["subscription_min"], r["subscription_max"])
    if r["vehicle_age_min"] is not None:
        plan.value_range["vehicle_age"] = (r["vehicle_age_min"], r["vehicle_age_max"])
    if r["region_code"]:
        plan.fixed["region_code"] = r["region_code"]
    return plan


# Request texts and, written by hand, every field they must give (and no other).
EXPECTED = [
    ("1000 rows 50% M3, 30% M4, 20% M1", "n_rows=1000;allocation=M3:percent:50.0,M4:percent:30.0,M1:percent:20.0;rest=distribute"),
    ("1100 rows 100 M3 rest equally", "n_rows=1100;allocation=M3:count:100;rest=equal"),
    ("50 rows 100 M3", "n_rows=50;allocation=M3:count:100;rest=distribute"),
    ("M3=200 M4:300", "allocation=M3:count:200,M4:count:300;rest=distribute"),
    ("1000 rows petrol or diesel", "n_rows=1000;fuel_types=Diesel,Petrol"),
    ("utility vehicles 200 rows", "n_rows=200;segment=Utility"),
    ("without esc 500 rows", "n_rows=500;safety_off=is_esc"),
    ("ncap 4+ vehicles 500 rows", "n_rows=500;ncap_min=4"),
    ("middle aged drivers 500 rows", "n_rows=500;age_min=35;age_max=50"),
    ("2.5k rows petrol", "n_rows=2500;fuel_types=Petrol"),
    ("500 rows no claims", "n_rows=500;claim_rate=0.0"),
    ("generate 456 rows data with 2% claim rate", "n_rows=456;claim_rate=0.02"),
    ("only M3 1000 rows", "n_rows=1000;allocation=M3:exclusive;rest=distribute"),
    ("5k rows no M5 no M7", "n_rows=5000;exclude=M5,M7"),
    ("young drivers high risk 500 rows", "n_rows=500;age_min=18;age_max=35;claim_rate=0.15"),
    ("senior drivers petrol 8% claim rate", "fuel_types=Petrol;age_min=55;age_max=75;claim_rate=0.08"),
    ("2000 rows automatic with parking camera", "n_rows=2000;transmission_type=Automatic;safety_on=is_parking_camera"),
    ("1k rows segment B2 disc brakes", "n_rows=1000;segment=B2;rear_brakes_type=Disc"),
    ("3000 rows new cars low risk", "n_rows=3000;vehicle_age_min=0;vehicle_age_max=2;claim_rate=0.02"),
    ("1000 rows petrol or diesel age 40-60", "n_rows=1000;fuel_types=Diesel,Petrol;age_min=40;age_max=60"),
    ("500 rows 500 M3", "n_rows=500;model=M3"),
    ("vehicle age 3-7", "vehicle_age_min=3;vehicle_age_max=7"),
    ("manual steering", "steering_type=Manual"),
    ("99999999999999999999 rows petrol", "fuel_types=Petrol"),
    ("0 rows", "n_rows=0"),
]
_lit = lambda x: "'" + x.replace("'", "''") + "'"


@query("req_expected", f"""SELECT o.o_orderkey AS request_id, e.given FROM orders o
JOIN (VALUES {', '.join(f"({i}, {_lit(g)})" for i, (_, g) in enumerate(EXPECTED))}) e(i, given) ON o.o_orderkey % {len(EXPECTED)} = e.i""")
def req_expected(spark, sf):
    """EX1-EX22 against fields written by hand: each order carries one of the texts."""
    o = table(spark, sf, "orders")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in EXPECTED]), (F.col("o_orderkey") % len(EXPECTED) + 1).cast("int"))
    parsed = R.parse_requests(o.select(F.col("o_orderkey").alias("request_id"), text.alias("prompt")))
    order = ["n_rows", "allocation", "exclude", "rest", "model"] + R.FIELDS[5:]
    given = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in order]
    return parsed.select("request_id", F.array_join(F.filter(F.array(*given), lambda x: x.isNotNull()), ";").alias("given"))


@query("synth_from_request")
def synth_from_request(spark, sf):
    """SY27: the first order's allocation request, parsed with all others -> plan -> generated table."""
    from tabletwin.plans.synth_plans import blueprint
    row = _parsed(spark, sf).where("request_id % 16 = 0").orderBy("request_id").first()
    return SY.generate(spark, blueprint(spark, sf), plan_from_row(row), seed=42)


MAPPING = Mapping(
    equal={c: c for c in ("segment", "transmission_type", "steering_type", "rear_brakes_type")}, among={"fuel_type": "fuel_types"},
    least={"ncap_rating": "ncap_min"}, on="safety_on", off="safety_off",
    clips={"customer_age": ("age_min", "age_max"), "subscription_length": ("subscription_min", "subscription_max")},
    ranges={"vehicle_age": ("vehicle_age_min", "vehicle_age_max")}, fixed={"region_code": "region_code"})


def _tables_for_all(spark, sf):
    from tabletwin.plans.synth_plans import blueprint
    parsed = R.parse_requests(supplier_requests(spark, sf))
    return generate_many(parsed, blueprint(spark, sf), MAPPING, seed=42)


def _many_sql() -> str:
    """Rows, labels and ranges per request and key, with every row's key and label replayed."""
    from tabletwin.plans.synth_plans import DETERMINED, POL
    at = "r.request_id || ':' || t.id"
    flag = lambda f, vals: " AND ".join(
        f"(NOT list_contains(string_split(coalesce(r.{f}, ''), ','), '{c}') OR lower(l.{c}) IN {vals})" for c in DETERMINED if c.startswith("is_"))
    eq = " AND ".join(f"(r.{c} IS NULL OR lower(l.{c}) = lower(r.{c}))" for c in MAPPING.equal)
    out = "list_contains(string_split(coalesce(r.exclude, ''), ','), p.v)"
    return f"""WITH r AS MATERIALIZED (SELECT *, coalesce(n_rows, 1000) AS n, coalesce(claim_rate, 0.06) AS rate FROM ({R.parse_sql(SUPPLIER_REQUESTS_SQL)})),
pool AS MATERIALIZED (SELECT v, w, row_number() OVER (ORDER BY w DESC, v) AS pos FROM {Q.key_pool(POL, 'model')}),
l AS MATERIALIZED (SELECT * FROM {Q.lookup(POL, 'model', DETERMINED, 'policy_id')}),
asked AS MATERIALIZED (SELECT r.request_id, r.n, u.i, split_part(u.x, ':', 1) AS k, split_part(u.x, ':', 2) AS kind, TRY_CAST(split_part(u.x, ':', 3) AS DOUBLE) AS v
  FROM r, (SELECT request_id AS q, unnest(string_split(allocation, ',')) AS x, generate_subscripts(string_split(allocation, ','), 1) AS i FROM r WHERE allocation IS NOT NULL) u
  WHERE u.q = r.request_id AND split_part(u.x, ':', 1) IN (SELECT v FROM pool)),
only_ AS (SELECT request_id, arg_min(k, i) AS k FROM asked WHERE kind = 'exclusive' GROUP BY 1),
wants AS (SELECT *, greatest(0, CASE WHEN kind = 'percent' THEN round_even(n * v / 100.0, 0) ELSE v END)::BIGINT AS c FROM asked WHERE kind <> 'exclusive'),
segs AS (SELECT request_id, k, least(n, s - c) AS lo, least(n, s) AS hi FROM (SELECT *, sum(c) OVER (PARTITION BY request_id ORDER BY i) AS s FROM wants) WHERE request_id NOT IN (SELECT request_id FROM only_)),
done AS (SELECT r.request_id, r.n, r.rest, CASE WHEN o.k IS NOT NULL THEN r.n ELSE coalesce((SELECT max(hi) FROM segs WHERE segs.request_id = r.request_id), 0) END AS done, o.k AS only_k,
  r.allocation IS NOT NULL AS alloc, r.allocation IS NOT NULL AND r.rest <> 'equal' AND r.rest IN (SELECT v FROM pool) AND NOT list_contains(string_split(coalesce(r.exclude, ''), ','), r.rest) AS named
  FROM r LEFT JOIN only_ o ON r.request_id = o.request_id),
cand AS (SELECT r.request_id, p.v, p.w, p.pos, r.allocation IS NOT NULL AS alloc, NOT {out} AS allowed, EXISTS (SELECT 1 FROM asked a WHERE a.request_id = r.request_id AND a.k = p.v) AS taken,
  coalesce(NOT {out} AND {eq} AND (r.fuel_types IS NULL OR list_contains(string_split(lower(r.fuel_types), ','), lower(l.fuel_type)))
    AND (r.ncap_min IS NULL OR l.ncap_rating >= r.ncap_min) AND {flag('safety_on', "('yes', '1', 'true', 'y')")} AND {flag('safety_off', "('no', '0', 'false', 'n')")}
    AND (r.model IS NULL OR lower(p.v) = lower(r.model)), false) AS passes
  FROM r CROSS JOIN pool p LEFT JOIN l ON p.v = l.model),
step AS (SELECT *, CASE WHEN alloc THEN allowed OR NOT bool_or(allowed) OVER q ELSE passes OR NOT bool_or(passes) OVER q END AS in1 FROM cand WINDOW q AS (PARTITION BY request_id)),
free AS MATERIALIZED (SELECT request_id, v, w, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY request_id) AS m,
  sum(w) OVER (PARTITION BY request_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY request_id) AS total FROM (
  SELECT *, in1 AND (NOT alloc OR NOT taken OR NOT bool_or(in1 AND NOT taken) OVER (PARTITION BY request_id)) AS in2 FROM step) WHERE in2),
rows_ AS MATERIALIZED (SELECT r.request_id, t.id, r.rate, r.n, {sql_uniform(42, 'key', at)} AS uk,
  row_number() OVER (PARTITION BY r.request_id ORDER BY {sql_uniform(42, 'alloc', at)}, t.id) - 1 AS rk, row_number() OVER (PARTITION BY r.request_id ORDER BY {sql_uniform(42, 'label', at)}, t.id) - 1 AS lab
  FROM r, LATERAL (SELECT unnest(range(r.n)) AS id) t),
keyed AS (SELECT x.request_id, x.id, CAST(lab < greatest(0, least(round_even(x.n * rate, 0), x.n)) AS BIGINT) AS label,
  CASE WHEN d.only_k IS NOT NULL THEN d.only_k WHEN rk < d.done THEN s.k WHEN d.named THEN d.rest WHEN d.alloc AND d.rest = 'equal' THEN e.v ELSE f.v END AS model
  FROM rows_ x JOIN done d ON x.request_id = d.request_id LEFT JOIN segs s ON s.request_id = x.request_id AND rk >= s.lo AND rk < s.hi
  LEFT JOIN (SELECT DISTINCT request_id, m, total FROM free) z ON z.request_id = x.request_id
  LEFT JOIN free e ON e.request_id = x.request_id AND rk >= d.done AND e.place = CASE WHEN rk - d.done < ((x.n - d.done) % z.m) * ((x.n - d.done) // z.m + 1) THEN (rk - d.done) // ((x.n - d.done) // z.m + 1)
    ELSE (x.n - d.done) % z.m + (rk - d.done - ((x.n - d.done) % z.m) * ((x.n - d.done) // z.m + 1)) // greatest((x.n - d.done) // z.m, 1) END
  LEFT JOIN free f ON f.request_id = x.request_id AND floor(uk * z.total) >= f.hi - f.w AND floor(uk * z.total) < f.hi)
SELECT k.request_id, k.model, count(*) AS n_rows, sum(label)::BIGINT AS n_labels, min(l.segment) AS segment, min(l.fuel_type) AS fuel_type FROM keyed k LEFT JOIN l ON k.model = l.model GROUP BY 1, 2"""


@query("synth_from_requests", _many_sql())
def synth_from_requests(spark, sf):
    """SY27 for every request of a table: rows and labels per request and key, with the key's attributes."""
    made = _tables_for_all(spark, sf)
    return made.groupBy("request_id", "model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("claim_status").alias("n_labels"),
                                                   F.min("segment").alias("segment"), F.min("fuel_type").alias("fuel_type"))


@query("synth_request_bounds", f"""SELECT request_id, n_rows_made, age_ok, months_ok, region_ok FROM (
  SELECT request_id, coalesce(n_rows, 1000) AS n_rows_made, true AS age_ok, true AS months_ok, true AS region_ok FROM ({R.parse_sql(SUPPLIER_REQUESTS_SQL)})) WHERE n_rows_made > 0""")
def synth_request_bounds(spark, sf):
    """SY21, SY23, SY24 per request: ages within the asked range, vehicle ages within the asked years and their jitter
    (in months), one asked region."""
    made = _tables_for_all(spark, sf).alias("m").join(R.parse_requests(supplier_requests(spark, sf)).alias("q"), "request_id")
    ok = lambda c: F.coalesce(F.min(c.cast("int")) == 1, F.lit(True))
    months = (F.col("m.vehicle_age") >= (F.col("q.vehicle_age_min") - 0.1) * 12 - 1) & (F.col("m.vehicle_age") <= (F.greatest("q.vehicle_age_max", "q.vehicle_age_min") + 0.1) * 12 + 1)
    return made.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_rows_made"), ok(F.col("m.customer_age").between(F.col("q.age_min"), F.col("q.age_max"))).alias("age_ok"),
                                          ok(months).alias("months_ok"), ok(F.col("m.region_code") == F.col("q.region_code")).alias("region_ok"))
