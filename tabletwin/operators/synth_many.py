"""Tables for many requests in one job (SY27).

Requests are a table, one parsed plan per row, and their rows are made together. A request of up to ``RANK_PART`` rows is
made and ranked where its plan lies, so its rows are never shuffled. A larger one becomes blocks of row numbers, so one
request for billions of rows is many tasks, and its ranks come from prefix sums over (request, part of the draw). What a
plan asks for (allocation ends, filtered keys, ranges) are columns that rows meet by the request's id; plans are
dealt by it and stay on the executors.

Draws are keyed by request and row number: a request gives the same rows whatever other requests stand beside it.

Results for odd cases: no rows asked gives none; missing fields take the defaults; unknown allocated keys are skipped;
filters or exclusions that leave no key do not count; an empty range gives its lower end; an unknown fixed value gives
null attributes; a request id must be unique and not null (rows of repeated ids are an error). The key may have up to
``MANY_KEYS`` values, since each plan carries its keys; more is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletwin.functions.rng import uniform
from tabletwin.operators import synth as SY
from tabletwin.operators.rank import BROADCAST_POOL, part_of, prefix_sum, split_points
from tabletwin.session import cut_lineage

MANY_KEYS = 10_000
BLOCK_ROWS = 10_000
#: Rows ranked in one window; also the rows of a task's requests together, on average at most four times this many.
RANK_PART = 250_000
#: Plans of large requests up to this many are broadcast to their rows; more are joined by a shuffle.
BROADCAST_PLANS = 1_000


@dataclass
class Mapping:
    """Which fields of a request speak of which columns: filters on key attributes (``equal``: one value, ``among``: a
    comma list, ``least``: a lower bound; ``on`` and ``off``: fields that list flags), ``clips`` and ``ranges`` (column to
    lower and upper field) and ``fixed`` (sampled column to field)."""

    equal: dict[str, str] = field(default_factory=dict)
    among: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    on: str | None = None
    off: str | None = None
    clips: dict[str, tuple[str, str]] = field(default_factory=dict)
    ranges: dict[str, tuple[str, str]] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=dict)


def _list(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, ","))


def _if_any(chosen: Column, other: Column) -> Column:
    return F.when(F.size(chosen) > 0, chosen).otherwise(other)


def _pool_row(bp: SY.Blueprint, mapping: Mapping) -> DataFrame:
    """One row: the keys as array<struct<count, key, attributes>>, in pool order."""
    if bp.key_counts.limit(MANY_KEYS + 1).count() > MANY_KEYS:
        raise ValueError(f"{bp.key} has more than {MANY_KEYS} values")
    look = bp.lookup.withColumn(bp.key, F.col(bp.key).cast("string"))
    d = bp.key_counts.join(F.broadcast(look), bp.key, "left")
    each = F.struct((-F.col("count")).alias("neg"), F.col(bp.key).alias("key"), F.col("count").alias("w"),
                    F.struct(*[F.col(c).cast("string").alias(c) for c in bp.determined] or [F.lit(None).cast("string").alias("none")]).alias("attr"))
    return d.agg(F.array_sort(F.collect_list(each)).alias("_pool"))


def _passes(mapping: Mapping, determined: list[str], flags: list[str]):
    """The plan's filters (PF4-PF9) as a predicate on one key of the pool."""
    def keep(k: Column) -> Column:
        ok = F.lit(True)
        for c, f in mapping.equal.items():
            if c in determined:
                ok = ok & (F.col(f).isNull() | (F.lower(k["attr"][c]) == F.lower(F.col(f))))
        for c, f in mapping.among.items():
            if c in determined:
                ok = ok & (F.col(f).isNull() | F.array_contains(_list(F.lower(F.col(f))), F.lower(k["attr"][c])))
        for c, f in mapping.least.items():
            if c in determined:
                ok = ok & (F.col(f).isNull() | (k["attr"][c].cast("double") >= F.col(f).cast("double")))
        for f, values in ((mapping.on, SY.TRUTHY), (mapping.off, SY.FALSY)):
            for c in flags if f else ():
                ok = ok & (~F.array_contains(_list(F.col(f)), c) | F.lower(k["attr"][c]).isin(*values))
        ok = ok & (F.col("model").isNull() | (F.lower(k["key"]) == F.lower(F.col("model"))))
        return F.coalesce(ok & ~F.array_contains(_list(F.col("exclude")), k["key"]), F.lit(False))

    return keep


def plans(requests: DataFrame, bp: SY.Blueprint, mapping: Mapping) -> DataFrame:
    """One row per request: size, labelled rows, allocation ends and keys, the keys that share the rest and how
    (SY6-SY12, PF4-PF10), and the fields that later columns read. Column names start with an underscore."""
    p = requests.withColumn("_one", F.lit(1)).join(F.broadcast(_pool_row(bp, mapping).withColumn("_one", F.lit(1))), "_one")
    p = p.withColumn("_n", F.coalesce(F.col("n_rows").cast("bigint"), F.lit(SY.DEFAULT_ROWS)))
    rate = F.coalesce(F.col("claim_rate"), F.lit(SY.DEFAULT_RATE))
    p = p.withColumn("_labels", F.greatest(F.lit(0), F.least(F.bround(F.col("_n") * rate, 0).cast("bigint"), F.col("_n"))))
    known = F.transform("_pool", lambda k: k["key"])
    item = lambda x: F.struct(F.split(x, ":")[0].alias("key"), F.split(x, ":")[1].alias("kind"), F.get(F.split(x, ":"), 2).cast("double").alias("v"))
    p = p.withColumn("_known", known).withColumn("_asked", F.filter(F.transform(_list(F.col("allocation")), item), lambda a: F.array_contains(F.col("_known"), a["key"])))
    only = F.get(F.filter("_asked", lambda a: a["kind"] == "exclusive"), 0)["key"]
    wants = F.transform(F.filter("_asked", lambda a: a["kind"].isin("count", "percent")), lambda a: F.greatest(F.lit(0).cast("bigint"), F.when(
        a["kind"] == "percent", F.bround(F.col("_n") * a["v"] / 100.0, 0)).otherwise(a["v"]).cast("bigint")))
    p = p.withColumn("_only", only).withColumn("_wants", wants)
    ends = F.transform(F.sequence(F.lit(1), F.size("_wants")), lambda i: F.least(F.col("_n"), F.aggregate(
        F.slice("_wants", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, w: s + w)))
    ends = F.when(F.size("_wants") > 0, ends).otherwise(F.array().cast("array<bigint>"))
    p = p.withColumn("_ends", ends).withColumn("_keys", F.transform(F.filter("_asked", lambda a: a["kind"].isin("count", "percent")), lambda a: a["key"]))
    last = F.coalesce(F.get("_ends", F.size("_ends") - 1), F.lit(0).cast("bigint"))
    barred = F.array_contains(_list(F.col("exclude")), F.col("rest"))
    named = F.col("allocation").isNotNull() & (F.col("rest") != "equal") & F.array_contains(F.col("_known"), F.col("rest")) & ~barred & (last < F.col("_n"))
    p = p.withColumn("_to", F.when(F.col("_only").isNotNull(), F.col("_only")).when(named, F.col("rest")))
    p = p.withColumn("_ends", F.when(F.col("_only").isNotNull(), F.array("_n")).when(F.col("_to").isNotNull(), F.concat("_ends", F.array("_n"))).otherwise(F.col("_ends")))
    p = p.withColumn("_keys", F.when(F.col("_only").isNotNull(), F.array("_only")).when(F.col("_to").isNotNull(), F.concat("_keys", F.array("_to"))).otherwise(F.col("_keys")))
    p = p.withColumn("_done", F.coalesce(F.get("_ends", F.size("_ends") - 1), F.lit(0).cast("bigint")))
    flags = [c for c in bp.determined if c.startswith("is_")]
    p = p.withColumn("_filtered", F.filter("_pool", _passes(mapping, bp.determined, flags)))
    p = p.withColumn("_allowed", F.filter("_pool", lambda k: ~F.array_contains(_list(F.col("exclude")), k["key"])))
    p = p.withColumn("_allowed", _if_any(F.col("_allowed"), F.col("_pool")))
    others = F.filter("_allowed", lambda k: ~F.exists("_asked", lambda a: a["key"] == k["key"]))
    free = F.when(F.col("allocation").isNull(), _if_any(F.col("_filtered"), F.col("_pool"))).otherwise(_if_any(others, F.col("_allowed")))
    p = p.withColumn("_equal", F.col("allocation").isNotNull() & F.coalesce(F.col("rest") == "equal", F.lit(False)))
    pair = lambda k: F.struct(k["key"].alias("key"), k["w"].alias("w"))
    p = p.withColumn("_free", F.transform(free, pair))
    p = p.withColumn("_free", F.when(F.col("_equal"), F.col("_free")).otherwise(F.array_sort("_free")))
    p = p.withColumn("_sums", F.transform(F.sequence(F.lit(1), F.size("_free")), lambda i: F.aggregate(
        F.slice("_free", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, k: s + k["w"])))
    keep = [f for pair_ in [*mapping.clips.values(), *mapping.ranges.values()] for f in pair_] + list(mapping.fixed.values())
    return p.select("request_id", "_n", "_labels", "_ends", "_keys", "_done", "_equal", F.transform("_free", lambda k: k["key"]).alias("_rest"), "_sums",
                    *[F.col(f).alias(f"_q_{f}") for f in dict.fromkeys(keep)])


def row_numbers(p: DataFrame) -> DataFrame:
    """(request_id, id, _n): the rows of every plan, dealt out in blocks."""
    parallel = p.sparkSession.sparkContext.defaultParallelism
    total = p.agg(F.sum("_n")).first()[0] or 0
    blocks = p.where("_n > 0").select("request_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {BLOCK_ROWS}"))).alias("_b"))
    blocks = blocks.repartition(max(parallel, total // 1_000_000 + 1), "request_id", "_b")
    return blocks.select("request_id", "_n", F.explode(F.sequence(F.col("_b") * BLOCK_ROWS, F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK_ROWS) - 1)).alias("id"))


def _rank(rows: DataFrame, seed: int, salt: str, out: str) -> DataFrame:
    """A random order of each request's rows: the 0-based rank of (u, id)."""
    d = rows.withColumn("_u", uniform(seed, salt, "_draw"))
    part = F.floor(F.col("_u") * (F.floor(F.col("_n") / RANK_PART) + 1)).cast("int")
    return prefix_sum(d, F.lit(1).cast("bigint"), [F.col("_u"), F.col("id")], part, ["request_id"], lo_col=out, hi_col="_hi").drop("_u", "_hi")


def _key(seed: int) -> Column:
    """The key of a row from its rank and its plan."""
    r = F.col("_rank")
    fixed = F.get("_keys", F.size(F.filter("_ends", lambda e: e <= r)))
    left, m, at = F.col("_n") - F.col("_done"), F.size("_rest"), r - F.col("_done")
    share, more = F.floor(left / m), left % m
    wide = more * (share + 1)
    place = F.when(at < wide, F.floor(at / (share + 1))).otherwise(more + F.floor((at - wide) / F.greatest(share, F.lit(1))))
    target = F.floor(uniform(seed, "key", "_draw") * F.element_at("_sums", -1))
    drawn = F.get("_rest", F.size(F.filter("_sums", lambda s: s <= target)))
    return F.when(r < F.col("_done"), fixed).when(F.col("_equal"), F.get("_rest", place.cast("int"))).otherwise(drawn)


def _with_plan(rows: DataFrame, p: DataFrame) -> DataFrame:
    small = p.limit(BROADCAST_PLANS + 1).count() <= BROADCAST_PLANS
    # no broadcast of many plans, however well they compress in the shuffle
    return rows.drop("_n").join(F.broadcast(p) if small else p.hint("merge"), "request_id")


def _whole_requests(p: DataFrame, rows: int, seed: int, ranks: dict[str, str]) -> DataFrame:
    """The rows of plans that ask for at most ``RANK_PART``, ranked (``ranks``: salt by column) and with their plans. All
    steps share one dealing by the request, which only plans pass through."""
    parts = max(p.sparkSession.sparkContext.defaultParallelism, rows // (4 * RANK_PART) + 1)
    dealt = p.select("request_id", "_n").repartition(parts, "request_id")
    d = dealt.where("_n > 0").select("request_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("id"))
    draw = F.concat_ws(":", "request_id", "id")
    for out, salt in ranks.items():
        run = Window.partitionBy("request_id").orderBy("_u", "id")
        d = d.withColumn("_u", uniform(seed, salt, draw)).withColumn(out, F.row_number().over(run).cast("bigint") - 1).drop("_u")
    return d.drop("_n").join(p.repartition(parts, "request_id").hint("merge"), "request_id").withColumn("_draw", draw)


def _split_requests(p: DataFrame, seed: int, ranks: dict[str, str]) -> DataFrame:
    """The rows of larger requests in blocks, ranked over parts of the draw, with plans."""
    d = row_numbers(p).withColumn("_draw", F.concat_ws(":", "request_id", "id"))
    for out, salt in ranks.items():
        d = _rank(d, seed, salt, out)
    return _with_plan(d, p)


def _ranked_rows(p: DataFrame, seed: int, ranks: dict[str, str]) -> DataFrame:
    """Every row of every plan: its number and draw key, its ranks and its plan's columns."""
    wide = F.col("_n") > RANK_PART
    size = p.agg(F.sum(F.when(wide, F.col("_n"))).alias("wide"), F.sum(F.when(~wide, F.greatest("_n", F.lit(0)))).alias("whole")).first()
    whole = _whole_requests(p.where(~wide), size["whole"] or 0, seed, ranks)
    if not size["wide"]:
        return whole
    return whole.unionByName(_split_requests(p.where(wide), seed, ranks))


def _ranged_pool(pool: DataFrame, col: str, p: DataFrame, lo: str, hi: str, st: dict) -> tuple[DataFrame, DataFrame, int]:
    """(plans with _from and _upto, the running counts of the pool below and up to their range; the pool's intervals by
    bucket; buckets). The ends of the ranges stand among the values with weight zero, so one running sum gives both."""
    least = F.when(F.col(lo).isNotNull() | F.col(hi).isNotNull(), F.coalesce(F.col(lo).cast("double"), F.lit(float(st["min"]))))
    p = p.withColumn("_lo", least).withColumn("_up", F.when(F.col("_lo").isNotNull(), F.coalesce(F.col(hi).cast("double"), F.lit(float(st["max"])))))
    ranges = p.where(F.col("_lo").isNotNull()).select("_lo", "_up").distinct()
    ends = ranges.select(F.inline(F.array(F.struct(F.col("_lo").alias("v"), F.lit(0).alias("side")), F.struct(F.col("_up").alias("v"), F.lit(2).alias("side"))))).distinct()
    shape = pool.select(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"), split_points(64).alias("cuts")).first()
    cuts = F.array(*[F.lit(float(x)) for x in shape["cuts"] or []]).cast("array<double>")
    every = pool.select(F.col(col).alias("v"), F.lit(1).alias("side"), "w").unionByName(ends.withColumn("w", F.lit(0).cast("bigint")))
    run = cut_lineage(prefix_sum(every, F.col("w").cast("bigint"), [F.col("v"), F.col("side")], part_of(F.col("v"), cuts)))
    total = run.agg(F.sum("w")).first()[0]
    at = lambda side, name: run.where(F.col("side") == side).select(F.col("v").alias(name), F.col("cum_hi").alias(f"_c{name}"))
    known = ranges.join(at(0, "_lo"), "_lo").join(at(2, "_up"), "_up")
    p = (p.alias("p").join(known.alias("k"), (F.col("p._lo") == F.col("k._lo")) & (F.col("p._up") == F.col("k._up")), "left")
          .select("p.*", F.coalesce("_c_lo", F.lit(0)).alias("_from"), F.coalesce("_c_up", F.lit(total)).alias("_upto"), F.lit(total).alias("_total")))
    buckets = min(max(1024, shape["n"]), 1 << 30)
    b = lambda c: F.floor(F.col(c) / F.lit(float(total)) * buckets)
    held = run.where("side = 1").select(F.col("v").alias(col), "cum_lo", "cum_hi", F.explode(F.sequence(
        F.greatest(b("cum_lo") - 1, F.lit(0)), F.least(b("cum_hi") + 1, F.lit(buckets - 1)))).alias("_bucket"))
    return p.drop("_up"), F.broadcast(held) if shape["n"] <= BROADCAST_POOL else held, buckets


def _draw_in_range(df: DataFrame, col: str, held: DataFrame, buckets: int, seed: int) -> DataFrame:
    """SY20, SY21: one value of the column for every row, by its counts within the request's range."""
    k = F.col("_from") + F.floor(uniform(seed, f"boot:{col}", "_draw") * (F.col("_upto") - F.col("_from")))
    df = df.withColumn("_at", F.least(k, F.col("_total") - 1))
    df = df.withColumn("_bucket", F.least(F.floor(F.col("_at") / F.col("_total").cast("double") * buckets), F.lit(buckets - 1)))
    out = df.join(held, "_bucket").where((F.col("_at") >= F.col("cum_lo")) & (F.col("_at") < F.col("cum_hi")))
    out = out.withColumn(col, F.when(F.col("_upto") <= F.col("_from"), F.col("_lo")).otherwise(F.col(col)))
    return out.drop("_at", "_bucket", "cum_lo", "cum_hi", "_from", "_upto", "_total", "_lo")


def generate_many(requests: DataFrame, bp: SY.Blueprint, mapping: Mapping, seed: int = 42, perturb_numeric: bool = True) -> DataFrame:
    """(request_id, id, the blueprint's columns) for all ``requests`` (request_id and the parsed fields)."""
    p = cut_lineage(plans(requests, bp, mapping))
    sizes = p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("ids")).first()
    if sizes.n != sizes.ids:
        raise ValueError("request ids must be unique and not null")
    held = {}
    for c in bp.empirical:
        lo, hi = mapping.ranges.get(c, (None, None))
        q = p.withColumn(f"_q_{lo}", F.lit(None).cast("double")).withColumn(f"_q_{hi}", F.lit(None).cast("double")) if lo is None else p
        p, *held[c] = _ranged_pool(bp.numeric_counts(c), c, q, f"_q_{lo}", f"_q_{hi}", bp.stats[c])
        p = p.withColumnsRenamed({x: f"{x}:{c}" for x in ("_from", "_upto", "_total", "_lo")})
    p = cut_lineage(p)
    df = _ranked_rows(p, seed, {"_rank": "alloc"} | ({"_lab": "label"} if bp.label_col else {}))
    df = df.withColumn(bp.key, _key(seed))
    if bp.label_col:
        df = df.withColumn(bp.label_col, (F.col("_lab") < F.col("_labels")).cast("bigint"))
    df = df.drop("_keys", "_ends", "_rest", "_sums", "_lab", "_rank", "_labels", "_done", "_equal", "_n")
    look = bp.lookup.withColumn(bp.key, F.col(bp.key).cast("string"))
    df = df.join(F.broadcast(look) if bp.broadcast_lookup else look, bp.key, "left")
    if perturb_numeric:
        df = SY.perturb(df, bp, seed, "_draw")
    for c in bp.fitted:
        df = SY.with_drawn(df, c, bp.dists.get(c, {}), bp.stats[c], seed, "_draw")
        if c in mapping.clips:  # SY23; a missing bound does not count
            lo, hi = (F.col(f"_q_{f}") for f in mapping.clips[c])
            x = F.least(F.greatest(F.col(c), lo), hi)
            df = df.withColumn(c, x.cast("bigint") if bp.stats[c]["integral"] else x)
    for c, scale in bp.empirical.items():
        df = df.withColumnsRenamed({f"{x}:{c}": x for x in ("_from", "_upto", "_total", "_lo")})
        df = SY.jitter(_draw_in_range(df, c, *held[c], seed), bp, c, seed, scale, "_draw")
    for c, attached in bp.sampled.items():
        df = SY.draw_categorical(df, bp.spark, bp.cat_pools[c], c, seed, f"cat:{c}", "_draw")
        if c in mapping.fixed:  # SY24
            df = df.withColumn(c, F.coalesce(F.col(f"_q_{mapping.fixed[c]}"), F.col(c)))
        if attached:
            lk = bp.sampled_lookup[c].withColumn(c, F.col(c).cast("string"))
            df = df.join(lk if isinstance(bp.cat_pools[c], DataFrame) else F.broadcast(lk), c, "left")
    if bp.id_col:
        df = df.withColumn(bp.id_col, F.format_string(SY.ID_FORMAT, F.col("id")))
    return df.select("request_id", "id", *[c for c in bp.columns if c in df.columns])
