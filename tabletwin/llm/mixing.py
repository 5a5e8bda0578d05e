"""Mixing sources to target weights with exact budgets, DataFrame functions only.

Each document has a size in words and a hash-random key (md5 of its id). Sources get targets from their weights;
a target stops at ``max_epochs`` times its source's size and the excess is shared again by weight. A source's
budget is cut at an exact word: whole passes over the source, then the documents in key order until the budget
is used up; the last one is taken in part. The order within a source comes from a range sort into key bins and
prefix sums of the bins' sizes, so a source with a third of all rows is spread over up to 4,096 groups.

Cases: a null source is a source (last in order); null and empty texts have size 0 and are never taken; repeated
rows are separate rows with equal keys; an empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabletwin.llm.store import named, unused, WORD, word_count, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Plans of up to this many sources (one short row each) are broadcast.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row per source.

    Targets are min(level * weight, max_epochs * size) for the one level at which they add up to the total: in the
    order of size / weight, the first source that is not full at the level its predecessors leave fixes it (later levels are lower).
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sizes.withColumn("_i", (F.row_number().over(order) - 1) % len(weights))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") + 1))
    s = s.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    here_on = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    earlier = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    s = s.withColumn("_level", left / F.sum("_w").over(here_on))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(every))
    return s.select("source", "source_size", F.least(F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def mix_key(doc_id):
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def shares(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, passes, part) of every row of ``docs`` (doc_id, text, source):
    ``passes`` whole passes over the source, then ``part`` words of this document."""
    key = mix_key(F.col("doc_id"))
    # the table is read for its words once; what follows are a few numbers per document
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"))
                    .withColumn("_bin", F.substring("_key", 1, 3)), "mix")
    bins = sized.groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
    plan = targets(bins.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    before = F.sum("_words").over(W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    bins = bins.withColumn("_before", F.coalesce(before, F.lit(0)))
    bins = (bins.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
                .select("b.source", "b._bin", "_before", "source_size", "target"))
    inside = W.partitionBy("source", "_bin").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s = (sized.alias("d").join(bins.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d._bin") == F.col("b._bin")))
              .select("d.doc_id", "d.source", "d.size", F.col("d._key").alias("key"), "d._inside", "b._before", "b.source_size", "b.target"))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_inside")))
    return s.select("doc_id", "source", "size", "source_size", "target", "key", passes.alias("passes"), part.cast("long").alias("part"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source)."""
    s = shares(docs, weights, max_epochs)
    return s.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, the one at the cut as a whole. Rows without words
    are left out. Each source's passes and its key at the cut are one row; texts are neither shuffled nor sorted."""
    s = shares(docs.select("doc_id", "text", "source"), weights, max_epochs)
    # beside the rows' own columns, under names that none of them has
    source, passes, at_cut, copies = (unused(docs.columns, n) for n in ("_source", "_passes", "_cut", "_copies"))
    cut = written(s.groupBy("source").agg(F.max("passes").alias(passes), F.max(F.when(F.col("part") > 0, F.col("key"))).alias(at_cut)), "cuts")
    cut = cut.withColumnRenamed("source", source)
    few = cut.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = docs.join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col(source)))
    last = F.coalesce(mix_key(F.col("doc_id")) <= F.col(at_cut), F.lit(False)).cast("int")
    times = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(WORD), F.col(passes).cast("int") + last).otherwise(F.lit(0))
    out = out.withColumn(copies, F.sequence(F.lit(1), times)).where(times > 0)
    return out.withColumn(copies, F.explode(copies)).select(*[named(c) for c in docs.columns])




MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)[((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C")) - 1) % 3 + 1] AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least((SELECT max(level) FROM l WHERE level <= cap / w) * w, cap) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (passes * size + greatest(0, least(size, round(target)::BIGINT - passes * source_size - before)))::BIGINT AS taken FROM e
"""
