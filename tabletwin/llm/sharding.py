"""Sharding by rendezvous hashing (highest random weight), DataFrame functions only.

Every (record key, shard) pair gets a draw u in (0, 1) from md5; the record goes to the shard with the least
-ln(u) / weight. Shards receive rows in proportion to their weights, any record's choice depends on its key and
the shards alone, and a further shard only takes rows into itself: no row moves between old shards.

Cases: a null key is one key of its own (all its rows meet in one shard); repeated rows get the same shard and
different slots; null texts have no bytes; an empty table gives an empty result; further columns are kept
unless their name is one of the result's, which the result's column replaces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabletwin.llm.store import named, unused, utf8_bytes

#: Slots are numbered within (shard, bin) and shifted by the counts before: a shard is no single task.
SLOT_BINS = 4096


def draw(key: Column, shard: int) -> Column:
    """u in (0, 1): the first 52 bits of md5("key|shard")."""
    hexes = F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of each key; ``weights[s]`` > 0 is shard s's share."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    cost = [F.struct((-F.ln(draw(key, s)) / F.lit(float(w))).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    best = cost[0] if len(cost) == 1 else F.least(*cost)
    return best["s"].cast("int")


def record_key(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), col.cast("string")), F.lit("null"))


def shard(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grow_by: float | None = 1.0) -> DataFrame:
    """Rows of ``df`` without ``text``, plus size (bytes + 8), text_crc32, shard, slot (gapless from 0 in each
    shard) and grown_shard (the shard if one more of weight ``grow_by`` is added; null if ``grow_by`` is None)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.select(
        *[named(c) for c in df.columns if c not in {text, "size", "text_crc32", "shard", "slot", "grown_shard"}],
        (utf8_bytes(F.col(text)) + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    at = record_key(F.col(key))
    out = out.withColumn("shard", rendezvous(at, weights))
    if grow_by is None:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        # only the new shard can take a row away: one more draw against the winner's
        won = F.element_at(F.array(*[-F.ln(draw(at, s)) / F.lit(float(w)) for s, w in enumerate(weights)]), F.col("shard") + 1)
        new = -F.ln(draw(at, len(weights))) / F.lit(float(grow_by))
        out = out.withColumn("grown_shard", F.when(new < won, F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    return slots(out, key)


def with_shard(df: DataFrame, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """All columns of ``df`` and ``shard``; rows are not moved."""
    return df.withColumn("shard", rendezvous(record_key(F.col(key)), weights))


def slots(df: DataFrame, key: str) -> DataFrame:
    """Gapless numbers from 0 in each shard: counts of (shard, bin) are summed over bins, rows are numbered within."""
    # beside the rows' own columns, under names that none of them has
    at, place, before_bin = (unused(df.columns, n) for n in ("_bin", "_k", "_first"))
    df = df.withColumn(at, F.conv(F.substring(F.md5(F.concat_ws("|", record_key(F.col(key)), "size", "text_crc32")), 1, 3), 16, 10).cast("int") % SLOT_BINS)
    bins = df.groupBy("shard", at).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    # at most shards x SLOT_BINS rows of three numbers, whatever the input
    first = bins.select("shard", at, F.coalesce(before, F.lit(0)).alias(before_bin))
    within = F.row_number().over(W.partitionBy("shard", at).orderBy(key, "size", "text_crc32")) - 1
    return (df.withColumn(place, within).join(first, ["shard", at])
              .withColumn("slot", (F.col(before_bin) + F.col(place)).cast("long")).drop(at, place, before_bin))


def expected_share(weights: Sequence[float]) -> list[float]:
    total = math.fsum(weights)
    return [w / total for w in weights]
