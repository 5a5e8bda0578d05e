"""Registered queries of the operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tabletwin.llm import bitplane, bpe, decontam, jaccard, mixing, phrases, pii, quality, recompress, rules, secrets, sharding, suffix
from tabletwin.llm.store import shared_path, source_table

SHARDS = 24


def op2_jaccard_join(spark, sf_dir):
    return jaccard.component_rows(source_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix.cleaned(source_table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(source_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op1_pii(spark, sf_dir):
    return pii.find(source_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    # which rule rejects first depends on measured costs; the verdict does not
    return rules.judge(source_table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_quality_classifier(spark, sf_dir):
    return quality.classify(source_table(spark, sf_dir, "documents"), source_table(spark, sf_dir, "labels"))


def op7_decontamination(spark, sf_dir):
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark(docs, source_table(spark, sf_dir, "benchmark"))


def op8_secrets(spark, sf_dir):
    versions = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    # an earlier run has recorded the older ids; this one scans all, and of their contents only those that are new
    ledger = shared_path(spark, "ledger")
    middle = versions.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    secrets.record(versions.where(F.col("doc_id") <= F.lit(middle)), ledger)
    found = secrets.scan(versions, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
                        F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op9_substring_dedup(spark, sf_dir):
    return recompress.cleaned(source_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs, [1.0] * SHARDS, key="doc_id", text="text", grow_by=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")



def op11_bpe(spark, sf_dir):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(source_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_bitplane_clusters(spark, sf_dir):
    out = bitplane.cluster(source_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, salt="2:")
    code = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", code.alias("centroid_sha256"))


def op13_collocations(spark, sf_dir):
    return phrases.collocations(source_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sharding": op10_sharding,
    "op11_bpe": op11_bpe,
    "op12_bitplane_clusters": op12_bitplane_clusters,
    "op13_collocations": op13_collocations,
}
ORACLE = {
    "op4_mixing": mixing.MIX_SQL,
    "op9_substring_dedup": recompress.CLEAN_SQL,
    "op12_bitplane_clusters": bitplane.cluster_sql(),
}
