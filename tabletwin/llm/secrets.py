"""Secret scans over an incremental blob ledger, DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content (the blob). The ledger holds one row per
(blob, rule, rule version) with the spans found, empty ones too. A scan reads the ledger, runs each rule only over
blobs for which its present version is not recorded, appends the new rows and joins all findings back to every
path that holds the blob. Equal contents are scanned once, however many paths or versions carry them.

Spans are code points, end exclusive, leftmost and non-overlapping per rule. Positions come from marking the
matches with control characters and adding up the lengths of the pieces between the marks; control characters
U+0001 and U+0002 of the text itself are first replaced by U+0003 (no rule names any of them).

Cases: a null text is the empty text; repeated rows are separate paths; an empty table gives empty results;
columns other than the text come through ``paths`` unless they clash with a result's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletwin.llm.store import written

MATCH, GROUP, NEUTRAL = "\u0001", "\u0002", "\u0003"
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group ``group`` (0: all of it) has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Well-known token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
)
RULES = BASE_RULES + MORE_RULES


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's matches in one text (null if there are none)."""
    marked = F.regexp_replace(text, rule.pattern, f"{MATCH}$0{GROUP}${rule.group}{MATCH}")
    whole = lambda p: F.substring_index(p, GROUP, 1)

    def lengths(pieces):
        return F.transform(pieces, lambda p, i: F.length(F.when(i % 2 == 1, whole(p)).otherwise(p)))

    def long_enough(piece):
        return F.length(F.substring_index(piece, GROUP, -1)) >= rule.least

    def spans(pieces, lens, blocks):
        # lengths are added up block by block, so that a text with very many matches stays near linear
        def span(i):
            block = F.floor(i / BLOCK).cast("int")
            start = F.element_at(blocks, block + 1) + _sum(F.slice(lens, block * BLOCK + 1, i - block * BLOCK))
            return _let(start, lambda at: F.struct(
                at.alias("start"), F.lit(order).alias("rank"), (at + F.element_at(lens, i + 1)).alias("end"), F.lit(rule.kind).alias("kind")))

        at = F.filter(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: long_enough(F.element_at(pieces, i + 1)))
        return F.transform(at, span)

    def located(pieces):
        blocks = lambda lens: F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / BLOCK).cast("int")),
                                          lambda b: _sum(F.slice(lens, F.lit(1), b * BLOCK)))
        return _let(lengths(pieces), lambda lens: _let(blocks(lens), lambda bs: spans(pieces, lens, bs)))

    return _let(F.split(marked, MATCH), lambda pieces: F.when(F.size(pieces) > 1, located(pieces)))


SPAN_TYPE = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def neutral(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(MATCH) | t.contains(GROUP), F.translate(t, MATCH + GROUP, NEUTRAL * 2)).otherwise(t)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def new_findings(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) of the (blob, rule version) pairs that ``ledger`` does not have yet."""
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    blobs = blobs.groupBy("blob").agg(F.first("_t").alias("_t"))
    keys = [r.key for r in rules]
    if ledger is None:
        blobs = blobs.withColumn("_seen", F.array().cast("array<string>"))
    else:
        seen = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
        blobs = blobs.where(F.size("_seen") < len(keys))
    none = F.array().cast(SPAN_TYPE)

    def rows(text):
        return F.array(*[F.when(~F.array_contains("_seen", r.key), F.struct(
            F.lit(r.key).alias("rule"), F.coalesce(rule_spans(text, r, i).cast(SPAN_TYPE), none).alias("spans"))) for i, r in enumerate(rules)])

    return (blobs.select("blob", F.explode(F.filter(_let(neutral(F.col("_t")), rows), lambda x: x.isNotNull())).alias("r"))
                 .select("blob", "r.rule", "r.spans"))


LEDGER_SCHEMA = f"blob string, rule string, spans {SPAN_TYPE}"


def record(versions: DataFrame, ledger_path: str, rules=RULES, text: str = "text") -> None:
    """Add to the ledger what it lacks of ``versions``, without joining findings back to paths."""
    spark = versions.sparkSession
    old = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path) if _has_rows(spark, ledger_path) else None
    written(new_findings(versions, old, rules, text), "secrets").write.mode("append").parquet(ledger_path)


def scan(versions: DataFrame, ledger_path: str | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Rows of ``versions`` without the text, plus ``blob`` and ``spans`` (all findings of the rules' present
    versions, by start, then rule). With ``ledger_path`` (Parquet folder) the ledger is read and added to."""
    spark = versions.sparkSession
    paths = versions.select(*[F.col(f"`{c}`") for c in versions.columns if c not in {text, "blob", "spans"}], blob_of(F.col(text)).alias("blob"))
    if ledger_path is None:
        found = written(new_findings(versions, None, rules, text), "secrets")
    else:
        record(versions, ledger_path, rules, text)
        found = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    hits = (found.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
                 .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans")))
    return (paths.join(hits, "blob", "left")
                 .withColumn("spans", F.coalesce("spans", F.array().cast(SPAN_TYPE))))


def _has_rows(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
