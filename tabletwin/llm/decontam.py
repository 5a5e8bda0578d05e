"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

Texts become lower-case tokens of letters and digits. A mask such as 1101011 reads some positions of a window and
ignores the others, so a hit survives substitutions at ignored positions. Seeds of all benchmark positions are
hashed; seeds of all document positions are first tried against a bit table of the benchmark's hashes (three bits per
seed), the few that pass join the benchmark's seeds by hash, and every hit is verified: on the hit's diagonal some
window of ``MIN_TOKENS`` tokens around it must agree in all but ``MAX_DIFFERENT`` positions. Items shorter than the window must
agree as a whole, with at most a sixth of their tokens different. Their masks are the runs of tokens that a cut into one part
more than the allowed differences leaves: at least one part has none, so no placing is missed, at any length from one
token on. Documents are read at the lengths of such parts only if the benchmark has short items.

Cases: null and empty texts have no tokens; very long texts are read whole; repeated rows are judged each by
itself; an empty benchmark or an empty table marks nothing; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletwin.llm.store import written

#: Fixed masks: 1 is read, 0 is ignored.
MASKS = ("1101011", "11001011", "111011")
MIN_TOKENS = 13
MAX_DIFFERENT = 2
#: Benchmark seeds up to this many rows are broadcast; larger benchmarks are joined by a shuffle.
BROADCAST_SEEDS = 400_000
#: Contaminated documents up to this many (an id, a hash, item ids) are broadcast; more are joined by a shuffle.
BROADCAST_FOUND = 200_000
#: The bit table has 32 bits a seed within these bounds (as powers of two).
TABLE_BITS = (16, 24)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits (null or none: empty array)."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_at(hashes: Column, start: Column, mask: str, number: int) -> Column:
    """Hash of the word hashes that the mask reads at 0-based ``start``; the mask's number goes in."""
    return F.xxhash64(F.lit(number), *[F.get(hashes, start + i if i else start) for i, c in enumerate(mask) if c == "1"])


def positions(words: Column, mask: str) -> Column:
    n = F.size(words) - len(mask)
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def allowed(length: int) -> int:
    """Differences allowed in an item of ``length`` tokens, fewer than ``MIN_TOKENS``."""
    return length // 6


def parts_of(length: int) -> list[tuple[int, int]]:
    """(start, tokens) of the parts of a short item: one more than its allowed differences."""
    n = allowed(length) + 1
    cuts = [i * length // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def part_mask(length: int) -> tuple[int, str]:
    """Number and mask of a part of ``length`` tokens."""
    return len(MASKS) + length, "1" * length


def document_masks(items: DataFrame) -> list[tuple[int, str]]:
    """The masks that documents are read with: the fixed ones and those of the parts of the short items there are."""
    size = F.size(tokens(F.col("text")))
    short = [r.n for r in items.select(size.alias("n")).where(F.col("n").between(1, MIN_TOKENS - 1)).distinct().collect()]
    return list(enumerate(MASKS)) + [part_mask(k) for k in sorted({k for n in short for _, k in parts_of(n)})]


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_at, item_words) for every mask and position of the items (item_id, text)."""
    def of(hashes, mask, number):
        return F.transform(positions(hashes, mask), lambda i: F.struct(seed_at(hashes, i, mask, number).alias("seed"), i.alias("item_at")))

    def part(hashes, start, length):
        number, mask = part_mask(length)
        return F.struct(seed_at(hashes, F.lit(start), mask, number).alias("seed"), F.lit(start).alias("item_at"))

    def seeds(words):
        short = [F.when(F.size(words) == n, F.array(*[part(h, a, k) for a, k in parts_of(n)])) for h in [word_hashes(words)] for n in range(1, MIN_TOKENS)]
        long = let(word_hashes(words), lambda h: F.flatten(F.array(*[of(h, m, k) for k, m in enumerate(MASKS)])))
        return F.when(F.size(words) >= MIN_TOKENS, long).otherwise(F.coalesce(*short))

    w = items.select("item_id", tokens(F.col("text")).alias("item_words"))
    return w.select("item_id", "item_words", F.explode(seeds(F.col("item_words"))).alias("s")).select("s.seed", "item_id", "s.item_at", "item_words")


def slots(seed: Column, bits: int) -> list[Column]:
    """Three bit numbers of a seed in a table of 2**bits bits."""
    return [F.shiftrightunsigned(h, 64 - bits) for h in (seed, F.shiftleft(seed, 32), F.xxhash64(seed))]


def bit_table(seeds: DataFrame, bits: int) -> Column:
    """The table as a constant array of 64-bit words. The driver holds at most 2**TABLE_BITS[1] bits (2 MB) of it."""
    at = seeds.select("seed").distinct().select(F.explode(F.array(*slots(F.col("seed"), bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w"))
    full = [0] * max(1, 2**bits // 64)
    for r in words.collect():
        full[r.id] = r.w
    return F.split(F.lit(",".join(map(str, full))), ",").cast("array<bigint>")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, doc_at, item_at, agree): verified hits, ``agree`` is the most equal tokens in one
    window. Rows are told apart by id and a hash of their text."""
    items = items.where(F.col("text").isNotNull()).select("item_id", "text")
    seeds = benchmark_seeds(items)
    n_seeds = seeds.count()
    bits = min(max(TABLE_BITS[0], (32 * max(n_seeds, 1) - 1).bit_length()), TABLE_BITS[1])
    reach, masks = MIN_TOKENS, document_masks(items)

    def known(seed, table):
        hit = [F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in slots(seed, bits)]
        return hit[0] & hit[1] & hit[2]

    def candidates(table, words, hashes):
        def of(mask, k):
            # the first bit settles nearly all positions, so the seed is made once for them
            at = F.filter(positions(hashes, mask), lambda i: known(seed_at(hashes, i, mask, k), table))
            return F.transform(at, lambda i: F.struct(i.alias("at"), seed_at(hashes, i, mask, k).alias("seed")))

        found = F.flatten(F.array(*[of(m, k) for k, m in masks]))
        # the words around a hit go along, so that documents need not be joined again
        return F.transform(found, lambda p: F.struct(p["at"].alias("at"), p["seed"].alias("seed"), F.greatest(p["at"] - reach, F.lit(0)).alias("from"),
                                                     F.slice(words, F.greatest(p["at"] - reach, F.lit(0)) + 1, 2 * reach + 8).alias("near")))

    found = let(bit_table(seeds, bits), lambda table: let(tokens(F.col("text")), lambda words: let(word_hashes(words), lambda h: candidates(table, words, h))))
    cand = docs.select("doc_id", text_key(F.col("text")), F.explode(found).alias("c")).select("doc_id", "text_key", "c.at", "c.seed", "c.from", "c.near")
    joined = cand.join(F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds, "seed")
    # item word j stands at document word j + shift; both are compared where the item and the words around the hit meet
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(F.lit(0), F.col("from") - shift)
    last = F.least(F.size("item_words"), F.col("from") + F.size("near") - shift) - 1
    equal = F.transform(F.sequence(first, last), lambda j: F.when(F.get("item_words", j) == F.get("near", j + shift - F.col("from")), F.lit(1)).otherwise(F.lit(0)))
    width = F.least(F.lit(MIN_TOKENS), F.size("item_words"))
    windows = lambda e: F.when(F.size(e) >= F.col("_width"), F.array_max(F.transform(
        F.sequence(F.lit(1), F.size(e) - F.col("_width") + 1), lambda s: F.aggregate(F.slice(e, s, F.col("_width")), F.lit(0), lambda a, x: a + x))))
    joined = joined.withColumn("_width", width).withColumn("agree", let(equal, windows))
    enough = F.when(F.col("_width") < MIN_TOKENS, F.col("_width") - F.floor(F.col("_width") / 6)).otherwise(F.lit(MIN_TOKENS - MAX_DIFFERENT))
    return joined.where(F.col("agree") >= enough).select("doc_id", "text_key", "item_id", F.col("at").alias("doc_at"), "item_at", "agree")


def text_key(text: Column) -> Column:
    return F.xxhash64(text).alias("text_key")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_hits, item_ids) of the documents that overlap benchmark items, each once."""
    per_item = hits(docs, items).groupBy("doc_id", "text_key", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.groupBy("doc_id", "text_key").agg(F.sum("n").cast("long").alias("n_hits"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = written(contaminated(docs.select("doc_id", "text"), items), "contaminated")
    return F.broadcast(found) if found.count() <= BROADCAST_FOUND else found


def _same_row() -> Column:
    return F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("f.text_key"))


def mark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of ``docs`` without its text, plus contaminated, n_hits and item_ids."""
    keep = [c for c in docs.columns if c not in {"text", "n_hits", "item_ids", "contaminated"}]
    out = docs.alias("d").join(_found(docs, items).alias("f"), _same_row(), "left")
    return out.select(*[F.col(f"d.`{c}`") for c in keep], F.col("f.n_hits").isNotNull().alias("contaminated"), F.coalesce("f.n_hits", F.lit(0)).cast("long").alias("n_hits"),
                      F.coalesce("f.item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item."""
    return docs.alias("d").join(_found(docs, items).alias("f"), _same_row(), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
