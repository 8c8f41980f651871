"""Benchmark decontamination (4, native): SimHash over item-sized windows.

1. A window that resembles an item shares word shingles with it, so positions of
   shingles that the benchmark holds are found first; the others only count as
   differing.  Each shared shingle fixes a window: where the item would begin, of
   the item's length.  A window must share 3/4 of its own shingles with the
   benchmark, else no item can match it.
2. A window's fingerprint is the SimHash of its shingles that the benchmark
   holds; an item's that of all its shingles, both by multiplicity.
3. Fingerprints have four blocks of 16 bits.  Within ``RADIUS`` = 15 bits, some
   block differs in 3 bits at most, so the items' blocks with up to 3 bits flipped
   find every item within the radius.
4. The weighted (multiset) Jaccard similarity of the whole windows decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, own, with_decision, words

WIDTH, PERCENT, RADIUS, BLOCKS, BITS = 5, 75, 15, 4, 16
#: Shingles of a benchmark up to which they are sent to every task (16 bytes each).
BROADCAST = 1_000_000
_STEP = 256


def shingle_hashes(w: Column) -> Column:
    """Hashes of each five consecutive words; of all words if there are fewer; none without words."""
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)])))


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    """(keep.., n, p, h): a row for each shingle, n the number of words."""
    # a generator keeps the words as a column; else they would be split anew for each shingle
    w = df.select(*keep, F.explode(F.array(words(F.col("text")))).alias("w"))
    h = w.select(*keep, F.size("w").alias("n"), shingle_hashes(F.col("w")).alias("hs"))
    return h.select(*keep, "n", F.posexplode("hs").alias("p", "h"))


def _fingerprints(rows: DataFrame, *by: str) -> DataFrame:
    """SimHash of the hashes ``h`` of each group, and their number; counters of 16 bits, four to a sum."""
    lanes = 0x0001000100010001
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), *[
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(lanes))).alias(f"c{i}") for i in range(BITS)])
    bits = [F.when(F.shiftrightunsigned(f"c{i}", BITS * b).bitwiseAND(F.lit(0xFFFF)) * 2 > F.col("m"), F.lit(1 << i)).otherwise(F.lit(0))
            for b in range(BLOCKS) for i in range(BITS)]
    blocks = [sum(bits[b * BITS + 1:(b + 1) * BITS], bits[b * BITS]).cast("int").alias(f"b{b}") for b in range(BLOCKS)]
    return sums.select(*by, "m", *blocks)


def _probes() -> list[int]:
    """Masks of at most RADIUS // BLOCKS bits of a block."""
    return [sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), r)]


def _near(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(b0.., item_id) for fingerprints within the radius of an item's."""
    names = [f"b{b}" for b in range(BLOCKS)]
    masks = prints.sparkSession.createDataFrame([(m,) for m in _probes()], "mask int")
    blocks = items.select("item_id", *[F.col(c).alias("i" + c) for c in names], F.posexplode(F.array(*names)).alias("b", "v"))
    keys = blocks.join(F.broadcast(masks)).select("item_id", *["i" + c for c in names], "b", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))
    mine = prints.select(*names, F.posexplode(F.array(*names)).alias("b", "v"))
    apart_bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("i" + c))) for c in names[1:]), F.bit_count(F.col("b0").bitwiseXOR(F.col("ib0"))))
    return mine.join(keys, ["b", "v"]).where(apart_bits <= RADIUS).select(*names, "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each document for each item it leaks.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored.  ``start`` counts words from 0 and is negative if the text begins
    amid the item; ties go to the earliest window.  Texts and items of fewer than
    five words are one shingle, so such an item matches only a text of the same
    words.  Null and empty texts or items match nothing.  A null doc_id is
    reported as null.  Repeated rows give one result; rows that share a doc_id
    but not the text are judged apart and the best is given.  Items that are
    alike are all reported.  Empty tables: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    item_rows = scratch.table(_positions(benchmark.select("item_id", "text"), "item_id").distinct())
    known = scratch.table(item_rows.select("h").distinct())
    few = known.count() <= BROADCAST
    rows = _positions(docs.select(F.col("doc_id").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("k")), "k", "doc_id")
    hits = scratch.table(rows.join(F.broadcast(known) if few else known, "h"))
    # windows: an item's length, laid where a shared shingle puts the item's begin
    lengths = item_rows.select("h", F.col("p").alias("q"), F.col("n").alias("len")).distinct()
    spans = hits.join(apart(lengths), "h").select("k", "doc_id", "n", (F.col("p") - F.col("q")).alias("s"), "len").distinct().select(
        "*", F.greatest("s", F.lit(0)).alias("lo"), F.greatest(F.least(F.col("s") + F.col("len"), F.col("n")) - WIDTH, F.lit(0)).alias("hi"))
    spans = spans.where("hi >= lo").select("k", "doc_id", "s", "len", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / _STEP), F.floor(F.col("hi") / _STEP))).alias("step"))
    inside = spans.join(apart(hits.select("k", "p", "h", F.floor(F.col("p") / _STEP).alias("step"))), ["k", "step"]).where("p between lo and hi")
    window = ["k", "doc_id", "s", "len"]
    inside = scratch.table(inside.select(*window, (F.col("hi") - F.col("lo") + 1).alias("size"), "p", "h").distinct())
    prints = scratch.table(_fingerprints(inside, *window, "size").where(F.col("m") * 100 >= F.col("size") * PERCENT))
    items = scratch.table(_fingerprints(item_rows, "item_id").withColumnRenamed("m", "item_size"))
    names = [f"b{b}" for b in range(BLOCKS)]
    near = scratch.table(_near(prints.select(*names).distinct(), items).join(items.select("item_id", "item_size"), "item_id"))
    pairs = prints.join(apart(near), names).where(F.least("size", "item_size") * 100 >= F.greatest("size", "item_size") * PERCENT)
    pairs = scratch.table(pairs.select(*window, "size", "item_id", "item_size"))
    mine = inside.groupBy(*window, "h").agg(F.count(F.lit(1)).alias("c"))
    theirs = item_rows.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("ic"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in window]
    met = pairs.alias("p").join(apart(mine).alias("m"), same).select("p.*", "m.h", "m.c")
    met = met.join(apart(theirs), ["item_id", "h"]).groupBy(*window, "size", "item_id", "item_size").agg(F.sum(F.least("c", "ic")).alias("both"))
    union = F.col("size") + F.col("item_size") - F.col("both")
    found = met.where(F.col("both") * 100 >= union * PERCENT).select("doc_id", "item_id", "s", "len", (F.col("both") / union).alias("sim"))
    best = F.max_by(F.struct("s", "len", "sim"), F.struct("sim", -F.col("s"), -F.col("len"))).alias("w")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("w.s").alias("start"), F.col("w.len").alias("n_words"), F.col("w.sim").alias("similarity"))


def decontam_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that leak no item, all columns as they are.

    Texts that are null or without words leak nothing and stay, as do rows with a null doc_id that leak none; rows that
    share an id go together.  Without documents or items nothing goes.
    """
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("_llm_key")).distinct()
    return with_decision(docs, apart(gone), "left_anti").select(*own(docs))
