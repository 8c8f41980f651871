"""Mixing sources to target weights (2): temperature, bisection, block permutations.

Token shares p are raised to an exponent a in [0, 1] and normalised.  a = 1 keeps
the shares, a = 0 levels them.  The exponent is bisected, by aggregates over the
table of sources, to the largest that reaches the target entropy; if a source
would then be repeated more often than the limit, it is raised until none is.
The budgets are met by passes over each source in permuted order: documents are
dealt to blocks by a hash, blocks are ordered by a hash of the pass, documents in
a block likewise.  Whole passes need no order; in the last, partial one, running
token totals over groups of blocks, blocks and documents find where it ends, so
no task sees all of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, apart, own

BLOCK, GROUP = 256, 512
ENTROPY, REPEATS, SEED = 0.97, 2.0, 17


def _tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("bigint")


def _state(sources: DataFrame, a: list[float], budget: int | None, total: int) -> list[tuple[float, float]]:
    """For each exponent: entropy as a share of the greatest, and the passes over the source repeated most: with
    ``budget`` tokens, else if the one repeated least is passed once."""
    live = sources.where("tokens > 0")
    cols = [F.count(F.lit(1)).alias("n")]
    for i, x in enumerate(a):
        p = F.pow("share", F.lit(x))
        cols += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log("share")).alias(f"l{i}"),
                 F.max(p / F.col("share")).alias(f"m{i}"), F.min(p / F.col("share")).alias(f"s{i}")]
    r = live.agg(*cols).first()
    if not r["n"]:
        return [(1.0, 1.0)] * len(a)
    top = math.log(r["n"]) or 1.0
    passes = [r[f"m{i}"] / r[f"s{i}"] if budget is None else budget / max(total, 1) * r[f"m{i}"] / r[f"z{i}"] for i in range(len(a))]
    return [((math.log(r[f"z{i}"]) - x * r[f"l{i}"] / r[f"z{i}"]) / top if r["n"] > 1 else 1.0, passes[i]) for i, x in enumerate(a)]


def find_exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, tolerance: float = 1e-4) -> float:
    """The exponent, by bisection to ``tolerance``.  ``sources`` has tokens and share.

    Entropy falls and so do repeats as the exponent grows, so both conditions
    split [0, 1] in two.  If both can't hold, the limit on repeats wins.  Each
    four halvings are told by one aggregate over the sources.
    """
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def bisect(lo: float, hi: float, holds) -> tuple[float, float]:
        """The last two places between which ``holds`` turns true."""
        while hi - lo > tolerance:
            a = [lo + (hi - lo) * i / 16 for i in range(17)]  # four halvings at once
            state = _state(sources, a, budget, total)
            left, right = 0, 16
            while right - left > 1:
                middle = (left + right) // 2
                left, right = (left, middle) if holds(state[middle]) else (middle, right)
            lo, hi = a[left], a[right]
        return lo, hi

    first, last = _state(sources, [0.0, 1.0], budget, total)
    within = (lambda s: s[1] <= repeats * (1 + 1e-9))
    least = 0.0 if within(first) else bisect(0.0, 1.0, within)[1]
    if last[0] >= entropy - 1e-9:
        return 1.0
    if _state(sources, [least], budget, total)[0][0] < entropy - 1e-9:
        return least
    return bisect(least, 1.0, lambda s: s[0] < entropy - 1e-9)[0]


def _key(level: str) -> Column:
    """Place of a block or document in the permutation of the last pass."""
    return F.xxhash64(F.col(level), F.col("passes"), F.lit(SEED + 1))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """One row per row of ``docs``: row columns doc_id, source, and n_tokens, weight, budget, copies, block.

    ``budget`` is the number of tokens to draw; by default the least that passes
    every source once, so that every document stays and small sources repeat.
    A document is taken ``copies`` times: once for each whole pass, and once
    more if the partial pass comes to it before the source's budget is used up
    (the document that crosses it is left out).  A null source is a source of its
    own; a null or empty text has no tokens and goes with the whole passes, once
    at least.  Repeated rows count each and are treated alike.  Empty table:
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), _tokens(F.col("text")).alias("n_tokens")))
    sums = scratch.table(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = sums.select("*", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("share"))
    a = find_exponent(sources, entropy, repeats, budget)
    live = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    norm = sources.agg(F.sum(live).alias("z"), F.max(F.col("share") / F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)))).alias("b")).first()
    draw = float(budget) if budget is not None else total * (norm["b"] or 0.0) * (norm["z"] or 0.0)
    plan = sources.select("source", "tokens", "docs", (live / F.lit(norm["z"] or 1.0)).alias("weight")).select(
        "*", F.floor(F.col("weight") * F.lit(draw) + F.lit(1e-6)).cast("bigint").alias("budget"))
    plan = plan.select("*", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("bigint").alias("passes"))
    plan = plan.select("*", (F.col("budget") - F.col("passes") * F.col("tokens")).alias("left"),
                       F.ceil(F.col("docs") / BLOCK).cast("bigint").alias("blocks"))
    joined = rows.join(apart(plan), rows["source"].eqNullSafe(plan["source"]), "left").drop(plan["source"])
    dealt = scratch.table(joined.select("*", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("blocks")).alias("block")).select(
        "*", F.pmod(F.xxhash64("block", F.lit(SEED + 2)), F.ceil(F.col("blocks") / GROUP)).alias("grp")))
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("src")
    blocks = dealt.groupBy(src, "grp", "block", "passes", "left").agg(F.sum("n_tokens").alias("t"))
    groups = blocks.groupBy("src", "grp", "passes").agg(F.sum("t").alias("t"))
    def start(*by: str, level: str) -> Column:
        w = Window.partitionBy(*by).orderBy(_key(level), level).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("t").over(w), F.lit(0))
    groups = groups.select("src", "grp", start("src", level="grp").alias("g0"))
    blocks = blocks.join(groups, ["src", "grp"]).select("src", "block", "left", "t", (F.col("g0") + start("src", "grp", level="block")).alias("b0"))
    edge = scratch.table(blocks.where("left > 0").select("src", "block", "b0", (F.col("b0") + F.col("t")).alias("b1"), "left")
                         .select("src", "block", "b0", (F.col("b1") <= F.col("left")).alias("whole"), (F.col("b0") >= F.col("left")).alias("none")))
    placed = dealt.select("*", src).join(apart(edge), ["src", "block"], "left")
    cut = placed.where("not whole and not none").select("src", "block", "b0", "left", "passes", "doc_id", "n_tokens")
    by = Window.partitionBy("src", "block").orderBy(_key("doc_id"), "doc_id").rangeBetween(Window.unboundedPreceding, 0)
    ends = cut.select("src", "block", "doc_id", "left", (F.col("b0") + F.sum("n_tokens").over(by)).alias("at"))
    inside = (ends.where("at <= left").select("src", "block", F.col("doc_id").alias("d"), F.lit(True).alias("inside")).distinct())
    full = placed.join(apart(inside), (placed["src"] == inside["src"]) & (placed["block"] == inside["block"]) & placed["doc_id"].eqNullSafe(inside["d"]), "left").select(
        placed["*"], inside["inside"])
    extra = F.when(F.col("n_tokens") == 0, 0).when(F.coalesce("whole", F.lit(False)) | F.coalesce("inside", F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col("n_tokens") == 0, F.greatest("passes", F.lit(1))).otherwise(F.col("passes") + extra)
    return full.select("doc_id", "source", "n_tokens", "weight", "budget", copies.cast("bigint").alias("copies"), "block")


def mix_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as its copies, and mix_pass, mix_block, mix_order.

    Reading by (mix_pass, mix_block, mix_order) gives the block permutation of each
    source.  Other columns pass through whatever their names, but that those with a
    name of the three new ones are left out.
    """
    src = (lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n")))
    plan = mix(docs).select(F.col("doc_id").alias("key"), src(F.col("source")).alias("key_src"), "copies", "block", F.col("n_tokens").alias("key_tokens")).distinct()
    packed = docs.select(F.struct(*own(docs)).alias("row"), "doc_id", src(F.col("source").cast("string")).alias("src"), _tokens(F.col("text")).alias("tokens"))
    out = packed.join(plan, packed["doc_id"].eqNullSafe(plan["key"]) & (F.col("src") == F.col("key_src")) & (F.col("tokens") == F.col("key_tokens")))
    out = out.where("copies > 0").select("row", "doc_id", "block", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("turn"))
    added = {"mix_pass": F.col("turn"), "mix_block": F.col("block"), "mix_order": F.xxhash64("doc_id", "turn", F.lit(SEED + 1))}
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
