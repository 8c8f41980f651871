"""MinHash near-dedup (8): bottom-k sketches, inverted lists, exact Jaccard.

1. One hash function gives each document its ``K`` smallest distinct shingle
   hashes.  Documents with the same set collapse to one class (smallest id).
2. Inverted lists hold the classes by retained value.  Two sets of Jaccard
   similarity 0.75 share half of their sketches but in about one case of 1e5,
   so it is enough to list a sketch under its rarest values (prefix filter);
   values that one class holds need no list.
3. Every member of a list is paired with the list's pivots (one per slot of the
   id's hash), union-sketch estimation drops pairs far below the threshold and
   the full sets decide.  So a group of n copies costs O(n) pairs.
4. Classes in lists that still hold more than one component are paired across
   components by an exact prefix filter on their full sets, first with a few
   near pivots, then with all that is left.  No link between
   components that share a list is lost, whatever the list's length, and texts
   that merely share a common passage make no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, apart, components, own, with_decision

K, SLOTS, NEAREST, PERCENT = 64, 6, 10, 75


def _sketch_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shingles.sketches(K), "doc_id bigint, n bigint, f1 bigint, f2 bigint, sketch array<bigint>")


def _lists(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, doc) for the rarest values of each sketch that another class also holds."""
    held = F.size("sketch")
    # a set of up to 3/4 of K shingles can only match sets that fit in a sketch whole
    need = F.when(F.col("n") <= K * 3 // 4, F.ceil(held * PERCENT / 100)).otherwise(F.ceil(held / 2))
    rows = classes.select(F.col("rep").alias("doc"), held.alias("m"), (held - need + 1).alias("prefix"), F.explode("sketch").alias("value"))
    shared = scratch.table(rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    mine = Window.partitionBy("doc")
    ranked = rows.join(shared, "value").select(
        "*", (F.col("m") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "value"))).alias("place"))
    return scratch.table(ranked.where(F.col("place") <= F.col("prefix")).select("value", "doc"))


def _pivot_pairs(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Each member with the smallest member of each slot that shares a list with it."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    firsts = lists.groupBy("value").agg(*[F.min(F.when(slot == i, F.col("doc"))).alias(f"p{i}") for i in range(SLOTS)])
    met = lists.join(apart(firsts), "value").groupBy("doc").agg(*[F.min(F.nullif(F.col(f"p{i}"), F.col("doc"))).alias(f"p{i}") for i in range(SLOTS)])
    pairs = met.select("doc", F.explode(F.array_distinct(F.array_compact(F.array(*[f"p{i}" for i in range(SLOTS)])))).alias("other"))
    return pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def _rest_pairs(lists: DataFrame, comps: DataFrame, full: DataFrame, scratch: Scratch, pivots: bool) -> DataFrame:
    """Pairs across components for the classes of lists that hold more than one.

    Sketches tell 1/2 from 3/4 but coarsely, so these classes are paired by their
    full sets: a link needs 3/4 of the larger set and 6/7 of the smaller, so it
    shows among the rarest 1/4 of the one and 1/7 of the other.  With ``pivots``
    a class meets only the smallest set of its rarest lists, NEAREST of them, to
    merge large groups before all pairs are made.
    """
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = scratch.table(comps.join(apart(sizes), "component").select(F.col("node").alias("doc"), "component", "size"))
    rows = scratch.table(lists.join(named, "doc", "left").select("value", "doc", F.coalesce("component", "doc").alias("component")))
    mixed = rows.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    docs = scratch.table(rows.join(apart(mixed), "value").select("doc", "component").distinct())
    sets = full.join(docs, F.col("doc_id") == F.col("doc")).select("doc", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    sets = scratch.table(sets)
    # what one component holds alone is no way to another; it comes first in the order
    held = sets.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value", "df")
    mine = Window.partitionBy("doc")
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "value"))
    ranked = sets.join(apart(held), "value").select("value", "doc", "component", "n", place.alias("place"))
    probe = scratch.table(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1))
    least = F.ceil(F.col("n") * 2 * PERCENT / (100 + PERCENT))
    index = probe.where(F.col("place") <= F.col("n") - least + 1).select("value", F.col("doc").alias("x"), F.col("component").alias("xc"), F.col("n").alias("xn"), F.col("place").alias("xp"))
    if pivots:
        firsts = index.groupBy("value").agg(F.min(F.struct("xn", "x", "xc")).alias("p"))
        met = probe.join(apart(firsts), "value").where((F.col("p.xc") != F.col("component")) & (F.col("p.xn") * 100 >= F.col("n") * PERCENT) & (F.col("n") * 100 >= F.col("p.xn") * PERCENT))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("p.x").alias("x")))), lambda r: r["x"])
        few = met.groupBy("doc").agg(F.slice(F.array_distinct(ordered), 1, NEAREST).alias("xs")).select("doc", F.explode("xs").alias("x"))
        return few.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct()
    smaller = (F.col("xn") < F.col("n")) | ((F.col("xn") == F.col("n")) & (F.col("x") < F.col("doc")))
    # from the first shared value on, no more can be shared than either set has left
    most = 1 + F.least(F.col("xn") - F.col("xp"), F.col("n") - F.col("place"))
    both = index.join(probe, "value").where((F.col("xc") != F.col("component")) & smaller & (F.col("xn") * 100 >= F.col("n") * PERCENT)
                                            & (most * (100 + PERCENT) >= (F.col("xn") + F.col("n")) * PERCENT))
    return both.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct()


def _links(pairs: DataFrame, classes: DataFrame, full: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets reach the threshold; the sketches of the union drop most others."""
    def side(x: str) -> DataFrame:
        return classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    near = scratch.table(near.where(met * 2 >= F.size(union)).select("a", "b", "na", "nb"))
    sets_a = full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    sets_b = full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    both = near.join(sets_a, "a").join(sets_b, "b").select("a", "b", "na", "nb", common.alias("both"))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * PERCENT).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Needs ``doc_id`` and ``text``; other columns are ignored.  Null and empty
    texts have no shingles and link with nothing.  A null doc_id links with
    nothing, its ``component_id`` is null and it is kept.  Rows with the same
    doc_id count as one document with the shingles of either.  Equal texts are
    one class.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.table(_sketch_rows(docs))
    real = rows.where("n > 0 and doc_id is not null")
    same = ["f1", "f2", "n"]
    classes = scratch.table(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    lists = _lists(classes, scratch)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = lists.select(F.col("doc").alias("doc_id")).distinct()
    full = scratch.table(texts.join(listed, "doc_id", "left_semi").mapInArrow(shingles.sets, "doc_id bigint, shingles array<bigint>"))
    comps = components(_links(scratch.table(_pivot_pairs(lists, scratch)), classes, full, scratch), scratch)
    for pivots in (True, False):
        seen = Observation()
        rest = scratch.table(_rest_pairs(lists, comps, full, scratch, pivots), seen)
        if seen.get["n"]:
            again = _links(rest, classes, full, scratch)
            comps = components(again.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    placed = rows.select("doc_id", *same).join(named, same, "left")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document is kept: the smallest doc_id of each group, all columns as they are.

    Rows with a null doc_id and texts without words stay; of equal texts with different ids one stays; rows
    that share an id stay or go together.  An empty table gives an empty table.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_llm_key")).distinct()
    return with_decision(docs, apart(gone), "left_anti").select(*own(docs))
