"""N-gram Jaccard join (13): PartEnum signatures of shingle sets, verified on the full sets.

1. Documents with the same set are one class (the smallest id).  A class of whose 64
   smallest hashes fewer than a third lie among another's has no partner: two sets at
   0.8 share so few in less than one case of 1e13.
2. Sizes fall into bands.  Sets whose larger one lies in a band of sizes up to R differ
   in at most k = 2R(1 - t)/(1 + t) elements at similarity t; a set is signed for its own
   band, and for the next if partners can lie there.
3. PartEnum for k: the domain is split into n1 parts, so one of them holds at most k2
   of the differences; that part is split into n2 smaller ones, and each choice of n2 - k2
   of them is a signature.  Up to three differences have one part and all choices; from four on
   there are n1 = k + m parts with one signature each, of which m at least agree.  No link is lost.
4. Classes that share a signature meet the list's pivots (the smallest id of each slot),
   so a group of n copies costs O(n) pairs; full sets decide, links make components.
5. Sets of which m signatures or more are still shared with other components are signed anew by more and smaller
   parts, of which the most frequent may go as long as one that partners share is left; and with
   them go empty parts and common passages.  Sets meet a few pivots by what is left, those that
   share most with others, then all of other components whose bitmaps don't differ in too much.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, apart, components

PERCENT, SKETCH, SLOTS, NEAREST = 80, 64, 4, 10
#: Ids of texts up to which they are sent to every task (8 bytes each).
BROADCAST = 1_000_000
#: Differences up to which subsets of one part's smaller parts are enumerated.
ENUMERATED = 3
#: Length of the bitmaps that tell from below how far two sets differ.
BITS = 2048
_CHUNK = 400_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def bands(percent: int) -> np.ndarray:
    """The greatest size of each band; a partner of a set lies in its band, the one before or the next."""
    tops = [max(1, (100 + percent) // (2 * (100 - percent)))]  # up to here no two different sets reach the threshold
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] * 3 // 2, tops[-1] * 100 // percent, tops[-1] + 1))
    return np.array(tops, np.int64)


def differences(top: np.ndarray, percent: int) -> np.ndarray:
    """How many elements two sets of at most ``top`` can differ in."""
    return 2 * top * (100 - percent) // (100 + percent)


def plan(k: int, fine: bool) -> tuple[int, int, int]:
    """(n1, n2, k2): parts, smaller parts of each, and how many of these a signature leaves out.

    Few differences: one part, of whose k + 3 smaller ones all but k are chosen in each way.
    More: parts that are signed whole, half as many again as there can be differences.
    """
    if fine:
        return max(2 * k, 16), 1, 0
    return (1, k + 3, k) if k <= ENUMERATED else (k + k // 2 + 1, 1, 0)


def agreeing(k: int, fine: bool) -> int:
    """How many signatures of a band two sets with at most k differences share at least."""
    n1, _, k2 = plan(k, fine)
    return 1 if k2 else n1 - k


def sign(flat: np.ndarray, sizes: np.ndarray, percent: int, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, band, signature) of sets that lie end to end in ``flat``."""
    tops = bands(percent)
    ks = differences(tops, percent)
    own = np.searchsorted(tops, sizes)
    follows = sizes * 100 // percent > tops[own]
    of = np.concatenate([np.arange(len(sizes)), np.flatnonzero(follows)])
    band = np.concatenate([own, own[follows] + 1])
    starts = np.cumsum(sizes) - sizes
    plans = {int(b): plan(int(ks[b]), fine) for b in np.unique(band) if ks[b] > 0}
    found = []
    for n2, k2 in sorted({p[1:] for p in plans.values()}):
        pick = np.flatnonzero([b in plans and plans[b][1:] == (n2, k2) for b in band.tolist()])
        sets, bs = of[pick], band[pick].astype(np.uint64)
        n, n1 = sizes[sets], np.array([plans[b][0] for b in band[pick].tolist()], np.uint64)
        at = np.repeat(starts[sets] - np.cumsum(n) + n, n) + np.arange(n.sum())
        element = flat[at].view(np.uint64)
        h = shingles.mix(shingles.mix(element + np.repeat((bs + np.uint64(1)) * _SALT, n)))
        cells = np.cumsum(n1) - n1
        part = (h >> np.uint64(33)) % np.repeat(n1, n)
        small = (h & np.uint64(0x1FFFFFFF)) % np.uint64(n2)
        sums = np.zeros(int(n1.sum()) * n2, np.uint64)
        np.add.at(sums, (np.repeat(cells, n) + part).astype(np.int64) * n2 + small.astype(np.int64), shingles.mix(element * _SALT))
        sums = shingles.mix((sums.reshape(-1, n2) + np.arange(1, n2 + 1, dtype=np.uint64)) * _SALT)
        which = np.arange(len(sums), dtype=np.uint64) - np.repeat(cells, n1.astype(np.int64))
        name = shingles.mix((which + np.uint64(1)) * _SALT ^ np.repeat(bs << np.uint64(48), n1.astype(np.int64)))
        for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
            key = shingles.mix(shingles.mix(sums[:, list(chosen)].sum(1, dtype=np.uint64) + name) + np.uint64(i))
            found.append((np.repeat(sets, n1.astype(np.int64)), np.repeat(bs.astype(np.int32), n1.astype(np.int64)), key.view(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _signatures(percent: int, fine: bool):
    """mapInArrow function: (doc, component, n, shingles) to (doc, component, n, band, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64)
            flat = batch.column(3).flatten().to_numpy()
            ends = np.cumsum(sizes)
            start = 0
            while start < len(batch):
                low = ends[start] - sizes[start]
                stop = max(start + 1, int(np.searchsorted(ends, low + _CHUNK, "right")))
                of, band, sig = sign(flat[low:ends[stop - 1]], sizes[start:stop], percent, fine)
                at = pa.array(of + start)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(band), pa.array(sig)], ["doc", "component", "n", "band", "sig"])
                start = stop

    return run


def bitmaps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of BITS bits for each set, each the parity of the elements that fall on it: sets that differ
    in h elements differ in at most h bits."""
    h = shingles.mix((flat.view(np.uint64) ^ _SALT) * _SALT) % np.uint64(BITS)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * BITS + h.astype(np.int64), minlength=len(sizes) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), BITS // 64)


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc, shingles) to (doc, bits)."""
    for batch in batches:
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            ends = part.column(1).offsets.to_numpy().astype(np.int64)
            words = bitmaps(part.column(1).flatten().to_numpy(), np.diff(ends))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc", "bits"])


def _signed(sets: DataFrame, percent: int, fine: bool) -> DataFrame:
    return sets.select("doc", "component", "n", "shingles").mapInArrow(_signatures(percent, fine), "doc bigint, component bigint, n bigint, band int, sig bigint")


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Classes (doc) of whose smallest hashes a third or more lie among another's."""
    rows = classes.select(F.col("rep").alias("doc"), F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = scratch.table(rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("value"))
    met = rows.join(apart(shared), "value").groupBy("doc").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"))
    return met.where("3 * c >= m").select("doc")


def _pivot_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Each set with the smallest of each slot that shares a signature with it."""
    signed = _signed(sets.withColumn("component", F.col("doc")), percent, False).select("sig", "doc")
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    firsts = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), *[F.min(F.when(slot == i, F.col("doc"))).alias(f"p{i}") for i in range(SLOTS)]).where("c > 1").drop("c")
    met = signed.join(apart(firsts), "sig").groupBy("doc").agg(*[F.min(F.nullif(F.col(f"p{i}"), F.col("doc"))).alias(f"p{i}") for i in range(SLOTS)])
    return _ordered(met.select("doc", F.explode(F.array_compact(F.array(*[f"p{i}" for i in range(SLOTS)]))).alias("other")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def _links(pairs: DataFrame, classes: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets reach the threshold; sketches of the union drop most of those far below."""
    def side(x: str) -> DataFrame:
        return classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    near = scratch.table(near.where(met * 2 >= F.size(union)).select("a", "b", "na", "nb"))
    both = near.join(full.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    both = both.select("a", "b", "na", "nb", common.alias("both"))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _placed(full: DataFrame, comps: DataFrame) -> DataFrame:
    """Sets with their component."""
    return full.join(apart(comps), F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("component"), "n", "shingles")


def _most(n, m, percent: int):
    """How many elements sets of these sizes can differ in."""
    return F.floor((n + m) * (100 - percent) / (100 + percent))


def _of_band(values: list[int]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("band") + 1)


def _crowded(placed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Sets of which as many signatures as partners must share lie in lists that hold more than one component."""
    ks = [int(k) for k in differences(bands(percent), percent)]
    signed = _signed(placed, percent, False)
    mixed = signed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    met = signed.join(apart(mixed), "sig").groupBy("doc", "n", "band").agg(F.count(F.lit(1)).alias("c"))
    # a set of this size can't differ in as many elements as the largest of its band
    spared = F.greatest(_of_band(ks) - _most(F.col("n"), F.floor(F.col("n") * 100 / percent), percent), F.lit(0))
    need = _of_band([agreeing(k, False) for k in ks]) + F.when(_of_band(ks) > ENUMERATED, spared).otherwise(0)
    docs = scratch.table(met.where(F.col("c") >= need).select("doc").distinct())
    return scratch.table(placed.join(apart(docs), "doc", "left_semi"))


def _rest_pairs(crowded: DataFrame, comps: DataFrame, percent: int, pivots: bool, scratch: Scratch) -> DataFrame:
    """Pairs of different components by fine signatures without each set's most frequent ones.

    Sets of sizes n and m differ in at most h = (n + m)(1 - t)/(1 + t) elements, and so in as
    many parts; the rarest one they share is then among the h + 1 rarest of either.
    """
    ks = [int(k) for k in differences(bands(percent), percent)]
    rows = scratch.table(_signed(_placed(crowded.drop("component"), comps), percent, True))
    # what one component holds alone is no way to another; it comes first in the order
    held = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig", "df")
    mine = Window.partitionBy("doc", "band")
    place = _of_band([plan(k, True)[0] for k in ks]) - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "sig"))

    kept = _most(F.col("n"), F.floor(F.col("n") * 100 / percent), percent) + 1
    index = rows.join(apart(held), "sig").select("*", place.alias("place"), F.sum("df").over(mine).alias("central"))
    index = scratch.table(index.where(F.col("place") <= kept).select("sig", "doc", "component", "n", "place", "central"))
    fits = ((F.col("n") * 100 >= F.col("on") * percent) & (F.col("on") * 100 >= F.col("n") * percent) & (F.col("component") != F.col("oc"))
            & (F.greatest("place", "op") <= _most(F.col("n"), F.col("on"), percent) + 1))
    if pivots:
        # the set that shares most with others is the likeliest partner of each
        firsts = index.groupBy("sig").agg(F.max_by(F.struct("n", "doc", "component", "place"), F.struct("central", F.xxhash64("doc"))).alias("p")).select(
            "sig", F.col("p.n").alias("on"), F.col("p.doc").alias("other"), F.col("p.component").alias("oc"), F.col("p.place").alias("op"))
        met = index.join(apart(firsts), "sig").where(fits)
        ordered = F.transform(F.array_sort(F.collect_set(F.struct("place", "other"))), lambda r: r["other"])  # as many as the set has parts at most
        few = met.groupBy("doc").agg(F.slice(F.array_distinct(ordered), 1, NEAREST).alias("others"))
        return _ordered(few.select("doc", F.explode("others").alias("other")))
    bits = crowded.select("doc", "shingles").mapInArrow(_mapped, "doc bigint, bits array<bigint>")
    index = scratch.table(index.drop("central").join(apart(bits), "doc"))
    other = index.select("sig", F.col("doc").alias("other"), F.col("n").alias("on"), F.col("component").alias("oc"), F.col("place").alias("op"), F.col("bits").alias("ob"))
    apart_by = F.aggregate(F.zip_with("bits", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = fits & (F.col("doc") < F.col("other")) & (apart_by <= _most(F.col("n"), F.col("on"), percent))
    return _ordered(index.join(other, "sig").where(near).select("doc", "other"))


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of
    five-word shingles; ``component_id`` is the smallest doc_id reachable.  Needs ``doc_id`` and
    ``text``; other columns are ignored.  Texts without words (null and empty ones) have
    no shingles and link with nothing.  A null doc_id links with nothing and its
    ``component_id`` is null.  Rows with the same doc_id count as one document with the shingles of either.
    Equal texts are one class.  An empty table gives an empty table.  ``percent`` lies between 60 and 99.
    """
    if not 60 <= percent <= 99:
        raise ValueError("percent must lie between 60 and 99")
    scratch = Scratch(docs.sparkSession, "partenum")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.table(texts.mapInArrow(shingles.sketches(SKETCH), "doc_id bigint, n bigint, f1 bigint, f2 bigint, sketch array<bigint>"))
    same = ["f1", "f2", "n"]
    classes = scratch.table(rows.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    some = scratch.table(_candidates(classes, scratch).select(F.col("doc").alias("doc_id")))
    few = F.broadcast(some) if some.count() <= BROADCAST else apart(some)
    full = scratch.table(texts.join(few, "doc_id", "left_semi").mapInArrow(shingles.sets, "doc_id bigint, shingles array<bigint>")
                         .select(F.col("doc_id").alias("doc"), F.size("shingles").cast("bigint").alias("n"), "shingles"))
    pairs = scratch.table(_pivot_pairs(full, percent))
    comps = components(_links(pairs, classes, full, percent, scratch), scratch)
    crowded = _crowded(_placed(full, comps), percent, scratch)
    for pivots in (True, False):
        if not pivots:
            crowded = _crowded(_placed(crowded.drop("component"), comps), percent, scratch)
        seen = Observation()
        rest = scratch.table(_rest_pairs(crowded, comps, percent, pivots, scratch), seen)
        if seen.get["n"]:
            again = _links(rest, classes, full, percent, scratch)
            comps = components(again.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    placed = rows.select("doc_id", *same).join(named, same, "left")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
