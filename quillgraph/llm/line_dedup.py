"""Line dedup (5, native): levelled sorted runs of line hashes.

A store of line keys grows batch by batch.  A batch's keys are aggregated, then
merge-anti-joined with the runs that the store has: keys that no run holds make
a new run of level 0, the others go to a table of repeats.  So each key lies in
exactly one run.  ``fanout`` runs of a level are compacted to one of the next
level.  All steps are joins and aggregates on the 128-bit line hash; a hot line
is reduced to one row per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, apart, ascii_lower, own, with_decision

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
KEY = ["h1", "h2"]
_RUN = "h1 bigint, h2 bigint, n bigint, last bigint"


def line_key(line: Column) -> Column:
    """A line stripped of blanks at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    """128 bits of a key; two xxhash64 with different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(5)).alias("h2"))


class LineRuns:
    """The levelled store.  ``levels[i]`` lists the paths of the runs of level i."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = FANOUT):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*paths)

    def runs(self) -> DataFrame:
        """All runs; no key occurs twice."""
        return self._read([p for level in self.levels for p in level])

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in ``batch`` (h1, h2, doc_id; once per document and key).

        Returns the keys new to the store, to be read before the next batch.
        """
        self._compact()
        mine = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        fresh = mine
        if any(self.levels):
            mine = self.scratch.table(mine)
            known = self.runs().select(*KEY)
            fresh = mine.join(known, KEY, "left_anti")
            self.repeats.append(self.scratch.path(mine.join(known, KEY, "left_semi")))
        path = self.scratch.path(fresh.sortWithinPartitions(*KEY))
        self.levels[0].append(path)
        return self._read([path])

    def _compact(self) -> None:
        """Merge ``fanout`` runs of a level to one of the next, as often as there are so many."""
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._read(level).repartition(*KEY).sortWithinPartitions(*KEY)
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self.scratch.path(merged))
                for path in level:
                    self.scratch.drop(path)
                self.levels[i] = []

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys (h1, h2, last) that at least ``min_docs`` documents hold, and the largest doc_id."""
        again = self._read(self.repeats)
        firsts = self.runs()
        firsts = firsts.where(F.col("n") >= min_docs).unionByName(
            firsts.where(F.col("n") < min_docs).join(again.select(*KEY).distinct(), KEY, "left_semi"))
        total = firsts.unionByName(again).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return total.where(F.col("n") >= min_docs).select(*KEY, "last")


def _decided(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """row (all columns of ``docs``), text, lines, kept (both arrays)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    packed = docs.select(F.struct(*own(docs)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = packed.select("doc_id", F.array_distinct(F.transform(
        F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars), key_hash)).alias("keys"))
    rows = scratch.table(keyed.select("doc_id", F.explode("keys").alias("k")).select(
        "k.h1", "k.h2", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(batches)).cast("int").alias("batch")))
    runs = LineRuns(spark, scratch)
    for b in range(batches):
        runs.add(rows.where(F.col("batch") == b).select(*KEY, "doc_id"))
    hot = scratch.table(runs.frequent(min_docs))
    gone = (rows.select(*KEY, "doc_id").join(hot, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
            .groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("_llm_gone"))
            .withColumnRenamed("doc_id", "_llm_key"))
    out = with_decision(packed, apart(gone))
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("_llm_gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(
        (F.length(line_key(x)) >= min_chars) & F.array_contains(F.col("_llm_gone"), key_hash(line_key(x))))))
    return out.select("row", "text", lines.alias("lines"), kept.alias("kept"))


_ADDED = ("_llm_text", "_llm_lines", "_llm_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Drop lines whose key many documents hold, except in the largest doc_id.

    Returns the columns of ``docs`` with the new text in ``_llm_text`` and
    ``_llm_lines`` / ``_llm_dropped`` (before dropping, dropped).  Every row
    counts as one document, also if rows repeat.  Null and empty texts are one
    empty line, which is never dropped.  A null doc_id is smaller than any other;
    a key held by null ids only stays.  A line that stands several times in the
    document that keeps it stays as often.  Extra columns pass through whatever
    their names, but that those with a name of the three new ones are left out.
    An empty table gives an empty table.
    """
    out = _decided(docs, min_chars, min_docs, batches)
    cols = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in _ADDED]
    return out.select(*cols, F.array_join("kept", "\n").alias("_llm_text"), F.size("lines").cast("bigint").alias("_llm_lines"),
                      (F.size("lines") - F.size("kept")).cast("bigint").alias("_llm_dropped"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines gone from its texts.

    A text that loses nothing stays as it is (null too).  Rows all stay; a
    document of which no line is left has an empty text.  ``n_chars``, if there,
    follows the text.  Extra columns pass through whatever their names.
    """
    out = _decided(docs, MIN_CHARS, MIN_DOCS, BATCHES)
    fewer, text = F.size("kept") < F.size("lines"), F.array_join("kept", "\n")
    new = {"text": F.when(fewer, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(fewer, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
