"""Order-dependent operators: budgets, samples, canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import folder, written


def budget(rows: DataFrame, size: Column, total: int, order: list, by: list[str]) -> DataFrame:
    """``taken`` characters of each row under a running budget: whole, cut, or 0; by prefix sums."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum(size).over(w), F.lit(0))
    return rows.select("*", F.greatest(F.least(size, left), F.lit(0)).cast("bigint").alias("taken"))


def round_robin(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The first of each group, then the second of each, and so on."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(key)).alias("round")
    return rows.select("*", r).orderBy("round", group).limit(limit)


def systematic(rows: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """``limit`` rows of each group at even distances: places floor(i * n / limit).

    Rows are written in sorted ranges of group and key; a row's place is its place in its range after those of
    the ranges before it, so no task holds a group, however few there are.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, key).sortWithinPartitions(by, key)
    # ids ascend in the order of the rows, 2^33 apart from range to range
    dealt = written(dealt.select("*", F.monotonically_increasing_id().alias("_at")), folder(spark, "systematic"))
    part = F.shiftright("_at", 33)
    w = Window.partitionBy("_by")
    before = F.coalesce(F.sum("m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count(F.lit(1)).alias("m"), F.min("_at").alias("_first"))
    ranges = ranges.select("_by", "_part", "_first", before.alias("_before"), F.sum("m").over(w).alias("n"))
    placed = dealt.join(F.broadcast(ranges), F.col(by).eqNullSafe(F.col("_by")) & (part == F.col("_part")))
    placed = placed.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "n")
    # place p is taken if some i has floor(i * n / limit) = p
    i = F.ceil(F.col("place") * limit / F.col("n"))
    return placed.where((F.col("n") <= limit) | ((i < limit) & (F.floor(i * F.col("n") / limit) == F.col("place")))).drop("place", "n")


def canonical(messages: DataFrame, by: list[str], priority: Column, pos: str) -> DataFrame:
    """The message of highest priority, of equals the later."""
    w = Window.partitionBy(*by).orderBy(priority.desc(), F.col(pos).desc())
    return messages.select("*", F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


def nearest_rank(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: place ceil(n * share), from 1."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({s}) within group (order by `{value}`)").alias(n) for n, s in shares.items()])


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def all_or_nothing(value: str, name: str) -> Column:
    """A sum that is null if any row lacks the value."""
    return F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias(name)
