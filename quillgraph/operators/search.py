"""Full-text search: postings and BM25 with column weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

K1, B = 1.2, 0.75
WEIGHTS = {"label": 6.0, "content": 2.0, "metadata": 1.0}


def postings(rows: DataFrame, weights: dict[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """(term, key, weighted frequency, row length): one row per term and row.

    Columns weigh in by multiplying their term frequencies; a row's length counts
    all columns alike.
    """
    found = None
    for name, weight in weights.items():
        part = rows.select(key, F.explode(text.search_terms(F.col(name))).alias("term"), F.lit(float(weight)).alias("w"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(key, "term").agg(F.sum("w").alias("freq"), F.count(F.lit(1)).alias("n"))


def bm25(index: DataFrame, rows: int, terms: list[str], key: str = "id") -> DataFrame:
    """(key, score), smaller is better; ``index`` are postings, ``rows`` the number of rows indexed."""
    lengths = index.groupBy(key).agg(F.sum("n").alias("length"))
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mean = lengths.agg((F.sum("length") / rows).alias("mean"))
    raw = F.log((rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(1e-6)
    joined = hits.join(F.broadcast(df), "term").join(lengths, key).join(F.broadcast(mean))
    part = idf * F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy(key).agg((-F.sum(part)).alias("score"))


def search(rows: DataFrame, query: str, limit: int, weights: dict[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """The best ``limit`` rows (1 to 1000) for any of a query's tokens, ties by key."""
    terms = sorted({t for q in text.query_tokens(query) for t in q.replace("-", " ").replace("_", " ").split()})
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    # a few terms need no postings: each row's own counts, and one aggregate for what all rows tell
    split = rows.select(key, *[text.search_terms(F.col(c)).alias(f"t{i}") for i, c in enumerate(weights)])
    length = sum((F.greatest(F.size(f"t{i}"), F.lit(0)) for i in range(len(weights))), F.lit(0)).alias("length")
    held = split.select(key, length, *[F.filter(f"t{i}", lambda x: x.isin(terms)).alias(f"t{i}") for i in range(len(weights))])
    def freq(term: str):
        return sum((F.lit(float(w)) * F.greatest(F.size(F.filter(f"t{i}", lambda x: x == term)), F.lit(0)) for i, w in enumerate(weights.values())), F.lit(0.0))
    counted = held.select(key, "length", *[freq(t).alias(f"f{j}") for j, t in enumerate(terms)])
    seen = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), *[F.count_if(F.col(f"f{j}") > 0).alias(f"d{j}") for j in range(len(terms))]).first()
    mean = (seen["length"] or 0) / seen["n"] if seen["n"] else 0.0
    score = F.lit(0.0)
    for j in range(len(terms)):
        raw = math.log((seen["n"] - seen[f"d{j}"] + 0.5) / (seen[f"d{j}"] + 0.5))
        f = F.col(f"f{j}")
        score = score + F.when(f > 0, (raw if raw > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))).otherwise(0.0)
    hit = sum((F.col(f"f{j}") for j in range(len(terms))), F.lit(0.0)) > 0
    return counted.where(hit).select(key, (-score).alias("score")).orderBy("score", key).limit(max(1, min(1000, limit)))


def refresh(index: DataFrame, changed: DataFrame, rows: DataFrame, weights: dict[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """Postings after the rows of ``changed`` (keys) were replaced or removed."""
    keys = changed.select(key).distinct()
    return index.join(keys, key, "left_anti").unionByName(postings(rows.join(keys, key, "left_semi"), weights, key))


def lexical_score(label, content, metadata, tokens: list[str]):
    """6, 2 and 1 for each token that a label, content or metadata contains."""
    out = F.lit(0)
    for t in tokens:
        for c, w in ((label, 6), (content, 2), (metadata, 1)):
            out = out + F.when(F.contains(F.lower(c), F.lit(t)), w).otherwise(0)
    return out


def late_filter(hits: DataFrame, keep, limit: int) -> DataFrame:
    """Over-fetch, then filter, then cut; the filter does not reach below the first limit."""
    first = hits.orderBy("score", "id").limit(max(limit, min(5000, 20 * limit)))
    return first.where(keep).orderBy("score", "id").limit(limit)


UNIT_WEIGHTS = {"text": 6.0, "metadata": 1.0}


def search_units(units: DataFrame, files: DataFrame, query: str, limit: int, keep=None) -> DataFrame:
    """Units (id, path, text, metadata) that match a query best, with their file's columns.

    Text weighs 6, metadata 1.  Units of files that were not read in full are no
    candidates.  ``keep``, a condition on unit and file, is applied after more were
    fetched than asked for.
    """
    whole = units.join(files.where("scan = 'full'"), "path")
    hits = search(whole, query, max(limit, min(1000, 20 * limit)), UNIT_WEIGHTS).join(whole, "id")
    return late_filter(hits, F.lit(True) if keep is None else keep, limit)


def recent(rows: DataFrame, times: list, keys: list[str], limit: int, keep=None) -> DataFrame:
    """The latest ``limit`` rows (0: all) that pass, by the first known of ``times``, then by ``keys``."""
    kept = rows if keep is None else rows.where(keep)
    ordered = kept.orderBy(F.desc_nulls_last(F.coalesce(*times)), *keys)
    return ordered.limit(limit) if limit > 0 else ordered


def seeds(scored: DataFrame, limit: int = 5) -> DataFrame:
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def ranked(rows: DataFrame, by: list, within: list[str]) -> DataFrame:
    return rows.select("*", F.row_number().over(Window.partitionBy(*within).orderBy(*by)).alias("rank"))
