"""Plain files, skills and globs: one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text
from .specs import glob_regex, glob_root

EXTENSIONS = (".md", ".txt", ".json", ".jsonl")


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text, modified, size) of every file below ``root`` whose name fits."""
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True))
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/")
    return rows.select(path.alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Files whose whole path fits a glob and that have a known extension."""
    return read_texts(spark, glob_root(pattern)).where(F.col("path").rlike(glob_regex(pattern)) & loadable(F.col("path")))


def loadable(path):
    return F.lower(path).rlike(r"\.(md|txt|json|jsonl)$")


def read_skills(spark: SparkSession, root: str, limit: int = 0) -> DataFrame:
    """``SKILL.md`` files outside plugin caches, named by their folder; dotted paths last."""
    found = read_texts(spark, root, "SKILL.md").where(~F.contains("path", F.lit("plugins/cache")))
    named = found.select("*", F.element_at(F.split("path", "/"), -2).alias("name"), F.col("path").rlike(r"/\.").alias("dotted"))
    ordered = named.orderBy("dotted", "path").drop("dotted")
    return ordered.limit(limit) if limit > 0 else ordered


def to_documents(files: DataFrame, source_set: str, role: str, limit: int = 8000) -> DataFrame:
    """id, source_set, role, uri, text, char_count, truncated."""
    s = F.lit(source_set)
    return files.select(identity.document_id(s, F.col("path"), F.col("text")).alias("id"), s.alias("source_set"), F.lit(role).alias("role"),
                        F.col("path").alias("uri"), text.compact(F.col("text"), limit).alias("text"), F.length("text").alias("char_count"),
                        (F.length(text.squeeze(F.col("text"))) > limit).alias("truncated"))
