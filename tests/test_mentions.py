"""A skill that many documents tell is one name to the memories that mention it."""

import time

from pyspark.sql import functions as F

from quillgraph.plans import snapshot


def test_mentions_do_not_multiply_by_documents(spark):
    """20,000 documents of one skill and 20,000 memories that name it: as many rows as memories, not 400 million on the way."""
    n = 20_000
    docs = spark.range(n).select(F.lit("Lint it").alias("skill_name"), F.lit("skill:Lint it").alias("key"))
    notes = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id", F.lit("use $lint it, then stop").alias("body"))
    snapshot.skill_mentions(notes.limit(1), docs.limit(1)).count()
    began = time.perf_counter()
    rows = snapshot.skill_mentions(notes, docs)
    assert rows.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("skill_key"), F.max("skill_name")).first() == (n, n, "skill:Lint it", "Lint it")
    assert time.perf_counter() - began < 10
