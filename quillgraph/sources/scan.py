"""Finding session logs and reading no more of them than their filter asks: header, scope, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, memories, sessions

HEADER_BYTES, LINE_BYTES, PREFIX = 1 << 20, 64 << 10, 2048


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ns) of every ``rollout-*.jsonl`` below ``root``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "rollout-*.jsonl").load(root)
    return rows.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def timestamp_of(raw: Column) -> Column:
    """The timestamp in a line's beginning, without parsing the line; null if there is none."""
    return F.nullif(F.regexp_extract(F.substring(raw, 1, PREFIX), r'"timestamp"\s*:\s*"([^"]+)"', 1), F.lit(""))


def within_days(timestamp: Column, now: str, days: int | None) -> Column:
    """Whether a session is young enough; no limit, a limit of 0, and times that are missing or unreadable pass."""
    if not days:
        return F.lit(True)
    return F.coalesce(F.try_to_timestamp(timestamp) >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)), F.lit(True))


def scopes(lines: DataFrame) -> DataFrame:
    """One row a file: session_id, cwds, first_ts, last_ts, long_lines, headed.

    Lines have path, line, raw.  Only headers and turn contexts are parsed.  Lines
    over 64 KiB are counted and give their time, but are not parsed.  A header over
    1 MiB is none.
    """
    size, kind = F.octet_length("raw"), F.get_json_object("raw", "$.type")
    context = F.col("raw").rlike(r'"type"\s*:\s*"(session_meta|turn_context)"')
    parsed = F.when(context & (size <= F.when(F.col("line") == 1, HEADER_BYTES).otherwise(LINE_BYTES)), F.col("raw"))
    rows = lines.where(F.trim("raw") != "").select("path", "line", (size > LINE_BYTES).alias("long"), timestamp_of(F.col("raw")).alias("ts"), parsed.alias("raw")).select(
        "path", "line", "long", "ts", kind.alias("type"), F.get_json_object("raw", "$.payload.cwd").alias("cwd"),
        F.coalesce(F.get_json_object("raw", "$.payload.id"), F.get_json_object("raw", "$.payload.session_id")).alias("session"))
    head = (F.col("line") == 1) & F.col("type").eqNullSafe("session_meta")
    when = F.when(F.col("ts").isNotNull(), F.col("line"))
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return rows.groupBy("path").agg(
        F.coalesce(F.max(F.when(head, F.col("session"))), F.first(name)).alias("session_id"), F.max(F.when(head, F.col("cwd"))).alias("cwd"), F.array_sort(F.collect_set("cwd")).alias("cwds"),
        F.min_by("ts", when).alias("first_ts"), F.max_by("ts", when).alias("last_ts"), F.count_if("long").alias("long_lines"), F.bool_or(head).alias("headed"))


def probe(found: DataFrame, keep: Column | None = None) -> DataFrame:
    """(path, scan, reason): how far each file must be read.

    ``keep`` is a condition on ``cwd``.  Without a header nothing is read.  Without a
    filter all is.  A file whose header fails and whose turns never move stays at
    its header; one of which some folders pass and some fail is mixed and left out.
    """
    if keep is None:
        return found.select("path", F.when(F.col("headed"), "full").otherwise("header").alias("scan"), F.when(~F.col("headed"), "no-header").alias("reason"))
    each = found.select("path", "headed", F.explode_outer("cwds").alias("cwd")).groupBy("path", "headed").agg(
        F.count_if(F.coalesce(keep, F.lit(False))).alias("good"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("bad"), F.count("cwd").alias("cwds"))
    scan = F.when(~F.col("headed"), "header").when(F.col("good") == 0, F.when(F.col("cwds") <= 1, "header").otherwise("scope")).when(F.col("bad") > 0, "scope").otherwise("full")
    reason = F.when(~F.col("headed"), "no-header").when(F.col("good") == 0, "filter-mismatch").when(F.col("bad") > 0, "mixed-scope")
    return each.select("path", scan.alias("scan"), reason.alias("reason"))


def select_units(lines: DataFrame, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Units of the files that must be read whole, and the decisions on all; others' contents are not parsed."""
    found = scopes(lines)
    decided = probe(found, keep)
    parsed = sessions.parse_lines(lines.join(decided.where("scan = 'full'").select("path"), "path", "left_semi"))
    return sessions.with_ids(sessions.segment(parsed), sessions.headers(parsed)), decided


def scan_counts(decided: DataFrame, units: DataFrame) -> DataFrame:
    """One row: files, header, scope and full scans, mixed ones, those excluded unread, units selected."""
    one = decided.agg(F.count(F.lit(1)).alias("candidate_files"), *[F.count_if(F.col("scan") == s).alias(f"{s}_scans") for s in ("header", "scope", "full")],
                      F.count_if(F.col("reason").eqNullSafe("mixed-scope")).alias("mixed_scope_rejected"), F.count_if(F.col("reason").eqNullSafe("filter-mismatch")).alias("excluded_before_content"))
    return one.join(units.agg(F.count(F.lit(1)).alias("selected_units")))


# --- source sets ----------------------------------------------------------------------------------

def load_notes(spark: SparkSession, home: str, root: str | None = None, documents: int = 0, hints: int = 0) -> tuple[DataFrame, DataFrame]:
    """Notes and their records; with a root only records of projects below it and the notes that hold them.  Limits of 0 are none."""
    notes = memories.read_notes(spark, home)
    records = memories.to_records(notes)
    if root:
        place = F.regexp_replace("project", "/+$", "")
        records = records.where(F.coalesce((place == root.rstrip("/")) | place.startswith(root.rstrip("/") + "/"), F.lit(False)))
        notes = notes.join(records.select("rel").distinct(), "rel", "left_semi")
    notes, records = notes.orderBy("rel"), records.orderBy("rel", "line")
    return notes.limit(documents) if documents > 0 else notes, records.limit(hints) if hints > 0 else records


def load_set(spark: SparkSession, kind: str, value: str, name: str, limit: int = 0) -> DataFrame:
    """Documents of one source by its kind; sessions must come through the catalogue."""
    if kind.endswith("sessions"):
        raise ValueError("sessions are read through the catalogue")
    if kind == "glob":
        rows, role = files.read_glob(spark, value), "file"
    elif kind == "file":
        rows, role = files.read_texts(spark, value), "file"
    elif kind.endswith("skills"):
        rows, role = files.read_skills(spark, value, limit), "skill"
    elif kind.endswith("memories"):
        rows, role = files.read_texts(spark, value, "*.md"), "note"
    else:
        raise ValueError(f"unknown source kind: {kind}")
    out = files.to_documents(rows, name, role)
    return out.orderBy("uri").limit(limit) if limit > 0 else out


def union_first(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of all parts; of those that share a key the one of the first part stays."""
    every = None
    for i, part in enumerate(parts):
        one = part.select("*", F.lit(i).alias("_part"))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    cols = [c for c in every.columns if c not in (key, "_part")]
    kept = every.groupBy(key).agg(F.min_by(F.struct(*cols), "_part").alias("r"))
    return kept.select(key, *[F.col(f"r.`{c}`").alias(c) for c in cols])


# --- artifacts of runs ----------------------------------------------------------------------------

def write_artifact(rows: DataFrame, folder: str, name: str) -> str:
    """One artifact of a run as JSON lines in a folder of its own."""
    path = f"{folder.rstrip('/')}/{name}"
    rows.write.mode("overwrite").json(path)
    return path


def read_artifact(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """An artifact's rows; one that was not written is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path.toString())


def read_legacy(spark: SparkSession, path: str, versions: tuple[int, ...] = (1, 2)) -> dict[str, DataFrame]:
    """Nodes, revisions and edges of an old JSON snapshot; another version is an error."""
    whole = spark.read.option("multiLine", True).json(path)
    found = whole.select("schemaVersion").first()
    if found is None or found[0] not in versions:
        raise ValueError(f"snapshot version {found and found[0]} is not one of {versions}")
    return {name: whole.select(F.explode(name).alias("r")).select("r.*") for name in ("nodes", "revisions", "edges") if name in whole.columns}
