"""A graph snapshot from loaded documents and notes: staging items and the eight derivations of edges.

Documents have pos (their order), source_set, role, uri, text, session_id, unit_id,
unit_ordinal, rel_path, skill_name, path, cwd, project_path, modified.  Source sets
have id, kind (sessions, memories, skills, file, glob), root, scope.  Memories have
id, type, scope, status, body, heading, source_path, line, project_path, cwd,
thread_id, modified.  All edges are joins on keys; no text is compared with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNIT, SUMMARY, SKILL = "session-unit", "session-summary", "skill"
ITEM = ("source_key", "kind", "scope", "project", "label", "content", "uri", "metadata", "source_modified_at")


def canonical(path: Column) -> Column:
    """A path without doubled or trailing slashes; null and empty are null."""
    short = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    return F.nullif(short, F.lit(""))


def below(path: Column, root: str) -> Column:
    """Whether a canonical path is ``root`` or lies below it."""
    return F.coalesce((path == root) | path.startswith(root.rstrip("/") + "/"), F.lit(False))


def _known(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _json(**fields: Column | str) -> Column:
    """A JSON object of columns; nulls are left out."""
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()]))


def _ref(**fields: Column | str) -> Column:
    """One evidence reference: a JSON object that shows nulls too."""
    return F.array(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"}))


def document_key(role: Column) -> Column:
    """What a document is known by, whatever its text."""
    unit = F.concat(F.lit("session:"), F.coalesce(_known("session_id"), F.lit("unknown")), F.lit(":responsibility:"), F.coalesce(_known("unit_id"), "uri"))
    return (F.when(role == UNIT, unit).when(role == SUMMARY, F.concat(F.lit("session:"), F.coalesce(_known("session_id"), "uri")))
            .when(role == SKILL, F.concat(F.lit("skill:"), F.coalesce(_known("path"), _known("skill_name"), "uri")))
            .otherwise(F.concat(F.lit("document:"), F.coalesce(_known("rel_path"), "uri"))))


def document_kind(role: Column) -> Column:
    return F.when(role == SUMMARY, "session").when(role == SKILL, "skill").otherwise("source_document")


def document_label(role: Column) -> Column:
    number = F.when(F.col("unit_ordinal").isNotNull(), F.concat(F.lit(" #"), (F.col("unit_ordinal") + 1).cast("string"))).otherwise("")
    session = F.coalesce(_known("session_id"), "uri")
    return (F.when(role == UNIT, F.concat(F.lit("Responsibility "), session, number)).when(role == SUMMARY, F.concat(F.lit("Session "), session))
            .when(role == SKILL, F.concat(F.lit("$"), F.coalesce(_known("skill_name"), F.lit("skill")))).otherwise(F.coalesce(_known("rel_path"), "uri")))


def root_scoped(sets: DataFrame, project: str) -> DataFrame:
    """One row: whether a session or memory source has the project as its root (P7's strongest filter)."""
    return sets.agg(F.coalesce(F.bool_or(F.col("kind").isin("sessions", "memories") & (canonical(F.col("root")) == project)), F.lit(False)).alias("rooted"))


def placed_documents(documents: DataFrame, sets: DataFrame, project: str) -> DataFrame:
    """Documents with key, kind, label, item_project and item_scope; sources are few and sent to every task."""
    s = sets.select(F.col("id").alias("source_set"), F.col("kind").alias("set_kind"), canonical(F.col("root")).alias("set_root"), F.col("scope").alias("set_scope"))
    rows = documents.join(F.broadcast(s), "source_set", "left")
    role = F.col("role")
    everywhere = F.coalesce((F.col("set_kind") == "sessions") & (F.col("set_scope") == "global"), F.lit(False))
    rooted = F.coalesce(F.col("set_kind").isin("sessions", "memories") & F.col("set_root").isNotNull(), F.lit(False))
    own = F.coalesce(canonical(F.col("cwd")), canonical(F.col("project_path")))
    caller = F.when(F.col("set_kind").isin("file", "glob"), F.lit(project))
    place = F.when(everywhere, F.lit(None).cast("string")).when(rooted, F.lit(project)).otherwise(F.coalesce(own, caller))
    rows = rows.select("*", document_key(role).alias("key"), document_kind(role).alias("kind"), document_label(role).alias("label"), place.alias("item_project"), everywhere.alias("everywhere"))
    scope = (F.when((F.col("kind") == "skill") | F.col("everywhere"), "global").when(F.col("item_project").isNotNull(), "project")
             .when((F.col("kind") == "source_document") & (F.col("set_kind") == "memories"), "corpus").otherwise("global"))
    return rows.select("*", scope.alias("item_scope"))


def admitted_memories(memories: DataFrame, sets: DataFrame, project: str) -> DataFrame:
    """Active memories of the project: below it if a source is rooted there, else global ones and its own."""
    place = F.coalesce(canonical(F.col("project_path")), canonical(F.col("cwd")))
    rows = memories.where("status = 'active'").join(F.broadcast(root_scoped(sets, project))).select("*", place.alias("place"))
    keep = F.when(F.col("rooted"), below(F.col("place"), project)).otherwise((F.col("scope") == "global") | F.coalesce(F.col("place") == project, F.lit(False)))
    key = F.when(_known("source_path").isNotNull(), F.concat(F.lit("memory:"), "source_path", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("document")))).otherwise(
        F.concat(F.lit("memory:"), F.col("id").cast("string")))
    item = F.when(F.col("rooted") & below(F.col("place"), project), F.lit(project)).otherwise(F.col("place"))
    return rows.where(keep).select("*", key.alias("key"), item.alias("item_project"))


def session_parents(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit documents with ``parent``, the key of their session) and the parents that no earlier document stands for.

    Before a unit, the last other document of its session is the parent; else one made from the first such unit.
    """
    known = placed.where(_known("session_id").isNotNull())
    w = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("role") != UNIT, F.col("key"))
    rows = known.select("*", F.last(other, ignorenulls=True).over(w).alias("before"))
    units = rows.where(F.col("role") == UNIT)
    made = units.where("before is null").groupBy("session_id").agg(F.min_by(F.struct("item_scope", "item_project", "modified"), "pos").alias("u"))
    units = units.select("*", F.coalesce("before", F.concat(F.lit("session:"), "session_id")).alias("parent"))
    return units, made.select("session_id", F.concat(F.lit("session:"), "session_id").alias("key"), "u.item_scope", "u.item_project", "u.modified")


def session_by_id(placed: DataFrame, made: DataFrame) -> DataFrame:
    """(thread, session_key): the document that finally stands for a session."""
    last = placed.where(_known("session_id").isNotNull() & (F.col("role") != UNIT)).groupBy(F.col("session_id").alias("thread")).agg(F.max_by("key", "pos").alias("session_key"))
    return last.unionByName(made.select(F.col("session_id").alias("thread"), F.col("key").alias("session_key")).join(last.select("thread"), "thread", "left_anti"))


def skill_mentions(memories: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, id, skill_key, skill_name): memories that name a skill as ``$name`` between blanks or before punctuation.

    Mentions are cut out of the body, so they meet names by an equi join, each name of a
    skill once, however many documents tell it.  A name
    may itself hold blanks or punctuation: a mention is every beginning of what
    follows the ``$`` that ends where a mention may end, as long as the longest name
    has words.
    """
    skills = placed.where(_known("skill_name").isNotNull()).select(F.lower("skill_name").alias("name"), "skill_name", F.col("key").alias("skill_key"), F.size(F.split("skill_name", r"\s")).alias("words")).distinct()
    most = skills.agg(F.coalesce(F.max("words"), F.lit(0)).alias("most"))
    rest = memories.select("key", "id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r"(?s)(?:^|(?<=\s))\$(.+?(?=(?<!\S)\$|\z))"), 1)).alias("rest")).join(F.broadcast(most))
    tail = F.transform(F.sequence(F.lit(1), F.greatest("most", F.lit(1))), lambda n: F.array_join(F.slice(F.split("rest", r"(?<=\s)"), F.lit(1), n), ""))
    whole = rest.select("key", "id", F.explode(F.array_distinct(tail)).alias("part"))
    trimmed = whole.select("key", "id", F.regexp_replace("part", r"\s+$", "").alias("part"))
    # a mention also ends before each of .,;:!?)
    ends = F.filter(F.sequence(F.lit(1), F.length("part")), lambda i: (i == F.length("part")) | F.substring("part", i + 1, F.lit(1)).isin(*".,;:!?)"))
    names = trimmed.where("part <> ''").select("key", "id", F.explode(F.transform(ends, lambda i: F.substring("part", F.lit(1), i))).alias("name")).distinct()
    return names.join(skills, "name").select("key", "id", "skill_key", "skill_name").distinct()


def edges(documents: DataFrame, memories: DataFrame, sets: DataFrame, project: str, prefix: str = "notes") -> DataFrame:
    """(source_key, target_key, kind, confidence, derivation, evidence_refs) of all derivations, names beginning with ``prefix``.

    An evidence reference is a JSON object that tells which row the edge comes from.
    """
    placed, admitted = placed_documents(documents, sets, project), admitted_memories(memories, sets, project)
    units, made = session_parents(placed)
    here = F.lit(f"project:{project}")
    by_path = placed.where(_known("rel_path").isNotNull()).groupBy(F.col("rel_path").alias("source_path")).agg(F.max_by("key", "pos").alias("document_key"))
    evidence = admitted.join(by_path, "source_path").select("key", "document_key", "source_path", "line", F.concat(F.lit("evidence:"), "source_path", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("document"))).alias("evidence_key"))
    seen = admitted.join(session_by_id(placed, made), F.col("thread_id") == F.col("thread"))
    memory = F.col("id").cast("string")
    place = _ref(sourcePath="source_path", line="line")
    parts = [
        (made.where(F.col("item_project") == project), "key", here, "APPLIES_TO_PROJECT", "session-scope", _ref(sessionId="session_id")),
        (units, "key", F.col("parent"), "DERIVED_FROM", "responsibility-unit-session", _ref(sessionId="session_id", unitId=_known("unit_id"))),
        (placed.where(F.col("item_project") == project), "key", here, "APPLIES_TO_PROJECT", "project-metadata", _ref(uri="uri", metadataField=F.lit("cwd"))),
        (admitted.where(F.col("item_project") == project), "key", here, "APPLIES_TO_PROJECT", "memory-project-scope", _ref(memoryId=memory, projectPath="item_project")),
        (evidence, "key", F.col("evidence_key"), "DERIVED_FROM", "memory-line-provenance", place),
        (evidence, "evidence_key", F.col("document_key"), "DERIVED_FROM", "evidence-document-provenance", place),
        (seen, "key", F.col("session_key"), "OBSERVED_IN_SESSION", "thread-id-match", _ref(memoryId=memory, threadId="thread_id")),
        (skill_mentions(admitted, placed), "key", F.col("skill_key"), "REQUIRES_SKILL", "explicit-skill-reference", _ref(memoryId=memory, skillName="skill_name")),
    ]
    out = None
    for df, source, target, kind, name, refs in parts:
        part = df.select(F.col(source).alias("source_key"), target.alias("target_key"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"), F.lit(f"{prefix}-{name}").alias("derivation"), refs.alias("evidence_refs"))
        out = part if out is None else out.unionByName(part)
    return out


def items(spark: SparkSession, documents: DataFrame, memories: DataFrame, sets: DataFrame, project: str) -> DataFrame:
    """Staging items (ITEM) of project, documents, made sessions, memories and evidence; of a key's equal items the first stays.

    ``conflict`` marks keys whose items differ in kind, scope, project or content.
    """
    placed, admitted = placed_documents(documents, sets, project), admitted_memories(memories, sets, project)
    _, made = session_parents(placed)
    null = F.lit(None).cast("string")
    base = spark.createDataFrame([(f"project:{project}", "project", "project", project, project.rstrip("/").rsplit("/", 1)[-1] or project, project, -1)], "source_key string, kind string, scope string, project string, label string, content string, at bigint")
    from_document = _json(sessionId="session_id", unitId="unit_id", unitOrdinal="unit_ordinal", relPath="rel_path", skillName="skill_name", path="path", cwd="cwd", projectPath="project_path", updatedAt="modified", sourceSet="source_set", role="role")
    memory = F.col("id").cast("string")
    from_memory = _json(memoryId=memory, memoryType="type", status="status", heading="heading", sourcePath="source_path", line="line", projectPath="project_path", cwd="cwd", threadId="thread_id", updatedAt="modified")
    parts = [base.select("source_key", "kind", "scope", "project", "label", "content", null.alias("uri"), _json(path="content").alias("metadata"), null.alias("source_modified_at"), F.struct(F.lit(0).alias("step"), "at").alias("at"))]
    parts.append(placed.select(F.col("key").alias("source_key"), "kind", F.col("item_scope").alias("scope"), F.col("item_project").alias("project"), "label", F.col("text").alias("content"), "uri", from_document.alias("metadata"), F.col("modified").alias("source_modified_at"), F.struct(F.lit(1).alias("step"), F.col("pos").cast("bigint").alias("at")).alias("at")))
    parts.append(made.select(F.col("key").alias("source_key"), F.lit("session").alias("kind"), F.col("item_scope").alias("scope"), F.col("item_project").alias("project"), F.concat(F.lit("Session "), "session_id").alias("label"),
                             F.concat(F.lit("Session "), "session_id", F.lit(" responsibility-unit index.")).alias("content"), F.concat(F.lit("session://"), F.url_encode("session_id")).alias("uri"), _json(sessionId="session_id", responsibilityUnits=F.lit(True)).alias("metadata"), F.col("modified").alias("source_modified_at"),
                             F.struct(F.lit(1).alias("step"), F.lit(-1).cast("bigint").alias("at")).alias("at")))
    line = F.when(F.coalesce(F.col("line"), F.lit(0)) != 0, F.concat(F.lit("#L"), F.col("line").cast("string"))).otherwise("")
    order = F.struct(F.lit(2).alias("step"), F.xxhash64("key").alias("at")).alias("at")
    uri = F.concat(F.lit("memory://"), F.coalesce(F.concat(_known("source_path"), line), F.col("id").cast("string")))
    parts.append(admitted.select(F.col("key").alias("source_key"), F.lit("memory").alias("kind"), "scope", F.col("item_project").alias("project"), F.coalesce(_known("heading"), F.substring("body", 1, 96)).alias("label"),
                                 F.col("body").alias("content"), uri.alias("uri"), from_memory.alias("metadata"), F.col("modified").alias("source_modified_at"), order))
    by_path = placed.where(_known("rel_path").isNotNull()).groupBy(F.col("rel_path").alias("source_path")).agg(F.max_by("uri", "pos").alias("document_uri"))
    number = F.coalesce(F.col("line").cast("string"), F.lit("document"))
    parts.append(admitted.drop("uri").join(by_path, "source_path").select(
        F.concat(F.lit("evidence:"), "source_path", F.lit(":"), number).alias("source_key"), F.lit("evidence").alias("kind"), "scope", F.col("item_project").alias("project"),
        F.concat("source_path", F.regexp_replace(line, "#L", ":")).alias("label"), F.col("body").alias("content"),
        F.concat(F.coalesce("document_uri", F.concat(F.lit("memory://"), "source_path")), line).alias("uri"), _json(sourcePath="source_path", line="line", memoryId=memory).alias("metadata"), F.col("modified").alias("source_modified_at"), order))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    body = F.struct("kind", "scope", "project", "label", "content", "uri", "metadata", "source_modified_at")
    kinds = F.count_distinct(F.xxhash64("kind", F.coalesce("scope", F.lit("")), F.coalesce("project", F.lit("\0")), F.coalesce("content", F.lit("\0"))))
    return every.groupBy("source_key").agg(F.min_by(body, "at").alias("i"), (kinds > 1).alias("conflict")).select("source_key", "i.*", "conflict")
