"""Queries of the snapshot builder, topics, validators and deliberation on the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import deliberation, graph, records, search, sync
from .plans import responsibility, snapshot, topics
from .queries import _CT, _EDGES, _SQUEEZE, key_edges, query, read

PROJECT = "/p/src1"


# --- the snapshot builder -------------------------------------------------------------------------

def corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, turns as memories, and three sources, as the snapshot builder takes them."""
    i = F.col("doc_id")
    kind = i % 5
    s = (lambda c: c.cast("string"))
    documents = read(spark, d, "documents").select(
        i.alias("pos"), F.element_at(F.array(*map(F.lit, ("S", "M", "F"))), (i % 3 + 1).cast("int")).alias("source_set"),
        F.when(kind == 0, snapshot.UNIT).when(kind == 1, snapshot.SUMMARY).when(kind == 2, snapshot.SKILL).otherwise("note").alias("role"),
        F.concat(F.lit("doc://"), s(i)).alias("uri"), F.col("text"), F.when(kind < 2, F.concat(F.lit("s"), s(i % 23))).alias("session_id"), F.concat(F.lit("u"), s(i)).alias("unit_id"), F.lit(None).cast("int").alias("unit_ordinal"),
        F.when(kind > 2, F.concat(F.lit("n"), s(i % 50), F.lit(".md"))).alias("rel_path"), F.when(kind == 2, F.concat("lang", s(i % 4))).alias("skill_name"), F.lit(None).cast("string").alias("path"),
        F.when(i % 7 > 0, F.concat(F.lit("/p//"), "source", F.lit("/"))).alias("cwd"), F.lit(None).cast("string").alias("project_path"), F.lit(None).cast("string").alias("modified"))
    c, t = F.col("conv_id"), F.col("turn")
    skill = F.concat(F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (c % 4 + 1).cast("int")), s(t % 4))
    memories = read(spark, d, "conversations").select(
        (c * 100 + t).alias("id"), F.lit("semantic").alias("type"), F.when(t % 2 == 0, "global").otherwise("project").alias("scope"), F.when(t % 5 == 4, "retired").otherwise("active").alias("status"),
        F.concat(F.lit("Use $"), F.upper(skill), F.when(t % 3 == 0, ", then stop").when(t % 3 == 1, "x instead").otherwise("")).alias("body"), F.lit(None).cast("string").alias("heading"),
        F.concat(F.lit("n"), s(c % 60), F.lit(".md")).alias("source_path"), (c * 10 + t).cast("int").alias("line"), F.concat(F.lit("/p/src"), s(c % 4)).alias("project_path"), F.lit(None).cast("string").alias("cwd"),
        F.concat(F.lit("s"), s(c % 30)).alias("thread_id"), F.lit(None).cast("string").alias("modified"))
    sets = spark.createDataFrame([("S", "sessions", None, "project"), ("M", "memories", None, None), ("F", "file", None, None)], "id string, kind string, root string, scope string")
    return documents, memories, sets


_CORPUS = """
d AS (SELECT doc_id AS pos, ['S', 'M', 'F'][doc_id % 3 + 1] AS st, doc_id % 5 AS k, 'doc://' || doc_id AS uri, text, source, 's' || doc_id % 23 AS sid, 'n' || doc_id % 50 || '.md' AS rel, lower(lang || doc_id % 4) AS skill,
       CASE WHEN doc_id % 7 > 0 THEN '/p/' || source WHEN doc_id % 3 = 2 THEN '/p/src1' END AS place FROM documents),
e AS (SELECT *, CASE k WHEN 0 THEN 'session:' || sid || ':responsibility:u' || pos WHEN 1 THEN 'session:' || sid WHEN 2 THEN 'skill:' || (SELECT lang FROM documents WHERE doc_id = pos) || pos % 4 ELSE 'document:' || rel END AS key FROM d),
m AS (SELECT conv_id * 100 + turn AS id, conv_id AS c, turn AS t, 'n' || conv_id % 60 || '.md' AS path, conv_id * 10 + turn AS line, '/p/src' || conv_id % 4 AS place, 's' || conv_id % 30 AS thread,
       ['en', 'de', 'fr', 'es'][conv_id % 4 + 1] || turn % 4 AS skill FROM conversations WHERE turn % 5 <> 4 AND (turn % 2 = 0 OR conv_id % 4 = 1)),
k AS (SELECT *, 'memory:' || path || ':' || line AS key FROM m),
u AS (SELECT e.*, (SELECT arg_max(x.key, x.pos) FROM e x WHERE x.k = 1 AND x.sid = e.sid AND x.pos < e.pos) AS prior FROM e WHERE k = 0),
made AS (SELECT sid, arg_min(struct_pack(place := place), pos).place AS place FROM u WHERE prior IS NULL GROUP BY sid),
ses AS (SELECT sid, arg_max(key, pos) AS key FROM e WHERE k = 1 GROUP BY sid UNION SELECT sid, 'session:' || sid FROM made WHERE sid NOT IN (SELECT sid FROM e WHERE k = 1)),
rel AS (SELECT rel, arg_max(key, pos) AS key, arg_max(uri, pos) AS uri FROM e WHERE k > 2 GROUP BY rel)"""


@query("g9_edges", f"""
WITH {_CORPUS},
x AS (SELECT 'session:' || sid AS source_key, 'project:{PROJECT}' AS target_key, 'APPLIES_TO_PROJECT' AS kind, 'session-scope' AS derivation, '{{"sessionId":"' || sid || '"}}' AS evidence FROM made WHERE place = '{PROJECT}'
UNION ALL SELECT key, coalesce(prior, 'session:' || sid), 'DERIVED_FROM', 'responsibility-unit-session', '{{"sessionId":"' || sid || '","unitId":"u' || pos || '"}}' FROM u
UNION ALL SELECT key, 'project:{PROJECT}', 'APPLIES_TO_PROJECT', 'project-metadata', '{{"uri":"' || uri || '","metadataField":"cwd"}}' FROM e WHERE place = '{PROJECT}'
UNION ALL SELECT key, 'project:{PROJECT}', 'APPLIES_TO_PROJECT', 'memory-project-scope', '{{"memoryId":"' || id || '","projectPath":"' || place || '"}}' FROM k WHERE place = '{PROJECT}'
UNION ALL SELECT k.key, 'evidence:' || path || ':' || line, 'DERIVED_FROM', 'memory-line-provenance', '{{"sourcePath":"' || path || '","line":' || line || '}}' FROM k JOIN rel ON rel = path
UNION ALL SELECT 'evidence:' || path || ':' || line, rel.key, 'DERIVED_FROM', 'evidence-document-provenance', '{{"sourcePath":"' || path || '","line":' || line || '}}' FROM k JOIN rel ON rel = path
UNION ALL SELECT k.key, ses.key, 'OBSERVED_IN_SESSION', 'thread-id-match', '{{"memoryId":"' || id || '","threadId":"' || thread || '"}}' FROM k JOIN ses ON sid = thread
UNION ALL SELECT DISTINCT k.key, e.key, 'REQUIRES_SKILL', 'explicit-skill-reference', '{{"memoryId":"' || id || '","skillName":"' || substr(e.key, 7) || '"}}' FROM k JOIN e ON e.k = 2 AND e.skill = k.skill WHERE t % 3 <> 1)
SELECT source_key, target_key, kind, 1.0::DOUBLE AS confidence, 'notes-' || derivation AS derivation, evidence FROM x""")
def g9_edges(spark, d):
    return snapshot.edges(*corpus(spark, d), PROJECT).select("source_key", "target_key", "kind", "confidence", "derivation", F.col("evidence_refs")[0].alias("evidence"))


_ITEMS = f"""
x AS (SELECT 'project:{PROJECT}' AS source_key, 'project' AS kind, 'project' AS scope, '{PROJECT}' AS project, 'src1' AS label, '{PROJECT}' AS content, NULL AS uri, '{{"path":"{PROJECT}"}}' AS metadata, 0 AS step, -1 AS place_in
UNION ALL SELECT key, CASE k WHEN 1 THEN 'session' WHEN 2 THEN 'skill' ELSE 'source_document' END, CASE WHEN k = 2 THEN 'global' WHEN place IS NOT NULL THEN 'project' WHEN k <> 1 AND st = 'M' THEN 'corpus' ELSE 'global' END, place,
  CASE k WHEN 0 THEN 'Responsibility ' || sid WHEN 1 THEN 'Session ' || sid WHEN 2 THEN '$' || substr(key, 7) ELSE rel END, text, uri,
  '{{' || CASE WHEN k < 2 THEN '"sessionId":"' || sid || '",' ELSE '' END || '"unitId":"u' || pos || '",' || CASE WHEN k > 2 THEN '"relPath":"' || rel || '",' WHEN k = 2 THEN '"skillName":"' || substr(key, 7) || '",' ELSE '' END ||
  CASE WHEN pos % 7 > 0 THEN '"cwd":"/p//' || source || '/",' ELSE '' END || '"sourceSet":"' || st || '","role":"' || ['session-unit', 'session-summary', 'skill', 'note', 'note'][k + 1] || '"}}', 1, pos FROM e
UNION ALL SELECT 'session:' || sid, 'session', (SELECT arg_min(CASE WHEN place IS NOT NULL THEN 'project' WHEN st = 'M' THEN 'corpus' ELSE 'global' END, pos) FROM u WHERE u.sid = made.sid AND prior IS NULL), place, 'Session ' || sid, 'Session ' || sid || ' responsibility-unit index.', 'session://' || sid,
  '{{"sessionId":"' || sid || '","responsibilityUnits":true}}', 1, -1 FROM made
UNION ALL SELECT key, 'memory', CASE WHEN t % 2 = 0 THEN 'global' ELSE 'project' END, place, b, b, 'memory://' || path || CASE WHEN line <> 0 THEN '#L' || line ELSE '' END,
  '{{"memoryId":"' || id || '","memoryType":"semantic","status":"active","sourcePath":"' || path || '","line":' || line || ',"projectPath":"' || place || '","threadId":"' || thread || '"}}', 2, id FROM (SELECT *, 'Use $' || upper(skill) || CASE t % 3 WHEN 0 THEN ', then stop' WHEN 1 THEN 'x instead' ELSE '' END AS b FROM k)
UNION ALL SELECT 'evidence:' || path || ':' || line, 'evidence', CASE WHEN t % 2 = 0 THEN 'global' ELSE 'project' END, place, path || CASE WHEN line <> 0 THEN ':' || line ELSE '' END, b, rel.uri || CASE WHEN line <> 0 THEN '#L' || line ELSE '' END,
  '{{"sourcePath":"' || path || '","line":' || line || ',"memoryId":"' || id || '"}}', 2, id
  FROM (SELECT *, 'Use $' || upper(skill) || CASE t % 3 WHEN 0 THEN ', then stop' WHEN 1 THEN 'x instead' ELSE '' END AS b FROM k) q JOIN rel ON rel = path),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY step, place_in) AS n, count(*) OVER (PARTITION BY source_key) AS n_all FROM x),
c AS (SELECT source_key, count(DISTINCT kind || chr(0) || scope || chr(0) || coalesce(project, chr(1)) || chr(0) || coalesce(content, chr(1))) > 1 AS conflict FROM x GROUP BY source_key)"""


@query("g9_items", f"""
WITH {_CORPUS}, {_ITEMS}
SELECT source_key, kind, scope, project, label, uri, metadata, sha256(coalesce(content, '')) AS digest, conflict FROM r JOIN c USING (source_key) WHERE n = 1""")
def g9_items(spark, d):
    return snapshot.items(spark, *corpus(spark, d), PROJECT).select("source_key", "kind", "scope", "project", "label", "uri", "metadata", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), "conflict")


@query("u3_snapshot_sync", f"""
WITH {_CORPUS}, {_ITEMS},
i AS (SELECT source_key, replace(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM r WHERE n = 1),
a AS (SELECT *, CASE WHEN source_key LIKE 'memory:%' OR source_key LIKE 'evidence:%' THEN body || ' (changed)' ELSE body END AS later FROM i),
ids AS (SELECT 'graph-node:' || substr(sha256('notes' || chr(0) || source_key || chr(0)), 1, 24) AS id, source_key, body <> later AS changed FROM a)
SELECT 'node' AS entity, 'updated' AS op, id FROM ids WHERE changed""")
def u3_snapshot_sync(spark, d):
    """A built snapshot, synced twice: the second time the memories' texts have changed; which nodes did."""
    documents, memories, sets = corpus(spark, d)

    def staged(notes):
        key = {"source_adapter": F.lit("notes")}
        made = snapshot.items(spark, documents, notes, sets, PROJECT).withColumns(key).select("source_adapter", *snapshot.ITEM)
        met = snapshot.edges(documents, notes, sets, PROJECT).withColumns(key | {"target_adapter": F.lit("notes"), "metadata": F.lit("{}"), "input_pos": F.xxhash64("source_key", "target_key", "kind", "derivation", F.col("evidence_refs")[0])})
        return made, met

    first, _ = sync.sync(*staged(memories), None, "2026-01-01T00:00:00Z")
    changed = memories.withColumn("body", F.concat("body", F.lit(" (changed)")))
    _, delta = sync.sync(*staged(changed), first, "2026-01-02T00:00:00Z")
    return delta.where("entity = 'node'").select("entity", "op", "id")


# --- reading --------------------------------------------------------------------------------------

@query("g3_inspect", f"""
WITH e AS ({_EDGES}), i AS (SELECT *, src || '>' || dst AS id FROM e)
SELECT * FROM (SELECT 'in' AS side, id, kind FROM i WHERE dst = 'n3' ORDER BY id LIMIT 500) UNION ALL SELECT * FROM (SELECT 'out', id, kind FROM i WHERE src = 'n3' ORDER BY id LIMIT 500)
UNION ALL SELECT 'node', n_name, 'nation' FROM nation WHERE n_nationkey = 3""")
def g3_inspect(spark, d):
    nodes = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("source_key"), F.col("n_nationkey").alias("current_revision_id"))
    revisions = nodes.select(F.col("current_revision_id").alias("id"), F.col("id").alias("node_id"), F.col("source_key").alias("content"))
    node, into, out = graph.inspect(nodes, revisions, key_edges(spark, d), "n3")
    part = (lambda df, name: df.select(F.lit(name).alias("side"), "id", "kind"))
    return part(into, "in").unionByName(part(out, "out")).unionByName(node.select(F.lit("node").alias("side"), F.col("revision_content").alias("id"), F.lit("nation").alias("kind")))


_UNIT_TERMS = ", ".join(f"'{t}'" for t in text.query_tokens("the onerre shwhea hand nterti en"))


@query("x2_unit_search", f"""
WITH w AS (SELECT doc_id, text, lang, source FROM documents WHERE doc_id % 6 <> 0),
p AS (SELECT doc_id, unnest([t FOR t IN string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') IF t <> '']) AS term, 6.0 AS w FROM w
      UNION ALL SELECT doc_id, unnest([t FOR t IN string_split_regex(lower(coalesce(lang, '')), '[^\\p{{L}}\\p{{N}}]+') IF t <> '']), 1.0 FROM w),
i AS (SELECT doc_id, term, sum(w)::DOUBLE AS freq, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS length FROM i GROUP BY ALL),
k AS (SELECT count(*) AS rows FROM w), a AS (SELECT sum(length) / (SELECT rows FROM k) AS mean FROM l), h AS (SELECT * FROM i WHERE term IN ({_UNIT_TERMS})), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT h.doc_id, -sum(CASE WHEN ln((rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM h JOIN f ON h.term = f.term JOIN l ON l.doc_id = h.doc_id, k, a GROUP BY h.doc_id),
t AS (SELECT * FROM s ORDER BY score, doc_id LIMIT 200)
SELECT t.doc_id, score FROM t JOIN w ON w.doc_id = t.doc_id WHERE source <> 'src1' ORDER BY score, t.doc_id LIMIT 10""")
def x2_unit_search(spark, d):
    docs = read(spark, d, "documents")
    path = F.concat(F.lit("f"), (F.col("doc_id") % 6).cast("string"))
    units = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text", F.col("lang").alias("metadata"), "source")
    files = docs.select(path.alias("path"), F.when(F.col("doc_id") % 6 == 0, "header").otherwise("full").alias("scan")).distinct()
    return search.search_units(units, files, "the onerre shwhea hand nterti en", 10, F.col("source") != "src1").select(F.col("id").alias("doc_id"), "score")


@query("g8_units", """
WITH c AS (SELECT doc_id, 'd' || lpad(doc_id::VARCHAR, 9, '0') AS id, (doc_id % 4)::INT AS depth, doc_id % 4 = 0 AS seed, ['memory', 'session', 'skill', 'source_document', 'evidence', 'project'][doc_id % 6 + 1] AS kind, CASE WHEN doc_id % 5 < 2 THEN source || lang END AS path FROM documents),
k AS (SELECT *, NOT (seed AND kind = 'memory') AND path IS NOT NULL AND kind IN ('memory', 'evidence', 'source_document') AS clustered FROM c WHERE kind <> 'project'),
u AS (SELECT CASE WHEN clustered THEN 'source:' || path ELSE id END AS unit_key, CASE WHEN clustered THEN 'source-cluster' WHEN kind IN ('memory', 'session', 'skill') THEN kind ELSE 'resource' END AS kind, * EXCLUDE (kind) FROM k),
g AS (SELECT unit_key, kind, min(depth) AS depth, bool_or(seed) AS seed, list_sort(list(id)) AS nodes FROM u GROUP BY ALL)
SELECT g.unit_key, g.kind, g.depth, g.seed, array_to_string(g.nodes, ',') AS nodes, (SELECT string_agg(id, ',' ORDER BY id) FROM u WHERE u.unit_key = g.unit_key AND u.kind = g.kind AND u.depth = g.depth) AS expansion,
       CASE WHEN g.seed THEN 'awake' WHEN g.depth = 1 THEN 'sleeping' ELSE 'deferred' END AS state FROM g""")
def g8_units(spark, d):
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("memory", "session", "skill", "source_document", "evidence", "project")))
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(i.cast("string"), 9, "0")).alias("id"), (i % 4).cast("int").alias("depth"), (i % 4 == 0).alias("seed"), F.element_at(kinds, (i % 6 + 1).cast("int")).alias("kind"), F.col("source").alias("label"),
                                              F.when(i % 5 < 2, F.to_json(F.struct(F.concat("source", "lang").alias("sourcePath")))).alias("metadata"))
    found = responsibility.units(docs.select("id", "depth", "seed"), docs.select("id", "kind", "label", "metadata"))
    return found.select("unit_key", "kind", "depth", "seed", F.array_join("nodes", ",").alias("nodes"), F.array_join("expansion", ",").alias("expansion"), "state")


@query("j14_current", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 4 = 1")
def j14_current(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("revision_id"))
    now = part.where("id % 9 <> 0").select("id", F.when(F.col("id") % 4 == 1, F.concat("revision_id", F.lit("+"))).otherwise(F.col("revision_id")).alias("current_revision_id"))
    return responsibility.current(part, now)


# --- topics ---------------------------------------------------------------------------------------

@query("g11_topics", """
WITH u AS (SELECT source AS unit_id, lang FROM documents WHERE doc_id % 50 = 3 GROUP BY ALL),
b AS (SELECT source AS unit_id, doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id % 5 = 0
      UNION SELECT u.unit_id, d.doc_id::VARCHAR FROM u JOIN documents d ON d.lang = u.lang AND d.doc_id % 11 = 0)
SELECT s.unit_id, coalesce(count(chunk_id), 0) AS chunks, coalesce(min(chunk_id), '') AS first_chunk, s.state FROM (SELECT source AS unit_id, CASE WHEN min(doc_id) % 2 = 0 THEN 'awake' ELSE 'sleeping' END AS state FROM documents GROUP BY source) s LEFT JOIN b ON b.unit_id = s.unit_id GROUP BY s.unit_id, s.state""")
def g11_topics(spark, d):
    docs = read(spark, d, "documents")
    ids = F.col("doc_id").cast("string")
    units = docs.groupBy(F.col("source").alias("unit_id")).agg(F.array_compact(F.collect_list(F.when(F.col("doc_id") % 5 == 0, ids))).alias("nodes"), F.when(F.min("doc_id") % 2 == 0, "awake").otherwise("sleeping").alias("state"))
    contexts = docs.where("doc_id % 50 = 3").select(F.col("source").alias("unit_id"), F.col("lang").alias("source_unit"))
    chunks = docs.select(ids.alias("chunk_id"), F.when(F.col("doc_id") % 11 == 0, F.col("lang")).alias("source_unit"))
    found = topics.topics(units, contexts, chunks, PROJECT)
    return found.select("unit_id", F.size("chunks").cast("bigint").alias("chunks"), F.coalesce(F.try_element_at("chunks", F.lit(1)), F.lit("")).alias("first_chunk"), "state")


_WAKE = "CASE n_nationkey % 5 WHEN 0 THEN 'memory-cartographer' WHEN 1 THEN 'proposal-editor' ELSE 'claim-scout' END"


@query("g12_communication", f"SELECT n_nationkey AS unit_id, CASE WHEN n_regionkey = 1 THEN 'awake' ELSE 'sleeping' END AS state, {_WAKE} AS wake_target, CASE WHEN n_regionkey = 1 THEN {_WAKE} END AS attached FROM nation")
def g12_communication(spark, d):
    kinds = F.array(*map(F.lit, ("memory", "skill", "source-cluster", "session", "resource")))
    units = read(spark, d, "nation").select(F.col("n_nationkey").alias("unit_id"), F.when(F.col("n_regionkey") == 1, "awake").otherwise("sleeping").alias("state"), F.element_at(kinds, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("kind"))
    return topics.communication(units, "pipeline")


# --- counts and sets ------------------------------------------------------------------------------

@query("a1_table_counts", "SELECT 'nodes' AS name, count(*) AS rows FROM part UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'revisions', count(*) FROM orders")
def a1_table_counts(spark, d):
    return records.table_counts({"nodes": read(spark, d, "part"), "edges": read(spark, d, "lineitem"), "revisions": read(spark, d, "orders")})


@query("a4_corpus_size", "SELECT count(*) AS rows, count(DISTINCT conv_id) AS groups FROM conversations")
def a4_corpus_size(spark, d):
    return records.corpus_size(read(spark, d, "conversations"), "conv_id")


@query("a7_exclusions", "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY event_type")
def a7_exclusions(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("reason"), F.col("event_id").cast("string").alias("node"), F.lit("x").alias("text"))
    return records.compact_plan(rows, rows)[1]


def _batches(spark, d):
    """Events of a user as one journal event: views create, clicks update, others remove nodes."""
    e, s = read(spark, d, "events"), F.col("event_id").cast("string")
    def some(ok):
        return F.nullif(F.array_compact(F.collect_list(F.when(ok, s))), F.array().cast("array<string>"))
    return e.groupBy(F.col("user_id").alias("sequence")).agg(some(F.col("event_type") == "view").alias("created_nodes"), some(F.col("event_type") == "click").alias("updated_nodes"), some(F.col("event_type") == "purchase").alias("removed_nodes"))


@query("a20_change_counts", """
SELECT user_id AS sequence, count(*) FILTER (event_type = 'view')::INT AS created_nodes, count(*) FILTER (event_type = 'click')::INT AS updated_nodes, count(*) FILTER (event_type = 'purchase')::INT AS removed_nodes,
       count(*) FILTER (event_type IN ('view', 'click', 'purchase'))::INT AS total FROM events GROUP BY user_id""")
def a20_change_counts(spark, d):
    return records.change_counts(_batches(spark, d))


@query("u4_normalised", "SELECT user_id AS sequence, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) FILTER (event_type = 'view'), '') AS created, '' AS updated_edges FROM events GROUP BY user_id")
def u4_normalised(spark, d):
    return records.normalised_delta(_batches(spark, d)).select("sequence", F.array_join("created_nodes", ",").alias("created"), F.array_join("updated_edges", ",").alias("updated_edges"))


@query("u7_missing", """
SELECT user_id, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['click', 'login', 'purchase', 'view']) AS x) WHERE NOT list_contains(list(DISTINCT event_type), x)), '') AS missing,
       (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(list_concat(list(event_type), ['click', 'login'])) AS x)) AS merged FROM events GROUP BY user_id""")
def u7_missing(spark, d):
    sets = read(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("have"))
    wanted = F.array(*map(F.lit, ("view", "click", "purchase", "login")))
    return sets.select("user_id", F.array_join(records.missing(wanted, F.col("have")), ",").alias("missing"), F.array_join(records.merged(F.col("have"), F.array(F.lit("login"), F.lit("click"))), ",").alias("merged"))


@query("p12_visual", "SELECT page_id AS id, url IS NOT NULL AS has_uri FROM pages")
def p12_visual(spark, d):
    rows = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("memory").alias("kind"), F.lit("global").alias("scope"), F.lit("").alias("label"), F.col("url").alias("uri"))
    return records.visual_node(rows).select("id", "has_uri")


@query("p7_scope_filter", "SELECT doc_id, source = 'src1' OR starts_with(source, 'src1/') AS rooted, source = 'src2' AS own FROM documents")
def p7_scope_filter(spark, d):
    path = F.concat(F.lit("/p/"), "source")
    return read(spark, d, "documents").select("doc_id", records.scope_filter(path, "/p/src1/", True, "/p/src2").alias("rooted"), records.scope_filter(path, None, False, "/p/src2").alias("own"))


# --- validators -----------------------------------------------------------------------------------

@query("p17_findings", """
SELECT doc_id, concat_ws(',', CASE WHEN length(trim(text)) > 0 THEN NULL ELSE 'body' END, CASE WHEN lang IN ('en', 'de', 'fr') THEN NULL ELSE 'relation' END, CASE WHEN (doc_id % 13) / 10 <= 1 THEN NULL ELSE 'confidence' END,
       CASE WHEN doc_id % 4 = 0 THEN 'source_refs' END, CASE WHEN doc_id % 3 = 0 THEN 'target_memory_id' END) AS errors FROM documents""")
def p17_findings(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.trim("text").alias("body"), F.col("lang").alias("relation"), (F.col("doc_id") % 13 / 10).alias("confidence"), F.lit("because").alias("rationale"),
                                              F.when(F.col("doc_id") % 4 > 0, F.array("source")).alias("source_refs"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("target_memory_id"))
    return rows.select("doc_id", F.array_join(records.finding_errors(["en", "de", "fr"]), ",").alias("errors"))


@query("p19_corpus_bounds", "SELECT (SELECT count(*) FROM region) AS sets, count(*) AS documents, (SELECT count(*) FROM conversations) AS memories, max(length(text)) AS longest, CASE WHEN max(length(text)) > 100 THEN 'longest' ELSE '' END AS errors FROM documents")
def p19_corpus_bounds(spark, d):
    found = records.corpus_errors(read(spark, d, "region"), read(spark, d, "documents"), read(spark, d, "conversations"), {"sets": 1000, "longest": 100})
    return found.select("sets", "documents", "memories", F.col("longest").cast("bigint").alias("longest"), F.array_join("errors", ",").alias("errors"))


@query("p20_indexed_files", """
SELECT 'missing' AS error, 'c' || c_custkey AS path FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT 'unexpected', 'o' || o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 50 = 0)
UNION ALL SELECT 'duplicate', 'o' || o_custkey FROM orders WHERE o_orderkey % 50 = 0 GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT 'too-long', 'd' || source FROM documents WHERE length(text) > 5000 GROUP BY source""")
def p20_indexed_files(spark, d):
    def path(prefix, c):
        return F.concat(F.lit(prefix), F.col(c).cast("string")).alias("path")
    customers = read(spark, d, "customer")
    done = customers.where("c_custkey % 10 <> 1").select(path("c", "c_custkey")).union(read(spark, d, "orders").where("o_orderkey % 50 = 0").select(path("o", "o_custkey")))
    return records.indexed_file_errors(customers.select(path("c", "c_custkey")), done, read(spark, d, "documents").select(path("d", "source"), "text"), 5000)


# --- deliberation ---------------------------------------------------------------------------------

@query("d4_claim_cards", "SELECT conv_id::VARCHAR AS run, 'claim:' || conv_id || ':' || row_number() OVER w AS id, (row_number() OVER w)::INT AS place, coalesce(nullif(text, ''), 'Unnamed claim ' || row_number() OVER w) AS body FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def d4_claim_cards(spark, d):
    rows = read(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("run"), F.col("turn").alias("pos"), F.col("text").alias("body"), F.array("role").alias("refs"))
    return deliberation.claim_cards(rows).select("run", "id", "place", "body")


@query("f19_find_claim", f"""
WITH c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place, lower({_SQUEEZE.format('text')}) AS b, ['r' || item_id % 30] AS refs, ['t' || item_id % 7] AS targets FROM benchmark),
r AS (SELECT doc_id, doc_id % 50 + 1 AS place, lower({_SQUEEZE.format('text')}) AS b, ['r' || doc_id % 45] AS refs, ['t' || doc_id % 9] AS targets FROM documents),
ct AS (SELECT *, {_CT.format('b')} AS t FROM c), rt AS (SELECT *, {_CT.format('b')} AS t FROM r),
p AS (SELECT doc_id AS row, item_id::VARCHAR AS claim, ct.place, ct.b AS cb, rt.b AS rb, len(list_intersect(ct.t, rt.t)) AS o, least(len(ct.t), len(rt.t)) AS m, ct.targets = rt.targets AS tm, ct.refs = rt.refs AS rm, ct.place = rt.place AS pm,
      sum((ct.refs = rt.refs)::INT) OVER (PARTITION BY doc_id) AS nr FROM ct, rt),
s AS (SELECT row, claim, place, CASE WHEN rb = '' THEN 0 WHEN cb = rb THEN 100 WHEN contains(cb, rb) OR contains(rb, cb) THEN 90 WHEN cb <> '' AND contains(rb, substr(cb, 1, 80)) THEN 80 WHEN m = 0 THEN 0
      WHEN o / m >= 0.6 THEN 70 WHEN o / m >= 0.35 THEN 45 WHEN o / m >= 0.2 THEN 20 ELSE 0 END + 45 * tm::INT + 15 * (rm AND nr = 1)::INT + 8 * pm::INT AS score FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, place) AS n, max(score) OVER (PARTITION BY row) AS top FROM s WHERE score > 0),
u AS (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY row) AS ties FROM t)
SELECT row, claim, score::INT AS score FROM u WHERE n = 1 AND (ties = 1 OR score >= 60)""")
def f19_find_claim(spark, d):
    run = F.lit(0).alias("run")
    tag = (lambda name, c, n: F.array(F.concat(F.lit(name), (F.col(c) % n).cast("string"))))
    items = read(spark, d, "benchmark").select(run, F.col("item_id").alias("pos"), F.col("text").alias("body"), "item_id", tag("r", "item_id", 30).alias("refs"), tag("t", "item_id", 7).alias("targets"))
    places = deliberation.claim_cards(items.select(F.col("run").cast("string").alias("run"), "pos", F.col("item_id").cast("string").alias("body"), "refs")).select(F.col("body").cast("bigint").alias("item_id"), "place")
    claims = items.join(places, "item_id").select("run", F.col("item_id").cast("string").alias("id"), "place", "body", "refs", "targets")
    rows = read(spark, d, "documents").select(run, F.col("doc_id").alias("id"), (F.col("doc_id") % 50 + 1).cast("int").alias("place"), F.col("text").alias("body"), tag("r", "doc_id", 45).alias("refs"), tag("t", "doc_id", 9).alias("targets"))
    return deliberation.find_claims(claims, rows).select("row", "claim", "score")


@query("h8_first_messages", """
WITH m AS (SELECT conv_id, turn, turn % 3 AS phase FROM conversations WHERE role = 'assistant' AND turn % 4 <> 3)
SELECT conv_id AS run, arg_min(turn, (phase <> 1)::INT * 1000000 + turn) AS pos FROM m GROUP BY conv_id""")
def h8_first_messages(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), F.col("role").alias("step"), (F.col("turn") % 3).cast("string").alias("phase"), F.when(F.col("turn") % 4 == 3, "failed").otherwise("succeeded").alias("status"))
    return deliberation.first_messages(rows, "assistant", "1").select("run", "pos")


@query("h12_complete", "SELECT conv_id AS run, bool_or(role = 'assistant' AND turn % 3 = 1 AND turn % 4 <> 3) AND bool_or(role = 'user' AND turn % 3 = 2 AND turn % 4 <> 3) AS complete FROM conversations GROUP BY conv_id")
def h12_complete(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("role").alias("step"), (F.col("turn") % 3).cast("string").alias("phase"), F.when(F.col("turn") % 4 == 3, "failed").otherwise("succeeded").alias("status"))
    return deliberation.phases_complete(rows, [("assistant", "1"), ("user", "2")])


@query("h13_transcript", f"SELECT conv_id AS run, turn AS pos, CASE WHEN length(s) > 100 THEN rtrim(substr(s, 1, 97)) || '...' ELSE s END AS body FROM (SELECT conv_id, turn, role, {_SQUEEZE.format('text')} AS s FROM conversations) WHERE role IN ('user', 'system')")
def h13_transcript(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), F.col("role").alias("thread"), F.col("role").alias("sender"), F.col("text").alias("body"))
    return deliberation.transcript(rows, ["user", "system"], 100).select("run", "pos", "body")


@query("h15_all_messages", "SELECT conv_id AS thread, turn, role FROM conversations")
def h15_all_messages(spark, d):
    threads = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("thread")).agg(F.collect_list(F.struct("turn", "role")).alias("messages"))
    return deliberation.all_messages(threads)


@query("w14_moves", "SELECT conv_id AS run, turn AS pos, 'move:' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS move FROM conversations")
def w14_moves(spark, d):
    return deliberation.numbered(read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("pos")))


@query("a9_summary", """
WITH c AS (SELECT o_orderpriority AS run, count(*) AS claims, count(*) FILTER (o_orderstatus = 'F') AS accepted_claims, count(*) FILTER (o_orderstatus = 'O') AS rejected_claims, count(*) FILTER (o_orderstatus = 'P') AS challenged_claims FROM orders GROUP BY ALL),
h AS (SELECT o_orderpriority AS run, count(*) AS challenges, count(*) FILTER (l_linestatus = 'O') AS unresolved_challenges FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL),
t AS (SELECT o_orderpriority AS run, count(*) AS moves FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT run, claims, accepted_claims, rejected_claims, challenged_claims, coalesce(challenges, 0) AS challenges, coalesce(unresolved_challenges, 0) AS unresolved_challenges, coalesce(moves, 0) AS moves FROM c LEFT JOIN h USING (run) LEFT JOIN t USING (run)""")
def a9_summary(spark, d):
    orders = read(spark, d, "orders").withColumn("run", F.col("o_orderpriority"))
    names = F.create_map(*map(F.lit, ("F", "accepted", "O", "rejected", "P", "challenged")))
    lines = read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    challenges = lines.where("l_returnflag = 'R'").select("run", F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"))
    return deliberation.summary(orders.select("run", F.element_at(names, F.col("o_orderstatus")).alias("status")), challenges, lines.select("run"))


@query("d3_artifacts")
def d3_artifacts(spark, d):
    """Conversations as runs: user turns are claims, assistant turns judge them; the claims with what became of them."""
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    talk = read(spark, d, "conversations").where("text is not null")
    part = F.when(F.col("role") == "user", 0).otherwise(t % 4 + 1)
    step = F.element_at(F.array(*map(F.lit, ("claim-scout", "proposal-editor", "memory-cartographer", "evidence-auditor", "decision-synthesizer"))), (part + 1).cast("int"))
    phase = F.element_at(F.array(*map(F.lit, ("candidate-proposal", "typed-proposal", "memory-cartography", "preflight-critique", "proposal-synthesis"))), (part + 1).cast("int"))
    names = F.element_at(F.array(*map(F.lit, ("candidates", "typed", "findings", "findings", "proposals"))), (part + 1).cast("int"))
    messages = talk.select(c.alias("run"), t.alias("pos"), F.concat(F.lit("m"), t.cast("string")).alias("message"), step.alias("step"), phase.alias("phase"), F.lit("succeeded").alias("status"), F.col("role").alias("agent"))
    # each line of a turn is a row
    lines = talk.select("*", F.posexplode(F.split("text", "[.\n]")).alias("index", "line")).where("trim(line) <> ''")
    relation = F.element_at(F.array(*map(F.lit, ("novel", "refinement", "duplicate"))), (F.length("line") % 3 + 1).cast("int"))
    rows = lines.select(c.alias("run"), F.concat(F.lit("m"), t.cast("string")).alias("message"), names.alias("list"), "index", F.trim("line").alias("body"), F.array(F.concat(F.lit("r"), (F.length("line") % 7).cast("string"))).alias("refs"),
                        F.array().cast("array<string>").alias("targets"), F.lit("create").alias("action"), F.lit(0.5).alias("confidence"), relation.alias("relation"), F.lit(None).cast("string").alias("rationale"), F.lit(None).cast("string").alias("reason"))
    return deliberation.artifacts(messages, rows).claims.select("run", "claim", "place", "status", "action", "reason")
