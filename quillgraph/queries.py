"""The engine's queries on the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identity, text
from .operators import checks, evaluation, folds, graph, journal, linkage, search, sync, walk
from .plans import responsibility
from .sources import sessions
from .sources.written import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
REQUEST = "the failure of these modules and their nterti shwhea"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL."""
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nodes: the source is the label, the language the metadata."""
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"), F.lit("memory").alias("kind"), F.lit("global").alias("scope"),
                                              F.lit(None).cast("string").alias("project"), F.col("source").alias("label"), F.col("text").alias("content"), F.col("lang").alias("metadata"))


_STOP = ", ".join(f"'{w}'" for w in text.SEARCH_STOP_WORDS)
_PLAN_STOP = ", ".join(f"'{w}'" for w in text.PLAN_STOP_WORDS)
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TOKENS = "list_sort(list_distinct([t FOR t IN regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_-]+') IF length(t) >= {1} AND t NOT IN ({2})]))"
_PHASE = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{n}'" for n, p in text.PHASES) + " ELSE 'continuation' END"


# --- scalar functions ----------------------------------------------------------------------------

@query("f1_compact", f"SELECT doc_id, CASE WHEN length(s) > 200 THEN rtrim(substr(s, 1, 197)) || '...' ELSE s END AS body, length(s) > 200 AS truncated, length(text)::BIGINT AS char_count FROM (SELECT doc_id, text, {_SQUEEZE.format('text')} AS s FROM documents)")
def f1_compact(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", text.compact(t, 200).alias("body"), (F.length(text.squeeze(t)) > 200).alias("truncated"), F.length(t).cast("bigint").alias("char_count"))


@query("f3_identity", "SELECT doc_id, 'graph-node:' || substr(sha256('documents' || chr(0) || doc_id || chr(0)), 1, 24) AS node_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g') || chr(0)) AS content_hash FROM documents")
def f3_identity(spark, d):
    return read(spark, d, "documents").select("doc_id", identity.node_id(F.lit("documents"), F.col("doc_id")).alias("node_id"), identity.content_hash(F.col("text")).alias("content_hash"))


@query("f5_tokens", f"SELECT doc_id, len({_TOKENS.format('text', 2, _PLAN_STOP)})::BIGINT AS plan_tokens, len({_TOKENS.format('text', 3, _STOP)})::BIGINT AS claim_tokens, {_TOKENS.format('text', 2, _PLAN_STOP)}[1] AS first_token FROM documents")
def f5_tokens(spark, d):
    t = F.col("text")
    two = text.tokens(t)
    return read(spark, d, "documents").select("doc_id", F.size(two).cast("bigint").alias("plan_tokens"), F.size(text.tokens(t, 3, text.SEARCH_STOP_WORDS)).cast("bigint").alias("claim_tokens"), F.get(two, F.lit(0)).alias("first_token"))


@query("f11_phase", f"SELECT conv_id, turn, {_PHASE.format('text')} AS phase, regexp_matches(text, '(?i){text.NEGATIVE}') AS negative, regexp_matches(text, '(?i){text.HIGH_IMPACT}') AS high_impact, regexp_matches(text, '(?i){text.FAILURE}') AS failed FROM conversations")
def f11_phase(spark, d):
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", text.phase(t).alias("phase"), text.is_negative(t).alias("negative"), text.is_high_impact(t).alias("high_impact"), text.tells_failure(t).alias("failed"))


@query("f21_conclusions", f"SELECT source, count(DISTINCT coalesce(lang, '') || chr(0) || lower({_SQUEEZE.format('text')})) AS kinds, count(*) AS n FROM documents GROUP BY source")
def f21_conclusions(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count_distinct(text.conclusion(F.col("lang"), F.col("text"))).alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("f25_estimates", "SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents")
def f25_estimates(spark, d):
    return read(spark, d, "documents").select("doc_id", text.estimated_tokens(F.length("text")).alias("tokens"))


@query("f34_safe_names", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) AS name FROM pages")
def f34_safe_names(spark, d):
    return read(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


# --- sessions -------------------------------------------------------------------------------------

_UNITS = f"""
WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS unit FROM conversations),
u AS (SELECT conv_id, unit, min(turn) AS start_turn, max(turn) AS end_turn, arg_min(text, turn) AS goal, count(*) FILTER (role = 'assistant') AS outcomes FROM n WHERE unit > 0 GROUP BY ALL),
p AS (SELECT *, {_PHASE.format('goal')} AS phase FROM u),
l AS (SELECT *, lag(phase) OVER (PARTITION BY conv_id ORDER BY unit) AS last FROM p)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY unit) - 1)::INT AS ordinal, start_turn, end_turn, phase, outcomes,
       CASE WHEN last <> phase THEN last || '-to-' || phase END AS transition FROM l"""


@query("w1_session_units", _UNITS)
def w1_session_units(spark, d):
    return sessions.turns_to_units(read(spark, d, "conversations"))


@query("a5_unit_counts", "SELECT c.conv_id, count(*) FILTER (role = 'user') AS unit_count, count(DISTINCT role) AS roles FROM conversations c GROUP BY c.conv_id")
def a5_unit_counts(spark, d):
    turns = read(spark, d, "conversations")
    units = sessions.turns_to_units(turns).groupBy("conv_id").agg(F.count(F.lit(1)).alias("unit_count"))
    return turns.groupBy("conv_id").agg(F.count_distinct("role").alias("roles")).join(units, "conv_id", "left").select("conv_id", F.coalesce("unit_count", F.lit(0)).alias("unit_count"), "roles")


# --- search ---------------------------------------------------------------------------------------

def _bm25_sql(terms: list[str], limit: int) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    split = "[t FOR t IN string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+') IF t <> '']"
    parts = " UNION ALL ".join(f"SELECT doc_id, unnest({split.format(c)}) AS term, {w} AS w FROM documents" for c, w in (("source", 6.0), ("text", 2.0), ("lang", 1.0)))
    return f"""
WITH p AS ({parts}), i AS (SELECT doc_id, term, sum(w)::DOUBLE AS freq, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT doc_id, sum(n) AS length FROM i GROUP BY ALL), k AS (SELECT count(*) AS rows FROM documents), m AS (SELECT sum(length) / (SELECT rows FROM k) AS mean FROM l),
h AS (SELECT * FROM i WHERE term IN ({names})), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT h.doc_id, -sum(CASE WHEN ln((rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
       * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM h JOIN f ON h.term = f.term JOIN l ON l.doc_id = h.doc_id, k, m GROUP BY h.doc_id)
SELECT doc_id, score FROM s ORDER BY score, doc_id LIMIT {limit}"""


SEARCH = "the onerre shwhea hand or nterti and src3 eauonc"


@query("x1_bm25_search", _bm25_sql(text.query_tokens(SEARCH), 20))
def x1_bm25_search(spark, d):
    hits = search.search(doc_nodes(spark, d), SEARCH, 20)
    return hits.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "score")


_LEX = " + ".join(f"6 * contains(lower(source), '{t}')::INT + 2 * contains(lower(text), '{t}')::INT + contains(lower(lang), '{t}')::INT" for t in text.query_tokens(SEARCH, text.PLAN_STOP_WORDS))


@query("f9_seeds", f"SELECT doc_id, (({_LEX}) * 100)::INT AS score FROM documents WHERE ({_LEX}) > 0 ORDER BY score DESC, doc_id LIMIT 5")
def f9_seeds(spark, d):
    found = responsibility.seeds(doc_nodes(spark, d), SEARCH, responsibility.Limits())
    return found.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "score")


# --- graph ----------------------------------------------------------------------------------------

_EDGES = """
SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'APPLIES_TO_PROJECT' AS kind FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'DERIVED_FROM' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'SUPPORTS' FROM nation"""


def key_edges(spark: SparkSession, d: str) -> DataFrame:
    """Keys of customers, suppliers, nations and regions as a graph."""
    def part(table: str, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        return read(spark, d, table).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source_node_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target_node_id"), F.lit(kind).alias("kind"))
    every = (part("customer", "c", "c_custkey", "n", "c_nationkey", "APPLIES_TO_PROJECT").unionByName(part("supplier", "s", "s_suppkey", "n", "s_nationkey", "DERIVED_FROM"))
             .unionByName(part("nation", "n", "n_nationkey", "r", "n_regionkey", "SUPPORTS")))
    return every.select(F.concat("source_node_id", F.lit(">"), "target_node_id").alias("id"), "*", F.lit(1.0).alias("confidence"))


@query("g2_adjacency", f"SELECT src || '>' || dst AS id, kind, (SELECT count(*) FROM ({_EDGES}) WHERE src = 'n3' OR dst = 'n3') > 30 AS truncated FROM ({_EDGES}) WHERE src = 'n3' OR dst = 'n3' ORDER BY id LIMIT 30")
def g2_adjacency(spark, d):
    return graph.adjacency(key_edges(spark, d), "n3", limit=30).select("id", "kind", "truncated")


@query("g4_reach", f"""
WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 's1' AS id, 0 AS depth UNION SELECT b.z, w.depth + 1 FROM w JOIN b ON w.id = b.a WHERE w.depth < 4)
SELECT id, min(depth)::INT AS depth FROM w GROUP BY id""")
def g4_reach(spark, d):
    start = spark.createDataFrame([("s1",)], "id string")
    return graph.reach(key_edges(spark, d), start, 4)


@query("t7_snapshot_page", f"WITH e AS ({_EDGES}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), p AS (SELECT id FROM n ORDER BY id LIMIT 1515) SELECT src || '>' || dst AS id, kind FROM e WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p) ORDER BY id LIMIT 50")
def t7_snapshot_page(spark, d):
    e = key_edges(spark, d)
    nodes = e.select(F.col("source_node_id").alias("id")).union(e.select("target_node_id")).distinct()
    return graph.snapshot_page(nodes, e, 1515, 50)[1].select("id", "kind")


@query("j6_unresolved", """
SELECT DISTINCT 'customer' AS a, o_custkey::VARCHAR AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION SELECT 'order', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F'""")
def j6_unresolved(spark, d):
    orders = read(spark, d, "orders")
    edges = orders.select(F.lit("order").alias("source_adapter"), F.col("o_orderkey").cast("string").alias("source_key"), F.lit("customer").alias("target_adapter"), F.col("o_custkey").cast("string").alias("target_key"))
    have = read(spark, d, "customer").where("c_acctbal > 0").select(F.lit("customer").alias("source_adapter"), F.col("c_custkey").cast("string").alias("source_key"))
    nodes = have.union(orders.where("o_orderstatus <> 'F'").select(F.lit("order"), F.col("o_orderkey").cast("string")))
    return sync.unresolved(edges, nodes).select("a", "k")


@query("j7_lookup", "SELECT ref, arg_min(id, rank * 100000 + length(id)) AS id FROM (SELECT n_name AS ref, 'n' || n_nationkey AS id, 1 AS rank FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation) GROUP BY ref")
def j7_lookup(spark, d):
    nodes = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("source_key"))
    wanted = nodes.select(F.col("id").alias("ref")).union(nodes.select("source_key"))
    return graph.lookup(nodes, wanted).select("ref", "id")


@query("u1_both_ways", f"SELECT node, count(*) AS degree FROM (SELECT src AS node, dst AS other FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})) GROUP BY node")
def u1_both_ways(spark, d):
    return graph.both_ways(key_edges(spark, d)).select(F.col("src").alias("node"), "dst").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query("p10_edge_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount >= 0.05")
def p10_edge_filter(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("confidence"))
    return graph.filter_edges(rows, ["A", "R"], 0.05).select("l_orderkey", "l_linenumber")


@query("d11_fixture", """
WITH e AS (SELECT range AS j, range % 1000 AS src, range // 1000 AS lane FROM range(4000)),
s AS (SELECT j, src, (src + [1, 7, 31, 127, 509, 1021, 4093][lane % 7 + 1] + 2 * (lane // 7)) % 1000 AS t FROM e)
SELECT j AS e, src, CASE WHEN t = src THEN (t + 1) % 1000 ELSE t END AS dst, 0.5 + (j % 51) / 100 AS confidence,
       ['DERIVED_FROM', 'OBSERVED_IN_SESSION', 'APPLIES_TO_PROJECT', 'SUPPORTS', 'CONTRADICTS', 'SUPERSEDES', 'DUPLICATES', 'SAME_TOPIC_AS', 'REQUIRES_SKILL'][j % 9 + 1] AS kind FROM s""")
def d11_fixture(spark, d):
    return evaluation.fixture_edges(spark, 1000, 4000).select("e", "src", "dst", "confidence", "kind")


# --- sync and journal -----------------------------------------------------------------------------

@query("j8_diff", """
WITH b AS (SELECT p_partkey AS id, p_name, p_size FROM part WHERE p_partkey % 11 <> 0),
a AS (SELECT p_partkey AS id, p_name, p_size + (p_partkey % 7 = 0)::INT AS p_size FROM part WHERE p_partkey % 13 <> 0)
SELECT 'node' AS entity, CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'removed' ELSE 'updated' END AS op, coalesce(a.id, b.id) AS id
FROM b FULL JOIN a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.p_size <> b.p_size OR a.p_name <> b.p_name""")
def j8_diff(spark, d):
    part = read(spark, d, "part")
    cols = ["id", "p_name", "p_size"]
    before = part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    after = part.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")).alias("p_size"))
    return sync.diff("node", before.select(cols), after.select(cols))


@query("a6_sync_summary", """
WITH c AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'created' WHEN p_partkey % 3 = 1 THEN 'updated' ELSE 'removed' END AS op, CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'edge' END AS entity FROM part)
SELECT count(*) FILTER (entity = 'node' AND op = 'created') AS nodes_created, count(*) FILTER (entity = 'edge' AND op = 'updated') AS edges_updated, count(*) FILTER (entity = 'edge' AND op = 'removed') AS edges_removed FROM c""")
def a6_sync_summary(spark, d):
    op = F.element_at(F.array(F.lit("created"), F.lit("updated"), F.lit("removed")), (F.col("p_partkey") % 3 + 1).cast("int"))
    part = read(spark, d, "part")
    delta = part.select(F.when(F.col("p_partkey") % 2 == 0, "node").otherwise("edge").alias("entity"), op.alias("op"))
    return sync.summary(delta, part).select("nodes_created", "edges_updated", "edges_removed")


_OPS = "SELECT event_id AS sequence, 'node' AS entity, CASE event_type WHEN 'purchase' THEN 'removed' WHEN 'click' THEN 'updated' ELSE 'created' END AS op, user_id AS id FROM events"


def event_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as journal rows: purchases remove a user, clicks update, others create."""
    op = F.when(F.col("event_type") == "purchase", "removed").when(F.col("event_type") == "click", "updated").otherwise("created")
    return read(spark, d, "events").select(F.col("event_id").alias("sequence"), F.lit("node").alias("entity"), op.alias("op"), F.col("user_id").alias("id"))


@query("r3_replay", f"SELECT entity, id, max(sequence) AS sequence, CASE WHEN arg_max(op, sequence) = 'removed' THEN 'removed' ELSE 'upsert' END AS op FROM ({_OPS}) WHERE sequence > 100 GROUP BY ALL")
def r3_replay(spark, d):
    return journal.replay(event_changes(spark, d), 100)


@query("r3_replay_state", f"WITH c AS ({_OPS}) SELECT min(sequence) AS first, max(sequence) AS last, (SELECT count(DISTINCT id) FROM c WHERE sequence > 100) AS nodes, 0::BIGINT AS edges, (SELECT count(DISTINCT id) FROM c WHERE sequence > 100) > 100 AS reset_required FROM c")
def r3_replay_state(spark, d):
    return journal.replay_state(event_changes(spark, d), 100, node_cap=100)


@query("t8_journal_page", "SELECT event_id AS sequence, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def t8_journal_page(spark, d):
    return journal.page(read(spark, d, "events").select(F.col("event_id").alias("sequence"), "user_id"), 500, 100)


@query("t9_retention", "SELECT event_id AS sequence FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000")
def t9_retention(spark, d):
    return journal.retain(read(spark, d, "events").select(F.col("event_id").alias("sequence")))


@query("a2_bounds", "SELECT coalesce(min(event_id), 0) AS first, coalesce(max(event_id), 0) AS last FROM events")
def a2_bounds(spark, d):
    return journal.bounds(read(spark, d, "events").select(F.col("event_id").alias("sequence")))


# --- linkage, routing, checks ----------------------------------------------------------------------

_RUNS = "claims AS (SELECT 0::BIGINT AS run, item_id::VARCHAR AS id, item_id AS place, text AS body FROM benchmark), rws AS (SELECT 0::BIGINT AS run, doc_id AS id, text AS body FROM documents)"


def run_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as claims, with ids as text and their number as place, and documents as rows, all in one run."""
    return (read(spark, d, "benchmark").select(F.lit(0).cast("bigint").alias("run"), F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("place"), F.col("text").alias("body")),
            read(spark, d, "documents").select(F.lit(0).cast("bigint").alias("run"), F.col("doc_id").alias("id"), F.col("text").alias("body")))


_CT = "list_distinct([t FOR t IN string_split_regex({}, '[^a-z0-9:_/-]+') IF length(t) >= 4])"


@query("j15_claim_linkage", f"""
WITH {_RUNS}, c AS (SELECT run, id, place, lower({_SQUEEZE.format('body')}) AS b FROM claims), r AS (SELECT run, id, lower({_SQUEEZE.format('body')}) AS b FROM rws),
ct AS (SELECT *, {_CT.format('b')} AS t FROM c), rt AS (SELECT *, {_CT.format('b')} AS t FROM r),
p AS (SELECT ct.run, rt.id AS row, ct.id AS claim, ct.place, ct.b AS cb, rt.b AS rb, len(list_intersect(ct.t, rt.t)) AS o, least(len(ct.t), len(rt.t)) AS m FROM ct JOIN rt ON ct.run = rt.run),
s AS (SELECT run, row, claim, place, CASE WHEN rb = '' THEN 0 WHEN cb = rb THEN 100 WHEN contains(cb, rb) OR contains(rb, cb) THEN 90 WHEN cb <> '' AND contains(rb, substr(cb, 1, 80)) THEN 80 WHEN m = 0 THEN 0
       WHEN o / m >= 0.6 THEN 70 WHEN o / m >= 0.35 THEN 45 WHEN o / m >= 0.2 THEN 20 ELSE 0 END AS score FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY run, row ORDER BY score DESC, place) AS n, max(score) OVER (PARTITION BY run, row) AS top FROM s WHERE score > 0),
u AS (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY run, row) AS ties FROM t)
SELECT run, row, claim, score::INT AS score FROM u WHERE n = 1 AND (ties = 1 OR score >= 60)""")
def j15_claim_linkage(spark, d):
    claims, rows = run_sides(spark, d)
    return linkage.best(linkage.match(claims, rows), claims)


@query("j16_material_overlap", f"""
WITH {_RUNS}, c AS (SELECT run, id, {_TOKENS.format('body', 3, _STOP)} AS t FROM claims), r AS (SELECT run, id, {_TOKENS.format('body', 3, _STOP)} AS t FROM rws)
SELECT c.run, c.id AS l, r.id AS r, len(list_intersect(c.t, r.t))::BIGINT AS "both" FROM c JOIN r ON c.run = r.run WHERE len(list_intersect(c.t, r.t)) >= greatest(3, ceil(least(len(c.t), len(r.t)) * 0.3))""")
def j16_material_overlap(spark, d):
    return linkage.material_overlap(*run_sides(spark, d))


@query("j19_unsupported", "SELECT l.doc_id AS id, l.doc_id AS ref FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j19_unsupported(spark, d):
    proposals = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.array("doc_id").alias("refs"))
    return checks.unsupported_refs(proposals, read(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("ref")))


@query("j20_covered_orders", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS members FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))")
def j20_covered_orders(spark, d):
    allowed = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return checks.covered_groups(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey", allowed)


@query("j20_underived", """
WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS action, list_distinct(list(l_suppkey)) AS refs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
t AS (SELECT n_nationkey AS id, action, list(s_suppkey) AS refs FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT DISTINCT o_orderpriority AS action FROM orders WHERE o_orderpriority < '3') GROUP BY ALL)
SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.action = p.action AND len(list_intersect(p.refs, t.refs)) = len(p.refs))""")
def j20_underived(spark, d):
    orders = read(spark, d, "orders")
    p = orders.join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("action")).agg(F.collect_list("l_suppkey").alias("refs"))
    home = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("id")).agg(F.collect_list("s_suppkey").alias("refs"))
    actions = orders.where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("action")).distinct()
    return checks.underived(p, home.join(F.broadcast(actions)))


@query("a8_distribution", "SELECT l_shipdate AS value, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_shipdate")
def a8_distribution(spark, d):
    return checks.distribution(read(spark, d, "lineitem"), "l_shipdate")


@query("a11_usage", "SELECT user_id, CASE WHEN count(*) FILTER (event_id % 97 = 0) = 0 THEN round(sum(value), 4) END AS total FROM events GROUP BY user_id")
def a11_usage(spark, d):
    rows = read(spark, d, "events").select("user_id", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("v"))
    return rows.groupBy("user_id").agg(folds.all_or_nothing("v", "t")).select("user_id", F.round("t", 4).alias("total"))


@query("a14_zero_filled", "SELECT r_name AS kind, count(n_nationkey) FILTER (n_nationkey % 2 = 0 AND r_regionkey > 1) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def a14_zero_filled(spark, d):
    region = read(spark, d, "region")
    rows = read(spark, d, "nation").where("n_nationkey % 2 = 0 and n_regionkey > 1").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return checks.zero_filled(region.select(F.col("r_name").alias("kind")), rows, "r_name")


@query("a15_percentiles", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.95) AS p95, min(l_quantity) AS lowest, max(l_quantity) AS highest FROM lineitem GROUP BY l_returnflag")
def a15_percentiles(spark, d):
    rows = read(spark, d, "lineitem")
    return folds.nearest_rank(rows, "l_quantity", ["l_returnflag"], {"median": 0.5, "p95": 0.95}).join(rows.groupBy("l_returnflag").agg(F.min("l_quantity").alias("lowest"), F.max("l_quantity").alias("highest")), "l_returnflag")


@query("a17_run_audit", f"SELECT source AS run, count(*) AS conclusions, count(*) FILTER (n_chars % 7 = 0 AND n_chars % 3 > 0) AS unsupported, coalesce(sum(CASE WHEN n_chars % 7 > 0 THEN n_chars % 3 ELSE 0 END)::DOUBLE / nullif(sum(n_chars % 3), 0), 1.0) AS citation_validity, (count(*) - count(DISTINCT lang || chr(0) || lower({_SQUEEZE.format('text')})))::DOUBLE / count(*) AS duplicate_rate FROM documents GROUP BY source")
def a17_run_audit(spark, d):
    cited = F.col("n_chars") % 3
    return checks.run_audit(read(spark, d, "documents").select(F.col("source").alias("run"), F.col("lang").alias("action"), F.col("text").alias("body"), cited.alias("cited"), F.when(F.col("n_chars") % 7 > 0, cited).otherwise(0).alias("valid")))


@query("a23_inspect", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def a23_inspect(spark, d):
    return folds.first_per_group(read(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("p6_all_within", "SELECT user_id, bool_and(event_type IN ('view', 'click', 'purchase')) AS admitted, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def p6_all_within(spark, d):
    known = F.col("event_type").isin("view", "click", "purchase")
    path = F.concat(F.when(known, "/w/").otherwise("/w2/"), "event_type")
    sets = read(spark, d, "events").groupBy("user_id").agg(F.collect_set(path).alias("kinds"))
    return sets.select("user_id", text.all_within(F.col("kinds"), F.lit("/w/")).alias("admitted"), F.size("kinds").cast("bigint").alias("kinds"))


# --- windows --------------------------------------------------------------------------------------

@query("w4_budget", "SELECT doc_id, greatest(least(length(text), 20000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0)::BIGINT AS taken FROM documents")
def w4_budget(spark, d):
    return folds.budget(read(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")), F.col("n"), 20000, ["doc_id"], ["source"]).select("doc_id", "taken")


@query("w10_round_robin", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS round FROM documents ORDER BY round, source LIMIT 40")
def w10_round_robin(spark, d):
    return folds.round_robin(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 40)


@query("w11_systematic", """
WITH p AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS k, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS place, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
i AS (SELECT DISTINCT l_returnflag, (range * n) // 100 AS place FROM (SELECT DISTINCT l_returnflag, n FROM p), range(100))
SELECT l_returnflag, k FROM p JOIN i USING (l_returnflag, place)""")
def w11_systematic(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return folds.systematic(rows, "l_returnflag", "k", 100)


@query("w12_canonical", "SELECT conv_id, arg_max(turn, (CASE role WHEN 'assistant' THEN 2 WHEN 'user' THEN 1 ELSE 0 END) * 1000000 + turn) AS turn FROM conversations GROUP BY conv_id")
def w12_canonical(spark, d):
    rank = F.when(F.col("role") == "assistant", 2).when(F.col("role") == "user", 1).otherwise(0)
    return folds.canonical(read(spark, d, "conversations"), ["conv_id"], rank, "turn").select("conv_id", "turn")


@query("t4_recency", "SELECT event_id, user_id FROM events WHERE event_type <> 'view' ORDER BY ts DESC, user_id, event_id LIMIT 50")
def t4_recency(spark, d):
    return search.recent(read(spark, d, "events"), ["ts"], ["user_id", "event_id"], 50, F.col("event_type") != "view").select("event_id", "user_id")


# --- what SQL can't tell --------------------------------------------------------------------------

def key_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The key graph's nodes, with columns that a plan needs, and its edges; every tenth customer is stale."""
    e = key_edges(spark, d)
    ids = e.select(F.col("source_node_id").alias("id")).union(e.select("target_node_id")).distinct()
    age = F.when(F.col("id").rlike("^c[0-9]*0$"), "2020-01-01T00:00:00Z")
    none = F.lit(None).cast("string")
    return ids.select("id", F.lit("memory").alias("kind"), F.lit("global").alias("scope"), none.alias("project"), F.col("id").alias("label"), F.col("id").alias("content"), F.lit("{}").alias("metadata"), age.alias("modified")), e


@query("g6_plan")
def g6_plan(spark, d):
    """A plan over the key graph from one explicit seed: its nodes and edges, and how many were left out for each reason."""
    nodes, e = key_graph(spark, d)
    p = responsibility.build(nodes, e, "", "global", None, "2026-01-01T00:00:00Z", responsibility.Limits(days=365), explicit=["n3"])
    return p.nodes.select(F.lit("node").alias("what"), "id", "depth").unionByName(p.edges.select(F.lit("edge").alias("what"), "id", "depth")).unionByName(
        p.exclusions.groupBy(F.lit("excluded").alias("what"), F.col("reason").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("depth")))


@query("g4_neighbourhood")
def g4_neighbourhood(spark, d):
    """Nodes and edges around a nation within three steps, and what was cut."""
    nodes, e = key_graph(spark, d)
    found = walk.neighbourhood(nodes, e, "n3", 3, 200, 300)
    cut = spark.createDataFrame([(k, int(v)) for k, v in found.truncated.items()], "id string, depth int")
    return found.nodes.select(F.lit("node").alias("what"), "id", "depth").unionByName(found.edges.select(F.lit("edge").alias("what"), "id", F.lit(-1).alias("depth"))).unionByName(
        cut.select(F.lit("truncated").alias("what"), "id", "depth"))


@query("g5_hydrate", f"""
WITH RECURSIVE e AS (SELECT src || '>' || dst AS id, src, dst FROM ({_EDGES})),
s AS (SELECT id, src, dst FROM e UNION SELECT id, dst, src FROM e),
l1 AS (SELECT id, dst, row_number() OVER (ORDER BY id) AS p FROM s WHERE src = 'r1' ORDER BY id LIMIT 12000),
l2 AS (SELECT s.id, s.dst, l1.p, row_number() OVER (ORDER BY l1.p, s.id) AS n FROM s JOIN l1 ON s.src = l1.dst WHERE s.id NOT IN (SELECT id FROM l1)),
x2 AS (SELECT * FROM l2 WHERE n <= 12000 - (SELECT count(*) FROM l1)),
f AS (SELECT dst, min(n) AS n FROM x2 GROUP BY dst),
nn AS (SELECT dst AS id, 2 AS depth FROM f QUALIFY row_number() OVER (ORDER BY n) <= 4000 - 1 - (SELECT count(*) FROM l1))
SELECT 'node' AS what, 'r1' AS id, 0 AS depth UNION ALL SELECT 'node', dst, 1 FROM l1 UNION ALL SELECT 'node', id, depth FROM nn
UNION ALL SELECT 'edge', id, -1 FROM l1 UNION ALL SELECT 'edge', id, -1 FROM x2""")
def g5_hydrate(spark, d):
    """What a plan from one region may need, from a graph laid out in buckets: nodes with their depth, and edges."""
    nodes, e = key_graph(spark, d)
    stored = walk.Adjacency.write(e, folder(spark, "adjacency"), 32)
    found = walk.hydrate(nodes, stored, ["r1"], ["r1"], 2, 4000, 12_000)
    return spark.createDataFrame([("node", *x) for x in found.nodes.items()] + [("edge", x, -1) for x in found.edges], "what string, id string, depth int")
