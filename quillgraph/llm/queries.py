"""The operators bound to the test tables, one query each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, decontam, knn, lang_id, line_dedup, lm_trie, minhash, mixing, partenum, substring, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that other documents hold too."""
    return substring.repeated_passages(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its source's weight and budget, and how often it is taken."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the predicted language."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(docs.where(_fold(5) != 0))
    out = lang_id.identify(docs.drop("lang"), model)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many fall, and the digest of what stays."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_llm_lines").alias("n_lines"), F.col("_llm_dropped").cast("bigint").alias("n_dropped"),
                      F.sha2("_llm_text", 256).alias("kept_sha256"))


def op6_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its log10 probability under the n-gram model and under the base."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_trie.train_and_score(docs, ~_fold(7).eqNullSafe(2))
    return out.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that fits and the verdict."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shingles, its component and whether it stays."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how likely it is labelled toxic."""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs.where(_fold(5) != 0), labels.where(_fold(5) != 0)))
    return toxicity.score(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest inner products of each query vector."""
    vectors = knn.to_integers(_read(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, F.pmod("vec_id", F.lit(50)) == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how the tokens of two vocabularies lie on each other, and how common the pairs are."""
    return alignment.align(_read(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its cluster, its distance to the centroid, and what the clusters amount to."""
    return centroids.cluster(centroids.to_whole(_read(spark, sf_dir, "embeddings")))


def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shingles and its component of documents at 0.8 and more."""
    return partenum.similar_documents(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_mixing": op2_mixing,
    "op3_lang_id": op3_lang_id,
    "op4_decontam": op4_decontam,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_trie": op6_lm_trie,
    "op7_url_filter": op7_url_filter,
    "op8_minhash": op8_minhash,
    "op9_toxicity": op9_toxicity,
    "op10_knn": op10_knn,
    "op11_alignment": op11_alignment,
    "op12_centroids": op12_centroids,
    "op13_partenum": op13_partenum,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"



def _jaccard_sql(percent: int, more: str) -> str:
    """Components of documents whose sets of shingles are as similar."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x FOR x IN string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= {percent} * (p.n + q.n - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT reach.node, sides.b FROM reach JOIN sides ON reach.other = sides.a),
tops AS (SELECT node, min(other) AS top FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, t.top AS component_id{more}
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN tops t ON t.node = d.doc_id"""


def _lloyd_sql(clusters: int, rounds: int) -> str:
    """The rounds of clustering one after the other, each a pair of tables."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1)::INT AS k, e FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT {clusters})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := (list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e))::BIGINT, k := k)) AS best
  FROM v, c{i} c GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS MATERIALIZED (
  SELECT k, list(m ORDER BY j)::DOUBLE[] AS e FROM (
    SELECT best.k AS k, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE AS m
    FROM (SELECT best, unnest(e)::BIGINT AS x, generate_subscripts(e, 1) AS j FROM v JOIN a{i} USING (r)) GROUP BY best.k, j) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e::BIGINT[], ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.k = best.k"""


ORACLE_SQL: dict[str, str] = {
    "op12_centroids": _lloyd_sql(40, 5),
    "op4_decontam": f"""
WITH split AS (
  SELECT doc_id, [x FOR x IN string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
isplit AS (
  SELECT item_id, [x FOR x IN string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM benchmark),
grams AS (
  SELECT DISTINCT doc_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS p,
         unnest([array_to_string(w[i + 1:i + 5], ' ') FOR i IN range(0, greatest(len(w) - 4, 1))]) AS g
  FROM split WHERE len(w) > 0),
igrams AS (
  SELECT DISTINCT item_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS q,
         unnest([array_to_string(w[i + 1:i + 5], ' ') FOR i IN range(0, greatest(len(w) - 4, 1))]) AS g
  FROM isplit WHERE len(w) > 0),
hits AS (SELECT * FROM grams WHERE g IN (SELECT g FROM igrams)),
wins AS (
  SELECT DISTINCT h.doc_id, h.n, h.p - i.q AS s, i.n AS len FROM hits h JOIN igrams i ON h.g = i.g),
bounds AS (
  SELECT *, greatest(s, 0) AS lo, greatest(least(s + len, n) - 5, 0) AS hi FROM wins),
counts AS (
  SELECT b.doc_id, b.s, b.len, b.hi - b.lo + 1 AS size, h.g, count(*) AS c
  FROM bounds b JOIN hits h ON h.doc_id = b.doc_id AND h.p BETWEEN b.lo AND b.hi GROUP BY ALL),
icounts AS (SELECT item_id, g, count(*) AS ic FROM igrams GROUP BY ALL),
isizes AS (SELECT item_id, count(*) AS isize FROM igrams GROUP BY ALL),
met AS (
  SELECT doc_id, s, len, size, item_id, sum(least(c, ic)) AS shared
  FROM counts JOIN icounts ON counts.g = icounts.g GROUP BY ALL),
found AS (
  SELECT doc_id, met.item_id, s, len, shared::DOUBLE / (size + isize - shared) AS sim
  FROM met JOIN isizes ON met.item_id = isizes.item_id WHERE 100 * shared >= 75 * (size + isize - shared)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, s, len) AS r FROM found)
SELECT doc_id, item_id, s::INT AS start, len::INT AS n_words, sim AS similarity FROM ranked WHERE r = 1""",
    "op7_url_filter": f"""
WITH RECURSIVE split AS (
  SELECT page_id, url, html,
         {_LOWER.format("regexp_extract(coalesce(" + _REST + ", ''), '^[^/?#]*')")} AS host,
         regexp_extract(coalesce({_REST}, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rhost, rpath, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (
  SELECT page_id, rhost || rpath AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS r
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
judged AS (SELECT s.*, f.rule, f.v FROM split s LEFT JOIN fitting f ON s.page_id = f.page_id AND f.r = 1),
links AS (
  SELECT url, regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL)
  UNION
  SELECT url, regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL)),
sides AS (SELECT url AS a, target AS b FROM links WHERE target <> '' UNION SELECT target, url FROM links WHERE target <> ''),
reach AS (
  SELECT DISTINCT a AS node, a AS other FROM sides
  UNION
  SELECT reach.node, sides.b FROM reach JOIN sides ON reach.other = sides.a),
alias AS (SELECT node, min(v) AS cv FROM reach JOIN judged ON judged.url = reach.other WHERE v IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, coalesce(v, cv, 'allow') AS verdict FROM judged LEFT JOIN alias ON judged.url = alias.node""",
    "op10_knn": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op5_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.doc_id, line, pos, (hot.k IS NOT NULL AND keyed.doc_id <> last_doc) AS gone
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op8_minhash": _jaccard_sql(75, ", d.doc_id = t.top AS kept"),
    "op13_partenum": _jaccard_sql(80, ""),
}
