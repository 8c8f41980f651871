"""The corpus operators on small tables: brute force, round trips, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import decontam, knn, lang_id, line_dedup, lm_trie, minhash, mixing, queries, substring, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `_llm_key` string, `a.b` int"


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, clashing columns."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [(1, base), (2, base), (3, None), (4, ""), (5, " \n "), (6, prose(rng, 30_000)), (7, base + " tail"), (8, "one two"), (8, "one two"), (None, base), (9, "x " * 300), (10, "\n".join(["a line that is surely longer than forty characters"] * 3)), (None, None)]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", None, 0.5, "k", k) for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_finds_planted_passages(spark):
    rng = random.Random(1)
    passage = prose(rng, 60, 10_000)
    rows = [(i, prose(rng, 80, 10_000) + (f" {passage} " if i in (3, 7, 9) else " ") + prose(rng, 80, 10_000)) for i in range(12)]
    near = passage.split()
    near[30] = "changed"
    rows.append((20, prose(rng, 40, 10_000) + " " + " ".join(near * 1) + " " + prose(rng, 40, 10_000)))
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == {3, 7, 9, 20}
    exact = [r for r in got if r["doc_id"] == 7 and r["other_id"] == 3]
    assert exact and exact[0]["n_words"] >= 60 and exact[0]["start_word"] <= 80


def edited_pairs(rng, count):
    """Documents 2k and 2k + 1 hold a passage of 51 words and the same with a word more in its middle."""
    rows = []
    for k in range(count):
        one = prose(rng, 51, 10_000).split()
        two = [*one[:25], "inserted", *one[25:]]
        rows += [(2 * k + s, f"{prose(rng, 80, 10_000)} {' '.join(p)} {prose(rng, 80, 10_000)}") for s, p in enumerate((one, two))]
    return rows


def test_substring_finds_passages_with_an_insertion(spark):
    got = substring.repeated_passages(spark.createDataFrame(edited_pairs(random.Random(11), 60), "doc_id bigint, text string")).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    pairs = sum((2 * k, 2 * k + 1) in found for k in range(60))
    print("pairs found", pairs)
    assert pairs >= 58


def test_substring_goes_on_beyond_a_first_text_that_holds_less(spark):
    rng, rows = random.Random(12), []
    for k in range(40):
        p = prose(rng, 50, 10_000).split()
        rows += [(3 * k + s, f"{prose(rng, 80, 10_000)} {' '.join(p[:49] if s == 0 else p)} {prose(rng, 80, 10_000)}") for s in range(3)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    pairs = sum((3 * k + 1, 3 * k + 2) in found for k in range(40))
    print("pairs found", pairs)
    assert pairs == 40


def test_substring_links_a_text_with_one_that_is_settled(spark):
    """A and B agree, B and C agree, A and C don't: C is still found."""
    rng, rows = random.Random(13), []
    for k in range(20):
        p = prose(rng, 90, 10_000).split()
        rows += [(3 * k + s, f"{prose(rng, 80, 10_000)} {' '.join(x)} {prose(rng, 80, 10_000)}") for s, x in enumerate((p[:55], p, p[30:]))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    assert all((3 * k, 3 * k + 1) in found and (3 * k + 1, 3 * k + 2) in found for k in range(20))


def test_substring_reports_each_passage_of_a_pair(spark):
    rng = random.Random(14)
    p, q, run = prose(rng, 60, 10_000), prose(rng, 70, 10_000), "a b c " * 20
    gap = [prose(rng, 100, 10_000) for _ in range(8)]
    rows = [(1, f"{gap[0]} {p} {gap[1]} {q}"), (2, f"{q} {gap[2]} {p} {gap[3]}"),
            (3, f"{gap[4]} {run} {gap[5]}"), (4, f"{run * 10} {gap[6]} {run}")]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    mine = sorted((r["start_word"], r["n_words"], r["other_start"]) for r in got if r["doc_id"] == 1)
    assert mine == [(100, 60, 170), (260, 70, 0)]
    assert {(r["doc_id"], r["other_id"]) for r in got} >= {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_compare_goes_on_after_a_rejected_stretch():
    rng = np.random.default_rng(15)
    run, tail, gap = rng.integers(0, 1 << 62, 3).astype(np.uint64), rng.integers(0, 1 << 62, 50).astype(np.uint64), rng.integers(0, 1 << 62, 90).astype(np.uint64)
    x = np.concatenate([np.tile(run, 30), gap[:30], tail])
    y = np.concatenate([np.tile(run, 300), gap[30:60], tail, gap[60:]])
    got = substring.compare(x, y, 46, 75)
    assert {(i, j) for i, j, p, q, s in got if s >= 0.75 and j - i >= 46 and q - p >= 46} >= {(120, 170)} and any(j <= 90 for i, j, *_ in got)


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 50, 80).astype(np.uint64)
    seed, least = substring._SEEDS[0], 6
    a, c, b = substring.compact_windows(s, np.array([0, 40]), np.array([40, 80]), seed, least)
    v = substring.shingles.mix(substring.shingles.mix(s ^ seed)) >> np.uint64(32)
    for lo, hi in ((0, 40), (40, 80)):
        for i in range(lo, hi):
            for j in range(i + least, hi + 1):
                low = v[i:j].min()
                assert any(x <= i and y >= j - 1 and i <= k < j and v[k] == low for x, k, y in zip(a, c, b))


def test_substring_odd_rows(odd, none):
    got = {r["doc_id"] for r in substring.repeated_passages(odd).collect()}
    assert got == {1, 2, 7} and substring.repeated_passages(none).count() == 0


def test_mixing_budgets(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(5, 40)), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs).toPandas()
    assert (out.copies >= 1).all() and len(out) == 900
    total = out.assign(t=out.n_tokens * out.copies).groupby("source").agg(t=("t", "sum"), b=("budget", "first"), n=("n_tokens", "sum"), w=("weight", "first"))
    assert (total.t <= total.b).all() and (total.b - total.t < 80).all()
    assert total.t.div(total.n).max() <= mixing.REPEATS + 1e-6 and abs(total.w.sum() - 1) < 1e-9
    half = mixing.mix(docs, budget=int(out.n_tokens.sum() / 2)).toPandas()
    assert abs((half.n_tokens * half.copies).sum() - out.n_tokens.sum() / 2) < 6 * 40
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.mix_stage(odd).columns[:8] == odd.columns and mixing.mix_stage(none).count() == 0


def test_language_held_out(spark, odd, none):
    out = queries.op3_lang_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.9
    model = lang_id.train({"en": __import__("pandas").Series(["the cat and the dog"] * 3), "de": __import__("pandas").Series(["der hund und die katze"] * 3)})
    got = lang_id.identify(odd, model).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (3, 4, 5))
    assert lang_id.identify(none, model).count() == 0 and lang_id.fit(none).languages == []


def test_kneser_ney_sums_to_one():
    import pandas as pd

    model = lang_id.train({"x": pd.Series(["abab abba baab", "aabb"])})
    p = np.exp(model.logs[0][:, 0].astype(float))
    unseen = math.exp(model.backoff[0][0, 0] + model.unseen)
    assert abs(p.sum() + unseen - 1) < 1e-5
    for head in "ab ":
        at, found = lang_id._find(model.contexts[1], lang_id._grams(np.array([ord(head)], np.uint64), 1)[0])
        back, total = math.exp(model.backoff[1][at[0], 0]), 0.0
        assert found[0]
        for ch in "ab ":
            one, two = lang_id._grams(np.array([ord(head), ord(ch)], np.uint64), 2)
            k, hit = lang_id._find(model.keys[1], two)
            low, _ = lang_id._find(model.keys[0], one[1:])
            total += math.exp(model.logs[1][k[0], 0]) if hit[0] else back * p[low[0]]
        assert abs(total + back * unseen - 1) < 1e-5


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    items = [(i, prose(rng, 40, 5000)) for i in range(5)] + [(90, None), (91, ""), (92, "one two")]
    near = items[1][1].split()
    near[20] = "changed"
    docs = [(1, prose(rng, 50, 5000) + " " + items[0][1] + " " + prose(rng, 50, 5000)), (2, " ".join(near)), (3, prose(rng, 100, 5000)), (4, items[2][1][: len(items[2][1]) // 3])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert set(got) == {(1, 0), (2, 1)} and got[1, 0]["start"] == 50 and got[1, 0]["similarity"] == 1.0 and 0.75 <= got[2, 1]["similarity"] < 1
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, bench).collect()] == [(8, 92)]
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.decontam_stage(odd, bench).columns == odd.columns


def test_line_dedup_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd, min_docs=2, min_chars=5).where("doc_id = 8")
    assert [r["_llm_dropped"] for r in out.collect()] == [0, 0]
    assert line_dedup.dedup_stage(odd).count() == odd.count() and line_dedup.dedup_lines(none).count() == 0


def dictionary_scores(train, texts, order=3):
    """Interpolated absolute discounting by plain dictionaries: log10 of each text."""
    seqs = [t.split() + [None] for t in train]
    counts = [Counter(tuple(s[i:i + n]) for s in seqs for i in range(len(s) - n + 1)) for n in range(1, order + 1)]
    total, words = sum(counts[0].values()), len(counts[0])
    cut, heads, kinds = [0.0], [Counter()], [Counter()]
    for c in counts[1:]:
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut.append(min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5)
        heads.append(Counter())
        kinds.append(Counter())
        for g, v in c.items():
            heads[-1][g[:-1]] += v
            kinds[-1][g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (counts[0][g] + 1) / (total + words + 1)
        n, low = len(g) - 1, p(g[1:])
        h = heads[n][g[:-1]]
        return (max(counts[n][g] - cut[n], 0) + cut[n] * kinds[n][g[:-1]] * low) / h if h else low

    out = []
    for t in texts:
        s = t.split() + [None]
        out.append(sum(math.log10(p(tuple(s[max(i - order + 1, 0):i + 1]))) for i in range(len(s))))
    return out, [len(c) for c in counts]


def test_trie_against_dictionaries(spark, odd, none, monkeypatch):
    """Scores of the shipped order, and the same ones with shards so small that frequent contexts are split."""
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 60), 30) + " the" * (i % 5) + (" the w1" if i % 3 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, sizes = dictionary_scores([t for i, t in rows if i < 40], [t for _, t in rows])
    model = lm_trie.train(docs.where("doc_id < 40"))
    assert [x.size for x in model.levels] == sizes and model.order == lm_trie.ORDER == 3
    got = {r["doc_id"]: r for r in lm_trie.score(docs, model).collect()}
    seqs = [t.split() + [None] for i, t in rows if i < 40]
    one = Counter(w for s in seqs for w in s)
    n, v = sum(one.values()), len(one)
    for (i, t), w in zip(rows, want):
        s = t.split() + [None]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in s)
        r = got[i]
        assert r["n_tokens"] == len(s) and r["n_known"] == sum(one[x] > 0 for x in s) and r["train_tokens"] == n and abs(r["base_score"] - base) < 1e-8
        assert abs(r["score"] - w) <= -model.lowest / 508 * 3 * len(s) + 1e-9  # half a step for each of three bytes
    monkeypatch.setattr(lm_trie, "SHARD", 37)
    monkeypatch.setattr(lm_trie, "CHUNK", 150)
    small = lm_trie.train(docs.where("doc_id < 40"))
    assert [x.size for x in small.levels] == sizes and len(small.levels[1].files) > 20
    assert any(a == b for a, b in zip(small.levels[1].first, small.levels[1].first[1:]))
    assert {r["doc_id"]: r["score"] for r in lm_trie.score(docs, small).collect()} == pytest.approx({i: r["score"] for i, r in got.items()}, abs=1e-9)
    assert lm_trie.score(odd, small).count() == odd.count() and lm_trie.score(none, small).count() == 0
    assert lm_trie.score(odd, lm_trie.train(none)).where("n_known = 0").count() == odd.count()


def test_lm_keeps_trigrams_seen_once(spark):
    """The two texts differ in nothing but the trigram that training saw."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "x b d")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lm_trie.score(docs.unionByName(spark.createDataFrame([(3, "x b c")], docs.schema)), lm_trie.train(docs)).collect()}
    assert got[1] > got[3] + 0.05


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1000, 5), (1000, 10 ** 9), (500, 700)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        e = lm_trie.EliasFano(lm_trie.unpack(lm_trie.pack(lm_trie.ef_encode(v, "x"))), "x")
        assert (e[np.arange(n)] == v).all()
        if n:
            at = e.successor(v, np.zeros(n, np.int64), np.full(n, n))
            assert (v[at] == v).all()


def test_url_aliases(spark, none):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [(1, "http://a.net/x", None), (2, "http://good.com/p", link.format("http://a.net/x")), (3, "http://third.com/", link.format("/q")),
            (4, "http://third.com/q", '<meta http-equiv="refresh" content="0; url=http://b.example.net/en/1">'), (5, "http://third.com/q2", link.format("http://a.net/x")), (6, None, None), (7, "no scheme", None), (8, "HTTP://X.ORG/fr/?q#f", None)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    assert got[3]["aliased"] and got[6]["host"] == "" and (got[8]["host"], got[8]["path"], got[8]["rule"]) == ("x.org", "/fr/", "org/fr/")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_near_duplicates_odd_rows(odd, none):
    got = {}
    for r in minhash.near_duplicates(odd).collect():
        got.setdefault(r["doc_id"], r)
    assert got[1]["kept"] and got[2]["component_id"] == 1 and got[7]["component_id"] == 1 and got[3]["kept"] and got[4]["n_shingles"] == 0
    assert minhash.near_duplicates(none).count() == 0 and minhash.near_dedup_stage(odd).columns == odd.columns


def test_toxicity_learns_marks(spark, odd, none):
    rng = random.Random(8)
    rows = [(prose(rng, 60) + (" you utter scoundrel " if i % 2 else " ") + prose(rng, 60), i % 2) for i in range(120)]
    model = toxicity.fit(rows[:80])
    test = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[80:])], "doc_id bigint, text string")
    right = sum((r["score"] >= 0.5) == bool(rows[80 + r["doc_id"]][1]) for r in toxicity.score(test, model).collect())
    assert right >= 38
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(none, model).count() == 0
    assert toxicity.toxicity_stage(odd, model).columns == odd.columns and toxicity.score(odd, toxicity.fit([])).count() == odd.count()


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)).round(2)
    rows = [(i, x[i % 200].tolist()) for i in range(400)] + [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 8), (903, [])]
    v = knn.to_integers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(v, F.col("vec_id") % 50 == 0).collect()}
    ids = [*range(400), 903]
    m = np.vstack([np.floor(256 * np.array([x[i % 200] for i in range(400)])), np.zeros(8)])
    for q in range(0, 400, 50):
        s = sorted(((-int(m[q] @ m[j]), ids[j]) for j in range(401) if ids[j] != q))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -k) for k, i in s]
    assert knn.top_k(v.limit(0), F.lit(True)).count() == 0 and knn.top_k(v.limit(1), F.lit(True)).count() == 0


def test_pipeline_rows(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 50 and out.columns[:5] == spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontam", "mixing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    plain = (lambda df: sorted(tuple("null" if v is None or v != v else f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)))
    assert set(cols) <= set(got.columns) and plain(got) == plain(want)


def test_stages_pass_clashing_columns_through(spark, odd, none):
    names = ("_llm_gone", "_llm_lines", "_llm_kept", "_llm_text", "_llm_block", "_llm_copies", "row", "key", "copies", "doc", "component", "kept")
    wide = odd.select("*", *[F.lit(n).alias(n) for n in names])
    empty = wide.where("false")
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id bigint, text string")
    model = toxicity.fit([])
    for stage in (line_dedup.dedup_stage, minhash.near_dedup_stage, mixing.mix_stage, lambda d: decontam.decontam_stage(d, items), lambda d: toxicity.toxicity_stage(d, model)):
        out = stage(wide)
        assert out.columns[:len(wide.columns)] == wide.columns
        rows = out.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [names]
        assert stage(empty).count() == 0
    assert mixing.mix_stage(wide.withColumn("mix_pass", F.lit("x"))).columns[-3:] == ["mix_pass", "mix_block", "mix_order"]
    assert line_dedup.dedup_lines(wide).where("_llm_lines is null").count() == 0


def test_knn_repeated_ids_and_great_numbers(spark):
    schema = "vec_id bigint, v array<double>"
    rows = [(0, [2.0, 1.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [1.0, 0.0]), (2, [9.0])]
    got = knn.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 18), (1, 6), (1, 2), (1, 2)]
    q, x = np.array([[2.0 ** 31 + 1, 1.0]]), np.array([[2.0 ** 31 - 1, 3.0]])
    assert knn.products(q, x)[0, 0] == (2 ** 31 + 1) * (2 ** 31 - 1) + 3
    with pytest.raises(OverflowError):
        knn.products(q * 2.0 ** 20, x * 2.0 ** 20)


def test_mixing_exponent_against_a_fine_grid(spark):
    tokens = [5, 40, 300, 2500, 60_000]
    p = np.array(tokens) / sum(tokens)
    sources = spark.createDataFrame([(float(t), float(s)) for t, s in zip(tokens, p)], "tokens double, share double")
    for entropy, repeats, budget in ((0.6, 1e9, None), (0.97, 3.0, None), (0.2, 50.0, None), (0.9, 4.0, 60_000)):
        def state(a):
            w = p ** a / (p ** a).sum()
            return -(w * np.log(w)).sum() / np.log(len(p)), (w / p).max() / (w / p).min() if budget is None else budget / sum(tokens) * (w / p).max()
        grid = np.linspace(0, 1, 20_001)
        fits = [a for a in grid if state(a)[1] <= repeats * (1 + 1e-9)]
        least = min(fits) if fits else 1.0
        good = [a for a in grid if a >= least and state(a)[0] >= entropy - 1e-9]
        want = max(good) if good else least
        assert mixing.find_exponent(sources, entropy, repeats, budget) == pytest.approx(want, abs=3e-4)
