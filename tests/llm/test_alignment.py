"""Cross-tokenizer alignment beside plain loops over tokens."""

import hashlib
import os
import random
from collections import Counter

import pytest

from quillgraph.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="needs the public vocabularies")
SCHEMA = "doc_id bigint, text string, `pairs` string, `row` int, `a.b` int"
TEXTS = [None, "", " ", "a", "Hello world, it's 12345 o'clock", "  two  spaces\n\n and\ttabs ", "naïve café – “quotes” ☃ 𝄞 日本語 テスト", "zero\x00byte", "a ▁ mark",
         "<|endoftext|> is <s> plain </s> <unk> <0x41> text", "don't stop now", "x" * 3000, "word " * 50, "Ünïcödé é ​﻿ end", "\r\n", "tail  "]


def plain():
    """Ids and bytes by the tokenizers' own calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    letters = alignment.byte_alphabet()

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda t: [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, b_bytes(i)) for i in b.encode(t)])


def by_hand(texts):
    a_of, b_of = plain()
    out, held = [], Counter()
    for t in texts:
        x, y = (a_of(t), b_of(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(v for _, v in x) != want or b"".join(v for _, v in y) != want:
            out.append(None)
            continue
        spans = []
        for side in (x, y):
            at, mine = 0, []
            for i, v in side:
                mine.append((at, at + len(v), i))
                at += len(v)
            spans.append(mine)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(p[2]) for p in side if low < p[1] <= c) for side in spans))
            low = c
        held.update(set(links))
        out.append((len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == top[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in out]


def rows_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(df, **options).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("options", [{}, {"piece": 40}, {"frequent": 30}, {"frequent": 0, "piece": 7}])
def test_alignment_equals_plain_loops(spark, options):
    rng = random.Random(3)
    parts = ["the", "und", "été", "don't", "42", "\n", "  ", "x-y", "Zürich,", "ja…", "snow☃man", "</s>", "a\tb"]
    texts = TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    assert rows_of(spark, texts, **options) == by_hand(texts)


def test_alignment_of_test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    texts = [r["text"] and r["text"][:3000] for r in rows]
    assert rows_of(spark, texts, piece=5000) == by_hand(texts)


def test_alignment_odd_rows(spark):
    df = spark.createDataFrame([(None, "one two", "x", 1, 2), (7, "one two", "x", 1, 2), (7, "one two", None, None, None), (8, None, None, None, None)], SCHEMA)
    got = alignment.align(df).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in got) == [("7", 2, 6), ("7", 2, 6), ("8", 0, 0), ("None", 2, 6)]
    assert alignment.align(df.where("false")).count() == 0


def test_cut_is_between_words():
    text = "one  two three\tfour " + "five six" * 3
    parts = alignment.cut(text, 4)
    assert " ".join(parts) == text and len(parts) > 3 and not any(p.startswith(" ") for p in parts[1:])
