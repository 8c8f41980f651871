"""Language ID (3): interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language, trained on a bounded sample of rows.
The models share sorted arrays of 64-bit n-gram hashes, one per order, with a
column of interpolated log probabilities for each language; a second sorted array
has the contexts' back-off weights.  A position is looked up at the highest order
first and backs off where no language has the n-gram.  The language with the
lowest cross-entropy per character wins.  The score is a softmax whose scale is
calibrated on rows that training left out, and so is the entropy beyond which a
text is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
#: Rows of each language that training uses, and rows for calibration; of all languages together; a text's length up to which shorter ones are not preferred.
ROWS, HELD, TEXTS, LONGEST = 300, 60, 72_000, 20_000
UNKNOWN = "und"
_M = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")
_FLOOR = -14.0


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order, sorted hashes of n-grams
    logs: list[np.ndarray]  # by order, natural logs, a row for each n-gram and a column for each language
    contexts: list[np.ndarray]  # by order, sorted hashes of contexts
    backoff: list[np.ndarray]
    unseen: float
    scale: float = 1.0
    limit: float = np.inf


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _M
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of blanks as one."""
    t = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n = 1 to ``order``; the first n - 1 are missing."""
    out = [_mix(codes + np.uint64(1))]
    for n in range(2, order + 1):
        out.append(_mix(out[-1][:-1] ^ (codes[n - 1:] << np.uint64(1))) + np.uint64(n))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _counts(texts: pd.Series) -> list[pd.DataFrame]:
    """By order: n-gram, its context, the n-gram without its first character, count."""
    parts: list[list[pd.DataFrame]] = [[] for _ in range(ORDER)]
    for t in texts:
        g = _grams(_codes(t), ORDER)
        for n in range(1, ORDER + 1):
            x = g[n - 1]
            if not len(x):
                continue
            f = pd.DataFrame({"g": x, "c": g[n - 2][:-1] if n > 1 else np.zeros(len(x), np.uint64), "s": g[n - 2][1:] if n > 1 else x})
            parts[n - 1].append(f)
    out = []
    for p in parts:
        f = pd.concat(p) if p else pd.DataFrame({"g": [], "c": [], "s": []}, dtype=np.uint64)
        out.append(f.groupby("g", as_index=False).agg(c=("c", "first"), s=("s", "first"), n=("g", "size")))
    return out


def _train_one(texts: pd.Series) -> list[tuple[pd.DataFrame, pd.DataFrame]]:
    """By order: (g, c, s, p) with the interpolated probability's own share p, and (c, b) with the back-off weight."""
    tables, out = _counts(texts), []
    for n in range(ORDER, 0, -1):
        t = tables[n - 1].copy()
        if n < ORDER and len(tables[n]):  # continuation counts: how many characters precede
            k = tables[n].groupby("s").size()
            t["n"] = t["g"].map(k).fillna(0).to_numpy() + (t["g"].map(k).isna().to_numpy())
        ones, twos = (t["n"] == 1).sum(), (t["n"] == 2).sum()
        d = float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.1, 0.9))
        total, kinds = t.groupby("c")["n"].sum(), t.groupby("c").size()
        t["p"] = (t["n"] - d).clip(lower=0) / t["c"].map(total)
        out.append((t[["g", "c", "s", "p"]], pd.DataFrame({"c": total.index.to_numpy(), "b": (d * kinds / total).to_numpy()})))
    return out[::-1]


def train(samples: dict[str, pd.Series]) -> Model:
    """Models of the languages' sample texts, folded into shared arrays."""
    langs = sorted(samples)
    single = [_train_one(samples[x]) for x in langs]
    letters = max([len(s[0][0]) for s in single], default=1) + 1
    model = Model(langs, [], [], [], [], float(np.log(1 / letters)))
    for n in range(ORDER):
        tables = [s[n][0] for s in single]
        every = pd.concat(tables).drop_duplicates("g").sort_values("g") if tables else pd.DataFrame({"g": [], "c": [], "s": []}, dtype=np.uint64)
        keys, ctx, suffix = (every[x].to_numpy(np.uint64) for x in ("g", "c", "s"))
        ctx_keys = np.unique(np.concatenate([s[n][1]["c"].to_numpy(np.uint64) for s in single])) if single else np.empty(0, np.uint64)
        back, own = np.ones((len(ctx_keys), len(langs))), np.zeros((len(keys), len(langs)))
        for i, s in enumerate(single):
            back[np.searchsorted(ctx_keys, s[n][1]["c"].to_numpy(np.uint64)), i] = s[n][1]["b"]
            own[np.searchsorted(keys, s[n][0]["g"].to_numpy(np.uint64)), i] = s[n][0]["p"]
        lower = np.full(own.shape, 1 / letters) if n == 0 else np.exp(model.logs[n - 1][np.searchsorted(model.keys[n - 1], suffix)])
        p = own + back[np.searchsorted(ctx_keys, ctx)] * lower
        model.keys.append(keys)
        model.logs.append(np.maximum(np.log(p), _FLOOR).astype(np.float32))
        model.contexts.append(ctx_keys)
        model.backoff.append(np.log(back).astype(np.float32))
    return model


def entropies(model: Model, texts: list[str]) -> np.ndarray:
    """Cross-entropy per character (nats) of each text under each language."""
    codes = [_codes(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    starts = ends - [len(c) for c in codes]
    grams = _grams(np.concatenate(codes), ORDER)
    place = np.arange(ends[-1])
    depth = np.minimum(place - np.repeat(starts, [len(c) for c in codes]), ORDER - 1)  # characters before, in the same text
    logs = np.zeros((ends[-1], len(model.languages)), np.float32)
    left = place
    for n in range(ORDER - 1, -1, -1):
        try_now = left[depth[left] >= n]
        later = left[depth[left] < n]
        at, hit = _find(model.keys[n], grams[n][try_now - n])
        got = try_now[hit]
        logs[got] += model.logs[n][at[hit]]
        rest = try_now[~hit]
        if n and len(rest):
            at, hit = _find(model.contexts[n], grams[n - 1][rest - n])
            logs[rest[hit]] += model.backoff[n][at[hit]]
        elif len(rest):
            logs[rest] += model.backoff[0][0] + model.unseen if len(model.backoff[0]) else model.unseen
        left = np.concatenate([rest, later]) if n else rest
    return -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / (ends - starts)[:, None]


def _soft(h: np.ndarray, scale: float) -> np.ndarray:
    z = -scale * (h - h.min(1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def calibrate(model: Model, texts: list[str], langs: list[str]) -> Model:
    """Set the scale with the least log loss and the entropy that all but 1 in 1000 right texts stay under."""
    if not texts:
        return model
    h = np.vstack([entropies(model, [t]) for t in texts])
    y = np.array([model.languages.index(x) for x in langs])
    scales = 2.0 ** np.arange(0, 9)
    loss = [-np.log(np.maximum(_soft(h, s)[np.arange(len(y)), y], 1e-12)).mean() for s in scales]
    model.scale = float(scales[int(np.argmin(loss))])
    right = h.argmin(1) == y
    if right.any():
        model.limit = float(np.quantile(h.min(1)[right], 0.999)) * 1.1
    return model


def fit(docs: DataFrame, rows: int = ROWS, held: int = HELD) -> Model:
    """Train on ``rows`` documents of each language and calibrate on ``held`` more.

    Every language is learned.  Rows come in order of a hash of their id, texts over
    ``LONGEST`` characters after the others, the shorter ones first.  Together no more
    than ``TEXTS`` rows are taken, or six of each language if that is more.  Texts
    without letters are no examples.
    """
    good = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    keys = good.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ranked = keys.select("lang", F.greatest(F.length("text"), F.lit(LONGEST)).alias("long"), F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("k"))
    kinds = ranked.select(F.count_distinct("lang")).first()[0]
    if not kinds:
        return train({})
    share = max(min(rows + held, TEXTS // kinds), 6)
    rows, held = rows * share // (rows + held), held * share // (rows + held)
    # each task keeps no more than the first rows of a language before they are dealt by it
    first = Window.partitionBy("lang").orderBy("long", "h", "k")
    chosen = ranked.select("lang", "k", F.row_number().over(first).alias("n")).where(F.col("n") <= share).select(F.col("lang").alias("name"), "k")
    found = keys.select(F.xxhash64("doc_id", "text").alias("k"), "text").join(F.broadcast(chosen), "k").select("name", "k", "text").distinct().toPandas()
    found = found.sort_values(["name", "k"])
    found["i"] = found.groupby("name").cumcount()
    part = found["i"] % (rows // max(held, 1) + 1) == 0 if held else found["i"] < 0
    few = found.groupby("name")["i"].transform("size") < 4
    samples = {n: g["text"] for n, g in found[~part | few].groupby("name")}
    model = train(samples)
    test = found[part & ~few]
    return calibrate(model, list(test["text"]), list(test["name"]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            lang, score, entropy = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            real = [i for i, t in enumerate(texts) if t and model.languages and _LETTER.search(t)]
            while real:
                take, size = 0, 0
                while take < len(real) and (not take or size + len(texts[real[take]]) <= 400_000):
                    size += len(texts[real[take]])
                    take += 1
                now, real = real[:take], real[take:]
                h = entropies(model, [texts[i] for i in now])
                p = _soft(h, model.scale)
                for j, i in enumerate(now):
                    k = int(h[j].argmin())
                    lang[i], score[i], entropy[i] = model.languages[k], p[j, k], float(h[j, k])
            low = pa.array(entropy, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), low, pa.array([e is None or e > model.limit for e in entropy])],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected: one row per row of ``docs``.

    Depends on the text alone.  A null text, or one without letters, is ``und``
    with score 0 and rejected; so is any text if no language was learned.
    ``rejected`` also marks texts that no language explains.  Repeated rows are
    judged alike; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _predict(shared.value)(batches)

    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")
