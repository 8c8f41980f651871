"""Toxicity (9): compression distance with zstandard dictionaries.

Two dictionaries of one size are trained, one on windows of toxic texts and one on
windows of ordinary ones.  Windows are trained on without the words that many
ordinary texts hold, which would crowd out the rest; for the ordinary side, the
words of another half of the texts.  zstandard chooses the content; of that, what
the other class's texts hold about as often is blanked, since it tells nothing.
Both stand before the same plain content, trained on whole ordinary windows, so
that common prose costs the same under either.  A window of a few words is
compressed with each; the bytes that the toxic dictionary saves are its gain.  A
text's features are its greatest gains; a logistic curve fitted on the labelled
sample turns them into the score, calibrated so that 0.5 is the threshold.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows of each class that training uses, and the characters they may have.
ROWS, CHARS = 2000, 8_000_000
WINDOW, PLAIN, DICTIONARY, SEGMENT, LEVEL = 8, 32_768, 8_192, 16, 3
#: Ordinary texts that hold a word from which on it is left out; bytes of a piece, how many times as often the own class holds it, in one of how many texts.
COMMON, PIECE, TELLING, SHARE = 3, 6, 30, 100
#: How much an ordinary text weighs in the curve, a toxic one 1: most texts are ordinary.
WEIGHT = 2.0
_STRIP = b".,;:!?()[]{}\"'|*#%&$"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _windows(text: str | None) -> list[bytes]:
    """Runs of ``WINDOW`` words, A-Z lower-cased."""
    w = _words(text)
    return [b" " + b" ".join(w[i:i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


class _Pair:
    """The two compressors, and the bytes the toxic one saves on a window."""

    def __init__(self, model: Model):
        self.sides = []
        for content in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, search_log=6, hash_log=14, chain_log=14,
                                                              window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.sides.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """The greatest gain of a window; as logarithms, the sum of gains over three bytes, the number of lesser ones, and of windows, one at least."""
        a, b = (s.compress for s in self.sides)
        top, total, weak = 0, 0, 0
        windows = _windows(text)
        for w in windows:
            gain = len(a(w)) - len(b(w))
            top = gain if gain > top else top
            if gain > 3:
                total += gain
            elif gain > 0:
                weak += 1
        return top, math.log1p(total), math.log1p(weak), math.log1p(max(len(windows), 1))


def _novel(texts: list[str]) -> list[str]:
    """The texts without copies of earlier ones: those that share half of a bottom sketch of word triples."""
    seen, kept = set(), []
    for t in texts:
        w = t.lower().split()
        sketch = sorted({zlib.crc32(" ".join(w[i:i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(len(w) - 2, 1))})[:16]
        if sum(x in seen for x in sketch) * 2 < len(sketch):
            kept.append(t)
        seen.update(sketch)
    return kept


def _common(texts: list[str]) -> set[bytes]:
    """Words that ``COMMON`` texts hold."""
    found = Counter(w for t in texts for w in {x.strip(_STRIP) for x in _words(t)})
    return {w for w, n in found.items() if n >= COMMON}


def _rest(texts: list[str], known: set[bytes]) -> list[bytes]:
    """The texts' windows without known words."""
    out = []
    for t in texts:
        w = _words(t)
        for i in range(0, len(w), WINDOW):
            left = [x for x in w[i:i + WINDOW] if x.strip(_STRIP) not in known]
            if left:
                out.append(b" " + b" ".join(left) + b" ")
    return out


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary trained on ``samples``; the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _pieces(content: bytes) -> np.ndarray:
    """A number for each run of ``PIECE`` bytes."""
    x = np.frombuffer(content, np.uint8).astype(np.uint64)
    h = np.zeros(max(len(x) - PIECE + 1, 0), np.uint64)
    for i in range(PIECE):
        h = (h << np.uint64(8)) | x[i:i + len(h)]
    return h


def _telling(content: bytes, own: list[str], other: list[str]) -> bytes:
    """``content`` with blanks where no piece is ``TELLING`` times as frequent in texts of its own class."""
    pieces, at = np.unique(_pieces(content), return_inverse=True)

    def spread(texts: list[str]) -> np.ndarray:
        return sum((np.isin(pieces, _pieces(b" " + b" ".join(_words(t)) + b" ")) for t in texts), np.zeros(len(pieces), int))
    mine, theirs = spread(own), spread(other)
    good = (mine >= max(2, len(own) / SHARE)) & (mine * max(len(other), 1) >= TELLING * (theirs + 0.1) * max(len(own), 1))
    keep = np.zeros(len(content), bool)
    for i in np.flatnonzero(good[at]):
        keep[i:i + PIECE] = True
    return np.where(keep, np.frombuffer(content, np.uint8), 0).astype(np.uint8).tobytes()


def fit(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Train on (text, label) rows."""
    rows = sorted({(t or "", int(y)) for t, y in rows})
    toxic, ordinary = [_novel([t for t, y in rows if bool(y) == side]) for side in (True, False)]
    half, others = ordinary[0::2], ordinary[1::2]
    plain = _trained([w for t in half for w in _windows(t)], PLAIN, 64)
    sides = [_telling(_trained(_rest(texts, _common(known)), DICTIONARY, SEGMENT), own, other)
             for texts, known, own, other in ((others, half, ordinary, toxic), (toxic, ordinary, toxic, ordinary))]
    # of one length, so that matches in the plain content lie equally far away under both
    size = max(map(len, sides))
    model = Model(*[bytes(size - len(x)) + x + plain for x in sides], (0.0,) * 5)
    pair = _Pair(model)
    x = np.array([(*pair.features(t), 1.0) for t, _ in rows] or [(0.0, 0.0, 0.0, 0.0, 1.0)])
    y = np.array([y > 0 for _, y in rows] or [0], float)
    c = np.where(y > 0, 1.0, WEIGHT)
    w, size = np.zeros(5), np.array([0.1, 0.1, 0.1, 0.1, 0.01])
    for _ in range(50):  # Newton's method, with a small penalty so that separable classes have a finite fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(size), x.T @ (c * (y - p)) - size * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.ordinary, model.toxic, tuple(map(float, w)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> list[tuple[str, int]]:
    """(text, toxic) of at most ``rows`` labelled documents and ``chars`` characters of each class, in order of a hash of the id.

    A document with several labels counts as toxic if any says so; null labels and
    texts, and texts longer than a hundredth of ``chars``, are no examples, which is
    settled before rows are chosen.  Rows that share an id count each, equal ones once.
    """
    longest = chars // 100
    texts = docs.select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("text")).where(
        F.col("k").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest)).select("k", "text", F.xxhash64("k", "text").alias("t"))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = marks.join(texts.select("k", "t"), "k").groupBy("k", "t").agg(F.max("y").alias("y"))
    some = None
    for y in (False, True):
        part = known.where((F.col("y") > 0) == F.lit(y)).orderBy(F.xxhash64("k"), "k", "t").limit(rows)
        some = part if some is None else some.unionByName(part)
    chosen = texts.join(F.broadcast(some), ["k", "t"]).groupBy("k", "t").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    found, total = [], [0, 0]
    for r in chosen.orderBy(F.xxhash64("k"), "k", "t").toLocalIterator():  # at most ``rows`` of each class
        y = int(r["y"] > 0)
        total[y] += len(r["text"])
        if total[y] <= chars:
            found.append((r["text"], y))
    return found


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, w = _Pair(model), np.array(model.weights)
        for batch in batches:
            x = np.array([(*pair.features(t.as_py()), 1.0) for t in batch.column(batch.num_columns - 1)]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of ``docs``; null and empty texts have no window and score as such.

    Depends on the text alone.  Repeated rows score alike; an empty table gives
    an empty table; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id bigint, score double")


def toxicity_stage(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, all columns as they are.

    Every row is judged by its own text, repeated rows and null ids too; null and empty texts
    score as texts without content do, which is below the threshold.  An empty table gives an empty table.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*cols).alias("_llm_row"), F.col("text").cast("string").alias("_llm_text"))
    out = packed.mapInArrow(_scores(model), T.StructType([packed.schema["_llm_row"], T.StructField("score", T.DoubleType())]))
    return out.where(F.col("score") < threshold).select(*[F.col("_llm_row").getField(c).alias(c) for c in docs.columns])

