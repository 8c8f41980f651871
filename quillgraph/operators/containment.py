"""Which texts lie within which others: an equi join on few fingerprints of each, then a look.

A fingerprint is the smallest hash of the short pieces in a window of fixed width.  A text that
lies within another has a window at its head, and one at its tail, whose fingerprint the other has too.
Windows overlap, so a text has far fewer distinct fingerprints than characters; all is one pass of
numpy over Arrow batches, linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import folder, written

#: Fingerprints in a batch.
_CHUNK = 250_000
#: Keys with at most so many characters of outer texts times inner texts compare all their texts; that is a few ten milliseconds a key.
NEAR = 1 << 24
#: Width of a window and of its pieces, by class; an inner text takes the widest that fits in it.
WINDOWS = ((64, 16), (16, 8), (4, 4), (3, 3), (2, 2), (1, 1))
_BASE, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _pieces(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive code points."""
    h, power, have = codes.astype(np.uint64) + np.uint64(1), int(_BASE), 1
    while 2 * have <= size:
        h = h[:len(h) - have] * np.uint64(power) + h[have:]
        power, have = power * power % 2 ** 64, 2 * have
    for _ in range(have, size):
        h = h[:-1] * _BASE + codes[len(codes) - len(h) + 1:].astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive hashes."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:len(h) - have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h


def fingerprints(codes: np.ndarray, kind: int) -> np.ndarray:
    """The distinct fingerprints of all windows of a class; none if the text is shorter than one."""
    width, size = WINDOWS[kind]
    if len(codes) < width:
        return np.empty(0, np.int64)
    return np.unique(_lowest(_pieces(codes, size), width - size + 1)).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _of_outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (row, text, kinds) to (row, kind, mark)."""
    kept, size = [], 0

    def made() -> pa.RecordBatch:
        rows, kinds, marks = zip(*kept)
        n = [len(m) for m in marks]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), n)), pa.array(np.repeat(np.array(kinds, np.int32), n)), pa.array(np.concatenate(marks))], ["row", "kind", "mark"])

    for batch in batches:
        for i in range(len(batch)):
            codes = _codes(batch.column(1)[i].as_py())
            for kind in batch.column(2)[i].as_py():
                kept.append((batch.column(0)[i].as_py(), kind, fingerprints(codes, kind)))
                size += len(kept[-1][2])
                if size >= _CHUNK:
                    yield made()
                    kept, size = [], 0
    if kept:
        yield made()


def _of_inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (row, part) to (row, kind, head, tail)."""
    for batch in batches:
        rows = []
        for row, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind = next(k for k, (width, _) in enumerate(WINDOWS) if len(part) >= width)
            width = WINDOWS[kind][0]
            rows.append((row, kind, *(int(fingerprints(_codes(p), kind)[0]) for p in (part[:width], part[len(part) - width:]))))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["row", "kind", "head", "tail"])


def held(outer: DataFrame, inner: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, outer, inner), each once: inner texts (``part``) that lie within outer ones (``text``) of the same keys.

    Outer rows have keys, ``outer``, ``text``; inner ones keys, ``inner``, ``part``.  Null and empty
    texts hold nothing and lie in nothing.  A pair meets if the outer text has the fingerprints of
    the inner one's head and tail; then the texts are compared.  Keys with little text (``NEAR``) compare all of theirs,
    which costs less than fingerprints.  What is read several times is written once.
    """
    root = folder(outer.sparkSession, "containment")
    out = outer.where("text <> ''").select(*keys, "outer", "text", F.xxhash64(*keys, "outer", "text").alias("row"))
    part = inner.where("part <> ''").select(*keys, "inner", "part", F.xxhash64(*keys, "inner", "part").alias("row"))
    # a text that is longer than all of its keys' outer ones lies in none
    longest = out.groupBy(*keys).agg(F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars"))
    part = part.join(longest, list(keys)).where(F.length("part") <= F.col("longest")).drop("longest")
    near = part.groupBy(*keys, "chars").agg((F.count(F.lit(1)) * F.col("chars") <= NEAR).alias("near")).drop("chars")
    near, part = written(near, root), part.drop("chars")
    small = near.where("near").drop("near")
    close = out.join(small, list(keys)).join(part.select(*keys, "inner", "part"), list(keys)).where(F.contains("text", "part")).select(*keys, "outer", "inner").distinct()
    wide = near.where("not near").drop("near")
    if wide.isEmpty():
        return close
    out, part = (df.join(wide, list(keys), "left_semi") for df in (out, part))
    marks = part.select(*keys, "row", "part").distinct()
    ends = marks.select(*keys, F.col("row").alias("at")).join(marks.select("row", "part").distinct().mapInArrow(_of_inner, "row bigint, kind int, head bigint, tail bigint"), F.col("at") == F.col("row")).drop("at")
    ends = written(ends, root)
    # only the windows that some inner text of the same keys needs; at most one row a class for each of the keys
    kinds = ends.groupBy(*keys).agg(F.collect_set("kind").alias("kinds"))
    seen = out.join(kinds, list(keys)).select("row", "text", "kinds").distinct().mapInArrow(_of_outer, "row bigint, kind int, mark bigint")
    # marks that no inner text begins or ends with go before they meet any key
    wanted = ends.select("kind", F.explode(F.array("head", "tail")).alias("mark")).distinct()
    seen = seen.join(wanted, ["kind", "mark"], "left_semi")
    named = written(out.select(*keys, F.col("row").alias("o")).distinct().join(seen, F.col("o") == F.col("row")).select(*keys, "o", "kind", "mark"), root)

    def meet(end: Column) -> DataFrame:
        return named.join(ends.select(*keys, "kind", F.col("row").alias("i"), end.alias("mark")), [*keys, "kind", "mark"]).select("o", "i").distinct()

    both = meet(F.col("head")).join(meet(F.col("tail")), ["o", "i"])
    texts = both.join(out, F.col("o") == F.col("row")).select("o", "i", *keys, "outer", "text")
    met = texts.join(part.select(F.col("row"), "inner", "part"), F.col("i") == F.col("row"))
    return met.where(F.contains("text", "part")).select(*keys, "outer", "inner").distinct().unionByName(close)
