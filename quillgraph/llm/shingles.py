"""Word shingles as 63-bit hashes, with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
_CACHE = 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE:
            self[word] = h
        return h


def split_words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at runs of blank and TAB to CR."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(27))


def rolling(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A 63-bit hash of each ``width`` consecutive words; one of the whole sequence if it is shorter."""
    n = len(h)
    if not n:
        return h
    take = min(width, n)
    s = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        s = mix((s ^ h[i:n - take + 1 + i]) * _M1)
    return s >> np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles of a text, ascending."""
    return np.unique(rolling(word_hashes(split_words(text), hashes)))


def id_column(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0)


def sketches(k: int):
    """mapInArrow function: (id, text) to (id, n, f1, f2, sketch).

    ``n`` is the number of distinct shingles, ``f1`` and ``f2`` identify the
    set, ``sketch`` has its ``k`` smallest hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ns, f1, f2, flat, ends = [], [], [], [], [0]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes)
                low = s[:k]
                ns.append(len(s))
                f1.append(int(mix(s * _M1).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(mix(s ^ _M2), initial=np.uint64(0)).astype(np.int64)))
                flat.append(low.astype(np.int64))
                ends.append(ends[-1] + len(low))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [id_column(batch), pa.array(ns, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "n", "f1", "f2", "sketch"])

    return run


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, text) to (id, all distinct shingles)."""
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(t.as_py(), hashes).astype(np.int64) for t in batch.column(1)]
        ends = np.cumsum([0, *map(len, found)])
        values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [id_column(batch), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "shingles"])
