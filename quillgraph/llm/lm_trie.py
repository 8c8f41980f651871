"""LM scoring (6): an Elias-Fano trie of n-grams.

Level 1 has the training words' 64-bit hashes in order; a word's rank is its id.
Level n has, for each n-gram of level n - 1 (its context, by rank), the ids of the
words that follow.  Start offsets and ids are monotone sequences (ids by adding
the last sum of the context before) in Elias-Fano form; a smoothed log
probability and a back-off weight take one byte each, on one even scale.  An
n-gram is found by looking for the successor of its id inside its context's range.

Every level is built by Spark from texts that were split and hashed once: tasks
count the n-grams of their texts and send them packed to the shard of their key
(context, word).  Shards hold about equal numbers of tokens; a frequent context is
several shards.  Each shard merges its counts; when all have, the discount of the
order and the sums of split contexts are known, and each writes one file to the
folder that the cluster shares.  Tasks map these files into memory, so they are
never sent anywhere and take no heap.
Probabilities are interpolated with absolute discounting, one discount an order;
the lowest level is add-one over the vocabulary and one unknown word.  No score
depends on how many shards there are.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch

ORDER = 3
#: Tokens for each shard of a level; tokens that a task handles at once.
SHARD, CHUNK = 1_500_000, 500_000
#: Code of contexts that nothing follows.
_EMPTY = 255
_MERGED = "shard int, size bigint, ones bigint, twos bigint, ends array<bigint>, at array<bigint>, part array<double>, file string"
_CODED = "doc_ids array<bigint>, training array<boolean>, sizes array<int>, local binary, hashes binary"
END = np.uint64(0xE5D0F7E7D)
_ONE, _64 = np.uint64(1), np.uint64(64)


# --- arrays in one file, mapped into memory -------------------------------------------------------

def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one block of bytes: header length, header, data at multiples of 8."""
    at, head, body = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (at, a.dtype.str, len(a))
        body.append(a.tobytes() + bytes(-a.nbytes % 8))
        at += len(body[-1])
    h = json.dumps(head).encode()
    h += b" " * (-len(h) % 8)
    return len(h).to_bytes(8, "little") + h + b"".join(body)


def unpack(buffer) -> dict[str, np.ndarray]:
    n = int.from_bytes(bytes(buffer[:8]), "little")
    return {k: np.frombuffer(buffer, np.dtype(d), size, offset=8 + n + at) for k, (at, d, size) in json.loads(bytes(buffer[8:8 + n])).items()}


def save(uri: str, data: bytes) -> None:
    """Write a file whole; a repeated task writes the same again."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    else:
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(data)


def load(uri: str) -> dict[str, np.ndarray]:
    """Map a file into memory; from a store without local paths it is read."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return unpack(np.memmap(path, np.uint8, "r"))
    with fs.open_input_file(path) as f:
        return unpack(np.frombuffer(f.read_buffer(), np.uint8))


# --- Elias-Fano ------------------------------------------------------------------------------------

def ef_encode(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """A monotone sequence: ``l`` low bits packed, high bits in unary, ones and zeros counted every 64 bits."""
    v = values.astype(np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    if bits:
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        part = v & np.uint64((1 << bits) - 1)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, part << shift)
        over = shift + np.uint64(bits) > _64
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (_64 - shift[over]))
    size = n + (top >> bits) + 1
    unary = np.zeros((size + 63) // 64 * 64, np.uint8)
    unary[((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
    high = np.packbits(unary, bitorder="little").view(np.uint64)
    ones = np.zeros(len(high) + 1, np.int64)
    np.cumsum(np.bitwise_count(high), out=ones[1:])
    kind = np.uint32 if size < 2 ** 32 else np.uint64
    return {prefix + "b": np.array([bits, n], np.int64), prefix + "low": low, prefix + "high": high,
            prefix + "ones": ones[:-1].astype(kind), prefix + "zeros": (np.arange(len(high), dtype=np.int64) * 64 - ones[:-1]).astype(kind)}


_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
#: Place of the r-th one of a byte, at 8 * byte + r.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.uint8)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) of 64-bit words: running counts of all bytes at once, then a table."""
    r = r.astype(np.uint64)
    n = word - ((word >> _ONE) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + ((n >> np.uint64(2)) & np.uint64(0x3333333333333333))
    n = ((n + (n >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    reached = ((n | _TOPS) - (r + _ONE) * _BYTES) & _TOPS
    byte = (np.uint64(8) - np.bitwise_count(reached)) << np.uint64(3)
    r -= (n << np.uint64(8)) >> byte & np.uint64(255)
    value = (word >> byte) & np.uint64(255)
    return byte.astype(np.int64) + _IN_BYTE[(value << np.uint64(3)) + r]


class EliasFano:
    def __init__(self, a: dict[str, np.ndarray], prefix: str):
        self.bits, self.n = (int(x) for x in a[prefix + "b"])
        self.low, self.high, self.ones, self.zeros = (a[prefix + x] for x in ("low", "high", "ones", "zeros"))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).view(np.int64), at & np.uint64(63)
        # with what the next word has of a value; nothing is left of that word at shift 0
        v = self.low.take(word) >> shift | self.low.take(word + 1) << _ONE << (np.uint64(63) - shift)
        return v & np.uint64((1 << self.bits) - 1)

    def _places(self, i: np.ndarray) -> np.ndarray:
        """Where the ones of places ``i`` stand."""
        w = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        return w * 64 + _select_in_word(self.high.take(w), i - self.ones.take(w).astype(np.int64))

    def _values(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        return self._values(i, self._places(i)) if len(i) else np.empty(0, np.uint64)

    def with_next(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and at those that follow: mostly the next one of the same word."""
        if not len(i):
            return self[i], self[i]
        place = self._places(i)
        rest = self.high.take(place >> 6) >> (place & 63).view(np.uint64) >> _ONE
        after = place + 1 + np.bitwise_count(~rest & (rest - _ONE))
        far = np.flatnonzero(rest == 0)
        after[far] = self._places(i[far] + 1)
        return self._values(i, place), self._values(i + 1, after)

    def _buckets(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places [lo, hi) of the values whose high part is ``h``."""
        place = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(h)
        z = h[some].view(np.int64) - 1
        w = np.searchsorted(self.zeros, z.astype(self.zeros.dtype), "right") - 1
        place[some] = w * 64 + _select_in_word(~self.high.take(w), z - self.zeros.take(w).astype(np.int64))
        at, lo = place + 1, place + 1 - h.view(np.int64)

        def ones(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How many ones follow in a word, and which of these runs reach its end."""
            p = at & 63
            rest = ~(self.high.take(np.minimum(at >> 6, len(self.high) - 1)) >> p.view(np.uint64))
            n = np.minimum(np.bitwise_count((rest & (~rest + _ONE)) - _ONE), 64 - p)
            return n, np.flatnonzero((p + n == 64) & ((at >> 6) + 1 < len(self.high)))

        # the ones that follow, up to the next zero; in the next words too if this one ends first
        run, live = ones(at)
        while len(live):
            n, on = ones(at[live] + run[live])
            run[live] += n
            live = live[on]
        return lo, lo + run

    def successor(self, wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of each wanted value in [first, last), or -1."""
        h = wanted >> np.uint64(self.bits)
        most = np.uint64(int(self.n and self[np.array([self.n - 1])][0]) >> self.bits)
        out = np.full(len(h), -1, np.int64)
        inside = np.flatnonzero((first < last) & (h <= most))
        a, b = self._buckets(h[inside])
        a, b = np.maximum(a, first[inside]), np.minimum(b, last[inside])
        some = np.flatnonzero(a < b)
        inside, a, b = inside[some], a[some], b[some]
        low = wanted[inside] & np.uint64((1 << self.bits) - 1)
        # down to one candidate each, the first that is not less
        live = np.flatnonzero(b - a > 1)
        while len(live):
            x, y = a[live], b[live]
            mid = (x + y) >> 1
            less = self.lows(mid - 1) < low[live]
            x, y = np.where(less, mid, x), np.where(less, y, mid)
            a[live], b[live] = x, y
            live = live[y - x > 1]
        hit = np.flatnonzero(self.lows(a) == low)
        out[inside[hit]] = a[hit]
        return out


# --- the trie --------------------------------------------------------------------------------------

@dataclass
class Level:
    """Shards of a level: files, ranks at which they start, their first context and the first word of it."""
    files: list[str]
    base: list[int]
    first: list[int]
    word: list[int]
    size: int
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def shard(self, s: int):
        if s not in self._open:
            a = load(self.files[s])
            self._open[s] = (a, EliasFano(a, "p"), EliasFano(a, "i")) if "pb" in a else (a, None, None)
        return self._open[s]

    def _parts(self, keys: np.ndarray, starts: list[int]) -> Iterator[tuple[int, slice]]:
        """The shards of ascending keys."""
        cuts = np.append(np.searchsorted(keys, np.array(starts, np.int64)), len(keys))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            if self.files[s]:
                yield int(s), slice(cuts[s], cuts[s + 1])

    def weights(self, context: np.ndarray) -> np.ndarray:
        """Codes of the back-off weights of ascending contexts."""
        out = np.full(len(context), _EMPTY, np.uint8)
        for s, part in self._parts(context, self.first):
            out[part] = self.shard(s)[0]["b"][context[part] - self.first[s]]
        return out

    def find(self, context: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1 if absent) and code of the probability of n-grams that ascend; absent ones have code 0."""
        rank, code = np.full(len(context), -1, np.int64), np.zeros(len(context), np.uint8)
        for s, part in self._parts(context * words + word, [c * words + w for c, w in zip(self.first, self.word)]):
            a, pointers, ids = self.shard(s)
            of = context[part] - self.first[s]
            new = np.concatenate([[True], of[1:] != of[:-1]])
            local, back = of[new], np.cumsum(new) - 1
            first, last = (x.view(np.int64) for x in pointers.with_next(local))
            offset, full = np.zeros(len(local), np.uint64), first < last
            some = full & (first > 0)
            offset[some] = ids[first[some] - 1] + _ONE
            asked = np.flatnonzero(full[back])
            of = back[asked]
            at = ids.successor(word[part][asked].astype(np.uint64) + offset[of], first[of], last[of])
            hit = at >= 0
            place = asked[hit] + part.start
            rank[place], code[place] = at[hit] + self.base[s], a["q"][at[hit]]
        return rank, code


@dataclass
class Model:
    tokens: int
    words: int
    order: int
    levels: list[Level]

    @property
    def lowest(self) -> float:
        """No probability or weight is lower (log10): the least share of one of all tokens after a discount of 0.9."""
        return math.log10(0.05 / (self.tokens + 1))

    def code(self, log: np.ndarray) -> np.ndarray:
        """The byte nearest to a log10 value; ``_EMPTY`` stands for something else."""
        return np.rint(np.clip(log / self.lowest, 0, 1) * (_EMPTY - 1)).astype(np.uint8)

    def value(self, code: np.ndarray) -> np.ndarray:
        return code * (self.lowest / (_EMPTY - 1))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and training counts of ascending hashes."""
        top = self.levels[0]
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes, np.array(top.first[1:], np.uint64))
        cuts = np.array([0, *cuts, len(hashes)])
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            if not top.files[s]:
                continue
            part = slice(cuts[s], cuts[s + 1])
            a, _, _ = top.shard(int(s))
            at = np.minimum(np.searchsorted(a["h"], hashes[part]), len(a["h"]) - 1)
            hit = a["h"][at] == hashes[part]
            out[part], count[part] = np.where(hit, at + top.base[s], -1), np.where(hit, a["n"][at], 0)
        return out, count

    def base_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.words + 1))


#: Bytes hashed at once; words of more bytes than ``_WORD`` are hashed alone.
_BLOCK, _WORD = 1 << 16, 64
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(_BLOCK + _WORD, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(_BLOCK + _WORD, pow(_BASE, -1, 1 << 64), np.uint64))
#: A fixed random number for each byte.
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words and of its end: of a word a polynomial of its bytes' numbers, from running sums of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    letters = np.frombuffer(data, np.uint8)
    edge = np.ones(len(letters) + 2, bool)
    edge[1:-1] = _IS_BLANK[letters]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    first, last = at[::2], at[1::2]
    out = np.empty(len(first) + 1, np.uint64)
    out[-1] = END
    sums = np.zeros(min(len(letters), _BLOCK + _WORD) + 1, np.uint64)
    for base in range(0, len(letters), _BLOCK):
        some = slice(*np.searchsorted(first, (base, base + _BLOCK)))
        part = letters[base:base + _BLOCK + _WORD]
        np.cumsum(_LETTERS[part] * _POWERS[:len(part)], out=sums[1:len(part) + 1])
        start = first[some] - base
        out[some] = (sums[np.minimum(last[some] - base, len(part))] - sums[start]) * _INVERSES[start]
    size = last - first
    out[:-1] = shingles.mix(shingles.mix(out[:-1] ^ size.view(np.uint64)))
    for i in np.flatnonzero(size > _WORD):
        out[i] = xxhash.xxh64_intdigest(data[first[i]:last[i]])
    return out


def _ranked(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below ``bound``, and the place of each key among them."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys):
        return keys, keys
    if bits + bound.bit_length() > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << bits) | np.arange(len(keys)))  # sorting is faster than ordering
    sorted_, at = both >> bits, both & ((1 << bits) - 1)
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    place = np.empty(len(keys), np.int64)
    place[at] = np.cumsum(new) - 1
    return sorted_[new], place


def _code_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, training, text) to runs of texts: places of their tokens among the run's distinct hashes."""
    press = zstandard.ZstdCompressor(level=1)
    ids, marks, held, size = [], [], [], 0

    def made() -> pa.RecordBatch:
        distinct, local = np.unique(np.concatenate(held), return_inverse=True)
        row = ids, marks, [len(x) for x in held], press.compress(local.astype("<i4").tobytes()), distinct.astype("<u8").tobytes()
        kinds = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["doc_ids", "training", "sizes", "local", "hashes"])

    for batch in batches:
        for i in range(len(batch)):
            ids.append(batch.column(0)[i].as_py())
            marks.append(batch.column(1)[i].as_py())
            held.append(tokens(batch.column(2)[i].as_py()))
            size += len(held[-1])
            if size >= CHUNK:
                yield made()
                ids, marks, held, size = [], [], [], 0
    if held:
        yield made()


def encode(docs: DataFrame, training) -> DataFrame:
    """Runs of texts, with words as places in a list of hashes."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), training.alias("training"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_code_texts, _CODED)


class _Run:
    """A run of texts: local ids of tokens, how many are before each in its text, and the run's distinct hashes."""

    def __init__(self, row: dict, only_training: bool = False):
        sizes, local = np.array(row["sizes"]), np.frombuffer(zstandard.ZstdDecompressor().decompress(row["local"]), "<i4").astype(np.int64)
        if only_training:
            marks = np.array(row["training"], bool)
            local, sizes = local[np.repeat(marks, sizes)], sizes[marks]
        self.sizes, self.local, self.hashes = sizes, local, np.frombuffer(row["hashes"], "<u8")
        self.starts = np.cumsum(sizes) - sizes
        self.before = np.arange(len(local)) - np.repeat(self.starts, sizes)

    def grams(self, place: np.ndarray, distinct: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For n-grams from the ``place`` of each token's (n - 1)-gram: distinct contexts, their words, the tokens they end at, places of those."""
        at = np.flatnonzero(self.before >= n - 1)
        u = len(self.hashes)
        keys, back = _ranked(place[at - 1] * u + self.local[at], distinct * u)
        return keys // u, keys % u, at, back


def _runs(batches: Iterator[pa.RecordBatch], only_training: bool = False) -> Iterator[tuple[dict, _Run]]:
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row, _Run(row, only_training)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, run in _runs(batches, True):
        n = np.bincount(run.local, minlength=len(run.hashes))
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(run.hashes[some].view(np.int64)), pa.array(n[some])], ["h", "n"])


def _shares(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where to start the next level's shards, so that each has about ``SHARD`` of the mass: context and part of its words."""
    whole = mass >= SHARD
    at, part = [np.zeros(1, np.int64)], [np.zeros(1)]
    steps = np.cumsum(np.where(whole, 0, mass)) // SHARD
    at.append(np.flatnonzero(steps[1:] > steps[:-1]) + 1)
    part.append(np.zeros(len(at[-1])))
    for i in np.flatnonzero(whole):
        n = -(-int(mass[i]) // SHARD)
        at.append(np.concatenate([np.full(n, i), [i + 1]]))
        part.append(np.append(np.arange(n) / n, 0.0))
    at, part = np.concatenate(at), np.concatenate(part)
    inside = at < len(mass)
    return at[inside], part[inside]


def _row(s: int, size: int, ones: int, twos: int, ends: list[int], mass: np.ndarray, path: str) -> pa.Table:
    at, part = _shares(mass)
    row = [s], [size], [ones], [twos], [ends], [at], [part], [path]
    kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string()
    return pa.table([pa.array(x, t) for x, t in zip(row, kinds)], names=["shard", "size", "ones", "twos", "ends", "at", "part", "file"])


def _word_shard(root: str):
    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, n = h[order], table.column("n").to_numpy()[order].astype(np.int64)
        path = f"{root}/1-{s}.trie"
        save(path, pack({"h": h, "n": n}))
        return _row(s, len(h), 0, 0, [], np.where(h == END, 0, n), path)

    return run


def _level_of(rows: list, first: list[int], word: list[int]) -> Level:
    found = {r["shard"]: r for r in rows}
    files, base, total = [], [], 0
    for s in range(len(first)):
        files.append(found[s]["file"] if s in found else "")
        base.append(total)
        total += found[s]["size"] if s in found else 0
    return Level(files, base, first, word, total)


def _send(model: Model, n: int, starts: list[tuple[int, int]]):
    """mapInArrow function: runs to the packed counts of their n-grams, by shard, with the codes of their last n - 1 words."""
    first = [c for c, _ in starts]
    keys = np.array([c * model.words + w for c, w in starts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for _, r in _runs(batches, True):
            ids, _ = model.ids(r.hashes)
            place, distinct, rank, code = r.local, len(ids), ids, np.zeros(len(ids), np.uint8)
            for m in range(2, n + 1):
                ctx, word, at, back = r.grams(place, distinct, m)
                if m < n:
                    rank, code = model.levels[m - 1].find(rank[ctx], ids[word], model.words)
                    place, distinct = np.zeros(len(r.local), np.int64), len(ctx)
                    place[at] = back
            count = np.bincount(back, minlength=len(ctx))
            lower = np.zeros(len(ctx), np.uint8)
            if n > 2:
                lower[back] = code[place[at]]
            key = rank[ctx] * model.words + ids[word]
            cuts = np.append(np.searchsorted(key, keys), len(key))
            out_s, out_n, out_b = [], [], []
            for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
                part = slice(cuts[s], cuts[s + 1])
                c = (rank[ctx[part]] - first[s]).astype(np.uint32)
                data = np.concatenate([np.diff(c, prepend=np.uint32(0)), ids[word[part]].astype(np.uint32), count[part].astype(np.uint32)])
                out_s.append(s)
                out_n.append(len(c))
                out_b.append(press.compress(data.tobytes() + lower[part].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out_s, pa.int32()), pa.array(out_n, pa.int64()), pa.array(out_b, pa.binary())], ["shard", "size", "data"])

    return run


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context and word), counts and codes."""
    data = zstandard.ZstdDecompressor().decompress(data)
    size = len(data) // 13
    ctx, word, count = np.frombuffer(data, np.uint32, 3 * size).reshape(3, -1)
    return np.cumsum(ctx, dtype=np.uint64) << np.uint64(32) | word, count, np.frombuffer(data, np.uint8, size, 12 * size)


def _merge_shard(n: int, root: str):
    """applyInArrow function: a shard's packed counts to one sorted table of them, and what the whole level must know of it."""

    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        column, size = table.column("data"), table.column("size").to_numpy()
        ends = np.cumsum(size)
        key, c, q = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32), np.empty(ends[-1], np.uint8)
        for i, end in enumerate(ends):
            part = slice(end - size[i], end)
            key[part], c[part], q[part] = _unpacked(column[i].as_py())
        order = np.argsort(key, kind="stable")  # merges sorted parts
        key, c, q = key[order], c[order], q[order]
        del order
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, c, q = key[new], np.add.reduceat(c, new, dtype=np.int64), q[new]
        path = f"{root}/{n}-{s}.counts"
        ctx = (key >> np.uint64(32)).astype(np.uint32)
        columns = np.diff(ctx, prepend=np.uint32(0)).tobytes(), key.astype(np.uint32).tobytes(), c.tobytes(), q.tobytes()
        press = zstandard.ZstdCompressor(level=1)
        save(path, pack({str(i): np.frombuffer(press.compress(x), np.uint8) for i, x in enumerate(columns)}))
        head, tail = ctx == ctx[0], ctx == ctx[-1]
        ends = [int(x) for x in (ctx[0], head.sum(), c[head].sum(), ctx[-1], tail.sum(), c[tail].sum())]
        return _row(s, len(key), int((c == 1).sum()), int((c == 2).sum()), ends, c, path)

    return run


def _build_shard(model: Model, n: int, discount: float, files: list[str], contexts: list[int], sums: dict[int, dict[int, tuple[int, int]]], root: str):
    """mapInArrow function: shard numbers to their files, from merged counts."""

    def build(s: int) -> None:
        packed, open_ = load(files[s]), zstandard.ZstdDecompressor()
        ctx, word, c, q = (np.frombuffer(open_.decompress(packed[str(i)].tobytes()), t) for i, t in enumerate((np.uint32, np.uint32, np.int64, np.uint8)))
        ctx, word, per = np.cumsum(ctx, dtype=np.int64), word.astype(np.int64), contexts[s]
        total, kinds = np.bincount(ctx, c, per), np.bincount(ctx, minlength=per)
        for i, (k, t) in sums.get(s, {}).items():
            kinds[i], total[i] = k, t
        span = kinds > 0
        back = np.where(span, discount * kinds / np.maximum(total, 1), 1.0)
        if n == 2:
            top = model.levels[0]
            shard, counts = np.searchsorted(top.base, word, "right") - 1, np.zeros(len(word), np.int64)
            for t in np.unique(shard):  # of shards that start alike the last has the words
                some = shard == t
                counts[some] = top.shard(int(t))[0]["n"][word[some] - top.base[t]]
            lower = model.base_log(counts)
        else:
            lower = model.value(q)
        p = np.log10((c - discount) / total[ctx] + back[ctx] * 10.0 ** lower)
        starts = np.searchsorted(ctx, np.arange(per + 1))
        full = starts[1:] > starts[:-1]
        last = np.where(full, word[np.maximum(starts[1:] - 1, 0)], 0)
        offset = np.concatenate([[0], np.cumsum(np.where(full, last + 1, 0))[:-1]]).astype(np.int64)  # one more, so that contexts never touch
        codes = np.where(span, model.code(np.log10(np.maximum(back, 1e-300))), _EMPTY).astype(np.uint8)
        save(f"{root}/{n}-{s}.trie", pack({**ef_encode(starts, "p"), **ef_encode(word + offset[ctx], "i"), "q": model.code(p), "b": codes}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                build(s)
            yield batch

    return run


def vocabulary(coded: DataFrame, scratch: Scratch) -> tuple[Model, str, list[tuple[int, float]]]:
    """The first level, from the training texts of ``coded``; where the files lie; where shards of the next level start."""
    root = scratch.root if ":" in scratch.root else f"file://{scratch.root}"
    words = scratch.table(coded.mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    n_words, n_tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (n_words * 8 // SHARD).bit_length())
    top = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    made = words.select("h", "n", top.alias("shard")).groupBy("shard").applyInArrow(_word_shard(root), _MERGED)
    rows = scratch.table(made).collect()  # a row for each shard
    level = _level_of(rows, [s << (64 - bits) for s in range(1 << bits)], [0] * (1 << bits))
    return Model(n_tokens, n_words, 1, [level]), root, _starts(rows, level)


def _starts(rows: list, level: Level) -> list[tuple[int, float]]:
    return sorted({(level.base[r["shard"]] + i, p) for r in rows for i, p in zip(r["at"], r["part"])})


def grow(model: Model, coded: DataFrame, root: str, starts: list[tuple[int, float]], scratch: Scratch, order: int) -> Model:
    """Add the levels up to ``order``; raises OverflowError where a level's keys do not fit."""
    spark = coded.sparkSession
    for n in range(2, order + 1 if model.tokens else 0):
        size = model.levels[-1].size
        if (size + 1) * model.words >= 2 ** 63 or model.words >= 2 ** 32:
            raise OverflowError(f"{size} contexts and {model.words} words are too many for keys of 64 bits")
        at = [(c, int(p * model.words)) for c, p in starts]
        sent = coded.select("training", "sizes", "local", "hashes").mapInArrow(_send(model, n, at), "shard int, size bigint, data binary")
        rows = scratch.table(sent.groupBy("shard").applyInArrow(_merge_shard(n, root), _MERGED)).collect()
        rows = [r.asDict() for r in sorted(rows, key=lambda r: r["shard"])]  # without those that got nothing: the one before covers their keys
        at = [at[r["shard"]] for r in rows]
        first = [c for c, _ in at]
        ones, twos = sum(r["ones"] for r in rows), sum(r["twos"] for r in rows)
        discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5
        # contexts in several shards, the only ones that a shard can't sum alone
        sums: dict[int, list] = {}
        for s, r in enumerate(rows):
            for c, local, k, t in {(first[s] + r["ends"][i], *r["ends"][i:i + 3]) for i in (0, 3)}:
                sums.setdefault(c, []).append((s, local, k, t))
        split: dict[int, dict[int, tuple[int, int]]] = {}
        for parts in sums.values():
            if len(parts) > 1:
                for s, local, _, _ in parts:
                    split.setdefault(s, {})[local] = sum(p[2] for p in parts), sum(p[3] for p in parts)
        ends = [first[s + 1] + (at[s + 1][1] > 0) for s in range(len(at) - 1)] + [size]
        files = [r["file"] for r in rows]
        build = _build_shard(model, n, discount, files, [max(e - c, 1) for e, c in zip(ends, first)], split, root)
        shards = spark.createDataFrame([(s,) for s in range(len(rows))], "shard int").repartition(max(len(rows), 1))
        shards.mapInArrow(build, "shard int").write.format("noop").mode("overwrite").save()
        for s, r in enumerate(rows):
            r.update(shard=s, file=f"{root}/{n}-{s}.trie")
        level = _level_of(rows, first, [w for _, w in at])
        for f in files:
            scratch.drop(f)
        starts = _starts(rows, level)
        model.levels.append(level)
        model.order = n
    return model


def score_run(model: Model, run: _Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log10 probability of each text of a run, its known tokens and its base score."""
    ids, count = model.ids(run.hashes)
    plain = model.base_log(count)
    total, place, distinct, rank = plain[run.local], run.local, len(ids), ids
    for n in range(2, model.order + 1):
        level = model.levels[n - 1]
        ctx, word, at, back = run.grams(place, distinct, n)
        weight = np.zeros(len(rank))  # of contexts without successors, and unknown ones: 1
        known = np.flatnonzero(rank >= 0)
        code = level.weights(rank[known])
        weight[known] = np.where(code == _EMPTY, 0.0, model.value(code))
        found, code = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx), np.uint8)
        ok = np.flatnonzero((rank[ctx] >= 0) & (ids[word] >= 0))
        found[ok], code[ok] = level.find(rank[ctx[ok]], ids[word[ok]], model.words)
        total[at] = np.where(found >= 0, model.value(code), weight[ctx])[back] + np.where(found >= 0, 0.0, 1.0)[back] * total[at]
        place, distinct, rank = np.zeros(len(run.local), np.int64), len(ctx), found
        place[at] = back
    return tuple(np.add.reduceat(x, run.starts) for x in (total, (count > 0).astype(np.int64)[run.local], plain[run.local]))


def score_coded(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, r in _runs(batches):
            total, known, base = score_run(model, r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["training"], pa.bool_()), pa.array(r.sizes.astype(np.int64)), pa.array(known),
                 pa.array([model.tokens] * len(known), pa.int64()), pa.array(base), pa.array(total)],
                ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(
        run, "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count every n-gram of every text of ``docs`` and build the trie.

    A null text is empty: one end.  Repeated rows count each.  Without rows all
    words are unknown.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    coded = scratch.table(encode(docs.select(F.lit(None).alias("doc_id"), "text"), F.lit(True)))
    model, root, starts = vocabulary(coded, scratch)
    return grow(model, coded, root, starts, scratch, order)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Null and empty texts have one token, the end.  Repeated rows score alike;
    other columns are ignored; an empty table gives an empty table.
    """
    return score_coded(encode(docs, F.lit(False)), model).drop("training")


def train_and_score(docs: DataFrame, training, order: int = ORDER) -> DataFrame:
    """Train on the rows where ``training`` holds and score all rows, which are encoded but once.

    The columns of ``score``, and ``training``.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    coded = scratch.table(encode(docs, F.coalesce(training, F.lit(False))))
    model, root, starts = vocabulary(coded, scratch)
    return score_coded(coded, grow(model, coded, root, starts, scratch, order))
