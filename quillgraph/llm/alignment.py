"""Cross-tokenizer alignment (11): which tokens of two vocabularies cover the same bytes.

1. A task encodes its texts with both tokenizers, in pieces of bounded length, and lays
   the tokens of many pieces end to end.  Cumulated lengths are byte offsets; those at
   which both sides end are common cuts, and searching them labels the groups.
2. Each token overlaps a run of the other side's tokens.  Repeating it over that run
   makes the links; a text keeps its distinct pairs with their numbers, 4 bytes each.
3. How many texts hold a pair is counted in two shuffles: by pair and a salt, with
   sums of each partition before, then by pair.
4. The most frequent pairs, up to a fixed number, are sent to the tasks, which add up
   what their texts hold of them; the others meet their counts in a join.

Texts are cut only between a character that isn't blank and a single space before another:
no token of either side spans such a place (checked for the second vocabulary, a rule
of the first one's pattern).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, apart

#: Characters of text that are encoded together.
PIECE = 400_000
#: Pairs whose counts are sent to every task: 13 bytes each.
FREQUENT = 1_000_000
SALTS = 32
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What splits a text before merges, fixed by the first vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_INT = np.int64


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Bytes of each id, end to end, and a function from texts to ids."""

    def __init__(self, tokens: list[bytes], encode: Callable[[str], list[int]]):
        self.lengths = np.array([len(t) for t in tokens], _INT)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.encode, self.size = encode, len(tokens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, joined."""
        n = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def byte_level(content: str) -> Vocabulary:
    """A byte-level vocabulary from the content of its JSON file; special tokens in texts are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    data = json.loads(content)
    special = {t["content"] for t in data.get("added_tokens", [])}
    ids, letters = data["model"]["vocab"], byte_alphabet()
    size = 1 + max(ids.values())
    plain = {t: i for t, i in ids.items() if t not in special}
    tokens = [b""] * size
    for t, i in ids.items():
        tokens[i] = bytes(letters[c] for c in t) if t in plain else t.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    # ids in the order of merges are ranks, so the faster encoder gives the same ids
    if [ids[a + b] for a, b in merges] == list(range(256, 256 + len(merges))):
        encoder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for i in plain.values()}, special_tokens={})
        return Vocabulary(tokens, encoder.encode_ordinary)
    whole = Tokenizer.from_str(content)
    whole.encode_special_tokens = True
    return Vocabulary(tokens, lambda text: whole.encode(text, add_special_tokens=False).ids)


def pieces(content: bytes) -> Vocabulary:
    """A vocabulary of pieces from the content of its model file; it puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(_SPACE in name.lstrip(_SPACE) for name in names):
        raise ValueError("a piece of this vocabulary holds a space behind other characters, so texts can't be cut at spaces")
    tokens = [bytes([int(_BYTE.fullmatch(n)[1], 16)]) if model.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]
    return Vocabulary(tokens, model.encode)


def cut(text: str, most: int) -> list[str]:
    """The text in parts of about ``most`` characters; each but the first begins behind the space that ends at a cut."""
    parts, at = [], 0
    while len(text) - at > most:
        hit = _BREAK.search(text, at + most)
        if not hit:
            break
        parts.append(text[at:hit.start()])
        at = hit.end()
    parts.append(text[at:])
    return parts


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. size - 1, right-aligned, and which of them show."""
    width = len(str(max(size - 1, 1)))
    values = np.arange(size)
    digits = np.stack([values // 10 ** (width - 1 - j) % 10 + 48 for j in range(width)], axis=1).astype(np.uint8)
    shown = np.arange(width) >= width - np.array([len(str(v)) for v in values])[:, None]
    return digits, shown


class Aligner:
    """Aligns pieces of text, many at a time."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.digits, self.shown = _decimals(max(a.size, b.size))

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, bytes, np.ndarray, np.ndarray] | None]:
        """Per text: n_a, n_b, n_groups, n_links, the written groups, distinct pairs (a * size of b + b), and how often each is linked.

        None where a side's bytes differ from space and text.
        """
        raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        ids = [[np.fromiter(x, _INT, len(x)) for x in (self.a.encode(" " + t), self.b.encode(t))] for t in texts]
        fits = [self._same(r, x, y) for r, (x, y) in zip(raw, ids)]
        sizes = np.array([len(r) for r, ok in zip(raw, fits) if ok], _INT)
        out: list = [None] * len(texts)
        if not len(sizes):
            return out
        x = np.concatenate([i[0] for i, ok in zip(ids, fits) if ok])
        y = np.concatenate([i[1] for i, ok in zip(ids, fits) if ok])
        bounds = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.a.lengths[x]), np.cumsum(self.b.lengths[y])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # tokens of b that reach beyond the start of a's token, up to the one that reaches its end
        first = np.searchsorted(ends_b, ends_a - self.a.lengths[x], "right")
        count = np.searchsorted(ends_b, ends_a) - first + 1
        left = np.repeat(np.arange(len(x)), count)
        right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        doc_a, doc_b, doc_cut = (np.searchsorted(bounds, e) for e in (ends_a, ends_b, cuts))
        k = len(sizes)
        n_a, n_b, n_groups, n_links = (np.bincount(d, minlength=k) for d in (doc_a, doc_b, doc_cut, doc_a[left]))
        wide = self.a.size * self.b.size
        pairs, times = np.unique(doc_a[left] * wide + x[left] * self.b.size + y[right], return_counts=True)
        at = np.searchsorted(pairs, np.arange(k + 1) * wide)
        text, ends = self._written(x, y, group_a, group_b, doc_a, doc_b, k)
        rows = iter(range(k))
        for i, ok in enumerate(fits):
            if ok:
                d = next(rows)
                out[i] = (int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(n_links[d]), text[ends[d]:ends[d + 1] - 1],
                          pairs[at[d]:at[d + 1]] - d * wide, times[at[d]:at[d + 1]])
        return out

    def _same(self, raw: bytes, x: np.ndarray, y: np.ndarray) -> bool:
        want = np.frombuffer(raw, np.uint8)
        return all(v.lengths[i].sum() == len(want) and bool((v.joined(i) == want).all()) and bool((v.lengths[i] > 0).all()) for v, i in ((self.a, x), (self.b, y)))

    def _written(self, x, y, group_a, group_b, doc_a, doc_b, k: int) -> tuple[bytes, np.ndarray]:
        """The groups of all texts as ``a1,a2|b1;``, end to end, and where each text begins."""
        groups = int(group_a[-1]) + 1
        before_a = np.cumsum(np.bincount(group_a, minlength=groups))
        before_b = np.cumsum(np.bincount(group_b, minlength=groups))
        at_a = np.arange(len(x)) + np.where(group_a > 0, before_b[group_a - 1], 0)
        at_b = np.arange(len(y)) + before_a[group_b]
        ids, mark = np.empty(len(x) + len(y), _INT), np.full(len(x) + len(y), ord(","), np.uint8)
        ids[at_a], ids[at_b] = x, y
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        cells = np.hstack([self.digits[ids], mark[:, None]])
        shown = np.hstack([self.shown[ids], np.ones((len(ids), 1), bool)])
        width = shown.sum(1)
        doc = np.empty(len(ids), _INT)
        doc[at_a], doc[at_b] = doc_a, doc_b
        return cells[shown].tobytes(), np.concatenate([[0], np.cumsum(np.bincount(doc, width, k).astype(_INT))])


_ROWS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>"


def _aligned(a_content: str, b_content: bytes, piece: int):
    """mapInArrow function: (row, doc_id, text) to the aligned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            texts, found, size, start = batch.column(2), [], 0, 0
            todo: list[tuple[int, str]] = []
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                parts = [(i, p) for p in cut(text, piece)] if text else []
                if not parts:
                    found.append((i, None))
                for part in parts:
                    todo.append(part)
                    size += len(part[1])
                    if size >= piece:
                        aligner = aligner or Aligner(byte_level(a_content), pieces(b_content))
                        found += zip([p[0] for p in todo], aligner.align([p[1] for p in todo]))
                        todo, size = [], 0
                if i + 1 == len(batch) or (not todo and i + 1 - start >= 500):
                    if todo:
                        aligner = aligner or Aligner(byte_level(a_content), pieces(b_content))
                        found += zip([p[0] for p in todo], aligner.align([p[1] for p in todo]))
                        todo, size = [], 0
                    yield _rows(batch.slice(start, i + 1 - start), start, found)
                    found, start = [], i + 1

    return run


def _rows(batch: pa.RecordBatch, start: int, found: list) -> pa.RecordBatch:
    """One row a text from its parts: numbers and pairs add up, the written groups follow each other."""
    parts: dict[int, list] = {}
    for i, part in found:
        parts.setdefault(i - start, []).append(part)
    numbers, digests, pairs, times = np.zeros((4, len(batch)), _INT), [], [], []
    for i in range(len(batch)):
        mine = parts[i]
        if any(p is None for p in mine):
            mine = []
        digest = hashlib.sha256()
        for j, p in enumerate(mine):
            numbers[:, i] += p[:4]
            digest.update(b";" + p[4] if j else p[4])
        digests.append(digest.hexdigest() if mine else "")
        both = np.concatenate([p[5] for p in mine] or [np.empty(0, _INT)])
        many = np.concatenate([p[6] for p in mine] or [np.empty(0, _INT)])
        if len(mine) > 1:
            both, back = np.unique(both, return_inverse=True)
            many = np.bincount(back, many, len(both)).astype(_INT)
        pairs.append(both)
        times.append(many)
    ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v).astype(np.int32))) for v in (pairs, times)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, numbers), pa.array(digests, pa.string()), *lists],
                                      ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (pairs) to (pair, n), added up over about a million places."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size >= 1 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def pair_counts(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, n): how many rows hold each pair; a frequent one is added up under several salts first."""
    some = rows.select("pairs").mapInArrow(_partial_counts, "pair int, n bigint")
    salted = some.groupBy("pair", (F.spark_partition_id() % salts).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _sums(sent):
    """mapInArrow function: the aligned rows to those with n_best and count_sum over the pairs in ``sent``, and the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = sent.value
        for batch in batches:
            pairs, many = batch.column("pairs"), batch.column("times")
            flat, times = pairs.flatten().to_numpy(), many.flatten().to_numpy().astype(_INT)
            row = np.repeat(np.arange(len(batch)), np.diff(pairs.offsets.to_numpy()))
            hit, at = np.zeros(len(flat), bool), np.searchsorted(key, flat)
            if len(key):
                at = np.minimum(at, len(key) - 1)
                hit = key[at] == flat
            sums = np.zeros((2, len(batch)), _INT)
            for i, worth in enumerate((best, count)):
                np.add.at(sums[i], row[hit], times[hit] * worth[at[hit]])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(batch)))]), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(v[~hit].astype(np.int32))) for v in (flat, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", *_OUT)], *map(pa.array, sums), *rest], ["row", *_OUT, "n_best", "count_sum", "pairs", "times"])

    return run


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, piece: int = PIECE, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Needs ``doc_id`` and ``text``; other columns are ignored.  Texts that are null, empty
    or changed by a tokenizer have zeros and ''.  Each row is a document, also where rows
    share an id or have none.  A text is encoded in parts of about ``piece`` characters, longer
    only where no single space lies between other characters; of each part its pairs and its
    written groups are kept.  An empty table gives an empty table.  The driver reads the two
    vocabularies (about 4 MB) and sends them along.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    with open(f"{folder}/{a_file}", encoding="utf-8") as f:
        a_content = f.read()
    with open(f"{folder}/{b_file}", "rb") as f:
        b_content = f.read()
    b_size = pieces(b_content).size
    if (byte_level(a_content).size + 1) * b_size >= 2 ** 31:
        raise ValueError("the vocabularies are too large for pairs of 32 bits")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.table(texts.mapInArrow(_aligned(a_content, b_content, piece), _ROWS))
    seen = Observation()
    counts = scratch.table(pair_counts(rows), seen)
    tops = counts.groupBy(F.floor(F.col("pair") / b_size).cast("int").alias("a")).agg(F.max("n").alias("top"))  # as many rows as the vocabulary at most
    judged = scratch.table(counts.join(F.broadcast(tops), F.floor(F.col("pair") / b_size).cast("int") == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    least, held = 1, 0
    if seen.get["n"] > frequent:
        # by powers of two of the count, 64 rows at most: the highest ones that fit together
        steps = judged.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()
        for p, c in sorted(((r["p"], r["c"]) for r in steps), reverse=True):
            held += c
            if held > frequent:
                least = 2 ** (p + 1)
                break
    table = judged.where(F.col("n") >= least).toArrow()  # ``frequent`` rows at most
    key = table.column("pair").to_numpy()
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))
    part = rows.mapInArrow(_sums(sent), _ROWS.replace("pairs", "n_best bigint, count_sum bigint, pairs"))
    if least == 1:
        return part.select(*_OUT[:-1], "n_best", "count_sum", "groups_sha256")
    part = scratch.table(part)
    rest = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("times"))
    more = rest.join(apart(judged.where(F.col("n") < least)), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return part.join(apart(more), "row", "left").select(*_OUT[:-1], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                                                         (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
