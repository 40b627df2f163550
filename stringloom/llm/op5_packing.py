"""Packing along a space-filling curve.

Each document's token ids are projected, by fixed pseudo-random vectors per id, to DIMS numbers; their cell on a Hilbert
curve is the sort key. Documents are dealt to ranges of (key, doc_id), so that even a key that very many copies share is
split, and sorted. Where ranges end is decided by a sample of at most SAMPLE rows that hashes of the rows themselves pick, so
reruns with the same number of partitions give the same pieces; the sample only balances the ranges. Each partition joins its documents along the curve and cuts every 1024 ids; what is left at its end
becomes sequences of powers of two, which need no padding. Only ids and keys shuffle.

Ids are those of the tokenizers file. Texts that hold one of its added tokens (<|endoftext|>) are encoded by tokenizers itself,
all others by tiktoken from the ranks of the same vocabulary. Pre-tokens that were encoded before are known by a 64-bit hash,
and a known one's code points are compared before its ids are taken.

Defined results: a null or empty text is the single id 0. Rows that share a doc_id are packed one after the other, each
from start 0. sequence_id is unique: the partition's number, then a number in it. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .textnp import BASE, U, mix

LENGTH, DIMS, BITS = 1024, 4, 12
#: Bytes of ids in a partition of the curve.
PART = 64_000_000
#: Rows that decide the ranges.
SAMPLE = 1_000_000
#: Code points that classes() does not know.
BEYOND = re.compile("[\u0250-\U0010ffff]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary(path: str | None = None) -> str:
    """Where the tokenizer's ranks are: the given place, or that of the installed public_tokenizers."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def whole(path: str):
    """The tokenizers file that belongs to the ranks, and its added tokens."""
    import json

    from tokenizers import Tokenizer

    path = path.removesuffix(".tiktoken") + ".json"
    with open(path, encoding="utf-8") as raw:
        added = tuple(x["content"] for x in json.load(raw)["added_tokens"])
    return Tokenizer.from_file(path), added


@lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point up to U+024F: 0 white space, 1 letter, 2 number, 3 other. Texts beyond take the slower way."""
    import regex

    kinds = [regex.compile(x) for x in (r"\s", r"\p{L}", r"\p{N}")]
    return np.array([next((i for i, k in enumerate(kinds) if k.match(chr(c))), 3) for c in range(0x250)], np.uint8)


def cuts(points: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a text begin that has no apostrophe."""
    kind = classes()[points]
    n = len(kind)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    space = kind == 0
    last = space.copy()  # the last white space before other text stands alone ...
    last[:-1] &= ~space[1:]
    last[-1:] = False
    new |= last
    new[1:][last[:-1]] = points[:-1][last[:-1]] != 32  # ... or, if it is U+0020, goes with what follows
    return np.flatnonzero(new)


class Tokens:
    """Ids of texts: pre-tokens are cut and hashed with numpy, and each distinct one is encoded once."""

    MOST = 1 << 19

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.whole, self.added = whole(path)
        self.clear()

    def slow(self, text: str) -> list[int]:
        if any(x in text for x in self.added):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.encoder.encode_ordinary(text)

    def clear(self) -> None:
        self.keys, self.at, self.ids, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
        self.points, self.from_, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        sizes = np.zeros(len(texts), np.int64)
        plain = [i for i, x in enumerate(texts) if x and "'" not in x and (x.isascii() or not BEYOND.search(x)) and not any(y in x for y in self.added)]
        odd = sorted(set(range(len(texts))) - set(plain))
        slow = {i: np.array(self.slow(texts[i]), np.uint16) for i in odd}
        flat, firsts = np.zeros(0, np.uint16), np.zeros(1, np.int64)
        if plain:
            whole = "".join(texts[i] for i in plain)
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            ends = np.cumsum([len(texts[i]) for i in plain])
            begin = np.concatenate([cuts(points[a:b]) + a for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])
            lens = np.diff(np.append(begin, len(points)))
            hashed = mix(points.astype(U) + BASE)
            pos = np.arange(len(points)) - np.repeat(begin, lens)
            power = np.full(int(lens.max()), BASE, U)
            power[0] = 1
            words = mix(np.add.reduceat(hashed * np.multiply.accumulate(power)[pos], begin) + lens.astype(U))
            where = self.find(words, begin, lens, points, whole)
            n = self.count[where]
            total = np.cumsum(n)
            flat = self.ids[np.repeat(self.at[where], n) + np.arange(int(total[-1])) - np.repeat(total - n, n)]
            firsts = np.append(0, total[np.searchsorted(begin, ends) - 1])
        for k, i in enumerate(plain):
            sizes[i] = firsts[k + 1] - firsts[k]
        if not odd:
            return flat, sizes
        parts, k = [], 0
        for i in range(len(texts)):
            if i in slow:
                parts.append(slow[i])
                sizes[i] = len(slow[i])
            else:
                parts.append(flat[firsts[k] : firsts[k + 1]])
                k += 1
        return np.concatenate(parts) if parts else flat, sizes

    def find(self, words: np.ndarray, begin: np.ndarray, lens: np.ndarray, points: np.ndarray, whole: str) -> np.ndarray:
        known, first, back = np.unique(words, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, known)
        old = np.zeros(len(known), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == known[inside]
        if old.any():
            a, b = first[old], at[old]
            same = self.lens[b] == lens[a]
            if same.all():
                pos = np.arange(int(lens[a].sum())) - np.repeat(np.cumsum(lens[a]) - lens[a], lens[a])
                same = points[np.repeat(begin[a], lens[a]) + pos] == self.points[np.repeat(self.from_[b], lens[a]) + pos]
            if not same.all() or len(self.keys) + len(known) - len(a) > self.MOST:  # two pre-tokens of one hash, or too many: forget all
                self.clear()
                at, old = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        if not old.all():
            fresh, at = first[~old], at[~old]
            encode = self.encoder.encode_ordinary
            got = [encode(whole[b:e]) for b, e in zip(begin[fresh].tolist(), (begin[fresh] + lens[fresh]).tolist(), strict=True)]
            n, size = np.array([len(x) for x in got], np.int64), lens[fresh]
            self.at = np.insert(self.at, at, len(self.ids) + np.cumsum(n) - n)
            self.ids = np.append(self.ids, np.array([y for x in got for y in x], np.uint16))
            self.from_ = np.insert(self.from_, at, len(self.points) + np.cumsum(size) - size)
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            self.points = np.append(self.points, points[np.repeat(begin[fresh], size) + pos])
            self.keys, self.count, self.lens = np.insert(self.keys, at, known[~old]), np.insert(self.count, at, n), np.insert(self.lens, at, size)
        return np.searchsorted(self.keys, known)[back]


@lru_cache(1)
def directions() -> np.ndarray:
    """For each id DIMS numbers of mean 0, the same everywhere."""
    n = 1 << 16
    x = mix((np.arange(n * DIMS, dtype=U) + U(1)) * BASE)
    return ((x >> U(11)).astype(np.float64) / float(1 << 53) - 0.5).reshape(n, DIMS).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of cell numbers (Skilling's transposition)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Curve keys of documents; none is empty."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    table = directions()
    at = np.cumsum(sizes) - sizes
    mean = np.stack([np.add.reduceat(table[:, d][ids].astype(np.float64), at) / sizes for d in range(DIMS)], 1)
    # common ids pull all means to one place; rarer ones spread them by about 1/8
    return hilbert(np.clip((mean * 4 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, curve, size, ids): ids as unsigned 16-bit numbers with the closing 0."""
    where = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(where)
        for batch in batches:
            ids_in, texts = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1_000_000):
                    size += len(texts[j])
                    j += 1
                flat, n = tokens(texts[i:j])
                n1 = n + 1
                at = np.cumsum(n1)
                ids = np.zeros(int(at[-1]), np.uint16)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                offsets = np.append(0, at * 2).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([ids_in.slice(i, j - i), pa.array(keys(ids, n1)), pa.array(n1 * 2), binary], ["doc_id", "curve", "size", "ids"])
                i = j

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, curve long, size long, ids binary")


def bounds(ids: DataFrame, parts: int, rows: int) -> np.ndarray:
    """Up to parts - 1 places along the curve that cut it into ranges of about the same bytes, by a sample that only the rows decide."""
    share = min(1.0, min(100 * parts, SAMPLE) / max(rows, 1))
    sample = ids.where(F.pmod(F.xxhash64("curve", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("curve", "doc_id", "size").toArrow()
    at = places(sample.column("curve"), sample.column("doc_id"))
    by = np.argsort(at, kind="stable")
    total = np.cumsum(sample.column("size").to_numpy()[by])
    if not len(total):
        return at
    return np.unique(at[by][np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)])


def places(curve: pa.Array | pa.ChunkedArray, doc_id: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Of (curve, doc_id) 16 bytes that sort like them; a null doc_id is the smallest."""
    doc = doc_id.fill_null(-(1 << 63)).to_numpy().astype(np.int64)
    both = np.stack([curve.to_numpy().astype(">u8"), (doc.view(U) ^ U(1 << 63)).astype(">u8")], 1)
    return np.ascontiguousarray(both).view("S16").reshape(-1)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece."""
    ids = stage(tokenized(docs, path), "op5-ids")
    size, rows = ids.agg(F.sum("size"), F.count(F.lit(1))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART))
    cut = bounds(ids, parts, rows)

    @F.arrow_udf("int")
    def part(curve: pa.Array, doc_id: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cut, places(curve, doc_id)), pa.int32())

    laid = ids.drop("size").withColumn("part", part("curve", "doc_id")).repartitionById(parts, "part").sortWithinPartitions("curve", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length)
        for batch in batches:
            yield from packer.add(batch)
        yield from packer.close()

    return laid.mapInArrow(run, PIECES)


class Packer:
    """Cuts a stream of documents every `length` ids. What a document leaves open stays here until the sequence's end is known."""

    def __init__(self, length: int):
        self.length, self.number, self.fill, self.open, self.part = length, 0, 0, [], 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        docs, part = batch.column("doc_id").to_pylist(), batch.column("part")
        for doc, raw in zip(docs, batch.column("ids"), strict=True):
            self.part = part[0].as_py()
            ids = np.frombuffer(raw.as_buffer(), np.uint16)
            start = 0
            while start < len(ids):
                n = min(len(ids) - start, self.length - self.fill)
                self.open.append((doc, start, ids[start : start + n], len(ids), self.fill))
                self.fill += n
                start += n
                if self.fill == self.length:
                    out += self.flush([self.length])
        yield from self.rows(out)

    def flush(self, lengths: list[int]) -> list[tuple]:
        """The open pieces as sequences of these lengths, cut where one ends."""
        out, ends, k = [], list(np.cumsum(lengths)), 0
        for doc, start, ids, total, offset in self.open:
            done = 0
            while done < len(ids):
                n = min(len(ids) - done, int(ends[k]) - offset - done)
                begin = int(ends[k]) - lengths[k]
                crc = zlib.crc32(ids[done : done + n].astype("<u4").tobytes())
                out.append((doc, start + done, n, crc, total, (self.part << 40) + self.number + k, offset + done - begin))
                done += n
                if offset + done == ends[k]:
                    k += 1
        self.number += len(lengths)
        self.open, self.fill = [], 0
        return out

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.fill:
            yield from self.rows(self.flush([1 << b for b in range(self.fill.bit_length() - 1, -1, -1) if self.fill >> b & 1]))

    @staticmethod
    def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
