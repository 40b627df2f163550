"""Suffix-array dedup of byte strings by a run-length index.

Strings of `width` bytes are grouped by their anchor, the least of the hashed 24-byte grams in them, which equal strings
share (as in op1). Only runs of strings whose anchor is not unique are looked at: each run is a piece of text, and pieces
with one anchor meet in one task. There, pieces that differ are joined into one text whose suffixes are sorted, and its
Burrows-Wheeler transform is cut into runs. At each run's first row the position of the suffix and the length of its match
with the one before in suffix order are sampled; between samples both are known, since a match shrinks by one from each
position to the next. So matching statistics stream over the text from the samples alone: every position's match of at
least `width` bytes, and by the rows that such matches join, the first place where each string occurs.

An anchor with over HEAVY pieces is not indexed in one task as it is: equal pieces are merged in Spark, and each is cut in two at
the anchor: the strings that go on after it for half of what they have besides it, and those that begin as far before it. The
anchor and these bytes are a finer anchor, which equal strings share as well. That is repeated for those that still have over
HEAVY different pieces, until the anchor is the whole string, and all meet in the same index. Pieces of heavy anchors are cut from
the documents as they are read, without a shuffle of whole texts: copies of a text give the same pieces at later places.

Defined results: a null text is empty. A null doc_id counts as larger than all others. Rows that share doc_id and text get
the same result; of different texts with one doc_id the one with the smaller hash counts as earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, stage, table, text_rows
from .op1_substring import SHIFT, Units, check_width, first_of_text, repeated_anchors, runs_of, with_runs
from .textnp import anchors, arrow_text, bytes_hash, covered, signed, slices

GRAM, WIDTH, HEAVY, LARGE = 24, 100, 16_384, 10_000
#: Bytes of text in one index.
TEXT = 1_200_000


def byte_anchors(width: int) -> Units:
    def run(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row, start, count, value = anchors(bytes_hash(buf), GRAM, width, off)
        return row, start - off[row], count, value

    return run


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order. A suffix has left[i] symbols, up to its piece's end; of two that are equal the
    first in the text comes first. Prefix doubling, over those suffixes only whose order is still open."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        symbol = np.zeros(n, np.uint64)
        symbol[: n - j] = text[j:].astype(np.uint64) + np.uint64(1)
        symbol[left <= j] = 0
        key = (key << np.uint64(9)) | symbol
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (left[order[1:]] < 7)
    del key, k
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 7
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        # one that ends here comes before longer ones, and equal ones come by place
        key = (rank[at] << 32) | np.where(left[at] <= done, at, n + rank[np.minimum(at + done, n - 1)])
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[open_] = at
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[open_] = split
        rank[at] = np.maximum.accumulate(np.where(split, open_, 0))
        done *= 2


def common(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match of the suffixes at a and b."""
    most = np.minimum(left[a], left[b])
    raw = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", raw.data, 0, (1,))
    out, todo, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(todo):
        x = words[np.minimum(a[todo] + at, len(text) - 1)] ^ words[np.minimum(b[todo] + at, len(text) - 1)]
        same = x == 0
        low = x & (~x + np.uint64(1))  # its lowest set bit
        bytes_ = np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        out[todo] = at + bytes_
        at += 8
        todo = todo[same & (most[todo] > at)]
    return np.minimum(out, most)


def matches(text: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Whether the string of `width` bytes from each position of the text also starts before it. Index, then stream."""
    n = len(text)
    order = suffix_array(text, left)
    piece_start = np.ones(n, bool)
    piece_start[1:] = left[1:] >= left[:-1]
    before = text[order - 1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1]) | piece_start[order[1:]] | piece_start[order[:-1]]
    rows = np.flatnonzero(head)
    rows = rows[rows > 0]
    sample, length = order[rows], common(text, left, order[rows], order[rows - 1])
    by = np.argsort(sample)
    sample, length = sample[by], length[by]
    # the first suffix in order has no one before it; its place is a sample of length 0
    k = int(np.searchsorted(sample, order[0]))
    sample, length = np.insert(sample, k, order[0]), np.insert(length, k, 0)
    size = np.diff(np.append(sample, n))
    match = np.zeros(n, np.int64)
    match[int(sample[0]) :] = np.repeat(sample + length, size) - np.arange(int(sample[0]), n)
    linked = match[order] >= width
    linked[0] = False
    group = np.flatnonzero(~linked)
    first = np.repeat(np.minimum.reduceat(order, group), np.diff(np.append(group, n)))
    again = np.zeros(n, bool)
    again[order] = first < order
    return again & (left >= width)


def piece_rows(batches: Iterator[pa.RecordBatch], width: int, hot: frozenset[int] = frozenset()) -> Iterator[pa.RecordBatch]:
    """(anchor, piece, doc_id, h1, start) of each run whose anchor is not in `hot`; of equal pieces of one text only the first."""
    for batch in batches:
        buf, off = arrow_text(batch.column("text"))
        docs, h1, found = batch.column("doc_id").to_numpy(), batch.column("h1").to_numpy(), batch.column("found")
        cols: list[list] = [[], [], [], [], []]
        held = 0
        for i in range(batch.num_rows):
            raw = buf[off[i] : off[i + 1]].tobytes()
            seen = set()
            for x in sorted((y["at"], y["anchor"]) for y in found[i].as_py() if y["anchor"] not in hot):
                start, count = x[0] >> SHIFT, x[0] & ((1 << SHIFT) - 1)
                piece = raw[start : start + count + width - 1]
                if len(piece) >= width and (x[1], piece) not in seen:
                    seen.add((x[1], piece))
                    held += len(piece)
                    for c, v in zip(cols, (x[1], piece, int(docs[i]), int(h1[i]), start), strict=True):
                        c.append(v)
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECE_TYPES, strict=True)], PIECE)
                cols, held = [[], [], [], [], []], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECE_TYPES, strict=True)], PIECE)


def hot_rows(batches: Iterator[pa.RecordBatch], width: int, hot: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """(anchor, piece, doc_id, h1, start) of each run whose anchor is in `hot`; of equal pieces of a slice only the first."""
    wanted, units = np.array(sorted(hot), np.int64), byte_anchors(width)
    for batch in batches:
        buf, off = arrow_text(batch.column("text"))
        docs, h1 = batch.column("doc_id").to_numpy(), batch.column("h1").to_numpy()
        for i, j in slices(off):
            row, start, count, value = units(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            value = signed(value)
            at = np.flatnonzero(np.isin(value, wanted))
            first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            for r, s, n, v in zip(row[at].tolist(), start[at].tolist(), count[at].tolist(), value[at].tolist(), strict=True):
                begin = int(off[i + r]) + s
                key, place = (v, buf[begin : begin + n + width - 1].tobytes()), (int(docs[i + r]), int(h1[i + r]), s)
                if key not in first or place < first[key]:
                    first[key] = place
            if first:
                cols = [*zip(*first, strict=True), *zip(*first.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECE_TYPES, strict=True)], PIECE)


PIECE = ["anchor", "piece", "doc_id", "h1", "start"]
PIECE_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def indexed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, start, again) of the first of equal pieces; again has a byte for each string in it. The rows come sorted
    by anchor, then place; an anchor's pieces are never split over two indexes."""
    held: list[pa.Table] = []
    size = 0

    def answer(t: pa.Table) -> pa.RecordBatch | None:
        anchor, doc, h1, start = (t.column(c).to_numpy() for c in ("anchor", "doc_id", "h1", "start"))
        pieces = t.column("piece").to_pylist()
        seen: set[tuple[int, bytes]] = set()
        first = []
        for k, x in enumerate(zip(anchor.tolist(), pieces, strict=True)):
            if x not in seen:
                seen.add(x)
                first.append(k)
        own = anchor[first]
        many = np.ones(len(first), bool)
        many[1:] = own[1:] == own[:-1]
        many[:1] = False
        many[:-1] |= many[1:]
        again = [bytes(len(pieces[k]) - width + 1) for k in first]
        at = [k for k in range(len(first)) if many[k]]
        if at:
            place = sorted(at, key=lambda k: (doc[first[k]], h1[first[k]], start[first[k]]))
            parts = [pieces[first[k]] for k in place]
            text = np.frombuffer(b"".join(parts), np.uint8)
            lens = np.array([len(x) for x in parts])
            ends = np.cumsum(lens)
            found = matches(text, np.repeat(ends, lens) - np.arange(len(text)), width)
            for k, end, n in zip(place, ends.tolist(), lens.tolist(), strict=True):
                again[k] = found[end - n : end - width + 1].astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(h1[first]), pa.array(start[first]), pa.array(again, pa.binary())], ["doc_id", "h1", "start", "again"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.column("piece").nbytes
        if size >= TEXT:
            t = pa.concat_tables(held)
            a = t.column("anchor").to_numpy()
            cut = len(a) - int(np.argmax(a[::-1] != a[-1])) if a[0] != a[-1] else 0
            ends = np.flatnonzero(np.append(a[1:cut] != a[: cut - 1], True)) + 1 if cut else []
            lens, begin = np.cumsum(pa.compute.binary_length(t.column("piece")).to_numpy()), 0
            for k, end in enumerate(ends):  # groups of whole anchors of about TEXT bytes
                if k == len(ends) - 1 or lens[end - 1] - (lens[begin - 1] if begin else 0) >= TEXT:
                    yield answer(t.slice(begin, end - begin))
                    begin = end
            held = [t.slice(cut)] if cut else [t]
            size = held[0].column("piece").nbytes if cut else 0
    if held:
        yield answer(pa.concat_tables(held))


def merged(pieces: DataFrame) -> DataFrame:
    """The first of equal pieces of an anchor."""
    return pieces.groupBy("anchor", "piece", "gram", "place").agg(F.min(F.struct("doc_id", "h1", "start")).alias("x")).select("anchor", "piece", "gram", "place", "x.*")


def finer(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces cut in two by finer anchors. A piece's strings all hold the `gram` bytes from `place`."""
    names = [*PIECE, "gram", "place"]
    for batch in batches:
        out = []
        for anchor, piece, doc, h1, start, gram, place in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            n = len(piece) - width + 1
            more = (width - gram + 1) // 2
            late = max(0, min(n, place + gram + more - width))  # strings from here on have `more` bytes after the anchor
            for a, b, low, high in ((late, n, place, place + gram + more), (0, late, place - more, place + gram)):
                if a < b:
                    key = int.from_bytes(hashlib.blake2b(piece[low:high] + bytes([low < place]), digest_size=8).digest(), "big", signed=True)
                    out.append((key, piece[a : b + width - 1], doc, h1, start + a, high - low, low - a))
        if out:
            kinds = [*PIECE_TYPES, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def located(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces with the place of their anchor in them."""
    for batch in batches:
        place = []
        for raw, anchor in zip(batch.column("piece").to_pylist(), batch.column("anchor").to_pylist(), strict=True):
            n = len(raw) - width + 1
            place.append(n - 1 + int(np.argmax(signed(bytes_hash(np.frombuffer(raw, np.uint8)))[n - 1 : width - GRAM + 1] == anchor)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECE), pa.array([GRAM] * len(place), pa.int32()), pa.array(place, pa.int32())], [*PIECE, "gram", "place"])


def refined(heavy: DataFrame, width: int, most: int) -> DataFrame:
    """The pieces of heavy anchors by finer ones, none of which has over `most` different pieces; equal ones are merged."""
    schema = "anchor long, piece binary, doc_id long, h1 long, start long, gram int, place int"
    rows = stage(merged(heavy.mapInArrow(lambda b: located(b, width), schema)), "op4-heavy")
    done = None
    while True:
        large = stage(rows.groupBy("anchor").count().where(F.col("count") > most).where("anchor IS NOT NULL"), "op4-large")
        few = rows.join(large, "anchor", "left_anti")
        done = few if done is None else done.unionByName(few)
        if large.isEmpty():
            return done.select(*PIECE)
        # the anchor is the whole string at last, and then each has one piece
        rows = stage(merged(rows.join(large, "anchor", "left_semi").mapInArrow(lambda b: finer(b, width), schema)), "op4-heavy")


def suffix_dedup(docs: DataFrame, width: int = WIDTH, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; doc_id is NO_ID where it is null. width: from
    GRAM bytes to 2**20."""
    check_width(width, GRAM)
    rows = text_rows(docs)
    found = repeated_anchors(rows, byte_anchors(width))
    info = stage(with_runs(found, first_of_text(rows)), "op4-heads").select(F.col("doc_id").alias("d"), F.col("h1").alias("g"), F.col("h2").alias("other"), "found", F.lit(True).alias("head"))
    # dealt by (doc_id, h1), as the answers are, so texts shuffle once; h2 is compared but no key
    texts = rows.join(info, (F.col("doc_id") == F.col("d")) & (F.col("h1") == F.col("g")) & (F.col("h2").bitwiseXOR(F.col("other")) == 0), "left").drop("d", "g", "other")
    large = stage(found.groupBy("anchor").count().where(F.col("count") > heavy), "op4-large")
    # at most LARGE of them; an anchor that is not among them has less than one row in LARGE, so the others are joined by shuffle
    hot = frozenset(x.anchor for x in large.orderBy(F.desc("count"), "anchor").limit(LARGE).collect())
    schema = "anchor long, piece binary, doc_id long, h1 long, start long"
    pieces = texts.where("found IS NOT NULL").select("doc_id", "h1", "text", "found").mapInArrow(lambda b: piece_rows(b, width, hot), schema)
    if hot:
        many = rows.select("doc_id", "h1", "text").mapInArrow(lambda b: hot_rows(b, width, hot), schema)
        if large.count() > LARGE:
            others = large.select("anchor").hint("merge")
            many = many.unionByName(pieces.join(others, "anchor", "left_semi"))
            pieces = pieces.join(others, "anchor", "left_anti")
        pieces = pieces.unionByName(refined(many, width, heavy))
    pieces = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "h1", "start")
    told = pieces.mapInArrow(lambda b: indexed(b, width), "doc_id long, h1 long, start long, again binary")
    told = told.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("start", "again")).alias("firsts"))
    done = texts.join(told, ["doc_id", "h1"], "left").select("doc_id", "text", "found", "head", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = arrow_text(batch.column("text"))
            found, head, firsts, out = batch.column("found"), batch.column("head"), batch.column("firsts"), []
            for i in range(batch.num_rows):
                n = int(off[i + 1] - off[i])
                if not head[i].is_valid:
                    begin = np.arange(max(0, n - width + 1))
                else:
                    at = runs_of(found[i])
                    gone = np.zeros(n + 1, bool)  # strings of a run go, but those of the first of equal pieces that are not seen before
                    for start, count in zip((at >> SHIFT).tolist(), (at & ((1 << SHIFT) - 1)).tolist(), strict=True):
                        gone[start : start + count] = True
                    for x in firsts[i].as_py() if firsts[i].is_valid else ():
                        gone[x["start"] : x["start"] + len(x["again"])] = np.frombuffer(x["again"], np.uint8) > 0
                    begin = np.flatnonzero(gone)
                removed = covered(n, begin, begin + width)
                spans = int((np.diff(np.concatenate([[False], removed]).astype(np.int8)) == 1).sum())
                out.append((n, int(removed.sum()), spans, hashlib.sha256(buf[off[i] : off[i + 1]][~removed].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return done.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, hash(substr(x, (2 * i + 1)::BIGINT, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM t WHERE length(x) >= 200)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM g),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE n > 1),
b AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR p + 100 < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM b GROUP BY 1, 2),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER w AS before, lead(a) OVER w AS next FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
o AS (SELECT t.doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed,
      string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT) || CASE WHEN next IS NULL THEN substr(x, (2 * z + 1)::BIGINT) ELSE '' END, '' ORDER BY a) AS kept
      FROM k JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN o USING (doc_id)
"""
