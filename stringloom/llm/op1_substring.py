"""Substring dedup of token windows by Rabin-Karp hashes, counted in Spark.

A window is `width` consecutive words of a document. Every window is hashed, but not every hash shuffles: windows are
grouped by their anchor, the least of the hashed GRAM-word runs in them, which equal windows share. Anchors that only one
text has cannot lie in a repeated window. Of the others all windows are hashed and each hash gets the least doc_id it
occurs in; those of a smaller document merge into maximal removal intervals.

A task pre-aggregates: anchors that two of its texts share are known to be repeated at once, so a passage in very many
documents sends one row per task, not one per document, to where anchors meet.

Defined results: a null text has no words. A null doc_id counts as larger than all others. Rows that share doc_id and text
get the same result and remove nothing from each other; so do rows that share only doc_id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, stage, table, text_rows
from .textnp import anchors, arrow_text, covered, signed, slices, spans_hash, window_hash, word_bounds

GRAM = 12
#: An `at` is the first window's start, shifted by so many bits, and below it the number of windows.
SHIFT = 24
#: Rows that a task gathers before it looks for anchors that several of its texts share.
GATHER = 1 << 20

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def check_width(width: int, least: int) -> None:
    if not least <= width <= 1 << 20:
        raise ValueError(f"width is {least} to {1 << 20}")


def word_anchors(width: int) -> Units:
    def run(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, row = word_bounds(buf, off)
        bounds = np.append(0, np.cumsum(np.bincount(row, minlength=len(off) - 1)))
        row, start, count, value = anchors(window_hash(spans_hash(buf, starts, ends), GRAM), GRAM, width, bounds)
        return row, start - bounds[row], count, value

    return run


def shared(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose anchor occurs again in these rows, and the first row of each such anchor."""
    order = np.argsort(value, kind="stable")
    v = value[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    known = np.zeros(len(v), bool)
    known[order] = many
    return known, order[new & many]


def repeated_anchors(rows: DataFrame, units: Units) -> DataFrame:
    """(h1, found): for each text by its hash, the runs of windows whose anchor is not unique, as (anchor, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                value, text, at = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                known, first = shared(value)
                # a known row goes to its text; one row per known anchor goes to where anchors meet, to tell the others
                key = np.append(np.where(known, text, value), value[first])
                kind = np.append(known.astype(np.int8), np.full(len(first), 2, np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.append(value, value[first])), pa.array(np.append(text, text[first])), pa.array(np.append(at, at[first])), pa.array(kind)], ["key", "anchor", "h1", "at", "kind"])

        for batch in batches:
            buf, off = arrow_text(batch.column(1))
            h1 = batch.column(0).to_numpy()
            for i, j in slices(off):
                row, start, count, value = units(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                own = h1[i:j]
                fresh = np.zeros(j - i, bool)  # copies of a text this task has had say nothing new
                for k, h in enumerate(own.tolist()):
                    if h not in seen:
                        seen.add(h)
                        fresh[k] = True
                if len(seen) > GATHER:
                    seen.clear()
                ok = fresh[row]
                held.append((signed(value[ok]), own[row[ok]], (start[ok] << SHIFT) + count[ok]))
                if sum(len(x[0]) for x in held) >= GATHER:
                    yield from flush()
        yield from flush()

    found = rows.select("h1", "text").mapInArrow(run, "key long, anchor long, h1 long, at long, kind byte")
    meet = Window.partitionBy("key")  # at most one row per task and key: a task sends no second one of an anchor
    found = found.withColumns({"low": F.min("h1").over(meet), "high": F.max("h1").over(meet), "told": F.max(F.when(F.col("kind") == 2, 1)).over(meet)})
    found = found.where("kind = 1 OR (kind = 0 AND (low < high OR told = 1))").select("h1", "anchor", "at")
    return stage(found, "anchors")


def with_runs(found: DataFrame, heads: DataFrame) -> DataFrame:
    """heads with `found`, the list of (anchor, at) of each text's runs."""
    lists = found.groupBy("h1").agg(F.collect_set(F.struct("anchor", "at")).alias("found"))
    return heads.join(lists, "h1", "left")


def first_of_text(rows: DataFrame) -> DataFrame:
    """(h1, h2, doc_id): the first document of each text. Its copies need no look at their windows."""
    return rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))


def runs_of(value: pa.Scalar) -> np.ndarray:
    """The at of a `found` list, ascending."""
    if not value.is_valid:
        return np.zeros(0, np.int64)
    return np.sort(value.values.field("at").to_numpy())


def window_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(window, doc_id, h1, start) of the windows in the runs of each text."""
    for batch in batches:
        buf, off = arrow_text(batch.column("text"))
        docs, h1, found = batch.column("doc_id").to_numpy(), batch.column("h1").to_numpy(), batch.column("found")
        for i, j in slices(off):
            starts, ends, row = word_bounds(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            bounds = np.append(0, np.cumsum(np.bincount(row, minlength=j - i)))
            hashed = window_hash(spans_hash(buf[off[i] : off[j]], starts, ends), width)
            at = [(k, runs_of(found[i + k])) for k in range(j - i)]
            owner = np.concatenate([np.full(len(x), k) for k, x in at])
            run = np.concatenate([x for _, x in at])
            count = run & ((1 << SHIFT) - 1)
            owner, first = np.repeat(owner, count), np.repeat(run >> SHIFT, count)
            begin = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            ok = begin + width <= (bounds[owner + 1] - bounds[owner])
            owner, begin = owner[ok], begin[ok]
            if len(owner):
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashed[bounds[owner] + begin])), pa.array(docs[i:j][owner]), pa.array(h1[i:j][owner]), pa.array(begin)], ["window", "doc_id", "h1", "start"])


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; spans are the maximal removed [start, end) in words.
    doc_id is NO_ID where it is null. width: from GRAM words to 2**20."""
    check_width(width, GRAM)
    rows = text_rows(docs)
    heads = first_of_text(rows)
    found = repeated_anchors(rows, word_anchors(width))
    info = stage(with_runs(found, heads), "op1-heads").select("h1", "h2", "doc_id", "found", F.lit(True).alias("head"))
    texts = rows.join(info, ["h1", "h2", "doc_id"], "left")
    windows = texts.where("found IS NOT NULL").select("doc_id", "h1", "text", "found").mapInArrow(lambda b: window_rows(b, width), "window long, doc_id long, h1 long, start long")
    least = stage(windows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "op1-windows")
    gone = windows.join(least.select("window", "low"), "window").where("doc_id > low").groupBy("doc_id", "h1").agg(F.collect_set("start").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = arrow_text(batch.column("text"))
            head, gone = batch.column("head"), batch.column("gone")
            out = []
            for i, j in slices(off):
                part = buf[off[i] : off[j]]
                starts, ends, row = word_bounds(part, off[i : j + 1] - off[i])
                bounds = np.append(0, np.cumsum(np.bincount(row, minlength=j - i)))
                raw = part.tobytes()
                for k in range(j - i):
                    n = int(bounds[k + 1] - bounds[k])
                    if not head[i + k].is_valid:  # a copy of an earlier document
                        begin = np.arange(max(0, n - width + 1))
                    elif gone[i + k].is_valid:
                        begin = np.array(gone[i + k].as_py(), np.int64)
                    else:
                        begin = np.zeros(0, np.int64)
                    removed = covered(n, begin, begin + width)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
                    at = bounds[k] + np.flatnonzero(~removed)
                    kept = b" ".join([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                    out.append((n, int(removed.sum()), hashlib.sha256(kept).hexdigest(), edge.reshape(-1, 2).tolist()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    done = texts.join(gone, ["doc_id", "h1"], "left").select("doc_id", "text", "head", "gone")
    return done.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS d FROM g GROUP BY 1),
r AS (SELECT DISTINCT g.doc_id, g.i + o.k AS p FROM g JOIN m ON m.h = g.h AND m.d < g.doc_id CROSS JOIN (SELECT unnest(range(50)) AS k) o),
x AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY 1),
t AS (SELECT w.doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) w),
k AS (SELECT t.doc_id, string_agg(t.t, ' ' ORDER BY t.p) AS kept FROM t ANTI JOIN r ON r.doc_id = t.doc_id AND r.p = t.p GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(x.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
