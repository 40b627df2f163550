"""LM scoring by cross-entropy difference.

Two bigram models share one vocabulary, all words of all documents. The target model counts the documents labelled of quality
1, the background model all documents. Counts are of the whole corpus and exact; nothing has a limit, and what is gathered
grows with the input. Both models smooth alike, and the background's counts are scaled to the target's total, so they match in
all but content. A document's score is the mean over its tokens of background loss less target loss, in nats: higher is more
like the target.

Texts are dealt into chunks of some CHUNK bytes, each one row. A chunk sends the hashes of its distinct words and pairs of
neighbouring words with their counts, cut into buckets by hash; in each bucket the counts of all chunks are added up, and each
chunk gets back the sums in the order in which it sent its hashes. So a word or pair costs some nine bytes per chunk that has
it, not a row per document, and a chunk scores its documents from what it got back. The number of buckets grows with the
input. The driver gets one row: the size of the vocabulary and of both models.

Words and pairs go by 64-bit hashes. Losses are summed as integers of 1 / SCALE nats, so the order of sums does not matter.

Defined results: a null or empty text has n_tokens 0 and score 0. Without target documents the models are equal and all
scores 0. Rows that share a doc_id are each scored. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .textnp import BASE, U, arrow_text, mix, signed, slices, spans_hash, word_bounds

BLOOM = 26
START, MIX, SCALE = U(0), 0.6, 1_000_000_000
#: Bytes of text in a chunk, unless a single text is longer, and for each bucket.
CHUNK = 8_000_000


def bigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pair that each word ends, the word before it (START at the head of a row), the word, and rows."""
    pairs, befores, words, rows = [], [], [], []
    for i, j in slices(off):
        starts, ends, row = word_bounds(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        word = spans_hash(buf[off[i] : off[j]], starts, ends)
        before = np.append(START, word[:-1])[: len(word)]
        before[np.append(True, row[1:] != row[:-1])[: len(row)]] = START
        pairs.append(mix(before * BASE + word))
        befores.append(before)
        words.append(word)
        rows.append(row + i)
    if not rows:
        return (np.zeros(0, U),) * 3 + (np.zeros(0, np.int64),)
    return np.concatenate(pairs), np.concatenate(befores), np.concatenate(words), np.concatenate(rows)


def dealt(texts: DataFrame) -> DataFrame:
    """(chunk, size, rows): texts by chunks, as compressed Arrow data. Written, since the numbers would not be the same again."""
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = 0, 0, []

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            chunk = (held[0].column("task")[0].as_py() << 32) + number
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "size", "rows"])

        for batch in batches:
            _, off = arrow_text(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(off, off[i] + most - size, "right")) - 1))
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
                if size >= most or j < batch.num_rows:
                    yield close()
                    number, size, held = number + 1, 0, []
                i = j
        if held:
            yield close()

    return texts.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(run, "chunk long, size long, rows binary")


def opened(raw: pa.Scalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The doc_ids of a chunk, and of its tokens: pair, word before, word, row. Tokens of the target have a row below 0, less 1."""
    rows = pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks()
    buf, off = arrow_text(rows.column("text"))
    own = rows.column("target").to_numpy().astype(bool)
    pair, before, word, row = bigrams(buf, off)
    return rows.column("doc_id").combine_chunks(), pair, before, word, np.where(own[row], -1 - row, row)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, where each begins in sorted order, and that order."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    return found[first], first, order


def sums(values: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)


def vocabulary(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As distinct(), of the words of a chunk; and which of the two copies of each token's words is one before another."""
    return *distinct(np.concatenate([before, word])), np.append(np.ones(len(before), np.int64), np.zeros(len(word), np.int64))


def sent(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, chunk, word, keys, background, target): packed hashes of a chunk's pairs or words, and their counts."""
    names = ["bucket", "chunk", "word", "keys", "background", "target"]
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True):
            _, pair, before, word, row = opened(raw)
            wanted = (row < 0).astype(np.int64)
            keys, first, order = distinct(pair)
            kinds = [(False, keys, np.diff(np.append(first, len(pair))), sums(wanted, first, order))]
            keys, first, order, ahead = vocabulary(before, word)
            kinds.append((True, keys, sums(ahead, first, order), sums(ahead * np.append(wanted, wanted), first, order)))
            for is_word, keys, every, target in kinds:
                bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
                cuts = list(zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True)) if len(at) else []
                columns = [[x[a:b].tobytes() for a, b in cuts] for x in (keys, every.astype(np.int32), target.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(signed(bucket[at])), pa.array(np.full(len(at), chunk)), pa.array(np.full(len(at), is_word)), *(pa.array(x, pa.binary()) for x in columns)], names)


def added(t: pa.Table) -> pa.Table:
    """(chunk, word, bucket, background, target, size, n, every, wanted) of a bucket: each chunk's sums, as numbers of `size`
    bytes, and a row of the totals."""
    out: list[tuple] = []
    is_word, chunks, bucket = t.column("word").to_numpy(), t.column("chunk").to_numpy(), t.column("bucket")[0].as_py()
    for kind in (False, True):
        part = t.filter(pa.array(is_word == kind))
        columns = [part.column(c).to_pylist() for c in ("keys", "background", "target")]
        keys, first, order = distinct(np.frombuffer(b"".join(columns[0]), U))
        ends = np.cumsum([len(x) // 8 for x in columns[0]]).astype(np.int64)
        group = np.zeros(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        totals = [sums(np.frombuffer(b"".join(x), np.int32).astype(np.int64), first, order) for x in columns[1:]]
        small = all(x.max(initial=0) < 1 << 31 for x in totals)
        told = [x.astype(np.int32 if small else np.int64)[group] for x in totals]
        begin = np.append(0, ends[:-1])
        out += [(c, kind, bucket, told[0][a:b].tobytes(), told[1][a:b].tobytes(), 4 if small else 8, None, None, None) for c, a, b in zip(chunks[is_word == kind].tolist(), begin.tolist(), ends.tolist(), strict=False)]
        if kind:
            out.append((None, None, None, None, None, None, len(keys), int(totals[0].sum()), int(totals[1].sum())))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["chunk", "word", "bucket", "background", "target", "size", "n", "every", "wanted"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def marked(texts: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, target) of every row of texts. Rows whose id is not in a Bloom filter of the target's ids don't shuffle.

    The filter has 2**BLOOM bits whatever the input; beyond its capacity more rows shuffle and the result stays the same.
    """
    ids = stage(target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "op10-target")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BLOOM))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    flagged = texts.withColumn("slot", slot).join(F.broadcast(words), F.shiftright("slot", 6) == F.col("word"), "left")  # at most 2**(BLOOM - 6) rows
    hit = "doc_id IS NOT NULL AND coalesce(bits & shiftleft(1L, cast(slot & 63 AS int)), 0L) != 0"
    sure = flagged.where(f"NOT ({hit})").select("doc_id", "text", F.lit(False).alias("target"))
    rest = flagged.where(hit).select("doc_id", "text").join(ids.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    return sure.unionByName(rest.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")))


def lm_scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row; target has the doc_ids of the target."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = stage(dealt(marked(texts, target)), "op10-chunks")
    buckets = max(1, -(-int(chunks.agg(F.sum("size")).first()[0] or 0) // CHUNK))
    packed = chunks.select("chunk", "rows").mapInArrow(lambda b: sent(b, buckets), "bucket long, chunk long, word boolean, keys binary, background binary, target binary")
    told = stage(packed.groupBy("bucket").applyInArrow(added, "chunk long, word boolean, bucket long, background binary, target binary, size int, n long, every long, wanted long"), "op10-counts")
    total = told.where("chunk IS NULL").agg(F.sum("n"), F.sum("every"), F.sum("wanted")).first()
    n, every, wanted = (int(x or 0) for x in total)
    same = not wanted  # both models are the background's
    size = float(wanted or every)
    scale = 1.0 if same else wanted / max(every, 1)

    def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, factor: float) -> np.ndarray:
        p = MIX * (pair * factor) / np.maximum(before * factor, 1e-9) + (1 - MIX) * (word * factor + 0.5) / (size + 0.5 * n)
        return np.round(-np.log(np.minimum(p, 1.0)) * SCALE).astype(np.int64)

    def score(own: pa.Table, back: pa.Table) -> pa.Table:
        ids, pair, before, word, row = opened(own.column("rows")[0])
        tokens = np.bincount(np.where(row < 0, -1 - row, row), minlength=len(ids))
        per, total = np.maximum(tokens, 1) * float(SCALE), []
        if len(pair):
            back = back.sort_by([("word", "ascending"), ("bucket", "ascending")])
            is_word = back.column("word").to_numpy()
            pairs, first, order = distinct(pair)
            words, _, _, _ = vocabulary(before, word)
            of_pair = np.empty(len(pair), np.int64)
            of_pair[order] = np.repeat(np.arange(len(pairs)), np.diff(np.append(first, len(pair))))
            at = order[first]
            left, right = np.searchsorted(words, before[at]), np.searchsorted(words, word[at])
            for model, factor in (("target", 1.0), ("background", scale)):
                parts = [[], []]
                for kind, raw, other in zip(is_word, back.column("background" if same else model).to_pylist(), back.column("size").to_pylist(), strict=True):
                    parts[int(kind)].append(np.frombuffer(raw, np.int32 if other == 4 else np.int64))
                n_pair, n_word = (np.concatenate(x).astype(np.int64) for x in parts)
                loss = losses(n_pair, n_word[left], n_word[right], factor)[of_pair]
                upto, ends = np.append(0, np.cumsum(loss)), np.cumsum(tokens)
                total.append(upto[ends] - upto[ends - tokens])
        else:
            total = [np.zeros(len(ids), np.int64)] * 2
        columns = [ids, pa.array(tokens), pa.array(total[0] / per), pa.array(total[1] / per), pa.array((total[1] - total[0]) / per)]
        return pa.table(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answers = told.where("chunk IS NOT NULL").select("chunk", "word", "bucket", "background", "target", "size")
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
