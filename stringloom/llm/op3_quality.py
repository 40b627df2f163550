"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, pairs of neighbouring words, and the same for word shapes (runs of lower case, upper case,
digits and each other sign, with a mark where a word repeats the one before). A feature's value is its share of the text's
words, times SCALE. Features hash into 2**LOG2 weights, so scoring is a sparse dot product over the whole text: the mean of
the looked-up weights. Training reads the texts of at most MOST labelled rows, those with the least hash of doc_id, in one
task; the model is one array of fixed size.

Labels, language, source and id are no features. Rows with crc32(doc_id as text) mod 4 = 2 are held out of training.

Defined results: a null or empty text scores as the bias alone. A null doc_id is not held out. Labels that are null, not 0
or 1, or repeated for a document train once each if valid. Without any label all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .textnp import BASE, U, arrow_text, mix, slices, spans_hash, word_bounds

LOG2, SCALE, MOST, EPOCHS = 18, 10.0, 20_000, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7

#: A class per byte: lower case and all beyond ASCII alike, upper case, digits, and each other sign its own.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[128:], SHAPE[65:91], SHAPE[48:58] = 97, 97, 65, 48


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of all features, four per word (three for the last), and the row of each, by row."""
    starts, ends, row = word_bounds(buf, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = spans_hash(buf, starts, ends)
    shape = SHAPE[buf]
    new = np.ones(len(buf), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    kept = np.cumsum(new)
    inside = new.copy()
    at = kept[starts] - 1
    shapes = spans_hash(shape[inside], at, kept[ends - 1])
    same = np.append(words[1:] == words[:-1], False).astype(U)
    pair = np.append((row[1:] == row[:-1]), False)
    follow = lambda x: np.append(x[1:], U(0))
    pairs, shape_pairs = mix(words * BASE + follow(words)), mix(shapes * BASE + follow(shapes) * U(3) + same + U(5))
    both = np.stack([words, mix(shapes + U(2)), np.where(pair, pairs, words), np.where(pair, shape_pairs, mix(shapes + U(2)))], 1)
    return (both >> U(64 - LOG2)).astype(np.int64).ravel(), np.repeat(row, 4)


def train(rows: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights and, last, the bias, from (features, values, label)."""
    size = (1 << LOG2) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(k: np.ndarray) -> np.ndarray:
        x = z[k]
        return np.where(np.abs(x) <= L1, 0.0, (np.sign(x) * L1 - x) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    for k, value, label in rows:
        k, value = np.append(k, size - 1), np.append(value, 1.0)
        w = weights(k)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
        n[k] += g * g
    return weights(np.arange(size)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> np.ndarray:
    """The model. Reads `most` labelled texts at most; those ids are broadcast."""
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    sample = usable.select("doc_id", F.col("quality").cast("int").alias("label"), F.xxhash64(F.lit(3), "doc_id").alias("turn")).distinct().orderBy("turn", "doc_id", "label").limit(most)
    sample = stage(sample, "op3-sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("turn", "label", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = arrow_text(batch.column("text"))
            ks, vs = [], []
            for i, j in slices(off):
                k, row = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.searchsorted(row, np.arange(j - i + 1))
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    u, c = np.unique(k[a:b], return_counts=True)
                    ks.append(u.astype(np.int32).tobytes())
                    vs.append((c * (SCALE / max(1, b - a))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("label"), pa.array(ks, pa.binary()), pa.array(vs, pa.binary())], ["turn", "label", "k", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ((np.frombuffer(k, np.int32), np.frombuffer(v, np.float32), y) for b in batches for k, v, y in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), b.column("label").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train(seen).tobytes()], pa.binary())], ["model"])

    ready = texts.mapInArrow(sparse, "turn long, label int, k binary, v binary")
    ready = ready.withColumn("epoch", F.explode(F.array(*(F.lit(k) for k in range(EPOCHS)))))
    # one task, which streams over at most `most` rows, once for each epoch, and holds the weights only
    model = ready.repartition(1).sortWithinPartitions("epoch", "turn", "label", "k").mapInArrow(fit, "model binary").first()
    return np.frombuffer(model[0], np.float32) if model else np.zeros((1 << LOG2) + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs with score and predicted; columns of those names are replaced."""
    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", scoring(docs, model)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scoring(docs: DataFrame, model: np.ndarray) -> Column:
    """The score of a row of docs by its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        w = shared.value
        buf, off = arrow_text(pa.array(texts, pa.string()))
        out = np.zeros(len(texts))
        for i, j in slices(off):
            k, row = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.bincount(row, minlength=j - i)
            out[i:j] = np.bincount(row, w[k], j - i) * (SCALE / np.maximum(n, 1)) + float(w[-1])
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return scores(F.coalesce("text", F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
