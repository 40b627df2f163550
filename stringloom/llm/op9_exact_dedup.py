"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts how often each slot of a Bloom filter with two hash functions is set. The filter has some 128 slots a row, so
slots that are set twice are few but for copies; they are folded to a filter of at most 2**most bits, which is broadcast. In
pass 2 a row whose two bits are not both set there has no copy: it passes straight through. Only the others shuffle. Beyond the
folded filter's capacity, some 2**(most - 2) groups of copies, more rows shuffle and the result stays the same. Each text is
hashed once, by SHA-256: what follows reads the hash.

Defined results: a null text counts as empty. Rows with a null doc_id take part and stand below every other id. Rows that
share doc_id and text all count in group_size and are kept or dropped together. Columns of the input named like a result
are replaced; all others are carried along. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stage, table

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def hashed(docs: DataFrame) -> DataFrame:
    """docs with text_sha256, the hash of the normalised text."""
    return docs.drop(*RESULT).withColumn("text_sha256", F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256))


def exact_dedup(docs: DataFrame, most: int = 26, heavy: int = 1000) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256."""
    return grouped(hashed(docs), most, heavy)


def grouped(rows: DataFrame, most: int = 26, heavy: int = 1000) -> DataFrame:
    """hashed() rows with keep_id, group_size and kept.

    heavy: that many largest groups of copies are joined by broadcast, so no key left to the shuffled join holds more than
    one row in `heavy`.
    """
    rows = stage(rows, "op9-rows")
    log2 = min(60, max(10, rows.count().bit_length() + 7))
    slot = [F.pmod(F.xxhash64(F.lit(seed), F.col("text_sha256")), F.lit(1 << log2)) for seed in (1, 2)]
    twice = rows.select(F.explode(F.array(*slot)).alias("slot")).groupBy("slot").count().where("count > 1")
    fold = F.lit((1 << min(log2, most)) - 1)
    words = twice.select(F.col("slot").bitwiseAND(fold).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    words = stage(words, "op9-bloom")

    flagged = rows.withColumns({"__s1": slot[0].bitwiseAND(fold), "__s2": slot[1].bitwiseAND(fold)})
    for k in ("1", "2"):  # at most 2**(most - 6) rows
        bits = F.broadcast(words.select(F.col("word").alias(f"__w{k}"), F.col("bits").alias(f"__b{k}")))
        flagged = flagged.join(bits, F.shiftright(f"__s{k}", 6) == F.col(f"__w{k}"), "left")
    hit = [f"coalesce(__b{k} & shiftleft(1L, cast(__s{k} & 63 AS int)), 0L) != 0" for k in "12"]
    names = rows.columns
    suspect = flagged.where(" AND ".join(hit)).select(*(F.col(f"`{c}`") for c in names))
    single = flagged.where(f"NOT ({' AND '.join(hit)})").select(*(F.col(f"`{c}`") for c in names))

    groups = stage(suspect.groupBy(F.col("text_sha256").alias("__sha")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "op9-groups")
    large = groups.orderBy(F.desc("group_size"), "__sha").limit(heavy)  # `heavy` rows
    first = suspect.join(F.broadcast(large), F.col("text_sha256") == F.col("__sha"), "left")
    done = first.where("__sha IS NOT NULL").drop("__sha")
    rest = first.where("__sha IS NULL").select(*(F.col(f"`{c}`") for c in names)).join(groups, F.col("text_sha256") == F.col("__sha")).drop("__sha")
    out = done.unionByName(rest).unionByName(single.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(hashed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")).select("doc_id", *RESULT)


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
