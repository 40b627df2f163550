"""What a list's lookups need, written once: gram statistics, postings clustered by gram, and each entry's grams; or exact keys."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import analyze, steps_of
from ..plans.search import ListConfig, Segment, entry_grams, exact_keys, gram_tables
from . import files

#: Fixed limit: entries that may share an exact key.
SHARED = (1 << 20) - 1


def digest(*parts: str) -> str:
    """SHA-256 of parts, each after its length."""
    h = hashlib.sha256()
    for x in parts:
        raw = x.encode()
        h.update(str(len(raw)).encode() + b":" + raw)
    return h.hexdigest()


def index_digest(c: ListConfig) -> str:
    """Of the settings that an index depends on: mode, grams, spaces and analyser steps."""
    return digest("index", c.mode, json.dumps([list(c.sizes), c.strip_spaces] if c.mode == "ngram" else []), *steps_of(c.steps))


def config_digest(c: ListConfig) -> str:
    """Of all settings, resolved: presets by their steps, defaults by their values."""
    own = asdict(c) | {"steps": list(steps_of(c.steps)), "threshold": c.floor, "topk": c.k, "fields": dict(sorted(c.fields.items()))}
    return digest("config", json.dumps(own, sort_keys=True, default=list))


def numbered(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """rows with ord, 0 and up in the given order, by way of a table at path. A partition's rows are counted before they are
    numbered, so no task sorts more than its range."""
    spark = rows.sparkSession
    laid = rows.drop("ord").repartitionByRange(*order).sortWithinPartitions(*order)
    laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.mode("overwrite").parquet(path)
    laid = spark.read.parquet(path)
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).drop("n")  # a row per partition
    return laid.join(F.broadcast(before), "__part").withColumn("ord", F.col("before") + F.col("__at")).drop("__part", "__at", "before")


def build(spark: SparkSession, entries: DataFrame, c: ListConfig, path: str) -> dict:
    """Writes the index of entries (ord, id, keys, payload) below path and returns its manifest."""
    entries.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/entries")
    rows = spark.read.parquet(f"{path}/entries")
    if c.mode == "exact":
        keys = exact_keys(rows, c)
        hot = keys.groupBy("a").count().where(F.col("count") > SHARED).orderBy("a").first()
        if hot:
            raise ValueError(f"key {hot.a!r} is on {hot['count']} entries")
        keys.repartitionByRange("a").sortWithinPartitions("a", "ord").write.mode("overwrite").parquet(f"{path}/keys")
    else:
        entry_grams(rows, c).write.mode("overwrite").parquet(f"{path}/grams")
        found = spark.read.parquet(f"{path}/grams")
        stats, _, _ = gram_tables(found)
        stats.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/stats")
        coded = found.join(spark.read.parquet(f"{path}/stats").select("gram", "code"), "gram").select("code", "ord")
        coded.repartitionByRange("code").sortWithinPartitions("code", "ord").write.mode("overwrite").parquet(f"{path}/postings")
        coded.groupBy("ord").agg(F.sort_array(F.collect_list("code")).alias("codes")).write.mode("overwrite").parquet(f"{path}/sets")
        files.remove(spark, f"{path}/grams")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("keys")).first()
    manifest = {"index": index_digest(c), "config": config_digest(c), "entries": size.n, "keys": size["keys"], "last": -1 if size["last"] is None else size["last"]}
    files.write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def load(spark: SparkSession, path: str, c: ListConfig) -> Segment:
    """The segment at path. An index is only a cache: one of other settings, or that does not fit its entries, is not used, and the
    segment derives its tables from the entries."""
    entries = spark.read.parquet(f"{path}/entries")
    raw = files.read_text(spark, f"{path}/manifest.json")
    manifest = json.loads(raw) if raw else {}
    if manifest.get("index") != index_digest(c) or not fits(spark, path, c, manifest):
        return Segment.of(entries, c)
    if c.mode == "exact":
        return Segment(entries, keys=spark.read.parquet(f"{path}/keys"))
    return Segment(entries, *(spark.read.parquet(f"{path}/{x}") for x in ("stats", "postings", "sets")))


def fits(spark: SparkSession, path: str, c: ListConfig, manifest: dict) -> bool:
    """No ordinal of the index is beyond the entries it was made of."""
    table = "keys" if c.mode == "exact" else "sets"
    try:
        last = spark.read.parquet(f"{path}/{table}").agg(F.max("ord")).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return (last if last is not None else -1) <= manifest["last"]


def losses(entries: DataFrame, c: ListConfig) -> DataFrame:
    """One row: keys that analysis leaves empty, and entries with keys that have none left."""
    left = F.transform("keys", lambda k: analyze(k, c.steps) == "")
    gone = entries.select(F.size("keys").alias("n"), F.size(F.filter(left, lambda x: x)).alias("empty"))
    return gone.agg(F.coalesce(F.sum("empty"), F.lit(0)).cast("long").alias("dropped_keys"), F.count_if((F.col("n") > 0) & (F.col("n") == F.col("empty"))).alias("keyless_entries"))


def key_count(entries: DataFrame) -> DataFrame:
    """One row: raw keys, and different ones."""
    keys = entries.select(F.explode("keys").alias("key"))
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.countDistinct("key").alias("distinct_keys"))


def unindexed(entries: DataFrame, manifest: dict) -> int:
    """Entries that a stale index does not know."""
    return max(0, entries.count() - manifest["entries"])
