"""Streams: queries against a list as it is, mutations into a list, and standing queries against what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Lists
from ..plans.search import ListConfig, Segment, Snapshot, search

#: Entries of a micro-batch of mutations, as far as files allow.
BATCH = 10_000


def match_stream(queries: DataFrame, entries: DataFrame, config: ListConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the hits of each micro-batch of queries (query_id, q) to `out`, until the input is read."""

    def batch(df: DataFrame, number: int) -> None:
        at = Snapshot(Segment.of(entries, config))
        search(df, at, config).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def list_stream(queries: DataFrame, lists: Lists, name: str, out: str, checkpoint: str) -> StreamingQuery:
    """As match_stream, against a list on disk: each micro-batch reads its pointer once and sees one version."""

    def batch(df: DataFrame, number: int) -> None:
        lists.query(name, df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(entries: DataFrame, lists: Lists, name: str, checkpoint: str) -> StreamingQuery:
    """Puts a stream of entries (id, keys, payload) into a list, each micro-batch whole or not at all. It fails once the list is
    replaced by others, with what came before in place; putting a batch twice changes nothing."""
    generation = lists.pointer(name)["generation"]

    def batch(df: DataFrame, number: int) -> None:
        df = df.withColumn("seq", F.monotonically_increasing_id())
        lists.upsert(name, df, None if lists.config(name).overlay_auto_compact else generation)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recheck_stream(deltas: DataFrame, standing: DataFrame, config: ListConfig, out: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch of delta records (op, id, entry), the hits of standing queries among the entries that came or changed."""

    def batch(df: DataFrame, number: int) -> None:
        rows = df.where("op != 'delete'").select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("ord"), "entry.*")  # a delta is small
        search(standing, Snapshot(Segment.of(rows, config)), config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return deltas.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends mutations (seq, op, id, keys, payload) to the log, each batch a file set of its own."""
    return changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
