"""Mutations and versions of a list: last-wins dedupe, log folding, live view, compaction, deltas, status; and lists on disk."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.search import ListConfig, Segment, Snapshot, meet, search
from . import files, index

ROW = ("id", "keys", "payload")
ENTRY = "id string, keys array<string>, payload string"
LOG = f"seq long, op string, {ENTRY}"
#: Fixed rule: what a list may be called.
NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}\Z")


def content() -> Column:
    """An entry's hash."""
    return F.sha2(F.to_json(F.struct(*ROW)), 256)


def dedupe_last(rows: DataFrame) -> DataFrame:
    """The last row (by seq, and of equal ones the largest) of each id; seq keeps their order."""
    rest = [c for c in rows.columns if c not in ("id", "seq")]
    tie = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return rows.groupBy("id").agg(F.max_by(F.struct("seq", *rest), F.struct("seq", tie)).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in rows.columns if c != "id"))


def fold(log: DataFrame) -> DataFrame:
    """The last operation of each id in a log (seq, op, id, keys, payload); unknown ones and upserts without keys don't count. Of
    operations with one seq an upsert comes after a delete, and of upserts the larger entry."""
    fine = log.where("id IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND keys IS NOT NULL)")
    last = F.struct("seq", "op", F.to_json(F.struct("keys", "payload")))
    return fine.groupBy("id").agg(F.max_by(F.struct("op", "keys", "payload"), last).alias("r")).select("id", "r.*")


def live(base: DataFrame, folded: DataFrame) -> DataFrame:
    """Base rows that the log leaves alone, and its upserts."""
    kept = meet(base.select(*ROW), folded.select("id"), "id", "left_anti")
    return kept.unionByName(folded.where("op = 'upsert'").select(*ROW))


def overlay(folded: DataFrame) -> DataFrame:
    """The log's upserts as entries; ordinals follow the ids. An overlay is small against its base, and numbered in one task."""
    return folded.where("op = 'upsert'").select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("ord"), *ROW)


def tombstones(base: DataFrame, folded: DataFrame) -> DataFrame:
    """(id) of base entries that the log deletes or supersedes."""
    return meet(base.select("id"), folded.select("id"), "id", "left_semi")


def snapshot(base: Segment, folded: DataFrame, c: ListConfig) -> Snapshot:
    return Snapshot(base, Segment.of(overlay(folded), c), tombstones(base.entries, folded))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, op): add, update or delete from old to new."""
    return changes(old, new).select("id", "op")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, id, keys, payload, nth): from old to new, with the new entry of adds and updates. nth sorts adds and updates in the
    order of new, deletes after them in that of old, where these have an ord."""
    nth = lambda df: F.col("ord").cast("long") if "ord" in df.columns else F.lit(None).cast("long")
    a = old.select("id", content().alias("a"), nth(old).alias("was"))
    b = new.select(*ROW, content().alias("b"), nth(new).alias("at"))
    both = a.join(b, "id", "full_outer")
    op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    found = both.withColumn("op", op).where("op IS NOT NULL")
    return found.select("op", *ROW, F.when(F.col("op") == "delete", F.struct(F.lit(1).alias("kind"), F.col("was").alias("at"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("at"))).alias("nth"))


def write_delta(found: DataFrame, path: str) -> None:
    """changes() as JSON lines in order: {op, id} of deletes, {op, id, entry} of the others."""
    entry = F.when(F.col("op") != "delete", F.struct(*ROW))
    found.orderBy("nth", "id").select("op", "id", entry.alias("entry")).write.mode("overwrite").json(path)


def collapse(rows: DataFrame) -> DataFrame:
    """One row per id with how many equal ones went; ids with rows that differ have conflict."""
    return rows.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("collapsed"), (F.countDistinct(content()) > 1).alias("conflict"))


class Conflict(ValueError):
    pass


def collapsed(rows: DataFrame) -> DataFrame:
    """The first (by seq) of equal rows of an id. Rows of one id that differ are an error that names the first of them."""
    told = rows.groupBy("id").agg(F.countDistinct(content()).alias("n"), F.min("seq").alias("seq"), F.min_by(F.struct("keys", "payload"), "seq").alias("r"))
    bad = told.where("n > 1").orderBy("seq").first()
    if bad:
        raise Conflict(f"entry {bad.id!r} of record {bad.seq} comes again with other content")
    return told.select("seq", "id", "r.*")


def status(base: DataFrame, folded: DataFrame) -> DataFrame:
    """One row: entries, overlay, tombstones and raw keys."""
    rows = live(base, folded).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).cast("long").alias("keys"))
    over = folded.agg(F.count_if(F.col("op") == "upsert").alias("overlay"))
    dead = tombstones(base, folded).agg(F.count(F.lit(1)).alias("tombstones"))
    return rows.crossJoin(over).crossJoin(dead)  # one row each


class Stale(RuntimeError):
    pass


class Lists:
    """Named lists below a folder. A list is a pointer to an immutable base version and a log of mutations after it: a change
    writes beside what is there and then moves the pointer, so readers see one version or the next, and a failed one leaves the old.

    name/current.json: {version, generation, config, hash, prev}; name/<version>/: index and entries; name/log-<version>/seq=N: log.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        """Of all lists that have a pointer: a folder without is what a broken creation left."""
        return [n for n in files.names(self.spark, self.root) if NAME.match(n) and files.exists(self.spark, f"{self.root}/{n}/current.json")]

    def damaged(self) -> list[str]:
        return [n for n in files.names(self.spark, self.root) if not files.exists(self.spark, f"{self.root}/{n}/current.json")]

    def pointer(self, name: str) -> dict:
        raw = files.read_text(self.spark, f"{self.root}/{name}/current.json") if NAME.match(name) else None
        if raw is None:
            raise KeyError(f"no such list: {name}")
        return json.loads(raw)

    def config(self, name: str) -> ListConfig:
        own = self.pointer(name)["config"]
        return ListConfig(**(own | {"steps": own["steps"] if isinstance(own["steps"], str) else tuple(own["steps"]), "sizes": tuple(own["sizes"]), "golden": tuple(own["golden"])}))

    def create(self, name: str, c: ListConfig) -> str:
        """An empty list; one of that name is wiped."""
        if not NAME.match(name):
            raise ValueError(f"{name!r} is no name for a list")
        return self._install(name, c, self.spark.createDataFrame([], f"seq long, {ENTRY}"))

    def replace(self, name: str, entries: DataFrame) -> str:
        """entries (seq, id, keys, payload), of each id the last, are the list; the log is empty. Returns the version stamp."""
        return self._install(name, self.config(name), dedupe_last(entries.select("seq", *ROW)))

    def _install(self, name: str, c: ListConfig, rows: DataFrame, order: str = "seq") -> str:
        version = uuid.uuid4().hex
        where = f"{self.root}/{name}/{version}"
        entries = index.numbered(rows.select(*{order, *ROW}), f"{where}/order", order).select("ord", *ROW)
        index.build(self.spark, entries, c, where)
        files.remove(self.spark, f"{where}/order")
        old = files.read_text(self.spark, f"{self.root}/{name}/current.json")
        generation = json.loads(old)["generation"] + 1 if old else 1
        found = self.spark.read.parquet(f"{where}/entries")
        pointer = {"version": version, "generation": generation, "config": asdict(c), "hash": table_hash(found), "entries": found.count(), "prev": json.loads(old)["hash"] if old else None}
        files.write_text(self.spark, f"{self.root}/{name}/current.json", json.dumps(pointer))
        return self.stamp(name)

    def log(self, name: str) -> DataFrame:
        p = self.pointer(name)
        where = f"{self.root}/{name}/log-{p['version']}"
        if not files.names(self.spark, where):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(where)

    def _append(self, name: str, rows: DataFrame, generation: int | None) -> str:
        p = self.pointer(name)
        if generation is not None and generation != p["generation"]:
            raise Stale(f"list {name} is of generation {p['generation']}, not {generation}")
        where = f"{self.root}/{name}/log-{p['version']}"
        seq = max([int(x.partition("=")[2]) for x in files.names(self.spark, where) if x.startswith("seq=")], default=0) + 1
        rows.withColumn("seq", F.lit(seq).cast("long")).select("op", *ROW).write.parquet(f"{where}/.new-{seq}")
        fs, new = files.place(self.spark, f"{where}/.new-{seq}")
        if not fs.rename(new, files.place(self.spark, f"{where}/seq={seq}")[1]):
            raise Stale(f"another writer was first in list {name}")
        limit = self.config(name).overlay_auto_compact
        if limit and fold(self.log(name)).where("op = 'upsert'").count() >= limit:
            self.compact(name)
        return self.stamp(name)

    def upsert(self, name: str, entries: DataFrame, generation: int | None = None) -> str:
        """Puts entries (id, keys, payload, and seq where an id repeats) over those of their ids. With a generation, only if
        nobody replaced the list since."""
        bad = entries.where("id IS NULL OR id = '' OR keys IS NULL OR octet_length(to_json(struct(id, keys, payload))) >= 1048576").limit(1).count()
        if bad:
            raise ValueError("an entry needs an id and keys, and has less than 1 MiB")
        rows = dedupe_last(entries.select("seq", *ROW)).drop("seq") if "seq" in entries.columns else entries.select(*ROW)
        return self._append(name, rows.withColumn("op", F.lit("upsert")), generation)

    def delete(self, name: str, ids: list[str], generation: int | None = None) -> str:
        rows = self.spark.createDataFrame([(x,) for x in ids], "id string").select(F.lit("delete").alias("op"), "id", F.lit(None).cast("array<string>").alias("keys"), F.lit(None).cast("string").alias("payload"))
        return self._append(name, rows, generation)

    def compact(self, name: str) -> str:
        """The live entries, by id, are the new base; weights are of them, so scores may move."""
        return self._install(name, self.config(name), self.live(name), order="id")

    def base(self, name: str) -> Segment:
        return index.load(self.spark, f"{self.root}/{name}/{self.pointer(name)['version']}", self.config(name))

    def live(self, name: str) -> DataFrame:
        return live(self.base(name).entries, fold(self.log(name)))

    def open(self, name: str) -> tuple[Snapshot, ListConfig, str]:
        """One snapshot of the list, its settings and its stamp."""
        c, log = self.config(name), self.log(name)
        base = self.base(name)
        at = snapshot(base, fold(log), c) if log.columns and not log.isEmpty() else Snapshot(base)
        return at, c, self.stamp(name)

    def query(self, name: str, queries: DataFrame, flt=None) -> DataFrame:
        """search() of the list as it is, each row with the version that answers."""
        at, c, version = self.open(name)
        return search(queries, at, c, flt).withColumn("version", F.lit(version))

    def stamp(self, name: str) -> str:
        """Equal for equal state and settings, and only then: the base's hash and size, the log's, and the settings'."""
        p, log = self.pointer(name), self.log(name)
        n = log.count()
        return f"{p['hash']}@{p['entries']}+j{n}{'.' + table_hash(log, 'log') if n else ''}+c{index.config_digest(self.config(name))}"

    def status(self, name: str) -> DataFrame:
        at, c, version = self.open(name)
        folded = fold(self.log(name))
        return status(at.base.entries, folded).crossJoin(index.losses(self.live(name), c)).withColumns({"name": F.lit(name), "mode": F.lit(c.mode), "version": F.lit(version)})  # one row each

    def publish(self, name: str, bundle: str, c: ListConfig) -> DataFrame:
        """A bundle's entries are the list. A list with mutations of its own refuses it; golden probes are returned as they came out."""
        if name in self.names() and not self.log(name).isEmpty():
            raise Stale(f"list {name} has changes that the bundle lacks")
        rows = self.spark.read.parquet(f"{bundle}/base/entries")
        self._install(name, c, rows, order="ord")
        return self.probe(name)

    def probe(self, name: str) -> DataFrame:
        """(q, expect_id, absent, min_score, passed) of the list's golden probes."""
        at, c, _ = self.open(name)
        return probes(at, c, self.spark)


def probes(at: Snapshot, c: ListConfig, spark: SparkSession) -> DataFrame:
    rows = [(i, p["q"], p.get("expect_id"), bool(p.get("absent")), float(p.get("min_score", 0))) for i, p in enumerate(c.golden)]
    asked = spark.createDataFrame(rows, "query_id int, q string, expect_id string, absent boolean, min_score double")
    return judged(asked, search(asked.select("query_id", "q"), at, c, with_keys=False)).drop("query_id")


def judged(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """asked (query_id, expect_id, absent, min_score) with passed: the expected id is among the hits with that score, or none is."""
    best = hits.groupBy("query_id").agg(F.collect_list(F.struct("entry_id", "score")).alias("hits"))
    found = F.exists("hits", lambda x: (x["entry_id"] == F.col("expect_id")) & (x["score"] >= F.col("min_score")))
    none = F.coalesce(~F.exists("hits", lambda x: x["score"] >= F.col("min_score")), F.lit(True))
    return meet(asked, best, "query_id", "left").withColumn("passed", F.when(F.col("absent"), none).otherwise(F.coalesce(found, F.lit(False)))).drop("hits")


def table_hash(rows: DataFrame, kind: str = "base") -> str:
    """SHA-256 over the rows' own, in an order that only the rows decide. Rows are hashed in Spark; each range's hashes are put
    together there, and the driver gets one hash per 2**12 ranges of hashes."""
    one = rows.select(F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    for n in (6, 3):  # of each of 2**24 ranges of hashes, then of each of 2**12
        one = one.groupBy(F.substring("h", 1, n).alias("p")).agg(F.array_join(F.sort_array(F.collect_list("h")), "").alias("all"))
        one = one.select(F.concat("p", F.sha2("all", 256)).alias("h"))
    return index.digest(kind, *(r.h for r in one.orderBy("h").collect()))  # at most 4096 rows
