"""Feeds to entries: NDJSON, CSV and XML read strictly, and declarative rules over their records.

A record is a JSON document, or a row of text columns for CSV, whose names are taken as they are. Paths of documents go by dots
and fan out at every repeated level. Rows are compiled to Columns; documents are mapped in one Arrow UDF, since no built-in
function keeps the digits of numbers and walks documents without a schema.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import Number, _Pairs, load
from ..functions.text import SPACE, analyze
from ..operators import files, index, store
from ..plans.search import ListConfig

# Fixed limits: bytes of a record and of a CSV header, columns, and CSV columns beyond the header that are looked at.
RECORD, COLUMNS, BEYOND = 1 << 20, 1024, 32
#: Bytes of memory per key in a dry run's estimate.
PER_KEY = {"ngram": 114, "exact": 133}
MAPPED = "status string, reason string, id string, keys array<string>, payload string"
_BLANK = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class MappingError(ValueError):
    pass


class BadRecord(ValueError):
    pass


@dataclass(frozen=True)
class KeyRule:
    """One key per instance, which is what the deepest path that all paths and conditions share resolves to: the first value of
    each path, joined, if the instance meets the conditions ('*': any value); split, one key per piece."""

    paths: tuple[str, ...]
    join: str = " "
    where: tuple[tuple[str, str], ...] = ()
    split: str = ""


@dataclass(frozen=True)
class Mapping:
    """ids: the paths of an id; several are joined, empty ones too. single_id: the first value that is not empty is the id."""

    ids: tuple[str, ...]
    keys: tuple[KeyRule, ...]
    id_join: str = "|"
    where: tuple[tuple[str, str], ...] = ()
    payload: tuple[tuple[str, str], ...] = ()
    format: str = "csv"
    record: str = ""
    delimiter: str = ""
    single_id: bool = False
    config: ListConfig = field(default_factory=ListConfig)

    def __post_init__(self):
        if self.format not in ("ndjson", "csv", "xml"):
            raise MappingError(f"unknown format {self.format!r}")
        if (self.format == "xml") != bool(self.record):
            raise MappingError("xml needs the name of its record element, and no other format has one")
        if self.delimiter and (self.format != "csv" or len(self.delimiter) != 1):
            raise MappingError("a delimiter is one character, of csv only")
        if not self.ids or not all(self.ids) or self.single_id and len(self.ids) > 1:
            raise MappingError("an id needs paths")
        if not self.keys:
            raise MappingError("at least one key rule")
        for i, rule in enumerate(self.keys):
            if not rule.paths or not all(rule.paths) or not all(p for p, _ in rule.where):
                raise MappingError(f"keys[{i}]: empty path")
            if rule.split and len(rule.paths) > 1:
                raise MappingError(f"keys[{i}]: a split is of one path")
        if not all(p for p, _ in self.where) or not all(n and p for n, p in self.payload):
            raise MappingError("empty path")

    @staticmethod
    def parse(text: str) -> Mapping:
        """From JSON: format, record, delimiter, where, id or id_paths, id_join, keys of path or paths, join, where, split; payload."""
        raw = json.loads(text)
        if not isinstance(raw, dict):
            raise MappingError("a mapping is an object")
        extra = set(raw) - {"format", "record", "delimiter", "where", "id", "id_paths", "id_join", "keys", "payload", "list"}
        if extra:
            raise MappingError(f"unknown: {', '.join(sorted(extra))}")
        if bool(raw.get("id")) == bool(raw.get("id_paths")):
            raise MappingError("either id or id_paths")
        rules = []
        for i, k in enumerate(raw.get("keys", ())):
            if bool(k.get("path")) == bool(k.get("paths")):
                raise MappingError(f"keys[{i}]: either path or paths")
            rules.append(KeyRule((k["path"],) if k.get("path") else tuple(k["paths"]), k.get("join", " "), tuple(k.get("where", {}).items()), k.get("split", "")))
        ids = (raw["id"],) if raw.get("id") else tuple(raw["id_paths"])
        own = raw.get("list", {})
        an, match = own.get("analyzer", {}), own.get("match", {})
        c = ListConfig(tuple(an["steps"]) if an.get("steps") else an.get("preset") or "free-text", match.get("mode") or "ngram", tuple(match.get("grams") or (2, 3)), match.get("strip_spaces", False), match.get("threshold"), match.get("topk"), match.get("fallback", ""), {x["name"]: x["path"] for x in own.get("filterable", ())}, tuple(own.get("golden", ())), own.get("overlay_auto_compact", 0))
        return Mapping(ids, tuple(rules), raw.get("id_join", "|"), tuple(raw.get("where", {}).items()), tuple(raw.get("payload", {}).items()), raw.get("format", ""), raw.get("record", ""), raw.get("delimiter", ""), bool(raw.get("id")), c)


# --- rows of columns ---


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def _value(path: str) -> Column:
    return stripped(F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")))


def _holds(where: tuple[tuple[str, str], ...]) -> Column:
    ok = F.lit(True)
    for path, value in where:
        ok = ok & ((_value(path) != "") if value == "*" else (_value(path) == value))
    return ok


def _keys(rule: KeyRule) -> Column:
    joined = stripped(F.array_join(F.filter(F.array(*map(_value, rule.paths)), lambda x: x != ""), rule.join))
    out = F.transform(F.split(joined, "\\Q" + rule.split + "\\E"), stripped) if rule.split else F.array(joined)
    return F.when(_holds(rule.where), F.filter(out, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def map_records(rows: DataFrame, m: Mapping) -> DataFrame:
    """(record, status, reason, id, keys, payload) of rows of columns: filtered, bad (no id, no keys, or too large) or ok. A record
    that `where` leaves out is never bad for what it lacks, but one that could not be read is (_bad)."""
    parts = [_value(p) for p in m.ids]
    ident = F.when(F.concat(*parts) == "", None).otherwise(F.concat_ws(m.id_join, *parts))
    keys = F.array_distinct(F.concat(*map(_keys, m.keys)))
    fields = sorted(m.payload)
    payload = F.to_json(F.struct(*(F.nullif(_value(p), F.lit("")).alias(n) for n, p in fields))) if fields else F.lit(None).cast("string")
    own = {x.lower() for x in rows.columns}
    unread = F.coalesce(F.col("_bad").cast("string"), F.lit("false")) if "_bad" in own else F.lit("false")
    record = F.col("_record") if "_record" in own else F.monotonically_increasing_id()
    got = rows.select(record.alias("record"), unread.alias("unread"), _holds(m.where).alias("holds"), ident.alias("id"), keys.alias("keys"), F.nullif(payload, F.lit("{}")).alias("payload"))
    large = F.octet_length(F.to_json(F.struct("id", "keys", "payload"))) >= RECORD
    reason = F.when(F.col("unread") != "false", F.when(F.col("unread") == "true", "not readable").otherwise(F.col("unread"))).when(~F.col("holds"), None)
    reason = reason.when(F.col("id").isNull(), "no id").when(F.size("keys") == 0, "no keys").when(large, "too large")
    status = F.when(F.col("unread") != "false", "bad").when(~F.col("holds"), "filtered").when(F.col("reason").isNotNull(), "bad").otherwise("ok")
    return got.withColumn("reason", reason).withColumn("status", status).select("record", "status", "reason", "id", "keys", "payload")


# --- documents ---


def _kids(x, name: str) -> list:
    if isinstance(x, _Pairs):
        found = [v for k, v in x if k == name][-1:]  # of equal names the last
        return [y for v in found for y in (v if isinstance(v, list) and not isinstance(v, _Pairs) else [v])]
    return [y for e in x for y in _kids(e, name)] if isinstance(x, list) else []


def _resolve(x, path: list[str]) -> list:
    at = [x]
    for name in path:
        at = [y for n in at for y in _kids(n, name)]
    return at


def _text(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, Number) else x.strip(_BLANK) if isinstance(x, str) else ""


def _texts(found: list) -> list[str]:
    return [t for t in map(_text, found) if t]


def _meets(x, where: list[tuple[list[str], str]], skip: int) -> bool:
    return all(any(t == want or want == "*" and t for t in map(_text, _resolve(x, path[skip:]))) for path, want in where)


def mapped_document(doc, m: Mapping) -> tuple:
    """(status, reason, id, keys, payload) of a parsed document."""
    split = lambda p: p.split(".")
    if not _meets(doc, [(split(p), v) for p, v in m.where], 0):
        return "filtered", None, None, None, None
    if m.single_id:
        ident = next(iter(_texts(_resolve(doc, split(m.ids[0])))), "")
        none = not ident
    else:
        parts = [_text(next(iter(_resolve(doc, split(p))), "")) for p in m.ids]
        ident, none = m.id_join.join(parts), not any(parts)
    if none:
        return "bad", "no id", None, None, None
    keys: dict[str, None] = {}
    for rule in m.keys:
        paths, where = [split(p) for p in rule.paths], [(split(p), v) for p, v in rule.where]
        every, n = paths + [p for p, _ in where], 0
        while all(len(p) > n and p[n] == every[0][n] for p in every):
            n += 1
        for x in _resolve(doc, every[0][:n]):
            if _meets(x, where, n):
                joined = rule.join.join(t[0] for t in (_texts(_resolve(x, p[n:])) for p in paths) if t).strip(_BLANK)
                keys.update((k.strip(_BLANK), None) for k in (joined.split(rule.split) if rule.split else [joined]) if k.strip(_BLANK))
    if not keys:
        return "bad", f"no keys (id {ident})", None, None, None
    found = ((n, _texts(_resolve(doc, split(p)))) for n, p in sorted(m.payload))
    own = {n: t[0] if len(t) == 1 else t for n, t in found if t}
    payload = json.dumps(own, ensure_ascii=False, separators=(",", ":")) if own else None
    if len(json.dumps([ident, list(keys), payload]).encode()) >= RECORD:
        return "bad", f"too large (id {ident})", None, None, None
    return "ok", None, ident, list(keys), payload


def map_documents(docs: DataFrame, m: Mapping) -> DataFrame:
    """(record, status, reason, id, keys, payload) of (record, doc): a doc is the text of one JSON document, null if too large."""

    @F.pandas_udf(MAPPED)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                if text is None:
                    raise ValueError("too large")
                doc = load(text)
            except (ValueError, RecursionError) as e:
                out.append(("bad", "too large" if text is None else f"not readable: {type(e).__name__}", None, None, None))
                continue
            out.append(mapped_document(doc, m))
        return pd.DataFrame(out, columns=["status", "reason", "id", "keys", "payload"])

    return docs.select("record", run("doc").alias("m")).select("record", "m.*")


# --- sources ---


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(record, doc): lines that are not blank. A line over 1 MiB has no doc. What is no JSON document, or more than one, the mapping
    calls bad."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("record"), "value").where(stripped(F.col("value")) != "")
    return lines.select("record", F.when(F.octet_length("value") <= RECORD, F.col("value")).alias("doc"))


def csv_header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    rows = spark.read.csv(path, sep=delimiter, header=False, multiLine=True, quote='"', escape='"').limit(1)
    found = rows.first()
    names = ["" if x is None else x.removeprefix("﻿") for x in found] if found else []
    own = [x for x in names if x]
    if not own:
        raise MappingError("the header names no column")
    if len(set(own)) != len(own):
        raise MappingError("the header names a column twice")
    if len(names) > COLUMNS or sum(len(x.encode()) + 1 for x in names) > RECORD:
        raise MappingError("the header is too large")
    return names


def read_csv(spark: SparkSession, path: str, names: tuple[str, ...] | None = None, delimiter: str = ",") -> DataFrame:
    """Columns as text under the header's names, whatever their order; shorter rows end in nulls. `names` must be among them.
    A row with data beyond the header, or over 1 MiB, is bad: _bad says why. _record numbers the rows."""
    header = csv_header(spark, path, delimiter)
    gone = [x for x in names or () if x not in header]
    if gone:
        raise MappingError(f"no column {', '.join(gone)}")
    inner = [f"c{i}" for i in range(len(header))] + [f"x{i}" for i in range(BEYOND)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*inner, "corrupt")])
    rows = spark.read.csv(path, schema=schema, sep=delimiter, header=True, multiLine=True, enforceSchema=True, quote='"', escape='"', columnNameOfCorruptRecord="corrupt", maxCharsPerColumn=16 * RECORD)
    wide = F.exists(F.array(*(F.col(x) for x in inner[len(header) :])), lambda x: F.coalesce(stripped(x), F.lit("")) != "")
    size = F.lit(0)
    for x in inner[: len(header)]:
        size = size + F.coalesce(F.octet_length(x), F.lit(0))
    bad = F.when(wide, "data beyond the header").when(size > RECORD, "too large").otherwise("false")
    own = [F.col(f"c{i}").alias(x) for i, x in enumerate(header) if x and (names is None or x in names)]
    return rows.select(F.monotonically_increasing_id().alias("_record"), *own, bad.alias("_bad"))


def xml_schema(paths: list[list[str]]) -> T.StructType:
    """Text at the ends of all paths; every level may repeat."""
    tree: dict = {}
    for p in paths:
        at = tree
        for name in p:
            at = at.setdefault(name, {})

    def of(node: dict) -> T.DataType:
        return T.StructType([T.StructField(n, T.ArrayType(of(x) if x else T.StringType())) for n, x in node.items()])

    return of(tree)


def read_xml(spark: SparkSession, path: str, m: Mapping) -> DataFrame:
    """(record, doc): the elements named m.record as JSON documents of what the mapping reads; attributes and namespaces are left
    out. One that is broken has a doc that is no JSON."""
    paths = [*m.ids, *(p for p, _ in m.where), *(p for _, p in m.payload), *(p for r in m.keys for p in (*r.paths, *(w for w, _ in r.where)))]
    schema = xml_schema([p.split(".") for p in paths])
    read = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.format("xml").options(rowTag=m.record, ignoreNamespace=True, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE").schema(read).load(path)
    doc = F.to_json(F.struct(*(F.col(f"`{x.name}`") for x in schema.fields)))
    return rows.select(F.monotonically_increasing_id().alias("record"), F.when(F.col("_corrupt").isNull(), doc).otherwise("broken").alias("doc"))


def parse(spark: SparkSession, path: str, m: Mapping) -> DataFrame:
    """(record, status, reason, id, keys, payload) of a feed."""
    if m.format == "csv":
        names = {*m.ids, *(p for p, _ in m.where), *(p for _, p in m.payload), *(p for r in m.keys for p in (*r.paths, *(w for w, _ in r.where)))}
        return map_records(read_csv(spark, path, tuple(sorted(names)), m.delimiter or ","), m)
    return map_documents(read_ndjson(spark, path) if m.format == "ndjson" else read_xml(spark, path, m), m)


def entries(mapped: DataFrame, skip_bad: int = 0) -> DataFrame:
    """(seq, id, keys, payload) of the records that are ok. More bad ones than skip_bad are an error that names the first."""
    bad = mapped.where("status = 'bad'")
    if bad.limit(skip_bad + 1).count() > skip_bad:
        first = bad.orderBy("record").first()
        part, at = first.record >> 33, first.record & ((1 << 33) - 1)
        before = mapped.where(F.shiftright("record", 33) < part).count()
        raise BadRecord(f"record {before + at + 1}: {first.reason}")
    return mapped.where("status = 'ok'").select(F.col("record").alias("seq"), "id", "keys", "payload")


def report(mapped: DataFrame) -> DataFrame:
    """One row: records, filtered, bad, distinct and repeated ids, raw keys."""
    ok = F.col("status") == "ok"
    return mapped.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("status") == "filtered").alias("filtered"),
        F.count_if(F.col("status") == "bad").alias("bad"),
        F.countDistinct(F.when(ok, F.col("id"))).alias("distinct_ids"),
        (F.count_if(ok) - F.countDistinct(F.when(ok, F.col("id")))).alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(ok, F.size("keys"))), F.lit(0)).cast("long").alias("raw_keys"),
    )


def dry_run(mapped: DataFrame, c: ListConfig, limit: int = 0, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row of what a build of the first `limit` good records (0: all) would meet, and the first `samples` of these entries."""
    if limit:  # the feature: a report on the head of a feed
        last = mapped.where("status = 'ok'").orderBy("record").limit(limit).agg(F.max("record").alias("last"), F.count(F.lit(1)).alias("n"))
        mapped = mapped.crossJoin(F.broadcast(last)).where((F.col("n") < limit) | (F.col("record") <= F.col("last"))).drop("last", "n")  # last has one row
    rows = mapped.withColumn("analyzed", F.transform("keys", lambda k: analyze(k, c.steps)))
    rows = rows.withColumn("left", F.filter("analyzed", lambda k: k != ""))
    ok = F.col("status") == "ok"
    total = lambda x: F.coalesce(F.sum(F.when(ok, x)), F.lit(0)).cast("long")
    out = rows.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(ok).alias("records"),
        F.count_if(F.col("status") == "filtered").alias("filtered"),
        F.count_if(F.col("status") == "bad").alias("bad"),
        F.countDistinct(F.when(ok, F.col("id"))).alias("distinct_ids"),
        (F.count_if(ok) - F.countDistinct(F.when(ok, F.col("id")))).alias("duplicate_ids"),
        total(F.size("keys")).alias("raw_keys"),
        total(F.size("left")).alias("analyzed_keys"),
        total(F.size("keys") - F.size("left")).alias("empty_keys"),
        F.count_if(ok & (F.size("left") == 0)).alias("keyless_entries"),
    )
    out = out.withColumn("empty_key_rate", F.when(F.col("raw_keys") > 0, F.col("empty_keys") / F.col("raw_keys")).otherwise(0.0))
    out = out.withColumn("est_memory_bytes", (F.col("analyzed_keys") * PER_KEY[c.mode]).cast("long"))
    return out, rows.where(ok).orderBy("record").limit(samples).select("id", "keys", F.col("left").alias("analyzed_keys"), "payload")


def build(spark: SparkSession, path: str, m: Mapping, out: str, skip_bad: int = 0, prev: str | None = None, created_at: str = "", version_id: str = "") -> dict:
    """A feed as a bundle below out: base (an index and its entries), with prev also the delta from that bundle, and last the manifest,
    which is returned. Equal records of an id count once; others of one id are an error."""
    if prev and files.read_text(spark, f"{prev}/manifest.json") is None:
        raise FileNotFoundError(f"{prev} is no bundle")
    for x in ("manifest.json", "base", "delta", "rows", "order"):
        files.remove(spark, f"{out}/{x}")
    found = entries(parse(spark, path, m), skip_bad)
    found.write.parquet(f"{out}/rows")
    found = spark.read.parquet(f"{out}/rows")
    own = index.numbered(store.collapsed(found), f"{out}/order", "seq").select("ord", *store.ROW)
    base = index.build(spark, own, m.config, f"{out}/base")
    rows = spark.read.parquet(f"{out}/base/entries")
    manifest = {"v": 1, "sha256": store.table_hash(rows), "collapsed": found.count() - base["entries"], "version_id": version_id, "steps": list(m.config.steps) if not isinstance(m.config.steps, str) else m.config.steps, "mode": m.config.mode, "config_sha256": base["config"], "entries": base["entries"], "keys": base["keys"], "source": path, "created_at": created_at}
    if prev:
        told = store.changes(spark.read.parquet(f"{prev}/base/entries"), rows)
        store.write_delta(told, f"{out}/delta")
        counts = {r.op: r["count"] for r in told.groupBy("op").count().collect()}  # three rows at most
        manifest |= {"prev_sha256": json.loads(files.read_text(spark, f"{prev}/manifest.json"))["sha256"], "delta": {f"{x}s": counts.get(x, 0) for x in ("add", "update", "delete")}}
    for x in ("rows", "order"):
        files.remove(spark, f"{out}/{x}")
    files.write_text(spark, f"{out}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest
