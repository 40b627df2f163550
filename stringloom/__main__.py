"""python -m stringloom gen | bench | ingest | build | query | keygen: what the modules do, from a shell."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.filters import flag_filter
from .operators.store import Lists
from .plans import generate
from .plans.search import ListConfig, Segment, Snapshot, answered
from .service.govern import new_key
from .sources import mapping


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="stringloom")
    sub = top.add_subparsers(dest="command", required=True)
    gen = sub.add_parser("gen", help="names and disturbed queries, as JSON and CSV")
    gen.add_argument("--n", type=int, default=100_000)
    gen.add_argument("--sample", type=int, default=200)
    gen.add_argument("--seed", type=int, default=42)
    gen.add_argument("out")
    bench = sub.add_parser("bench", help="recall and throughput of what gen wrote")
    bench.add_argument("--threshold", type=float, default=0.6)
    bench.add_argument("dir")
    ingest = sub.add_parser("ingest", help="what a build of a feed would meet")
    ingest.add_argument("--limit", type=int, default=0)
    ingest.add_argument("--max-empty-rate", type=float, default=1.0)
    build = sub.add_parser("build", help="a feed as a bundle")
    build.add_argument("--prev")
    build.add_argument("--out", required=True)
    for p in (ingest, build):
        p.add_argument("--skip-bad", type=int, default=0)
        p.add_argument("mapping")
        p.add_argument("feed")
    query = sub.add_parser("query", help="lookups in a list, as JSON lines")
    query.add_argument("--threshold", type=float, default=0.0)
    query.add_argument("--topk", type=int, default=0)
    query.add_argument("--filter", action="append", default=[])
    query.add_argument("--stats", action="store_true")
    query.add_argument("root")
    query.add_argument("list")
    query.add_argument("q", nargs="+")
    sub.add_parser("keygen", help="an API key and its digest")
    a = top.parse_args(args)
    if a.command == "keygen":
        print(*new_key(), sep="\n")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "gen":
        names = generate.names(spark, a.n, a.seed)
        names.write.mode("overwrite").json(f"{a.out}/entries")
        generate.cases(names, a.sample, a.seed).select(F.col("q").alias("query"), "truth_id", "category").write.mode("overwrite").csv(f"{a.out}/corpus", header=True)
    elif a.command == "bench":
        entries = spark.read.schema("ord long, id string, keys array<string>").json(f"{a.dir}/entries")
        header = spark.read.text(f"{a.dir}/corpus").first()[0]
        if header != "query,truth_id,category":
            raise ValueError(f"a corpus begins with query,truth_id,category, not {header!r}")
        asked = spark.read.csv(f"{a.dir}/corpus", header=True, schema="q string, truth_id string, category string").withColumn("query_id", F.concat_ws(":", "category", "truth_id"))
        c = ListConfig("person-name", threshold=a.threshold, strip_spaces=True)
        began = time.time()
        rows = generate.recall(asked, Snapshot(Segment.of(entries, c)), c).collect()
        took = time.time() - began
        print(json.dumps({"seconds": round(took, 3), "queries": sum(r.cases for r in rows if r.category != "OVERALL"), "recall": {r.category: round(r.recall, 4) for r in rows}}))
    elif a.command in ("ingest", "build"):
        with open(a.mapping, encoding="utf-8") as raw:
            m = mapping.Mapping.parse(raw.read())
        if a.command == "build":
            print(json.dumps(mapping.build(spark, a.feed, m, a.out, a.skip_bad, a.prev), sort_keys=True))
            return 0
        mapped = mapping.parse(spark, a.feed, m)
        mapping.entries(mapped, a.skip_bad)
        told, samples = mapping.dry_run(mapped, m.config, a.limit)
        row = told.first().asDict()
        print(json.dumps(row | {"samples": [r.asDict() for r in samples.collect()]}, ensure_ascii=False))
        return int(row["empty_key_rate"] > a.max_empty_rate)
    else:
        at, c, version = Lists(spark, a.root).open(a.list)
        rows = [(str(i), q, a.threshold, a.topk) for i, q in enumerate(a.q)]
        hits, stats = answered(spark.createDataFrame(rows, "query_id string, q string, threshold double, topk int"), at, c, flag_filter(a.filter))
        for line in hits.withColumn("version", F.lit(version)).orderBy("query_id", F.desc("score"), "entry_id").toJSON().toLocalIterator():
            print(line)
        if a.stats:
            print(json.dumps([r.asDict() for r in stats.collect()]), file=sys.stderr)  # a row per query given
    return 0


if __name__ == "__main__":
    sys.exit(main())
