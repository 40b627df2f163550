"""Lists on disk, ingest, governance, generated names and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stringloom import __main__ as cli
from stringloom.functions.filters import FilterError, TypedFilter, flag_filter
from stringloom.functions.text import analyze, grams
from stringloom.operators import index, store
from stringloom.plans import generate
from stringloom.plans.search import ListConfig, Segment, Snapshot, answered, ngram_search, search
from stringloom.service import govern
from stringloom.sources import mapping
from stringloom.sources.mapping import KeyRule, Mapping, MappingError
from stringloom.streaming import match

ENTRY = "seq long, id string, keys array<string>, payload string"


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, q string")


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    return [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 3))) for _ in range(120)]


@pytest.mark.parametrize("floor", [-1.0, 0.4, 0.8, 1.0])
def test_prefix_equals_full_and_brute_force(spark, words, floor):
    import math

    e = spark.createDataFrame([(i, f"e{i:03d}", [w]) for i, w in enumerate(words)], "ord long, id string, keys array<string>")
    q = asked(spark, *[w[:-1] for w in words[:25]], "", "zzz")
    c = ListConfig(threshold=floor, topk=-1)
    found = [{(r.query_id, r.entry_id, r.score) for r in ngram_search(q, e, c, prefix=p).collect()} for p in (True, False)]
    assert found[0] == found[1] and found[0]
    cut = lambda s: {s[i : i + n] for n in (2, 3) for i in range(max(1, len(s) - n + 1))} if s else set()
    sets = [cut(" ".join(w.split())) for w in words]
    df = {g: sum(g in s for s in sets) for s in sets for g in s}
    want = set()
    for i, text in enumerate([*[w[:-1] for w in words[:25]], "", "zzz"]):
        known = {g: round(math.log(1 + len(words) / df[g]) * 1e9) for g in cut(" ".join(text.split())) if g in df}
        most = sum(known.values())
        for k, s in enumerate(sets):
            got = sum(known[g] for g in known if g in s)
            if got and got >= max(floor, 0) * most:
                want.add((f"q{i}", f"e{k:03d}", float(math.floor(100 * got / most + 0.5))))
    assert found[0] == want


def test_settings_of_a_query(spark):
    e = spark.createDataFrame([(i, f"e{i}", ["kite"]) for i in range(5)] + [(9, "far", ["kitten"])], "ord long, id string, keys array<string>")
    q = spark.createDataFrame([("list", "kite", 0.0, 0), ("none", "kite", -1.0, -1), ("two", "kite", None, 2)], "query_id string, q string, threshold double, topk int")
    got = ngram_search(q, e, ListConfig(topk=3)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {"list": 3, "none": 6, "two": 2}
    assert ListConfig(threshold=0.0, topk=0).floor == 0.6 and ListConfig(topk=-1).k == 0 and ListConfig(mode="exact").k == 0
    for bad in ({"threshold": 1.1}, {"topk": 1 << 21}, {"sizes": (17,)}, {"fallback": "parent_domain"}, {"overlay_auto_compact": -1}, {"golden": ({"q": "x"},)}):
        with pytest.raises(ValueError):
            ListConfig(**bad)


def test_lists(spark, tmp_path):
    lists = store.Lists(spark, str(tmp_path))
    c = ListConfig("person-name", threshold=0.3, golden=({"q": "blue bolt", "expect_id": "w2"}, {"q": "blue bolt", "expect_id": "w9"}, {"q": "zzz", "absent": True}))
    with pytest.raises(ValueError):
        lists.create("No Name", c)
    lists.create("a", c)
    one = lists.replace("a", spark.createDataFrame([(0, "w1", ["old"], None), (1, "w2", ["blue bolt"], None), (2, "w3", ["small anvil"], None), (3, "w1", ["blue anvil"], "{}")], ENTRY))
    assert one.split("@")[1].startswith("3+j0+c") and lists.base("a").postings is not None
    q = asked(spark, "blue anvl")
    assert {(r.entry_id, r.score) for r in lists.query("a", q).collect()} == {("w1", 100.0), ("w2", 46.0), ("w3", 31.0)}
    two = lists.upsert("a", spark.createDataFrame([("w4", ["blue anvl"], None), ("w1", ["gone"], None)], "id string, keys array<string>, payload string"))
    assert two != one and {r.entry_id for r in lists.query("a", q).collect()} == {"w4", "w2", "w3"}
    lists.delete("a", ["w3", "nobody"])
    row = lists.status("a").first()
    assert (row.entries, row.overlay, row.tombstones) == (3, 2, 2)
    assert [r.passed for r in lists.probe("a").collect()] == [True, False, True]
    generation = lists.pointer("a")["generation"]
    three = lists.compact("a")
    assert {r.id for r in lists.live("a").collect()} == {"w1", "w2", "w4"} and lists.log("a").isEmpty() and three != two
    with pytest.raises(store.Stale):
        lists.upsert("a", spark.createDataFrame([("x", ["x"], None)], "id string, keys array<string>, payload string"), generation)
    lists.create("b", c.but(overlay_auto_compact=2))
    lists.upsert("b", spark.createDataFrame([("x", ["x"], None), ("y", ["y"], None)], "id string, keys array<string>, payload string"))
    assert lists.log("b").isEmpty() and lists.base("b").entries.count() == 2 and lists.names() == ["a", "b"] and lists.damaged() == []
    # the same entries have the same stamp, another order or setting another one
    rows = [(0, "p", ["one"], None), (1, "q", ["two"], None)]
    s1, s2 = (lists.replace("b", spark.createDataFrame(rows, ENTRY)) for _ in range(2))
    assert s1 == s2 and s1 != lists.replace("b", spark.createDataFrame([(5, *rows[0][1:]), (1, *rows[1][1:])], ENTRY))
    assert index.config_digest(c) != index.config_digest(c.but(topk=5)) and index.index_digest(c) == index.index_digest(c.but(topk=5))
    # an index of other settings is not used
    where = f"{tmp_path}/b/{lists.pointer('b')['version']}"
    assert index.load(spark, where, c.but(sizes=(4,))).entries.count() == 2


def test_overlay_and_dead_in_exact_mode(spark):
    c = ListConfig(steps="identifier", mode="exact", topk=2, fields={"k": "k"})
    base = spark.createDataFrame([(i, f"b{i}", ["Key"], '{"k":1}' if i % 2 else '{"k":2}') for i in range(6)] + [(6, "bad", ["Key"], "{")], "ord long, id string, keys array<string>, payload string")
    over = spark.createDataFrame([(0, "a0", ["key "], '{"k":1}')], base.schema)
    dead = spark.createDataFrame([("b1",)], "id string")
    at = Snapshot(Segment.of(base, c), Segment.of(over, c), dead)
    hits, stats = answered(asked(spark, "KEY"), at, c, TypedFilter.parse('{"k":1}'))
    assert [r.entry_id for r in hits.orderBy("entry_id").collect()] == ["b3", "b5"]
    assert [(r.evaluated, r.rejected) for r in stats.collect()] == [(5, 3)]  # the broken payload comes after the second survivor
    assert [r.entry_id for r in search(asked(spark, "key"), at, c.but(topk=-1)).orderBy("entry_id").collect()] == ["a0", "b0", "b2", "b3", "b4", "b5", "bad"]
    with pytest.raises(Exception, match="malformed payload"):
        answered(asked(spark, "KEY"), at, c.but(topk=-1), TypedFilter.parse('{"k":1}'))[0].collect()


def test_hot_key_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SHARED", 3)
    e = spark.createDataFrame([(i, str(i), ["k"], None) for i in range(4)], "ord long, id string, keys array<string>, payload string")
    with pytest.raises(ValueError, match="'k' is on 4"):
        index.build(spark, e, ListConfig("identifier", mode="exact"), str(tmp_path))


FEED = {
    "format": "ndjson", "where": {"kind": "person"}, "id": "id",
    "keys": [{"paths": ["name.first", "name.last"]}, {"paths": ["aka.list.first", "aka.list.last"], "where": {"aka.list.type": "strong"}}, {"path": "also", "split": ";"}],
    "payload": {"codes": "codes", "n": "n", "none": "nothing"},
}


def test_ndjson(spark, tmp_path):
    docs = [
        {"id": 12345678901234567890, "kind": "person", "name": {"first": " Ann ", "last": "Lee"}, "aka": {"list": [{"type": "strong", "first": "A", "last": "L"}, {"type": "weak", "last": "No"}, {"type": "strong", "last": "Only"}]}, "also": "x; y;;", "codes": ["a", None, "b"], "n": True},
        {"id": "f", "kind": "ship", "name": {"last": "No"}},
        {"kind": "person", "name": {"last": "Nobody"}},
        {"id": "k", "kind": "person"},
    ]
    lines = [json.dumps(d) for d in docs] + ["", '{"id":"t"} trailing', '{"id": "' + "x" * (1 << 20) + '"}', "{", '{"id":"z","kind":["ship","person"],"name":{"last":"Zed"},"n":1.50}']
    (tmp_path / "f.ndjson").write_text("﻿" + "\n".join(lines) + "\n")
    m = Mapping.parse(json.dumps(FEED))
    got = mapping.parse(spark, str(tmp_path / "f.ndjson"), m).orderBy("record").collect()
    assert [r.status for r in got] == ["ok", "filtered", "bad", "bad", "bad", "bad", "bad", "ok"]
    assert got[0].id == "12345678901234567890" and got[0]["keys"] == ["Ann Lee", "A L", "Only", "x", "y"] and json.loads(got[0].payload) == {"codes": ["a", "b"], "n": "true"}
    assert got[2].reason == "no id" and got[5].reason == "too large" and '"n":"1.50"' in got[7].payload
    with pytest.raises(mapping.BadRecord, match="record 3: no id"):
        mapping.entries(mapping.parse(spark, str(tmp_path / "f.ndjson"), m))
    assert mapping.entries(mapping.parse(spark, str(tmp_path / "f.ndjson"), m), 5).count() == 2


def test_csv_and_xml(spark, tmp_path):
    (tmp_path / "f.csv").write_text('name;no.1;x\n"A ""q"" B";1;\nshort\nC;3;y;  ;more\nD;4;z; ;\n')
    rows = mapping.read_csv(spark, str(tmp_path / "f.csv"), ("no.1", "name"), ";").orderBy("_record").collect()
    assert [(r["name"], r["no.1"], r["_bad"]) for r in rows] == [('A "q" B', "1", "false"), ("short", None, "false"), ("C", "3", "data beyond the header"), ("D", "4", "false")]
    for head in ("a;a", ";", ";".join(f"c{i}" for i in range(1100))):
        (tmp_path / "g.csv").write_text(head + "\n1;2\n")
        with pytest.raises(MappingError):
            mapping.read_csv(spark, str(tmp_path / "g.csv"), None, ";")
    (tmp_path / "f.xml").write_text('<all xmlns:n="u"><n:row kind="x"><id> 7 </id><n:who><last>Lee</last><last>Li</last></n:who></n:row><row><id>8</id><who><first>B</first><last>Bo</last></who><who><last>Bu</last></who></row></all>')
    m = Mapping(ids=("id",), single_id=True, format="xml", record="row", keys=(KeyRule(("who.first", "who.last")),), payload=(("last", "who.last"),))
    got = {r.id: (r["keys"], r.payload) for r in mapping.parse(spark, str(tmp_path / "f.xml"), m).collect()}
    assert got == {"7": (["Lee"], '{"last":["Lee","Li"]}'), "8": (["B Bo", "Bu"], '{"last":["Bo","Bu"]}')}


@pytest.mark.parametrize("change", [{"format": "tsv"}, {"record": "x"}, {"format": "xml"}, {"delimiter": ";"}, {"id": ""}, {"id_paths": ["a"]}, {"keys": []}, {"keys": [{"path": "a", "paths": ["b"]}]}, {"keys": [{"paths": ["a", "b"], "split": ";"}]}, {"where": {"": "x"}}, {"more": 1}, {"list": {"match": {"threshold": 2}}}])
def test_mappings_are_checked(change):
    with pytest.raises(ValueError):
        Mapping.parse(json.dumps(FEED | change))


def test_bundle_delta_publish(spark, tmp_path):
    m = {"format": "csv", "id": "id", "keys": [{"path": "name"}], "list": {"analyzer": {"preset": "identifier"}, "match": {"mode": "exact"}}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    (tmp_path / "1.csv").write_text("id,name\na,Ann\nb,Bo\na,Ann\nc,Cy\n")
    (tmp_path / "2.csv").write_text("id,name\nd,Di\nb,Bob\nc,Cy\n")
    (tmp_path / "3.csv").write_text("id,name\nb,Bo\nb,Bob\n")
    own = Mapping.parse(json.dumps(m))
    first = mapping.build(spark, str(tmp_path / "1.csv"), own, str(tmp_path / "one"))
    second = mapping.build(spark, str(tmp_path / "2.csv"), own, str(tmp_path / "two"), prev=str(tmp_path / "one"))
    assert (first["entries"], first["collapsed"]) == (3, 1) and second["delta"] == {"adds": 1, "updates": 1, "deletes": 1} and second["prev_sha256"] == first["sha256"]
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "two" / "delta")).collect()]
    assert [(x["op"], x["id"]) for x in lines] == [("add", "d"), ("update", "b"), ("delete", "a")] and lines[1]["entry"]["keys"] == ["Bob"] and "entry" not in lines[2]
    with pytest.raises(store.Conflict, match="'b'"):
        mapping.build(spark, str(tmp_path / "3.csv"), own, str(tmp_path / "three"))
    lists = store.Lists(spark, str(tmp_path / "lists"))
    lists.publish("people", str(tmp_path / "two"), own.config)
    assert [r.entry_id for r in lists.query("people", asked(spark, "DI")).collect()] == ["d"]
    lists.delete("people", ["d"])
    with pytest.raises(store.Stale):
        lists.publish("people", str(tmp_path / "one"), own.config)
    assert cli.main(["build", "--out", str(tmp_path / "cli"), str(tmp_path / "m.json"), str(tmp_path / "1.csv")]) == 0
    assert cli.main(["ingest", "--max-empty-rate", "0.5", str(tmp_path / "m.json"), str(tmp_path / "1.csv")]) == 0
    assert cli.main(["query", "--stats", str(tmp_path / "lists"), "people", "cy"]) == 0


def test_dry_run(spark):
    rows = [(i, "ok", None, f"i{i % 3}", ["Ann", "!!"] if i else ["?"], None) for i in range(5)] + [(5, "bad", "no id", None, [], None), (6, "filtered", None, "x", ["y"], None)]
    df = spark.createDataFrame(rows, "record long, status string, reason string, id string, keys array<string>, payload string")
    told, samples = mapping.dry_run(df, ListConfig(), 0, 2)
    r = told.first()
    assert (r.sampled, r.records, r.filtered, r.bad, r.distinct_ids, r.duplicate_ids, r.raw_keys, r.analyzed_keys, r.empty_keys, r.keyless_entries) == (7, 5, 1, 1, 3, 2, 9, 4, 5, 1)
    assert r.est_memory_bytes == 4 * 114 and abs(r.empty_key_rate - 5 / 9) < 1e-9 and samples.count() == 2
    assert mapping.dry_run(df, ListConfig(), 2)[0].first().records == 2


def test_batch_and_validation(spark):
    c = ListConfig("identifier", mode="exact", fields={"k": "k"})
    at = Snapshot(Segment.of(spark.createDataFrame([(0, "a", ["x"], '{"k":1}'), (1, "b", ["x"], '{"k":2}')], "ord long, id string, keys array<string>, payload string"), c))
    rows = [(0, "x", ["l", "l"], None, None, None), (1, "x", ["l"], None, None, '{"k":2}'), (2, "x", ["l"], None, None, '{"z":2}'), (3, "x", [], None, None, None), (4, "x", ["l", "no"], None, None, None), (5, "x", ["l"], 0.0, 1, None)]
    hits, told = govern.batch(spark.createDataFrame(rows, "check_no int, q string, lists array<string>, threshold double, topk int, filter string"), {"l": (at, c)})
    assert sorted((r.check_no, r.entry_id) for r in hits.collect()) == [(0, "a"), (0, "b"), (1, "b"), (5, "a")]
    assert {r.check_no: r.error for r in told.collect()} == {0: None, 1: None, 2: "filter: z is not filterable", 3: "no lists", 4: "no such list: no", 5: None}
    govern.no_repeated_filter('{"q":"x","filter":{"filter":1}}')
    with pytest.raises(FilterError):
        govern.no_repeated_filter('{"checks":[{"filter":1,"filter":2}]}')
    assert flag_filter(["a=b=c"]).json() == '{"a":"b=c"}'
    for bad in (["a"], ["=b"], ["a=1", "a=2"]):
        with pytest.raises(FilterError):
            flag_filter(bad)


def test_admission_and_tenants():
    import threading

    now = [0.0]
    b = govern.Bucket(2, lambda: now[0])
    assert [b.take() for _ in range(5)] == [0, 0, 0, 0, 1] and b.take(3) == 2
    now[0] = 0.5
    assert b.take() == 0
    gate, order = govern.Admission(10), []
    with pytest.raises(govern.Refused), gate.admit(11):
        pass
    with gate.admit(10):
        with pytest.raises(govern.Refused), gate.admit(1, patience=0.05):
            pass
        t = threading.Thread(target=lambda: [order.append(1) for _ in [0] if gate.admit(5).__enter__() is None])
        t.start()
    t.join(5)
    assert order == [1]
    key, digest = govern.new_key()
    text = json.dumps({"a": {"key_digests": [digest], "quotas": {"rate_per_sec": 1, "max_lists": 1, "max_total_keys": 10}}})
    tenants = govern.Tenants(text)
    assert tenants.of(key).name == "a" and tenants.of("x") is None and govern.Tenants(text, tenants).of(key).bucket is tenants.of(key).bucket
    with pytest.raises(ValueError):
        govern.Tenants(json.dumps({"a": {"key_digests": [digest]}, "b": {"key_digests": [digest]}}))
    q = tenants.of(key).quotas
    assert q.lists(["x"], "x") is None and q.lists(["x"], "y") and q.keys(8, 3) and q.keys(8, 3, 2) is None


def test_metrics(spark):
    log = spark.createDataFrame([("t", "l", "query", 2, 200, 0.0002), ("t", "l", "query", 1, 200, 20.0), ("t", "l", "upsert", 0, 200, 0.1), ("t", "m", "query", 0, 429, None)], "tenant string, list string, kind string, hits long, status int, seconds double")
    h = {r.le: r["count"] for r in govern.histogram(log, "seconds", "list").where("list = 'l'").collect()}
    assert len(h) == 17 and h[0.0001] == 0 and h[0.00025] == 1 and h[0.1] == 2 and h[10.0] == 2 and h[float("inf")] == 3
    assert {(r.list, r.queries, r.hits, r.mutations, r.refused) for r in govern.counters(log).collect()} == {("l", 2, 3, 1, 0), ("m", 1, 0, 0, 1)}
    assert 'x{le="+Inf",list="l"} 3' in govern.exposition(govern.histogram(log, "seconds", "list"), "x", "histogram", "count", "le", "list")
    p = govern.percentiles(spark.createDataFrame([(float(i),) for i in range(1, 101)], "seconds double")).first()
    assert (p.n, p.p50, p.p99) == (100, 51.0, 100.0)


def test_generated_names(spark):
    e = generate.names(spark, 3000)
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, generate.names(spark, 3000).repartition(7).collect()))
    rows = generate.cases(e, 40).collect()
    truth = {r.id: r["keys"][0] for r in e.collect()}
    assert {r.category for r in rows} == set(generate.CATEGORIES) and len(rows) == 8 * 40
    for r in rows:
        name = truth[r.truth_id]
        diff = [i for i, (a, b) in enumerate(zip(name, r.q)) if a != b] if len(name) == len(r.q) else None
        want = {"EXACT": lambda: name == r.q, "TYPO_1": lambda: len(diff) == 1, "TYPO_2": lambda: len(diff) == 2, "TRANSPOSE_NONADJ": lambda: len(diff) == 2 and diff[1] - diff[0] > 1 and r.q[diff[0]] == name[diff[1]] and r.q[diff[1]] == name[diff[0]], "SPACE_INSERT": lambda: r.q.replace(" ", "") == name.replace(" ", "") and len(r.q) == len(name) + 1 and "  " not in r.q, "FUSED": lambda: r.q == name.replace(" ", ""), "DOUBLE_TOKEN": lambda: r.q == name.split()[0] + " " + name, "REMOVE_TOKEN": lambda: r.q == " ".join(name.split()[1:]) and len(name.split()) == 3}
        assert want[r.category](), (r.category, name, r.q)
    c = ListConfig("person-name", strip_spaces=True)
    got = {r.category: r.recall for r in generate.recall(generate.cases(e, 40), Snapshot(Segment.of(e, c)), c).collect()}
    assert got["EXACT"] == got["DOUBLE_TOKEN"] == 1.0 and got["TYPO_1"] > 0.9 and got["OVERALL"] > 0.85


def test_streams(spark, tmp_path):
    lists = store.Lists(spark, str(tmp_path / "lists"))
    lists.create("s", ListConfig())
    spark.createDataFrame([("k", ["kite"], None)], "id string, keys array<string>, payload string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id string, keys array<string>, payload string").parquet(str(tmp_path / "in"))
    match.upsert_stream(rows, lists, "s", str(tmp_path / "c1")).awaitTermination(180)
    asked(spark, "kites").write.parquet(str(tmp_path / "q"))
    q = spark.readStream.schema("query_id string, q string").parquet(str(tmp_path / "q"))
    match.list_stream(q, lists, "s", str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).first().entry_id == "k"
    spark.createDataFrame([("add", "k", ("k", ["kite"], None)), ("delete", "z", None)], "op string, id string, entry struct<id string, keys array<string>, payload string>").write.parquet(str(tmp_path / "d"))
    d = spark.readStream.schema("op string, id string, entry struct<id string, keys array<string>, payload string>").parquet(str(tmp_path / "d"))
    match.recheck_stream(d, asked(spark, "kite"), ListConfig(), str(tmp_path / "again"), str(tmp_path / "c3")).awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "again")).count() == 1


def test_invalid_utf8(spark):
    df = spark.sql("SELECT make_valid_utf8(CAST(X'61FF62' AS STRING)) AS s")
    assert df.select(analyze(F.col("s"), "free-text")).first()[0] == "ab"
    assert df.select(F.size(grams(F.lit("")))).first()[0] == 0
