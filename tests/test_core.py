import pytest
from pyspark.sql import functions as F

from stringloom.functions.filters import FilterError, TypedFilter, canonical
from stringloom.functions.text import analyze, char_grams, parents, steps_of
from stringloom.operators import store
from stringloom.plans.search import ListConfig, ngram_search
from stringloom.sources.mapping import KeyRule, Mapping, map_records, read_csv
from stringloom.streaming.match import match_stream


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    "steps,text,want",
    [
        ("person-name", "Dr. Émile O'Brien-Sørli", "emile obrien-sørli"),
        ("identifier", " AB  c ", "ab c"),
        ("free-text", "-Ünder- , ΑΣ", "under ας".replace("ς", "σ")),
        ("domain", "..Exämple.COM.", "xn--exmple-cua.com"),
        (("trim",), "", ""),
    ],
)
def test_analyze(spark, steps, text, want):
    assert one(spark, text, lambda c: analyze(c, steps)) == want
    assert one(spark, want, lambda c: analyze(c, steps)) == want


def test_steps_are_checked():
    for bad in (("upper",), ("trim:x",), ("strip_words: ,",), "nothing"):
        with pytest.raises(ValueError):
            steps_of(bad)


def test_grams_and_parents(spark):
    assert one(spark, "a😀é", lambda c: char_grams(c, 2)) == ["a😀", "😀é"]
    assert one(spark, "a", lambda c: char_grams(c, 2)) == ["a"]
    assert one(spark, "", lambda c: char_grams(c, 2)) == []
    assert one(spark, "a.b.c", parents) == ["a.b.c", "b.c"]
    assert one(spark, "com", parents) == ["com"]


def test_worked_example(spark):
    e = spark.createDataFrame([(0, "w1", ["blue anvil"]), (1, "w2", ["blue bolt"]), (2, "w3", ["small anvil"])], "ord long, id string, keys array<string>")
    q = spark.createDataFrame([("q", "blue anvl")], "query_id string, q string")
    for prefix in (True, False):
        got = {r.entry_id: r.score for r in ngram_search(q, e, ListConfig(steps="person-name", threshold=0.3), prefix=prefix).collect()}
        assert got == {"w1": 100.0, "w2": 46.0, "w3": 31.0}


def test_cut_before_tombstones(spark):
    e = spark.createDataFrame([(0, "z", ["kite"]), (1, "a", ["kite"]), (2, "t", ["other"])], "ord long, id string, keys array<string>")
    q = spark.createDataFrame([("q", "kite")], "query_id string, q string")
    got = ngram_search(q, e, ListConfig(topk=1), dead=e.where("id = 't'")).collect()
    assert [r.entry_id for r in got] == ["a"]


@pytest.mark.parametrize("text,want", [("1.50", "1.5"), ("-0.0", "0"), ("1e3", "1000"), ("12e-3", "0.012"), ("1e201", None), ("-2.5e1", "-25")])
def test_numbers(text, want):
    assert canonical(text) == want


def test_filters(spark):
    assert TypedFilter.parse('{"b":{"in":[2.0,2,"x",false]},"a":1}').json() == '{"a":1,"b":{"in":[false,2,"x"]}}'
    for bad in ("[]", '{"a":null}', '{"a":1,"a":2}', '{"a":{"in":[]}}', '{"a":{"gt":1}}', '{"a":[1]}', "{"):
        with pytest.raises(FilterError):
            TypedFilter.parse(bad)
    rows = ['{"m":{"v":[1.0,"x"]}}', '{"m":{"v":2},"m":{"v":1}}', '{"m":{"v":"1"}}', "{}", '{"m":', None, '{"m":{"v":1}} x']
    f = TypedFilter.parse('{"n":1}')
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    assert [r[0] for r in df.select(f.verdict(F.col("payload"), {"n": "m.v"})).collect()] == [1, 1, 0, 0, -1, -1, -1]
    with pytest.raises(FilterError):
        f.verdict(F.col("payload"), {})


def test_log_and_delta(spark):
    base = spark.createDataFrame([("a", ["x"], None), ("b", ["y"], None)], "id string, keys array<string>, payload string")
    log = spark.createDataFrame([(1, "delete", "a", None, None), (2, "upsert", "a", ["z"], None), (3, "what", "b", None, None), (4, "upsert", "c", ["c"], None)], "seq long, op string, id string, keys array<string>, payload string")
    now = store.live(base, store.fold(log))
    assert {r.id: r["keys"] for r in now.collect()} == {"a": ["z"], "b": ["y"], "c": ["c"]}
    assert {(r.id, r.op) for r in store.delta(base, now).collect()} == {("a", "update"), ("c", "add")}
    assert store.collapse(base.unionByName(base)).where("collapsed = 1 AND NOT conflict").count() == 2


def test_mapping(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id;name;alt\n1;Ann;A. | B\n2;;\n;Zed;\n3;Bo;x;more\n")
    rows = read_csv(spark, str(tmp_path / "f.csv"), ("id", "name", "alt"), ";")
    assert [r._bad for r in rows.orderBy("id").collect()].count("data beyond the header") == 1
    m = Mapping(ids=("id",), keys=(KeyRule(("name",)), KeyRule(("alt",), split="|")), payload=(("n", "name"),))
    got = {r.id: (r["keys"], r.status) for r in map_records(rows, m).collect()}
    assert got["1"] == (["Ann", "A.", "B"], "ok") and got["2"][1] == "bad" and got[None][1] == "bad"


def test_stream(spark, tmp_path):
    e = spark.createDataFrame([(0, "k", ["kite"])], "ord long, id string, keys array<string>")
    spark.createDataFrame([("q", "kites")], "query_id string, q string").write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("query_id string, q string").parquet(str(tmp_path / "in"))
    match_stream(q, e, ListConfig(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().entry_id == "k"


def test_registered_functions(spark):
    from stringloom.functions.text import register

    register(spark)
    assert spark.sql("SELECT fold_diacritics('É-𝅗𝅥-ß')").first()[0].startswith("E-")
    assert [tuple(r) for r in spark.sql("SELECT * FROM parent_suffixes('a.b.c')").collect()] == [(0, "a.b.c"), (1, "b.c")]
