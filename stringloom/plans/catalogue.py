"""Queries over the given tables by name, and SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import TypedFilter
from ..functions.text import analyze, char_grams, fold, parents
from ..operators import index, store
from ..service import govern
from ..sources.mapping import KeyRule, Mapping, map_documents, map_records, report
from . import generate, search
from .search import ListConfig, Segment, Snapshot

FREE = ("lowercase", "strip_punctuation")
PERSON = ("lowercase", "strip_punctuation", "strip_words:mr,dr", "sort_tokens")


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    p = T(spark, d, "part")
    payload = F.concat(F.lit('{"brand":"'), "p_brand", F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}"))
    return p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.array(*(keys or ("p_name",))).alias("keys"), payload.alias("payload"))


def typos(spark: SparkSession, d: str) -> DataFrame:
    """Part names without their third letter."""
    p = T(spark, d, "part")
    return p.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000)).alias("q"))


CFG = ListConfig(steps=FREE, topk=10, fields={"brand": "brand", "size": "size"})

CLEAN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\- \t\n]', '', 'g'), '\s+', ' ', 'g'))"
PARTS = "SELECT p_partkey AS ord, 'p' || p_partkey AS id, {keys} AS keys, p_brand, p_size FROM part"
TYPOS = "SELECT 'q' || p_partkey AS query_id, substr(p_name, 1, 2) || substr(p_name, 4) AS q FROM part"


def gram_list(x: str) -> str:
    one = "CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < {n} THEN [{x}] ELSE list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})) END"
    return f"list_distinct(list_concat({one.format(x=x, n=2)}, {one.format(x=x, n=3)}))"


def segment_sql(n: str, entries: str, floor: float, cut: str, where: str, dead: str, strip: bool) -> str:
    """Tables of one segment by its name n: h{n}, what it scores, and hit{n}, that after its cut and without the dead."""
    gram = gram_list("replace(a, ' ', '')" if strip else "a")
    return f"""e{n} AS ({entries}),
ek{n} AS (SELECT ord, i, k, {CLEAN.format("k")} AS a FROM (SELECT ord, unnest(range(1, len(keys) + 1)) AS i, unnest(keys) AS k FROM e{n})),
po{n} AS (SELECT DISTINCT ord, unnest({gram}) AS g FROM ek{n}),
st{n} AS (SELECT g, round(ln(1 + (SELECT max(ord) + 1 FROM po{n})::DOUBLE / count(*)) * 1000000000)::BIGINT AS w FROM po{n} GROUP BY g),
kn{n} AS (SELECT a, g, w, sum(w) OVER (PARTITION BY a)::BIGINT AS m FROM qg JOIN st{n} USING (g)),
sc{n} AS (SELECT a, ord, sum(w)::BIGINT AS s, any_value(m) AS m FROM kn{n} JOIN po{n} USING (g) GROUP BY 1, 2),
h{n} AS (SELECT a, e.*, round(100.0::DOUBLE * s / m)::DOUBLE AS score FROM sc{n} JOIN e{n} e USING (ord) WHERE s >= m * {floor}::DOUBLE),
hit{n} AS (SELECT a, ord, id AS entry_id, score, keys FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, ord) AS n FROM h{n} WHERE {where}) WHERE n <= {cut} {dead})"""


def ngram_sql(keys: str = "[p_name]", floor: float = 0.6, k: int = 10, where: str = "true", dead: str = "", cut: str = "", queries: str = TYPOS, strip: bool = False, over: str = "", body: str = "") -> str:
    """SQL of a search; dead: condition of tombstoned entries, which go after a cut at `cut`; over: entries of an overlay. Equal
    lookups are scored once. body: what to select instead, from hits (query_id, entry_id, score, key)."""
    gram = gram_list("replace(a, ' ', '')" if strip else "a")
    parts = [segment_sql("", PARTS.format(keys=keys), floor, cut or str(k), where, dead, strip)] + ([segment_sql("2", over, floor, str(k), where, "", strip)] if over else [])
    return f"""WITH q AS ({queries}),
qa AS (SELECT query_id, {CLEAN.format("q")} AS a FROM q),
qd AS (SELECT DISTINCT a FROM qa WHERE a != ''),
qg AS (SELECT a, unnest({gram}) AS g FROM qd),
{", ".join(parts)},
un AS (SELECT * FROM hit{" UNION ALL SELECT * FROM hit2" if over else ""}),
hit_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, entry_id) AS n2 FROM un) WHERE n2 <= {k}),
ql AS (SELECT a AS qa, list(g) AS gs FROM qg GROUP BY 1),
ks AS (SELECT qa, entry_id, score, k, i, {CLEAN.format("k")} AS a FROM (SELECT a AS qa, entry_id, score, unnest(keys) AS k, unnest(range(1, len(keys) + 1)) AS i FROM hit_)),
sh AS (SELECT qa, entry_id, score, k, i, len(list_intersect(gs, {gram})) AS s FROM ks JOIN ql USING (qa)),
b AS (SELECT *, row_number() OVER (PARTITION BY qa, entry_id ORDER BY s DESC, i) AS r FROM sh),
hits AS (SELECT query_id, entry_id, score, k AS key FROM qa JOIN b ON qa.a = b.qa WHERE r = 1)
{body or "SELECT * FROM hits"}"""


HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)"


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("query_id"), F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1).alias("q"))


def domains(spark: SparkSession, d: str) -> DataFrame:
    """The hosts of English pages, and of the others without their first labels, once, with the least page_id as ordinal."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1)
    h = T(spark, d, "pages").select("page_id", F.when(F.col("url").contains("/en/"), host).otherwise(F.regexp_replace(host, r"^[^.]*\.", "")).alias("k"))
    return h.groupBy("k").agg(F.min("page_id").alias("ord")).select("ord", F.concat(F.lit("d"), F.col("ord").cast("string")).alias("id"), F.array("k").alias("keys"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """Changes of parts: every 7th is deleted, every 5th gets another key, and every 35th of these is deleted after all."""
    p = parts(spark, d)
    up = p.where("ord % 5 = 0").select(F.col("ord").alias("seq"), F.lit("upsert").alias("op"), "id", F.array(F.concat(F.col("keys")[0], F.lit(" new"))).alias("keys"), "payload")
    gone = p.where("ord % 7 = 0").select((F.col("ord") + 1_000_000_000).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<string>").alias("keys"), F.lit(None).cast("string").alias("payload"))
    return up.unionByName(gone)


def live_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.live(parts(spark, d), store.fold(log(spark, d))).select("id", F.col("keys")[0].alias("key"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    m = Mapping(ids=("c_nationkey", "c_custkey"), keys=(KeyRule(("c_name",)), KeyRule(("c_mktsegment", "c_name"), join="/", where=(("c_mktsegment", "BUILDING"),)), KeyRule(("c_name",), split="#")), where=(("c_name", "*"),), payload=(("segment", "c_mktsegment"),))
    return map_records(T(spark, d, "customer"), m)


def before_and_after(spark: SparkSession, d: str) -> DataFrame:
    """What takes the parts but every 11th to the live entries: adds and updates with their entries, deletes without."""
    p = parts(spark, d)
    return store.changes(p.where("ord % 11 != 0"), store.live(p, store.fold(log(spark, d)))).select("op", "id", F.col("keys")[0].alias("key"))


SEGMENTS = ListConfig(steps=("lowercase", "trim"), mode="exact", topk=50)


def lists(spark: SparkSession, d: str) -> dict[str, tuple[Snapshot, ListConfig]]:
    """Customers by segment, and by segment and nation."""
    c = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = lambda x, *keys: c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit(x), F.col("c_custkey").cast("string")).alias("id"), F.array(*keys).alias("keys"), F.lit(None).cast("string").alias("payload"))
    return {"segments": (Snapshot(Segment.of(row("c", "c_mktsegment"), SEGMENTS)), SEGMENTS), "nations": (Snapshot(Segment.of(row("c", "n_name", "c_mktsegment"), SEGMENTS)), SEGMENTS)}


def multi_list(spark: SparkSession, d: str) -> DataFrame:
    q = T(spark, d, "customer").select("c_mktsegment").unionByName(T(spark, d, "nation").select(F.col("n_name").alias("c_mktsegment"))).distinct()
    hits = search.search_lists(q.select(F.col("c_mktsegment").alias("query_id"), F.lower("c_mktsegment").alias("q")), lists(spark, d), ["segments", "nations", "segments"], topk=20)
    return hits.select("query_id", "list", "entry_id", "score", "key")


def checks(spark: SparkSession, d: str) -> DataFrame:
    """A check per customer, each seventh with one flaw or another."""
    c = T(spark, d, "customer").withColumn("n", F.col("c_custkey") % 7)
    name = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.repeat(F.lit("x"), 600)).otherwise(F.col("c_mktsegment"))
    wanted = F.when(F.col("n") == 3, F.array(F.lit("nowhere"), F.lit("nations"))).otherwise(F.array(F.lit("nations"), F.lit("segments")))
    flt = F.when(F.col("n") == 6, '{"a":null}')
    return c.select(F.col("c_custkey").alias("check_no"), name.alias("q"), wanted.alias("lists"), F.when(F.col("n") == 4, 1.5).alias("threshold"), F.when(F.col("n") == 5, 0).otherwise(3).alias("topk"), flt.alias("filter"))


def batch_checks(spark: SparkSession, d: str) -> DataFrame:
    hits, told = govern.batch(checks(spark, d), lists(spark, d))
    return search.meet(told, hits, "check_no", "left").select("check_no", "error", "list", "entry_id", "score", "key")


def recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of perturbed part names that find their part's name among the hits."""
    p = T(spark, d, "part")
    n = F.col("p_name")
    kinds = {"EXACT": n, "DROP": F.concat(F.substring(n, 1, 2), F.substring(n, 4, 1000)), "FUSED": F.replace(n, F.lit(" "), F.lit("")), "DOUBLE": F.concat(n, F.lit(" "), n)}
    cases = p.select("p_partkey", n.alias("truth"), F.explode(F.array(*(F.struct(F.lit(k).alias("category"), v.alias("q")) for k, v in kinds.items()))).alias("c")).select("truth", "c.*", F.concat("c.category", F.col("p_partkey").cast("string")).alias("query_id"))
    hits = search.ngram_search(cases.select("query_id", "q"), parts(spark, d), CFG.but(strip_spaces=True))
    found = search.meet(cases, hits.select("query_id", F.col("key").alias("truth")).distinct().withColumn("hit", F.lit(1)), ["query_id", "truth"], "left")
    return found.groupBy("category").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("cases"))


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Whether each part is among the hits of its name without the third letter, with a score of 95; and none is of nonsense."""
    t = typos(spark, d).select("query_id", "q", F.concat(F.lit("p"), F.substring("query_id", 2, 20)).alias("expect_id"), F.lit(False).alias("absent"), F.lit(95.0).alias("min_score"))
    own = t.unionByName(t.select(F.concat(F.lit("n"), "query_id").alias("query_id"), F.concat(F.lit("zq"), F.reverse("q")).alias("q"), F.lit(None).cast("string").alias("expect_id"), F.lit(True).alias("absent"), F.lit(0.0).alias("min_score")))
    return store.judged(own, search.ngram_search(own, parts(spark, d), CFG, with_keys=False)).select("query_id", "passed")


def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer")
    q = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("query_id"), F.concat(F.lit(" "), F.lower("c_name")).alias("q"))
    return search.exact_search(q, c.select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), F.array("c_name").alias("keys")), ListConfig(steps="identifier", mode="exact"))


def exact_topk_order(spark: SparkSession, d: str) -> DataFrame:
    q = T(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.col("p_name").alias("q"))
    return search.exact_search(q, parts(spark, d), ListConfig(steps="identifier", mode="exact", topk=3))


def compact_search(spark: SparkSession, d: str) -> DataFrame:
    q = T(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.concat("p_name", F.lit(" NEW")).alias("q"))
    return search.exact_search(q, live_rows(spark, d).select(F.substring("id", 2, 20).cast("long").alias("ord"), "id", F.array("key").alias("keys")), ListConfig(steps="identifier", mode="exact", topk=4))


def overlay_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts with an overlay of every 5th under another name and every 7th deleted: each segment weighs its own grams."""
    folded = store.fold(log(spark, d)).where("op = 'delete' OR id IS NOT NULL")
    over = folded.where("op = 'upsert'").select(F.substring("id", 2, 20).cast("long").alias("ord"), "id", "keys", "payload")
    base = parts(spark, d)
    at = Snapshot(Segment.of(base, CFG), Segment.of(over, CFG), store.tombstones(base, folded))
    return search.search(typos(spark, d), at, CFG.but(topk=6))


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.answered(typos(spark, d), Snapshot(Segment.of(parts(spark, d), CFG)), CFG, TypedFilter.parse(FIRST[0]))[1]


def exact_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """A lookup stops at its second survivor: what comes after is not counted."""
    q = T(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.col("p_name").alias("q"))
    c = ListConfig(steps="identifier", mode="exact", topk=2, fields={"brand": "brand"})
    return search.answered(q, Snapshot(Segment.of(parts(spark, d), c)), c, TypedFilter.parse(FIRST[0]))[1]


def own_settings(spark: SparkSession, d: str) -> DataFrame:
    """Each lookup with its own floor and limit: 0 is the list's, a negative one none."""
    n = F.col("p_partkey") % 4
    own = T(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.when(n == 0, 0.0).when(n == 1, -1.0).when(n == 2, 0.9).otherwise(0.5).alias("threshold"), F.when(n == 0, 0).when(n == 1, 7).when(n == 2, 2).otherwise(5).alias("topk"))
    return search.ngram_search(search.meet(typos(spark, d), own, "query_id"), parts(spark, d), CFG)


def build_loss(spark: SparkSession, d: str) -> DataFrame:
    """Of each part a name, and keys that analysis leaves nothing of."""
    p = T(spark, d, "part").select(F.when(F.col("p_size") > 25, F.array(F.lit("..."), F.lit("&"))).otherwise(F.array("p_name", F.lit("!?"))).alias("keys"))
    return index.losses(p, CFG)


def composite(spark: SparkSession, d: str) -> DataFrame:
    """Ids of several columns, empty ones in place."""
    c = T(spark, d, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg ment"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).alias("no.1"), F.concat(F.lit("\u00a0"), "c_name", F.lit(" ")).alias("name"))
    m = Mapping(ids=("seg ment", "no.1"), keys=(KeyRule(("name",)),), id_join="/")
    return map_records(c, m).select("id", F.col("keys")[0].alias("key"), "status", "reason")


def split_keys(spark: SparkSession, d: str) -> DataFrame:
    s = T(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("no"), F.concat("s_name", F.lit(" ;; "), F.lower("s_name"), F.lit(";"), "s_name").alias("names"), F.when(F.col("s_acctbal") < 0, "debt").alias("kind"))
    m = Mapping(ids=("no",), keys=(KeyRule(("names",), split=";", where=(("kind", "*"),)), KeyRule(("names", "kind"), join=" is ")))
    return map_records(s, m).select("id", F.array_join("keys", "|").alias("keys"))


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer as nested documents, mapped: instances, conditions by instance, lists of values as payload."""
    o = T(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("no"), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("state")))).alias("orders"))
    docs = o.select(F.col("o_custkey").alias("record"), F.to_json(F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("orders").alias("list")).alias("all"))).alias("doc"))
    m = Mapping(ids=("id",), single_id=True, format="ndjson", keys=(KeyRule(("all.list.prio", "all.list.no"), join="#", where=(("all.list.state", "F"),)), KeyRule(("id",))), payload=(("states", "all.list.state"), ("none", "all.gone")))
    return map_documents(docs, m).select("id", F.array_join("keys", ";").alias("keys"), "payload", "status")


def costs(spark: SparkSession, d: str) -> DataFrame:
    """What lookups of each part's name would be charged, unfiltered and with a filter."""
    p = T(spark, d, "part").agg((F.max("p_partkey") + 1).alias("n")).first().n  # one row
    f = TypedFilter.parse(FIRST[1])
    rows = [(k, c.mode, govern.cost([govern.Size(p, 30 * p), govern.Size(10, 300)], 7, c, k, 20, x)) for k in (0, 5, 100) for c in (CFG, CFG.but(mode="exact")) for x in (None, f)]
    return spark.createDataFrame(rows, "topk int, mode string, cost long").groupBy("topk", "mode").agg(F.min("cost").alias("plain"), F.max("cost").alias("filtered"))


def latency(spark: SparkSession, d: str) -> DataFrame:
    """event values as milliseconds, in the sixteen buckets and the last one, which has no bound."""
    e = T(spark, d, "events").withColumn("seconds", F.col("value") / 1000)
    return govern.histogram(e, "seconds", "event_type").select("event_type", F.when(F.col("le") < float("inf"), F.col("le")).alias("le"), "count")


def query_log(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "upsert").otherwise("query")
    return govern.counters(e.select(F.col("user_id").alias("tenant"), F.col("event_type").alias("list"), kind.alias("kind"), F.floor("value").alias("hits"), F.when(F.col("value") > 400, 429).otherwise(200).alias("status")))


def generated(spark: SparkSession, d: str) -> DataFrame:
    """Recall by category of generated names, as many as there are parts."""
    c = ListConfig("person-name", strip_spaces=True)
    e = generate.names(spark, T(spark, d, "part").count())
    return generate.recall(generate.cases(e, 200), Snapshot(Segment.of(e, c)), c)


def filtered(text: str):
    return lambda s, d: search.ngram_search(typos(s, d), parts(s, d), CFG, TypedFilter.parse(text))


FIRST = ['{"brand":"Brand#2"}', '{"size":{"in":[1,2,3.0,4e0,5,10]}}']
QUERIES = {
    "analyze_freetext": lambda s, d: T(s, d, "part").select("p_partkey", analyze(F.concat("p_name", F.lit("  --X!y. ")), FREE).alias("a")),
    "analyze_person": lambda s, d: T(s, d, "customer").select("c_custkey", analyze(F.concat(F.lit("Dr. Mr "), "c_name"), PERSON).alias("a")),
    "analyze_identifier": lambda s, d: T(s, d, "supplier").select("s_suppkey", analyze(F.concat(F.lit(" "), "s_name", F.lit("\t")), "identifier").alias("a")),
    "analyze_fold_diacritics": lambda s, d: T(s, d, "documents").select("doc_id", fold(F.col("text")).alias("a")),
    "analyze_domain_ascii": lambda s, d: hosts(s, d).select("query_id", analyze(F.concat(F.lit("."), F.upper("q"), F.lit("..")), "domain").alias("a")),
    "char_grams": lambda s, d: T(s, d, "nation").select("n_nationkey", F.explode(char_grams(F.lower("n_name"), 3)).alias("gram")),
    "gram_stats": lambda s, d: search.gram_stats(search.entry_grams(search.alike(parts(s, d)), CFG, "last", "n")),
    "ngram_search": lambda s, d: search.ngram_search(typos(s, d), parts(s, d), CFG, prefix=False),
    "ngram_search_prefix": lambda s, d: search.ngram_search(typos(s, d), parts(s, d), CFG),
    "ngram_search_multikey": lambda s, d: search.ngram_search(typos(s, d), parts(s, d, "p_brand", "p_name"), CFG),
    "ngram_nofloor": lambda s, d: search.ngram_search(typos(s, d), parts(s, d), CFG.but(threshold=-1.0)),
    "ngram_strict": lambda s, d: search.ngram_search(typos(s, d), parts(s, d), CFG.but(threshold=1.0)),
    "filtered_search": filtered(FIRST[0]),
    "filtered_in": filtered(FIRST[1]),
    "tombstone_mask": lambda s, d: search.ngram_search(typos(s, d), parts(s, d), CFG.but(topk=3), dead=parts(s, d).where("ord % 7 = 0")),
    "exact_lookup": exact_lookup,
    "exact_topk_order": exact_topk_order,
    "parent_domain": lambda s, d: search.exact_search(hosts(s, d), domains(s, d), ListConfig(steps="domain", mode="exact", fallback="parent_domain")),
    "parent_domain_strict": lambda s, d: search.exact_search(hosts(s, d), domains(s, d), ListConfig(steps="domain", mode="exact", fallback="parent_domain", threshold=0.95)),
    "parent_suffixes": lambda s, d: hosts(s, d).select("query_id", F.posexplode(parents(F.col("q"))).alias("level", "suffix")),
    "journal_fold": lambda s, d: store.fold(log(s, d)).select("id", "op"),
    "live_entries": live_rows,
    "compact_search": compact_search,
    "list_status": lambda s, d: store.status(parts(s, d), store.fold(log(s, d))),
    "delta_diff": before_and_after,
    "dedupe_last_wins": lambda s, d: store.dedupe_last(T(s, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("p"))),
    "build_collapse": lambda s, d: store.collapse(T(s, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.array("o_orderstatus").alias("keys"), F.lit(None).cast("string").alias("payload"))),
    "multi_list_merge": multi_list,
    "mapping_rules": lambda s, d: customers(s, d).select("id", F.array_join("keys", ";").alias("keys"), "payload", "status"),
    "dry_run_report": lambda s, d: report(customers(s, d)),
    "golden_probes": golden,
    "recall_by_category": recall,
    "latency_histogram": latency,
    "key_attribution": lambda s, d: search.ngram_search(typos(s, d), parts(s, d, "p_type", "p_brand", "p_name"), CFG.but(threshold=0.3, topk=4)),
    "filter_stats": filter_stats,
    "exact_filter_stats": exact_filter_stats,
    "overlay_search": overlay_search,
    "query_settings": own_settings,
    "batch_checks": batch_checks,
    "key_count": lambda s, d: index.key_count(parts(s, d, "p_name", "p_brand")),
    "build_loss": build_loss,
    "mapping_composite_id": composite,
    "mapping_split_keys": split_keys,
    "payload_projection": documents_of,
    "admission_cost": costs,
    "query_counters": query_log,
    "generated_recall": generated,
}
_EXACT = "SELECT query_id, entry_id, 100.0::DOUBLE AS score, key FROM"
_LOG = """b AS (SELECT p_partkey AS ord, 'p' || p_partkey AS id, p_name AS k FROM part),
f AS (SELECT id, CASE WHEN ord % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op, k || ' new' AS k FROM b WHERE ord % 5 = 0 OR ord % 7 = 0),
l AS (SELECT id, k AS key FROM b WHERE ord % 5 != 0 AND ord % 7 != 0 UNION ALL SELECT id, k FROM f WHERE op = 'upsert')"""
_DOM = f"""u AS (SELECT 'u' || page_id AS query_id, {HOST} AS q FROM pages),
x AS (SELECT query_id, i AS level, array_to_string(string_split(q, '.')[i + 1:], '.') AS s FROM (SELECT query_id, q, unnest(range(0, greatest(len(string_split(q, '.')) - 1, 1))) AS i FROM u)),
d AS (SELECT CASE WHEN url LIKE '%/en/%' THEN {HOST} ELSE regexp_replace({HOST}, '^[^.]*\\.', '') END AS k, min(page_id) AS ord FROM pages GROUP BY 1),
j AS (SELECT query_id, 'd' || ord AS entry_id, CASE WHEN level = 0 THEN 100.0 ELSE 90.0 END::DOUBLE AS score, k AS key, level, min(level) OVER (PARTITION BY query_id) AS near FROM x JOIN d ON s = k {{0}})"""
_CUST = """m AS (SELECT c_nationkey || '|' || c_custkey AS id, list_concat(list_concat([c_name], CASE WHEN c_mktsegment = 'BUILDING' THEN [c_mktsegment || '/' || c_name] ELSE [] END), string_split(c_name, '#')) AS k, c_mktsegment FROM customer),
n AS (SELECT id, (SELECT string_agg(x, ';' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(k) AS x, unnest(range(len(k))) AS i) WHERE x != '' GROUP BY x)) AS keys, c_mktsegment FROM m)"""
SQL = {
    "analyze_freetext": f"SELECT p_partkey, {CLEAN.format('p_name')} || ' x' || 'y' AS a FROM part",
    "analyze_person": r"SELECT c_custkey, array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(c_name), '[^a-z0-9\- ]', '', 'g')), ' '), lambda t: t != '')), ' ') AS a FROM customer",
    "analyze_identifier": r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '\s+', ' ', 'g')) AS a FROM supplier",
    "analyze_fold_diacritics": "SELECT doc_id, strip_accents(text) AS a FROM documents",
    "analyze_domain_ascii": f"SELECT 'u' || page_id AS query_id, lower({HOST}) AS a FROM pages",
    "char_grams": "SELECT DISTINCT n_nationkey, unnest(list_transform(range(1, length(n_name) - 1), lambda i: substr(lower(n_name), i, 3))) AS gram FROM nation",
    "gram_stats": f"WITH a AS (SELECT p_partkey AS ord, {CLEAN.format('p_name')} AS a FROM part), po AS (SELECT DISTINCT ord, unnest({gram_list('a')}) AS gram FROM a) SELECT gram, count(*) AS df, round(ln(1 + (SELECT max(ord) + 1 FROM po)::DOUBLE / count(*)) * 1000000000)::BIGINT AS weight FROM po GROUP BY gram",
    "ngram_search": ngram_sql(),
    "ngram_search_prefix": ngram_sql(),
    "ngram_search_multikey": ngram_sql(keys="[p_brand, p_name]"),
    "ngram_nofloor": ngram_sql(floor=0),
    "ngram_strict": ngram_sql(floor=1.0),
    "filtered_search": ngram_sql(where="p_brand = 'Brand#2'"),
    "filtered_in": ngram_sql(where="p_size IN (1, 2, 3, 4, 5, 10)"),
    "tombstone_mask": ngram_sql(k=3, cut="3 + (SELECT count(*) FROM part WHERE p_partkey % 7 = 0)", dead="AND ord % 7 != 0"),
    "exact_lookup": f"{_EXACT} (SELECT 'c' || a.c_custkey AS query_id, b.c_custkey::VARCHAR AS entry_id, b.c_name AS key FROM customer a JOIN customer b ON lower(a.c_name) = lower(b.c_name) )",
    "exact_topk_order": f"{_EXACT} (SELECT 'q' || a.p_partkey AS query_id, 'p' || b.p_partkey AS entry_id, b.p_name AS key, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS n FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) ) WHERE n <= 3",
    "parent_domain": f"WITH {_DOM.format('')} SELECT query_id, entry_id, score, key FROM j WHERE level = near",
    "parent_domain_strict": f"WITH {_DOM.format('WHERE level = 0')} SELECT query_id, entry_id, score, key FROM j",
    "parent_suffixes": f"WITH {_DOM.format('')} SELECT query_id, level::INT AS level, s AS suffix FROM x",
    "journal_fold": f"WITH {_LOG} SELECT id, op FROM f",
    "live_entries": f"WITH {_LOG} SELECT id, key FROM l",
    "compact_search": f"WITH {_LOG} {_EXACT} (SELECT 'q' || p_partkey AS query_id, l.id AS entry_id, l.key, row_number() OVER (PARTITION BY p_partkey ORDER BY substr(l.id, 2)::BIGINT) AS n FROM part JOIN l ON lower(l.key) = lower(p_name || ' new') ) WHERE n <= 4",
    "list_status": f"WITH {_LOG} SELECT (SELECT count(*) FROM l) AS entries, (SELECT count(*) FROM l) AS keys, (SELECT count(*) FROM f WHERE op = 'upsert') AS overlay, (SELECT count(*) FROM f) AS tombstones",
    "delta_diff": f"WITH {_LOG}, o AS (SELECT * FROM b WHERE ord % 11 != 0) SELECT CASE WHEN o.id IS NULL THEN 'add' WHEN l.id IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(l.id, o.id) AS id, l.key FROM o FULL JOIN l ON l.id = o.id WHERE o.id IS NULL OR l.id IS NULL OR o.k != l.key",
    "dedupe_last_wins": "SELECT o_custkey::VARCHAR AS id, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey",
    "build_collapse": "SELECT o_custkey::VARCHAR AS id, count(*) - 1 AS collapsed, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY o_custkey",
    "multi_list_merge": "WITH q AS (SELECT DISTINCT c_mktsegment AS q FROM customer UNION SELECT n_name FROM nation), c AS (SELECT c_custkey AS o, 'c' || c_custkey AS id, c_mktsegment AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey), h AS (SELECT q, 'segments' AS list, 0 AS p, id, o, s AS key FROM q JOIN c ON s = q UNION ALL SELECT q, 'nations', 1, id, o, CASE WHEN n = q THEN n ELSE s END FROM q JOIN c ON s = q OR n = q), e AS (SELECT *, row_number() OVER (PARTITION BY q, list ORDER BY o) AS a FROM h), m AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id, p) AS b FROM e WHERE a <= 20) SELECT q AS query_id, list, id AS entry_id, 100.0::DOUBLE AS score, key FROM m WHERE b <= 20",
    "mapping_rules": f"WITH {_CUST} SELECT id, keys, '{{\"segment\":\"' || c_mktsegment || '\"}}' AS payload, 'ok' AS status FROM n",
    "dry_run_report": f"WITH {_CUST} SELECT count(*) AS records, 0::BIGINT AS filtered, 0::BIGINT AS bad, count(DISTINCT id) AS distinct_ids, count(*) - count(DISTINCT id) AS duplicate_ids, sum(len(string_split(keys, ';')))::BIGINT AS raw_keys FROM n",
    "golden_probes": ngram_sql(queries=f"{TYPOS} UNION ALL SELECT 'n' || query_id, 'zq' || reverse(q) FROM ({TYPOS})", body="SELECT query_id, CASE WHEN query_id LIKE 'n%' THEN NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id) ELSE EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.entry_id = 'p' || substr(q.query_id, 2) AND h.score >= 95) END AS passed FROM q"),
    "recall_by_category": ngram_sql(strip=True, queries="SELECT c || p_partkey AS query_id, q, c, p_name AS truth FROM (SELECT p_partkey, p_name, unnest(['EXACT', 'DROP', 'FUSED', 'DOUBLE']) AS c, unnest([p_name, substr(p_name, 1, 2) || substr(p_name, 4), replace(p_name, ' ', ''), p_name || ' ' || p_name]) AS q FROM part)", body="SELECT c AS category, avg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.key = q.truth) THEN 1 ELSE 0 END) AS recall, count(*) AS cases FROM q GROUP BY 1"),
    "latency_histogram": "SELECT event_type, le, count(value) FILTER (WHERE le IS NULL OR value / 1000 <= le) AS count FROM events CROSS JOIN (SELECT unnest([0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, NULL]::DOUBLE[]) AS le) GROUP BY 1, 2",
    "key_attribution": ngram_sql(keys="[p_type, p_brand, p_name]", floor=0.3, k=4),
    "filter_stats": ngram_sql(body="SELECT query_id, (SELECT count(*) FROM h WHERE h.a = qa.a) AS evaluated, (SELECT count(*) FROM h WHERE h.a = qa.a AND p_brand != 'Brand#2') AS rejected FROM qa"),
    "exact_filter_stats": "WITH c AS (SELECT p_name AS a, p_partkey AS o, p_brand = 'Brand#2' AS ok FROM part), r AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY a ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM c), s AS (SELECT a, count(*) AS evaluated, count(*) FILTER (WHERE NOT ok) AS rejected FROM r WHERE ahead < 2 GROUP BY 1) SELECT 'q' || p_partkey AS query_id, evaluated, rejected FROM part JOIN s ON a = p_name",
    "overlay_search": ngram_sql(k=6, cut="6 + (SELECT count(*) FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0)", dead="AND ord % 5 != 0 AND ord % 7 != 0", over="SELECT p_partkey AS ord, 'p' || p_partkey AS id, [p_name || ' new'] AS keys, p_brand, p_size FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 != 0"),
    "query_settings": " UNION ALL ".join(f"SELECT * FROM ({ngram_sql(floor=f, k=k, queries=f'{TYPOS} WHERE p_partkey % 4 = {n}')})" for n, f, k in ((0, 0.6, 10), (1, 0, 7), (2, 0.9, 2), (3, 0.5, 5))),
    "batch_checks": "WITH c AS (SELECT c_custkey AS o, 'c' || c_custkey AS id, c_mktsegment AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY o) AS a FROM c), t AS (SELECT s, id, list, row_number() OVER (PARTITION BY s ORDER BY id, list) AS b FROM r, (VALUES ('nations'), ('segments')) v(list) WHERE a <= 3) SELECT c_custkey AS check_no, CASE c_custkey % 7 WHEN 1 THEN 'q is empty' WHEN 2 THEN 'q is longer than 512 characters' WHEN 3 THEN 'no such list: nowhere' WHEN 4 THEN 'threshold is from 0 to 1' WHEN 5 THEN 'topk is from 1 to 1000' WHEN 6 THEN 'filter: a: not a scalar' END AS error, list, id AS entry_id, CASE WHEN list IS NOT NULL THEN 100.0 END::DOUBLE AS score, CASE WHEN list IS NOT NULL THEN c_mktsegment END AS key FROM customer LEFT JOIN t ON c_custkey % 7 = 0 AND s = c_mktsegment AND b <= 3",
    "key_count": "SELECT count(k) AS keys, count(DISTINCT k) AS distinct_keys FROM (SELECT unnest([p_name, p_brand]) AS k FROM part)",
    "build_loss": "SELECT sum(CASE WHEN p_size > 25 THEN 2 ELSE 1 END)::BIGINT AS dropped_keys, count(*) FILTER (WHERE p_size > 25) AS keyless_entries FROM part",
    "mapping_composite_id": "WITH c AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS s, CASE WHEN c_acctbal > 0 THEN c_custkey::VARCHAR ELSE '' END AS n, c_name FROM customer) SELECT CASE WHEN s || n != '' THEN s || '/' || n END AS id, c_name AS key, CASE WHEN s || n != '' THEN 'ok' ELSE 'bad' END AS status, CASE WHEN s || n = '' THEN 'no id' END AS reason FROM c",
    "mapping_split_keys": "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal < 0 THEN s_name || '|' || lower(s_name) || '|' ELSE '' END || s_name || ' ;; ' || lower(s_name) || ';' || s_name || CASE WHEN s_acctbal < 0 THEN ' is debt' ELSE '' END AS keys FROM supplier",
    "payload_projection": """WITH o AS (SELECT o_custkey AS c, o_orderkey::VARCHAR AS n, o_orderpriority AS p, o_orderstatus AS s FROM orders), k AS (SELECT c, string_agg(p || '#' || n, ';' ORDER BY n) FILTER (WHERE s = 'F') AS k, list('"' || s || '"' ORDER BY n) AS s FROM o GROUP BY 1) SELECT c::VARCHAR AS id, concat_ws(';', k, c::VARCHAR) AS keys, '{"states":' || CASE WHEN len(s) = 1 THEN s[1] ELSE '[' || array_to_string(s, ',') || ']' END || '}' AS payload, 'ok' AS status FROM k""",
    "admission_cost": "WITH p AS (SELECT max(p_partkey) + 1 AS n FROM part), t AS (SELECT n, k, m, CASE WHEN k = 0 THEN n ELSE least(n, k + CASE m WHEN 'ngram' THEN 7 ELSE 0 END) END + CASE WHEN k = 0 THEN 10 ELSE least(10, k) END AS hits FROM p, (VALUES (0), (5), (100)) a(k), (VALUES ('ngram'), ('exact')) b(m)), u AS (SELECT *, 192 * hits + CASE m WHEN 'ngram' THEN 8 * (n + 10) + 2 * (16384 + 20 * 8 + 20 * 2 * 200) ELSE 0 END AS plain FROM t) SELECT k::INT AS topk, m AS mode, plain::BIGINT AS plain, (plain + (30 * n + 300) + 192 * (n + 10) + (6 * 6 + 7) * (n + 10) + 128 * 6 + 8 * 7)::BIGINT AS filtered FROM u",
    "query_counters": "SELECT user_id AS tenant, event_type AS list, count(*) FILTER (WHERE event_type != 'purchase') AS queries, coalesce(sum(floor(value)) FILTER (WHERE event_type != 'purchase'), 0)::BIGINT AS hits, count(*) FILTER (WHERE event_type = 'purchase') AS mutations, count(*) FILTER (WHERE value > 400) AS refused FROM events GROUP BY 1, 2",
}
