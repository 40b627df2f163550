"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from stringloom.llm import common, op3_quality  # noqa: E402


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    good = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        text = " ".join(rng.choices(["$$ BUY!!", "9999", "CLICK>>"] if bad else good, k=40))
        rows.append((i, text, f"s{i % 3}", i * 0.5, "own", True, i))
        labels.append((i, int(not bad), 0))
    rows += [(300, rows[1][1].upper(), "s1", 1.0, "x", False, 1), (301, rows[2][1] + " tail", None, 1.0, "x", False, 1), (302, None, "s0", None, None, None, None), (None, rows[3][1] + " a b c d e f g h i j k l m n o p", "s2", 0.0, "n", None, 1), rows[4]]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, score double, kept string, `a.b` boolean, __b long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def key(r):
    return str(tuple(r))


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    steps = dict(corpus_pipeline.STAGES)

    kept = common.stage(steps["quality"](spark, docs, folder), "t")
    assert kept.columns == names
    scored = op3_quality.score(docs.select("doc_id", "text"), op3_quality.learn(docs, common.table(spark, folder, "labels"))).collect()
    want = Counter((r.doc_id, r.text) for r in scored if r.score >= 0.7)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    bad = {i for i in range(240) if i % 6 == 0}
    assert not bad & {r.doc_id for r in kept.collect()} and len({r.doc_id for r in kept.collect()} & (set(range(240)) - bad)) >= 195
    clash = {r.doc_id: (r.score, r["kept"], r["a.b"]) for r in kept.collect()}
    assert clash[7] == (3.5, "own", True)

    before = kept.collect()
    kept = common.stage(steps["exact_dedup"](spark, kept, folder), "t")
    last = {}
    for r in before:
        last[lower(r.text)] = max(last.get(lower(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    want = sorted(key(r) for r in before if (-1 if r.doc_id is None else r.doc_id) == last[lower(r.text)])
    assert kept.columns == names and sorted(map(key, kept.collect())) == want

    before = kept.collect()
    kept = common.stage(steps["near_dedup"](spark, kept, folder), "t")
    sets = {}
    for r in before:
        w = lower(r.text).split()
        sets.setdefault(r.doc_id, set()).update(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w)
    gone = {b for a in sets for b in sets if a is not None and b is not None and a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert gone and sorted(map(key, kept.collect())) == sorted(key(r) for r in before if r.doc_id not in gone)

    before = kept.collect()
    mixed = common.stage(steps["mixing"](spark, kept, folder), "t")
    times = Counter(map(key, mixed.collect()))
    assert mixed.columns == names and set(times) <= set(map(key, before)) and max(times.values()) <= 3
    assert times == Counter(map(key, steps["mixing"](spark, kept, folder).collect()))

    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    pieces = Counter()
    for r in steps["packing"](spark, mixed, folder).collect():
        pieces[r.doc_id] += r.length
    assert pieces == tokens


def test_whole_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "labels"):
        common.table(spark, folder, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    common.sweep(spark)
    assert not common.STAGED
