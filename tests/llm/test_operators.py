"""Each operator against a brute-force twin, on a fixture with nulls, empty texts, ties, copies and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.llm import op1_substring, op2_cover_tree, op3_quality, op4_suffix, op5_packing, op6_minhash, op7_html, op8_mixing, op9_exact_dedup, op10_lm_score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage = say(80)
    texts = [say(rng.randint(1, 150)) for _ in range(30)]
    texts += [say(20) + " " + passage + "\n" + say(15) for _ in range(6)]
    base = say(200).split(" ")
    for _ in range(6):
        near = list(base)
        near[rng.randrange(200)] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0], texts[0].upper(), "", " \t", None, "é" * 150, "ab " * 120, say(60) + " " + say(60), passage + " " + passage]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", 1, 7.0, "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, score double, h1 string")


@pytest.fixture(scope="module")
def odd(docs, spark):
    """A null id and a repeated row on top."""
    extra = spark.createDataFrame([(None, "a b", None, None, None, None, None), (3, corpus()[3][1], "en", "s0", 1, 7.0, "x")], docs.schema)
    return docs.unionByName(extra)


def test_op1(docs, odd):
    width, first = 50, {}
    words = {i: WORD.findall((t or "").encode()) for i, t in corpus()}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    want = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring.substring_dedup(docs).collect()}
    assert got == want
    assert op1_substring.substring_dedup(odd).count() == len(want) + 2


@pytest.mark.parametrize("heavy", [1 << 14, 2])
def test_op4(docs, heavy):
    width, seen, want = 100, set(), {}
    for i, t in corpus():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if s in seen:
                gone[k : k + width] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_suffix.suffix_dedup(docs, heavy=heavy).collect()}
    assert got == want


@pytest.mark.parametrize("large", [2, 10_000])
def test_op4_every_heavy_anchor(spark, monkeypatch, large):
    """Anchors that very many different pieces share go through finer ones to the same index."""
    monkeypatch.setattr(op4_suffix, "LARGE", large)
    rng = random.Random(3)
    core = "".join(rng.choices("abcdef", k=40))
    texts = ["".join(rng.choices("uvwxyz", k=80)) + core + "".join(rng.choices("uvwxyz", k=80)) for _ in range(20)]
    texts += [x[:130] + "".join(rng.choices("ab", k=70)) for x in texts[:10]] + [x[30:] for x in texts[5:15]] + ["".join(rng.choices("ab", k=50)) + x[60:] for x in texts[:12]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b, gone = t.encode(), np.zeros(len(t), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in op4_suffix.suffix_dedup(docs, heavy=3).collect()}
    assert got == want and sum(want.values()) > 1000


def test_op4_heavy_pieces_without_shuffle(docs, monkeypatch):
    """Pieces of heavy anchors come straight from the documents: whole texts don't shuffle once more for them."""
    plans, refined = [], op4_suffix.refined

    def look(many, *rest):
        plans.append(many._jdf.queryExecution().executedPlan().toString())
        return refined(many, *rest)

    monkeypatch.setattr(op4_suffix, "refined", look)
    got = {r.doc_id: tuple(r) for r in op4_suffix.suffix_dedup(docs, heavy=2).collect()}
    assert plans and not any("Exchange" in x for x in plans)
    assert got == {r.doc_id: tuple(r) for r in op4_suffix.suffix_dedup(docs).collect()}


@pytest.mark.parametrize("width", [300, 400])
def test_other_widths(spark, width):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}" for _ in range(900)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words) + " y"), (3, "z" * 90)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in op1_substring.substring_dedup(docs, width).collect()}
    assert got == {1: 0, 2: 900, 3: 0}
    n = len(" ".join(words))
    assert {r.doc_id: r.n_removed for r in op4_suffix.suffix_dedup(docs, width).collect()} == {1: 0, 2: n, 3: 0}
    with pytest.raises(ValueError):
        op1_substring.substring_dedup(docs, 5)


def test_op5_forgets_on_a_collision(monkeypatch):
    """Pre-tokens of one hash: what is known is compared, so ids stay right."""
    path = op5_packing.vocabulary()
    t = op5_packing.Tokens(path)
    t(["alpha beta"])
    t.points = t.points + np.uint32(1)  # as if other pre-tokens had these hashes
    got, _ = t(["alpha beta"])
    assert got.tolist() == op5_packing.encoder(path).encode_ordinary("alpha beta")


@pytest.mark.parametrize("most", [10, 26])
def test_op9_small_filter(odd, most):
    """A filter beyond its capacity lets more rows shuffle and changes nothing."""
    got = sorted(map(str, op9_exact_dedup.exact_dedup(odd, most=most).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == sorted(map(str, op9_exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect()))


def near_truth(percent=75):
    sets = {}
    for i, t in corpus():
        w = WORD.findall(lower(t or "").encode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_op6(docs, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op6_minhash.near_duplicates(docs).collect()}
    assert got == near_truth()
    rows = op6_minhash.near_duplicates(odd).collect()
    assert len(rows) == len(got) + 2 and [r.kept for r in rows if r.doc_id is None] == [True]


def test_op6_unlike_texts_of_one_id(spark):
    """A doc_id of two texts has the links of both."""
    say = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " more"), (3, say("b") + " more"), (4, say("c"))]
    for _ in range(2):
        got = sorted((r.doc_id, r.component_id) for r in op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@pytest.mark.parametrize(("block", "long"), [(2, 1024), (4096, -1), (2, 40)])
def test_op6_blocks(docs, monkeypatch, block, long):
    monkeypatch.setattr(op6_minhash, "BLOCK", block)
    monkeypatch.setattr(op6_minhash, "LONG", long)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op6_minhash.near_duplicates(docs).collect()}
    assert got == near_truth()


def test_op6_registers_agree_with_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    h, off = np.concatenate([np.sort(a[:2000]), np.sort(a[500:2500])]), np.array([0, 2000, 4000])
    r = op6_minhash.registers(h, off)
    est = op6_minhash.likeliest(r[:1], r[1:], np.array([2000]), np.array([2000]))[0]
    assert abs(est - 0.6) < 0.15


def test_op9(odd):
    rows = op9_exact_dedup.exact_dedup(odd).collect()
    groups = {}
    for r in odd.collect():
        groups.setdefault(lower(r.text or ""), []).append(r.doc_id)
    want = sorted((str(i), max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_op8(docs, spark):
    plan = {r.source: r for r in op8_mixing.plan(op8_mixing.sizes(docs)).collect()}
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall((r.text or "").encode()))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, total = dict.fromkeys(size, 0.0), set(), sum(size.values())
    while True:
        left = total - sum(3.0 * size[s] for s in full)
        w = sum(weight[s] for s in size if s not in full)
        target = {s: 3.0 * size[s] if s in full else left * weight[s] / w for s in size}
        over = {s for s in size if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    assert all(abs(plan[s].target - target[s]) < 1e-6 and plan[s].source_size == size[s] for s in size)
    mixed = op8_mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall((r.text or "").encode()))
    assert all(abs(taken.get(s, 0) - target[s]) <= 215 for s in size)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, op8_mixing.mix(docs).collect()))


def test_op5(docs):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    sequences = {}
    for r in op5_packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, x in corpus():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_op5_reruns_agree(docs, spark):
    """The same pieces however the rows lie, with repeated rows and ids that are null or very small; every range has documents."""
    odd = spark.createDataFrame([(None, "no id"), (None, None), (-(1 << 63), "least"), (-5, "below zero"), (7, "seven again")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd).unionByName(docs.select("doc_id", "text").where("doc_id % 3 = 0"))
    first, second = (sorted(map(str, op5_packing.pack(x).collect())) for x in (rows, rows.repartition(7, "text").union(rows.limit(0))))
    assert first == second
    assert len({r.sequence_id >> 40 for r in op5_packing.pack(rows).collect()}) == 4


@pytest.mark.parametrize("text", ["it's  a \n\n test\t\tx 12ab ", "don''t", "ñ é  ü x", "日本 語", " ", "a\r\n b", "x!!  ?? 'll", "<|endoftext|>", "a <|endoftext|> b's"])
def test_op5_tokens(text):
    path = op5_packing.vocabulary()
    got, n = op5_packing.Tokens(path)(["abc def", text, "plain  text\n"])
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")
    want = [whole.encode(x, add_special_tokens=False).ids for x in ("abc def", text, "plain  text\n")]
    assert got.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


@pytest.mark.parametrize(("leaf", "tile"), [(4096, op2_cover_tree.TILE), (12, op2_cover_tree.TILE), (12, 1500)])
def test_op2(spark, leaf, tile):
    rng = np.random.default_rng(3)
    vs = []
    for k in range(60):
        v = rng.normal(size=8)
        vs += [v, v + rng.normal(size=8) * 0.15, v.copy(), v + rng.normal(size=8) * 0.3]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vs)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1), (904, rows[0][1], None), (905, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(e), lab) for i, e, lab in rows if i < 900]
    links, comp = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    pairs = [(a[0], b[0]) for a in good for b in good if a[2] == b[2] and a[0] != b[0] and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.93]
    assert pairs
    for a, _ in pairs:
        links[a] += 1
    for _ in range(20):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op2_cover_tree.near_vectors(df, leaf=leaf, tile=tile).collect()}
    assert got == {i: (links[i], comp[i], comp[i] == i) for i in links}


def test_op2_null_and_repeated_ids(spark):
    """Rows of null or equal ids are vectors of their own: they join nothing but what is near them."""
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, 0), (2, y, 0), (None, x, 0), (None, y, 0), (5, [0.0, 0.0, 1.0], 0), (5, [2.0, 0.0, 0.0], 0), (None, [0.0, 0.0, -1.0], 0)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in op2_cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([("1", 2, "1", True), ("2", 1, "2", True), ("None", 2, "1", False), ("None", 1, "2", False), ("5", 0, "5", True), ("5", 2, "1", False), ("None", 0, "None", True)])


@pytest.mark.parametrize(("leaf", "tile"), [(4096, op2_cover_tree.TILE), (300, 200_000)])
def test_op2_prunes(spark, leaf, tile):
    """Thousands of linked vectors of 64 dimensions in clusters: equal to brute force, and most pairs are never compared."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 64))
    v = np.concatenate([c + rng.normal(size=(40, 64)) * s for c in centers for s in (0.2,)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), i // 40 % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(len(v))[:, None] // 40 % 2 == np.arange(len(v))[None, :] // 40 % 2)
    np.fill_diagonal(link, False)
    comp = np.arange(len(v))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(v)).min(1))
        if (new == comp).all():
            break
        comp = new
    assert link.sum() > 10_000
    got = {r.vec_id: (r.n_links, r.component_id) for r in op2_cover_tree.near_vectors(df, leaf=leaf, tile=tile).collect()}
    assert got == {i: (int(link[i].sum()), int(comp[i])) for i in range(len(v))}
    classes = op2_cover_tree.vectors(df.withColumn("label", F.col("label").cast("string"))).select(F.col("vec_id").alias("id"), F.concat_ws(":", "label", "size").alias("root"), "size", "v", F.lit(1).cast("long").alias("copies"))
    done = op2_cover_tree.found_links(classes, 0.93, leaf, tile).agg(F.sum("compared"), F.sum("pairs")).first()
    assert done[0] < len(v) ** 2 / 4 * 0.5


@pytest.mark.parametrize("size", [8, 64])
def test_traversal_takes_nodes_at_once(monkeypatch, size):
    """Two trees meet in few products, not one for each pair of nodes, and every link is found once."""
    from stringloom.llm import covertree

    rng, calls, settle = np.random.default_rng(6), [], covertree.settle
    centers = rng.normal(size=(40, size))
    x = np.concatenate([rng.normal(size=(700, size)), *(centers + rng.normal(size=(40, size)) * f for f in (0.01, 0.2, 0.25, 0.3, 0.35, 0.5))])
    x = op2_cover_tree.unit(x[rng.permutation(len(x))])
    weight = rng.integers(1, 4, len(x))
    monkeypatch.setattr(covertree, "settle", lambda *a, **k: calls.append(1) or settle(*a, **k))
    a, b = (covertree.Tree(x[k::2].copy(), op2_cover_tree.distance(0.93) / 4) for k in (0, 1))
    for one, other, k in ((a, b, 1), (a, a, 0)):
        found = covertree.Links(one, other, weight[::2], weight[k::2])
        covertree.traverse(one, other, found, 0.93, lambda i, j, one=one, other=other: (one.x[i] * other.x[j]).sum(1))
        link = one.x @ other.x.T >= 0.93
        if one is other:
            np.fill_diagonal(link, False)
            assert (found.count[0] + found.count[1]).tolist() == (link @ weight[::2]).tolist()
        else:
            assert found.count[0].tolist() == (link @ weight[1::2]).tolist() and found.count[1].tolist() == (weight[::2] @ link).tolist()
        assert link.any()
    assert size == 8 or len(calls) < 500


def test_cover_tree():
    """Levels nest, radii halve, children lie apart and cover their node."""
    from stringloom.llm.covertree import Tree, distances

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 5)).repeat(20, 0) + rng.normal(size=(600, 5)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = Tree(x, 0.05)
    assert len(t.kids) > 30 and sorted(t.points(0).tolist()) == list(range(600))
    for i, kids in t.kids.items():
        assert t.center[kids[0]] == t.center[i] and (t.scale[kids] <= t.scale[i] / 2).all() and (t.radius[kids] <= t.scale[kids] + 1e-12).all()
        assert sorted(np.concatenate([t.points(k) for k in kids]).tolist()) == sorted(t.points(i).tolist())
        apart = distances(x[t.center[kids]], x[t.center[kids]])[np.triu_indices(len(kids), 1)]
        assert (apart > t.scale[kids[0]] - 1e-9).all()
        assert all(distances(x[t.points(k)], x[t.center[[k]]]).max() <= t.radius[k] + 1e-7 for k in kids)


def test_op3(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(["xx!!", "JUNK", "buy"] if bad else ["the", "tree", "grows", "well"], k=30))))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "the tree")], "doc_id long, text string")
    got = op3_quality.score(docs, op3_quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 400) >= 396
    assert all(0 <= r.score <= 1 for r in got)
    none = op3_quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in op3_quality.score(docs, none).collect()} == {0.5}


def test_op7(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>menu</a></nav><div class='ad x'>buy</div><article><h1>Title &amp; so</h1><p><b>One  two<br><p>three &copy;<div class=comments><p>me</p></div></article><footer>f</footer>"
    plain = "<body><div id=sidebar>s</div><div><p>Main text</p></div><form>x</form>"
    rows = [(1, "http://a.example/1", page), (2, None, plain), (3, "x", None), (4, "http://a.example/", ""), (5, "http://b.example", "no <b markup")]
    got = {r.page_id: r.text for r in op7_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Title & so\nOne two\nthree ©" and got[2] == "Main text" and got[3] == "" and got[4] == ""


def test_op7_style_tree(spark):
    rows = [(i, "http://a.example/x", f"<body><div class=strip>Same words</div><div class=c>Own text {i} here</div>") for i in range(12)]
    got = op7_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Own text {r.page_id} here" for r in got)


def test_op7_tree_decides_inside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><div class=letter>Get our letter</div><p>Own text {0} here</p></article><div class=foot>Same</div>"
    rows = [(i, f"http://{h}.example/x", page.format(i)) for h, n in (("a", 12), ("b", 3)) for i in range(n)] + [(77, "http://c.example", page.format(77))]
    got = op7_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Title {r.page_id}\nOwn text {r.page_id} here" for r in got if r.page_id != 77) and len(got) == 16
    assert [r.text for r in got if r.page_id == 77] == ["Title 77\nGet our letter\nOwn text 77 here"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p title=\"abc>lost? no</p><p>b</p></article>", "lost? no\nb"),
        ("<article><p title='a>b' class=x>it's</p><p>5 < 6 > 4</p></article>", "it's\n5 < 6 > 4"),
        ("<title>never ends <article><p>text</p></article>", "text"),
        ("<article><svg><p>a</p></article><script>b", "a"),
        ("<article><p>a<!-- b </p></article>", "a"),
        ("<p>a</div></nav><p>b", "a\nb"),
        ("<div class='no-sidebar has-comments'><p>Main text</p></div>", "Main text"),
        ("<article class='post has-comments'><div class='post-header'><h1>Title</h1></div><p>Main text</p></article>", "Title\nMain text"),
        ("<form><nav>menu</nav><p>All of the main text is in a form</p></form>", "All of the main text is in a form"),
        ("<p>short words before it</p><div class=sidebar><nav>m</nav><article>Main text</article><p>x</p></div>", "Main text"),
        ("<article><p>The main text of this page</p></article><aside><article>Another one</article></aside>", "The main text of this page"),
        ("<article><p>The main text of this page</p><article class='comment'>I agree</article></article>", "The main text of this page"),
        ("<p>The main text of this page</p><div hidden>Much longer text that is hidden from all readers of it</div>", "The main text of this page"),
    ],
)
def test_op7_names(page, want):
    assert "\n".join(op7_html.kept(page, set())) == want


def test_op7_long_and_odd_pages():
    """Time grows with the length, whatever is unbalanced."""
    import time

    began = time.time()
    for x in ("<p " * 100_000 + '"', '<p a="' * 200_000, "<div>" * 200_000 + "</p>" * 200_000, "<nav>x" * 50_000, "<title>" * 200_000, "<!" * 300_000, "<p>some text of a long page</p>" * 160_000):
        op7_html.kept(x, set())
    assert time.time() - began < 60


def test_op7_clashing_columns_and_repeats(spark):
    rows = [(1, "http://a.example/1", "<p>one</p>", "h", "t", 1.0), (1, "http://a.example/1", "<p>one</p>", "h", "t", 1.0), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `__host` string, host string, `a.b` double").withColumns({"noise": F.lit(1), "text": F.lit("x")})
    got = op7_html.main_text(df)
    assert sorted(got.columns) == sorted([*df.columns, "n_chars"])
    assert sorted(str((r.text, r.host, r["a.b"])) for r in got.collect()) == sorted(map(str, [("one", "t", 1.0), ("one", "t", 1.0), ("", None, None)]))


def test_op7_tree_against_brute_force(spark):
    """The noise of a site is what entropies, computed in plain Python, call so."""
    import math
    from collections import Counter, defaultdict

    rng = random.Random(6)
    pages = []
    for h in range(3):
        for i in range(15):
            lines = "".join(f"<p class=c{rng.randrange(3)}>{rng.choice(['same', f'own {i} {h}', 'other'])}</p>" for _ in range(rng.randrange(1, 6)))
            pages.append((f"h{h}", f"<body><div class=a>fixed</div><article>{lines}<ul>{'<li>x</li>' * rng.randrange(4)}</ul></article></body>"))
    texts, styles, on = defaultdict(Counter), defaultdict(Counter), Counter()
    for h, x in pages:
        read = op7_html.Page(x)
        seen = {(p, t) for p, t, _, _ in read.found}
        for p, t in seen:
            texts[h, p][t] += 1
        for p in {p for p, _ in seen}:
            styles[h, p][tuple(read.children.get(p, ()))] += 1
            on[h, p] += 1

    def entropy(c, m):
        n = sum(c.values())
        return 1 - sum(x * math.log(x) for x in c.values()) / n / math.log(m)

    want = {k for k, m in on.items() if m >= 2 and max(entropy(texts[k], m), entropy(styles[k], m)) < op7_html.LOW}
    got = {tuple(r) for r in op7_html.site_noise(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert got == want and want


def test_op10(spark):
    docs = spark.createDataFrame([(i, "red green blue red" if i % 2 else "one two three one") for i in range(40)] + [(90, None), (91, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in op10_lm_score.lm_scores(docs, docs.where("doc_id % 2 = 1 AND doc_id < 20")).collect()}
    assert got[1].score > 0 > got[0].score and got[1].n_tokens == 4 and got[90].score == 0 == got[91].n_tokens


def test_op10_marks_target(spark, monkeypatch):
    ids = [3, 5, 5, 70, None, 1 << 40]
    docs = spark.createDataFrame([(i, f"t{i}") for i in (*range(80), 5, None, None, 1 << 40)], "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for bits in (6, 26):  # a full filter gives the same rows
        monkeypatch.setattr(op10_lm_score, "BLOOM", bits)
        got = sorted((r.text, r.target) for r in op10_lm_score.marked(docs, target).collect())
        assert got == sorted((t, i is not None and i in ids) for i, t in ((r.doc_id, r.text) for r in docs.collect()))


@pytest.mark.parametrize("chunk", [12_000_000, 20_000])
def test_op10_counts_exactly(spark, monkeypatch, chunk):
    """More words than any fixed vocabulary, in few chunks and in many: every word and pair counts as itself."""
    monkeypatch.setattr(op10_lm_score, "CHUNK", chunk)
    import math
    from collections import Counter

    rng = random.Random(8)
    texts = [" ".join(rng.choices(["red", "green", "blue"], k=20) + [f"w{i}x{k}" for k in range(200)] + [f"w{rng.randrange(400)}x{rng.randrange(200)}" for _ in range(20)]) for i in range(400)]
    rows = [*enumerate(texts), (7, "red w9x9"), (None, "blue blue"), (900, None), (901, " ")]
    target = {i for i, _ in rows if i is not None and i % 5 == 0}
    pairs, heads = (Counter(), Counter()), (Counter(), Counter())
    words = [["", *(t or "").split()] for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for m in (0, 1) if i in target else (0,):
            pairs[m].update(zip(w, w[1:]))
            heads[m].update(w[:-1])
    total, n = [sum(h.values()) for h in heads], len({x for w in words for x in w})
    assert n > 1 << 16
    scale = (total[1] / total[0], 1)
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        loss = [0.0, 0.0]
        for m in (0, 1):
            for b, x in zip(w, w[1:]):
                p = 0.6 * pairs[m][b, x] * scale[m] / max(heads[m][b] * scale[m], 1e-9) + 0.4 * (heads[m][x] * scale[m] + 0.5) / (total[1] + 0.5 * n)
                loss[m] -= math.log(min(p, 1))
        want.append((str(i), len(w) - 1, *(round(x / max(len(w) - 1, 1), 6) for x in (loss[1], loss[0], loss[0] - loss[1]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss, r.score) for r in op10_lm_score.lm_scores(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()]
    assert len(got) == len(want)
    for g, x in zip(sorted(got), sorted(want), strict=True):
        assert g[:2] == x[:2] and np.allclose(g[2:], x[2:], atol=2e-6)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (op1_substring.substring_dedup, op4_suffix.suffix_dedup, op6_minhash.near_duplicates, op9_exact_dedup.exact_dedup, op8_mixing.mix, op5_packing.pack):
        assert f(none).count() == 0
    assert op2_cover_tree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert op7_html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert op10_lm_score.lm_scores(none, none).count() == 0
