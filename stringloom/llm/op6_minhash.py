"""MinHash near-dedup with SetSketch registers.

A document's set is hashed into REGISTERS registers. Each element starts a stream of arrivals at random registers, the same
wherever the element occurs; a register keeps its first arrival, truncated to floor(1 - log_b t): an exponentially spaced
minimum. Registers of a union are the maxima of both, and two sets agree in a register with a chance of at least their
Jaccard similarity. Documents that agree in all ROWS registers of one of the bands are candidates; at similarity 0.75 a
pair escapes all bands with a chance of 2e-5. For candidates the similarity that makes the seen numbers of greater, equal
and less registers likeliest is computed; pairs far below the threshold go, the others are verified on their whole sets.

Texts with equal word sequences are collapsed first. Each text is tested against the least member of all its buckets. In
buckets that then hold several components, members outside the least member's are tested against that one; where that still
leaves several, members of different ones are tested too, in blocks, without emitting pairs. So a pair that shares a bucket
goes untested only if both ends are in one component already.

Defined results: a null text or one without words has n_shingles 0 and links with nothing. A null doc_id has a null
component and is kept. Rows that share a doc_id count as one document with the links of all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .components import components
from .textnp import BASE, LOWER, U, arrow_text, mix, powers, signed, slices, spans_hash, window_hash, word_bounds

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
STEP, SHIFT, TOP = 1.02, 20.0, 4095
#: Members on each side of a block, and shingles of a set that is held there: 8 bytes each.
BLOCK, LONG = 4096, 1024


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed shingles, sorted in each row, their offsets, and two hashes of each row's word sequence."""
    buf = LOWER[buf]
    starts, ends, row = word_bounds(buf, off)
    rows = len(off) - 1
    words = spans_hash(buf, starts, ends)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    hashes, owner = [], []
    grams = window_hash(words, size)
    if len(grams):
        inside = row[: len(grams)] == row[size - 1 :]
        hashes.append(grams[inside])
        owner.append(row[: len(grams)][inside])
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            hashes.append(mix(window_hash(words, k)[first[few]] + U(k)))
            owner.append(few)
    sequence = np.zeros((rows, 2), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        power = powers(int(n.max()))[np.arange(len(words)) - np.repeat(first, n)]
        for k, values in enumerate((words, mix(words + BASE))):
            sequence[some, k] = signed(mix(np.add.reduceat(values * power, first[some]) + n[some].astype(U)))
    if not hashes:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64), sequence
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.append(0, np.cumsum(np.bincount(o, minlength=rows))), sequence


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of registers for each set; that of an empty set is 0."""
    n = np.diff(off)
    best = np.full((len(n), REGISTERS), np.inf)
    todo, horizon = np.flatnonzero(n), np.zeros(len(n))
    horizon[todo] = (np.log(REGISTERS) + 3) / n[todo]
    while len(todo):
        best[todo] = np.inf
        mean = REGISTERS * horizon[todo]
        chunk = 2 ** np.ceil(np.log2(mean + 2 * np.sqrt(mean) + 1)).astype(np.int64)
        for c in np.unique(chunk):
            group = todo[chunk == c]
            owner = np.repeat(group, n[group])
            at = np.arange(len(owner)) - np.repeat(np.cumsum(n[group]) - n[group], n[group]) + np.repeat(off[group], n[group])
            element, base, done = h[at], np.zeros(len(at)), 0
            while len(element):
                draw = mix(element[:, None] + (np.arange(done, done + c, dtype=U) + U(1)) * BASE)
                t = -np.log(((draw >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / REGISTERS
                t = base[:, None] + np.cumsum(t, 1)
                ok = t <= horizon[owner][:, None]
                place = owner.repeat(c).reshape(ok.shape)[ok] * REGISTERS + (mix(draw[ok]) % U(REGISTERS)).astype(np.int64)
                np.minimum.at(best.reshape(-1), place, t[ok])
                more = t[:, -1] <= horizon[owner]
                element, owner, base, done = element[more], owner[more], t[more, -1], done + int(c)
        todo = todo[np.isinf(best[todo]).any(1)]
        horizon[todo] *= 2
    return np.clip(np.floor(1 - np.log(best / SHIFT) / np.log(STEP)), 0, TOP).astype(np.uint16)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches of sets of na and nb elements."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        log = lambda z: np.log(np.maximum(z, 1e-300))
        return more * log(x) + less * log(y) + same * log(1 - x - y)

    for _ in range(30):  # the likelihood has one maximum
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, s1, s2, registers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = arrow_text(batch.column(1))
            for first, last in slices(off):
                for i in range(first, last, 512):
                    j = min(i + 512, last)
                    h, o, sequence = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
                    raw = registers(h, o)
                    offsets = np.arange(j - i + 1, dtype=np.int32) * (2 * REGISTERS)
                    binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(o)), pa.array(sequence[:, 0]), pa.array(sequence[:, 1]), binary], ["doc_id", "n", "s1", "s2", "registers"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, registers binary")


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose likeliest similarity is at least `least`."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = likeliest(unpack(batch.column("ra")), unpack(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(got >= least))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("a"), F.coalesce("text", F.lit("")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}

        def members(key: tuple, text: pa.Scalar) -> np.ndarray:
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                buf, off = arrow_text(pa.array([text.as_py()]))
                known[key] = shingles(buf, off, size)[0]
            return known[key]

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            ok = []
            for i in range(batch.num_rows):
                p, q = members((a[i].as_py(), hash(x[i].as_py())), x[i]), members((b[i].as_py(), hash(y[i].as_py())), y[i])
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ready = pairs.join(texts, "a").join(texts.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    return ready.mapInArrow(run, "a long, b long").distinct()


def split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, center, component, main, size) of members of buckets that hold several components; main is the center's."""
    lab = labels.select(F.col("id").alias("doc_id"), "component")
    m = members.select("key", "doc_id", "center").join(lab, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.min_by("component", "doc_id").alias("main")).where("lo < hi")
    mixed = stage(mixed.select("key", "main", "size"), "op6-mixed")
    return stage(m.join(mixed, "key"), "op6-split")


def held_sets(split: DataFrame, docs: DataFrame, sketches: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, registers, set) of the documents in split; set is null where it has over LONG shingles."""
    ids = split.where("size > 2 AND doc_id != center").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = arrow_text(batch.column(1))
            for i, j in slices(off):
                h, o, sequence = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
                sets = [h[x:y].tobytes() if y - x <= LONG else None for x, y in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sequence[:, 0]), pa.array(sequence[:, 1]), pa.array(sets, pa.binary())], ["doc_id", "s1", "s2", "set"])

    found = texts.mapInArrow(run, "doc_id long, s1 long, s2 long, set binary").dropDuplicates(["doc_id", "s1", "s2"])
    return sketches.select("doc_id", "s1", "s2", "n", "registers").join(found, ["doc_id", "s1", "s2"]).drop("s1", "s2")


def across(split: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b, sure): pairs of members of one bucket that are in different components so far. In each bucket those outside
    the component of its least member meet all others, in blocks of at most about BLOCK by BLOCK. A pair is looked at in the
    first band it agrees in. Where both sets are at hand only linked pairs come out, else likely ones, which are not sure."""
    grid = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = split.where("size > 2 AND doc_id != center").select("key", "doc_id", "component", "main", grid.alias("grid")).join(sets, "doc_id")
    every, own = F.sequence(F.lit(0), F.col("grid") - 1), F.pmod(F.xxhash64("doc_id"), F.col("grid")).cast("int")
    cell = lambda i, j, outside: F.struct(i.alias("i"), j.alias("j"), F.lit(outside).alias("outside"))
    base = F.transform(every, lambda x: cell(x, own, False))
    cells = F.when(F.col("component") != F.col("main"), F.concat(base, F.transform(every, lambda x: cell(own, x, True)))).otherwise(base)
    both = rows.withColumn("cell", F.explode(cells)).select("key", "cell.*", "doc_id", "component", "main", "n", "registers", "set")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("outside").to_numpy()
        ids, comp, main, size = (t.column(c).to_numpy() for c in ("doc_id", "component", "main", "n"))
        regs, sets = unpack(t.column("registers")), t.column("set").to_pylist()
        band = int((regs == regs[:1]).reshape(-1, BANDS, ROWS).all((0, 2)).argmax())
        o, b = np.flatnonzero(side), np.flatnonzero(~side)
        found: list[tuple[int, int, bool]] = []
        for i in o:
            # of two that are both outside, one looks at the other
            k = b[(comp[b] != comp[i]) & ((comp[b] == main[b]) | (ids[b] > ids[i]))]
            if not len(k):
                continue
            same = regs[k] == regs[i]
            # below this many equal registers the estimate cannot reach `least`
            k = k[(same.sum(1) >= REGISTERS * least * 0.7) & ~same.reshape(-1, BANDS, ROWS)[:, :band].all(2).any(1)]
            if not len(k):
                continue
            k = k[likeliest(np.broadcast_to(regs[i], (len(k), REGISTERS)), regs[k], np.full(len(k), size[i]), size[k]) >= least]
            known = np.array([sets[i] is not None and sets[x] is not None for x in k], bool)
            if known.any():
                q = k[known]
                mine, theirs = np.frombuffer(sets[i], U), np.frombuffer(b"".join([sets[x] for x in q]), U)
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[q]) - size[q])
                q = q[(inter > 0) & (100 * inter >= percent * (size[i] + size[q] - inter))]
                found += [(min(ids[i], x), max(ids[i], x), True) for x in ids[q]]
            found += [(min(ids[i], x), max(ids[i], x), False) for x in ids[k[~known]]]
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "sure"])

    return both.groupBy("key", "i", "j").applyInArrow(run, "a long, b long, sure boolean").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, slack: float = 0.15) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    slack: a pair whose estimate is that much below the threshold, five standard errors, is not verified.
    """
    docs = docs.select("doc_id", "text")
    least = percent / 100 - slack
    sketches = stage(sketch(docs, size), "op6-sketches")
    filled = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = stage(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "op6-classes")
    reps = stage(filled.join(classes, ["s1", "s2"]).where("doc_id = rep").select("doc_id", "n", "registers", "s1", "s2").dropDuplicates(["doc_id", "s1", "s2"]), "op6-reps")

    band = F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("registers", k * ROWS * 2 + 1, ROWS * 2)) for k in range(BANDS)))).alias("key")
    rows = reps.select("doc_id", band)
    buckets = stage(rows.groupBy("key").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "op6-buckets")
    members = stage(rows.join(buckets, "key"), "op6-members")
    star = members.where("doc_id != center").groupBy(F.col("doc_id").alias("b")).agg(F.min("center").alias("a")).select("a", "b")
    links = stage(verified(likely(star, reps, least), docs, size, percent), "op6-links")
    labels = components(links)
    split = split_buckets(members, labels)
    outside = split.where("component != main").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    more = stage(verified(likely(outside, reps, least), docs, size, percent), "op6-links")
    if not more.isEmpty():
        links = stage(links.unionByName(more), "op6-links")
        labels = components(links)
        split = split_buckets(split, labels)
    more = stage(across(split, held_sets(split, docs, reps, size), least, percent), "op6-rest")
    if not more.isEmpty():
        links = links.unionByName(more.where("sure").select("a", "b")).unionByName(verified(more.where("NOT sure").select("a", "b"), docs, size, percent))
        labels = components(stage(links, "op6-links"))

    of = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"), "copies")
    large = of.orderBy(F.desc("copies"), "s1", "s2").limit(1000).drop("copies")  # these groups of copies need no shuffle
    hot = sketches.where("n > 0").join(F.broadcast(large), ["s1", "s2"], "left")
    rest_rows = hot.where("component IS NULL").drop("component").join(of.drop("copies"), ["s1", "s2"], "left")
    empty = sketches.where("n = 0").withColumn("component", F.col("doc_id"))
    every = [x.select("doc_id", "n", "component") for x in (hot.where("component IS NOT NULL"), rest_rows, empty)]
    out = every[0].unionByName(every[1]).unionByName(every[2])
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
