"""What a service asks before and after a lookup: validation, cost, admission, quotas, tenants, keys and metrics."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import secrets
import threading
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import FilterError, TypedFilter
from ..plans.search import ListConfig, Snapshot, meet, search

# Fixed limits of a check.
RUNES, LISTS, TOPK, CHECKS = 512, 100, 1000, 100
# The terms of a lookup's cost, in bytes.
PER_ORD, FIXED, PER_RUNE, PER_GRAM, PER_HIT = 8, 16 << 10, 8, 200, 192
PAYLOAD_BYTE, PATH_ORD, ALTERNATIVE, SCALAR_BYTE, ALTERNATIVE_ORD, SCALAR_BYTE_ORD = 1, 192, 128, 8, 6, 1
#: Upper bounds of the latency histogram, in seconds; the last bucket has none.
BUCKETS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def flaw(q: Column, lists: Column, threshold: Column, topk: Column) -> Column:
    """Why a check cannot be answered, null if it can. A threshold of 0 asks for no floor."""
    return (
        F.when(F.coalesce(q, F.lit("")) == "", "q is empty")
        .when(F.char_length(q) > RUNES, f"q is longer than {RUNES} characters")
        .when(F.coalesce(F.size(lists), F.lit(0)) < 1, "no lists")
        .when(F.size(lists) > LISTS, f"more than {LISTS} lists")
        .when(threshold.isNotNull() & (F.isnan(threshold) | ~threshold.between(0, 1)), "threshold is from 0 to 1")
        .when(topk.isNotNull() & ~topk.between(1, TOPK), f"topk is from 1 to {TOPK}")
    )


def no_repeated_filter(raw: str) -> None:
    """A request names its filter once, at the top and in each of its checks."""
    from ..functions.filters import _Pairs, load

    def look(x: object) -> None:
        if isinstance(x, _Pairs):
            if sum(k == "filter" for k, _ in x) > 1:
                raise FilterError("filter comes twice")
            for k, v in x:
                if k != "filter":
                    look(v)
        elif isinstance(x, list):
            for v in x:
                look(v)

    look(load(raw))


def check_flaws(checks: DataFrame, lists: dict[str, tuple[Snapshot, ListConfig]]) -> DataFrame:
    """checks with `error`: a flaw, the lists there are not, or a filter that cannot be used. Each different text of a filter is
    looked at once, on the driver: there are no more than CHECKS in a batch."""
    known = F.array(*(F.lit(x) for x in lists)) if lists else F.array().cast("array<string>")
    gone = F.array_except("lists", known)
    out = checks.withColumn("error", F.coalesce(flaw(F.col("q"), F.col("lists"), F.col("threshold"), F.col("topk")), F.when(F.size(gone) > 0, F.concat(F.lit("no such list: "), F.array_join(gone, ", ")))))
    texts = [r["filter"] for r in out.where("filter IS NOT NULL").select("filter").distinct().limit(CHECKS + 1).collect()]
    if len(texts) > CHECKS:
        raise ValueError(f"more than {CHECKS} different filters")
    for text in texts:
        try:
            names = [n for n, _ in TypedFilter.parse(text).terms]
        except FilterError as e:
            out = out.withColumn("error", F.when(F.col("error").isNull() & (F.col("filter") == text), f"filter: {e}").otherwise(F.col("error")))
            continue
        for name in names:
            without = [n for n, (_, c) in lists.items() if name not in c.fields]
            if without:
                hit = F.arrays_overlap("lists", F.array(*(F.lit(x) for x in without)))
                out = out.withColumn("error", F.when(F.col("error").isNull() & (F.col("filter") == text) & hit, f"filter: {name} is not filterable").otherwise(F.col("error")))
    return out


def batch(checks: DataFrame, lists: dict[str, tuple[Snapshot, ListConfig]]) -> tuple[DataFrame, DataFrame]:
    """Results (check_no, list, entry_id, score, key) of checks (check_no, q, lists, threshold, topk, filter), and (check_no, error)
    of each. A check that cannot be answered says why and does not disturb the others."""
    told = check_flaws(checks, lists)
    fine = told.where("error IS NULL").withColumn("wanted", F.array_distinct("lists"))
    texts = [None, *(r["filter"] for r in fine.where("filter IS NOT NULL").select("filter").distinct().collect())]  # at most CHECKS, see check_flaws
    parts = []
    for pos, (name, (at, c)) in enumerate(lists.items()):
        for text in texts:
            own = fine.where(F.array_contains("wanted", name)).where(F.col("filter").eqNullSafe(F.lit(text)))
            default = min(c.k or 100, 100)
            asked = own.select(F.col("check_no").alias("query_id"), "q", F.when(F.col("threshold") == 0, -1.0).otherwise(F.col("threshold")).alias("threshold"), F.coalesce("topk", F.lit(default)).alias("topk"))
            hits = search(asked, at, c, TypedFilter.parse(text) if text else None)
            place = own.select(F.col("check_no").alias("query_id"), F.array_position("wanted", name).alias("place"), F.coalesce("topk", F.lit(100)).alias("most"))
            parts.append(meet(hits.withColumn("list", F.lit(name)), place, "query_id"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id", "place"))
    out = out.withColumn("n", turn).where(F.col("n") <= F.col("most"))
    return out.select(F.col("query_id").alias("check_no"), "list", "entry_id", "score", "key"), told.select("check_no", "error")


# --- cost and admission ---


@dataclass(frozen=True)
class Size:
    """Of a segment: ordinals that lookups reach, and bytes of payload."""

    ords: int
    payload_bytes: int = 0


def sizes(at: Snapshot) -> tuple[list[Size], int]:
    """Of the parts of a snapshot, and its number of tombstones."""
    out = []
    for s, _ in at.parts:
        payload = F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)) if "payload" in s.entries.columns else F.lit(0)
        row = s.entries.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("n"), payload.alias("b")).first()
        out.append(Size(int(row.n), int(row.b)))
    return out, at.dead.distinct().count() if at.dead is not None else 0


def cost(parts: list[Size], dead: int, c: ListConfig, topk: int, runes: int = RUNES, flt: TypedFilter | None = None) -> int:
    """Bytes a lookup is charged: what it may hold at once, erring upward, and for a filter what it may look at. topk 0: unlimited."""
    total = 0
    terms = flt.terms if flt else ()
    alternatives = sum(len(v) for _, v in terms)
    scalar = sum(len(str(x).encode()) for _, v in terms for _, x in v)
    levels = runes if c.fallback else 1
    for i, p in enumerate(parts):
        hits = min(p.ords, topk + (dead if i == 0 and c.mode == "ngram" else 0)) if topk > 0 else p.ords
        total += PER_HIT * hits
        if c.mode == "ngram":
            total += PER_ORD * p.ords + FIXED + runes * PER_RUNE + runes * len(c.sizes) * PER_GRAM
        if terms:
            times = levels if c.mode == "exact" else 1
            total += times * (PAYLOAD_BYTE * p.payload_bytes + PATH_ORD * len(terms) * p.ords + (ALTERNATIVE_ORD * alternatives + SCALAR_BYTE_ORD * scalar) * p.ords)
    return total + ALTERNATIVE * alternatives + SCALAR_BYTE * scalar


class Refused(RuntimeError):
    pass


class Admission:
    """A budget that lookups take their cost from, in the order they come, and wait for. None may cost more than all of it."""

    def __init__(self, budget: int):
        self.budget, self.used, self.line, self.lock = budget, 0, [], threading.Condition()

    @contextmanager
    def admit(self, n: int, patience: float = 10.0):
        if n > self.budget:
            raise Refused(f"costs {n} of a budget of {self.budget}")
        turn, until = object(), time.monotonic() + patience
        with self.lock:
            self.line.append(turn)
            try:
                while self.line[0] is not turn or self.used + n > self.budget:
                    left = until - time.monotonic()
                    if left <= 0 or not self.lock.wait(left) and time.monotonic() >= until:
                        raise Refused("the queue is too long")
                self.used += n
            finally:
                self.line.remove(turn)
                self.lock.notify_all()
        try:
            yield
        finally:
            with self.lock:
                self.used -= n
                self.lock.notify_all()


class Bucket:
    """Tokens that come back at `rate` a second, up to twice as many at once; a check takes one and never waits."""

    def __init__(self, rate: float, now=time.monotonic):
        self.rate, self.most, self.now = rate, max(1.0, 2 * rate), now
        self.left, self.at, self.lock = self.most, now(), threading.Lock()

    def take(self, n: int = 1) -> int:
        """0, or after how many seconds to come back."""
        with self.lock:
            t = self.now()
            self.left, self.at = min(self.most, self.left + (t - self.at) * self.rate), t
            if self.left >= n:
                self.left -= n
                return 0
            return max(1, math.ceil((n - self.left) / self.rate))


# --- tenants ---


@dataclass(frozen=True)
class Quotas:
    max_lists: int = 0
    max_total_keys: int = 0
    scratch_budget_mb: int = 0
    rate_per_sec: float = 0.0

    def lists(self, have: list[str], name: str) -> str | None:
        """Why a list of that name cannot be made. One that is there is replaced."""
        if self.max_lists and name not in have and len(have) >= self.max_lists:
            return f"max_lists: {len(have)} of {self.max_lists} in use"
        return None

    def keys(self, used: int, more: int, own: int = 0) -> str | None:
        """Why `more` keys cannot be put in; own: those of a list that they replace."""
        if self.max_total_keys and used + more - own > self.max_total_keys:
            return f"max_total_keys: {used} and {more} more would be {used + more - own} of {self.max_total_keys}"
        return None


def new_key() -> tuple[str, str]:
    """An API key, and the digest of it that a tenants file has."""
    key = secrets.token_hex(32)
    return key, key_digest(key)


def key_digest(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


@dataclass
class Tenant:
    name: str
    quotas: Quotas = field(default_factory=Quotas)
    shared_reads: bool = False
    bucket: Bucket | None = None
    admission: Admission | None = None


class Tenants:
    """Tenants by the digests of their keys, from {name: {key_digests, quotas, shared_reads}}. On a reload a tenant of the same
    quotas keeps its tokens and its queue."""

    def __init__(self, text: str, before: Tenants | None = None):
        self.by_digest: dict[str, Tenant] = {}
        old = {t.name: t for t in before.by_digest.values()} if before else {}
        for name, own in json.loads(text).items():
            q = Quotas(**own.get("quotas", {}))
            t = Tenant(name, q, bool(own.get("shared_reads")), Bucket(q.rate_per_sec) if q.rate_per_sec else None, Admission(q.scratch_budget_mb << 20) if q.scratch_budget_mb else None)
            if name in old and old[name].quotas == q:
                t.bucket, t.admission = old[name].bucket, old[name].admission
            if not own.get("key_digests"):
                raise ValueError(f"{name} has no keys")
            for d in own["key_digests"]:
                if len(d) != 64 or set(d) - set("0123456789abcdef"):
                    raise ValueError(f"{name}: {d!r} is no digest")
                if d in self.by_digest:
                    raise ValueError(f"a key of {name} is also one of {self.by_digest[d].name}")
                self.by_digest[d] = t

    def of(self, key: str) -> Tenant | None:
        """Every digest is compared, so the time tells nothing of which one is near."""
        own, found = key_digest(key), None
        for d, t in self.by_digest.items():
            if hmac.compare_digest(own, d):
                found = t
        return found

    @staticmethod
    def may_write(t: Tenant, owner: str) -> bool:
        return t.name == owner

    @staticmethod
    def may_read(t: Tenant, owner: str) -> bool:
        return t.name == owner or t.shared_reads and owner == ""


# --- metrics ---


def bucket_of(seconds: Column) -> Column:
    """The upper bound of a duration's bucket; infinity is the last one's."""
    out = F.when(seconds <= BUCKETS[0], F.lit(BUCKETS[0]))
    for b in BUCKETS[1:]:
        out = out.when(seconds <= b, F.lit(b))
    return out.otherwise(F.lit(float("inf")))


def histogram(log: DataFrame, seconds: str, *by: str) -> DataFrame:
    """(by, le, count): how many durations are at most le, for each of the buckets, seen or not; no row per duration moves."""
    bounds = (*BUCKETS, float("inf"))
    return log.where(F.col(seconds).isNotNull()).groupBy(*by).agg(*(F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds))).select(*by, F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)))).alias("x")).select(*by, "x.*")


def counters(log: DataFrame) -> DataFrame:
    """(tenant, list, queries, hits, mutations, refused) of a log (tenant, list, kind, hits, status)."""
    return log.groupBy("tenant", "list").agg(F.count_if(F.col("kind") == "query").alias("queries"), F.coalesce(F.sum(F.when(F.col("kind") == "query", F.col("hits"))), F.lit(0)).alias("hits"), F.count_if(F.col("kind").isin("upsert", "delete", "replace")).alias("mutations"), F.count_if(F.col("status") == 429).alias("refused"))


def percentiles(log: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: n, p50, p99 and queries a second of durations, by rank: the one at n/2 and the one at n*99/100. A row per duration
    is sorted in one task, so this is for the measurements of a run."""
    s = F.sort_array(F.collect_list(seconds))
    row = log.agg(s.alias("s"))
    n = F.size("s")
    at = lambda i: F.element_at("s", F.least(F.floor(i).cast("int"), n - 1) + 1)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return row.where(n > 0).select(n.alias("n"), at(n / 2).alias("p50"), at(n * 99 / 100).alias("p99"), (n / F.nullif(total, F.lit(0.0))).alias("qps"))


def exposition(rows: DataFrame, name: str, kind: str, value: str, *labels: str) -> str:
    """Rows as text that a metrics server reads; one line per row, of which there are few."""
    quote = lambda x: str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    show = lambda x: "+Inf" if x == float("inf") else str(x)
    lines = [f"# TYPE {name} {kind}"]
    for r in rows.orderBy(*labels).limit(100_000).collect():
        lines.append(f"{name}{{{','.join(f'{x}=' + chr(34) + quote(show(r[x])) + chr(34) for x in labels)}}} {r[value]}")
    return "\n".join(lines) + "\n"


def audit(tenant: str, action: str, name: str, status: int, at: str) -> str:
    return json.dumps({"at": at, "tenant": tenant, "action": action, "list": name, "status": status}, sort_keys=True)


