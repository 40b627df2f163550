"""Tables that repeat few names many times: no plan may send rows that grow with the input to the driver, nor make pairs of like rows."""

import pytest
from pyspark.sql import functions as F

from stringloom.plans import catalogue

DIR, COPIES = "/root/testdata/sf0.001", 50
#: Rows that any step may make for each row of the input, by what a lookup may have as results.
FINDINGS = {
    "batch_checks": 12,
    "exact_topk_order": 12,
    "compact_search": 12,
    "filter_stats": 12,
    "exact_filter_stats": 12,
    "filtered_in": 12,
    "golden_probes": 24,
    "ngram_nofloor": 12,
    "key_attribution": 12,
    "ngram_search_multikey": 12,
    "ngram_strict": 12,
    "overlay_search": 12,
    "tombstone_mask": 12,
    "filtered_search": 12,
    "ngram_search": 12,
    "ngram_search_prefix": 12,
    "recall_by_category": 48,
    "query_settings": 12,
    "gram_stats": 2,
}


def repeated(spark, path: str, table: str, key: str) -> int:
    df = spark.read.parquet(f"{DIR}/{table}.parquet")
    n = df.count()
    df.crossJoin(spark.range(COPIES).withColumnRenamed("id", "i")).withColumn(key, F.col(key) + F.col("i") * n).drop("i").coalesce(2).write.parquet(f"{path}/{table}.parquet")
    return n * COPIES


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large"))
    rows = {t: repeated(spark, path, t, k) for t, k in (("part", "p_partkey"), ("customer", "c_custkey"))}
    spark.read.parquet(f"{DIR}/nation.parquet").write.parquet(f"{path}/nation.parquet")
    return path, rows


def steps(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from steps(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from steps(plan.plan())
    else:
        made = plan.metrics().get("numOutputRows")
        yield kind, made.get().value() if made.isDefined() else 0
        for i in range(plan.children().size()):
            yield from steps(plan.children().apply(i))


@pytest.mark.parametrize("name", FINDINGS)
def test_no_step_outgrows_the_input(spark, large, name):
    path, rows = large
    n = rows["customer" if name == "batch_checks" else "part"]
    df = catalogue.QUERIES[name](spark, path)
    df.collect()
    made = list(steps(df._jdf.queryExecution().executedPlan()))
    assert max([x for kind, x in made if kind == "BroadcastExchangeExec"], default=0) < n / 4
    assert max(x for _, x in made) <= FINDINGS[name] * n
