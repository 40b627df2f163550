"""Session helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = (1 << 63) - 1
#: Tables written so far, for sweep().
STAGED: list[str] = []
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stringloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back, so that a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stringloom-{name}-{uuid.uuid4().hex}"
    clean = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # what the write shuffled is of no use after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, clean)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that this session's operators wrote for themselves. Results that were not written yet need them."""
    for path in STAGED:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    STAGED.clear()


def renamed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text", "source")) -> tuple[DataFrame, dict[str, str]]:
    """docs with other columns than `keep` under names that no operator uses, and those names by the ones to give back."""
    names = {x: x if x in keep else f"column_{i}_of_input" for i, x in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{x}`").alias(y) for x, y in names.items())), names


def given(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(y).alias(x) for x, y in names.items()))


def free(name: str, taken: list[str]) -> str:
    """name, with marks in front until no column has it."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z only. lower() does just that on pure ASCII, and much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h1, h2) of documents: a null text is empty, a null id counts as the largest; h1 and h2 name the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
    )
