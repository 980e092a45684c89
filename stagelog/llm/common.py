"""What the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stagelog.session import configure, cut_lineage, release, shared_folder

__all__ = ["SPACES", "configure_llm", "cut_lineage", "fold", "let", "new_folder", "numbered", "release", "table", "words"]

SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def configure_llm(spark: SparkSession) -> SparkSession:
    """Settings of these queries: Arrow batches bounded by rows and bytes, since texts can be long."""
    configure(spark)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, spark.sparkContext.getConf().get(size, "64m"))  # as the session was built
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    # each step ends in a written table, so its shuffle files can go at once
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of non-space characters of ``text``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fold(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Number rows from 0 in an order, without one task holding all of them.

    A sort by ranges is written with its places; only the sizes of its partitions are added up in one task.
    """
    ids = cut_lineage(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ids.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ids.join(starts, "__part").withColumn(
        name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the cluster's shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
