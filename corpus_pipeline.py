"""Filter, deduplicate, decontaminate and mix the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagelog.llm import decontaminate, mixing, rules, setjoin, suffixes
from stagelog.llm.common import configure_llm, cut_lineage, new_folder, table


def passing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Rows with a null id are judged, too: by id and text."""
    configure_llm(spark)
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    judged, _ = rules.judge(keyed.select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id", F.xxhash64("text").alias("text_key")])
    good = cut_lineage(judged.where("kept").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct())
    return keyed.join(good.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__k")), "left_semi").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    configure_llm(spark)
    return setjoin.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that repeat an earlier document; documents of which nothing is left go.

    Where a removed run ends inside a character, its leftover bytes become replacement characters.
    """
    configure_llm(spark)
    cut = suffixes.remove_repeats(docs, digest=False, rest_text=True)
    cut = cut.where("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") > 0, F.col("rest_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars"))
    return cut.withColumns({"n_chars": size.cast(docs.schema["n_chars"].dataType), "text": text}).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    configure_llm(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources of what is left, mixed to their targets: copies and words taken of each document."""
    configure_llm(spark)
    return mixing.mix(docs, priority=mixing.variety(F.col("text"))).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality rules", passing),
    ("n-gram Jaccard join", distinct),
    ("suffix-array dedup", unrepeated),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mixed),
]
ORACLE_SQL = None  # removing repeated bytes and sampling have no plain SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each writing its result and the next one reading it."""
    configure_llm(spark)
    docs = table(spark, sf_dir, "documents")
    for step, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{step}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
