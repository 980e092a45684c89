"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagelog.llm import alignment, chats, convnet, decontaminate, katz, languages, mixing, rules, setjoin, spelling, suffixes, token_counts, warc
from stagelog.llm.common import configure_llm, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure_llm(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_warc_round_trip(spark, folder):
    """All pages archived, then read back by byte ranges."""
    found = warc.archive_and_read(table(spark, folder, "pages"))
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to_id")).alias("refers_to"))


@query
def op2_chat_collapse(spark, folder):
    """Conversations that no other extends, rendered."""
    return chats.collapse_and_render(table(spark, folder, "conversations"))


SQL["op2_chat_collapse"] = chats.SQL


@query
def op5_token_counts(spark, folder):
    """Tokens of every text."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op8_pareto_mix(spark, folder):
    """All documents mixed to source targets, texts of varied words being likelier."""
    return mixing.mix(table(spark, folder, "documents"), priority=mixing.variety(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_decision_list(spark, folder):
    """Quality verdict for every document."""
    judged, _ = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query
def op9_byte_convnet(spark, folder):
    """Quality probability of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = convnet.classify(docs, convnet.train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", convnet.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_benchmark_leaks(spark, folder):
    """Documents that contain benchmark items."""
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "similarity")


@query
def op6_shingle_join(spark, folder):
    """Near-duplicate components of all documents."""
    return setjoin.components(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op7_suffix_dedup(spark, folder):
    """Bytes of every document that repeat an earlier one."""
    found = suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_katz_scores(spark, folder):
    """Log probability of every text under a backoff model of the training texts."""
    return katz.score(table(spark, folder, "documents"))


@query
def op11_spelling_variants(spark, folder):
    """Words of all documents, their near words and common forms."""
    return spelling.variants(table(spark, folder, "documents"))


@query
def op12_tokenizer_alignment(spark, folder):
    """Two tokenizers aligned over every text, with corpus-wide counts of linked tokens."""
    found, _ = alignment.align_and_count(table(spark, folder, "documents"))
    return found


@query
def op13_language(spark, folder):
    """Language of every document by the shortest code."""
    docs = table(spark, folder, "documents")
    trees = languages.learn(docs.where(~languages.held_out(F.col("doc_id"))).select("text", "lang"))
    found = languages.predict(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
