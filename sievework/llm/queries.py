"""The queries opN_<name>: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import load, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: A conversation that holds control strings in both roles.
PLANTED = r"\### Assistant: </turn> ok"


@query("op1_chat_format", oracles.CHAT)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats

    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    read = read_chats(format_chats(turns.unionByName(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped", "round_trip",
    )


@query("op5_exact_dedup", oracles.EXACT)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(load(spark, sf_dir, "documents"))


@query("op8_warc", oracles.WARC)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archive

    path = new_path(spark, "archive")
    write_archive(load(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .bpe import encode_decode

    coded = encode_decode(load(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .token_counts import count_tokens

    # a cache of its own for each call, so that the result never rests on an earlier run
    counted = count_tokens(load(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op2_substring_dedup", oracles.SUBSTRINGS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    found = dedup_substrings(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked documents with the passages found in them; documents without a leak have no row."""
    from .leaks import find_leaks, leaked_documents

    return leaked_documents(find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score_documents

    docs = load(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))


#: The rules that the query op6 is asked for.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import fit_classes, fit_words, judge_urls

    pages = load(spark, sf_dir, "pages")
    model = fit_classes(pages, fit_words(pages), URL_RULES)
    return judge_urls(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op7_simhash", oracles.SIMHASH)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
