"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens). Counting joins the texts' digests to it, encodes one text of
each digest it lacks, appends those counts, and joins again. Digests are shuffled, 32 bytes each; a text is encoded where it is read, unless its digest may be a repeated or a held one. What may be
is said by a Bloom filter of at most BLOOM_BITS bits, so that what is broadcast has a bound at any size and the plan is the same at all sizes. Texts that the filter holds back are grouped by digest, one of each task first, and
those that really lack a count, the filter's errors among them, are encoded after that. A filter that is too full holds back more texts; each digest is still encoded once.

Defined cases: a null text is empty (and counts as the tokenizer counts the empty text); repeated rows, repeated and null ids each get their row; a digest with many rows is spread over tasks when counts are joined; a very
long text is encoded at once by the library, alone in its slice; there are no ties, as equal texts have equal counts; an empty table gives no rows and appends nothing; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_of, slices, spread_join, written

CACHE = "digest binary, tokenizer string, n_tokens long"
#: Bits of a filter for each digest in it, and at most.
BITS_EACH, BLOOM_BITS = 16, 1 << 28
WORD = 64


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the file and of the library's name and version, since either may change counts."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def _counter(path: str):
    """texts -> numbers of tokens, as the library gives them without begin, end or added special tokens."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]


def _places(digests: pa.Array, bits: int) -> np.ndarray:
    """Four places for each digest of 32 bytes."""
    flat = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    return (flat % np.uint64(bits)).astype(np.int64)


class Bloom:
    """A filter of digests, made in tasks and joined word by word; bits is a power of two."""

    def __init__(self, digests: DataFrame, most: int):
        n = digests.count()
        self.bits = bits = min(most, max(1 << 12, 1 << (BITS_EACH * max(1, n) - 1).bit_length()))

        def marked(batches):
            on = np.zeros(bits // WORD, np.uint64)
            for batch in batches:
                if batch.num_rows:
                    at = _places(batch.column("digest"), bits).ravel()
                    np.bitwise_or.at(on, at // WORD, np.uint64(1) << (at % WORD).astype(np.uint64))
            words = np.flatnonzero(on)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(on[words].view(np.int64))], ["word", "mask"])

        rows = digests.select("digest").mapInArrow(marked, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        self.words = np.zeros(bits // WORD, np.uint64)
        self.words[np.asarray(rows.column("word"))] = np.asarray(rows.column("mask")).view(np.uint64)

    def __contains__(self, _):
        raise TypeError("ask may_hold")

    def may_hold(self, digests: pa.Array) -> np.ndarray:
        if not len(digests):
            return np.zeros(0, bool)
        at = _places(digests, self.bits)
        return ((self.words[at // WORD] >> (at % WORD).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def _chosen(shared, held: bool):
    """The rows whose digest the filter may hold, or the others."""

    def run(batches):
        for batch in batches:
            may = shared.value.may_hold(batch.column("digest"))
            yield batch.filter(pa.array(may if held else ~may))

    return run


def _encoded(path: str, tokenizer: str):
    def run(batches):
        count = _counter(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pc.cast(part.column("digest"), pa.binary()), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, doc_id: str = "doc_id", text: str = "text", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, digest, n_tokens. cache is the folder of the cache table; it is created if need be."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    keyed = written(body.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-keys")
    held = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest").distinct().withColumn("held", F.lit(True))
    one = written(keyed.groupBy("digest").agg(F.count("*").alias("copies")).join(held, "digest", "left"), "token-digests")
    stats = one.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count_if(F.expr("held is null")).alias("misses")).first()
    if stats["misses"]:
        texts, share = body.select("digest", "text"), spark.sparkContext.broadcast
        back = share(Bloom(one.filter("copies > 1 or held"), bloom_bits))
        fresh = texts.mapInArrow(_chosen(back, False), texts.schema)
        # digests without a count among those that are held back: repeated ones, and the filter's errors
        late = written(one.filter("held is null").select("digest").mapInArrow(_chosen(back, True), "digest binary"), "token-late")
        if not late.isEmpty():
            some = texts.mapInArrow(_chosen(share(Bloom(late, bloom_bits)), True), texts.schema).groupBy("digest").agg(F.any_value("text").alias("text"))
            fresh = fresh.unionAll(some.join(late, "digest", "left_semi"))
        fresh.mapInArrow(_encoded(tokenizer_path, version), CACHE).write.mode("append").option("compression", "zstd").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).join(one.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return spread_join(keyed, written(counts, "token-counts"), "digest", "doc_id", stats["rows"], "left").select("doc_id", "n_bytes", "digest", "n_tokens")
