"""What the operators of this subpackage share: the shared work folder, written intermediate tables, size-checked broadcasts and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one narrow column (ids or digests) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 4 << 20
#: What empties the caches that a Python worker keeps from task to task, of the operators that it has run.
CACHES: list[Callable[[], None]] = []


def empty_caches() -> None:
    """For a task that shares its worker, and so its memory, with earlier ones of other operators."""
    for empty in CACHES:
        empty()
    gc.collect()


#: glibc's way to give freed memory back to the system; other C libraries lack it.
MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hand_back() -> None:
    """Gives the memory that this process has freed back to the system: two Python workers, which outlive their tasks, share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if MALLOC_TRIM:
        MALLOC_TRIM(0)


def lean(run: Callable) -> Callable:
    """run, a function from batches to batches, that hands memory back before its first batch and after its last."""

    @functools.wraps(run)
    def of(batches):
        hand_back()
        yield from run(batches)
        hand_back()

    return of


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share. The session's spark.checkpoint.dir; only in a local session, as in tests, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "sievework")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{work_dir(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    at, system = _at(spark, path)
    system.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.sievework_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again, instead of at the application's end."""
    for df in tables:
        at, system = _at(df.sparkSession, df.sievework_path)
        system.delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes the shuffle files of queries that have ended, as Spark does whenever the driver's JVM happens to collect its garbage; then the executors' JVMs collect theirs, which makes them return
    the heap they don't need. Tasks are dealt to all free cores in turn, so each idle executor gets some; results never depend on it."""
    gc.collect()
    context = spark.sparkContext
    context._jvm.System.gc()
    if not re.match(r"local(\[|$)", context.master):
        n = context.defaultParallelism
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as it is, so that the join shuffles. df should be a written table of narrow rows: it is counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest_of(text: Column) -> Column:
    """The SHA-256 of a text, null as empty: 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs without the rows whose id and text's SHA-256 are in gone (gone_id, gone_digest; a written table). Ids are compared with nulls equal; columns of docs may have any names."""
    i, d = fresh(docs, "gone_id"), fresh(docs, "gone_digest")
    listed = checked_broadcast(gone.select(F.col("gone_id").alias(i), F.col("gone_digest").alias(d)))
    return docs.join(listed, F.col(doc_id).eqNullSafe(F.col(i)) & (digest_of(F.col(text)) == F.col(d)), "left_anti")


#: A key with more than this share of the rows, and more rows than SPREAD_LEAST, is spread by spread_join; at most so many keys are.
SPREAD_KEYS, SPREAD_LEAST = 2000, 100


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to right on key, where any key may hold most rows of left: the keys with more than rows / SPREAD_KEYS rows, so at most SPREAD_KEYS of them, are dealt by a hash of the
    column `by` of left to as many parts, each with its own copy of right's row. right has a key once. Beyond those keys it is Spark's own join."""
    hot = left.groupBy(key).agg(F.count("*").alias("hot_rows")).filter(F.col("hot_rows") > F.greatest(F.lit(SPREAD_LEAST), F.lit(rows // SPREAD_KEYS)))
    hot = written(hot.select(key, F.ceil(F.col("hot_rows") / max(SPREAD_LEAST, rows // SPREAD_KEYS)).cast("int").alias("parts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)  # SPREAD_KEYS rows at most
    dealt = left.join(few, key, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("parts")))).drop("parts")
    copied = right.join(few, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return dealt.withColumn("part", F.col("part").cast("int")).join(copied, [key, "part"], how).drop("part")


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most about limit bytes of the column; a longer single row is a piece of its own."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    hand_back()  # Arrow and malloc keep what earlier batches took


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
