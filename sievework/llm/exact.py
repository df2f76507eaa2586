"""Exact deduplication by a log-structured merge index of digests.

Every task fills a memtable with the digests of its rows and, when it is full, flushes it as sorted runs, one for each digest range,
each with a Bloom filter. A range's runs are compacted in tiers of FANOUT: a digest that no other run's filter admits passes without
being compared; the others are merged, keeping the identifier that stays and the number of rows. Ranges are equal slices of the digest
space, so they are even whatever the texts are; a text that a third of all rows hold is one entry in each run.

A hit is no proof: each row of a group of several is compared byte for byte with the row that stays. Rows of digests whose texts
differ are then grouped by digest and text.

Defined cases: a null text counts as empty; a null doc_id counts as smaller than any other; if several rows hold the doc_id that stays
with the same text, one of them stays (a tie: any of them); a very long text is a digest like any other, and is shuffled only if another row has the same; an empty table gives no rows; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, digest_of, fresh, spread_join, without, written

#: Rows in a memtable, entries that a range of the index is planned for, runs merged at once, filter bits an entry.
MEMTABLE, RANGE_ROWS, FANOUT, BITS = 200_000, 500_000, 8, 10
#: Rows of a group of copies that one task compares.
GROUP_ROWS = 200
WIDTH = 32
NULL_ID = np.iinfo(np.int64).min
RUN = "bucket int, n int, digests binary, ids binary, counts binary, kept binary, bloom binary"


class Run:
    """Sorted distinct digests with, for each, the doc_id that stays, the number of rows, the number of rows with that doc_id; and a filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, kept: np.ndarray, bloom: np.ndarray | None = None):
        self.digests, self.ids, self.counts, self.kept = digests, ids, counts, kept
        self.bloom = self._filter() if bloom is None else bloom

    def _places(self, digests: np.ndarray, bits: int) -> np.ndarray:
        return digests[:, 1:] % np.uint64(bits)

    def _filter(self) -> np.ndarray:
        bits = max(64, -(-len(self.digests) * BITS // 8) * 8)
        on = np.zeros(bits, np.uint8)
        on[self._places(self.digests, bits).ravel().astype(np.int64)] = 1
        return np.packbits(on)

    def admits(self, digests: np.ndarray) -> np.ndarray:
        places = self._places(digests, len(self.bloom) * 8).astype(np.int64)
        return ((self.bloom[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)

    def __getitem__(self, at) -> tuple[np.ndarray, ...]:
        return self.digests[at], self.ids[at], self.counts[at], self.kept[at]


def merged(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by digest with one entry each: the largest id, all rows, the rows of that id."""
    order = np.lexsort((~ids, *digests.T[::-1]))
    digests, ids, counts, kept = digests[order], ids[order], counts[order], kept[order]
    first = np.ones(len(digests), bool)
    first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    if not len(starts):
        return digests, ids, counts, kept
    top = np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
    return digests[starts], ids[starts], np.add.reduceat(counts, starts), np.add.reduceat(np.where(ids == top, kept, 0), starts)


def compact(runs: list[Run]) -> Run:
    """One run of several, in tiers."""
    while len(runs) > 1:
        tier, runs = runs[:FANOUT], runs[FANOUT:]
        passed, met = [], []
        for r in tier:
            maybe = np.zeros(len(r.digests), bool)
            for other in tier:
                if other is not r:
                    maybe |= other.admits(r.digests)
            passed.append(r[~maybe])
            met.append(r[maybe])
        parts = [*passed, merged(*(np.concatenate(x) for x in zip(*met, strict=True)))]
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort(whole[0].T[::-1])
        runs.append(Run(*(x[order] for x in whole)))
    return runs[0]


def _flushed(ranges: int):
    def flush(digests: list[np.ndarray], ids: list[np.ndarray]):
        n = sum(map(len, ids))
        one = np.ones(n, np.int64)
        d, i, c, k = merged(np.concatenate(digests), np.concatenate(ids), one, one)
        bucket = ((d[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(ranges + 1))
        rows = [(b, Run(d[s:e], i[s:e], c[s:e], k[s:e])) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int32()), pa.array([len(r.ids) for _, r in rows], pa.int32()), pa.array([_bytes(r.digests) for _, r in rows], pa.binary()), *(pa.array([getattr(r, x).tobytes() for _, r in rows], pa.binary()) for x in ("ids", "counts", "kept", "bloom"))],
            ["bucket", "n", "digests", "ids", "counts", "kept", "bloom"],
        )

    def run(batches):
        digests, ids, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            digests.append(_keys(b"".join(batch.column("digest").to_pylist())))
            ids.append(np.asarray(batch.column("doc_id").fill_null(NULL_ID)))
            n += batch.num_rows
            if n >= MEMTABLE:
                yield flush(digests, ids)
                digests, ids, n = [], [], 0
        if n:
            yield flush(digests, ids)

    return run


def _keys(raw: bytes) -> np.ndarray:
    """Digests as rows of words, which sort as the bytes do."""
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, WIDTH // 8)


def _bytes(digests: np.ndarray) -> bytes:
    return digests.astype(">u8").tobytes()


def _compacted(table):
    runs = [
        Run(_keys(r["digests"]), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["kept"], np.int64), np.frombuffer(r["bloom"], np.uint8))
        for r in table.to_pylist()
    ]
    d, ids, counts, kept = compact(runs)[:]
    many = np.flatnonzero(counts > 1)
    raw = _bytes(d[many])
    return pa.table({
        "digest": pa.array([raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)], pa.binary()),
        "keep_id": pa.array(ids[many], mask=ids[many] == NULL_ID), "group_size": pa.array(counts[many]), "keepers": pa.array(kept[many]),
    })


def build_index(keyed: DataFrame, rows: int) -> DataFrame:
    """The compacted index of keyed (doc_id, digest of 32 bytes), without the digests that one row has: digest, keep_id, group_size, keepers (rows with keep_id)."""
    ranges = max(1, -(-rows // RANGE_ROWS))
    runs = keyed.select("doc_id", "digest").mapInArrow(_flushed(ranges), RUN)
    return runs.groupBy("bucket").applyInArrow(_compacted, "digest binary, keep_id long, group_size long, keepers long")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (of the row that stays: the largest doc_id of equal texts), group_size, kept, text_sha256.
    digest_bits under 256 blanks the rest of each digest in the index, for tests of the verification."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sha = F.sha2("text", 256)
    digest = F.unhex(F.rpad(F.substring(sha, 1, digest_bits // 4), 64, "0"))
    keyed = written(body.select("doc_id", digest.alias("digest"), sha.alias("text_sha256")), "digests")
    rows = keyed.count()
    hits = written(build_index(keyed, rows), "digest-index")
    index = checked_broadcast(hits)
    # hits are verified: every row of such a digest against the row that stays. A large group is spread over several tasks, each of which gets the text that stays
    met = body.withColumn("digest", digest).join(index, "digest")
    salts = F.ceil(F.col("group_size") / GROUP_ROWS).cast("int")
    one = met.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    single, several = one.filter("keepers = 1"), one.filter("keepers > 1").dropDuplicates(["digest"])
    held = single.unionByName(several).select("digest", F.col("text").alias("held"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    spread = met.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    unlike = written(spread.join(held, ["digest", "salt"]).filter(F.col("text") != F.col("held")).select("digest").distinct(), "digest-collisions")
    # a group that a third of all rows is in would be one key: spread
    out = spread_join(keyed, hits, "digest", "doc_id", rows, "left")
    if not unlike.isEmpty():
        bad = checked_broadcast(unlike)
        groups = met.join(bad, "digest", "left_semi").groupBy("digest", "text", "doc_id").count().groupBy("digest", "text").agg(F.max("doc_id").alias("keep"), F.sum("count").alias("size"), F.max_by("count", F.coalesce("doc_id", F.lit(int(NULL_ID)))).alias("several"))
        exact = groups.select(F.sha2("text", 256).alias("text_sha256"), "keep", "size", "several", F.lit(True).alias("collided"))
        out = out.join(exact, "text_sha256", "left").select(
            "doc_id", "text_sha256", "digest",
            F.when(F.col("collided"), F.col("keep")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(F.col("collided"), F.col("size")).otherwise(F.col("group_size")).alias("group_size"),
            F.when(F.col("collided"), F.col("several")).otherwise(F.col("keepers")).alias("keepers"),
        )
    kept = F.col("keepers").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = out.select("doc_id", F.when(F.col("keepers").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "keepers")
    if hits.filter("keepers > 1").isEmpty() and unlike.isEmpty():
        return one.drop("keepers")
    # rows that repeat the doc_id that stays: one of them is kept
    several = one.filter("kept and keepers > 1")
    ranked = several.withColumn("kept", F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id")) == 1)
    return one.filter("not (kept and coalesce(keepers, 1) > 1)").unionByName(ranked).drop("keepers")


def keep_distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops; all columns, whatever their names."""
    found = written(exact_duplicates(docs, doc_id, text), "exact")
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest"), (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("all")).distinct()
    gone = written(gone, "exact-gone")
    left = without(docs, gone.filter("all"), doc_id, text)
    twice = gone.filter("not all")
    if twice.isEmpty():
        return left
    # rows that repeat the one that stays: one of them
    i, d, own = fresh(docs, "gone_id"), fresh(docs, "gone_digest"), fresh(docs, "own_digest")
    some = left.withColumn(own, digest_of(F.col(text))).join(checked_broadcast(twice.select(F.col("gone_id").alias(i), F.col("gone_digest").alias(d))), F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(own) == F.col(d)), "left_semi")
    return without(left, twice, doc_id, text).unionByName(some.dropDuplicates([doc_id, own]).drop(own))
