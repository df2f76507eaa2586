"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are dealt into blocks, and every block is a reference that all documents are factored against. A block publishes its phrases, the sequences of WINDOW consecutive words: of each distinct one its hash, and the
smallest document of the block that has it with the word it first begins at there. The index is dealt by the phrases' hashes, so asking it asks every reference block at once; what comes back to a block says, for each of
its phrases, the smallest document of all blocks where it stands, and the place, if that document is smaller than the block's own.

A document is then parsed greedily from left to right: where the phrase at a word has a source, a factor begins, and goes on word by word as long as the next phrase's source is the next word of the same document. So a
factor is a stretch of words that its source holds in one piece, WINDOW words at least. At a boundary the phrases that cross it are looked up like any other, with sources of their own, so what two factors only
cover together isn't lost; such factors overlap. The words that factors cover are duplicates. Which place of several is a phrase's source decides where factors are cut, not which words they cover.

A phrase that a third of all documents share is one entry of each block. The index never holds texts, and texts are shuffled once, to
their blocks. Hashes have 64 bits: with n distinct phrases, expect n*n / 2**65 that are wrongly the same.

Defined cases: a null text has no words and gives an empty kept text; a null doc_id counts as larger than any other; rows that repeat a
doc_id are no smaller than each other, so nothing is removed between them, and of such sources that tie the one with the smaller place is taken; a very long text is in one block, which then is as long; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Hashes, hashed, windows

#: Words in a phrase; bytes of text that a block and bytes of hashes that a range of the index are planned for.
WINDOW, BLOCK_BYTES, RANGE_BYTES = 13, 4 << 20, 16 << 20
LAST_ID, LAST_PLACE = np.iinfo(np.int64).max, np.iinfo(np.int64).max
ASK = "bucket int, block int, hashes binary, sources binary"
ANSWER = "block int, bucket int, at binary, sources binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,stop:int,source:long,source_start:int>>"


class Phrases:
    """The phrases of some documents, in the order of doc_id, and the distinct ones among them."""

    def __init__(self, ids: list, texts: list, window: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.null = [ids[i] is None for i in order]
        self.ids = [LAST_ID if ids[i] is None else ids[i] for i in order]
        self.words = [(texts[i] or "").encode().split() for i in order]  # bytes.split() splits at 0x20 and 0x09 to 0x0D
        known = Hashes()
        parts = [windows(hashed(w, known), range(window)) for w in self.words]
        self.sizes = [len(p) for p in parts]
        self.docs = np.repeat(np.array(self.ids, np.int64), self.sizes)
        self.places = np.concatenate([np.arange(n) for n in self.sizes]) if parts else np.zeros(0, np.int64)
        # documents come in order, so the first place of a phrase is in the block's smallest document
        self.hashes, first, self.which = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        self.first, self.first_place = self.docs[first], self.places[first]
        # within a bucket in the order of the text: neighbours then mostly share their source, which compresses well
        self.order = np.argsort(first, kind="stable")

    def buckets(self, n: int) -> np.ndarray:
        return ((self.hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def dealt(self, n: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, indices of its phrases) of the buckets that have some, the same each time."""
        b = self.buckets(n)[self.order]
        by = np.argsort(b, kind="stable")
        some, starts = np.unique(b[by], return_index=True)
        return [(int(k), part) for k, part in zip(some, np.split(self.order[by], starts[1:]), strict=True)] if len(some) else []


def packed(docs: np.ndarray, places: np.ndarray) -> bytes:
    """Places in documents, as runs of one document each: the documents' ids, the lengths of the runs, the steps from place to place. Compressed, as all three are small numbers mostly."""
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(docs))).astype("<u4")
    ids = np.diff(docs[starts], prepend=0).astype("<i8")  # wraps where it must, and back again
    steps = np.diff(places, prepend=0).astype("<i4")
    # bytes of one weight together, so that the high ones, which are all alike, take no room
    flat = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in (runs, ids, steps))
    return np.array([len(runs), len(steps)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(flat)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(data[:8], "<u4"))
    flat, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=12 * n + 4 * m), np.uint8), 0, []
    for count, kind in ((n, "<u4"), (n, "<i8"), (m, "<i4")):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at : at + count * width].reshape(width, count).T).view(kind).ravel())
        at += count * width
    runs, ids, steps = out
    return np.repeat(np.cumsum(ids, dtype=np.int64), runs), np.cumsum(steps, dtype=np.int64)


def factors(sources: np.ndarray, places: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(first word, word after the last, source, its first word there) from the source of each phrase, -1 for none, and the place in it."""
    if not len(sources):
        return []
    change = np.flatnonzero((np.diff(sources) != 0) | ((np.diff(places) != 1) & (sources[1:] >= 0))) + 1
    starts, stops = np.concatenate([[0], change]), np.concatenate([change, [len(sources)]])
    return [(int(s), int(e) + window - 1, int(sources[s]), int(places[s])) for s, e in zip(starts, stops, strict=True) if sources[s] >= 0]


def _asking(buckets: int, window: int):
    def run(key, table):
        p = Phrases(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), window)
        rows = p.dealt(buckets)
        return pa.table({
            "bucket": pa.array([k for k, _ in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "hashes": pa.array([p.hashes[i].tobytes() for _, i in rows], pa.binary()), "sources": pa.array([packed(p.first[i], p.first_place[i]) for _, i in rows], pa.binary()),
        })

    return run


def _answered(table):
    """Of one range of the index: for each block, where its phrases have an earlier source, and which."""
    asked = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    told = [unpacked(x) for x in table.column("sources").to_pylist()]
    hashes, own, place = np.concatenate(asked), np.concatenate([d for d, _ in told]), np.concatenate([p for _, p in told])
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
    sizes = np.diff(np.append(starts, len(order)))
    least = np.repeat(np.minimum.reduceat(own[order], starts), sizes)
    first = np.repeat(np.minimum.reduceat(np.where(own[order] == least, place[order], LAST_PLACE), starts), sizes)
    source, at_word = np.empty_like(own), np.empty_like(place)
    source[order], at_word[order] = least, first
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    at, sources = [], []
    for f, w, o in zip(np.split(source, cuts), np.split(at_word, cuts), np.split(own, cuts), strict=True):
        i = np.flatnonzero(f < o)
        at.append(i.astype(np.uint32).tobytes())
        sources.append(packed(f[i], w[i]))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "at": pa.array(at, pa.binary()), "sources": pa.array(sources, pa.binary())})


def _parsed(buckets: int, window: int):
    def run(docs, answers):
        p = Phrases(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), window)
        least, first = p.first.copy(), p.first_place.copy()
        phrases = dict(p.dealt(buckets))
        for r in answers.to_pylist():
            i = phrases[r["bucket"]][np.frombuffer(r["at"], np.uint32)]
            least[i], first[i] = unpacked(r["sources"])
        found, there = least[p.which], first[p.which]
        found = np.where(found < p.docs, found, -1) if len(found) else found.astype(np.int64)
        removed, kept, spans, at = [], [], [], 0
        for words, n in zip(p.words, p.sizes, strict=True):
            mine = factors(found[at : at + n], there[at : at + n], window)
            at += n
            gone = np.zeros(len(words), bool)
            for s, e, _, _ in mine:
                gone[s:e] = True
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode() if mine else b" ".join(words).decode())
            spans.append([{"start": s, "stop": e, "source": d, "source_start": w} for s, e, d, w in mine])
        return pa.table({
            "doc_id": pa.array([None if n else i for i, n in zip(p.ids, p.null, strict=True)], pa.int64()), "n_words": pa.array([len(w) for w in p.words], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
            "factors": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))),
        })

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the words left, joined by one space) and factors (start, stop, source, source_start)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    # a word is rarely under four bytes with its space, and a phrase has 16 bytes in the index
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total * 2 // RANGE_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # equal ids may meet in one block only by chance; the id and the length spread them
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_asking(buckets, window), ASK)
    # as many tasks as ranges, so that the largest doesn't grow with the input
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answered, ANSWER)
    return dealt.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(_parsed(buckets, window), KEPT)
