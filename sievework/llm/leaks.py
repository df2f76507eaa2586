"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; positions with 0 are ignored. The masks' hashes of every place in the benchmark are
looked up for every place of every document. A hit names a benchmark passage and an offset; around it the two texts are compared word
by word at that offset, substitutions included, and the overlap that is long and alike enough is a leak. The four masks together hit
every overlap of 13 words with any two substitutions and every one of 15 words with any three.

Words are lower-cased runs between white space and ASCII punctuation. A leak is a span of at least MIN_WORDS words (or the whole
passage, if that is shorter but has at least SHORTEST words) of which at least MIN_ALIKE are equal; the span begins and ends with an
equal word.

The benchmark is read in blocks of bounded size, each broadcast to one scan of the documents, so that neither the driver nor a worker
holds more than a block, whatever the benchmark's size. Documents are never shuffled.

Defined cases: null texts have no words and no leaks; passages of fewer than SHORTEST words are never found; a null id is carried as
null; repeated rows of either table count once for each id; of spans that tie in length the one that begins first is told; a very long text is searched whole, alone in its slice; empty tables give no leaks; other
columns don't matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest_of, lean, slices, without, written
from .words import Hashes, hashed, windows

#: Masks, 1 for the positions that count. Found by a random search for the two guarantees above; tests check them.
MASKS = ["111010101", "1100100111", "11010100101", "1110001011"]
MIN_WORDS, MIN_ALIKE, SHORTEST = 13, 0.8, 8
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
NO_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
LEAKS = "doc_id {doc}, item_id {item}, start long, n_words long, n_equal long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(NO_WORDS).split()


class Block:
    """Seeds of some passages: for each mask the sorted hashes and where they stand; bits says which hashes can't be there."""

    BITS = 22

    def __init__(self, texts: list[str | None]):
        known = Hashes()
        parts = [hashed(words_of(t), known) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.seeds = []
        # passages shorter than a mask are looked up as a whole
        for places in [[i for i, c in enumerate(m) if c == "1"] for m in MASKS] + [list(range(n)) for n in range(SHORTEST, max(map(len, MASKS)))]:
            whole = places == list(range(len(places)))
            h, at = [], []
            for i in np.flatnonzero((self.sizes == len(places)) if whole else (self.sizes > max(places))):
                w = windows(parts[i], places)
                h.append(w)
                at.append(self.starts[i] + np.arange(len(w)))
            if not h:
                continue
            h, at = np.concatenate(h), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << self.BITS, bool)
            bits[h >> np.uint64(64 - self.BITS)] = True
            self.seeds.append((places, h[order], at[order], bits))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in words and in the block's words where a seed is the same; the offset of each pair once."""
        found = []
        for places, h, at, bits in self.seeds:
            mine = windows(words, places)
            maybe = np.flatnonzero(bits[mine >> np.uint64(64 - self.BITS)])
            lo, hi = np.searchsorted(h, mine[maybe], "left"), np.searchsorted(h, mine[maybe], "right")
            n = hi - lo
            if n.sum():
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([np.repeat(maybe, n), at[np.repeat(lo, n) + step]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        here, there = np.concatenate(found, axis=1)
        return here, there

    def spans(self, words: np.ndarray, begin: int, end: int, here: np.ndarray, there: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, words, equal words) of each leak in the document at words[begin:end], given the hits in it."""
        out = []
        item = np.searchsorted(self.starts, there, "right") - 1
        done: dict[tuple[int, int], int] = {}  # passage and offset: where its last span ended
        for k in np.lexsort((here, here - there, item)):
            i, offset, p = int(item[k]), int(here[k] - there[k]), int(here[k])
            if p < done.get((i, offset), -1):
                continue
            first, size = int(self.starts[i]), int(self.sizes[i])
            lo, hi = max(begin, first + offset), min(end, first + size + offset)
            equal = words[lo:hi] == self.words[lo - offset : hi - offset]
            s, e = _extended(equal, p - lo)
            done[i, offset] = lo + e
            n, same = e - s, int(equal[s:e].sum())
            if n >= min(MIN_WORDS, size) and same >= MIN_ALIKE * n:
                out.append((i, lo + s - begin, n, same))
        return out


def _extended(equal: np.ndarray, seed: int) -> tuple[int, int]:
    """The longest span with seed in it of which MIN_ALIKE are equal, without differing words at its ends."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1 - MIN_ALIKE, -MIN_ALIKE))]).round(6)
    # a start is worth a look if no earlier one has as small a sum; its farthest end comes from the largest sum from there on
    starts = np.flatnonzero(total[: seed + 1] < np.concatenate([[np.inf], np.minimum.accumulate(total[:seed])]))
    ahead = np.maximum.accumulate(total[seed + 1 :][::-1])[::-1]
    ends = len(ahead) - np.searchsorted(ahead[::-1], total[starts], "left")
    best = int(np.argmax(np.where(ends > 0, ends - starts, -len(total))))
    s, e = int(starts[best]), seed + int(ends[best])
    same = np.flatnonzero(equal[s:e])
    return s + int(same[0]), s + int(same[-1]) + 1


def _searched(shared):
    def run(batches):
        block, items = shared.value
        known = Hashes()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                begins = np.cumsum(sizes) - sizes
                words = hashed([w for t in texts for w in t], known)
                here, there = block.hits(words)
                doc = np.searchsorted(begins, here, "right") - 1
                rows = []
                for d in np.unique(doc):
                    mine = doc == d
                    found = block.spans(words, int(begins[d]), int(begins[d] + sizes[d]), here[mine], there[mine])
                    rows += [(int(d), *f) for f in found]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), items.take(pa.array([r[1] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))],
                    ["doc_id", "item_id", "start", "n_words", "n_equal"],
                )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per leaked span: doc_id, item_id, start (in words), n_words, n_equal."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    kinds = {"doc": rows.schema["doc_id"].dataType.simpleString(), "item": items.schema["item_id"].dataType.simpleString()}
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, found = max(1, -(-total // block_bytes)), []
    for b in range(blocks):
        table = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((Block(table.column("text").to_pylist()), table.column("item_id").combine_chunks()))
        found.append(rows.mapInArrow(lean(_searched(shared)), LEAKS.format(**kinds)))
    return reduce(DataFrame.unionAll, found).distinct()


def leaked_documents(leaks: DataFrame) -> DataFrame:
    """One row per document and passage: doc_id, item_id, n_spans, n_words, n_equal, start of the first span."""
    return leaks.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_spans"), F.sum("n_words").alias("n_words"), F.sum("n_equal").alias("n_equal"), F.min("start").alias("first_start"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """docs without the documents that have a leak; all columns, whatever their names. Rows are told apart by id and SHA-256 of the text, so that each is kept or dropped by its own text, null and repeated ids too."""
    keyed = docs.select(F.struct(F.col(doc_id).alias("gone_id"), digest_of(F.col(text)).alias("gone_digest")).alias("doc"), F.col(text).alias("body"))
    bad = find_leaks(keyed, benchmark, "doc", "body", **names).select("doc_id.gone_id", "doc_id.gone_digest").distinct()
    return without(docs, written(bad, "leaked"), doc_id, text)
