"""SimHash near-duplicates with pigeonring filtering.

The 64 bits of a fingerprint are SEGMENTS consecutive segments on a ring. If two fingerprints differ in at most t bits, then from some
segment on, every chain of consecutive segments, 1 to all of them, differs in at most (its length) * t / SEGMENTS bits in total. With
six segments and t = 2 these budgets are 0, 0, 1, 1, 1, 2. So for each of the six starts two fingerprints that may link are equal on two segments, and
on one half of the next three. Those bits, twelve masks in all, are the keys of the index. A pair that meets is pruned by the budgets of its
chain before the full Hamming distance is taken.

Only distinct fingerprints are indexed, so copies cost nothing. Counts, smallest and largest member of each key are aggregated before
the shuffle; a key with two fingerprints is that pair. Keys with up to CROWD fingerprints are compared pairwise; in a larger key each
fingerprint names all fingerprints within one bit of it, among the bits that the key leaves free. Two fingerprints are within two bits
if and only if they name a common one, and those that name one are all linked, so each is linked to the smallest: as many rows as fingerprints times a constant, and no link is lost.

Defined cases are with near_duplicates and one_of_each; besides, a very long text is hashed a bounded number of shingles at a time, a bit that is set in exactly half the shingles (a tie) is 0, and other columns don't
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, digest_of, forget, lean, slices, without, written
from .graph import components

SEGMENTS, CROWD, SEED = 6, 32, 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(data: bytes, size: int = 3) -> int:
    """The SimHash of a text's shingles of size words, as an unsigned number: A-Z lower-cased, words split at ASCII white space, repeats counted."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    text, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    h = np.fromiter((digest(text[s:e], SEED) for s, e in zip(first, last, strict=True)), "<u8", n)
    on = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        on += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; one row per row of docs. Null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint((t or "").encode(), size) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(at: Iterable[int]) -> int:
    return sum(1 << i for i in at)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def ring() -> list[list[int]]:
    """The segments: lists of bit positions."""
    cuts = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(max_diff: int = 2) -> list[tuple[int, list[int]]]:
    """For each key: its mask, and the masks of the chain's first 1, 2, ... segments."""
    if max_diff != 2:
        raise ValueError("the keys are laid out for two differing bits")
    parts = ring()
    out = []
    for i in range(SEGMENTS):
        chain = [parts[(i + j) % SEGMENTS] for j in range(SEGMENTS)]
        nearly = [b for p in chain[2:5] for b in p]
        steps = [_bits(b for p in chain[: j + 1] for b in p) for j in range(SEGMENTS)]
        for half in (nearly[: len(nearly) // 2], nearly[len(nearly) // 2 :]):
            out.append((_bits(chain[0] + chain[1] + half), steps))
    return out


def _near(a: Column, b: Column, k: Column, max_diff: int) -> Column:
    """The chain's budgets, the shortest chain first, then the whole distance. k: the number of the key."""
    diff = a.bitwiseXOR(b)
    keys = masks(max_diff)
    ok = F.lit(True)
    for j in range(SEGMENTS - 1):
        step = F.element_at(F.array(*[F.lit(_signed(steps[j])) for _, steps in keys]), k + 1)
        ok = ok & (F.bit_count(diff.bitwiseAND(step)) <= (j + 1) * max_diff // SEGMENTS)
    return ok & (F.bit_count(diff) <= max_diff)


def links(fps: DataFrame, max_diff: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the distinct values of fps.fp that connect exactly those within max_diff bits, directly or through each other."""
    keys = masks(max_diff)
    entry = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (m, _) in enumerate(keys)]
    indexed = fps.select("fp", F.explode(F.array(*entry)).alias("e")).select("fp", "e.k", "e.key")
    met = written(indexed.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-keys")
    pairs = met.filter("n = 2").filter(_near(F.col("a"), F.col("b"), F.col("k"), max_diff)).select("a", "b")
    more = checked_broadcast(met.filter("n > 2").select("k", "key", "n"))
    members = indexed.join(more, ["k", "key"])
    some = members.filter(F.col("n") <= crowd).groupBy("k", "key").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    some = some.select("k", "all", F.posexplode("all").alias("i", "a")).select("k", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    some = some.filter(_near(F.col("a"), F.col("b"), F.col("k"), max_diff)).select("a", "b")
    # crowded keys: each fingerprint names itself and its neighbours in the free bits
    free = F.array(*[F.array(*[F.lit(0).cast("long")] + [F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m, _ in keys])
    named = members.filter(F.col("n") > crowd).select("k", "fp", F.explode(F.element_at(free, F.col("k") + 1)).alias("bit")).select("k", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("name"))
    least = named.groupBy("k", "name").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a != top").drop("top")
    star = named.join(least, ["k", "name"]).filter("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(some).unionAll(star).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, max_diff: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id: the smallest doc_id that links reach, its own included.

    Defined cases: null and wordless texts have fingerprint 0 and link like any other; null doc_ids are no component's id, unless all
    of the component are null; repeated rows are linked to each other; an empty table gives no rows."""
    held = written(fingerprints(docs, doc_id, text, size), "fingerprints")
    fps = written(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps, max_diff)).withColumnsRenamed({"node": "fp", "root": "root"})
    rooted = fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    moved = rooted.filter("fp != root")
    # only components of several fingerprints need their smallest doc_id worked out
    tops = moved.select("root", "least").unionAll(fps.join(moved.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("root"), "least")).groupBy("root").agg(F.min("least").alias("top"))
    named = rooted.join(tops, "root", "left").select("fp", F.coalesce("top", "least").alias("component_id"))
    return held.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _described(prefixes, size: int):
    def run(batches):
        of = prefixes()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                fp = np.array([fingerprint((t or "").encode(), size) for t in texts], np.uint64)
                n, prefix = of(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(fp.view(np.int64)), n, prefix], ["id", "digest", "fp", "n", "prefix"])

    return run


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 3, max_diff: int = 2) -> DataFrame:
    """The operator as a filter: docs with one document of each group, the one with the smallest id; all columns. A group is what links reach. Two texts link if their
    fingerprints differ in max_diff bits or fewer, as above, or if the similarity of their sets of five-word shingles is least or more: such texts mostly differ in more bits
    than an index of fingerprints finds, so similar.py finds them.

    Defined cases: null and wordless texts have fingerprint 0 and are alike; rows with the same id and text are one document, and stay or go together; a null id is smaller than any other; of equal ids
    the row written first stays; an empty table gives no rows. Rows are told apart by id and SHA-256 of the text, so nothing goes by a chance collision; other columns only pass, whatever their names."""
    from .similar import frequent, prefix_column, similar_links

    body = docs.select(F.col(doc_id).alias("id"), digest_of(F.col(text)).alias("digest"), F.col(text).alias("text"))
    prefixes = prefix_column(frequent(body), docs.sparkSession, least)
    kind = body.schema["id"].dataType.simpleString()
    told = body.mapInArrow(lean(_described(prefixes, size)), f"id {kind}, digest binary, fp long, n int, prefix array<long>").withColumn("node", F.monotonically_increasing_id())
    told = written(told, "near-rows")
    # the fingerprints' links, between the first rows of each; and every row to the first of its fingerprint
    fps = written(told.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    ends = [fps.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab"]
    edges = links(fps.select("fp"), max_diff).join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    again = told.groupBy("fp").agg(F.count("*").alias("rows")).filter("rows > 1").join(fps, "fp").select("fp", "first")
    edges = edges.unionAll(told.select("fp", "node").join(checked_broadcast(written(again, "shared-fingerprints")), "fp").select(F.col("node").alias("a"), F.col("first").alias("b")))
    edges = written(edges.filter("a != b"), "fingerprint-links")
    # one row of each text goes on
    twice = written(told.groupBy("digest").agg(F.count("*").alias("rows"), F.min("node").alias("first")).filter("rows > 1").select("digest", "first"), "equal-texts")
    single = told.select("node", "digest", "n", "prefix")
    if not twice.isEmpty():
        single = written(single.join(checked_broadcast(twice), "digest", "left").filter("first is null or first = node").drop("first"), "single-rows")
    groups = components(similar_links(single, body.select("digest", "text"), least, edges, twice.isEmpty()))
    members = groups.unionAll(groups.select(F.col("root").alias("node"), "root").distinct())
    members = written(told.select("node", "id", "digest").join(checked_broadcast(written(members, "near-nodes")), "node"), "near-members")
    first = members.groupBy("root").agg(F.min(F.struct("id", "node", "digest")).alias("first"))
    gone = members.join(first, "root").filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))))
    gone = written(gone.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), "near-gone")
    forget(told, *([single] if hasattr(single, "sievework_path") else []))
    return without(docs, gone, doc_id, text)
