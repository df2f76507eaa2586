"""Byte-level BPE encoding and decoding by a table over byte prefixes.

For any bytes, the encoding of each prefix ends in exactly one token. A token t that ends at byte i is that token if (1) t alone encodes
to itself, and (2) it may follow the last token u of the prefix before it: the merges applied to the bytes of u and t give u, t again, which is so
if no token that ends u at some time of the merging joins one that begins t at that time.
So one pass over the bytes fills ``last[i]``, the unique valid last token of each prefix, and the encoding is read off from the end.
Appending bytes only continues the table; an edit keeps the table before it.

A piece is a match of the split pattern. As the library does, a piece that is itself in the vocabulary is that token. Pieces repeat and
begin alike, so each worker keeps the last tokens of the short prefixes it met, and the encodings of whole pieces, in bounded dictionaries.

Defined cases: a null text is empty and has no tokens; a null doc_id stays null; repeated rows are encoded alike, each for itself; there are no ties, as each prefix has one valid last token; a very long text, or a
very long piece of it, is encoded in time in proportion to its bytes, alone in its slice; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, lean, slices

#: Entries in a worker's dictionaries of pieces, prefixes and pairs; bytes of a prefix that is kept.
MEMORY, SHORT = 150_000, 40
NEVER = 1 << 60


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Table:
    """last[i]: the token that the encoding of the first i bytes ends in; 0 bytes have none (-1)."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is in the table stays as it is."""
        start, self.data = len(self.data), self.data + more
        self.codec.fill(self.data, self.last, start)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Bytes start to stop become new. The table before start is kept; the rest is filled again."""
        data = self.data[:start] + new + self.data[stop:]
        del self.last[start + 1 :]
        self.data = data
        self.codec.fill(data, self.last, start)

    def ids(self) -> list[int]:
        out, at, sizes = [], len(self.data), self.codec.sizes
        while at:
            out.append(self.last[at])
            at -= sizes[out[-1]]
        return out[::-1]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.packed_token = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        #: Tokens by their bytes from the last to the first; -1 leads to the token that begins there.
        self.ends: dict = {}
        for token, rank in ranks.items():
            node = self.ends
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = rank
        self.alone: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")

    def merged(self, data: bytes, least_parts: int = 1) -> list[int]:
        """The merges by rank, one after the other, down to least_parts: for tokens, which are short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, NEVER
        while len(parts) > least_parts:
            ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of token while it is merged, from the byte up, each with the rank of the merge that takes it up."""
        if (found := self.edges.get((token, right))) is None:
            data = self.tokens[token]
            if len(data) == 1:
                found = [(data, NEVER)]
            else:
                halves = self.merged(data, 2)
                if max(halves) >= token:
                    raise ValueError("a token has a part of higher rank")
                inner = self.edge(halves[1 if right else 0], right)
                found = [*inner[:-1], (inner[-1][0], token), (data, NEVER)]
            self.edges[token, right] = found
        return found

    def apart(self, before: int, token: int) -> bool:
        """Whether no merge joins the end of before with the beginning of token. Of equal ranks the left one comes first."""
        a, b, i, j = self.edge(before, True), self.edge(token, False), 0, 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            if (rank := self.ranks.get(x + y)) is not None and rank < x_until and rank <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def fits(self, before: int, token: int) -> bool:
        """Whether token may be the last one after before, -1 for none."""
        if before < 0:
            if (ok := self.alone.get(token)) is None:
                ok = self.alone[token] = self.merged(self.tokens[token]) == [token]
            return ok
        if (ok := self.pairs.get(before << 32 | token)) is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            ok = self.pairs[before << 32 | token] = self.fits(-1, token) and self.apart(before, token)
        return ok

    def fill(self, data: bytes, last: list[int], start: int) -> None:
        pair, fits, prefixes, ends = self.pairs.get, self.fits, self.prefixes, self.ends
        for end in range(start + 1, len(data) + 1):
            if end <= SHORT and (token := prefixes.get(data[:end])) is not None:
                last.append(token)
                continue
            found, node, at = [], ends, end
            while at and (node := node.get(data[at - 1])) is not None:
                at -= 1
                if (token := node.get(-1)) is not None:
                    found.append((last[at], token))
            for before, token in reversed(found):  # the longest first: mostly it is the one
                if (ok := pair(before << 32 | token)) is None:
                    ok = fits(before, token)
                if ok:
                    break
            else:
                raise ValueError("no valid last token")
            last.append(token)
            if end <= SHORT:
                if len(prefixes) >= MEMORY:
                    prefixes.clear()
                prefixes[data[:end]] = token

    def piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return Table(self, piece).ids()

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self.pieces, []
        for p in self.split.findall(text):
            if (ids := known.get(p)) is None:
                if (ids := self.older.get(p)) is None:
                    ids = b"".join(map(self.packed_token.__getitem__, self.piece(p.encode())))
                if len(p) <= 64:
                    if len(known) >= MEMORY:  # what is in use comes back from the older half
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Document:
    """A text's encoding that can be appended to and edited. Pieces before the change are kept as they are; from the last piece boundary
    that the change can't move, the text is split anew, and pieces that come out as before keep their tables."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, text
        self.parts = [(m.start(), Table(codec, m.group().encode())) for m in codec.split.finditer(text)]

    def _from(self, text: str, changed: int) -> None:
        # a match ends by what follows it at most one character on, and white space may give one up: two pieces back is before any of that
        keep = 0
        while keep < len(self.parts) and self.parts[keep][0] < changed:
            keep += 1
        keep = max(0, keep - 3)
        begin = self.parts[keep][0] if keep < len(self.parts) else 0
        old = self.parts[keep:]
        self.text, self.parts = text, self.parts[:keep]
        known = {t.data: t for _, t in old}
        for m in self.codec.split.finditer(text, begin):
            data = m.group().encode()
            if (table := known.get(data)) is None and old and m.start() == old[0][0] and data.startswith(old[0][1].data):
                table = Table(self.codec)
                table.data, table.last = old[0][1].data, list(old[0][1].last)
                table.append(data[len(table.data) :])
            self.parts.append((m.start(), table or Table(self.codec, data)))
            old = old[1:]

    def append(self, more: str) -> None:
        self._from(self.text + more, len(self.text))

    def replace(self, start: int, stop: int, new: str) -> None:
        self._from(self.text[:start] + new + self.text[stop:], start)

    def ids(self) -> list[int]:
        out, whole = [], self.codec.ranks
        for _, table in self.parts:
            out += [whole[table.data]] if table.data in whole else table.ids()
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process and vocabulary."""
    return Codec(ranks_of(path), pattern)


CACHES.append(codec.cache_clear)

CODED = "doc_id {kind}, ids binary, decoded binary"


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers) and decoded (the bytes that those ids stand for)."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = [c.packed(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([c.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), CODED.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def decode(rows: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and decoded, the bytes that packed ids stand for; null ids stay null."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else c.decode(i) for i in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")
