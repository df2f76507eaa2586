"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good, one on text labelled bad. A whole text is cut into pieces of PIECE
bytes, each compressed with either dictionary; the difference of the summed sizes, divided by the text's bytes, says which kind it is
more like. A short text's difference says little, so PRIOR_BYTES with the difference that good text has on average are added to each. A logistic curve of this one number, fitted on further labelled rows, turns it into a probability of label 1.

The fit takes a bounded sample of labelled rows (SAMPLE of each class). Of a long one the dictionaries get PIECES pieces spread evenly over the whole text, of a shorter one all of it; the curve and
scoring take whole texts, row by row and without a shuffle. Labels of held-out rows, those whose crc32(doc_id as text) mod 5 is 0,
are never used. Labels, ids, lang and source are no inputs of a score.

Defined cases: null and empty texts have the average difference of good text and get the curve's value there; a document with several labels has the smaller; of rows that repeat a labelled doc_id the fit takes that with the smallest
SHA-256 of its text; rows of the sample that tie by hash are taken by doc_id; repeated rows are scored alike; a very long text is scored piece by piece; with no usable labels of one class every score is that of the other
(0 or 1), without any labels 0.5; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Rows of each class for the dictionaries and as many for the curve; pieces of a long text for the dictionaries; their bytes; bytes of a piece; zstandard's level.
SAMPLE, PIECES, DICTIONARY_BYTES, PIECE, LEVEL = 1500, 16, 32 << 10, 512, 1
#: Bytes of average good text that each text is taken with.
PRIOR_BYTES = 150
#: Scores from here on are label 1.
THRESHOLD = 0.3


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def evidence(text: str | None, good: bytes, bad: bytes) -> tuple[int, int]:
    """How many bytes fewer a text takes with the good dictionary, and its bytes."""
    data = (text or "").encode()
    if not data:
        return 0, 0
    g, b, total = _compressor(good), _compressor(bad), 0
    for i in range(0, len(data), PIECE):
        piece = data[i : i + PIECE]
        total += len(b.compress(piece)) - len(g.compress(piece))
    return total, len(data)


def normalised(sizes: np.ndarray, mean: float) -> np.ndarray:
    """The difference of a byte of each text, taken with PRIOR_BYTES whose difference is mean. sizes: rows of evidence()."""
    return (sizes[:, 0] + PRIOR_BYTES * mean) / (sizes[:, 1] + PRIOR_BYTES)


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: float
    slope: float
    offset: float

    def score(self, text: Column) -> Column:
        good, bad, mean, slope, offset = self.good, self.bad, self.mean, self.slope, self.offset

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            x = normalised(np.array([evidence(t, good, bad) for t in texts], float).reshape(-1, 2), mean) if good else np.zeros(len(texts))
            return pd.Series(1 / (1 + np.exp(-np.clip(slope * x + offset, -700, 700))))

        return scored(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def spread_pieces(text: Column) -> Column:
    """A text, or of one longer than PIECES pieces so many of PIECE characters, the first at its begin, the last at its end and the others evenly between."""
    step = (F.length(text) - PIECE) / (PIECES - 1)
    some = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(PIECE))), "")
    return F.when(F.length(text) <= PIECES * PIECE, text).otherwise(some)


def _dictionary(texts: list[str]) -> bytes:
    pieces = [d[i : i + PIECE] for d in (t.encode() for t in texts) for i in range(0, len(d), PIECE)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, pieces)) // 4)), pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples for training: the text itself
        return zstandard.ZstdCompressionDict(b"".join(pieces)[-DICTIONARY_BYTES:] or b"-" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """A weight for each column of x and an offset, by Newton's method, with a little ridge so that separable classes have a solution."""
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.column_stack([x / spread, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / spread, w[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """The model from rows of docs whose label is known and that aren't held out."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    # which documents are there is asked first, so that labels of absent ones don't thin the sample
    present = known.join(docs.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_semi")
    present = written(present.withColumn("at", F.xxhash64("doc_id")), "labelled")
    prior = present.agg(F.avg("y").alias("p"), F.count("*").alias("n")).first()
    if not prior["n"] or prior["p"] in (0.0, 1.0):
        p = 0.5 if not prior["n"] else prior["p"]
        return QualityModel(b"", b"", 0.0, 0.0, 0.0 if p == 0.5 else math.copysign(700.0, p - 0.5))
    chosen = present.filter("y = 0").orderBy("at", "doc_id").limit(2 * sample).unionAll(present.filter("y = 1").orderBy("at", "doc_id").limit(2 * sample))
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "y", "at").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    picked = written(picked, "quality-sample")
    # every other row of a class in the order of its hash: one half for the dictionaries, one for the curve
    rows = picked.select("doc_id", "y", spread_pieces(F.col("text")).alias("text"), "at").filter(F.col("at") % 2 == 0).orderBy("at", "doc_id").toPandas()
    good, bad = (_dictionary(rows.text[rows.y == y].tolist()) for y in (1, 0))

    @F.pandas_udf("array<double>")
    def weighed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, evidence(t, good, bad))) for t in texts])

    curve = picked.filter(F.col("at") % 2 != 0).select("y", weighed("text").alias("x")).toPandas()
    if curve.y.nunique() < 2:
        curve = pd.DataFrame({"y": rows.y, "x": [evidence(t, good, bad) for t in rows.text]})
    sizes = np.array([list(x) for x in curve.x], float)
    total, size = sizes[curve.y.to_numpy() == 1].sum(axis=0)
    mean = float(total / max(size, 1))
    slope, offset = map(float, logistic(normalised(sizes, mean)[:, None], curve.y.to_numpy().astype(float)))
    # the sample takes as many rows of either class: back to the share that the labels have
    share = curve.y.mean()
    offset += math.log(prior["p"] / (1 - prior["p"])) - (math.log(share / (1 - share)) if 0 < share < 1 else 0.0)
    return QualityModel(good, bad, mean, slope, offset)


def score_documents(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), model.score(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs that the model predicts as label 1; all columns."""
    score = fresh(docs, "score")
    return docs.withColumn(score, model.score(F.col(text))).filter(F.col(score) >= THRESHOLD).drop(score)
