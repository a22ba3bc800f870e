"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import column, hash60, importable, map_arrow, record, slices
from .packing import Cached, only

#: Weights (a fixed size, so they can be broadcast), labelled documents to fit on, passes over them.
BITS, MAX_LABELLED, PASSES = 18, 6000, 3
#: FTRL-proximal: step size, its smoothing, L1 and L2; features are counts divided by length, times SCALE.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 0.1, 16.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
_hashes = Cached(lambda token: zlib.crc32(token.encode()), 200_000)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed ids of all words and pairs of neighbours, as often as they occur (a run of signs is a word)."""
    words = TOKEN.findall(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    one = h * np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15) if len(h) else h
    return (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int32)


def train(examples: list[tuple[np.ndarray, int]], bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal updates, example by example."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = []
    for ids, label in examples:
        at, count = np.unique(ids, return_counts=True)
        rows.append((np.append(at, size - 1), np.append(count * (SCALE / max(1, len(ids))), 1.0), label))
    for _ in range(passes):
        for at, x, label in rows:
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return _weights(z, n).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _extract(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    only(_hashes)
    kind = pa.schema([("h", pa.int64()), ("label", pa.int32()), ("ids", pa.binary())])
    for batch in slices(batches):
        yield record(kind, batch.column("h"), batch.column("label"), [features(t or "", bits).tobytes() for t in column(batch, "text")])


def _fit(batches: Iterator[pa.RecordBatch], bits: int, passes: int) -> Iterator[pa.RecordBatch]:
    rows = sorted((h, label, ids) for b in batches for h, label, ids in zip(*(column(b, c) for c in ("h", "label", "ids")), strict=True))
    weights = train([(np.frombuffer(ids, np.int32), label) for _, label, ids in rows], bits, passes)
    yield record(pa.schema([("weights", pa.binary())]), [weights.tobytes()])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """Fit on about max_labelled of the labelled documents for which usable (over id_col) holds.

    The bound is by hash: with more usable labels than that, the fraction max_labelled / n with the
    smallest hashes is taken. Labels other than 0 and 1 and null ids don't count; repeated labels count once,
    so an id has two at most, and a document with both is learnt once for each. Only these labels, a bounded number, are broadcast, and one task fits.
    """
    own = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("label"))
    own = own.filter(F.col("l_id").isNotNull() & F.col("label").isin(0, 1)).withColumn(id_col, F.col("l_id")).filter(usable).drop(id_col).distinct()
    total = own.count()
    own = own.withColumn("h", hash60(F.lit("fit"), F.col("l_id"))).filter(F.col("h") <= F.lit(int((1 << 60) * min(1.0, max_labelled / max(1, total)))))
    texts = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(own), F.col("d_id") == F.col("l_id")).select("h", "label", "text")
    ids = map_arrow(chosen, lambda b: _extract(b, bits), "h long, label int, ids binary")
    got = map_arrow(ids.repartition(1), lambda b: _fit(b, bits, passes), "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score_text(weights: np.ndarray, ids: np.ndarray) -> float:
    logit = float(weights[-1]) + (SCALE / len(ids) * float(weights[ids].sum(dtype=np.float64)) if len(ids) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text, as a sparse dot product; no shuffle.

    A null text counts as empty, whose score is that of the bias alone; an existing column of the name
    out is replaced; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    importable(spark)
    model = spark.sparkContext.broadcast(weights)
    kept = docs.drop(out)
    bits = (len(weights) - 1).bit_length() - 1

    def run(batches):
        w = model.value
        only(_hashes)
        for batch in slices(batches, text_col):
            scores = [score_text(w, features(t or "", bits)) for t in column(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, out])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out, DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the id as text, modulo folds, is fold (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
