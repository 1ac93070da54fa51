"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features: words lower-cased (A-Z), their forms (letters as a, digits as 0, a word like the one before as a mark), and
pairs of neighbours of both kinds, hashed to 2**bits slots; values are square roots of shares, so vectors have unit length. Training goes over a bounded sample of labelled rows (TRAIN_ROWS, those of least hash of id),
streamed once through one task that holds only the two accumulators of a slot. Scoring is a sparse dot
product against the non-zero weights, at most 2**bits of them, broadcast.

Defined results: null and empty texts have no feature and get the score of the bias; rows without a label or id are
scored but never train; repeated rows score alike; without labels every score is 0.5; very long texts are taken whole; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import record_batch

BITS = 20
#: Labelled rows that train at most.
TRAIN_ROWS = 20_000
FTRL = {"alpha": 4.0, "beta": 1.0, "l1": 0.05, "l2": 0.0}
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: A word's form: letters and bytes above ASCII as a, digits as 0, a run of one byte as one.
SHAPE = bytes(ord("0") if 48 <= i < 58 else ord("a") if i >= 128 or 97 <= i < 123 or 65 <= i < 91 else i for i in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)
AGAIN = np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """Slots and values of a text. Its vector has unit length: the square of a value is the n-gram's share of all."""

    def __init__(self, bits: int):
        self.shift, self.seen = np.uint64(64 - bits), {}

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        seen, words = self.seen, text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = (xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(RUNS.sub(rb"\1", w.translate(SHAPE)), 1))
        both = np.array([seen[w] for w in words], np.uint64)
        one, form = both[:, 0], both[:, 1].copy()
        form[1:][one[1:] == one[:-1]] = AGAIN  # a word that repeats the one before
        grams = [one * PAIR, (one[:-1] * PAIR + one[1:]) * PAIR, form * PAIR, (form[:-1] * PAIR + form[1:]) * PAIR]
        slots, counts = np.unique((np.concatenate(grams) >> self.shift).astype(np.int64), return_counts=True)
        return slots, np.sqrt(counts / counts.sum())


class Ftrl:
    """The last slot is the bias."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(v: float) -> float:
    return 1 / (1 + exp(-max(-50.0, min(50.0, v))))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, train_rows: int = TRAIN_ROWS, **ftrl) -> dict[int, float]:
    """docs: _id, _text; labels: _id, _label (0 or 1), ids once. Weights by slot.

    The sample is drawn from the labels alone, so that no text is moved but the sample's; its ids, TRAIN_ROWS at most, are broadcast.
    """
    setting = FTRL | ftrl
    order = [F.xxhash64(F.col("_id").cast("string"), F.lit(7)), F.col("_id")]
    drawn = labels.where("_label is not null and _id is not null").orderBy(*order).limit(train_rows).select("_id", F.col("_label").cast("double").alias("_label"))
    sample = docs.join(F.broadcast(drawn), "_id").repartition(1).sortWithinPartitions(*order, "_text").select("_text", "_label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(bits), Ftrl(bits, **setting)
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                model.learn(*hasher.features(text or ""), label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield record_batch(slot=pa.array(at, pa.int64()), weight=pa.array(w[at], pa.float64()))

    found = sample.mapInArrow(fit, "slot long, weight double").toArrow()
    return dict(zip(found["slot"].to_pylist(), found["weight"].to_pylist(), strict=True))


def scored(rows: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """rows: _id, _text. Gives _id, score."""
    dense = np.zeros((1 << bits) + 1, np.float32)
    for slot, w in weights.items():
        dense[slot] = w
    shared = rows.sparkSession.sparkContext.broadcast(dense)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(bits), shared.value
        bias = float(w[-1])
        for b in batches:
            out = []
            for text in b.column(1):
                slots, values = hasher.features(text.as_py() or "")
                out.append(sigmoid(bias + float(w[slots] @ values)))
            yield record_batch(_id=b.column(0), score=pa.array(out, pa.float64()))

    return rows.select("_id", "_text").mapInArrow(score, f"_id {dict(rows.dtypes)['_id']}, score double")


def held_out(id_: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5, fold: int = 0, bits: int = BITS, **training) -> DataFrame:
    """id, held_out, score and predicted for each row of docs. Labels of the held-out fold are not read by training."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(~held_out(F.col("_id"), folds, fold)).groupBy("_id").agg(F.max("_label").alias("_label"))
    found = scored(rows, train(rows, known, bits, **training), bits)
    return found.select(F.col("_id").alias(id_col), held_out(F.col("_id"), folds, fold).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
