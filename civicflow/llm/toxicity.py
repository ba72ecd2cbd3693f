"""Toxicity by FTRL-proximal logistic regression.

Features are the presence of hashed word unigrams, bigrams and skip-grams (two
words with one between them) of the lower-cased text; ASCII characters other
than letters and digits separate words.  Training runs FTRL-proximal with a
learning rate per coordinate and L1, which leaves few weights: they are at most
``2 ** bits`` numbers and are sent to the scoring tasks.

Training takes at most about ``max_rows`` labelled ids (a documented bound: a
hash of ``doc_id`` decides) and one row of each, every document is scored on its whole text.

Defined cases: null or empty texts get the score of the bias; null labels or
null ids are not learned from; a label row repeated with different marks counts
as toxic; without training rows (or with one class only) the fit is the bias
alone; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import materialise, one_per_turn, slices, with_fields
from civicflow.llm.hashing import Words, mix

BITS = 20
MAX_ROWS = 24_000
#: FTRL-proximal: rate, its offset, L1, L2; passes over the rows; rows of one step.
ALPHA, BETA, L1, L2, PASSES, STEP = 3.0, 1.0, 10.0, 0.0, 4, 32
THRESHOLD = 0.7
_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of every occurrence in the texts."""
    words = Words([(t or "").lower().encode("utf-8", "replace").translate(_SEPARATE) for t in texts])
    h, text, shift = words.hashes(), words.text, np.uint64(64 - bits)
    parts, owners = [h], [text]
    for gap, salt in ((1, 0x51ED270B), (2, 0xB5297A4D)):
        same = text[:-gap] == text[gap:]
        parts.append(mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] + np.uint64(salt)))
        owners.append(text[:-gap][same])
    return np.concatenate(owners), (np.concatenate(parts) >> shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal state over hashed coordinates; the bias has neither L1 nor L2."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + self.bias_n ** 0.5)

    def step(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """One update from a few weighted rows (distinct features each)."""
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        used, where = np.unique(at, return_inverse=True)
        w = self.weights(used)
        bias = self.bias
        p = sigmoid(np.bincount(row, w[where], len(rows)) + bias)
        error = (p - y) * weight
        g = np.bincount(where, error[row], len(used))
        rate = (np.sqrt(self.n[used] + g * g) - np.sqrt(self.n[used])) / self.alpha
        self.z[used] += g - rate * w
        self.n[used] += g * g
        g0 = float(error.sum())
        self.bias_z += g0 - ((self.bias_n + g0 * g0) ** 0.5 - self.bias_n ** 0.5) / self.alpha * bias
        self.bias_n += g0 * g0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _extract(bits: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, feature = features(batch.column(2).to_pylist(), bits)
            own = np.unique(text << bits | feature)
            ends = np.searchsorted(own, np.arange(batch.num_rows + 1) << bits)
            low = (own & ((1 << bits) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([low[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                names=["turn", "label", "features"])

    return extract


def _fit(bits: int, passes: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            rows += [np.frombuffer(f, "<u4").astype(np.int32) for f in batch.column(2).to_pylist()]
        y, model = np.array(labels, float), Ftrl(1 << bits)
        marked = max(1.0, y.sum())
        weight = np.where(y > 0, max(1.0, (len(y) - marked) / marked) ** 0.5, 1.0)  # marked rows are the fewer
        for _ in range(passes):
            for i in range(0, len(rows), STEP):
                model.step(rows[i:i + STEP], y[i:i + STEP], weight[i:i + STEP])
        w = model.weights()
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(w[used], model.bias))],
                                         names=["feature", "weight"])

    return fit


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS,
                 bits: int = BITS, passes: int = PASSES) -> DataFrame:
    """The non-zero weights (feature -1: the bias), at most ``2 ** bits`` rows."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
                   .where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
                   .groupBy("doc_id").agg(F.max("label").alias("label"))
                   .withColumn("turn", F.xxhash64("doc_id")))
    share = min(1.0, max_rows / max(1, known.count()))
    if share < 1:
        known = known.where(F.col("turn").cast("double") < share * 2.0 ** 64 - 2.0 ** 63)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
                .select("turn", "label", F.col("text").cast("string").alias("text")))
    rows = (one_per_turn(rows, "label")
                .mapInArrow(_extract(bits), "turn long, label int, features binary"))
    # max_rows rows, one of each id: a stated bound
    return materialise(rows.repartition(1).sortWithinPartitions("turn", "features")
                           .mapInArrow(_fit(bits, passes), "feature long, weight double"), "toxicity-weights")


def _score(bits: int, at: np.ndarray, weight: np.ndarray, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.float64)
        table[at] = weight
        hit = table != 0
        for batch in slices(batches):
            text, feature = features(batch.column(batch.schema.get_field_index("text")).to_pylist(), bits)
            keep = hit[feature]
            own = np.unique(text[keep] << bits | feature[keep])
            total = np.bincount(own >> bits, table[own & ((1 << bits) - 1)], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(total + bias))], names=[*batch.schema.names, "score"])

    return score


def score_toxicity(rows: DataFrame, weights: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` (with a column ``text``) and their ``score``."""
    found = weights.toPandas()  # at most 2 ** bits rows
    bias = float(found.weight[found.feature < 0].sum())
    found = found[found.feature >= 0]
    return rows.mapInArrow(_score(bits, found.feature.to_numpy(), found.weight.to_numpy(), bias), with_fields(rows, "score double"))
