"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all
grades and increasing thresholds, so a document has one latent quality, an
expected grade and a tail probability P(grade >= g) to select by.

Features are hashed and scaled by the number of words: lower-cased words, runs
of character classes (4-grams over letters, capitals, digits, single marks) and
repetition (a word equal to the one before, pairs of words that came before).

The fit takes at most about ``max_rows`` rated ids (a documented bound: a hash
of ``doc_id`` decides) and one row of each; every document is scored on its whole text.

Defined cases: null or empty texts have no features and get the grade that the
thresholds alone give, and are rejected by ``select`` (nothing to train on);
null ratings or ids are not learned from; a grade below 0 or above ``MOST_GRADES``
- 1 is refused with an error; a row rated more than once takes its lowest grade;
without rated rows every text is kept with the highest grade;
repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import field, materialise, one_per_turn, slices, with_fields
from civicflow.llm.hashing import Words, mix
from civicflow.llm.toxicity import held_out, sigmoid

WORD_BITS, SHAPE_BITS = 16, 13
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 2
MAX_ROWS, MOST_GRADES = 8_000, 32
PASSES, STEP, RATE, DECAY = 12, 64, 0.02, 1e-5
#: Bytes of text whose features are found at one time; about 100 bytes of arrays each.
AT_ONCE = 512 << 10
#: Documents are kept if P(grade >= 1) is at least this.
KEEP_FROM = 0.5


def _classes() -> np.ndarray:
    """Byte classes: lower-case letters (and all of a character beyond ASCII), capitals, digits, white space; marks as they are."""
    out = np.arange(256, dtype=np.uint8)
    out[97:123] = out[128:] = ord("a")
    out[65:91], out[48:58], out[[9, 10, 11, 12, 13]] = ord("A"), ord("0"), 32
    return out


_CLASS = _classes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, feature, value)``, summed per text and feature."""
    plain = [(t or "").encode("utf-8", "replace") for t in texts]
    words = Words([(t or "").lower().encode("utf-8", "replace") for t in texts])
    n = np.maximum(words.count, 1).astype(float)
    h, text = words.hashes(), words.text
    owner, feature = [text], [(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)]

    kind = _CLASS[np.frombuffer(b"".join(t + b"\n" for t in plain), np.uint8)]
    past = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
    new = np.append(True, kind[1:] != kind[:-1])
    new[past[:-1]] = True
    run = np.flatnonzero(new)
    kind = kind[run].astype(np.int64)
    if len(kind) > 3:
        of = np.searchsorted(past, run, "right")
        gram = kind[:-3] | kind[1:-2] << 8 | kind[2:-1] << 16 | kind[3:] << 24
        gram = mix(gram.astype(np.uint64) + np.uint64(0x1F123BB5)) >> np.uint64(64 - SHAPE_BITS)
        same = of[:-3] == of[3:]
        owner.append(of[:-3][same])
        feature.append(gram.astype(np.int64)[same] + (1 << WORD_BITS))
    pair = text[:-1] == text[1:]
    again = np.flatnonzero(pair & (h[:-1] == h[1:]))
    owner.append(text[again])
    feature.append(np.full(len(again), SIZE - 2))
    both = mix(h[:-1][pair] * np.uint64(3) + h[1:][pair])
    order = np.lexsort((both, text[:-1][pair]))
    b, t = both[order], text[:-1][pair][order]
    old = (b[1:] == b[:-1]) & (t[1:] == t[:-1])
    owner.append(t[1:][old])
    feature.append(np.full(int(old.sum()), SIZE - 1))
    key, count = np.unique(np.concatenate(owner) * SIZE + np.concatenate(feature), return_counts=True)
    return key // SIZE, key % SIZE, count / n[key // SIZE]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, at_once=AT_ONCE):
        text, feature, value = features(batch.column(2).to_pylist())
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
        own = [(feature[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in own], pa.binary()),
                                          pa.array([o[1] for o in own], pa.binary())], names=["turn", "grade", "features", "of"])


class CumulativeLink:
    """Shared weights and ordered thresholds, fitted by Adam on the likelihood."""

    def __init__(self, size: int, grades: int):
        self.w = np.zeros(size)
        # the first threshold and the logarithms of the gaps to the next ones
        self.t = np.zeros(grades - 1)
        self.grades = grades

    def thresholds(self) -> np.ndarray:
        return np.concatenate([self.t[:1], self.t[:1] + np.cumsum(np.exp(self.t[1:]))]) if self.grades > 1 else np.zeros(0)

    def gradient(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean weighted negative log likelihood, for the weights and for ``t``."""
        at = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows]).astype(float)
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        s = np.bincount(row, self.w[at] * x, len(rows))
        th = np.concatenate([[-np.inf], self.thresholds(), [np.inf]])
        up, low = sigmoid(th[y + 1] - s), sigmoid(th[y] - s)
        share = weight / np.maximum(up - low, 1e-9) / len(rows)
        du, dl = share * up * (1 - up), share * low * (1 - low)
        gth = np.bincount(y, -du, self.grades)[:-1] + np.bincount(y, dl, self.grades)[1:]
        gt = np.cumsum(gth[::-1])[::-1].copy()
        gt[1:] *= np.exp(self.t[1:])
        return np.bincount(at, (du - dl)[row] * x, len(self.w)), gt

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int = PASSES) -> "CumulativeLink":
        m = [np.zeros_like(self.w), np.zeros_like(self.t)]
        v = [np.zeros_like(self.w), np.zeros_like(self.t)]
        turn = 0
        # rare grades weigh as much as frequent ones
        weight = len(y) / (np.maximum(np.bincount(y, minlength=self.grades), 1) * len(set(y.tolist())))
        for epoch in range(passes):
            for i in range(0, len(rows), STEP):
                part, grade = rows[i:i + STEP], y[i:i + STEP]
                gw, gt = self.gradient(part, grade, weight[grade])
                gw += DECAY * self.w
                turn += 1
                rate = RATE * (1 if epoch < passes - 3 else 0.2)
                for k, (p, g, step) in enumerate(((self.w, gw, 5 * rate), (self.t, gt, rate))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    p -= step * (m[k] / (1 - 0.9 ** turn)) / (np.sqrt(v[k] / (1 - 0.99 ** turn)) + 1e-8)
        return self


def _fit(grades: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            rows += [(np.frombuffer(f, "<i4"), np.frombuffer(o, "<f4"))
                     for f, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        model = CumulativeLink(SIZE, grades)
        if rows:
            model.fit(rows, np.array(y, np.int64))
        used = np.flatnonzero(model.w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1 - np.arange(grades - 1)), pa.int64()),
             pa.array(np.append(model.w[used], model.thresholds() if rows else np.arange(grades - 1) - 1e3))], names=["feature", "weight"])

    return fit


def rated(labels: DataFrame) -> DataFrame:
    """Ratings from the label table: its quality, as it is (0 the poorest)."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Non-zero weights; features -1, -2, ... are the thresholds, one less than there are grades (0 to the greatest given).  At most ``SIZE + MOST_GRADES`` rows."""
    known = (ratings.where("doc_id is not null and grade is not null").where(~held_out(F.col("doc_id")))
                    .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
                    .withColumn("turn", F.xxhash64("doc_id")))
    n, low, high = known.agg(F.count(F.lit(1)), F.min("grade"), F.max("grade")).first()
    if n and (low < 0 or high >= MOST_GRADES):
        raise ValueError(f"grades go from 0 to {MOST_GRADES - 1}; these go from {low} to {high}")
    grades = max(2, (high or 0) + 1)
    share = min(1.0, max_rows / max(1, n))
    if share < 1:
        known = known.where(F.col("turn").cast("double") < share * 2.0 ** 64 - 2.0 ** 63)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
                .select("turn", "grade", F.col("text").cast("string").alias("text")))
    rows = (one_per_turn(rows, "grade")
                .mapInArrow(_rows, "turn long, grade int, features binary, of binary"))
    # max_rows rows, one of each id: a stated bound
    return materialise(rows.repartition(1).sortWithinPartitions("turn", "features")
                           .mapInArrow(_fit(grades), "feature long, weight double"), "quality-weights")


def _score(w: np.ndarray, thresholds: np.ndarray, column: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, AT_ONCE):
            text, feature, value = features(field(batch, column).to_pylist())
            s = np.bincount(text, w[feature] * value, batch.num_rows)
            above = sigmoid(s[:, None] - thresholds[None, :])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above.tolist(), pa.list_(pa.float64()))],
                                             names=[*batch.schema.names, "expected_grade", "tail_probability", "tails"])

    return score


def score_quality(rows: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (with a string column ``text``, or a field ``row.text`` of a struct) and ``expected_grade``, ``tail_probability`` (of grade 1 or better) and ``tails`` (of each grade above 0 or better)."""
    found = model.toPandas()  # at most SIZE weights and the thresholds
    w = np.zeros(SIZE, np.float64)
    own = found[found.feature >= 0]
    w[own.feature.to_numpy()] = own.weight.to_numpy()
    thresholds = found[found.feature < 0].sort_values("feature", ascending=False).weight.to_numpy()
    if not len(thresholds):  # fitted on nothing
        thresholds = np.array([-1e3])
    return rows.mapInArrow(_score(w, thresholds, text), with_fields(rows, "expected_grade double, tail_probability double, tails array<double>"))


def keep(tail: str = "tail_probability", text: str = "text", keep_from: float = KEEP_FROM):
    """Whether a scored row is selected; texts without a word are not."""
    return (F.col(tail) >= keep_from) & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
