import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from civicflow.llm import quality, queries
from llm.conftest import words


def test_thresholds_stay_ordered_and_grades_separate():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 1200)
    rows = [(np.array([0, 1]), np.array([g + 0.3 * rng.standard_normal(), rng.random()], np.float32)) for g in y]
    model = quality.CumulativeLink(2, 4).fit(rows, y, passes=40)
    assert (np.diff(model.thresholds()) > 0).all()
    s = np.array([model.w @ x for _, x in rows])
    expected = (1 / (1 + np.exp(-(s[:, None] - model.thresholds())))).sum(axis=1)
    assert np.corrcoef(expected, y)[0, 1] > 0.95


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1, 2, 3], 15)
    rows = [(np.arange(3), (rng.random(3) + g / 2).astype(np.float32)) for g in y]
    weight = rng.random(len(y)) + 0.5
    model = quality.CumulativeLink(3, 4)
    model.w[:], model.t[:] = rng.normal(size=3), [-0.5, 0.2, -0.3]

    def loss():
        th = np.concatenate([[-np.inf], model.thresholds(), [np.inf]])
        s = np.array([model.w[a] @ x.astype(float) for a, x in rows])
        return -(weight * np.log(quality.sigmoid(th[y + 1] - s) - quality.sigmoid(th[y] - s))).mean()
    for p, g in zip((model.w, model.t), model.gradient(rows, y, weight), strict=True):
        for i in range(len(p)):
            kept, step = p[i], 1e-6
            p[i] = kept + step
            up = loss()
            p[i] = kept - step
            low = loss()
            p[i] = kept
            assert abs((up - low) / (2 * step) - g[i]) < 1e-6


def test_three_grades_and_refused_ones(spark, make):
    docs = [(i, " ".join(words(40, seed=i) + [["bad"], ["fair"], ["good"]][i % 3] * 10)) for i in range(300)]
    marks = spark.createDataFrame([(i, i % 3) for i, _ in docs], "doc_id long, grade int")
    out = quality.score_quality(make(docs), quality.fit_quality(make(docs), marks)).collect()
    assert all(len(r.tails) == 2 and r.tails[0] >= r.tails[1] and r.tail_probability == r.tails[0] for r in out)
    mean = [np.mean([r.expected_grade for r in out if r.doc_id % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    for wrong in (-1, quality.MOST_GRADES):
        with pytest.raises(ValueError, match="grades go from"):
            quality.fit_quality(make(docs), marks.selectExpr("doc_id", f"{wrong} as grade"))


def test_features_stay_within_texts():
    texts = ["One two. Three!!", "a a a a b", "", None, "x | y | z", "é Ü 12"]
    text, feature, value = quality.features(texts)
    for i, t in enumerate(texts):
        _, f, v = quality.features([t])
        assert np.array_equal(f, feature[text == i]) and np.allclose(v, value[text == i])


def _corpus():
    docs, labels = [], []
    for i in range(500):
        w = words(60, i, 900)
        poor = i % 5 == 0
        if poor:
            w = [f"{x}$$$" for x in w] if i % 2 else [x for x in w[:12] for _ in range(5)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(i % 7 == 0)))
    return docs, labels


def test_held_out_accuracy(spark, make):
    docs, labels = _corpus()
    ratings = quality.rated(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality.score_quality(make(docs), quality.fit_quality(make(docs), ratings))
    rows = [r for r in out.withColumn("kept", quality.keep()).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.kept for r in rows if r.doc_id % 5) and np.mean([r.kept for r in rows if r.doc_id % 5 == 0]) <= 0.1
    assert all(0 <= r.expected_grade <= 1 and 0 <= r.tail_probability <= 1 for r in rows)


def test_repeated_ids_count_once_in_the_fit(spark, make):
    some = [(i, " ".join(words(30, seed=i))) for i in range(120)]
    marks = spark.createDataFrame([(i, i % 3 // 2) for i, _ in some], "doc_id long, grade int")
    first = next(i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1)
    once, often = (quality.fit_quality(make(rows), marks) for rows in (some, some + 300 * [some[first]]))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, often.collect()))


def test_query_and_defined_cases(spark, odd, empty):
    rows = queries.op10_ordinal_quality(spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (7, None, 1), (8, 0, None), (8, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    graded = {(r.doc_id, r.grade) for r in quality.rated(labels).collect()}
    assert graded == {(5, 1), (None, 1), (7, None), (8, 0), (8, 1), (6, 1)}
    model = quality.fit_quality(odd, quality.rated(labels))
    out = quality.score_quality(odd, model).withColumn("kept", quality.keep()).collect()
    assert len(out) == 11 and not any(r.kept for r in out if not (r.text or "").strip(" \t\n"))
    nothing = quality.fit_quality(odd, quality.rated(labels.where("false")))
    kept = quality.score_quality(odd, nothing).withColumn("kept", quality.keep()).collect()
    assert all(r.kept for r in kept if (r.text or "").strip(" \t\n"))
    assert quality.score_quality(empty, model).count() == 0
