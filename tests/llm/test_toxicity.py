import zlib

import numpy as np
from conftest import SF_SMALL

from civicflow.llm import queries, toxicity
from llm.conftest import words


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(10, 1000, 60)) for _ in range(1500)]
    y = (rng.random(1500) < 0.2).astype(float)
    rows = [np.unique(np.append(r, rng.integers(0, 5, 2))) if t else r for r, t in zip(rows, y, strict=True)]
    model = toxicity.Ftrl(1000, l1=4.0)
    for _ in range(4):
        for i in range(0, 1500, 32):
            model.step(rows[i:i + 32], y[i:i + 32], np.ones(len(y[i:i + 32])))
    w = model.weights()
    assert (w[:5] > 0.5).all() and (w[10:] != 0).mean() < 0.2


def test_features_stay_within_texts():
    one = [set(toxicity.features([t])[1].tolist()) for t in ("You, STUPID thing!", "a b", "", None)]
    text, feature = toxicity.features(["You, STUPID thing!", "a b", "", None])
    assert [set(feature[text == i].tolist()) for i in range(4)] == one
    assert len(one[0]) == 3 + 2 + 1 and len(one[1]) == 3 and not one[2] and not one[3]
    assert set(toxicity.features(["you stupid thing"])[1].tolist()) == one[0]


def _corpus():
    bad = ["idiot", "scum", "moron", "trash"]
    docs, labels = [], []
    for i in range(600):
        w = words(60, i, 800)
        toxic = i % 6 == 0
        if toxic:
            w[10], w[30], w[45] = bad[i % 4], bad[(i + 1) % 4], bad[i % 3]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, make):
    docs, labels = _corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = toxicity.fit_toxicity(make(docs), table)
    assert weights.count() < 500
    out = toxicity.score_toxicity(make(docs).drop("score"), weights)
    rows = out.withColumn("held", toxicity.held_out(out.doc_id)).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    hit = [r.score >= toxicity.THRESHOLD for r in held if r.doc_id % 6 == 0]
    assert np.mean(hit) >= 0.9 and not any(r.score >= toxicity.THRESHOLD for r in held if r.doc_id % 6)


def test_labels_of_held_out_rows_change_nothing(spark, make):
    docs, labels = _corpus()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    fits = [sorted(map(tuple, toxicity.fit_toxicity(make(docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()))
            for x in (labels, flipped)]
    assert fits[0] == fits[1]


def test_repeated_ids_count_once_in_the_fit(spark, make):
    some = [(i, " ".join(words(30, seed=i))) for i in range(120)]
    marks = spark.createDataFrame([(i, i % 3 // 2) for i, _ in some], "doc_id long, toxic int")
    first = next(i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1)
    once, often = (toxicity.fit_toxicity(make(rows), marks) for rows in (some, some + 300 * [some[first]]))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, often.collect()))


def test_query_and_defined_cases(spark, odd, empty):
    rows = queries.op8_ftrl_toxicity(spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    labels = spark.createDataFrame([(5, None, 1), (None, 1, 1), (7, 1, None), (8, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    weights = toxicity.fit_toxicity(odd, labels)
    scored = toxicity.score_toxicity(odd.select("doc_id", "text"), weights).collect()
    assert len(scored) == 11 and len({r.score for r in scored if not (r.text or "").strip()}) == 1
    nothing = toxicity.fit_toxicity(empty, labels.where("false"))
    assert [tuple(r) for r in nothing.collect()] in ([], [(-1, 0.0)])
    assert {r.score for r in toxicity.score_toxicity(odd.select("text"), nothing).collect()} == {0.5}
    assert toxicity.score_toxicity(empty.select("text"), weights).count() == 0


def test_weights_equal_a_plain_ftrl():
    """Per-coordinate rates and L1 one coordinate at a time, in plain Python."""
    import math
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 9))) for _ in range(300)]
    y = np.array([float(3 in r or rng.random() < 0.1) for r in rows])
    weight = np.where(y > 0, 1.7, 1.0)
    model = toxicity.Ftrl(40)
    a, b, l1, l2 = model.alpha, model.beta, model.l1, model.l2
    z, n, bias_z, bias_n = [0.0] * 40, [0.0] * 40, 0.0, 0.0
    for at in range(0, 300, 7):
        part = range(at, min(at + 7, 300))
        model.step([rows[i] for i in part], y[at:at + 7], weight[at:at + 7])
        w = [0.0 if abs(z[j]) <= l1 else -(z[j] - math.copysign(l1, z[j])) / ((b + math.sqrt(n[j])) / a + l2) for j in range(40)]
        bias = -bias_z * a / (b + math.sqrt(bias_n))
        g, g0 = [0.0] * 40, 0.0
        for i in part:
            error = (1 / (1 + math.exp(-(sum(w[j] for j in rows[i]) + bias))) - y[i]) * weight[i]
            g0 += error
            for j in rows[i]:
                g[j] += error
        for j in {int(j) for i in part for j in rows[i]}:
            z[j] += g[j] - (math.sqrt(n[j] + g[j] ** 2) - math.sqrt(n[j])) / a * w[j]
            n[j] += g[j] ** 2
        bias_z += g0 - (math.sqrt(bias_n + g0 ** 2) - math.sqrt(bias_n)) / a * bias
        bias_n += g0 ** 2
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and abs(model.bias_z - bias_z) < 1e-9
    assert 0 < np.count_nonzero(model.weights()) < 40
