import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from civicflow.llm import queries, substrings
from llm.conftest import ODD, words


def brute(rows, window=35):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), int(gone.sum()), kept))
    return sorted(out, key=str)


def run(df, **kw):
    got = substrings.remove_repeats(df, **kw).collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str)


def _passages():
    """Shared passages of all lengths and neighbours, loops, branches and whole copies."""
    a, b, c = (words(120, s, 10_000) for s in (21, 22, 23))
    own = lambda s, n=50: words(n, 100 + s, 10_000)
    rows = [own(1) + a + own(2), own(3) + a + own(4), own(5) + a[:34] + own(6), own(7) + a[20:55] + own(8), own(9) + a[20:56],
            a[40:80] + own(10) + b[:60] + own(11), b + own(12), own(13) + b[30:], b[:36] + c[:36] + own(14), own(15) + c[:36] + b[:36],
            a[:60] + b[60:], b[:60] + a[60:], own(16) + c[:36], c + c, ["x"] * 90, ["x", "y"] * 50, ["x", "y", "z"] * 12 + own(17),
            own(18, 34), own(18, 34), own(19, 35), own(19, 35), own(20, 36), own(20, 36)]
    rows += [a[:i] + own(30 + i, 20) + a[i:] for i in (10, 35, 70, 110)]
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_passages_against_brute_force(make):
    rows = _passages()
    assert run(make(rows)) == brute(rows)


@pytest.mark.parametrize(("window", "k"), [(5, 2), (12, 4), (35, 34)])
def test_other_windows(make, window, k):
    rows = [(i, " ".join(words(80, i, 12 if window == 5 else 400))) for i in range(40)] + _passages()
    assert run(make(rows), window=window, k=k) == brute(rows, window)


def test_random_mixtures(make):
    rng = np.random.default_rng(7)
    pool = [words(int(n), 500 + i, 3000) for i, n in enumerate(rng.integers(5, 90, 25))]
    rows = [(i, " ".join(sum((pool[j] for j in rng.integers(0, 25, rng.integers(1, 6))), []))) for i in range(120)]
    assert run(make(rows)) == brute(rows)


def test_query(spark):
    got = sorted(tuple(r) for r in queries.op5_debruijn_substrings(spark, SF_SMALL).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows))


def test_defined_cases(odd, empty):
    assert run(odd) == brute(ODD)
    assert substrings.remove_repeats(empty).count() == 0


def test_paths_shorten_a_copied_text(make, monkeypatch):
    """Copies of one long text are compared as whole paths, not window by window."""
    text = " ".join(words(2000, 77, 100_000))
    seen = {}
    keep = substrings.materialise

    def watch(df, what):
        seen[what] = keep(df, what)
        return seen[what]
    monkeypatch.setattr(substrings, "materialise", watch)
    run(make([(i, text) for i in range(8)]))
    assert seen["digests"].where(F.col("n") > 1900).count() == 8
    assert seen["digests"].count() < 8 * 80


def test_sampled_and_full_graph_lead_to_the_same_windows():
    """Windows made of repeated k-mers (the full graph) or with a repeated anchor (the sampled one): what verifies is the same."""
    import hashlib
    import random
    from collections import Counter
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(30)}"
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(80)] + passage[i:50 + i] + [word() for _ in range(20)] for i in range(4)] + [["a", "b"] * 60, [word() for _ in range(100)]]
    hashed = lambda gram: hashlib.md5(" ".join(gram).encode()).digest()
    grams = Counter(tuple(t[i:i + substrings.K]) for t in texts for i in range(len(t) - substrings.K + 1))
    windows = [(n, i, tuple(t[i:i + substrings.WINDOW])) for n, t in enumerate(texts) for i in range(len(t) - substrings.WINDOW + 1)]
    inside = lambda w: [w[j:j + substrings.K] for j in range(substrings.WINDOW - substrings.K + 1)]
    anchor = {(n, i): min((hashed(g), j) for j, g in enumerate(inside(w))) for n, i, w in windows}
    places = Counter((h, n, i + j) for (n, i), (h, j) in anchor.items())
    anchors = Counter(h for h, _, _ in places)
    full = [x for x in windows if all(grams[g] > 1 for g in inside(x[2]))]
    sampled = [x for x in windows if anchors[anchor[x[0], x[1]][0]] > 1]
    times = Counter(w for *_, w in windows)
    verified = lambda found: {x[:2] for x in found if Counter(w for *_, w in found)[x[2]] > 1}
    repeated = {x[:2] for x in windows if times[x[2]] > 1}
    assert repeated and verified(full) == verified(sampled) == repeated
