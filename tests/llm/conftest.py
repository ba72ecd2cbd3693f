import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers import the package, too
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """``make(rows)``: documents of ``(doc_id, text)`` with columns whose names operators use themselves."""
    def build(rows):
        data = [(i, t, "en", "s", len(t or ""), 1.5, 7, "x", 3) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, "
                                           "times int, `row` string, kept_id int").repartition(3)
    return build


def words(n, seed=0, size=400):
    """n pseudo-random words of a small vocabulary."""
    x, out = seed * 7919 + 12345, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % size}")
    return out


LONG = " ".join(words(30_000, 5, 5000))
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "short text"), (4, "short text"), (None, "a row without an id"), (None, None),
       (5, LONG), (6, "éàü — Größe\x0bß\x1cend"), (7, " ".join(words(300, 1))), (8, " ".join(words(300, 1)))]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make, odd):
    return odd.where("false")
