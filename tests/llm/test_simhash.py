import numpy as np
import xxhash
from conftest import SF_SMALL

from civicflow.llm import gray_simhash as gs
from civicflow.llm import queries
from llm.conftest import LONG, words


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not own:
        return 0
    shingles = [" ".join(own[i:i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, limit=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \t", "One", "one two", "a b c", "A B\x0bC d", "É é À", LONG[:5000], "x y z " * 400]:
        assert gs.fingerprint(text) == slow_fingerprint(text)


def test_gray_neighbours_differ_in_one_bit():
    i = np.arange(1000, dtype=np.uint64)
    assert (gs.gray_rank(i ^ i >> np.uint64(1)) == i).all()


def test_index_finds_all_within_the_limit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    x[1000:2000] = x[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    x[2000:] = x[7] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    x = np.unique(x)
    x = x[np.argsort(gs.gray_rank(x))]
    for limit in (0, 2, 5):
        found = set()
        for q, item in gs.GrayIndex(x, np.full(len(x), ~np.uint64(0))).search(x, limit):
            found |= set(zip(q.tolist(), item.tolist(), strict=True))
        want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= limit)}
        assert found == want


def test_links_join_what_brute_force_joins(spark, monkeypatch):
    monkeypatch.setattr(gs, "BLOCK", 50)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = centre[rng.integers(0, 20, 700)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    x = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(x.view(np.int64))], "fp long, id long").repartition(4)
    labels = {r.node: r.component for r in gs.connected_components(gs.links(rows)).collect()}
    assert [labels.get(i, i) for i in range(len(x))] == components(x)


def test_query(spark):
    got = sorted(queries.op7_gray_simhash(spark, SF_SMALL).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    fps = [slow_fingerprint(d.text) for d in docs]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    ids = [d.doc_id for d in docs]
    assert [r.component_id for r in got] == [ids[c] for c in components(np.array(fps, np.uint64))]


def test_defined_cases(make, odd, empty):
    rows = gs.group_documents(odd).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(rows) == 11 and of[None] == {None}
    assert of[1] == of[2] == of[3] == {1} and of[4] == {4} and of[8] == {7}
    kept = gs.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 6, 7)] + [(True, 0)] * 2
    assert gs.group_documents(empty).count() == 0 and gs.keep_one(empty).count() == 0


def test_rows_that_share_an_id_are_one_document(make):
    a, b, c = (" ".join(words(200, s)) for s in (11, 12, 13))
    rows = gs.group_documents(make([(9, a), (9, b), (3, b), (7, c), (8, a)])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(9, 3), (3, 3), (8, 3), (7, 7)}


def test_the_kept_row_of_an_id_does_not_depend_on_order(spark):
    rows = [(i % 5, f"text {j}", i * 10 + j) for i in range(5) for j in range(4)]
    kept = []
    for some in (rows, rows[::-1], sorted(rows, key=lambda r: r[2] % 7)):
        df = spark.createDataFrame(some, "doc_id long, text string, other int").repartition(len(kept) + 2)
        kept.append(sorted(map(tuple, gs.keep_one(df).collect())))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == len({r[0] for r in kept[0]})


def test_ranges_and_parts_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(gs, "FEWEST_RANGES", 3)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), x[:50] ^ np.uint64(5)]))
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(x.view(np.int64))], "fp long, id long").repartition(7)
    plan = gs.links(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and len(plan) < 20_000
    labels = {r.node: r.component for r in gs.connected_components(gs.links(rows)).collect()}
    assert [labels.get(i, i) for i in range(len(x))] == components(x)
