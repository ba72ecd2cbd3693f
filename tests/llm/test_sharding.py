import heapq
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from civicflow.llm import queries, sharding


def heap_schedule(sizes, shards):
    loads = [(0.0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, s))
    return sorted(load for load, _ in loads)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_one_heap_step_per_group(seed):
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.integers(1, 40, 3000), rng.integers(1000, 8000, 50), [200_000] * (seed % 2)])
    values, counts = np.unique(sizes, return_counts=True)
    plan = sharding.schedule([(int(v), int(c), int(v * c)) for v, c in zip(values, counts, strict=True)], 24)
    loads = np.zeros(24)
    for size, shard, _, n in plan:
        loads[shard] += size * n
    want = np.array(heap_schedule(sizes.tolist(), 24))
    assert sum(n for *_, n in plan) == len(sizes)
    assert np.abs(np.sort(loads) - want).max() <= 1  # equal loads may be taken in another order


def test_schedule_of_very_many_small_groups_is_quick():
    plan = sharding.schedule([(10, 10**9, 10**10), (10**9, 1, 10**9)], 24)
    loads = np.zeros(24)
    for size, shard, _, n in plan:
        loads[shard] += size * n
    assert loads.min() > 0.38e9


def test_query(spark):
    got = queries.op6_lpt_sharding(spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(got)
    assert (both["size"] == both.text.map(lambda t: len(t.encode()) + 8)).all()
    assert (both.text_crc32 == both.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert both.groupby("text").shard.nunique().max() == 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    groups = both.groupby("text")["size"].sum()
    assert np.abs(np.sort(got.groupby("shard")["size"].sum()) - heap_schedule(groups.tolist(), 24)).max() <= 64
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_defined_cases(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 11
    same = {r.shard for r in rows if r.doc_id in (1, 2)}  # a null text is an empty one
    assert len(same) == 1
    assert all(r.size == 8 and r.text_crc32 == 0 for r in rows if r.doc_id in (1, 2))
    assert sharding.shard_documents(empty).count() == 0
