"""L1 as a stream: two sinks, each request once, whatever the order of files and batches."""

import json

import pandas as pd
import pytest

from conftest import SF_SMALL
from civicflow import sources
from civicflow.plans import scoring
from civicflow.plans.catalog import scoring as cat
from civicflow.streaming import _first_of, start_scoring

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def dims(spark):
    return cat._dims(spark, SF_SMALL).written()


def run(spark, folder, tmp, dims, **more):
    start_scoring(spark, str(folder), f"{tmp}/out", dims, cat.RuleModel(), f"{tmp}/ckpt", f"{tmp}/bad", AS_OF, **more).awaitTermination()
    read = lambda p: spark.read.parquet(f"{tmp}/{p}").drop("batch")
    return sorted(map(str, read("out").collect())), sorted(map(tuple, read("bad").collect()), key=repr)


def put(folder, name, requests):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in requests))


def ticket(i, **more):
    return {"ticket_id": i, "Agency": "NYPD", "Incident_Zip": "7", "created_date": "2024-01-05T10:00:00", **more}


def test_stream_equals_batch_in_both_sinks(spark, tmp_path, dims):
    requests = [ticket(i, Descriptor="A" if i % 4 else "B") for i in range(40)] + [
        ticket(50, created_date="yesterday"), ticket(51, Incident_Zip=None), ticket(52, Descriptor="none of them"), {"Agency": "DOT"}, {"Incident_Zip": "3"}]
    for i in range(0, len(requests), 9):
        put(tmp_path / "in", f"f{i}.json", requests[i:i + 9])
    good, bad = run(spark, tmp_path / "in", tmp_path, dims, groups=["A", "B", "Straßenzustand"], max_files_per_trigger=2)
    batch = sources.read_requests_json(spark, str(tmp_path / "in"), AS_OF, ["A", "B", "Straßenzustand"])
    assert good == sorted(map(str, scoring.score(batch, dims, cat.RuleModel(), AS_OF).collect()))
    assert sorted((r[0], r[-1]) for r in bad if r[0]) == [(50, "created_date"), (51, "Incident_Zip"), (52, "Descriptor")]
    assert len(bad) == sources.rejected(batch).count() == 4
    # what came is kept as it came
    assert [r[6] for r in bad if r[0] == 50] == ["yesterday"]


def test_replayed_files_change_nothing(spark, tmp_path, dims):
    first = [ticket(i) for i in range(20)] + [ticket(30, created_date="soon"), {"Incident_Zip": "3", "Agency": "DEP"}]
    put(tmp_path / "in", "a.json", first + first[:5])
    before = run(spark, tmp_path / "in", tmp_path, dims)
    put(tmp_path / "in", "b.json", first)
    put(tmp_path / "in", "c.json", [ticket(3, Agency="other text, known ticket"), ticket(30)])
    good, bad = run(spark, tmp_path / "in", tmp_path, dims)
    assert bad == before[1] and len(bad) == 1
    # the ticket that was rejected comes in better shape
    assert len(good) == len(before[0]) + 1 == 22


def test_several_texts_of_one_ticket_in_one_batch(spark, tmp_path, dims):
    a, b = ticket(1, Borough="A"), ticket(1, Borough="B")
    put(tmp_path / "x", "1.json", [a, b])
    put(tmp_path / "y", "1.json", [b])
    put(tmp_path / "y", "2.json", [a])
    (tmp_path / "t1").mkdir()
    (tmp_path / "t2").mkdir()
    one, other = run(spark, tmp_path / "x", tmp_path / "t1", dims), run(spark, tmp_path / "y", tmp_path / "t2", dims)
    assert one == other and len(one[0]) == 1 and "borough='A'" in one[0][0]


class Text(str):
    """Text that counts how often it is compared."""
    compared = 0

    def __lt__(self, other):
        Text.compared += 1
        return str.__lt__(self, other)


class State:
    hasTimedOut, exists, get = False, False, None

    def getCurrentWatermarkMs(self):
        return 0

    def update(self, new):
        self.exists, self.get = True, new

    def setTimeoutTimestamp(self, at):
        pass


def test_rows_of_a_bucket_are_looked_at_once():
    """A bucket that comes in many pieces costs as much as its rows, not as much as the square of its pieces."""
    def piece(numbers, text):
        return pd.DataFrame({"key": [f"{256 * i:032x}" for i in numbers], "request": pd.Series([Text(f"{text} {i}") for i in numbers], dtype=object), "arrived_ms": 5})

    state, first = State(), _first_of(1000)
    pieces = [piece(range(25 * j, 25 * j + 25), "b") for j in range(40)] + [piece([3, 4, 5], "a"), piece([5, 6], "c")]
    found = [r for frame in first((0,), pieces, state) for r in frame["request"]]
    assert Text.compared <= 1005
    assert set(found) == {f"{'a' if i in (3, 4, 5) else 'b'} {i}" for i in range(1000)} and len(found) == 1000
    # what came is known, and only the rest goes through
    again = [r for frame in first((0,), [piece([0, 1, 999, 1000], "d")], state) for r in frame["request"]]
    assert again == ["d 1000"]


def test_requests_are_not_dealt_by_the_values_of_a_dimension(spark, tmp_path, dims):
    """Kept dimensions say their size, so that small ones are broadcast and no borough or agency is one task."""
    put(tmp_path / "in", "a.json", [ticket(i) for i in range(5)])
    scored = scoring.score(sources.read_requests_json(spark, str(tmp_path / "in"), AS_OF), dims, cat.RuleModel(), AS_OF)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
