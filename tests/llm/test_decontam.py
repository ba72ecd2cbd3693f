import itertools
import re

import duckdb
import pytest
from conftest import SF_SMALL

from civicflow.llm import decontam, queries
from llm.conftest import words


def test_masks_lose_no_window():
    """However SUBSTITUTIONS differences lie in a window, some mask fits between them."""
    for bad in itertools.combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(not any(bit == "1" and at + i in bad for i, bit in enumerate(mask))
                   for mask in decontam.MASKS for at in range(decontam.WINDOW - len(mask) + 1))


def brute(docs, items):
    """Counts of windows by comparing all alignments."""
    split = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = {}
    for (doc_id, text), (item_id, item) in itertools.product({tuple(d) for d in docs}, {tuple(i) for i in items}):
        d, b = split(text), split(item)
        if len(b) < decontam.FEWEST:
            continue
        for shift in range(-len(b), len(d) + 1):
            same = [0 <= k + shift < len(d) and d[k + shift] == w for k, w in enumerate(b)]
            if len(b) < decontam.EQUAL:
                counts = [len(b)] * all(same)
            else:
                counts = [c for s in range(-2, len(b) - 12) if (c := sum(same[max(s, 0):s + 15])) >= 13]
            if counts:
                n, best = out.get((doc_id, item_id), (0, 0))
                out[doc_id, item_id] = (n + len(counts), max(best, *counts))
    return out


def _cases():
    item, other, short = words(40, 1), words(20, 2), words(8, 3)

    def change(w, *at):
        return [f"x{i}" if i in at else v for i, v in enumerate(w)]
    fill = words(30, 9, 5000)
    docs = [
        (1, " ".join(fill + item + fill)),
        (2, " ".join(fill + change(item, *range(0, 40, 6)) + fill)),  # every sixth word
        (3, " ".join(fill + change(item, *range(0, 40, 4)))),  # too many differences
        (4, " ".join(item[5:18])),  # a whole document of 13 equal words
        (5, " ".join(fill + item[5:17] + fill)),  # 12 words are too few
        (6, " ".join(w.upper() + "," for w in item[-13:])),
        (7, " ".join(fill + short + fill)), (8, " ".join(fill + change(short, 3) + fill)),
        (9, " ".join(item + item)), (9, " ".join(item + item)), (9, " ".join(item)),
        (None, " ".join(other)), (10, None), (11, ""), (12, "the the the the the the the the the the the the the the the the"),
    ]
    items = [(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(other)), (3, " ".join(short)), (None, " ".join(item[:14])), (4, None), (5, ""),
             (6, "few words only"), (7, "the " * 15)]
    return docs, items


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_brute_force_by_broadcast_and_by_shuffle(spark, make, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
    docs, items = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.windows, r.matched) for r in decontam.overlaps(make(docs), bench).collect()}
    assert got == brute(docs, items)
    assert {1, 2, 4, 6, 7, 9, None, 12} <= {d for d, _ in got} and not {3, 5, 8, 10, 11} & {d for d, _ in got}


def test_sql_agrees_on_the_cases(spark, make):
    docs, items = _cases()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert {(d, i): (w, m) for d, i, w, m in con.sql(decontam.SQL).fetchall()} == brute(docs, items)


def test_no_python_on_the_executors(spark):
    plan = queries.op1_spaced_seed_decontamination(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_removal_and_empty_tables(spark, make, empty):
    docs, items = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = make(docs)
    kept = decontam.remove_overlapping(rows, bench)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id for r in kept.collect())) == [3, 5, 8, 10, 11]
    assert decontam.remove_overlapping(rows, bench.where("false")).count() == len(docs)
    assert decontam.overlaps(empty, bench).count() == 0


def test_rows_of_one_id_are_judged_by_their_text(spark, make):
    docs, items = _cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.remove_overlapping(make([(1, docs[0][1]), (1, "clean"), (None, docs[0][1]), (None, "clean, too")]), bench)
    assert sorted(r.text for r in kept.collect()) == ["clean", "clean, too"]


def test_shortest_items_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    assert decontam.overlaps(docs, items).count() == 0
    assert [tuple(r) for r in decontam.overlaps(docs, items, fewest=1).collect()] == [(1, 9, 1, 2)]
