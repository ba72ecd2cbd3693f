import hashlib
import re
import zlib

import duckdb
import pytest

from civicflow.llm import prefix_trie as pt
from civicflow.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, head string, `key` string"


def entry(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def slow(rows):
    """Nodes of the trie from dictionaries of whole prefixes."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, entry(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    words = {p: len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0 for p in members}
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words[p]
            leaves[p[:d]] += kids[p] == 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def found(spark, rows):
    made = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, pt.conversation_trie(made.repartition(3)).collect()), key=repr)


def talk(conv, texts):
    return [(conv, i, "user" if i % 2 == 0 else "bot", t) for i, t in enumerate(texts)]


def grown():
    """Copies, near copies, beginnings of others, a long chain, short ones that borrow all."""
    rows = []
    for c in range(60):
        rows += talk(c, [f"start {c // 20}", "yes  no", "x\x0by z", *[f"t{j} a" for j in range(c % 7)]])
    for c in range(60, 100):
        rows += talk(c, [*["same turn"] * 12, f"end {c % 3}"])
    for c in range(100, 121):
        rows += talk(c, [f"step {j}" for j in range(c - 99)])
    rows += talk(140, [f"long {j}" for j in range(70)]) + talk(141, [f"long {j}" for j in range(69)]) + talk(147, [f"long {j}" for j in range(90)])
    return rows


@pytest.mark.parametrize(("segment", "rows_kept"), [(256, 256), (4, 3), (7, 1), (1, 2)])
def test_equals_brute_force(spark, monkeypatch, segment, rows_kept):
    monkeypatch.setattr(pt, "SEGMENT", segment)
    monkeypatch.setattr(pt, "BURST_ROWS", rows_kept)
    rows = grown()
    assert found(spark, rows) == slow(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pt, "IDS", 2)
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 2, None, None), (1, 2, None, None), (1, 1, "user", ""),
            (2, 5, "a", "bc"), (2, 6, "ab", "c"), (22, 0, "user", "only base missing"), (3, 0, "user", "é  ö ü " * 2000), (5, 0, "user", "x")]
    rows += [(c, 0, "user", "hello") for c in range(200, 400)]
    assert found(spark, rows) == slow(rows)
    assert found(spark, []) == []
    # nothing is left of one that borrows from a conversation that isn't there
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    only = [(lone, 0, "user", "x"), (lone, 1, "bot", "y")]
    assert found(spark, only) == slow(only) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_one_row_repeated(spark, monkeypatch):
    monkeypatch.setattr(pt, "SEGMENT", 16)
    rows = [(40, 3, "user", "again")] * 150 + talk(41, ["a", "b"])
    assert found(spark, rows) == slow(rows)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    made = queries.QUERIES["op13_burst_prefix_trie"](spark, sf)
    want = con.sql(f"SELECT {', '.join(made.columns)} FROM ({pt.SQL})").fetchall()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
