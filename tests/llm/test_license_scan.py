import re
from re import _parser

import duckdb
import pytest

from civicflow.llm import license_scan as ls
from civicflow.llm import queries
from civicflow.llm.license_rules import BASE, CONFIDENCE, rules
from llm.conftest import LONG


def examples(tree):
    """Texts that an expression matches: each choice once."""
    texts = [""]
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            some = [chr(value)]
        elif op == "NOT_LITERAL":
            some = ["q"]
        elif op == "SUBPATTERN":
            some = examples(value[3])
        elif op == "BRANCH":
            some = [x for t in value[1] for x in examples(t)]
        elif op == "MAX_REPEAT":
            low, high, inner = value
            some = [x * n for n in {low, max(low, 1), min(high, 3)} for x in examples(inner)]
        elif op == "IN":
            first = value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0] if str(value[0][0]) == "RANGE" else ord("q")
            some = [chr(first)]
        else:
            raise ValueError(op)
        texts = list(dict.fromkeys(a + b for a in texts for b in dict.fromkeys(some)))[:300]
    return texts


def of_rule(rule):
    return examples(_parser.parse(rule.replace(" ?", "(?: )?")))


def lowered(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def slow(doc_id, text):
    """Every rule on every text, every detection against every other."""
    words = lowered(text)
    line = " " + "  ".join(words) + " "
    found = []
    for n, priority, label, _, rule in rules():
        for m in re.finditer(ls.pattern_of(rule), line):
            start = line[:m.start()].count(" ") // 2
            found.append((n, priority, label, start, start + m.group().count(" ") // 2))

    def goes(d):
        n, p, _, s, e = d
        return any((q < p and t < e and s < f) or (q == p and t <= s and f >= e and (f - t > e - s or m < n)) for m, q, _, t, f in found)

    kept = [d for d in found if not goes(d)]
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return (doc_id, len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
            ",".join(sorted({b for _, b in base})), ",".join(sorted({b for _, b in base} | {d[2] for d in kept})), max((CONFIDENCE[d[1]] for d in kept), default=0.0))


def compare(spark, make, rows):
    got = sorted(map(tuple, ls.scan(make(rows)).collect()), key=repr)
    assert got == sorted((slow(*r) for r in rows), key=repr)
    return got


def test_hundreds_of_rules_gated_by_words_they_need():
    assert len(rules()) > 200
    for n, priority, _, keywords, rule in rules():
        assert priority in CONFIDENCE
        for text in of_rule(rule):
            assert re.fullmatch(ls.pattern_of(rule), " " + "  ".join(text.split()) + " "), (n, rule, text)
            assert set(text.split()) & set(keywords), (n, rule, text)


@pytest.mark.parametrize("part", range(4))
def test_examples_of_every_rule(spark, make, part):
    texts = [f"Some Words before, {t.upper() if i % 2 else t}! And after." for r in rules()[part::4] for i, t in enumerate(of_rule(r[4])[:4])]
    compare(spark, make, list(enumerate(texts)))


def test_overlaps(spark, make):
    got = compare(spark, make, [
        (1, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
        (2, "GNU General Public License, version 2 or any later version. GPL-2.0-or-later; gpl; GPL v3"),
        (3, "CC BY-NC CC BY-NC-SA 4.0 cc by cc.by.nc"),
        (4, "Released under the MIT License. under the mit licence, MIT-licensed; under the mit license under the mit license"),
        (5, "All rights reserved. Copyright (c) 2019"), (6, "a smith wrote the committee's submit button")])
    assert [r[6] for r in got[:1]] == ["apache-2"]
    assert got[5][6] == "" and got[5][7] == 0.0


def test_odd_rows(spark, make, odd, empty):
    text = "x " * 3000 + "under the MIT license " * 400 + LONG
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "under the mit license"), (None, None), (4, text), (4, "gpl"), (4, "gpl"), (4, "GPL v2"),
            (5, "underİthe mit license"), (6, "undeK the mit license éunder the mit license"), (7, "ＵＮＤＥＲ the mit license"), (8, "\x00under\x7fthe\x1fmit\x1clicense")]
    compare(spark, make, rows)
    assert ls.scan(empty).count() == 0
    assert ls.scan(odd).count() == odd.count()


def test_one_row_repeated(spark, make):
    compare(spark, make, [(9, "this is under the MIT License, all rights reserved")] * 200 + [(i, "gnu gpl") for i in range(100)])


def test_no_python_in_the_plan(spark, make):
    found = ls.matches(make([(1, "a")]))
    for df in (found, ls.intervals(found)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    made = queries.QUERIES["op11_license_signatures"](spark, sf)
    want = con.sql(f"SELECT {', '.join(made.columns)} FROM ({ls.SQL})").fetchall()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
