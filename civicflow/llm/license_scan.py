"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its lower-cased words, each between spaces of its own.  The
rules of :mod:`civicflow.llm.license_rules` are regular expressions over words;
one is tried on a text only if the text has one of the rule's keywords, so that
most texts meet no expression at all.  Splitting a text at a rule's matches
gives the words before each of them, whose running sum is where it starts.

Detections that overlap are resolved by the order of the rules.  One goes where
it shares a word with a detection of a better priority, or where the interval of
another one of its own priority contains it (of equal intervals the earlier rule
stays).  Running extremes over the sorted intervals of a text find both, without
pairs.  The fixed phrases count wherever they stand, and keep their labels.

Defined cases: a null or empty text has no word and no label, and score 0; null
ids are ids like any other; rows of one id and one text have the same result
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import materialise
from civicflow.llm.license_rules import BASE, CONFIDENCE, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE = "array<struct<number:int,keywords:array<string>,pattern:string>>"


def pattern_of(rule: str) -> str:
    """A rule's expression over words that each stand between spaces of their own."""
    return f" (?:{rule.replace(' ?', '(?: )?').replace(' ', '  ')}) "


def _n_words(part: Column) -> Column:
    """Words of a part that begins and ends between words."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, _text`` (a hash), ``n_words`` and ``found``: of each matching rule the words before and of each match."""
    known = rules()
    table = F.from_json(F.lit(json.dumps([{"number": r[0], "keywords": r[3], "pattern": pattern_of(r[4])} for r in known])), _RULE)
    keywords = F.from_json(F.lit(json.dumps(sorted({k for r in known for k in r[3]}))), "array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "").alias("words"))
    rows = rows.select("doc_id", "_text", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", keywords).alias("hits"),
                       F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("line"))
    tried = F.filter(table, lambda r: F.arrays_overlap(r.keywords, F.col("hits")))
    found = F.transform(tried, lambda r: F.struct(
        r.number.alias("number"),
        F.transform(F.split(F.col("line"), r.pattern, -1), _n_words).alias("before"),
        F.transform(F.regexp_extract_all(F.col("line"), r.pattern, F.lit(0)), _n_words).alias("length")))
    return rows.select("doc_id", "_text", "n_words", F.when(F.size("hits") > 0, F.filter(found, lambda m: F.size(m.length) > 0)).alias("found"))


def intervals(found: DataFrame) -> DataFrame:
    """``doc_id, _text, number, priority, label, start, end`` (words, end exclusive) and ``kept``."""
    known = rules()
    spans = F.arrays_zip(F.slice("m.before", 1, F.size("m.length")).alias("before"), F.col("m.length").alias("length"))
    rows = (found.where(F.size("found") > 0).select("doc_id", "_text", F.explode("found").alias("m"))
                 .select("doc_id", "_text", F.col("m.number").alias("number"), F.posexplode(spans).alias("k", "s"))
                 .select("doc_id", "_text", "number", "k", F.col("s.before").cast("long").alias("before"), F.col("s.length").cast("long").alias("length")).distinct())
    text = ["doc_id", "_text"]
    upto = Window.partitionBy(*text, "number").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("length")).over(upto)).withColumn("start", F.col("end") - F.col("length"))
    names = F.from_json(F.lit(json.dumps([{"priority": r[1], "label": r[2]} for r in known])), "array<struct<priority:int,label:string>>")
    rows = rows.withColumn("rule", F.get(names, "number")).select(*text, "number", "rule.priority", "rule.label", "start", "end")
    # of one priority: who comes before and ends no earlier contains this one
    same = Window.partitionBy(*text, "priority").orderBy("start", F.col("end").desc(), "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.max("end").over(same) >= F.col("end"), F.lit(False)))
    left = Window.partitionBy(*text).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(*text).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    better = F.lit(False)
    levels = sorted(CONFIDENCE)[:-1]
    rows = rows.select("*", *[F.max(F.when(F.col("priority") == p, F.col("end"))).over(left).alias(f"_end{p}") for p in levels])
    rows = rows.select("*", *[F.min(F.when(F.col("priority") == p, F.col("start"))).over(right).alias(f"_start{p}") for p in levels])
    for p in levels:
        shares = (F.col(f"_end{p}") > F.col("start")) | (F.col(f"_start{p}") < F.col("end"))
        better = better | ((F.col("priority") > p) & F.coalesce(shares, F.lit(False)))
    return rows.select(*text, "number", "priority", "label", "start", "end", (~F.col("inside") & ~better).alias("kept"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    found = materialise(matches(docs), "license-matches")
    base = F.col("number") < len(BASE)
    labels = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")  # noqa: E731  as many as rules at most
    sure = F.get(F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)]), F.col("priority") - 1)
    sums = intervals(found).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), labels(base).alias("base_labels"), labels(base | F.col("kept")).alias("labels"),
        F.max(F.when(F.col("kept"), sure)).alias("score"))
    rows = found.select("doc_id", "_text", "n_words").join(sums, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                       F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql() -> str:
    """The same rules tried on every text that has a keyword, and detections compared pair by pair."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ",\n       ".join(f"({n}, {p}, {quote(label)}, [{', '.join(map(quote, kw))}], {quote(pattern_of(rule))})" for n, p, label, kw, rule in rules())
    sure = " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items())
    return f"""
WITH rule(number, priority, label, keywords, pattern) AS (VALUES {known}),
     doc AS (SELECT row_number() OVER () AS r, doc_id,
                    [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NO_WORD}') IF x <> ''] AS w FROM documents),
     line AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS line, list_distinct(w) AS w FROM doc),
     hit AS (SELECT r, number, priority, label, string_split_regex(line, pattern) AS p, regexp_extract_all(line, pattern) AS m
             FROM line JOIN rule ON list_has_any(w, keywords)),
     part AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hit),
     long AS (SELECT r, number, priority, label, k, (length(p[k]) - length(replace(p[k], ' ', ''))) // 2 AS b, (length(m[k]) - length(replace(m[k], ' ', ''))) // 2 AS n FROM part),
     d AS (SELECT r, number, priority, label, CAST(sum(b + n) OVER (PARTITION BY r, number ORDER BY k) AS BIGINT) AS e, n FROM long),
     det AS (SELECT r, number, priority, label, e - n AS s, e FROM d),
     res AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM det b WHERE b.r = a.r AND (
               (b.priority < a.priority AND b.s < a.e AND a.s < b.e)
               OR (b.priority = a.priority AND b.s <= a.s AND b.e >= a.e AND (b.e - b.s > a.e - a.s OR b.number < a.number)))) AS kept FROM det a),
     agg AS (SELECT r, count(*) FILTER (number < {len(BASE)}) AS n_base, min(s) FILTER (number < {len(BASE)}) AS first_word, max(s) FILTER (number < {len(BASE)}) AS last_word,
                    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (number < {len(BASE)}) AS base_labels,
                    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept OR number < {len(BASE)}) AS labels,
                    max(CASE priority {sure} END) FILTER (kept) AS score FROM res GROUP BY r)
SELECT doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM doc LEFT JOIN agg USING (r)
"""


SQL = _sql()
