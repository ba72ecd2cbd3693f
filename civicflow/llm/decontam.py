"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text.  A document
overlaps a benchmark item where a window of ``WINDOW`` aligned words holds at
most ``SUBSTITUTIONS`` differences; words beyond either text's end count as
differences.  A seed mask looks at some words of its span and ignores the
others.  Every way to place that many differences in a window leaves one of the
two masks a place where all words it looks at are equal, so that joining the
masks' hashes of both sides misses no overlap; the words around each hit are
then compared one by one.

An item of fewer words than a window must hold equal ones counts only as a
whole and without differences; items of fewer than ``fewest`` words (a parameter;
1 takes all) are no evidence and never match.

Defined cases: null or empty texts (documents or items) match nothing; null ids
are ids like any other; rows of one id and text count once, those of one id and
different texts are added up; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import materialise, packed

WINDOW, SUBSTITUTIONS, FEWEST = 15, 2, 6
EQUAL = WINDOW - SUBSTITUTIONS
#: Spans of words with the ones that are looked at; found by exhaustive search, checked in the tests.
MASKS = ("1110100111", "11110111")
#: Benchmark seeds (of a few dozen bytes) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def word_array(text: str) -> Column:
    """Hashes of the words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = F.split(plain, " ", -1)
    return F.when(plain != "", F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _seeds(words: Column, at: Column, masks: dict[int, str]) -> Column:
    """One hash per mask of the words from a position on; null where the mask passes the end."""
    return F.array(*[
        F.when(at + len(mask) <= F.size(words),
               F.xxhash64(F.lit(number), *[F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]))
        for number, mask in masks.items()])


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, fewest: int = FEWEST) -> DataFrame:
    """``keys, item_id, windows, matched``: number of overlapping windows and the equal words of the best one."""
    keys = keys or ["doc_id"]
    items = benchmark.select("item_id", word_array("text").alias("item")).where(F.size("item") >= max(1, fewest)).distinct()
    items = materialise(items.withColumn("n", F.size("item")).withColumn("ik", F.monotonically_increasing_id()), "items")
    # at most EQUAL - 1 lengths
    short = [r.n for r in items.where(F.col("n") < EQUAL).select("n").distinct().collect()]
    masks = dict(enumerate(MASKS)) | {1000 + n: "1" * n for n in sorted(short)}
    at_item = items.select("ik", "n", "item", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    seeds = (at_item.select("ik", "n", "i", F.posexplode(_seeds(F.col("item"), F.col("i"), masks)).alias("m", "seed"))
                    .where(F.col("seed").isNotNull())
                    .where((F.col("m") < len(MASKS)) == (F.col("n") >= EQUAL))
                    .select("seed", "ik", "n", "i").distinct())
    seeds = materialise(seeds, "seeds")
    few = seeds.count() <= BROADCAST_SEEDS
    small = F.broadcast if few else lambda df: df

    own = [*keys, "_text"]
    text = docs.select(*keys, F.xxhash64("text").alias("_text"), word_array("text").alias("words"))
    # outer: Spark would otherwise add a filter that hashes the words a second time
    at_doc = text.select(*own, "words", F.posexplode_outer("words").alias("j", "_")).select(
        *own, *["words"] * few, "j", F.explode(_seeds(F.col("words"), F.col("j"), masks)).alias("seed")).where(F.col("seed").isNotNull())
    hits = at_doc.join(small(seeds), "seed").withColumn("shift", F.col("j") - F.col("i"))
    aligned = F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.col("n") + F.least("shift", F.lit(0)))
    if few:
        hits = hits.select(*own, "ik", "shift", aligned.alias("part")).groupBy(*own, "ik", "shift").agg(F.first("part").alias("part"))
    else:
        hits = hits.select(*own, "ik", "n", "shift").distinct().withColumnsRenamed({k: f"_{k}" for k in own})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in own]
        hits = text.join(hits, [*same], "inner").select(*own, "ik", "shift", aligned.alias("part")).distinct()

    first = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.transform("item", lambda w, k: F.coalesce(F.get("part", k - first) == w, F.lit(False)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    windows = F.transform(
        F.sequence(F.lit(-SUBSTITUTIONS), F.col("n") - EQUAL),
        lambda s: total(F.slice("equal", F.greatest(s, F.lit(0)) + 1, F.lit(WINDOW) + F.least(s, F.lit(0)))))
    found = (hits.join(small(items), "ik").withColumn("equal", equal)
                 .withColumn("counts", F.when(F.col("n") >= EQUAL, F.filter(windows, lambda c: c >= EQUAL))
                             .when(total(F.col("equal")) == F.col("n"), F.array("n")).otherwise(F.array().cast("array<int>")))
                 .where(F.size("counts") > 0))
    return found.groupBy(*keys, "item_id").agg(F.sum(F.size("counts")).cast("long").alias("windows"),
                                               F.max(F.array_max("counts")).cast("long").alias("matched"))


def remove_overlapping(docs: DataFrame, benchmark: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """The rows whose text overlaps no item."""
    rows = packed(docs).withColumn("key", F.xxhash64("text"))
    found = materialise(overlaps(rows, benchmark, ["doc_id", "key"], fewest).select(
        F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct(), "overlapping")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


#: The same rows from pigeonholes instead of masks: EQUAL of WINDOW words leave a run of five.
SQL = f"""
WITH doc AS (SELECT DISTINCT doc_id, text, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM documents),
     bench AS (SELECT DISTINCT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM benchmark),
     dw AS (SELECT row_number() OVER () AS dk, doc_id, string_split(plain, ' ') AS w FROM doc WHERE plain <> ''),
     bw AS (SELECT row_number() OVER () AS ik, item_id, string_split(plain, ' ') AS w FROM bench WHERE plain <> ''
            AND len(string_split(plain, ' ')) >= {FEWEST}),
     dpos AS (SELECT dk, doc_id, w, unnest(range(1, len(w) - 3)) AS j FROM dw WHERE len(w) >= 5),
     bpos AS (SELECT ik, item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw),
     hit AS (SELECT DISTINCT dk, ik, j - i AS shift FROM (SELECT dk, j, w[j:j + 4] AS g FROM dpos) JOIN (SELECT ik, i, w[i:i + 4] AS g FROM bpos) USING (g)),
     eq AS (SELECT h.dk, d.doc_id, h.ik, b.item_id, h.shift, len(b.w) AS n,
                   [CASE WHEN k + h.shift >= 1 AND k + h.shift <= len(d.w) AND d.w[k + h.shift] = b.w[k] THEN 1 ELSE 0 END FOR k IN range(1, len(b.w) + 1)] AS e
            FROM hit h JOIN dw d USING (dk) JOIN bw b USING (ik)),
     win AS (SELECT doc_id, item_id, CASE WHEN n >= {EQUAL}
                    THEN [list_sum(e[greatest(s, 0) + 1:s + {WINDOW}]) FOR s IN range(-{SUBSTITUTIONS}, n - {EQUAL} + 1)
                          IF list_sum(e[greatest(s, 0) + 1:s + {WINDOW}]) >= {EQUAL}]
                    WHEN list_sum(e) = n THEN [n] ELSE [] END AS c FROM eq)
SELECT doc_id, item_id, CAST(sum(len(c)) AS BIGINT) AS windows, CAST(max(list_max(c)) AS BIGINT) AS matched
FROM win WHERE len(c) > 0 GROUP BY doc_id, item_id
"""
