"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together.  Groups are taken
from the largest to the smallest and go to the least-loaded shard of a heap.
The heap runs over a histogram of group sizes, which is bounded: sizes from
``2 ** SIZE_BITS`` on share a class with those that agree in the first
``SIZE_BITS`` bits (at most 0.02 % apart), so there are at most
``2 ** SIZE_BITS`` classes and half as many for each further doubling.  Of a
class, equally large groups are interchangeable: the schedule says how many go
to each shard, and the groups take their place by a distributed rank.

Defined cases: a null text counts as an empty one (size: the 8 bytes that any
row has); rows with a null or a repeated ``doc_id`` are placed each; other
columns are not read; an empty table gives an empty result.  A group larger
than a shard's share keeps its shard to itself.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import global_index, materialise

SHARDS = 24
SIZE_BITS = 13
LAW = "bytes"


def schedule(histogram: list[tuple[int, int, int]], shards: int = SHARDS) -> list[tuple[int, int, int, int]]:
    """Place classes ``(class, groups, bytes)``; gives ``(class, shard, first, groups)``: of a class, the
    groups ranked from ``first`` on go to that shard.

    A group goes to the least-loaded shard.  Where the least-loaded shards lie within one group of each
    other, they take turns; as many whole turns as fit below the next shard's load are taken at once.
    """
    loads = [(0.0, s) for s in range(shards)]
    plan = []
    for size_class, n, total in sorted(histogram, reverse=True):
        mean, counts, left = total / n, [0] * shards, n
        while left:
            turns = 0
            if left > shards:
                loads.sort()
                level = sum(load - loads[0][0] <= mean for load, _ in loads)
                room = (loads[level][0] - loads[level - 1][0]) // mean if level < shards else left
                turns = int(min(left // level, room))
            if turns:
                for i in range(level):
                    load, s = loads[i]
                    loads[i] = (load + turns * mean, s)
                    counts[s] += turns
                left -= turns * level
                heapq.heapify(loads)
            else:
                load, s = loads[0]
                heapq.heapreplace(loads, (load + mean, s))
                counts[s] += 1
                left -= 1
        first = 0
        for s, count in enumerate(counts):
            if count:
                plan.append((size_class, s, first, count))
                first += count
        heapq.heapify(loads)
    return plan


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, text_key, shard, slot`` of every row; ``slot`` counts a shard's rows from 0 by id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_key")), "shard-rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("group_size")).withColumn(
        "size_class", F.expr(f"shiftleft(shiftright(group_size, greatest(length(bin(group_size)) - {SIZE_BITS}, 0)),"
                             f" greatest(length(bin(group_size)) - {SIZE_BITS}, 0))"))
    ranked = global_index(groups, [F.desc("size_class"), F.asc("text_key")], "shard-groups")
    # bounded: 2 ** (SIZE_BITS - 1) classes a doubling
    histogram = [tuple(r) for r in ranked.groupBy("size_class").agg(F.count(F.lit(1)), F.sum("group_size"), F.min("rank")).collect()]
    upto = {c: [0] * shards for c, *_ in histogram}  # groups of a class in the shards up to each one
    for c, s, _, n in schedule([h[:3] for h in histogram], shards):
        upto[c][s] = n
    plan = spark.createDataFrame([(c, first, list(accumulate(upto[c]))) for c, _, _, first in histogram],
                                 "size_class long, first long, upto array<long>")
    shard = F.size(F.filter("upto", lambda n: n <= F.col("rank") - F.col("first")))
    placed = ranked.join(F.broadcast(plan), "size_class").select("text_key", shard.alias("shard"))
    rows = materialise(rows.join(placed, "text_key"), "shard-placed")
    rows = global_index(rows, [F.asc("shard"), F.asc_nulls_first("doc_id"), F.asc("text_key")], "shard-slots")
    starts = rows.groupBy("shard").agg(F.min("rank").alias("start"))  # one row per shard
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "text_key", "shard", (F.col("rank") - F.col("start")).alias("slot"))
