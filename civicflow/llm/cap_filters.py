"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction of a random product code: after a random rotation the
coordinates are cut into blocks, each block has a list of random unit
directions, and a filter takes one of each.  A vector is list-decoded to the
filters that exceed its cap, i.e. those with the ``listed`` largest inner
products; because a filter's product is the sum of its blocks' products, only
combinations whose ranks multiply to at most ``listed`` can be among them.
Vectors that share a filter are compared exactly, in double precision; with
``ROTATIONS`` codes two vectors at cosine 0.95 share 15 filters on average, or
more: the list grows with the number of directions, so that larger tables with
narrower caps miss no more links.

Equal vectors are one class from the start.  A pair is counted in the smallest
filter that both have, so that links are counted without being listed; a
filter with many vectors is cut into blocks, and pairs of blocks are compared in
separate tasks.  Comparisons leave a spanning forest for the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null ``vec_id``, link with nothing; vectors of
different lengths never link; a repeated row is another vector; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import materialise
from civicflow.llm.components import connected_components
from civicflow.llm.gray_simhash import _Forest
from civicflow.llm.hashing import mix

LEAST_COSINE = 0.95
ROTATIONS, LIST, BLOCKS = 4, 12, 4
#: Vectors of a filter that are compared in one task (pairs of blocks: twice as many).
TILE = 256
#: Vectors without partners that a filter holds on average.
CROWD = 0.25
_SEED = 99


def listed(per_block: int) -> int:
    """Filters of a vector in each code: ``LIST`` up to 50 directions.  The power keeps the share of pairs at
    cosine 0.95 that have no common filter (tested at 1 and 10 million vectors)."""
    return int(np.ceil(LIST * max(1.0, per_block / 50) ** 0.6))


def directions(n: int) -> int:
    """Directions of a block, from the number of vectors: it keeps filters at ``CROWD`` chance members."""
    return next((p for p in range(16, 1000) if p ** BLOCKS >= n * ROTATIONS * listed(p) / CROWD), 1000)


class ProductCode:
    """``ROTATIONS`` random product codes for vectors of one length."""

    def __init__(self, length: int, per_block: int):
        rng = np.random.default_rng([_SEED, length, per_block])
        self.blocks = np.array_split(np.arange(length), min(BLOCKS, length))
        self.per_block, self.listed = per_block, listed(per_block)
        self.codes = []
        for _ in range(ROTATIONS):
            turn, _ = np.linalg.qr(rng.standard_normal((length, length)))
            lists = [rng.standard_normal((per_block, len(b))) for b in self.blocks]
            self.codes.append((turn, [x / np.linalg.norm(x, axis=1, keepdims=True) for x in lists]))
        # ranks whose product is at most listed: a combination of worse ranks has listed better ones
        ranks = np.zeros((1, 0), int)
        for _ in self.blocks:
            ranks = np.concatenate([np.column_stack([ranks, np.full(len(ranks), r)]) for r in range(min(self.listed, per_block))])
            ranks = ranks[np.prod(ranks + 1, axis=1) <= self.listed]
        self.ranks = ranks

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The sorted filter numbers of each row of unit vectors."""
        out = []
        for turn, (rotation, lists) in enumerate(self.codes):
            turned, total, best = unit @ rotation, 0.0, []
            for j, (block, own) in enumerate(zip(self.blocks, lists, strict=True)):
                score = turned[:, block] @ own.T
                order = np.argsort(-score, axis=1)[:, :self.listed]
                best.append(order)
                total = total + np.take_along_axis(score, order, 1)[:, self.ranks[:, j]]
            top = np.argpartition(-total, min(self.listed, total.shape[1]) - 1, axis=1)[:, :self.listed]
            number = np.full(top.shape, turn * 100_003 + unit.shape[1], np.uint64)
            for j, order in enumerate(best):
                number = number * np.uint64(1_000_003) + np.take_along_axis(order, self.ranks[:, j][top], 1).astype(np.uint64)
            out.append(mix(number))
        return np.sort(np.concatenate(out, axis=1).view(np.int64), axis=1)


def _matrix(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(rows), length)


def _units(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    x = _matrix(column, rows, length).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


def _decode(per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            lengths, found = _lengths(column), [None] * batch.num_rows
            for length in np.unique(lengths):
                code = codes.setdefault(int(length), ProductCode(int(length), per_block))
                rows = np.flatnonzero(lengths == length)
                for part in np.array_split(rows, -(-len(rows) // 1024)):
                    for row, own in zip(part, code.decode(_units(column, part, int(length))), strict=True):
                        found[row] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "filters"])

    return run


def _earlier_shared(f: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether two filter lists share a number below f, for each of many pairs."""
    out, step = np.zeros(len(f), bool), max(1, 4_700_000 // left.shape[1] ** 2)
    for i in range(0, len(f), step):
        a, b, limit = left[i:i + step], right[i:i + step], f[i:i + step]
        out[i:i + step] = ((a[:, :, None] == b[:, None, :]) & (a < limit[:, None])[:, :, None]).any(axis=(1, 2))
    return out


def _earlier_shared_in_group(f: int, filters: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for many pairs of one group: the numbers below f that two rows or more have become bits."""
    row, _ = np.nonzero(filters < f)
    number, where, times = np.unique(filters[filters < f], return_inverse=True, return_counts=True)
    use = times[where] > 1
    if not use.any():
        return np.zeros(len(left), bool)
    bit = np.cumsum(times > 1)[where[use]] - 1
    bits = np.zeros((len(filters), int(bit.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row[use], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    out = np.zeros(len(left), bool)
    for i in range(0, len(left), 65_536):
        out[i:i + 65_536] = (bits[left[i:i + 65_536]] & bits[right[i:i + 65_536]]).any(axis=1)
    return out


def _compare(batch: pa.RecordBatch, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row positions of the linked pairs to count, in whole groups of equal ``(f, a, b)``."""
    f, a, b, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    vectors, filters = batch.column(6), batch.column(7)
    lengths = _lengths(vectors)
    new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    sizes = np.diff(np.append(new, len(f)))
    lists = _matrix(filters, np.arange(len(f)), int(_lengths(filters)[0]))
    out = [[], []]
    for length in np.unique(lengths[new]):
        for size in np.unique(sizes[lengths[new] == length]):
            if size < 2:
                continue
            first = new[(sizes == size) & (lengths[new] == length)]
            step = max(1, 2_000_000 // int(size * max(size, length)))
            for i in range(0, len(first), step):
                rows = first[i:i + step, None] + np.arange(size)
                x = _units(vectors, rows.ravel(), int(length)).reshape(*rows.shape, int(length))
                near = (x @ x.transpose(0, 2, 1) >= least) & np.triu(np.ones((size, size), bool), 1)
                if (a[rows[:, 0]] != b[rows[:, 0]]).any():
                    across = (a == b)[rows[:, 0]][:, None, None] | (block[rows][:, :, None] != block[rows][:, None, :])
                    near &= across
                if size <= 16:
                    g, p, q = np.nonzero(near)
                    p, q = rows[g, p], rows[g, q]
                    new_pair = ~_earlier_shared(f[p], lists[p], lists[q])
                    out[0].append(p[new_pair])
                    out[1].append(q[new_pair])
                else:
                    for own, pairs in zip(rows, near, strict=True):
                        p, q = np.nonzero(pairs)
                        new_pair = ~_earlier_shared_in_group(int(f[own[0]]), lists[own], p, q)
                        out[0].append(own[p[new_pair]])
                        out[1].append(own[q[new_pair]])
    return tuple(np.concatenate(o) if o else np.zeros(0, int) for o in out)


def _verify(least: float):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of whole groups."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key = [both.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield both.slice(0, cut)
            held = both.slice(cut)
        if held is not None:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            p, q = _compare(batch, least)
            if not len(p):
                continue
            cid, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            every, where = np.unique(cid, return_inverse=True)
            total = (np.bincount(where[p], times[q], len(every)) + np.bincount(where[q], times[p], len(every))).astype(np.int64)
            used = np.flatnonzero(total)
            forest, a, b = _Forest(len(every)), [], []
            for u, v in zip(where[p].tolist(), where[q].tolist(), strict=True):
                if forest.join(u, v):
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([every[used], every[a]]), pa.int64()),
                 pa.array(np.concatenate([total[used], np.zeros(len(a), np.int64)])),
                 pa.array([None] * len(used) + every[b].tolist(), pa.int64())], names=["cid", "links", "other"])

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn(
        "valid", F.coalesce(F.col("vec_id").isNotNull() & F.forall(x, lambda v: F.coalesce(
            v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0), F.lit(False)))
    good = rows.where("valid")
    classes = materialise(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"))
                              .withColumn("cid", F.monotonically_increasing_id()), "cap-classes")
    per_block = directions(classes.count())
    coded = materialise(classes.select("cid", "times", "embedding").mapInArrow(
        _decode(per_block), f"cid long, times long, embedding {vectors.schema['embedding'].dataType.simpleString()}, filters array<long>"),
        "cap-filters")
    entries = coded.select("cid", F.explode("filters").alias("f"))
    shared = materialise(entries.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cap-shared")
    tiles = (entries.join(shared, "f").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int"))
                    .withColumn("block", F.pmod(F.xxhash64("cid", "f"), F.col("blocks")).cast("int"))
                    .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("cid", "f", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block"))
    found = materialise(tiles.join(coded, "cid").select("f", "a", "b", "block", "cid", "times", "embedding", "filters")
                             .repartition("f", "a", "b").sortWithinPartitions("f", "a", "b")
                             .mapInArrow(_verify(least), "cid long, links long, other long"), "cap-links")
    labels = connected_components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = materialise(classes.join(counts, "cid", "left").join(labels, classes.cid == labels.node, "left").select(
        "embedding", "id", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component")), "cap-named")
    least_id = materialise(named.groupBy("component").agg(F.min("id").alias("component_id")), "cap-components")
    named = named.join(least_id, "component").select("embedding", (F.col("times") - 1 + F.col("links")).alias("n_links"), "component_id")
    linked = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same rows by comparing all pairs (for tables of valid vectors).
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {LEAST_COSINE}),
     reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = vec_id GROUP BY vec_id
"""
