"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, in which neighbours share most
of their leading bits, into ranges of a range partitioning, and these are cut
into parts of ``PART`` fingerprints.  A node of the index holds the bits that all
fingerprints below it share (mask and pattern) without those its parent already
holds.  A search carries the differences seen so far down the levels and drops
a whole group as soon as they exceed the limit.  The masks of the ranges (a
bounded number) are the top level, which every task has; the masks of a range's
parts are a row of a table, which fingerprints that reach the range are joined
with; within a part the levels are built when it is searched.

A block of routed fingerprints and one range or part are one row of a join, so
that a part that very many fingerprints reach is split like any skewed join.
Searches leave a spanning forest of their links, from which components follow.

Defined cases: an empty or null text has fingerprint 0 and is linked like any
other; rows with a null ``doc_id`` are linked with nothing (null component);
rows that share a ``doc_id`` are one document (where one row of it is kept, that
of the least text hash, then of the least JSON text of all its columns); repeated
rows come out each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import materialise, packed, slices
from civicflow.llm.components import connected_components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
PART, FEWEST_RANGES, MOST_RANGES, PARTS_OF_A_RANGE = 16_384, 16, 16_384, 16
#: Children of an index node; fingerprints searched at a time; fingerprints of a routed block, and of all blocks that a task holds.
FAN, CHUNK, BLOCK, HELD = 16, 512, 8_192, 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        past = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *past[:len(words) - shingle]]
        hashes = [xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, past[shingle - 1:])]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    # up to 255 rows of 64 one-byte counters are added eight counters at a time
    for i in range(0, len(h), 255):
        bits = np.unpackbits(h[i:i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the binary reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels over items in Gray order; an item is a pattern of the bits that its mask says are known."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray):
        levels = [(pattern & mask, mask)]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            at = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern | ~mask, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(ones ^ np.bitwise_or.reduceat(pattern, at))
            levels.append((ones & shared, shared))
        levels.reverse()
        # what a node's parent holds is left out of the node
        self.levels = [levels[0]]
        for (_, above), (pattern, mask) in zip(levels, levels[1:]):
            own = mask & ~np.repeat(above, FAN)[:len(mask)]
            self.levels.append((pattern & own, own))

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, item)`` positions whose known bits differ in at most ``limit`` places."""
        for i in range(0, len(queries), CHUNK):
            q = queries[i:i + CHUNK]
            pattern, mask = self.levels[0]
            query = np.repeat(np.arange(len(q)), len(pattern))
            node = np.tile(np.arange(len(pattern)), len(q))
            far = np.zeros(len(node), np.uint8)
            for depth, (pattern, mask) in enumerate(self.levels):
                if depth:
                    query, far = np.repeat(query, FAN), np.repeat(far, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    if len(pattern) % FAN:
                        real = node < len(pattern)
                        query, far, node = query[real], far[real], node[real]
                far = far + np.bitwise_count((q[query] ^ pattern[node]) & mask[node])
                near = np.flatnonzero(far <= limit)
                query, node, far = query[near], node[near], far[near]
            yield query + i, node


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def join(self, a: int, b: int) -> bool:
        parent = self.parent
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
        return a != b


class _Blocks:
    """Routed fingerprints by where they go, in blocks ``(at, own, fps, ids)``; ``own``: the part they come from, if it lies there."""

    def __init__(self):
        self.held: dict[tuple[int, int], list] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def _flush(self, key: tuple[int, int]) -> pa.RecordBatch:
        fps, ids = (np.concatenate(x) for x in zip(*self.held.pop(key), strict=True))
        del self.sizes[key]
        return pa.RecordBatch.from_pydict({"at": pa.array([key[0]], pa.int64()), "own": pa.array([key[1]], pa.int64()),
                                           "fps": pa.array([fps.tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary())})

    def add(self, at: np.ndarray, own: int, home: int, fps: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(at, kind="stable")
        at, fps, ids = at[order], fps[order], ids[order]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            if len(part):
                goes = int(at[part[0]])
                key = (goes, own if goes == home else -1)
                self.held.setdefault(key, []).append((fps[part], ids[part]))
                self.sizes[key] = self.sizes.get(key, 0) + len(part)
                if self.sizes[key] >= BLOCK:
                    yield self._flush(key)
        if sum(self.sizes.values()) >= HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for key in list(self.held):
            yield self._flush(key)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of a range, which come in Gray order, in parts."""
    where, number, held = TaskContext.get().partitionId(), 0, []

    def part(fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "range": pa.array([where], pa.int64()), "part": pa.array([where << 32 | number], pa.int64()),
            "ones": pa.array([int(np.bitwise_and.reduce(fps))], pa.int64()), "some": pa.array([int(np.bitwise_or.reduce(fps))], pa.int64()),
            "part_fps": pa.array([fps.tobytes()], pa.binary()), "part_ids": pa.array([ids.tobytes()], pa.binary())})

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        while sum(len(f) for f, _ in held) >= PART:
            fps, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            yield part(fps[:PART], ids[:PART])
            number, held = number + 1, [[fps[PART:], ids[PART:]]]
    fps, ids = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
    if len(fps):
        yield part(fps, ids)


def _route_ranges(ranges: np.ndarray, ones: np.ndarray, some: np.ndarray, limit: int):
    """Blocks of the fingerprints that may have a partner in a range (their own or a later one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, blocks = GrayIndex(ones, ~(ones ^ some)), _Blocks()
        for batch in batches:
            for home, own, fps, ids in zip(*(batch.column(c).to_pylist() for c in ("range", "part", "part_fps", "part_ids")), strict=True):
                fps, ids = np.frombuffer(fps, "<u8"), np.frombuffer(ids, "<i8")
                for query, node in index.search(fps, limit):
                    later = ranges[node] >= home
                    yield from blocks.add(ranges[node[later]], own, home, fps[query[later]], ids[query[later]])
        yield from blocks.rest()

    return run


def _route_parts(limit: int):
    """Blocks of the fingerprints that may have a partner in a part (their own or a later one), from those that reach its range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for batch in batches:
            for own, fps, ids, below in zip(*(batch.column(c).to_pylist() for c in ("own", "fps", "ids", "below")), strict=True):
                fps, ids = np.frombuffer(fps, "<u8"), np.frombuffer(ids, "<i8")
                parts, ones, some = (np.array([b[c] for b in below], np.int64) for c in ("part", "ones", "some"))
                ones, some = ones.view(np.uint64), some.view(np.uint64)
                for query, node in GrayIndex(ones, ~(ones ^ some)).search(fps, limit):
                    later = parts[node] >= own
                    yield from blocks.add(parts[node[later]], -1, -1, fps[query[later]], ids[query[later]])
        yield from blocks.rest()

    return run


def _search(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, q_id, x, x_id = (np.frombuffer(batch.column(i)[row].as_py(), t)
                                    for i, t in enumerate(("<u8", "<i8", "<u8", "<i8")))
                order = np.argsort(gray_rank(x))
                x, x_id = x[order], x_id[order]
                index = GrayIndex(x, np.full(len(x), ~np.uint64(0)))
                every, where = np.unique(np.concatenate([q_id, x_id]), return_inverse=True)
                forest, a, b = _Forest(len(every)), [], []
                for query, item in index.search(q, limit):
                    left, right = where[query], where[len(q) + item]
                    other = left != right
                    for u, v in zip(left[other].tolist(), right[other].tolist(), strict=True):
                        if forest.join(u, v):
                            a.append(u)
                            b.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(every[a], pa.int64()), pa.array(every[b], pa.int64())], names=["a", "b"])

    return run


def _signed_rank():
    """Gray rank as a signed number in the same order."""
    x = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def links(distinct: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """A spanning forest ``(a, b)`` of the links between ids of distinct fingerprints ``(fp, id)``."""
    ranges = min(MOST_RANGES, max(FEWEST_RANGES, -(-distinct.count() // (PART * PARTS_OF_A_RANGE))))
    order = _signed_rank()
    parts = materialise(distinct.select("fp", "id").repartitionByRange(ranges, order).sortWithinPartitions(order).mapInArrow(
        _parts, "range long, part long, ones long, some long, part_fps binary, part_ids binary"), "gray-parts")
    tops = parts.groupBy("range").agg(
        F.sort_array(F.collect_list(F.struct("part", "ones", "some"))).alias("below"), F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
    tops = materialise(tops, "gray-ranges")  # as many rows as partitions of the range partitioning
    known = tops.select("range", "ones", "some").orderBy("range").toPandas()
    ones, some = (known[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("ones", "some"))
    routed = "at long, own long, fps binary, ids binary"
    near = parts.mapInArrow(_route_ranges(known["range"].to_numpy().astype(np.int64), ones, some, limit), routed) if len(known) else parts.sparkSession.createDataFrame([], routed)
    near = near.join(tops.select("range", "below"), F.col("at") == F.col("range")).mapInArrow(_route_parts(limit), routed)
    near = materialise(near, "gray-routed").select(F.col("at").alias("part"), "fps", "ids")
    return near.join(parts.select("part", "part_fps", "part_ids"), "part").select("fps", "ids", "part_fps", "part_ids").mapInArrow(_search(limit), "a long, b long")


def group_documents(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                           .mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    distinct = materialise(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    # rows of one document may differ: their fingerprints are linked through its id
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    same = rows.join(several.select("doc_id"), "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels = connected_components(links(distinct, limit).union(same))
    named = distinct.join(labels, distinct.id == labels.node, "left").select(
        "fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """One row of each group: that of the smallest id (rows with a null id stay)."""
    found = group_documents(docs, shingle, limit)
    kept = materialise(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")), "kept-ids")
    # the texts are moved at any size of the list of ids, and not sorted
    kept = kept.select(F.col("doc_id").alias("kept_id"), "times").hint("shuffle_hash")
    rows = packed(docs)
    rows = rows.where("doc_id is null").select("row").union(_first(rows.join(kept, rows.doc_id == kept.kept_id)))
    return rows.select("row.*")


def _first(rows: DataFrame) -> DataFrame:
    """One row per id, whatever their order; only ids that several rows have are compared."""
    # the text of the row itself: both branches read the same columns of one shuffle
    text = F.col("row")["text"].cast("string")
    several = rows.where("times > 1").select("doc_id", "row", F.struct(F.xxhash64(text).alias("h"), F.to_json("row").alias("j")).alias("order"))
    return rows.where("times = 1").select("row").union(several.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row"))
