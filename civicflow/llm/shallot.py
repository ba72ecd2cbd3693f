"""Centroid clustering by shallot search.

Vectors are integers, ``floor(scale * x)``.  Each vector carries an upper bound
of the distance to its centroid, a lower bound of the distance to any other and
the number of the second-nearest centroid.  After the centroids have moved the
bounds follow; a vector whose bounds still separate keeps its centroid without
a look at it.  Otherwise the distances to its own and to the remembered second
centroid are computed, and the search starts at the closer one: the others come
sorted by their distance to it, and the search ends at the edge of a ball around
it whose radius (distance to its centre plus second-best distance) shrinks as
closer centroids are found.  Bounds and balls are doubles, widened by a margin;
who is nearest is decided by integers alone, ties by the smaller number.

The vectors stay where they were read: a round rewrites them with their bounds
and never shuffles them.  Only centroids (``k`` of them) and their sums, split
into limbs of 30 bits that no number of rows overflows, pass through the driver.

Defined cases: vectors that are null, of another length or hold null or
non-finite components are left out; a null ``vec_id`` is clustered but starts no
centroid; repeated rows are further vectors; with fewer vectors than ``k``
there are as many centroids as vectors; components of any size are exact, a
squared distance or sum beyond a long is null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import materialise

K, ROUNDS, SCALE, SIZE, SEED = 16, 3, 64, 64, 1
#: Components below this give squared distances of up to 64 components within 63 bits.
SMALL = 1 << 27
_LIMB = 30
#: Relative widening of bounds, far above the rounding of the doubles they are computed with.
_MARGIN = 1e-9
#: Vectors searched at a time.
CHUNK = 4096
_STATE = "vec_id long, embedding array<double>, cluster int, second int, upper double, lower double, distance long"


def usable(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors of the given length without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where((F.size("embedding") == size) & finite)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``; Python integers where a component is not small."""
    if not x.size or np.abs(x).max() < SMALL / scale / 2:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in x.ravel().tolist()]
    made = np.empty(len(exact), object)
    made[:] = exact
    return made.reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``x`` to ``c`` (one row, or one for each)."""
    d = x - c
    return (d * d).sum(axis=-1)


def _root(d: np.ndarray | int) -> np.ndarray:
    d = np.asarray(d)
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    return np.array([math.sqrt(v) if v < 1e300 else _float(math.isqrt(v)) for v in d.ravel().tolist()]).reshape(d.shape)


def _float(v: int) -> float:
    """Infinity where a double can't hold the integer: bounds then separate nothing."""
    return float(v) if v < 1 << 1023 else math.inf


class Centroids:
    """Centroids with all that a search needs: distances between them and each one's neighbours in order."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        small = all(abs(v) < SMALL for r in rows for v in r)
        self.x = np.array(rows, np.int64 if small else object).reshape(len(rows), -1)
        self.apart = np.stack([_root(squared(self.x, c)) for c in self.x]) if len(rows) else np.zeros((0, 0))
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.moved = np.zeros(len(rows))
        if before:
            old = np.array(before, object).reshape(len(before), -1)
            self.moved = np.array([float(_root(squared(a, b))) for a, b in zip(self.x.astype(object), old, strict=True)]) * (1 + _MARGIN)

    def search(self, x: np.ndarray, start: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest centroid with their squared distances, and the number of distances computed."""
        near, next_ = start.copy(), other.copy()
        best, second = squared(x, self.x[start]), squared(x, self.x[other])
        computed = 2 * len(x)
        swap = (second < best) | ((second == best) & (next_ < near))
        near[swap], next_[swap], best[swap], second[swap] = next_[swap], near[swap], second[swap], best[swap].copy()
        centre, to_centre = near.copy(), _root(best)
        for c in np.unique(centre):
            rows = np.flatnonzero(centre == c)
            for j in self.order[c]:
                if not len(rows):
                    break
                # the ball shrinks with the second-best distance; who is outside stays outside
                rows = rows[self.apart[c, j] <= (to_centre[rows] + _root(second[rows])) * (1 + _MARGIN) + _MARGIN]
                todo = rows[(j != start[rows]) & (j != other[rows])]
                if j == c or not len(todo):
                    continue
                d = squared(x[todo], self.x[j])
                computed += len(todo)
                first = (d < best[todo]) | ((d == best[todo]) & (j < near[todo]))
                then = ~first & (d < second[todo])
                win, place = todo[first], todo[then]
                second[win], next_[win] = best[win], near[win]
                best[win], near[win] = d[first], j
                second[place], next_[place] = d[then], j
        return near, next_, best, second, computed


def assign(centroids: Centroids, x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
           exact: bool) -> tuple[np.ndarray, ...]:
    """The next ``cluster, second, upper, lower, distance`` and the number of distances computed; ``exact``: distances of all rows."""
    k, n = len(centroids.x), len(x)
    distance = np.zeros(n, x.dtype if x.dtype == object or centroids.x.dtype == object else np.int64)
    cluster, second = cluster.copy(), second.copy()
    if k == 1:
        cluster[:], second[:] = 0, 0
        distance[:] = squared(x, centroids.x[0])
        return cluster, second, _root(distance), np.full(n, np.inf), distance, n
    others = np.array([np.delete(centroids.moved, j).max() for j in range(k)])
    upper, lower = upper + centroids.moved[cluster], lower - others[cluster]
    clear = lambda rows: upper[rows] * (1 + _MARGIN) + _MARGIN < lower[rows] * (1 - _MARGIN)
    every = np.arange(n)
    open_ = every[~clear(every)]
    computed = 0
    tight = every if exact else open_
    if len(tight):
        distance[tight] = squared(x[tight], centroids.x[cluster[tight]])
        upper[tight] = _root(distance[tight])
        computed += len(tight)
        open_ = open_[~clear(open_)]
    if len(open_):
        near, next_, best, then, more = centroids.search(x[open_], cluster[open_], second[open_])
        cluster[open_], second[open_], distance[open_] = near, next_, best
        upper[open_], lower[open_] = _root(best), _root(then)
        computed += more
    return cluster, second, upper, lower, distance, computed


def _batches(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _assign(rows: list[list[int]], before: list[list[int]] | None, scale: int, exact: bool):
    """States of the vectors after an assignment; ``before``: centroids of the state's bounds, none in the first round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows, before)
        for batch in batches:
            for part, raw in _batches(batch, raw_size):
                x, n = integers(raw, scale), part.num_rows
                if before is None:
                    cluster, second = np.zeros(n, np.int64), np.full(n, min(1, len(rows) - 1))
                    upper, lower = np.full(n, np.inf), np.zeros(n)
                else:
                    cluster, second, upper, lower = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
                    cluster, second = cluster.astype(np.int64), second.astype(np.int64)
                cluster, second, upper, lower, distance, _ = assign(centroids, x, cluster, second, upper, lower, exact)
                fits = distance if distance.dtype != object else [int(d) if d < 1 << 63 else None for d in distance]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), pa.array(fits, pa.int64())], names=[c.split()[0] for c in _STATE.split(", ")])

    raw_size = len(rows[0])
    return run


def _sums(k: int, size: int, scale: int):
    """``cluster, limb, n, total`` (one number per component) of a task's vectors; limb -1 counts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), {}
        for batch in batches:
            for part, raw in _batches(batch, size):
                x, cluster = integers(raw, scale), part.column(2).to_numpy(zero_copy_only=False)
                counts += np.bincount(cluster, minlength=k)
                limb = 0
                while True:
                    # the last limb keeps the sign
                    last = x.dtype != object or max(map(abs, x.ravel())) < 1 << _LIMB
                    low = (x if last else x & ((1 << _LIMB) - 1)).astype(np.int64)
                    for c in np.unique(cluster):
                        at = (int(c), limb)
                        totals[at] = totals.get(at, 0) + low[cluster == c].sum(axis=0)
                    if last:
                        break
                    x, limb = x >> _LIMB, limb + 1
        found = [(c, -1, [int(n)]) for c, n in enumerate(counts) if n] + [(*at, t.tolist()) for at, t in totals.items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                                              pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["cluster", "limb", "totals"])

    return run


def means(state: DataFrame, rows: list[list[int]], scale: int) -> list[list[int]]:
    """New centroids: exact floors of the components' means; an empty cluster keeps its centroid."""
    k, size = len(rows), len(rows[0])
    parts = state.select("vec_id", "embedding", "cluster").mapInArrow(_sums(k, size, scale), "cluster int, limb int, totals array<long>")
    sums = parts.select("cluster", "limb", F.posexplode("totals").alias("i", "v")).groupBy("cluster", "limb", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    counts, totals = {}, {}
    for r in sums.collect():  # k * size numbers for each limb
        if r.limb < 0:
            counts[r.cluster] = int(r.v)
        else:
            totals[r.cluster, r.i] = totals.get((r.cluster, r.i), 0) + (int(r.v) << _LIMB * r.limb)
    return [[totals[c, i] // counts[c] for i in range(size)] if c in counts else rows[c] for c in range(k)]


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(order.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return [[int(v) for v in integers(np.array([r.embedding], np.float64), scale)[0]] for r in rows]


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE,
                    seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every usable vector after ``rounds`` rounds, and the final centroids."""
    kept = materialise(usable(vectors, size), "vectors")
    rows = first_centroids(kept, k, scale, seed)
    if not rows:
        return kept.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    state, before = kept, None
    for last in [False] * rounds + [True]:
        state = materialise(state.mapInArrow(_assign(rows, before, scale, last), _STATE), "assigned")
        if not last:
            before, rows = rows, means(state, rows, scale)
    return state.select("vec_id", "cluster", "distance"), rows


def summary(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.bool_and(F.col("distance").isNotNull()).alias("whole"))
    found = {r.cluster: int(r.d) if r.whole else None for r in sums.collect()}  # k rows
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    total = fits(None if None in found.values() else sum(found.values()))
    rows = [(c, fits(found.get(c)), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, seed: int = SEED) -> str:
    """All distances in every round."""
    ctes = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS x FROM embeddings
         WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {size})""",
            f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), x) - 1 AS cluster, x AS c
         FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (SELECT r, vec_id, x, cluster, list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN range(1, {size + 1})]) AS d FROM v, c{i}
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT cluster, list(m ORDER BY j) AS c FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS m FROM
         (SELECT cluster, j, CAST(sum(x[j]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{i}, range(1, {size + 1}) t(j) GROUP BY cluster, j)) GROUP BY cluster)""")
            ctes.append(f"c{i + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON m.cluster = o.cluster)")
    return "WITH " + ",\n     ".join(ctes) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


SQL = _sql()
