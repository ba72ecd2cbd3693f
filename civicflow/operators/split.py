"""Reproducible sampling and exact stratified splits.

Row order comes from a seeded md5 of the key (``functions.seeded_hash``), so
results do not depend on partitioning and can be reproduced in any SQL
engine; rows with equal keys are ordered by all their columns.  No operator
here ranks a whole class of an unbounded table inside one task:

* one pass counts rows per (class, hash bucket); a class has at most 65,536
  buckets.  From these counts follow class sizes, quotas and the bucket in
  which a draw ends, so that a second pass reads exactly the rows up to that
  bucket and only those are ordered;
* stratified fold ids rank rows inside (class, hash cell) groups whose size
  is capped, adding the rows of the cells before.

A null class is a class like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.session import cut_lineage

_H, _B = "_h", "_b"
BUCKETS = 1 << 16


def seeded_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """G1: keep rows whose seeded hash falls below ``fraction``."""
    return df.filter(cf.hash_unit(key, seed) < F.lit(fraction))


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows with their hash and its bucket (the leading 16 bits: buckets are in hash order)."""
    h = df.withColumn(_H, cf.seeded_hash(key, seed))
    return h.withColumn(_B, F.conv(F.substring(_H, 1, 4), 16, 10).cast("int"))


def _bucket_counts(hashed: DataFrame, strata: str) -> DataFrame:
    """Rows per (class, bucket), written once: the only full pass besides the draw itself."""
    return cut_lineage(hashed.groupBy(F.col(strata).alias("_s"), _B).agg(F.count(F.lit(1)).alias("n")))


def _largest_remainder(counts: DataFrame, quota_total: int, n_total: int) -> DataFrame:
    """Per-class quota floor(n_c*Q/N) + 1 for the largest remainders (ties:
    class asc, null first).  Runs on the table of classes ``(_s, n)``."""
    product = F.col("n").cast("decimal(38,0)") * F.lit(quota_total).cast("decimal(19,0)")
    base = F.floor(product / F.lit(n_total)).cast("long")
    c = counts.withColumn("_base", base)
    c = c.withColumn("_rem", (product - F.col("_base").cast("decimal(19,0)") * F.lit(n_total).cast("decimal(19,0)")))
    missing = F.lit(quota_total) - c.agg(F.sum("_base")).scalar()
    order = Window.orderBy(F.desc("_rem"), F.asc_nulls_first("_s"))  # one row per class
    extra = F.when(F.row_number().over(order) <= missing, 1).otherwise(0)
    return c.select("_s", "n", (F.col("_base") + extra).cast("long").alias("quota"))


def _row_order(df: DataFrame, key: str) -> list:
    """Hash, key, then all columns that can be ordered: equal keys don't make the order arbitrary."""
    rest = [f.name for f in df.schema.fields if f.name not in (_H, _B, key) and f.dataType.typeName() not in ("map", "variant")]
    return [F.col(_H), F.col(key), *[F.col(c) for c in rest]]


def _drawn(hashed: DataFrame, counts: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` first rows in hash order: only the buckets up to the one in which the draw ends are read and ordered."""
    by_bucket = counts.groupBy(_B).agg(F.sum("n").alias("n"))  # at most BUCKETS rows
    upto = by_bucket.withColumn("_upto", F.sum("n").over(Window.orderBy(_B)))
    last = upto.where(F.col("_upto") >= k).agg(F.min(_B)).first()[0]
    if last is None:
        return hashed
    return hashed.where(F.col(_B) <= last).orderBy(*_row_order(hashed, key)).limit(k)


def bottom_k(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows with the smallest seeded hash (ties: key, then the other columns), exactly."""
    hashed = _hashed(df, key, seed)
    counts = cut_lineage(hashed.groupBy(_B).agg(F.count(F.lit(1)).alias("n")))
    return _drawn(hashed, counts, key, k).drop(_H, _B)


def _split_drawn(drawn: DataFrame, key: str, strata: str, n: int, test: int) -> DataFrame:
    """Exact stratified split of a bounded draw of ``n`` hashed rows."""
    counts = drawn.groupBy(F.col(strata).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    quotas = _largest_remainder(counts, test, n)
    ranked = (drawn.join(quotas, drawn[strata].eqNullSafe(quotas["_s"]))
                   .withColumn("_r", F.row_number().over(Window.partitionBy(strata).orderBy(*_row_order(drawn, key)))))
    split = F.when(F.col("_r") > F.col("n") - F.col("quota"), F.lit("test")).otherwise(F.lit("train"))
    return ranked.select(*[c for c in drawn.columns if c not in (_H, _B)], split.alias("split"))


def exact_stratified_split(df: DataFrame, key: str, strata: str, seed: int = 42,
                           total: int = 66_000, test: int = 6_000, small_test_fraction: float = 0.1) -> DataFrame:
    """Reproducible draw of ``total`` rows, then a stratified split
    with exactly ``test`` test rows (largest-remainder class quotas).

    When the table has fewer than ``total`` rows all rows are used and the
    test size is ``min(test, int(small_test_fraction * n))``.
    Returns the drawn rows with a ``split`` column ('train' / 'test').
    """
    hashed = _hashed(df, key, seed)
    counts = _bucket_counts(hashed, strata)
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n >= total:
        return _split_drawn(cut_lineage(_drawn(hashed, counts, key, total)), key, strata, total, test)
    return _split_drawn(hashed, key, strata, max(n, 1), min(test, int(small_test_fraction * n)))


def stratified_bottom_k(df: DataFrame, key: str, strata: str, total: int, seed: int = 42) -> DataFrame:
    """Stratified draw of exactly ``total`` rows (all, if there are fewer):
    class quotas by largest remainder of n_c*total/N, and inside each class
    the rows with the smallest seeded hash."""
    hashed = _hashed(df, key, seed)
    return _stratified(hashed, _bucket_counts(hashed, strata), key, strata, total).drop(_H, _B)


def _stratified(hashed: DataFrame, counts: DataFrame, key: str, strata: str, total: int) -> DataFrame:
    sizes = counts.groupBy("_s").agg(F.sum("n").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    quotas = _largest_remainder(sizes, min(total, n), max(n, 1)).select(F.col("_s").alias("_class"), "quota")
    upto = counts.withColumn("_upto", F.sum("n").over(Window.partitionBy("_s").orderBy(_B)))
    last = (upto.join(quotas, upto["_s"].eqNullSafe(quotas["_class"])).where((F.col("_upto") >= F.col("quota")) & (F.col("quota") > 0))
                .groupBy("_class", "quota").agg(F.min(_B).alias("_last")))  # one row per class
    near = hashed.join(last, hashed[strata].eqNullSafe(last["_class"])).where(F.col(_B) <= F.col("_last"))
    rank = F.row_number().over(Window.partitionBy(strata).orderBy(*_row_order(hashed, key)))
    return near.withColumn("_r", rank).where(F.col("_r") <= F.col("quota")).select(*hashed.columns)


def two_stage_split(df: DataFrame, key: str, strata: str, seed: int = 42, stage1: int = 65_000,
                    train: int = 60_000, small_test_fraction: float = 0.1) -> DataFrame:
    """Stratified draw of ``stage1`` rows, then an exact stratified
    ``train`` / ``stage1 - train`` split of the draw; a table with fewer than
    ``stage1`` rows is split with ``min(stage1 - train, 10 %)`` test rows."""
    hashed = _hashed(df, key, seed)
    counts = _bucket_counts(hashed, strata)
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n >= stage1:
        return _split_drawn(cut_lineage(_stratified(hashed, counts, key, strata, stage1)), key, strata, stage1, stage1 - train)
    return _split_drawn(hashed, key, strata, max(n, 1), min(stage1 - train, int(small_test_fraction * n)))


def stratified_fold_ids(df: DataFrame, key: str, strata: str, k: int = 10, seed: int = 42,
                        cell_rows: int = 1_000_000) -> DataFrame:
    """fold = (rank of the row inside its class by seeded hash - 1) mod k.

    The rank is computed without putting a class into one task: a class's
    buckets are merged, in hash order, into cells of about ``cell_rows`` rows;
    a row's rank is its row number inside the cell plus the rows of the
    class's cells before.
    """
    hashed = _hashed(df, key, seed)
    counts = _bucket_counts(hashed, strata)
    order = Window.partitionBy("_s").orderBy(_B)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn("_before", before).withColumn("_cell", F.floor(F.col("_before") / cell_rows))
    first = Window.partitionBy("_s", "_cell")
    cells = cells.select("_s", F.col(_B).alias("_bucket"), "_cell", F.min("_before").over(first).alias("_off"))
    h = hashed.join(cells, hashed[strata].eqNullSafe(cells["_s"]) & (F.col(_B) == F.col("_bucket")))
    rank = F.col("_off") + F.row_number().over(Window.partitionBy(strata, "_cell").orderBy(*_row_order(hashed, key)))
    return h.withColumn("fold", ((rank - 1) % k).cast("int")).select(*df.columns, "fold")


def fold_summary(scores: DataFrame, metrics: list[str], fold: str = "fold") -> DataFrame:
    """The per-fold metric rows followed by their mean and standard deviation."""
    names = F.col(fold).cast("string").alias(fold)
    rows = scores.select(names, *metrics)
    mean = scores.agg(F.lit("mean").alias(fold), *[F.avg(m).alias(m) for m in metrics])
    std = scores.agg(F.lit("std").alias(fold), *[F.stddev_pop(m).alias(m) for m in metrics])
    return rows.unionByName(mean).unionByName(std)
