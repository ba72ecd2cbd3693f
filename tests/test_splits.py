"""Draws and splits on hard keys and classes."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicflow.operators import metrics, split


def test_draw_from_few_distinct_keys(spark):
    df = spark.range(20_000).select((F.col("id") % 5).alias("k"), "id")
    rows = split.bottom_k(df, "k", 10).collect()
    assert len(rows) == 10 and len({r.k for r in rows}) == 1
    again = split.bottom_k(df.repartition(7), "k", 10).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_stratified_draw_from_equal_keys(spark):
    df = spark.range(5_000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("c"), "id")
    assert split.stratified_bottom_k(df, "k", "c", 10).count() == 10


@pytest.fixture(scope="module")
def with_nulls(spark):
    return spark.range(1_000).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 4).alias("c"))


def test_a_null_class_is_a_class(with_nulls):
    for total in (100_000, 500):
        out = split.exact_stratified_split(with_nulls, "id", "c", total=total, test=50).collect()
        assert len(out) == min(total, 1_000)
        assert sum(r.split == "test" for r in out) == 50
        assert any(r.c is None for r in out)
    assert split.two_stage_split(with_nulls, "id", "c", stage1=400, train=360).where("c is null").count() == 40
    folds = split.stratified_fold_ids(with_nulls, "id", "c", k=5, cell_rows=7).collect()
    assert len(folds) == 1_000 and set(Counter(r.fold for r in folds if r.c is None).values()) == {20}


def test_folds_do_not_depend_on_cells(with_nulls):
    a, b = (sorted((r.id, r.fold) for r in split.stratified_fold_ids(with_nulls, "id", "c", cell_rows=n).collect()) for n in (3, 10**6))
    assert a == b


def test_test_size_between_the_limits(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 4).alias("c"))
    counts = Counter(r[0] for r in split.two_stage_split(df, "id", "c").select("split").collect())
    assert counts == {"train": 55_000, "test": 5_000}


def test_null_labels_are_counted(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 1), (None, None), (2, 2)], "y int, p int")
    assert metrics.summary_metrics(df, "y", "p").first()["n"] == 5
    assert metrics.confusion_counts(df, "y", "p").agg(F.sum("n")).first()[0] == 5
