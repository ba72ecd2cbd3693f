"""What plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from civicflow import session, sources
from civicflow.operators import categories, enrich, profile, split
from civicflow.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_years_are_folders(spark, tmp_path):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    sources.write_by_year(o, "o_orderdate", str(tmp_path / "t"))
    out = sources.read_years(spark, str(tmp_path / "t"), [1995])
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan(out))
    assert out.count() == o.where("year(o_orderdate) = 1995").count()


@pytest.mark.parametrize("name", ["balance_weights", "share_drift", "topk_rest", "dense_codes", "auc_ovr", "reweigh", "shares_fallback"])
def test_no_window_over_all_rows(spark, name):
    text = plan(catalog.queries()[name](spark, SF_SMALL))
    big = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    # single partitions hold only aggregates of the whole table or a take-ordered list
    assert "CartesianProduct" not in text
    assert len(big) == 0 or "Window" not in text or name == "topk_rest"


def test_lookups_run_no_job_while_the_plan_is_built(spark):
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    n = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    spark.sparkContext.setJobGroup("plan-only", "lookups")
    out = enrich.lookup_with_default(c, "c_nationkey", n, "n_nationkey", "n_name", "name", "none")
    out = enrich.fill_group_from_dimension(out, "c_nationkey", "name", n, "n_nationkey", "n_name")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    assert out.count() == c.count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fitted_dictionaries_save_and_load(spark, tmp_path):
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet").select("p_partkey", "p_brand", "p_size")
    for own in (categories.TopNBucketer("p_brand", 3), categories.TopNEncoder("p_brand", 3), categories.DenseCodes(["p_brand", "p_size"]),
                categories.RareBucketer("p_brand", 5.0)):
        fitted = own.fit(p)
        fitted.save(str(tmp_path / type(own).__name__))
        again = type(own).load(spark, str(tmp_path / type(own).__name__))
        assert sorted(map(tuple, fitted.transform(p).collect()), key=str) == sorted(map(tuple, again.transform(p).collect()), key=str)
    with pytest.raises(ValueError):
        categories.TopNEncoder.load(spark, str(tmp_path / "DenseCodes"))


def test_codes_of_large_integers_are_exact(spark):
    df = spark.createDataFrame([(2**53 + i,) for i in (3, 1, 2, 0)] + [(None,)], "x long")
    codes = {r.x: r.x_code for r in categories.DenseCodes(["x"], "_code").fit(df).transform(df).collect()}
    assert codes == {2**53: 0, 2**53 + 1: 1, 2**53 + 2: 2, 2**53 + 3: 3, None: 4}


def test_exact_quantiles_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 49 + [(10.0,), (None,)], "x double").repartition(5)
    assert profile.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"] == [1.0, 1.0, 1.5, 2.0, 10.0]
    assert profile.exact_quantiles(df.where("x is null"), ["x"], [0.5])["x"] == [None]


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_seeded_fold_sizes(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("c"))
    sizes = [r["count"] for r in split.stratified_fold_ids(df, "id", "c", k=10).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 3


def test_refined_lambda_is_at_least_as_likely(spark):
    from civicflow.operators.scaling import YeoJohnsonGrid
    df = spark.range(400).select((F.pow(F.col("id") % 37, F.lit(1.7)) - 20).alias("x"))
    grid, fine = YeoJohnsonGrid(["x"]), YeoJohnsonGrid(["x"], refine=2)
    best = {r["lambda"]: r["llf"] for r in grid.fit(df).table.collect()}
    finer = {r["lambda"]: r["llf"] for r in fine.fit(df).table.collect()}
    assert abs(fine.best["x"] - grid.best["x"]) <= 0.5 and max(finer.values()) >= max(best.values()) - 1e-9
    assert fine.transform(df).agg(F.stddev_pop("x")).first()[0] > 0
