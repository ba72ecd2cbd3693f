"""A5 over ranges, B3 with a zone map, D4/D11 from stored sketches."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from civicflow import sources
from civicflow.operators import profile

LABELS = {"Share A": "a", "Share B": "b"}


def slow(texts):
    out = []
    for text in texts:
        blocks, now = [], None
        for line in text.split("\n"):
            if line.strip().startswith("==="):
                continue
            if m := re.match(r"^\s*([^:]+?)\s*:\s*$", line):
                now = [m[1], {}]
                blocks.append(now)
            elif (m := re.match(r"^\s*([^:]+?)\s*:\s*[-+0-9.]", line)) and now is not None:
                number = re.search(r":\s*([-+0-9.eE]+)", line)[1]
                if m[1] in LABELS:
                    try:
                        now[1].setdefault(m[1], float(number))
                    except ValueError:
                        pass
        out += [(name, v["Share A"], v["Share B"]) for name, v in blocks if len(v) == 2]
    return sorted(out)


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_reports_by_ranges(spark, tmp_path, size):
    texts = []
    for f in range(3):
        lines = ["=== TITLE ===", "", "Share A: 9.9", f"Shares of {f}:"]
        for i in range(150):
            lines += [f"BLOCK {i} of {f}:", ""] + [f"  Share A: 0.{i} (1%)"] * (i % 7 > 0) + ["  other text", "  Other: 3"] + [f"  Share B: {i}.5 (2%)\r"] * (i % 5 > 0) + ["  Share B: 1e-1e"] * (i % 5 == 0)
        texts.append("\n".join(lines))
        (tmp_path / f"r{f}.txt").write_text(texts[-1], newline="")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, size)
    try:
        assert sorted(map(tuple, sources.read_block_report(spark, str(tmp_path), LABELS).collect())) == slow(texts)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_only_files_of_the_years_are_opened(spark, tmp_path):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderdate")
    o = o.unionByName(spark.createDataFrame([(-1, None)] * 3, o.schema))
    path = str(tmp_path / "z")
    sources.write_with_zones(o, "o_orderdate", path, files=14)
    found = sources.read_zones(spark, path, "o_orderdate", [1995, 1997])
    assert sorted(found.collect()) == sorted(o.where("year(o_orderdate) in (1995, 1997)").collect())
    zones = spark.read.parquet(f"{path}/_zones")
    meeting = zones.where("(year(least) <= 1995 and year(most) >= 1995) or (year(least) <= 1997 and year(most) >= 1997)").count()
    assert len(found.inputFiles()) == meeting < zones.count() - 4
    assert spark.read.parquet(path).count() == o.count()
    assert sources.read_zones(spark, path, "o_orderdate", [1900]).count() == 0 == len(sources.read_zones(spark, path, "o_orderdate", []).collect())


def test_sketches_answer_without_the_rows(spark, tmp_path):
    rows = spark.range(60_000).select(F.timestamp_seconds(1_600_000_000 + F.col("id") * 700).alias("t"), (F.col("id") * 7919 % 20_011).alias("k"),
                                      F.when(F.col("id") % 50 > 0, F.pow(F.col("id") % 977, 1.5)).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, float("nan"))], "t timestamp, k long, x double"))
    sources.write_parquet(profile.period_sketches(rows, "t", ["k"], ["x"]), str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for where in ("period >= '2021-01-01' and period < '2021-04-01'", "period is not null", "period is null"):
        probs = [0.1, 0.5, 0.9]
        own = rows.withColumn("period", F.date_trunc("month", "t")).where(where)
        got = profile.from_sketches(stored.where(where), (), ["k"], ["x"], probs).first()
        n, total = own.select("k").where("k is not null").distinct().count(), own.count()
        assert got["rows"] == total and abs(got["n_k"] - n) <= 0.05 * n
        have = own.where("not isnan(x)")
        if have.isEmpty():
            assert got["x"] is None
            continue
        for p, q in zip(probs, got["x"], strict=True):
            below, upto = have.agg(F.avg((F.col("x") < q).cast("double")), F.avg((F.col("x") <= q).cast("double"))).first()
            assert below - 0.02 <= p <= upto + 0.02
    assert "orders" not in stored.inputFiles()[0]
