"""Golden values from FIXTURES.md: the five-ticket table and the small
variants, checked operator by operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.operators import categories as cat
from civicflow.operators import clean, dates, enrich, fairness, profile, split

D = dt.datetime
TICKETS = [
    (0, D(2023, 1, 1, 10, 0), D(2023, 1, 1, 12, 0), "Noise - Residential", "MANHATTAN", "NYPD", "Loud Music", "10001",
     "PASSENGER VEHICLE", "Street/Sidewalk"),
    (1, D(2023, 1, 2, 22, 0), D(2023, 1, 3, 0, 0), "Sanitation Condition", "BROOKLYN", "DSNY", "Missed Collection",
     "11201", "TRUCK", "Residential Building/House"),
    (2, D(2023, 1, 3, 15, 30), D(2023, 1, 3, 18, 0), "Street Light Condition", "QUEENS", "DOT", "Light Out", "11375",
     "MOTORCYCLE", "Street/Sidewalk"),
    (3, D(2023, 1, 4, 8, 45), D(2023, 1, 4, 10, 0), "Noise - Commercial", "BRONX", "NYPD", "Loud Music", "10451",
     "PASSENGER VEHICLE", "Commercial Building"),
    (4, D(2023, 1, 5, 12, 20), D(2023, 1, 5, 14, 0), "Water System", "STATEN ISLAND", "DEP", "Water Quality", "10301",
     "TRUCK", "Residential Building/House"),
]
SCHEMA = ("id long, created timestamp_ntz, closed timestamp_ntz, ctype string, borough string, agency string, "
          "descriptor string, zip string, vehicle string, loctype string")
SHARES = [("BROOKLYN", 0.412, 0.364, 0.075, 0.198), ("MANHATTAN", 0.544, 0.174, 0.094, 0.272),
          ("QUEENS", 0.441, 0.2, 0.176, 0.25), ("BRONX", 0.299, 0.356, 0.03, 0.484),
          ("STATEN ISLAND", 0.776, 0.097, 0.057, 0.121)]
SHARE_COLS = ["Weisse", "Afroamerikaner", "Asiaten", "Hispanics"]


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.createDataFrame(TICKETS, SCHEMA)


def by_id(df, col):
    return [r[col] for r in df.orderBy("id").collect()]


def test_date_features(tickets):
    out = dates.add_date_features(tickets, ["created"])
    assert by_id(out, "created_hour") == [10, 22, 15, 8, 12]
    assert by_id(out, "created_dayofweek") == [6, 0, 1, 2, 3]
    assert by_id(out, "created_month") == [1] * 5


def test_duration_rounded_and_iqr(tickets):
    d = clean.round_columns(dates.add_duration_days(tickets, "created", "closed"), ["duration_days"], 2)
    assert by_id(d, "duration_days") == [0.08, 0.08, 0.1, 0.05, 0.07]
    cap = cat.IQRCapper(["duration_days"]).fit(d)
    assert cap.report(d).first()[0] == 2
    assert [round(x, 6) for x in by_id(cap.transform(d), "duration_days")] == [0.08, 0.08, 0.095, 0.055, 0.07]


def test_single_case_friday(spark):
    df = spark.createDataFrame([(0, D(2024, 3, 15, 10, 30), D(2024, 3, 15, 12, 30))], "id long, a timestamp_ntz, b timestamp_ntz")
    r = dates.add_duration_days(dates.add_date_features(df, ["a"]), "a", "b").first()
    assert (r.a_hour, r.a_month, r.a_dayofweek) == (10, 3, 4)
    assert abs(r.duration_days - 0.083333) < 1e-5


def test_top_n_encoder_and_dense_codes(tickets):
    enc3 = cat.TopNEncoder("descriptor", 3).fit(tickets).transform(tickets)
    assert by_id(enc3, "descriptor_encoded") == [1, 2, 0, 1, 3]
    enc50 = cat.TopNEncoder("descriptor", 50).fit(tickets).transform(tickets)
    assert by_id(enc50, "descriptor_encoded") == [1, 2, 0, 1, 3]
    codes = cat.DenseCodes(["zip", "borough", "vehicle", "loctype"]).fit(tickets).transform(tickets)
    assert by_id(codes, "zip") == [0, 3, 4, 2, 1]
    assert by_id(codes, "borough") == [2, 1, 3, 0, 4]
    assert by_id(codes, "vehicle") == [1, 2, 0, 1, 2]
    assert by_id(codes, "loctype") == [2, 1, 2, 0, 1]


def test_dense_codes_null_last_and_numeric_order(spark):
    df = spark.createDataFrame([(0, 10), (1, 9), (2, None), (3, 100)], "id long, v int")
    assert by_id(cat.DenseCodes(["v"]).fit(df).transform(df), "v") == [1, 0, 3, 2]


def test_rare_and_topn_bucket_noop(tickets):
    assert by_id(cat.RareBucketer("loctype").fit(tickets).transform(tickets), "loctype") == [t[9] for t in TICKETS]
    assert by_id(cat.TopNBucketer("ctype", 20).fit(tickets).transform(tickets), "ctype") == [t[3] for t in TICKETS]


def test_shares_join(spark, tickets):
    shares = spark.createDataFrame(SHARES, "Stadtteil string, " + ", ".join(f"{c} double" for c in SHARE_COLS))
    out = enrich.attach_shares(tickets, "borough", shares, "Stadtteil", SHARE_COLS)
    r0 = out.filter("id = 0").first()
    assert (r0.Weisse, r0.Afroamerikaner, r0.Asiaten, r0.Hispanics) == (0.544, 0.174, 0.094, 0.272)
    assert out.count() == 5
    t4 = tickets.withColumn("borough", F.when(F.col("id") == 4, "UNKNOWN_BOROUGH").otherwise(F.col("borough")))
    assert enrich.attach_shares(t4, "borough", shares, "Stadtteil", SHARE_COLS).count() == 4
    fb = enrich.attach_shares(t4, "borough", shares, "Stadtteil", SHARE_COLS, missing="mean").filter("id = 4").first()
    assert [round(fb[c], 4) for c in SHARE_COLS] == [0.4944, 0.2382, 0.0864, 0.265]


def test_zip_fill(spark, tickets):
    zips = spark.createDataFrame([(10001, "MANHATTAN"), (11201, "BROOKLYN"), (11375, "QUEENS"), (10451, "BRONX"),
                                  (10301, "STATEN ISLAND")], "ZipCode int, Borough string")
    t = tickets.withColumn("borough", F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 3, "")
                           .otherwise(F.col("borough"))).withColumn("zipn", cf.to_int_or_null("zip"))
    out = enrich.fill_group_from_dimension(t, "zipn", "borough", zips, "ZipCode", "Borough")
    assert by_id(out, "borough")[1] == "BROOKLYN" and by_id(out, "borough")[3] == "BRONX"


def test_small_cleaning_variants(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([1.5, -0.5, 2.0, -1.0, 0.8])], "id long, d double")
    assert by_id(clean.drop_negative(d, "d"), "d") == [1.5, 2.0, 0.8]
    r = spark.createDataFrame([(i, v) for i, v in enumerate([1.56789, 2.12345, 0.87654, 1.23456, 3.0])], "id long, d double")
    assert by_id(clean.round_columns(r, ["d"]), "d") == [1.57, 2.12, 0.88, 1.23, 3.0]
    z = spark.createDataFrame([(0, "10001"), (1, None), (2, "11375"), (3, ""), (4, "10301")], "id long, z string")
    assert by_id(clean.drop_missing_key(z, "z"), "id") == [0, 2, 4]
    v = spark.createDataFrame([(0, "TRUCK"), (1, "  "), (2, "nan"), (3, "NaN"), (4, None)], "id long, v string")
    assert by_id(clean.fill_missing_like(v, "v", "none"), "v") == ["TRUCK", "none", "none", "none", "none"]
    o = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 100, 5])], "id long, x double")
    assert by_id(cat.IQRCapper(["x"]).fit(o).transform(o), "x") == [1.0, 2.0, 3.0, 9.5, 5.0]
    c = spark.createDataFrame([(0, "10001.0"), (1, "10001-123"), (2, "10001.5"), (3, "abc")], "id long, t string")
    assert by_id(c.select("id", cf.to_int_or_null("t").alias("t")), "t") == [10001, None, None, None]


def test_impute_mode_smallest_and_median(spark, tickets):
    t = (tickets.withColumn("ctype", F.when(F.col("id") == 0, F.lit(None)).otherwise(F.col("ctype")))
                .withColumn("zip", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("zip"))))
    out = profile.NullImputer(["ctype", "zip"]).fit(t).transform(t)
    assert by_id(out, "ctype")[0] == "Noise - Commercial"
    assert by_id(out, "zip")[1] == "10001"


def test_shares_and_tiers(spark):
    rows = [(i, "a") for i in range(80)] + [(100 + i, "b") for i in range(15)] + [(200 + i, "c") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, k string")
    t = {r.k: (r.pct, r.tier) for r in profile.share_tiers(df, "k", cuts=(20.0,)).collect()}
    assert t == {"a": (80.0, 1), "b": (15.0, 2), "c": (5.0, 2)}


def test_fairness_hand_made(spark):
    rows = [("A", 1, 1), ("A", 1, 0), ("A", 0, 1), ("A", 0, 0), ("B", 1, 1), ("B", 1, 1), ("B", 0, 0), ("B", 0, 0)]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    m = fairness.per_class_metrics(df, "y", "p", ["g"], classes=[1]).first()
    assert (m[fairness.DPD], m[fairness.EOD], m[fairness.DIR]) == (0.0, 0.5, 1.0)
    assert fairness.verdict(fairness.per_class_metrics(df, "y", "p", ["g"])).first().violation is True


def test_reweighing_weights(spark):
    rows = [("A", 1)] * 3 + [("A", 0)] + [("B", 1)] * 2 + [("B", 0)] * 2
    df = spark.createDataFrame(rows, "g string, y int")
    w = {(r.g, r.y): r.weight for r in fairness.reweigh(df, ["g"], "y").distinct().collect()}
    assert w == {("A", 1): 8 / 3, ("A", 0): 8.0, ("B", 1): 4.0, ("B", 0): 4.0}


def test_metric_flags(spark):
    m = spark.createDataFrame([(0, 0.1, 0.0, 1.0), (1, 0.25, 0.0, 1.0), (2, -0.05, 0.0, 1.0)],
                              f"cls int, {fairness.DPD} double, {fairness.EOD} double, {fairness.DIR} double")
    assert [r.dpd_flag for r in fairness.metric_flags(m, 0.2).orderBy("cls").collect()] == [False, True, False]


def test_exact_split_sizes_and_drift(spark):
    df = spark.range(100_000).withColumn("cls", F.when(F.col("id") % 10 < 7, "x").when(F.col("id") % 10 < 9, "y")
                                         .otherwise("z"))
    s = split.exact_stratified_split(df, "id", "cls", 42, total=66_000, test=6_000).cache()
    assert s.filter("split = 'train'").count() == 60_000
    assert s.filter("split = 'test'").count() == 6_000
    drift = profile.share_drift(s.filter("split = 'train'"), s.filter("split = 'test'"), "cls").first()
    assert drift.within_limit


def test_fold_ids_cells_equal_single_rank(spark):
    df = spark.range(5_000).withColumn("cls", (F.col("id") % 3).cast("string"))
    many = split.stratified_fold_ids(df, "id", "cls", k=10, cell_rows=97)
    one = split.stratified_fold_ids(df, "id", "cls", k=10, cell_rows=10**9)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    sizes = [r[0] for r in many.groupBy("cls", "fold").count().select("count").collect()]
    assert max(sizes) - min(sizes) <= 1


def test_bottom_k_exact_under_skew(spark):
    # one class holds most rows: the candidate filter must still give exact quotas
    df = spark.range(20_000).withColumn("cls", F.when(F.col("id") % 20 == 0, "rare").otherwise("hot"))
    got = split.stratified_bottom_k(df, "id", "cls", 1_000, seed=7)
    counts = {r.cls: r["count"] for r in got.groupBy("cls").count().collect()}
    assert counts == {"hot": 950, "rare": 50}
    h = df.withColumn("h", cf.seeded_hash("id", 7)).filter("cls = 'hot'").orderBy("h", "id").limit(950)
    assert {r.id for r in h.collect()} == {r.id for r in got.filter("cls = 'hot'").collect()}


def test_block_report_reference_format(spark, tmp_path):
    text = ("=== BEVÖLKERUNGSVERTEILUNG HINZUFÜGEN ===\n\nBevölkerungsverteilung pro Borough:\n \n"
            "BROOKLYN:\n\n  Weiße: 0.412 (41.2%)\n\n  Afroamerikaner: 0.364 (36.4%)\n\n"
            "  Asiaten: 0.075 (7.5%)\n\n  Hispanics/Latinos: 0.198 (19.8%)\n \n"
            "QUEENS:\n\n  Weiße: 0.441 (44.1%)\n\n  Afroamerikaner: 0.200 (20.0%)\n\n"
            "  Asiaten: 0.176 (17.6%)\n\n  Hispanics/Latinos: 0.250 (25.0%)\n")
    p = tmp_path / "report.txt"
    p.write_text(text, encoding="utf-8")
    from civicflow import sources
    labels = {"Weiße": "Weisse", "Afroamerikaner": "Afroamerikaner", "Asiaten": "Asiaten",
              "Hispanics/Latinos": "Hispanics"}
    rows = {r.key: tuple(r[1:]) for r in sources.read_block_report(spark, str(p), labels).collect()}
    assert rows == {"BROOKLYN": (0.412, 0.364, 0.075, 0.198), "QUEENS": (0.441, 0.2, 0.176, 0.25)}
