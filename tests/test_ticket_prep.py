"""P1 on the five-ticket fixture: values from FIXTURES.md survive the chain."""

from pyspark.sql import functions as F

from test_fixtures import SHARE_COLS, SHARES, TICKETS
from civicflow.plans.ticket_prep import TicketColumns, prepare_features, split_features


def test_prepare_five_tickets(spark):
    rows = [(t[0], t[1], t[2], t[5], t[3], t[6], t[9], t[7], t[4], t[8], "addr") for t in TICKETS]
    raw = spark.createDataFrame(rows, "id long, `Created Date` timestamp_ntz, `Closed Date` timestamp_ntz, "
                                      "Agency string, `Complaint Type` string, Descriptor string, "
                                      "`Location Type` string, `Incident Zip` string, Borough string, "
                                      "`Vehicle Type` string, Location string")
    zips = spark.createDataFrame([(10001, "MANHATTAN"), (11201, "BROOKLYN")], "ZipCode int, Borough string")
    shares = spark.createDataFrame(SHARES, "Stadtteil string, " + ", ".join(f"{c} double" for c in SHARE_COLS))
    out = prepare_features(raw, zips, shares, TicketColumns()).features.orderBy("id").collect()
    assert len(out) == 5
    assert [r.Descriptor_encoded for r in out] == [1, 2, 0, 1, 3]
    assert [r.Created_Date_hour for r in out] == [10, 22, 15, 8, 12]
    assert [r.Created_Date_dayofweek for r in out] == [6, 0, 1, 2, 3]
    assert [round(r.duration_days, 3) for r in out] == [0.08, 0.08, 0.095, 0.055, 0.07]
    assert [r.Incident_Zip for r in out] == [0, 3, 4, 2, 1]
    assert [r.Borough for r in out] == [2, 1, 3, 0, 4]
    assert (out[0].Weisse, out[0].Hispanics) == (0.544, 0.272)
    assert "Location" not in out[0].asDict()


def test_split_features_small_branch(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4).cast("int"))
    train, test = split_features(df, "id", "y")
    assert (train.count(), test.count()) == (900, 100)
