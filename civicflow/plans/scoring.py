"""Ticket scoring (L1): request -> enrichment -> features -> model -> result.

One ``score`` function serves batch DataFrames and streaming DataFrames
alike: every step is a stateless column expression or a join against a
static dimension, so Structured Streaming runs it per micro-batch unchanged.

Flow: B9 zip digits -> C2 borough (default 'Unspecified') -> C4 group shares
(fallback: dimension means) -> F3 age at ``as_of`` -> F1 hour / month /
weekday -> C5 codes of agency, location type, borough and vehicle type
(default -1) -> C6 group -> descriptor (default: the rest label) -> code
(default 99) -> B15 feature order -> I15/I16 prediction + confidence ->
C7 class name and group -> A10 result record.

Codes come from dictionaries fitted on the training tickets
(:func:`fit_dictionaries`), the same that encode the training features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow.operators import categories as cat
from civicflow.operators import enrich
from civicflow.session import cut_lineage, written
from civicflow.sources import accepted

# Defaults of the lookups.
REST, NO_CODE, NO_DESCRIPTOR_CODE, NO_BOROUGH, NO_CLASS, NO_GROUP = (
    "sonstiges", -1, 99, "Unspecified", "Unknown Class", "Nicht kategorisiert")
CODED = {"Agency": "agency_code", "Location_Type": "location_type_code", "Borough": "borough_code", "Vehicle_Type": "vehicle_type_code"}
FEATURE_ORDER = ["agency_code", "location_type_code", "zip_code", "borough_code", "vehicle_type_code", "age_days", "created_hour",
                 "created_month", "created_dayofweek", "descriptor_code"]


@dataclass
class ScoringDims:
    zip_dim: DataFrame            # zip, borough
    shares: DataFrame             # borough key + share columns
    share_cols: Sequence[str]
    codes: DataFrame              # field, value, code
    group_descriptor: DataFrame   # group, descriptor
    descriptor_codes: DataFrame   # descriptor, code
    class_names: DataFrame        # class id, name
    class_groups: DataFrame       # name, group

    def written(self) -> ScoringDims:
        """The same dimensions, each computed once and kept in the shared folder, as files: their size tells Spark
        which to broadcast, so that requests are not dealt out by the few values of a borough or an agency."""
        return replace(self, **{f.name: written(getattr(self, f.name), f"dims-{f.name}") for f in fields(self) if f.name != "share_cols"})


def fit_dictionaries(tickets: DataFrame, descriptor: str = "Descriptor", group: str | None = None,
                     top_descriptors: int = 50) -> dict[str, DataFrame]:
    """Codes of the request fields (E4), of the descriptors (E3) and, with a
    ``group`` column, the most frequent descriptor of each group (ties: smallest)."""
    dense = cat.DenseCodes(list(CODED)).fit(tickets)
    encoder = cat.TopNEncoder(descriptor, top_descriptors, REST).fit(tickets)
    out = {"codes": dense.codes.select(F.col("_col").alias("field"), F.col("_s").alias("value"), F.col("_code").alias("code")).where("value is not null"),
           "descriptor_codes": encoder.codes.select(F.col("_v").alias("descriptor"), F.col("_code").alias("code"))}
    if group:
        counts = tickets.where(F.col(descriptor).isNotNull()).groupBy(F.col(group).alias("group"), F.col(descriptor).alias("descriptor")).agg(
            F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), "descriptor"))
        out["group_descriptor"] = cut_lineage(counts.groupBy("group").agg(best["descriptor"].alias("descriptor")))
    return out


def build_features(requests: DataFrame, dims: ScoringDims, as_of=None) -> DataFrame:
    """Enrichment and feature columns for each request row."""
    text = F.trim("Incident_Zip")
    df = requests.withColumn("zip_code", cf.digits_or_zero(text))
    zips = dims.zip_dim.select(F.col("zip").cast("string").alias("zip"), "borough")
    df = enrich.lookup_with_default(df, text, zips, "zip", "borough", "borough_lookup", NO_BOROUGH)
    given = F.when(F.col("Borough") != "", F.col("Borough"))
    df = df.withColumn("Borough", F.coalesce(given, F.col("borough_lookup"))).drop("borough_lookup")
    df = enrich.attach_shares(df, "Borough", dims.shares, dims.shares.columns[0], list(dims.share_cols), missing="mean")
    df = df.withColumns({
        "age_days": cf.age_days("created_date", as_of),
        "created_hour": cf.hour_of("created_date"),
        "created_month": cf.month_of("created_date"),
        "created_dayofweek": cf.weekday_of("created_date"),
    })
    for field, out in CODED.items():
        df = enrich.lookup_with_default(df, field, dims.codes.where(F.col("field") == field), "value", "code", out, NO_CODE)
    df = enrich.lookup_with_default(df, "Descriptor", dims.group_descriptor, "group", "descriptor", "descriptor_used", REST)
    rest = dims.descriptor_codes.where(F.col("descriptor") == REST).select("code")
    df = enrich.lookup_with_default(df, "descriptor_used", dims.descriptor_codes, "descriptor", "code", "descriptor_code")
    row = rest.first()  # one small read
    return df.withColumn("descriptor_code", F.coalesce("descriptor_code", F.lit(NO_DESCRIPTOR_CODE if row is None else row[0])))


def feature_columns(dims: ScoringDims) -> list[str]:
    """The features in the order the model takes them."""
    return FEATURE_ORDER + list(dims.share_cols)


def score(requests: DataFrame, dims: ScoringDims, model, as_of=None) -> DataFrame:
    """L1: one result row per accepted request (works on batch and streaming input)."""
    feats = build_features(accepted(requests) if "request_error" in requests.columns else requests, dims, as_of)
    vec = VectorAssembler(inputCols=feature_columns(dims), outputCol="features", handleInvalid="keep")
    pred = model.transform(vec.transform(feats))
    pred = pred.withColumn("predicted_class", F.col("prediction").cast("int"))
    if "probability" in pred.columns:
        p = F.col("probability")
        arr = p if dict(pred.dtypes)["probability"].startswith("array") else vector_to_array(p)
        pred = pred.withColumn("confidence", F.array_max(arr))
    else:
        pred = pred.withColumn("confidence", F.lit(None).cast("double"))
    pred = enrich.class_label(pred, "predicted_class", dims.class_names, dims.class_names.columns[0],
                              dims.class_names.columns[1], dims.class_groups, dims.class_groups.columns[0],
                              dims.class_groups.columns[1], default_name=NO_CLASS, default_group=NO_GROUP)
    shares_map = F.create_map(*[x for c in dims.share_cols for x in (F.lit(c), F.col(c))])
    return pred.select(
        "ticket_id",
        F.struct(F.col("class_group").alias("group"), F.col("class_name").alias("specific_type"),
                 F.col("confidence"), F.col("Borough").alias("borough"), shares_map.alias("shares"),
                 F.col("descriptor_used"), F.col("age_days").alias("duration_days")).alias("result"))


def score_json(results: DataFrame) -> DataFrame:
    """A10: result records as JSON text."""
    return results.select("ticket_id", F.to_json("result").alias("json"))
