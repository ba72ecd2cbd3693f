"""Composite ticket preparation (P1 with P2 inside): raw tickets -> model
features -> exact stratified train / test split.

The order of the steps matters and follows the reference flow; every step is
one of the library operators.  The cleaned and the enriched tables, each read
by several fits, are written once to the shared folder; the steps, fitted ones
with their dictionaries, are one ``PipelineModel`` that saves and loads.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from civicflow.operators import categories as cat
from civicflow.operators import profile, split
from civicflow.operators.stages import Step, step_of
from civicflow.session import written


@dataclass
class TicketColumns:
    # Raw column names of the ticket table.
    created: str = "Created Date"
    closed: str = "Closed Date"
    agency: str = "Agency"
    ctype: str = "Complaint Type"
    descriptor: str = "Descriptor"
    location_type: str = "Location Type"
    zip: str = "Incident Zip"
    borough: str = "Borough"
    vehicle: str = "Vehicle Type"
    address: str = "Location"
    share_cols: list = field(default_factory=lambda: ["Weisse", "Afroamerikaner", "Asiaten", "Hispanics"])


@dataclass
class PrepResult:
    """``pipeline`` turns raw tickets into the same features, here or after it was saved and loaded."""

    features: DataFrame
    fitted: dict
    pipeline: PipelineModel


def prepare_features(raw: DataFrame, zip_dim: DataFrame | None, shares: DataFrame | None,
                     cols: TicketColumns = TicketColumns(), top_types: int = 20, top_descriptors: int = 50,
                     min_location_pct: float = 0.01, iqr_k: float = 1.5, zip_key: str = "ZipCode",
                     zip_group: str = "Borough", shares_key: str = "Stadtteil", key: str | None = None) -> PrepResult:
    c = cols
    df, steps, fitted = raw, [], {}

    def step(kind: str, table: DataFrame | None = None, **args) -> None:
        nonlocal df
        steps.append(Step(kind, table, **args))
        df = steps[-1].transform(df)

    def fit(name: str, estimator) -> None:
        nonlocal df
        fitted[name] = estimator.fit(df)
        steps.append(step_of(fitted[name]))
        df = steps[-1].transform(df)

    step("drop_if_present", columns=[c.address])                                               # Q6: address dropped early
    step("fill_missing_like", column=c.vehicle, default="none")                                # B6
    step("fill_missing_like", column=c.location_type, default="Other")                         # B6
    fit("rare_location", cat.RareBucketer(c.location_type, min_location_pct))                  # E5
    fit("top_types", cat.TopNBucketer(c.ctype, top_types))                                     # E2
    step("add_duration_days", start=c.created, end=c.closed, out="duration_days")              # F2
    step("drop_negative", column="duration_days")                                              # F4 (nulls kept)
    step("drop_missing_key", column=c.zip)                                                     # B7
    step("coerce_integer", column=c.zip)                                                       # B8
    step("round_columns", columns=["duration_days"], digits=2)                                 # B14 (B11: named directly)
    df = written(df, "cleaned-tickets")
    fit("iqr", cat.IQRCapper(["duration_days"], iqr_k))                                        # E6 on measures only (Q2)
    step("add_date_features", columns=[c.created])                                             # F1
    step("drop_if_present", columns=[c.closed])                                                # B13
    fit("descriptor", cat.TopNEncoder(c.descriptor, top_descriptors, out="Descriptor_encoded"))  # E3
    if zip_dim is not None:                                                                    # C1
        step("fill_group_from_dimension", zip_dim, code=c.zip, group=c.borough, key=zip_key, name=zip_group)
    if shares is not None:                                                                     # C3 (B18 fallback: zeros)
        step("attach_shares", shares, column=c.borough, key=shares_key, shares=list(c.share_cols), missing="drop")
    else:
        step("zero_columns", columns=list(c.share_cols))
    df = written(df, "enriched-tickets")
    text_cols = [c.ctype, c.agency, c.location_type, c.vehicle, c.borough, c.zip]
    fit("codes", cat.DenseCodes([x for x in text_cols if x in df.columns]))                    # E4
    step("drop_if_present", columns=[c.created])
    fit("imputer", profile.NullImputer(exclude=[key, c.ctype]))                                # D12
    step("clip_columns", columns=list(c.share_cols), lo=0.0, hi=1.0)                           # B10
    step("clean_column_names")                                                                 # B12
    return PrepResult(df, fitted, PipelineModel(stages=steps))


def split_features(features: DataFrame, key: str, label: str, seed: int = 42, total: int = 66_000,
                   test: int = 6_000) -> tuple[DataFrame, DataFrame]:
    """Exact 60,000 / 6,000 (or the small-table branch) stratified split."""
    s = written(split.exact_stratified_split(features, key, label, seed, total=total, test=test), "split")
    return s.filter("split = 'train'").drop("split"), s.filter("split = 'test'").drop("split")
