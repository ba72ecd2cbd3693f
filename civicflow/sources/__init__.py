"""Readers and sinks.

No reader infers types (no extra pass over 100 TB); all
return lazy DataFrames; column pruning and predicate pushdown happen at scan.
Scratch output goes under the session's checkpoint folder (a shared folder
on a cluster).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow import functions as cf
from civicflow.sources import csv_ranges
from civicflow.session import cut_lineage, ensure_checkpoint_dir

# Fixed value: the ten raw ticket columns the reference keeps (all text).
RAW_TICKET_COLUMNS = ["Created Date", "Closed Date", "Agency", "Complaint Type", "Descriptor",
                      "Location Type", "Incident Zip", "Borough", "Vehicle Type", "Location"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/civicflow-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- A1-A4

def _csv_text(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as text under the names of the header.  A quote inside a
    quoted field is doubled.  With ``multi_line`` a quoted field may hold line
    breaks; a file is then one task (small tables; others by :func:`csv_ranges.read_csv`).
    """
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
                 .option("mode", "PERMISSIVE").csv(path))


def read_tickets_csv(spark: SparkSession, path: str, columns: Sequence[str] = RAW_TICKET_COLUMNS,
                     multi_line: bool = True) -> DataFrame:
    """A1: the named columns of a CSV export, found by header name, as text.
    With ``multi_line`` a quoted field may hold line breaks, and a file is
    still read by ranges (:mod:`civicflow.sources.csv_ranges`)."""
    raw = csv_ranges.read_csv(spark, path) if multi_line else _csv_text(spark, path, False)
    return raw.select(*[F.col(f"`{c}`") for c in columns])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A2: first rows (a LIMIT, not a scan of everything)."""
    return df.limit(n)


def prepare_raw_tickets(df: DataFrame, years: Sequence[int] = (2022, 2023, 2024),
                        created: str = "Created Date", closed: str = "Closed Date",
                        required: str = "Complaint Type") -> DataFrame:
    """Raw scan -> typed tickets: B1 fixed-format parse of both dates (bad ->
    null), B3 year filter, B4 not-null on the class column, B5 conjunction."""
    from civicflow.operators.clean import year_set_predicate
    out = df.withColumns({created: cf.parse_fixed_timestamp(F.col(f"`{created}`")),
                          closed: cf.parse_fixed_timestamp(F.col(f"`{closed}`"))})
    return out.filter(year_set_predicate(created, years) & F.col(f"`{required}`").isNotNull())


def read_dimension_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A4: dimension file; columns are found by header name and cast (unreadable -> null)."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return _csv_text(spark, path, True).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load a prepared table; a missing path raises (no silent empty table)."""
    return csv_ranges.read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)


def load_train_test(spark: SparkSession, train: str, test: str, target: str, sensitive: Sequence[str],
                    rename: Mapping[str, str] = {}, fmt: str = "parquet") -> DataFrame:  # noqa: B006 - never changed
    """Both tables as one, with ``split``, ``y`` (the target), the sensitive
    columns under their names and ``features``, a struct of all others."""
    def side(path: str, name: str) -> DataFrame:
        df = read_table(spark, path, fmt).withColumnsRenamed(dict(rename))
        rest = [c for c in df.columns if c != target and c not in sensitive]
        return df.select(F.lit(name).alias("split"), F.col(f"`{target}`").alias("y"), *[F.col(f"`{c}`") for c in sensitive],
                         F.struct(*[F.col(f"`{c}`") for c in rest]).alias("features"))
    return side(train, "train").unionByName(side(test, "test"))


# ---------------------------------------------------------------- A5: block report

_HEADER, _LABEL, _NUMBER = (re.compile(p) for p in (r"^\s*([^:]+?)\s*:\s*$", r"^\s*([^:]+?)\s*:\s*[-+0-9.]", r":\s*([-+0-9.eE]+)"))


def _report_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled lines with the header before them, if it is in the same range (kind 0), and the last header of each range (kind 1)."""
    key, number, header, out = None, 0, None, []

    def close() -> None:
        out.append((*key, 1, *(header or (None, None)), None, None))

    for batch in batches:
        for own, lines in csv_ranges.by_range(batch):
            if own != key:
                if key is not None:
                    close()
                key, number, header = own, 0, None
            for line in lines.column(2).to_pylist():
                number += 1
                if line.strip().startswith("==="):
                    continue
                if found := _HEADER.match(line):
                    header = (key[1] + number, found[1])  # unique in a file: a line has a byte at least
                elif found := _LABEL.match(line):
                    out.append((*key, 0, *(header or (None, None)), found[1], _NUMBER.search(line)[1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _REPORT.types, strict=True)], schema=_REPORT)
            out.clear()
    if key is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _REPORT.types, strict=True)], schema=_REPORT)


_REPORT = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("name", pa.string()), ("label", pa.string()), ("number", pa.string())])


def read_block_report(spark: SparkSession, path: str, labels: Mapping[str, str], key: str = "key") -> DataFrame:
    """A5: block-structured text report -> one row per block.

    A block is a header line ``NAME:`` followed by ``Label: number (...)``
    lines; lines starting with ``===`` are ignored.  A row is emitted only for
    blocks that carry every label in ``labels`` (label text -> column name),
    so titles and incomplete blocks produce nothing.  Files are read by ranges;
    a header goes on to the lines of its own range, and the last one of each
    range to those at the beginning of the next (one row per range is looked
    at for that), so a report of any size is many tasks.
    """
    rows = csv_ranges.lines(spark, path).mapInArrow(_report_lines, "file long, block long, kind int, at long, name string, label string, number string")
    wanted = F.col("label").isin(list(labels)) | (F.col("kind") == 1)
    rows = cut_lineage(rows.where(wanted))  # the report's numbers, without its other lines
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("at").isNotNull(), F.struct("at", "name")), ignorenulls=True).over(before)
    carried = rows.where("kind = 1").select(F.col("file").alias("_f"), F.col("block").alias("_b"), last.alias("carried"))
    vals = rows.where("kind = 0").join(carried, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    vals = vals.withColumn("at", F.coalesce("at", "carried.at")).withColumn(key, F.coalesce("name", "carried.name")).where("at is not null")
    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    vals = vals.select("file", "at", key, mapping[F.col("label")].alias("_col"), F.col("number").try_cast("double").alias("_value"))
    wide = vals.groupBy("file", "at", key).pivot("_col", list(labels.values())).agg(F.first("_value", ignorenulls=True))
    complete = F.lit(True)
    for c in labels.values():
        complete = complete & F.col(c).isNotNull()
    return wide.filter(complete).select(key, *labels.values())


def write_block_report(df: DataFrame, key: str, columns: Mapping[str, str], path: str,
                       title: str | None = None, digits: int = 3) -> None:
    """Sink for the block format read by :func:`read_block_report`: one
    block per row (``KEY:`` then ``Label: 0.412 (41.2%)`` lines)."""
    parts = [F.concat(F.col(key), F.lit(":\n"))]
    for col_name, label in columns.items():
        v = cf.round_half_even(F.col(col_name), digits)
        parts.append(F.format_string(f"\n  {label}: %.{digits}f (%.1f%%)\n", v, v * 100.0))
    text = F.concat(*parts)
    out = df.select(text.alias("value"))
    if title:
        out = df.sparkSession.range(1).select(F.lit(title).alias("value")).unionByName(out)
    out.write.mode("overwrite").text(path)


# ---------------------------------------------------------------- A6, A10, A12

def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with header (parquet is preferred for intermediate data)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stored fairness table; the class as text, every other column as a number."""
    raw = _csv_text(spark, path, False)
    return raw.select(F.col(raw.columns[0]), *[cf.to_number_or_null(c).alias(c) for c in raw.columns[1:]])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink, optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_by_year(df: DataFrame, ts_col: str, path: str) -> None:
    """Prepared tickets in one folder per year of ``ts_col`` (B3 reads only the folders it needs)."""
    df.withColumn("year", F.year(ts_col)).write.mode("overwrite").partitionBy("year").parquet(path)


def read_years(spark: SparkSession, path: str, years: Sequence[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("year").isin([int(y) for y in years]))


def write_with_zones(df: DataFrame, ts_col: str, path: str, files: int | None = None) -> None:
    """Parquet files of neighbouring timestamps and, beside them, a zone map: the
    least and the greatest timestamp of each file (B3 opens only those it needs)."""
    order = [F.col(ts_col), F.monotonically_increasing_id()]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.write.mode("overwrite").parquet(path)
    own = df.sparkSession.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), ts_col)
    own.groupBy("file").agg(F.min(ts_col).alias("least"), F.max(ts_col).alias("most"), F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/_zones")


def read_zones(spark: SparkSession, path: str, ts_col: str, years: Sequence[int]) -> DataFrame:
    """B3 on files with a zone map: only files that can hold a row of the years are listed and opened."""
    from civicflow.operators.clean import year_set_predicate
    zones = spark.read.parquet(f"{path}/_zones")
    meets = F.lit(False)
    for y in sorted({int(y) for y in years}):
        meets = meets | ((F.year("least") <= y) & (F.year("most") >= y))
    files = [r["file"] for r in zones.where(meets).select("file").orderBy("file").collect()]  # names of files, as Spark's own file list
    schema = spark.read.parquet(path).schema
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return found.where(year_set_predicate(ts_col, years))


def write_json(df: DataFrame, path: str) -> None:
    """A10: JSON-lines sink (nested structs / maps kept)."""
    df.write.mode("overwrite").json(path)


# ---------------------------------------------------------------- A9: JSON ticket requests

# Request fields and their defaults.
REQUEST_SCHEMA = T.StructType([
    T.StructField("ticket_id", T.LongType(), True),
    T.StructField("Agency", T.StringType(), True),
    T.StructField("Location_Type", T.StringType(), True),
    T.StructField("Incident_Zip", T.StringType(), True),
    T.StructField("Vehicle_Type", T.StringType(), True),
    T.StructField("Descriptor", T.StringType(), True),
    T.StructField("created_date", T.StringType(), True),
    T.StructField("Borough", T.StringType(), True),
])
REQUEST_DEFAULTS = {"Agency": "DSNY", "Location_Type": "Street/Sidewalk", "Vehicle_Type": "N/A", "Descriptor": "Straßenzustand"}


def apply_request_defaults(df: DataFrame, as_of=None, groups: Sequence[str] | None = None) -> DataFrame:
    """Fill absent request fields with their defaults; an absent creation
    time becomes ``as_of`` (default: now); the text timestamp is parsed (B2).

    ``request_error`` names the field that can't be accepted: a creation time
    that is no timestamp, no zip code, or (with ``groups``) a descriptor group
    that isn't one of them (B22).  :func:`accepted` and :func:`rejected` part
    the requests by it.
    """
    now = F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    exprs = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in REQUEST_DEFAULTS.items()}
    parsed = cf.parse_timestamp("created_date")
    exprs["created_date"] = F.when(F.col("created_date").isNull(), now).otherwise(parsed)
    error = F.when(F.col("created_date").isNotNull() & parsed.isNull(), "created_date").when(F.col("Incident_Zip").isNull(), "Incident_Zip")
    if groups is not None:
        error = error.when(~exprs["Descriptor"].isin(list(groups)), "Descriptor")
    return df.withColumn("request_error", error).withColumns(exprs)


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where("request_error is null").drop("request_error")


def rejected(requests: DataFrame) -> DataFrame:
    return requests.where("request_error is not null")


def read_requests_json(spark: SparkSession, path: str, as_of=None, groups: Sequence[str] | None = None) -> DataFrame:
    """JSON ticket requests with an explicit schema plus defaults."""
    return apply_request_defaults(spark.read.schema(REQUEST_SCHEMA).json(path), as_of, groups)
