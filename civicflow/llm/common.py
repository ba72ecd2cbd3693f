"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.session import ensure_checkpoint_dir, table

#: Text of an Arrow batch that is held as Python objects at one time.
SLICE_BYTES = 2 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed; the
    files survive a lost executor.  :func:`release_scratch` removes them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession, what: str) -> str:
    """A catalogue name for a bucketed table in the shared folder; :func:`release_scratch` drops it."""
    return f"llm_{what}_{spark.sparkContext.applicationId.replace('-', '_')}_{uuid.uuid4().hex}".lower()


def release_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder, and its entries in the catalogue.

    The caller decides when: results that are read lazily still need the files.
    """
    own = f"_{spark.sparkContext.applicationId.replace('-', '_')}_".lower()
    for t in spark.catalog.listTables():
        if t.name.startswith("llm_") and own in t.name:
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def field(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or (``row.text``) a field of a column that is never null itself."""
    first, *rest = path.split(".")
    out = batch.column(batch.schema.get_field_index(first))
    for name in rest:
        out = out.field(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", at_once: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``at_once`` bytes of text, so that few whole texts are Python objects at once."""
    for batch in batches:
        column = field(batch, text)
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast("int64")).to_numpy()
        first = 0
        while first < batch.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(ends.searchsorted(done + at_once, "right")))
            yield batch.slice(first, last - first)
            first = last


def with_fields(rows: DataFrame, added: str) -> T.StructType:
    """The rows' schema and further fields."""
    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])


def packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``doc_id`` and ``text``: what an operator adds can't clash with a column of the rows."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def one_per_turn(rows: DataFrame, mark: str) -> DataFrame:
    """``turn``, ``mark`` and one ``text`` of each turn (a hash of the id): of several texts the one with the largest hash.

    Rows of a turn are first reduced where they are, so an id repeated in very many rows is no large group.
    """
    best = F.max(F.struct(F.col("text").isNotNull().alias("has"), F.xxhash64("text").alias("hash"), "text"))
    return rows.groupBy("turn", mark).agg(best.alias("best")).select("turn", mark, F.col("best.text").alias("text"))


def global_index(df: DataFrame, order: list, what: str, name: str = "rank") -> DataFrame:
    """``df`` with a gapless 0-based position in the given order.

    The rows are range partitioned (rows equal in all columns of the order are
    split by where they were read), numbered inside their partition and shifted
    by the rows of the partitions before; only one count per partition meets in
    one task.
    """
    base = 1 << 33
    order = [*order, F.col("_row")]
    local = (df.withColumn("_row", F.monotonically_increasing_id())
               .repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_i", F.monotonically_increasing_id() % F.lit(base)))
    local = materialise(local, what)
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition
    return (local.join(F.broadcast(starts), "_pid")
                 .withColumn(name, F.col("_before") + F.col("_i")).drop("_pid", "_i", "_before"))
