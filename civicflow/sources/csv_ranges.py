"""CSV files with quoted line breaks, read by byte ranges (A1).

Spark's text reader cuts a file into byte ranges and gives each range the lines
that begin in it.  Whether a line begins inside a quoted field depends on all
lines before it, so a first pass finds, for each range, the state at its end
from either state at its start; composing these from range to range gives the
true state at the start of each.  A second pass cuts every range into
records.  Records that begin in one range and end in another are put together
from the pieces of the ranges they cross (a third pass, over such ranges only).

A quote opens a field only at its beginning; inside one, two quotes are one; what
follows the closing quote belongs to no quoted field.  That is how Spark's own
multi-line reader takes them, which reads a file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicflow.session import cut_lineage

#: Ranges (a few dozen bytes each) up to which their states are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 2_000_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one, or at a field's beginning."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at += not inside
            inside = False
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if not line.startswith('"', at + 1):
                    break
                at += 2
        at = line.find(",", at) + 1
        if not at:
            return False


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (a hash), ``block`` (the range's first byte) and the lines, in order within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The runs of lines of one range in a batch."""
    file, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def _quoted(values: pa.Array) -> np.ndarray:
    return pc.match_substring(values, '"').to_numpy(zero_copy_only=False)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each range from either state at its start."""
    key, state, out = None, None, []
    for batch in batches:
        for own, part in by_range(batch):
            if own != key:
                if key is not None:
                    out.append((*key, *state))
                key, state = own, (False, True)
            values = part.column(2)
            for line in values.filter(pa.array(_quoted(values))).to_pylist():
                first = ends_inside(line, state[0])
                state = (first, first if state[0] == state[1] else ends_inside(line, state[1]))
    if key is not None:
        out.append((*key, *state))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["file", "block", "from_out", "from_in"])


def _compose(table: pa.Table) -> pa.Table:
    """States at the start and the end of a file's ranges."""
    table = table.sort_by("block")
    starts, state = [], False
    ends = []
    for out, inside in zip(table["from_out"].to_pylist(), table["from_in"].to_pylist(), strict=True):
        starts.append(state)
        state = inside if state else out
        ends.append(state)
    return pa.Table.from_arrays([table["file"], table["block"], pa.array(starts), pa.array(ends)], names=["file", "block", "inside", "left_open"])


def _records(whole: bool):
    """Records of the ranges (``whole``), or the pieces of those that cross a border: kind 1 ends a record, 2 begins one, 3 is in the midst of one."""
    names = ["file", "block", "kind", "first", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, began, record = None, False, [], True, 0

        def emit(texts: list[str], kind: int, first: bool) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                                               pa.array([first] * n, pa.bool_()), pa.array(texts, pa.string())], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            """What is left at the end of a range."""
            if held and not whole:
                yield emit(["\n".join(held)], 2 if began else 3, began and record == 0 and key[1] == 0)

        for batch in batches:
            for own, part in by_range(batch):
                if own != key:
                    if key is not None:
                        yield from close()
                    key, state, held, record = own, bool(part.column(3)[0].as_py()), [], 0
                    began = not state
                values = part.column(2)
                marked = np.flatnonzero(_quoted(values))
                done, at = [], 0
                # lines without a quote are records of their own outside, and parts of one inside
                for i in [*marked.tolist(), len(values)]:
                    between = values.slice(at, i - at).to_pylist()
                    if state:
                        held.extend(between)
                    else:
                        done.extend(between)
                    if i == len(values):
                        break
                    line = values[i].as_py()
                    before, state = state, ends_inside(line, state)
                    if before and not state:
                        held.append(line)
                        if began:
                            done.append("\n".join(held))
                        elif not whole:
                            yield emit(["\n".join(held)], 1, False)
                        held, began = [], True
                    elif state:
                        held.append(line)
                    else:
                        done.append(line)
                    at = i + 1
                if done:
                    if whole:
                        if record == 0 and key[1] == 0:
                            yield emit(done[:1], 0, True)
                            done = done[1:]
                            record = 1
                        if done:
                            yield emit(done, 0, False)
                    record += len(done)
        if key is not None:
            yield from close()

    return run


_PIECES = "file long, block long, kind int, first boolean, value string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of every record but each file's first one (the header)."""
    text = lines(spark, path)
    found = text.mapInArrow(_transitions, "file long, block long, from_out boolean, from_in boolean")
    states = cut_lineage(found.groupBy("file").applyInArrow(_compose, "file long, block long, inside boolean, left_open boolean"))  # a row per range
    few = states.count() <= BROADCAST_RANGES
    own = (F.broadcast(states) if few else states).withColumnsRenamed({"file": "_f", "block": "_b"})
    here = [F.col("file") == F.col("_f"), F.col("block") == F.col("_b")]
    # every range of the first pass must be one of the second
    inside = F.coalesce("inside", F.raise_error(F.lit("the ranges of the file have changed")).cast("boolean")).alias("inside")
    joined = text.join(own, here, "left")
    if not few:  # a shuffle: ranges whole and in order again
        at = text.withColumn("_i", F.monotonically_increasing_id())
        joined = at.join(own, here, "left").repartition("file", "block").sortWithinPartitions("file", "block", "_i")
    each = joined.select("file", "block", "value", inside, "left_open")
    out = each.select("file", "block", "value", "inside").mapInArrow(_records(True), _PIECES).where("not first").select("value")
    if not states.where("left_open").isEmpty():
        crossed = each.where("inside or left_open").select("file", "block", "value", "inside").mapInArrow(_records(False), _PIECES)
        crossed = cut_lineage(crossed)  # two pieces of a range at most
        before = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
        start = F.last(F.when(F.col("kind") == 2, F.col("block")), ignorenulls=True).over(before)
        parts = F.sort_array(F.collect_list(F.struct("block", "value")))
        whole = crossed.withColumn("start", start).groupBy("file", "start").agg(
            F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"), F.bool_or("first").alias("first"))
        out = out.unionByName(whole.where("not first").select("value"))
    # a line break is one character, as for the multi-line reader on files of such breaks
    value = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    return out.select(value.alias("value")).where("value <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under the names of the header; one file is as many tasks as its bytes ask for."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return records(spark, path).select(row.alias("row")).select("row.*")
