"""Structured Streaming scoring (L1).

Requests arrive as JSON files in a folder.  Keyed state lets each request
through once: a file that is delivered again, or a ticket that is sent again
within the time the state is kept, changes nothing.  Every micro-batch goes to
two sinks, the result records (by the very same
:func:`civicflow.plans.scoring.score` as in batch) and the requests that can't
be accepted with the field at fault, in folders named by the batch, so that a
batch that is run again after a failure replaces what it wrote.

The caller names the checkpoint folder (offsets and state): a query restarted
with the same one resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from civicflow import sources
from civicflow.plans.scoring import ScoringDims, score

#: How long the state remembers a request after it came.
REMEMBERED = timedelta(days=1)
#: States that share the keys; more of them for more keys (each is read and written as a whole).
BUCKETS = 256


def request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A9 as a stream: JSON request files with an explicit schema, as they were sent."""
    r = spark.readStream.schema(sources.REQUEST_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


#: A remembered request: digest of its key, and when it came last (milliseconds).
_KNOWN = np.dtype([("key", "S16"), ("at", "<i8")])


def _first_of(remembered_ms: int):
    """The first request of each key of a bucket: of several in one batch the least text, whatever their order."""
    def run(bucket: tuple, rows: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        least: dict[str, str] = {}
        now = state.getCurrentWatermarkMs()
        for some in rows:  # each row is looked at once, and a key that comes very often is one entry
            now = max(now, int(some["arrived_ms"].max()))
            for key, request in zip(some["key"].tolist(), some["request"].tolist(), strict=True):
                held = least.get(key)
                if held is None or request < held:
                    least[key] = request
        known = np.frombuffer(state.get[0], _KNOWN).copy() if state.exists else np.empty(0, _KNOWN)
        known = known[known["at"] > now - remembered_ms]
        keys = np.frombuffer(bytes.fromhex("".join(least)), "S16")
        seen = np.isin(keys, known["key"])
        known["at"][np.isin(known["key"], keys[seen])] = now
        new = np.empty(int((~seen).sum()), _KNOWN)
        new["key"], new["at"] = keys[~seen], now
        state.update((np.concatenate([known, new]).tobytes(),))
        state.setTimeoutTimestamp(now + remembered_ms)
        yield pd.DataFrame({"request": [request for request, old in zip(least.values(), seen.tolist(), strict=True) if not old]}, dtype=object)

    return run


def once(requests: DataFrame, as_of=None, groups: Sequence[str] | None = None, remembered: timedelta = REMEMBERED, buckets: int = BUCKETS) -> DataFrame:
    """``request`` (JSON text): each accepted ticket, and each rejected ticket and fault, the first time it comes.

    The key is the ticket's id, or the whole request where it has none; a
    ticket that was rejected is free to come again in better shape.  Time is
    that of arrival, so that no request is ever late.  Keys share ``buckets``
    states (24 bytes a remembered key), so that a batch is a few hundred calls of
    Python and not one for each key; a checkpoint keeps its number of buckets.
    """
    fields = sources.REQUEST_SCHEMA.fieldNames()
    text = F.to_json(F.struct(*fields))
    rows = requests.withColumns({"request": text, "arrived": F.current_timestamp()}).withColumn("arrived_ms", F.unix_millis("arrived"))
    rows = sources.apply_request_defaults(rows, as_of, groups).withWatermark("arrived", "1 second")
    ticket = F.coalesce(F.col("ticket_id").cast("string"), F.sha2("request", 256))
    key = F.substring(F.sha2(F.concat_ws(":", F.coalesce("request_error", F.lit("")), ticket), 256), 1, 32)
    keyed = rows.select(key.alias("key"), "request", "arrived", "arrived_ms").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(
        _first_of(int(remembered.total_seconds() * 1000)), "request string", "known binary", "append", GroupStateTimeout.EventTimeTimeout)


def start_scoring(spark: SparkSession, in_path: str, out_path: str, dims: ScoringDims, model, checkpoint: str, rejected_path: str,
                  as_of=None, available_now: bool = True, groups: Sequence[str] | None = None, max_files_per_trigger: int | None = None,
                  remembered: timedelta = REMEMBERED, buckets: int = BUCKETS):
    """Start the scoring stream: requests in ``in_path`` -> result records in
    ``out_path`` and rejected requests, with ``request_error``, in
    ``rejected_path`` (parquet, a folder per batch).  ``available_now``
    processes what is there and stops (incremental batch); otherwise it runs
    continuously.  Dimensions are written once, not computed again per micro-batch.
    """
    written = dims.written()

    def both(batch: DataFrame, number: int) -> None:
        own = f"batch={number}"
        # the state is asked once, and what it let through is parsed and checked once; both sinks read that
        staged = f"{checkpoint}/staged/{own}"
        requests = batch.select(F.from_json("request", sources.REQUEST_SCHEMA).alias("sent")).select("sent", "sent.*")
        checked = sources.apply_request_defaults(requests, as_of, groups)
        checked.write.mode("overwrite").parquet(staged)
        checked = batch.sparkSession.read.schema(checked.schema).parquet(staged)
        score(checked.drop("sent"), written, model, as_of).write.mode("overwrite").parquet(f"{out_path}/{own}")
        sources.rejected(checked).select("sent.*", "request_error").write.mode("overwrite").parquet(f"{rejected_path}/{own}")

    w = once(request_stream(spark, in_path, max_files_per_trigger), as_of, groups, remembered, buckets).writeStream.foreachBatch(both)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
