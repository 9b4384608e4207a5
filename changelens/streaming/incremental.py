"""Label files that arrive over time: a file stream whose micro-batches keep only work not yet done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def request_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def pending(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a completed label for the same input."""
    return requests.join(done.select("request_id", "input_hash"), ["request_id", "input_hash"], "left_anti")


def append_pending(stream: DataFrame, done_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's pending requests once; a batch that is replayed after a failure replaces its own output.

    Every batch writes to a folder of its number, so the sink is idempotent.
    """

    def batch(rows: DataFrame, number: int) -> None:
        done = rows.sparkSession.read.schema("request_id string, input_hash string").parquet(done_path)
        pending(rows, done).dropDuplicates(["request_id", "input_hash"]).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(requests: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The stream ``requests`` (request_id, input_hash, ...) without what was handed on in any earlier batch or is in the stream ``done``.

    One flag per (request_id, input_hash) is kept as state, dealt out by the key and stored with the checkpoint, so no batch
    reads the work that is done, and a replayed batch begins from the state before it. Of requests repeated within a
    batch one goes on. A request and its label in the same batch: the label wins.
    """
    keys = ["request_id", "input_hash"]
    rows = requests.select(*keys, F.lit(False).alias("is_done"))
    if done is not None:
        rows = rows.unionByName(done.select(*keys, F.lit(True).alias("is_done")))

    def once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labelled = any([bool(b["is_done"].any()) for b in batches])
        known = state.exists
        if not known:
            state.update((True,))
        yield pd.DataFrame({"request_id": [key[0]], "input_hash": [key[1]]} if not known and not labelled else {"request_id": [], "input_hash": []}).astype(object)

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandasWithState(once, schema, "seen boolean", "append", "NoTimeout")


def append_first_seen(stream: DataFrame, out_path: str, checkpoint: str, done: DataFrame | None = None) -> StreamingQuery:
    """Writes each batch of ``first_seen`` to a folder of its number: replayed batches replace their own output."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return first_seen(stream, done).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, when: str, width: str, late: str) -> DataFrame:
    """Events per window of a stream, with a watermark for what comes late."""
    return stream.withWatermark(when, late).groupBy(F.window(when, width)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")
