"""Live mode: change events as streams, debounced, and applied to keyed state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.checkpoints import shared_dir


def watch(spark: SparkSession, folder: str, schema=None, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    """A folder of arriving files, or one file of a folder, as a stream."""
    reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", per_trigger)
    if os.path.isfile(folder.removeprefix("file://")):
        folder, name = os.path.split(folder)
        reader = reader.option("pathGlobFilter", name)
    return (reader.schema(schema) if schema is not None else reader).load(folder)


def debounced(events: DataFrame, key: str, item: str, ts: str, gap: str = "75 milliseconds", watermark: str = "10 minutes") -> DataFrame:
    """(key, item, start, end, n): changes of one item within a burst, emitted when the quiet period is over.

    Rows later than the watermark are dropped, the usual event-time policy.
    """
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    g = e.groupBy(F.col(key), F.col(item), F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, item, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


UPSERT = "path string, event string, hash string, version long"


def _apply(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old, version = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for h in rows["hash"]:
        if h is None or h != h:
            if old is not None:
                version += 1
                out.append((key[0], "removed", None, version))
            old = None
        elif h != old:
            version += 1
            out.append((key[0], "patched", h, version))
            old = h
    state.update((old, version))
    yield pd.DataFrame(out, columns=["path", "event", "hash", "version"])


def upserts(changes: DataFrame) -> DataFrame:
    """(path, event, hash, version) of a stream of changes (path, seq, hash): a known hash is no event, a null
    hash removes. State is one hash and counter per path."""
    return changes.groupBy("path").applyInPandasWithState(_apply, UPSERT, "hash string, version long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into the shared folder, and reads the result."""
    folder = os.path.join(shared_dir(stream), f"stream-{uuid.uuid4().hex}")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def on_graph_change(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Calls `rebuild(batch, id)` for every batch of changes, exactly once per checkpoint."""
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
