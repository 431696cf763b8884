"""Live acquisitions: frames that arrive in a folder, datasets that become ready, and running products.

The file source's checkpoint makes sure that each file is taken once. Readiness is a state for each dataset
(frames seen, when they last changed); a dataset is reported once, when it is complete and, if asked, has
rested for a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES = "dataset_id string, frame_idx int, scan_row int, scan_col int, counts array<int>"


def arriving(spark: SparkSession, folder: str, schema: str = FRAMES, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def ready_datasets(frames: DataFrame, expected: int, rest_ms: int = 0) -> DataFrame:
    """dataset_id, n_frames of the datasets that got their expected distinct frames; each once. rest_ms: so long no
    frame may come after the last one."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the frames seen are a bit set of the expected size, kept as text of a hexadecimal number
        seen, done = (int(state.get[0], 16), state.get[1]) if state.exists else (0, False)
        if state.hasTimedOut:
            report = seen.bit_count() >= expected and not done
        else:
            for pdf in parts:
                for i in pdf["frame_idx"]:
                    seen |= 1 << int(i)
            report = rest_ms == 0 and seen.bit_count() >= expected and not done
        state.update((f"{seen:x}", done or report))
        if rest_ms and not (done or report):
            state.setTimeoutDuration(rest_ms)
        if report:
            yield pd.DataFrame({"dataset_id": [key[0]], "n_frames": [seen.bit_count()]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if rest_ms else GroupStateTimeout.NoTimeout
    return frames.select("dataset_id", "frame_idx").groupBy("dataset_id").applyInPandasWithState(step, "dataset_id string, n_frames long", "seen string, done boolean", "update", timeout)


def running_products(frames: DataFrame) -> DataFrame:
    """Frames and counts so far, by dataset."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    return frames.groupBy("dataset_id").agg(F.count("*").alias("n_frames"), F.sum(total).alias("total"))


def poll(frames: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes what is there now, once, and returns."""
    frames.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def watch(frames: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], seconds: float = 2.0, mode: str = "append") -> StreamingQuery:
    """Looks every few seconds until the query is stopped."""
    return frames.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(sink).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch under its number, so that a batch that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def stop(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()
