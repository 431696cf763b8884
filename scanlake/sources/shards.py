"""A data source for detector files: ``spark.read.format("scan_shards").load(folder)``.

A shard is a file ``*.shard``: a line of JSON (dataset_id, first frame, frames, det_shape, dtype) and then, for each
frame, its compressed length (4 bytes, big-endian) and bytes. A folder may hold many datasets. Each shard is an
input partition; the driver reads their names only.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bitshuffle import compress, decompress

SCHEMA = "dataset_id string, frame_idx int, counts array<int>"


def write_shard(path: str, frames: np.ndarray, dataset_id: str = "scan", first: int = 0) -> None:
    """frames: (n, rows, cols) of unsigned integers."""
    head = {"dataset_id": dataset_id, "first": first, "frames": len(frames), "det_shape": list(frames.shape[1:]), "dtype": frames.dtype.name}
    with open(path, "wb") as f:
        f.write(json.dumps(head).encode() + b"\n")
        for frame in frames:
            packed = compress(frame)
            f.write(struct.pack(">I", len(packed)) + packed)


def read_header(path: str) -> dict:
    with open(path, "rb") as f:
        return json.loads(f.readline())


def read_frames(path: str, only: range | None = None) -> Iterator[tuple[str, int, np.ndarray]]:
    """Frames of a shard; those that are not asked for are stepped over without being decoded."""
    with open(path, "rb") as f:
        head = json.loads(f.readline())
        for i in range(head["first"], head["first"] + head["frames"]):
            size = f.read(4)
            if len(size) < 4:
                raise ValueError(f"{path} ends before frame {i}")
            (n,) = struct.unpack(">I", size)
            if only is not None and i not in only:
                f.seek(n, 1)
                continue
            yield head["dataset_id"], i, decompress(f.read(n), head["dtype"])


class _Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        first, last = options.get("firstframe"), options.get("lastframe")
        self.only = None if first is None and last is None else range(int(first or 0), int(last) + 1 if last is not None else 1 << 31)

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".shard"))
        if not names:
            raise FileNotFoundError(f"no shards in {self.folder}")
        return [_Shard(os.path.join(self.folder, n)) for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(c) for *_, c in rows)])
            counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([c.astype(np.int32) for *_, c in rows])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), counts], names=["dataset_id", "frame_idx", "counts"])

        for row in read_frames(partition.path, self.only):
            rows.append(row)
            if sum(len(c) for *_, c in rows) >= 1 << 20:
                yield batch()
                rows = []
        if rows:
            yield batch()


class ShardSource(DataSource):
    """Options: path, firstFrame, lastFrame."""

    @classmethod
    def name(cls) -> str:
        return "scan_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShardReader({k.lower(): v for k, v in self.options.items()})


def register(spark) -> None:
    spark.dataSource.register(ShardSource)
