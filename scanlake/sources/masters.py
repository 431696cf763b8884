"""Detector masters: an HDF5 file with metadata and links to shards ``<stem>_data_NNNNNN.h5`` of compressed frames.

``spark.read.format("scan_hdf5").load(master)`` gives frames, one input partition for a run of frames in a shard. The
folder has to be mounted on every machine, as HDF5 files are read by position.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.model import Scan
from .frames import pixel_mask, scan_of
from .hdf5 import File, Writer

DETECTOR = "entry/instrument/detector"
#: Frames of one input partition, and of one shard written.
PART_FRAMES, SHARD_FRAMES = 4096, 32768


def shards(master: str) -> list[tuple[str, str]]:
    """File and path of the frames, in order: linked shards, shards by name, or data within the master."""
    stem, folder = os.path.basename(master).removesuffix(".h5").removesuffix("_master"), os.path.dirname(master)
    with File(master) as f:
        keys = f.keys("entry/data")
        found = []
        for k in (k for k in keys if k.startswith("data_")):
            link = f.external(f"entry/data/{k}")
            if link is None:
                named = os.path.join(folder, f"{stem}_data_{k.split('_')[-1]}.h5")
                found.append((named, "entry/data/data") if os.path.exists(named) else (master, f"entry/data/{k}"))
            else:
                found.append((os.path.join(folder, link.file), link.path))
        if not found and "data" in keys:
            found = [(master, "entry/data/data")]
    if not found:
        raise ValueError(f"{master} names no frames")
    missing = [p for p, _ in found if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"missing shards: {', '.join(map(os.path.basename, missing))}")
    return found


def metadata(master: str) -> dict:
    """Values of at most 100 elements by path, and what follows from them (None where it doesn't)."""
    out: dict = {}
    with File(master) as f:
        for path in f.walk():
            d = f.dataset(path)
            if math.prod(d.shape) <= 100:
                v = d.read()
                v = v.astype(str) if v.dtype.kind == "S" else v
                out[path] = v.tolist()
    at = lambda name: out.get(f"{DETECTOR}/{name}")
    n = at("detectorSpecific/ntrigger")
    side = math.isqrt(n) if n is not None else 0
    y, x = at("detectorSpecific/y_pixels_in_detector"), at("detectorSpecific/x_pixels_in_detector")
    return out | {
        "n_frames": n, "scan_shape": (side, side) if n is not None and side * side == n else None, "dwell_time_us": None if at("frame_time") is None else at("frame_time") * 1e6,
        "detector_shape": None if y is None or x is None else (y, x), "detector_name": at("description"), "saturation": at("saturation_value"),
    }


def read_mask(spark: SparkSession, master: str) -> DataFrame:
    """Dead pixels as det_row, det_col; none if the master has no mask."""
    for name in ("pixel_mask", "detectorSpecific/pixel_mask"):
        with File(master) as f:
            try:
                return pixel_mask(spark, f.dataset(f"{DETECTOR}/{name}").read().tolist())
            except KeyError:
                continue
    return pixel_mask(spark, [])


def inspect(master: str, scan_shape: tuple[int, int] | None = None, tail: int = 0) -> dict:
    """Readiness from headers alone: frames found and expected (tail: so many in a row after scan_shape), and a reason if it isn't ready."""
    try:
        before = [(p, os.stat(p).st_size, os.stat(p).st_mtime_ns) for p, _ in shards(master)]
        heads = []
        for p, path in shards(master):
            with File(p) as f:
                d = f.dataset(path)
                heads.append((d.shape, d.dtype))
        meta = metadata(master)
    except (OSError, ValueError, KeyError) as wrong:
        return {"ready": False, "reason": str(wrong), "found": 0, "expected": None}
    found = sum(s[0] for s, _ in heads)
    expected = scan_shape[0] * scan_shape[1] + tail if scan_shape else meta["n_frames"]
    after = [(p, os.stat(p).st_size, os.stat(p).st_mtime_ns) for p, _ in shards(master)]
    reason = (
        "shards differ in shape or type" if len({(s[1:], t) for s, t in heads}) > 1
        else "files are changing" if before != after
        else "incomplete" if expected is not None and found < expected
        else "too many frames" if expected is not None and found > expected
        else None
    )
    return {"ready": reason is None, "reason": reason, "found": found, "expected": expected, "det_shape": heads[0][0][1:], "dtype": heads[0][1].name, "metadata": meta}


class _Run(InputPartition):
    def __init__(self, path: str, dataset: str, start: int, stop: int, first: int):
        super().__init__(path)
        self.path, self.dataset, self.start, self.stop, self.first = path, dataset, start, stop, first


class MasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.master = options["path"]
        self.name = os.path.basename(self.master).removesuffix(".h5").removesuffix("_master")
        self.first, self.last = int(options.get("firstframe", 0)), int(options.get("lastframe", 1 << 40))

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for path, dataset in shards(self.master):
            with File(path) as f:
                n = f.dataset(dataset).shape[0]
            for a in range(0, n, PART_FRAMES):
                b = min(a + PART_FRAMES, n)
                if first + a <= self.last and first + b > self.first:
                    out.append(_Run(path, dataset, a, b, first))
            first += n
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            ends = np.arange(len(rows) + 1, dtype=np.int32) * rows[0][1].size
            wide = np.int32 if rows[0][1].dtype.itemsize < 4 else np.int64
            counts = pa.array(np.concatenate([c.ravel() for _, c in rows]).astype(wide)).cast(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([self.name] * len(rows)), pa.array([i for i, _ in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), counts)], names=["dataset_id", "frame_idx", "counts"])

        with File(part.path) as f:
            d = f.dataset(part.dataset)
            for i, frame in self._frames(d, part):
                rows.append((part.first + i, frame))
                if len(rows) * frame.size >= 1 << 20:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    def _frames(self, d, part: _Run) -> Iterator[tuple[int, np.ndarray]]:
        """Frames of the run that are asked for; chunks outside it are not read."""
        wanted = range(max(part.start, self.first - part.first), min(part.stop, self.last + 1 - part.first))
        if d.layout[1] != 2 or d.chunk_shape[1:] != d.shape[1:]:
            whole = d.read()
            yield from ((i, whole[i]) for i in wanted)
            return
        depth = d.chunk_shape[0]
        for offset, at, size, mask in sorted(d.places()):
            if offset[0] + depth <= wanted.start or offset[0] >= wanted.stop:
                continue
            for i, frame in enumerate(d.decoded(d.file.at(at, size), mask), offset[0]):
                if i in wanted:
                    yield i, frame


class MasterSource(DataSource):
    """Options: path (of the master), firstFrame, lastFrame."""

    @classmethod
    def name(cls) -> str:
        return "scan_hdf5"

    def schema(self) -> str:
        return "dataset_id string, frame_idx int, counts array<int>"

    def reader(self, schema) -> DataSourceReader:
        return MasterReader({k.lower(): v for k, v in self.options.items()})


def load(spark: SparkSession, master: str, scan_shape: tuple[int, int] | None = None, order: str = "row-major", tail: int = 0) -> Scan:
    """tail: frames of a last row that is incomplete, as in Scan; it goes with a scan_shape."""
    spark.dataSource.register(MasterSource)
    state = inspect(master, scan_shape, tail)
    if not state["ready"]:
        raise ValueError(f"{master} is not ready: {state['reason']}")
    frames = spark.read.format("scan_hdf5").load(master)
    shape = scan_shape or state["metadata"]["scan_shape"] or (state["found"], 1)
    return replace(scan_of(frames, tuple(state["det_shape"]), shape, order), tail=tail if scan_shape else 0)


def save(path: str, frames: Sequence[np.ndarray] | np.ndarray, mask: np.ndarray | None = None, frame_time: float | None = None, per_shard: int = SHARD_FRAMES) -> str:
    """Writes a master and its shards beside it (path without ending); for frames that are at hand, as from acquisition."""
    frames = np.asarray(frames)
    for k, a in enumerate(range(0, len(frames), per_shard), 1):
        _save_shard(path, k, frames[a : a + per_shard])
    return _save_master(path, frames.shape, mask, frame_time, per_shard)


def save_scan(path: str, scan: Scan, mask: np.ndarray | None = None, frame_time: float | None = None, per_shard: int = SHARD_FRAMES) -> str:
    """The same from a table of frames (16 bits a count) that are numbered from 0: each shard is written by a task, in a folder that all
    machines see; the driver gets a row for each shard."""
    det_shape = scan.det_shape

    def run(shard: pa.Table) -> pa.Table:
        k, order = shard.column("shard")[0].as_py(), np.argsort(shard.column("frame_idx").to_numpy())
        at, counts = shard.column("frame_idx").to_numpy()[order], shard.column("counts").combine_chunks()
        if (at != np.arange(len(at)) + k * per_shard).any():
            raise ValueError(f"frames of shard {k + 1} are not numbered one by one")
        flat = counts.flatten().to_numpy(zero_copy_only=False)
        if flat.size != len(at) * math.prod(det_shape) or (flat.size and not 0 <= flat.min() <= flat.max() < 1 << 16):
            raise ValueError(f"frames of shard {k + 1} don't have {det_shape} counts of 16 bits")
        _save_shard(path, k + 1, flat.reshape(-1, *det_shape)[order].astype(np.uint16))
        return pa.table({"shard": [k], "n": [len(at)]})

    rows = scan.frames.select(F.floor(F.col("frame_idx") / per_shard).alias("shard"), "frame_idx", "counts")
    found = sorted(map(tuple, rows.groupBy("shard").applyInArrow(run, "shard long, n long").collect()))
    if any(k != i or (n != per_shard and i + 1 < len(found)) for i, (k, n) in enumerate(found)):
        raise ValueError("frames are not numbered one by one")
    return _save_master(path, (sum(n for _, n in found), *det_shape), mask, frame_time, per_shard)


def _shard_name(path: str, k: int) -> str:
    return f"{os.path.basename(path)}_data_{k:06d}.h5"


def _save_shard(path: str, k: int, frames: np.ndarray) -> None:
    """Under its name once it is whole, as a task may run twice."""
    at = os.path.join(os.path.dirname(path), _shard_name(path, k))
    shard = Writer(f"{at}.{uuid.uuid4().hex}")
    shard.add("entry/data/data", frames, packed=True)
    shard.close()
    os.replace(shard.path, at)


def _save_master(path: str, shape: tuple[int, ...], mask: np.ndarray | None, frame_time: float | None, per_shard: int) -> str:
    master = Writer(f"{path}_master.h5")
    for k in range(1, math.ceil(shape[0] / per_shard) + 1):
        master.link(f"entry/data/data_{k:06d}", _shard_name(path, k), "entry/data/data")
    specific = f"{DETECTOR}/detectorSpecific"
    for name, v in (("ntrigger", shape[0]), ("y_pixels_in_detector", shape[1]), ("x_pixels_in_detector", shape[2])):
        master.add(f"{specific}/{name}", np.array(v, np.int64))
    if frame_time is not None:
        master.add(f"{DETECTOR}/frame_time", np.array(frame_time, np.float64))
    if mask is not None:
        master.add(f"{DETECTOR}/pixel_mask", np.asarray(mask, np.uint8))
    master.close()
    return f"{path}_master.h5"
