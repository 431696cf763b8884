"""Loading and saving scans as Parquet, with metadata, readiness and source signatures.

A scan's folder holds ``frames`` (Parquet, sorted by frame) and ``meta`` (one row). Paths go through Spark, so any
store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import binning, select
from ..plans.model import Scan, square_shape

#: Frames in one file at most, as the acquisition software writes them.
FRAMES_PER_FILE = 32768
DTYPES = {"u8": 255, "u16": 65535, "u32": (1 << 32) - 1, "u4": 15}
_META = "scan_rows int, scan_cols int, det_rows int, det_cols int, dtype string, semiangle_mrad double, voltage_kV double, scan_step_A double, extra string, tail int"


def save(scan: Scan, path: str, dtype: str = "u16", extra: dict | None = None, mode: str = "errorifexists", codec: str = "zstd") -> None:
    """Frames in order, cut to the type's range. Range-partitioned by frame, so that sparse reads skip row groups."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown type {dtype!r}; there are {', '.join(DTYPES)}")
    top = DTYPES[dtype]
    frames = scan.frames.withColumn("counts", F.transform("counts", lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(top)).cast("long" if dtype == "u32" else "int")))
    frames.repartitionByRange("dataset_id", "frame_idx").sortWithinPartitions("dataset_id", "frame_idx").write.mode(mode).option("maxRecordsPerFile", FRAMES_PER_FILE).option("compression", codec).parquet(f"{path}/frames")
    meta = [(*scan.scan_shape, *scan.det_shape, dtype, scan.semiangle_mrad, scan.voltage_kV, scan.scan_step_A, json.dumps(extra or {}), scan.tail)]
    scan.frames.sparkSession.createDataFrame(meta, _META).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def metadata(spark: SparkSession, path: str) -> dict:
    """The scan's row of metadata, with what follows from it."""
    m = spark.read.schema(_META).parquet(f"{path}/meta").first().asDict()
    m |= json.loads(m.pop("extra") or "{}") | {"tail": m["tail"] or 0}
    step = m["scan_step_A"]
    return m | {"frames": m["scan_rows"] * m["scan_cols"], "field_of_view_A": None if step is None else (m["scan_rows"] * step, m["scan_cols"] * step)}


def load(
    spark: SparkSession,
    path: str,
    scan_region: select.Region | None = None,
    detector_region: select.Region | None = None,
    scan_indices: Sequence | None = None,
    random_positions: int | None = None,
    seed: int | None = None,
    det_bin: int = 1,
    dtype: str = "native",
    bad: DataFrame | None = None,
) -> Scan:
    """A scan, or a part of it. At most one of scan_region, scan_indices and random_positions; a detector region goes
    with a scan region only. Regions are filters on columns, which Parquet takes up."""
    if sum(x is not None for x in (scan_region, scan_indices, random_positions)) > 1:
        raise ValueError("give one of scan_region, scan_indices and random_positions")
    if detector_region is not None and scan_region is None:
        raise ValueError("a detector region needs a scan region")
    m = metadata(spark, path)
    frames = spark.read.parquet(f"{path}/frames")
    scan = Scan(frames, (m["scan_rows"], m["scan_cols"]), (m["det_rows"], m["det_cols"]), m["semiangle_mrad"], m["voltage_kV"], m["scan_step_A"], m["tail"])
    if scan_region is not None:
        scan = select.scan_crop(scan, scan_region)
    if detector_region is not None:
        scan = select.detector_crop(scan, detector_region)
    if random_positions is not None:
        scan_indices = select.random_scan_indices(random_positions, scan.scan_shape, seed=seed)[0]
    if scan_indices is not None:
        request = select.requested(spark, scan_indices, scan.scan_shape)
        found = select.sparse_frames(scan.frames, request)
        scan = scan.with_frames(found.withColumn("frame_idx", F.col("req_pos")).drop("req_pos"), scan_shape=(len(scan_indices), 1), tail=0)
    if bad is not None or det_bin > 1:
        pixels = scan.pixels() if bad is None else select.zero_bad_pixels(scan.pixels(), bad)
        shape = dict(zip(("det_row", "det_col"), scan.det_shape, strict=True))
        binned = binning.bin_pixels(pixels.withColumn("dataset_id", F.coalesce("dataset_id", F.lit("scan"))), det_bin, shape)
        rows = binned.groupBy("dataset_id", "scan_row", "scan_col").agg(F.transform(F.sort_array(F.collect_list(F.struct("det_row", "det_col", "n"))), lambda x: x["n"]).alias("counts"))  # a detector's pixels
        at = rows.select("dataset_id", (F.col("scan_row") * scan.scan_shape[1] + F.col("scan_col")).cast("int").alias("frame_idx"), "scan_row", "scan_col", "counts")
        if scan_indices is not None:
            raise ValueError("binning goes with regions, not with single positions")
        scan = scan.with_frames(at, det_shape=tuple(n // det_bin for n in scan.det_shape))
    return scan.with_frames(narrowed(scan.frames, dtype))


def narrowed(frames: DataFrame, dtype: str) -> DataFrame:
    """Counts cut to a type; native leaves them, auto takes the narrowest that loses nothing (from the exact maximum)."""
    if dtype == "native":
        return frames
    if dtype == "auto":
        most = frames.agg(F.max(F.array_max("counts"))).first()[0] or 0
        dtype = "u8" if most <= 255 else "u16" if most <= 65535 else "u32"
    if dtype not in DTYPES:
        raise ValueError(f"unknown type {dtype!r}")
    return frames.withColumn("counts", F.transform("counts", lambda c: F.least(c, F.lit(DTYPES[dtype])).cast("long" if dtype == "u32" else "int")))


def load_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Frames of several scans, each with its path as dataset_id; shapes have to agree."""
    shapes = {(m["det_rows"], m["det_cols"]) for m in (metadata(spark, p) for p in paths)}
    if len(shapes) > 1:
        raise ValueError(f"detectors differ: {sorted(shapes)}")
    out = None
    for p in paths:
        one = spark.read.parquet(f"{p}/frames").withColumn("dataset_id", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


# ---- metadata of microscopes

def emd_metadata(blob: Column) -> dict[str, Column]:
    """Of a JSON text: magnification, field of view (nm, from m), voltage (kV, from V), semi-angle (mrad, from rad);
    null where the text has none, or is no JSON."""
    at = lambda path: F.get_json_object(blob, path).cast("double")
    return {
        "magnification": at("$.CustomProperties.StemMagnification.value"), "field_of_view_nm": at("$.Scan.ScanSize.width") * 1e9, "voltage_kV": at("$.Optics.AccelerationVoltage") / 1000,
        "semiangle_mrad": at("$.Optics.BeamConvergence") * 1000,
    }


def emd_sibling(path: str, names: Sequence[str]) -> str | None:
    """Among the folder's names: the one with the scan's stem, else the only one."""
    stem = os.path.splitext(os.path.basename(path))[0].removesuffix("_master")
    found = [n for n in names if n.endswith(".emd")]
    return next((n for n in found if n == f"{stem}.emd"), found[0] if len(found) == 1 else None)


def pixel_mask(spark: SparkSession, mask: Sequence[Sequence[int]]) -> DataFrame:
    """Dead pixels (above 0) as det_row, det_col."""
    return spark.createDataFrame([(r, c) for r, row in enumerate(mask) for c, v in enumerate(row) if v > 0], "det_row int, det_col int")


# ---- readiness

def readiness(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """frames: dataset_id, frame_idx, counts; expected: dataset_id, expected. For each dataset: frames found, whether it is
    ready, and why not: too few or too many frames, repeated ones, or detectors of different size."""
    found = frames.groupBy("dataset_id").agg(F.count("*").alias("n"), F.countDistinct("frame_idx").alias("distinct"), F.min(F.size("counts")).alias("least"), F.max(F.size("counts")).alias("most"))
    both = expected.join(found, "dataset_id", "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "no frames").when(F.col("least") != F.col("most"), "detector sizes differ").when(F.col("distinct") != n, "repeated frames").when(n < F.col("expected"), "incomplete").when(n > F.col("expected"), "too many frames")
    return both.select("dataset_id", "expected", n.alias("found"), reason.isNull().alias("ready"), reason.alias("reason"))


def discover(spark: SparkSession, folder: str, pattern: str = "*", frames: int | None = None) -> list[str]:
    """Scans in a folder (folders with ``meta``), sorted; only those of so many frames if that is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    found = files.select(F.regexp_extract("path", r"^(.*)/meta/[^/]+$", 1).alias("p")).where("p <> ''").distinct()
    like = "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in pattern) + "$"
    names = sorted(r[0] for r in found.where(F.rlike(F.regexp_extract("p", r"([^/]+)$", 1), F.lit(like))).collect())  # a row for each scan
    if frames is not None:
        names = [n for n in names if sum(metadata(spark, n)[k] for k in ("frames", "tail")) == frames]
    if not names:
        raise FileNotFoundError(f"no scans like {pattern} in {folder}")
    return names


def inspect(spark: SparkSession, path: str) -> dict:
    """Metadata and readiness, without reading counts; notices files that change meanwhile."""
    before = signature(spark, path)
    m = metadata(spark, path)
    n = spark.read.parquet(f"{path}/frames").count()  # from the file footers
    expected = m["frames"] + m["tail"]
    ready = n == expected and signature(spark, path) == before
    return m | {"found": n, "ready": ready, "reason": None if ready else "incomplete" if n < expected else "too many frames" if n > expected else "changing", "signature": before}


def is_ready(spark: SparkSession, path: str) -> bool:
    return inspect(spark, path)["ready"]


def signature(spark: SparkSession, path: str) -> str:
    """Of the files' names, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    rows = files.select("path", "length", "modificationTime").orderBy("path").collect()  # a row for each file, without content
    return hashlib.sha256(json.dumps([list(map(str, r)) for r in rows]).encode()).hexdigest()


def scan_of(frames: DataFrame, det_shape: tuple[int, int], scan_shape: tuple[int, int] | None = None, order: str = "row-major") -> Scan:
    """Frames (dataset_id, frame_idx, counts) as a scan; a square one if no shape is given."""
    shape = scan_shape or square_shape(frames.count())
    row, col = select.position_of(F.col("frame_idx"), shape[1], order)
    return Scan(frames.select("dataset_id", "frame_idx", row.alias("scan_row"), col.alias("scan_col"), "counts"), shape, det_shape)
