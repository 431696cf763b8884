"""Selections: crops, sparse positions, regions of interest, dead pixels, and the index arithmetic between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.model import Scan

Region = tuple[int, int, int, int]  # rows r0 to r1, columns c0 to c1, the ends excluded


def check_region(region: Region, shape: tuple[int, int]) -> Region:
    r0, r1, c0, c1 = region
    if not (0 <= r0 < r1 <= shape[0] and 0 <= c0 < c1 <= shape[1]):
        raise ValueError(f"region {region} is not within {shape}")
    return region


def scan_crop(scan: Scan, region: Region) -> Scan:
    """Frames of a scan region; a filter on plain columns, which file scans take up. Indices start anew."""
    r0, r1, c0, c1 = check_region(region, scan.scan_shape)
    inside = scan.frames.where((F.col("scan_row") >= r0) & (F.col("scan_row") < r1) & (F.col("scan_col") >= c0) & (F.col("scan_col") < c1))
    row, col = F.col("scan_row") - r0, F.col("scan_col") - c0
    frames = inside.select("dataset_id", (row * (c1 - c0) + col).cast("int").alias("frame_idx"), row.alias("scan_row"), col.alias("scan_col"), "counts")
    return scan.with_frames(frames, scan_shape=(r1 - r0, c1 - c0), tail=0)


def detector_crop(scan: Scan, region: Region) -> Scan:
    """The counts of a detector region, row-major, cut out of each frame's array without exploding it."""
    r0, r1, c0, c1 = check_region(region, scan.det_shape)
    rows = F.transform(F.sequence(F.lit(r0), F.lit(r1 - 1)), lambda r: F.slice("counts", r * scan.det_shape[1] + c0 + 1, F.lit(c1 - c0)))
    return scan.with_frames(scan.frames.withColumn("counts", F.flatten(rows)), det_shape=(r1 - r0, c1 - c0))


def series_crop(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Frames of several datasets, each within its own regions (dataset_id, r0, r1, c0, c1)."""
    r = regions.alias("r")
    inside = (F.col("f.dataset_id") == F.col("r.dataset_id")) & (F.col("scan_row") >= F.col("r0")) & (F.col("scan_row") < F.col("r1")) & (F.col("scan_col") >= F.col("c0")) & (F.col("scan_col") < F.col("c1"))
    return frames.alias("f").join(r, inside).select("f.*", "r0", "c0")


def position_of(frame_idx: Column, scan_cols: int, order: str = "row-major") -> tuple[Column, Column]:
    """Scan row and column of a recorded frame. Serpentine scans run backwards in odd rows."""
    if order not in ("row-major", "raster", "serpentine", "snake", "boustrophedon"):
        raise ValueError(f"unknown scan order {order!r}")
    row, col = F.floor(frame_idx / scan_cols).cast("int"), (frame_idx % scan_cols).cast("int")
    if order in ("row-major", "raster"):
        return row, col
    return row, F.when(row % 2 == 1, scan_cols - 1 - col).otherwise(col).cast("int")


def index_of(row: Column, col: Column, scan_cols: int, order: str = "row-major") -> Column:
    """The recorded frame of a scan position; the inverse of position_of."""
    if order in ("serpentine", "snake", "boustrophedon"):
        col = F.when(row % 2 == 1, scan_cols - 1 - col).otherwise(col)
    elif order not in ("row-major", "raster"):
        raise ValueError(f"unknown scan order {order!r}")
    return (row * scan_cols + col).cast("int")


def region_indices(spark: SparkSession, region: Region, scan_shape: tuple[int, int], order: str = "row-major") -> DataFrame:
    """req_pos, frame_idx of the frames in a region, row by row."""
    r0, r1, c0, c1 = check_region(region, scan_shape)
    at = spark.range((r1 - r0) * (c1 - c0)).select(F.col("id").cast("int").alias("req_pos"))
    row, col = F.floor(F.col("req_pos") / (c1 - c0)) + r0, F.col("req_pos") % (c1 - c0) + c0
    return at.select("req_pos", index_of(row, col, scan_shape[1], order).alias("frame_idx"))


def requested(spark: SparkSession, indices: Sequence, scan_shape: tuple[int, int]) -> DataFrame:
    """req_pos, frame_idx of flat indices or of (row, column) pairs, in the order asked for, repeats included."""
    flat = [int(i) if np.ndim(i) == 0 else int(i[0]) * scan_shape[1] + int(i[1]) for i in indices]
    n = scan_shape[0] * scan_shape[1]
    if any(not 0 <= i < n for i in flat) or any(np.ndim(i) and not 0 <= i[1] < scan_shape[1] for i in indices):
        raise ValueError(f"an index is not within {scan_shape}")
    return spark.createDataFrame(list(enumerate(flat)), "req_pos int, frame_idx int")


def sparse_frames(frames: DataFrame, request: DataFrame) -> DataFrame:
    """The frames asked for; repeated requests give repeated frames. Joins on dataset_id too where the request has it."""
    on = ["frame_idx"] + (["dataset_id"] if "dataset_id" in request.columns else [])
    return request.join(frames, on).select("req_pos", *frames.columns)


def random_scan_indices(n: int, scan_shape: tuple[int, int], n_files: int = 1, seed: int | None = None, replace: bool = False, same_for_all_files: bool = True) -> list[list[int]]:
    """Positions for each file, drawn by NumPy's default generator."""
    total = scan_shape[0] * scan_shape[1]
    if n < 1 or (n > total and not replace):
        raise ValueError(f"{n} positions can't be drawn from {total}")
    rng = np.random.default_rng(seed)
    draw = lambda: rng.choice(total, size=n, replace=replace).tolist()
    first = draw()
    return [first if same_for_all_files or i == 0 else draw() for i in range(n_files)]


def frame(frames: DataFrame, index: int) -> DataFrame:
    return frames.where(F.col("frame_idx") == index)


def selected_position(row: int, col: int, scan_shape: tuple[int, int]) -> int:
    """The frame of a position that is moved into the scan if it lies outside."""
    return min(max(row, 0), scan_shape[0] - 1) * scan_shape[1] + min(max(col, 0), scan_shape[1] - 1)


def zero_bad_pixels(pixels: DataFrame, bad: DataFrame) -> DataFrame:
    """bad: det_row, det_col of dead pixels, at most as many as the detector has. Their counts become 0."""
    flagged = pixels.join(F.broadcast(bad.select("det_row", "det_col").distinct().withColumn("_bad", F.lit(True))), ["det_row", "det_col"], "left")
    return flagged.withColumn("n", F.when(F.col("_bad"), F.lit(0).cast("long")).otherwise(F.col("n"))).drop("_bad").select(pixels.columns)


def roi(row: Column, col: Column, kind: str, center: tuple[float, float] = (0, 0), radius: float = 0, inner: float = 0, half: tuple[float, float] | None = None) -> Column:
    """Whether a pixel lies in a region of interest: circle, annular, square, rect or point.

    Circles and rings compare exact squares; squares and rectangles include their edges."""
    dr, dc = row - center[0], col - center[1]
    d2 = dr * dr + dc * dc
    if kind == "circle":
        return d2 <= radius * radius
    if kind == "annular":
        return (d2 >= inner * inner) & (d2 <= radius * radius)
    if kind == "square":
        return (F.abs(dr) <= radius) & (F.abs(dc) <= radius)
    if kind == "rect":
        return (F.abs(dr) <= half[0]) & (F.abs(dc) <= half[1])
    if kind == "point":
        return (F.round(dr) == 0) & (F.round(dc) == 0)
    raise ValueError(f"unknown region {kind!r}")


def bf_columns(pixels: DataFrame, bf: DataFrame) -> DataFrame:
    """bf: bf_idx, det_row, det_col. The counts of those pixels as one scan-shaped column each: bf_idx, scan_row, scan_col, n."""
    return pixels.join(F.broadcast(bf), ["det_row", "det_col"]).select("bf_idx", "scan_row", "scan_col", "n")


def bf_subset(bf: DataFrame, ratio: float) -> DataFrame:
    """Every k-th bright-field pixel, k = round(1 / ratio)."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio lies between 0 and 1")
    return bf.where(F.col("bf_idx") % max(1, round(1 / ratio)) == 0)
