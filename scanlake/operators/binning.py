"""Types, binning, resampling and drift."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.model import Scan

# ---- types


def clip_u8(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts as 0 to 255, and how many were cut (one row)."""
    return pixels.withColumn("n", F.least(F.col("n"), F.lit(255))), pixels.agg(F.count_if(F.col("n") > 255).alias("clipped"))


def value_range(pixels: DataFrame) -> DataFrame:
    """least, most, over_u8, over_u16 and the narrowest lossless type of the counts; exact, over all of them."""
    out = pixels.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") > 255).alias("over_u8"), F.count_if(F.col("n") > 65535).alias("over_u16"))
    return out.withColumn("dtype", F.when(F.col("most") <= 255, "u8").when(F.col("most") <= 65535, "u16").otherwise("u32"))


def check_sums(pixels: DataFrame, det_pixels: int) -> None:
    """Raises if a sum over a frame or over all frames could pass 2^63."""
    most, frames = pixels.agg(F.max("n"), F.count("*")).first()
    if (most or 0) * max(frames, det_pixels) >= 1 << 63:
        raise OverflowError(f"sums of counts up to {most} don't fit")


def pack_uint4(values: np.ndarray) -> bytes:
    """Two counts of 0 to 15 in a byte, the first in the low half; an odd last one stands alone."""
    values = np.asarray(values)
    if values.size and (values.min() < 0 or values.max() > 15):
        raise ValueError("four bits hold 0 to 15")
    flat = np.pad(values.astype(np.uint8).ravel(), (0, values.size % 2))
    return (flat[::2] | flat[1::2] << 4).tobytes()


def unpack_uint4(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if n > 2 * len(raw):
        raise ValueError("there are fewer counts than asked for")
    return np.stack([raw & 15, raw >> 4], 1).ravel()[:n]


def pack_counts(counts: Column) -> Column:
    """An array column of 0 to 15 as hexadecimal digits packed two to a byte, low half first, on the JVM."""
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.size(counts) - 1, F.lit(0))), lambda i: i % 2 == 0)
    pairs = F.transform(first, lambda i: F.lpad(F.hex(counts[i] + 16 * F.coalesce(F.get(counts, i + 1), F.lit(0))), 2, "0"))
    return F.when(F.size(counts) > 0, F.unhex(F.array_join(pairs, ""))).otherwise(F.unhex(F.lit("")))


def dequantize(v: Column, low: float, high: float) -> Column:
    """0 to 255 as values from low to high; a range that is empty or reversed is a constant."""
    low = low if np.isfinite(low) else 0.0
    high = high if np.isfinite(high) else low
    return v * F.lit((high - low) / 255 if high > low else 0.0) + F.lit(low)


def half_even(x: Column, least: int, most: int) -> Column:
    """Floats as integers for saving: rounded half to even, then cut to the type's range."""
    return F.least(F.greatest(F.rint(x), F.lit(least)), F.lit(most)).cast("long")


# ---- binning

def bin_pixels(pixels: DataFrame, factor: int, shape: dict[str, int | None], reduction: str = "sum", edge: str = "crop") -> DataFrame:
    """Sums or means of blocks along the axes in shape (column name: length). edge "crop" drops incomplete blocks,
    "partial" keeps them as if padded with zeros (sums only). An axis without a length (None) is not cropped: its last blocks are
    the sum or mean of what there is. Sums are long."""
    if factor < 1 or reduction not in ("sum", "mean") or edge not in ("crop", "partial"):
        raise ValueError("factor, reduction or edge is not valid")
    if edge == "partial" and reduction == "mean":
        raise ValueError("partial blocks have no mean")
    keys = [c for c in ("dataset_id", "scan_row", "scan_col", "det_row", "det_col") if c in pixels.columns]
    if edge == "crop":
        for axis, n in ((axis, n) for axis, n in shape.items() if n is not None):
            pixels = pixels.where(F.col(axis) < n // factor * factor)
    own = [F.floor(F.col(k) / factor).cast("int").alias(k) if k in shape else F.col(k) for k in keys]
    return pixels.groupBy(*own).agg((F.sum("n") if reduction == "sum" else F.avg("n")).alias("n"))


def bin_detector(scan: Scan, factor: int, bad: DataFrame | None = None) -> DataFrame:
    """What the loader's detector binning gives: dead pixels are zeroed first, incomplete blocks dropped."""
    from .select import zero_bad_pixels

    pixels = scan.pixels() if bad is None else zero_bad_pixels(scan.pixels(), bad)
    return bin_pixels(pixels, factor, {"det_row": scan.det_shape[0], "det_col": scan.det_shape[1]})


def bin_exact(scan: Scan, scan_factor: int, det_factor: int) -> DataFrame:
    """Scan and detector binned together, incomplete edge blocks kept, in one aggregation."""
    own = [F.floor(F.col(k) / f).cast("int").alias(k) for k, f in (("scan_row", scan_factor), ("scan_col", scan_factor), ("det_row", det_factor), ("det_col", det_factor))]
    return scan.pixels().groupBy(*own).agg(F.sum("n").alias("n"), F.count("*").alias("samples"))


def binned_sampling(sampling: float, length: int, factor: int) -> tuple[float, bool]:
    """The sampling after binning, and whether all blocks are complete (else it does not hold at the edge)."""
    return sampling * factor, length % factor == 0


# ---- resampling and drift

def resample_scan(pixels: DataFrame, scan_shape: tuple[int, int], target: tuple[int, int, int, int], shift: tuple[float, float] = (0.0, 0.0), origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """Frames at the positions of target (r0, r1, c0, c1), moved by shift: bilinear in scan space, per detector pixel.

    Each source frame gives its share to the targets that it is a corner of, so counts move once."""
    r0, r1, c0, c1 = target

    def corners(start: int, stop: int, moved: float, first: int, n: int, axis: str) -> list[tuple[int, int, float]]:
        out = []
        for t in range(start, stop):
            x = min(max(t + moved - first, 0.0), n - 1.001 if n > 1 else 0.0)
            a = int(x)
            out += [(t - start, a, 1 - (x - a)), (t - start, min(a + 1, n - 1), x - a)]
        return out

    spark = pixels.sparkSession
    rows = spark.createDataFrame(corners(r0, r1, shift[0], origin[0], scan_shape[0], "row"), "out_row int, scan_row int, row_weight double")
    cols = spark.createDataFrame(corners(c0, c1, shift[1], origin[1], scan_shape[1], "col"), "out_col int, scan_col int, col_weight double")
    weighted = pixels.join(F.broadcast(rows), "scan_row").join(F.broadcast(cols), "scan_col")  # two rows for each scan row, and column
    value = F.sum(F.col("n") * F.col("row_weight") * F.col("col_weight"))
    return weighted.groupBy(F.col("out_row").alias("scan_row"), F.col("out_col").alias("scan_col"), "det_row", "det_col").agg(value.alias("value"))


def drifted_positions(frames: DataFrame, drift: DataFrame) -> DataFrame:
    """drift: scan_row, scan_col, d_row, d_col. Nominal positions plus the field there; patterns are untouched."""
    found = frames.select("frame_idx", "scan_row", "scan_col").join(drift, ["scan_row", "scan_col"], "left")
    at = lambda c, d: F.col(c) + F.coalesce(F.col(d), F.lit(0.0))
    return found.select("frame_idx", "scan_row", "scan_col", at("scan_row", "d_row").alias("row"), at("scan_col", "d_col").alias("col"))
