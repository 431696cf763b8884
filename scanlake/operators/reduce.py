"""Reductions over the detector and over the scan, and virtual detectors.

Products of frames are sums of counts times weights. Of a Scan they are made in one vectorised pass over the frames'
arrays, a matrix product for each batch, without a row for each count and without a shuffle; of a table of pixels (after binning,
selection or correction) in one aggregation. Sums over the scan keep an array for each task. Where rows have a
dataset_id, no result mixes datasets; what fits one probe or rotation to a scan refuses several.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.model import Scan

KEYS = ["frame_idx", "scan_row", "scan_col"]


def dataset_of(rows: DataFrame) -> list[str]:
    return ["dataset_id"] if "dataset_id" in rows.columns else []


def keys_of(rows: DataFrame) -> list[str]:
    """The columns that name a frame."""
    return [c for c in ("dataset_id", *KEYS) if c in rows.columns]


def one_dataset(rows: DataFrame) -> None:
    if dataset_of(rows) and rows.select("dataset_id").distinct().limit(2).count() > 1:
        raise ValueError("this is for one dataset; select one by its dataset_id")


def _matrix(counts: pa.Array, n: int) -> np.ndarray:
    """A row of counts for each frame."""
    flat = counts.flatten()
    if len(flat) != n * len(counts) or pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(counts), n)).as_py():
        raise ValueError(f"frames don't have {n} counts")
    return (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(-1, n)


def exact_product(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Integer matrix product, without rounding or wrapping."""
    most = int(np.abs(weights).sum(0).max(initial=0)) * max(int(counts.max(initial=0)), -int(counts.min(initial=0)))
    if most < 1 << 53:  # doubles hold all the sums
        by = np.ascontiguousarray(weights, np.float64)
        step = max(1, (1 << 18) // max(1, counts.shape[1]))  # few frames at a time, so that their doubles stay in the cache
        parts = [counts[a : a + step].astype(np.float64) @ by for a in range(0, len(counts), step)]
        return np.rint(np.concatenate(parts)).astype(np.int64) if parts else np.zeros((0, weights.shape[1]), np.int64)
    if most >= 1 << 63:
        raise OverflowError("sums of this scan may not fit 64 bits")
    return counts.astype(np.int64) @ weights


def frame_products(scan: Scan, weights: dict[str, Column]) -> DataFrame:
    """The frames' keys and, for each weight (an integer expression of det_row and det_col; null is 0), the exact sum of counts times weights.

    The weights are worked out on the detector and handed to the tasks: as many numbers as it has pixels. Frames without counts are left out."""
    h, w = scan.det_shape
    grid = scan.frames.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("det_row"), (F.col("id") % w).cast("int").alias("det_col"), "id")
    found = grid.select("id", *[F.coalesce(c.cast("long"), F.lit(0)).alias(name) for name, c in weights.items()]).toArrow()
    order = np.argsort(found.column("id").to_numpy())
    table = np.stack([found.column(name).to_numpy()[order] for name in weights], 1)
    keys, names = keys_of(scan.frames), list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = exact_product(_matrix(b.column(len(keys)), h * w), table)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(sums[:, i]) for i in range(sums.shape[1]))], names=[*keys, *names])

    frames = scan.frames.where("counts is not null").select(*keys, "counts")
    types = dict(frames.dtypes)
    return frames.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + [f"`{name}` long" for name in names]))


def sums_of(source: Scan | DataFrame, weights: dict[str, Column]) -> DataFrame:
    """frame_products of a scan, or the same of pixels."""
    if isinstance(source, Scan):
        return frame_products(source, weights)
    return source.groupBy(*keys_of(source)).agg(*[F.sum(F.col("n") * F.coalesce(c.cast("long"), F.lit(0))).alias(name) for name, c in weights.items()])


@dataclass(frozen=True)
class Probe:
    """The bright-field disk, in detector pixels."""

    row: float
    col: float
    radius: float


# ---- over the scan

def _task_sums(scan: Scan) -> DataFrame:
    """For each task and dataset the counts of its frames, added up pixel by pixel: total (array), frames."""
    h, w = scan.det_shape
    of = dataset_of(scan.frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, list] = {}
        for b in batches:
            counts = _matrix(b.column(len(of)), h * w)
            names = np.array(b.column(0).to_pylist() if of else [None] * b.num_rows, object)
            for name in set(names.tolist()):
                own = counts if len(set(names.tolist())) == 1 else counts[[x == name for x in names]]
                total = sums.setdefault(name, [np.zeros(h * w, np.int64), 0])
                total[0] += own.sum(0, dtype=np.int64)
                total[1] += len(own)
        for name, (total, n) in sums.items():
            arrays = [pa.array([total], pa.list_(pa.int64())), pa.array([n], pa.int64())]
            yield pa.RecordBatch.from_arrays([*([pa.array([name], pa.string())] if of else []), *arrays], names=[*of, "total", "frames"])

    return scan.frames.where("counts is not null").select(*of, "counts").mapInArrow(run, ", ".join([*(f"{c} string" for c in of), "total array<long>", "frames long"]))


def detector_sums(source: Scan | DataFrame) -> DataFrame:
    """det_row, det_col, total, frames (of each dataset)."""
    if isinstance(source, Scan):
        tasks = _task_sums(source)
        rows = tasks.select(*dataset_of(tasks), "frames", F.posexplode_outer("total").alias("p", "n")).where("p is not null")
        w = source.det_shape[1]
        rows = rows.select(*dataset_of(tasks), "frames", "n", F.floor(F.col("p") / w).cast("int").alias("det_row"), (F.col("p") % w).cast("int").alias("det_col"))
        return rows.groupBy(*dataset_of(tasks), "det_row", "det_col").agg(F.sum("n").alias("total"), F.sum("frames").alias("frames"))
    return source.groupBy(*dataset_of(source), "det_row", "det_col").agg(F.sum("n").alias("total"), F.count("*").alias("frames"))


def mean_dp(source: Scan | DataFrame) -> DataFrame:
    """det_row, det_col, value: the mean diffraction pattern (of each dataset), from exact sums."""
    sums = detector_sums(source)
    return sums.select(*dataset_of(sums), "det_row", "det_col", (F.col("total") / F.col("frames")).alias("value"))


def reduce_frames(pixels: DataFrame, request: DataFrame, how: str = "mean") -> DataFrame:
    """Mean, sum or max of the frames asked for (req_pos, frame_idx); a frame asked for twice counts twice."""
    found = request.join(pixels, "frame_idx")
    value = {"mean": F.sum("n") / F.count("*"), "sum": F.sum("n"), "max": F.max("n")}.get(how)
    if value is None:
        raise ValueError(f"unknown reduction {how!r}")
    return found.groupBy(*dataset_of(found), "det_row", "det_col").agg(value.alias("value"))


def roi_diffraction(pixels: DataFrame, inside: Column, how: str = "mean") -> DataFrame:
    """Sum, max or mean diffraction of the scan positions for which inside holds."""
    value = {"mean": F.sum("n") / F.count("*"), "sum": F.sum("n"), "max": F.max("n")}[how]
    return pixels.where(inside).groupBy(*dataset_of(pixels), "det_row", "det_col").agg(value.alias("value"))


# ---- over the detector

def _distance(center: tuple[float, float]) -> Column:
    return F.sqrt(F.pow(F.col("det_row") - F.lit(float(center[0])), 2) + F.pow(F.col("det_col") - F.lit(float(center[1])), 2))


def band(center: tuple[float, float], low: float, high: float) -> Column:
    """Whether a pixel's distance from the centre is in [low, high]: the one geometry of all virtual detectors."""
    d = _distance(center)
    return d >= low if math.isinf(high) else (d >= low) & (d <= high)


def virtual_images(source: Scan | DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One exact sum for each mask, in one pass; an empty mask gives 0."""
    return sums_of(source, {name: F.when(m, 1).otherwise(0) for name, m in masks.items()})


def masked_sum(source: Scan | DataFrame, mask: DataFrame) -> DataFrame:
    """mask: det_row, det_col of selected pixels, as many as the detector has at most."""
    chosen = mask.select("det_row", "det_col").distinct().collect()
    inside = F.array_contains(F.array(*[F.lit(f"{r} {c}") for r, c in chosen]), F.concat_ws(" ", "det_row", "det_col")) if chosen else F.lit(False)
    return virtual_images(source, {"value": inside})


def total_minus_complement(source: Scan | DataFrame, mask: Column) -> DataFrame:
    """The masked sum by way of the pixels outside it."""
    sums = virtual_images(source, {"total": F.lit(True), "outside": ~mask})
    return sums.select(*keys_of(sums), (F.col("total") - F.col("outside")).alias("value"))


def total_counts(source: Scan | DataFrame) -> DataFrame:
    return virtual_images(source, {"value": F.lit(True)})


def frame_checksums(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*keys_of(pixels)).agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("n_pixels"))


def screening_sums(source: Scan | DataFrame, probe: Probe) -> DataFrame:
    """Total, row and column moment, BF, ABF, ADF and DF in one pass."""
    bands = {m.lower(): F.when(c, 1).otherwise(0) for m, c in bands_of(probe).items() if m in ("BF", "ABF", "ADF", "DF")}
    return sums_of(source, {"total": F.lit(1), "row_moment": F.col("det_row"), "col_moment": F.col("det_col"), **{m: bands[m] for m in ("bf", "abf", "adf", "df")}})


def radial_sums(pixels: DataFrame, center: tuple[int, int]) -> DataFrame:
    """Cumulative sums by integer radius: inside ceil(distance) <= radius, and floor(distance) <= radius."""
    d = _distance(center)
    rows = pixels.select(*keys_of(pixels), "n", F.explode(F.array(F.struct(F.lit("ceil").alias("kind"), F.ceil(d).cast("int").alias("radius")), F.struct(F.lit("floor").alias("kind"), F.floor(d).cast("int").alias("radius")))).alias("x"))
    sums = rows.groupBy(*keys_of(pixels), F.col("x.kind").alias("kind"), F.col("x.radius").alias("radius")).agg(F.sum("n").alias("n"))
    return sums.withColumn("inside", F.sum("n").over(Window.partitionBy(*keys_of(pixels), "kind").orderBy("radius")))


def radial_annulus(pixels: DataFrame, center: tuple[int, int], inner: int, outer: int) -> DataFrame:
    """A ring's sum, both ends included, as a difference of cumulative sums; integer centre and radii only."""
    if any(x != int(x) for x in (*center, inner, outer)):
        raise ValueError("cumulative radial sums hold for integer centres and radii")
    sums = radial_sums(pixels, center)
    upper = F.max(F.when((F.col("kind") == "ceil") & (F.col("radius") <= outer), F.col("inside")))
    lower = F.max(F.when((F.col("kind") == "floor") & (F.col("radius") <= inner - 1), F.col("inside")))
    return sums.groupBy(*keys_of(sums)).agg((F.coalesce(upper, F.lit(0)) - F.coalesce(lower, F.lit(0))).alias("value"))


def row_prefix(pixels: DataFrame) -> DataFrame:
    """Inclusive prefix sums along each detector row."""
    along = Window.partitionBy(*keys_of(pixels), "det_row").orderBy("det_col")
    return pixels.withColumn("prefix", F.sum("n").over(along))


def span_sums(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """spans: det_row, c0, c1 (end excluded), at most one for each detector row. Sums from prefixes."""
    p = row_prefix(pixels).join(F.broadcast(spans), "det_row")
    ends = F.when(F.col("det_col") == F.col("c1") - 1, F.col("prefix")).when(F.col("det_col") == F.col("c0") - 1, -F.col("prefix")).otherwise(0)
    return p.groupBy(*keys_of(p)).agg(F.sum(ends).alias("value"))


# ---- probes

def auto_probe(image: DataFrame) -> DataFrame:
    """From a mean pattern (det_row, det_col, value): pixels above mean + population deviation give the centroid and
    sqrt(area / pi); if there are none, the middle and a quarter of the shorter side. One row (for each dataset): row, col, radius."""
    of = dataset_of(image)
    stats = image.groupBy(*of).agg((F.avg("value") + F.stddev_pop("value")).alias("limit"), (F.max("det_row") + 1).alias("h"), (F.max("det_col") + 1).alias("w"))
    above = F.col("value") > F.col("limit")
    found = image.join(F.broadcast(stats), of or None).groupBy(*of).agg(  # a row for each dataset
        F.avg(F.when(above, F.col("det_row"))).alias("r"), F.avg(F.when(above, F.col("det_col"))).alias("c"), F.count_if(above).alias("area"), F.first("h").alias("h"), F.first("w").alias("w")
    )
    return found.select(*of, F.coalesce("r", F.col("h") / 2).alias("row"), F.coalesce("c", F.col("w") / 2).alias("col"), F.when(F.col("area") > 0, F.sqrt(F.col("area") / math.pi)).otherwise(F.least("h", "w") * 0.25).alias("radius"))


def fitted_probe(scan: Scan, center: tuple[float, float] | None = None, radius: float | None = None) -> Probe:
    if center is not None and radius is not None:
        return Probe(float(center[0]), float(center[1]), float(radius))
    one_dataset(scan.frames)
    row, col, auto = auto_probe(mean_dp(scan)).select("row", "col", "radius").first()
    row, col = center or (row, col)
    return Probe(float(row), float(col), float(auto if radius is None else radius))


def bf_radius(image: DataFrame, det_shape: tuple[int, int], threshold: float = 0.1) -> Probe:
    """Rounded centroid of the pixels above a share of the maximum, and the radius at which the smoothed radial profile
    falls below half of its inner five. The profile has a value for each radius: it is finished on the driver."""
    most = F.broadcast(image.agg(F.max("value").alias("most")))
    above = F.col("value") > threshold * F.col("most")
    peak, row, col = image.join(most).agg(F.first("most"), F.avg(F.when(above, F.col("det_row"))), F.avg(F.when(above, F.col("det_col")))).first()
    if not peak or peak <= 0 or math.isnan(peak):
        raise ValueError("the pattern has no positive values")
    h, w = det_shape
    row, col = max(0, min(round(row), h - 1)), max(0, min(round(col), w - 1))
    reach = min(row, col, h - row, w - col)
    if reach < 2:
        return Probe(row, col, max(1, min(h, w) // 4))
    bins = image.groupBy(F.rint(_distance((row, col))).cast("int").alias("r")).agg(F.avg("value").alias("v")).where(F.col("r") < reach)
    profile = np.zeros(reach)
    for r, v in bins.collect():  # one row for each radius
        profile[r] = v
    if reach <= 5:
        return Probe(row, col, max(1, min(h, w) // 4))
    x = np.arange(-6, 7)
    kernel = np.exp(-0.5 * (x / 2.0) ** 2)
    smooth = np.convolve(np.pad(profile, 6, mode="edge"), kernel / kernel.sum(), "valid")
    below = np.flatnonzero(smooth < 0.5 * smooth[:5].mean())
    return Probe(row, col, max(1, int(below[0]) if len(below) else reach // 2))


def bf_disk(image: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Bright pixels above a share of the maximum, numbered row by row: bf_idx, det_row, det_col."""
    most = F.broadcast(image.agg(F.max("value").alias("most")))
    above = image.join(most).where(F.col("value") > threshold * F.col("most"))
    order = Window.orderBy("det_row", "det_col")  # one row for each detector pixel at most
    return above.select((F.row_number().over(order) - 1).alias("bf_idx"), "det_row", "det_col")


def circular_disk(image: DataFrame, center: tuple[int, int], radius: float) -> DataFrame:
    """Pixels whose squared distance is at most radius squared, numbered row by row."""
    dr, dc = F.col("det_row") - center[0], F.col("det_col") - center[1]
    order = Window.orderBy("det_row", "det_col")
    return image.where(dr * dr + dc * dc <= radius * radius).select((F.row_number().over(order) - 1).alias("bf_idx"), "det_row", "det_col")


# ---- virtual detectors

def bands_of(probe: Probe, inner: float | None = None, outer: float | None = None) -> dict[str, Column]:
    """The detector bands, in units of the disk's radius (1 pixel at least)."""
    r, center = max(1.0, probe.radius), (probe.row, probe.col)
    limits = {"BF": (0.0, r), "ABF": (0.5 * r, r), "ADF": (r, 2 * r), "HAADF": (2 * r, 4 * r), "DF": (r, math.inf), "ANNULAR": ((inner or 0.0) * r, math.inf if outer is None else outer * r)}
    return {mode: band(center, *x) for mode, x in limits.items()}


def to_pixels(scan: Scan, value: float, unit: str, radius: float) -> float:
    """A collection angle as a detector radius: the disk's radius spans the convergence semi-angle."""
    if unit in ("px", "pixel", "pixels"):
        return float(value)
    if unit != "mrad":
        raise ValueError(f"unknown unit {unit!r}")
    if not scan.semiangle_mrad:
        raise ValueError("angles in mrad need the convergence semi-angle; give pixels instead")
    return value / scan.semiangle_mrad * radius


def _image(scan: Scan, probe: Probe, low: float, high: float) -> DataFrame:
    return virtual_images(scan, {"value": band((probe.row, probe.col), low, high)})


def bf(scan: Scan, center=None, radius=None) -> DataFrame:
    probe = fitted_probe(scan, center, radius)
    return _image(scan, probe, 0.0, probe.radius)


def adf(scan: Scan, inner: float | None = None, outer: float | None = None, unit: str = "mrad", center=None, radius=None) -> DataFrame:
    probe = fitted_probe(scan, center, radius)
    low = probe.radius if inner is None else to_pixels(scan, inner, unit, probe.radius)
    high = 2 * probe.radius if outer is None else to_pixels(scan, outer, unit, probe.radius)
    return _image(scan, probe, low, high)


def df(scan: Scan, inner: float | None = None, unit: str = "mrad", center=None, radius=None) -> DataFrame:
    probe = fitted_probe(scan, center, radius)
    return _image(scan, probe, probe.radius if inner is None else to_pixels(scan, inner, unit, probe.radius), math.inf)


def virtual(scan: Scan, mode: str = "BF", center=None, bf_radius=None, inner=None, outer=None) -> DataFrame:
    mode = mode.strip().upper()
    if mode == "DP":
        return mean_dp(scan)
    bands = bands_of(fitted_probe(scan, center, bf_radius), inner, outer)
    if mode not in bands:
        raise ValueError(f"unknown mode {mode!r}")
    return virtual_images(scan, {"value": bands[mode]})


def service_image(scan: Scan, probe: Probe, mode: str, inner: float = 0.0, outer: float = 1.0) -> DataFrame:
    """The service's bands: BF reaches out to ``outer`` radii, rings from inner to max(inner + 1 pixel, outer) radii."""
    r = max(1.0, probe.radius)
    low = 0.0 if mode.upper() == "BF" else inner * r
    return _image(scan, probe, low, outer * r if mode.upper() == "BF" else max(low + 1, outer * r))
