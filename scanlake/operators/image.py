"""Images as rows (row, col, value): geometry, windows, line profiles, filters and Fourier views.

Interpolations are joins of output pixels to the four source pixels that they weigh; blurs are joins to a small
kernel, first along rows, then along columns. Transforms of a whole image go through functions.fourier.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fourier

# ---- interpolation


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    at = F.col("id")
    return spark.range(rows * cols).select(F.floor(at / cols).cast("int").alias("row"), (at % cols).cast("int").alias("col"))


def sample(image: DataFrame, points: DataFrame, shape: tuple[int, int], keys: list[str], by: list[str] | None = None) -> DataFrame:
    """points: keys, y, x (real coordinates). Bilinear values; corners beyond the edge take the nearest pixel.
    by: columns that image and points share (as a frame number)."""
    by = by or []
    r, c = F.floor("y"), F.floor("x")
    fr, fc = F.col("y") - r, F.col("x") - c
    limit = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    corners = [F.struct(limit(r + dr, shape[0]).alias("row"), limit(c + dc, shape[1]).alias("col"), ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("weight")) for dr in (0, 1) for dc in (0, 1)]
    wanted = points.select(*by, *keys, F.explode(F.array(*corners)).alias("k")).select(*by, *keys, "k.row", "k.col", "k.weight")
    return wanted.join(image, [*by, "row", "col"]).groupBy(*by, *[F.col(k) for k in keys]).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def check_angle(degrees: float) -> float:
    if isinstance(degrees, bool) or not isinstance(degrees, (int, float)) or not math.isfinite(degrees):
        raise ValueError(f"{degrees!r} is no angle")
    return float(degrees)


def rotate(images: DataFrame, shape: tuple[int, int], degrees: float, by: list[str] | None = None) -> DataFrame:
    """Each image turned within its own shape; a full turn changes nothing. by: columns that tell images apart."""
    angle, by = check_angle(degrees), by or []
    if math.isclose(angle % 360, 0, abs_tol=1e-12):
        return images
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    mid_row, mid_col = (shape[0] - 1) / 2, (shape[1] - 1) / 2
    x, y = F.col("col") - mid_col, F.col("row") - mid_row
    within = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    points = images.select(*by, F.col("row").alias("out_row"), F.col("col").alias("out_col"), within(s * x + c * y + mid_row, shape[0]).alias("y"), within(c * x - s * y + mid_col, shape[1]).alias("x"))
    out = sample(images, points, shape, ["out_row", "out_col"], by)
    return out.select(*by, F.col("out_row").alias("row"), F.col("out_col").alias("col"), "value")


def zoom(image: DataFrame, shape: tuple[int, int], out_shape: tuple[int, int]) -> DataFrame:
    """Bilinear, corner on corner."""
    scale = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(shape, out_shape, strict=True)]
    points = grid(image.sparkSession, *out_shape).select(F.col("row").alias("out_row"), F.col("col").alias("out_col"), (F.col("row") * F.lit(scale[0])).alias("y"), (F.col("col") * F.lit(scale[1])).alias("x"))
    return sample(image, points, shape, ["out_row", "out_col"]).select(F.col("out_row").alias("row"), F.col("out_col").alias("col"), "value")


def line_profile(image: DataFrame, shape: tuple[int, int], start: tuple[float, float], stop: tuple[float, float], width: int = 1) -> DataFrame:
    """i, value along a line, the mean of width parallel lines a pixel apart; ceil(length) samples, two at least."""
    (r0, c0), (r1, c1) = start, stop
    dr, dc = r1 - r0, c1 - c0
    length = math.hypot(dr, dc)
    n = max(2, math.ceil(length))
    lines = width if width > 1 and length >= 1e-8 else 1
    across = (-dc / length, dr / length) if lines > 1 else (0.0, 0.0)
    at = image.sparkSession.range(n * lines).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("line"))
    off, part = F.col("line") - F.lit((lines - 1) / 2), F.col("i") / F.lit(n - 1)
    points = at.select("i", "line", (F.lit(float(r0)) + off * across[0] + part * F.lit(float(dr))).alias("y"), (F.lit(float(c0)) + off * across[1] + part * F.lit(float(dc))).alias("x"))
    return sample(image, points, shape, ["i", "line"]).groupBy("i").agg((F.sum("value") / lines).alias("value"))


def crop_masked(image: DataFrame, shape: tuple[int, int], center: tuple[float, float], radius: float | None = None, size: tuple[float, float] | None = None) -> DataFrame | None:
    """A rectangle (size: height, width), or a circle's bounding box with zeros outside the circle; rows and columns
    start anew. None if less than two pixels are left on a side."""
    half = (radius, radius) if radius is not None else (size[0] / 2, size[1] / 2)
    r0, c0 = (max(0, math.floor(center[i] - half[i])) for i in (0, 1))
    r1, c1 = (min(shape[i], math.ceil(center[i] + half[i])) for i in (0, 1))
    if r1 - r0 < 2 or c1 - c0 < 2:
        return None
    inside = image.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    value = F.col("value")
    if radius is not None:
        dr, dc = F.col("row") - F.lit(float(center[0])), F.col("col") - F.lit(float(center[1]))
        value = F.when(dr * dr + dc * dc <= radius * radius, value).otherwise(0.0)
    return inside.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), value.alias("value"))


# ---- filters

def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) if sigma > 0 else 1.0 for i in range(-radius, radius + 1)]
    return [(i - radius, w / sum(weights)) for i, w in enumerate(weights)]


def gaussian_blur(image: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    """Reflecting edges (the edge pixel is repeated). Each pixel hands its weighted value to the pixels around it."""
    kernel = gaussian_kernel(sigma)
    if len(kernel) == 1:
        return image

    def along(axis: str, n: int, df: DataFrame) -> DataFrame:
        pairs: dict[tuple[int, int], float] = {}
        for i in range(n):
            for k, w in kernel:
                j = (i + k) % (2 * n)
                j = j if j < n else 2 * n - 1 - j
                pairs[j, i] = pairs.get((j, i), 0.0) + w
        other = "col" if axis == "row" else "row"
        table = image.sparkSession.createDataFrame([(j, i, w) for (j, i), w in pairs.items()], f"{axis} int, to int, weight double")
        moved = df.join(F.broadcast(table), axis)  # an image side times the kernel's length
        return moved.groupBy(other, F.col("to").alias(axis)).agg(F.sum(F.col("weight") * F.col("value")).alias("value")).select("row", "col", "value")

    return along("col", shape[1], along("row", shape[0], image))


def _half(n: int) -> int:
    return max(1, round(n * 0.5))  # half to even


def bin2(image: DataFrame, shape: tuple[int, int], sigma: float | None) -> DataFrame:
    """Zoomed to half, blurred there if sigma is given, and back."""
    small = (_half(shape[0]), _half(shape[1]))
    out = zoom(image, shape, small)
    if sigma is not None:
        out = gaussian_blur(out, small, max(1.0, sigma / 2.5))
    return zoom(out, small, shape)


def anscombe(image: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    """Variance-stabilised Gaussian smoothing; counts are taken as 30 at the 99.5 % value."""
    scale = image.agg(F.percentile("value", 0.995)).first()[0] + 1e-9
    stable = image.select("row", "col", (2 * F.sqrt(F.greatest(F.col("value") / scale * 30, F.lit(0.0)) + 0.375)).alias("value"))
    back = F.greatest(F.pow(F.col("value") * 0.5, 2) - 0.375, F.lit(0.0)) * scale / 30
    return gaussian_blur(stable, shape, max(1.0, sigma * 0.85)).select("row", "col", back.alias("value"))


def display_filter(image: DataFrame, shape: tuple[int, int], mode: str, sigma: float = 1.0, spatial_bin: int = 1) -> DataFrame:
    alias = {"bin2": ("gaussian", 2), "bin2_anscombe": ("anscombe", 2), "bin4_anscombe": ("anscombe", 4)}
    mode, least = alias.get(mode, (mode, 1))
    bins = max(spatial_bin or 1, least)
    if mode == "gaussian":
        if bins == 4:
            return bin2(bin2(image, shape, None), shape, sigma)
        return bin2(image, shape, sigma) if bins == 2 else gaussian_blur(image, shape, sigma)
    if mode not in ("anscombe", "none"):
        raise ValueError(f"unknown filter {mode!r}")
    for _ in range({4: 2}.get(bins, int(bins >= 2))):
        image = bin2(image, shape, None)
    return image if mode == "none" else anscombe(image, shape, max(2.0, sigma * 0.75) if bins >= 2 else sigma)


def hann(image: DataFrame, shape: tuple[int, int]) -> DataFrame:
    taper = lambda c, n: 0.5 * (1 - F.cos(2 * math.pi * F.col(c) / max(1, n - 1)))
    return image.select("row", "col", (F.col("value") * taper("row", shape[0]) * taper("col", shape[1])).alias("value"))


# ---- Fourier views

def fft2(image: DataFrame, keys: list[str] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """re, im by row and col (frequencies in transform order). With a shape an image is spread over the tasks, and rows beyond it (as of
    an incomplete scan row) count, see fourier.to_array; one image without a shape has the one that its rows need."""
    if shape is None and not keys:
        shape = fourier.shape_of(image, ["row", "col"])
    if shape is not None:
        return fourier.fft2(image, ["row", "col"], ["value"], shape, keys or [])

    def run(v: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.fft2(v)
        return {"re": f.real, "im": f.imag}

    return fourier.per_image(image, keys or [], ["row", "col"], ["value"], {"re": "double", "im": "double"}, run)


def ifft2(spectrum: DataFrame, keys: list[str] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """re, im of the image; shape as for fft2."""
    if shape is None and not keys:
        shape = fourier.shape_of(spectrum, ["row", "col"])
    if shape is not None:
        return fourier.fft2(spectrum, ["row", "col"], ["re", "im"], shape, keys or [], inverse=True)

    def run(re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.ifft2(re + 1j * im)
        return {"re": f.real, "im": f.imag}

    return fourier.per_image(spectrum, keys or [], ["row", "col"], ["re", "im"], {"re": "double", "im": "double"}, run)


def shifted(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Frequency 0 moved to the middle."""
    at = lambda c, n: ((F.col(c) + n // 2) % n).cast("int").alias(c)
    return df.select(at("row", shape[0]), at("col", shape[1]), *[c for c in df.columns if c not in ("row", "col")])


def magnitude(spectrum: DataFrame, log: bool = False) -> DataFrame:
    m = F.hypot("re", "im")
    return spectrum.select("row", "col", (F.log1p(m) if log else m).alias("value"))


def reciprocal(row: Column, col: Column, shape: tuple[int, int], sampling: tuple[float, float]) -> dict[str, Column]:
    """Frequencies and lattice spacing of offsets from the centre of a shifted spectrum."""
    fr, fc = row / F.lit(shape[0] * sampling[0]), col / F.lit(shape[1] * sampling[1])
    f = F.hypot(fr, fc)
    return {"row_frequency": fr, "col_frequency": fc, "spatial_frequency": f, "d_spacing": F.when(f > 0, 1 / f)}


def fft_peak(magnitude_: DataFrame, shape: tuple[int, int], near: tuple[float, float], radius: int) -> DataFrame:
    """The strongest pixel within radius of a point (the first of equals, row by row), refined by a 3 x 3 centroid."""
    row, col = (max(0, min(shape[i] - 1, math.floor(near[i]))) for i in (0, 1))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    best = magnitude_.where(finite & (F.abs(F.col("row") - row) <= radius) & (F.abs(F.col("col") - col) <= radius)).agg(F.max_by(F.struct("row", "col"), F.struct("value", -F.col("row"), -F.col("col"))).alias("best"))
    close = magnitude_.where(finite & (F.col("value") > 0)).join(F.broadcast(best), (F.abs(F.col("row") - F.col("best.row")) <= 1) & (F.abs(F.col("col") - F.col("best.col")) <= 1))
    found = close.agg(F.sum("value").alias("w"), F.sum(F.col("row") * F.col("value")).alias("r"), F.sum(F.col("col") * F.col("value")).alias("c"))
    return found.join(best).select(F.coalesce(F.col("r") / F.col("w"), F.col("best.row"), F.lit(row)).alias("row"), F.coalesce(F.col("c") / F.col("w"), F.col("best.col"), F.lit(col)).alias("col"))


def fft_quality(magnitude_: DataFrame, shape: tuple[int, int], sampling_A: float | None = None, periods_A: tuple[float, float] = (1.0, 6.0)) -> DataFrame:
    """sharp (share of the power in the lattice band, percent), peaks, snr and ring (evenness over 16 directions) of a
    shifted spectrum. One row; nulls where there is nothing to measure, as below 32 pixels a side."""
    h, w = shape
    reach = min(h, w) / 2
    if reach < 16:
        return magnitude_.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("sharp", "double"), ("peaks", "long"), ("snr", "double"), ("ring", "double"))])
    low, high = 0.15 * reach, 0.6 * reach
    if sampling_A:
        n = min(h, w)
        lo, hi = max(2, n * sampling_A / periods_A[1]), min(reach - 1, n * sampling_A / periods_A[0])
        low, high = (lo, hi) if hi > lo + 2 else (low, high)
    v = F.when(F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf")), 0.0).otherwise(F.greatest(F.col("value"), F.lit(0.0)))
    dy, dx = F.col("row") - F.lit(h / 2), F.col("col") - F.lit(w / 2)
    px = magnitude_.select("row", "col", v.alias("v"), (dx * dx + dy * dy).alias("r2"), F.least(F.lit(15), F.greatest(F.lit(0), F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * 16))).alias("way"))
    px = px.withColumn("whole", (F.col("r2") > max(2, reach * 0.015) ** 2) & (F.col("r2") < (reach - 1) ** 2)).withColumn("band", (F.col("r2") >= low * low) & (F.col("r2") <= high * high))
    used = F.col("whole") & F.col("band")
    part = F.when(used, F.col("v"))
    sums = px.agg(
        F.sum(F.when(F.col("whole"), F.col("v") * F.col("v"))).alias("power"), F.sum(part * part).alias("band_power"), F.count(part).alias("n"), F.avg(part).alias("mean"), F.max(part).alias("strongest")
    ).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("band_power") / F.col("n") - F.col("mean") * F.col("mean"))))
    sums = sums.withColumn("threshold", F.col("mean") + F.greatest(F.lit(3.0), F.when(F.col("std") > 0, 5 * F.col("std")).otherwise(2 * F.col("mean"))))
    ways = px.where(used).groupBy("way").agg(F.avg("v").alias("m")).agg(F.count("*").alias("ways"), F.avg("m").alias("ways_mean"), F.stddev_pop("m").alias("ways_std"))
    inner = (F.col("row") >= 1) & (F.col("row") < h - 1) & (F.col("col") >= 1) & (F.col("col") < w - 1)
    high_ = px.where(F.col("band") & inner).join(F.broadcast(sums.select("threshold"))).where(F.col("v") >= F.col("threshold")).select("row", "col", "v")
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    around = high_.select("row", "col", "v", F.explode(moves).alias("m")).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("v").alias("own"), (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    peaks = around.join(px.select("row", "col", "v"), ["row", "col"]).groupBy("r", "c").agg(F.max(F.col("v") >= F.col("own")).alias("beaten")).agg(F.count_if(~F.col("beaten")).alias("peaks"))
    out = sums.join(ways).join(peaks)
    enough = (F.col("power") > 1e-20) & (F.col("n") >= 8)
    snr = F.when(F.col("std") > 1e-20, F.greatest(F.lit(0.0), (F.col("strongest") - F.col("mean")) / F.col("std"))).when(F.col("mean") > 1e-20, F.col("strongest") / F.col("mean"))
    ring = F.when((F.col("ways") > 1) & (F.col("ways_mean") > 1e-20), F.greatest(F.lit(0.0), 1 - F.col("ways_std") / F.col("ways_mean")))
    return out.select(F.when(enough, 100 * F.col("band_power") / F.col("power")).alias("sharp"), F.when(enough, F.col("peaks")).alias("peaks"), F.when(enough, snr).alias("snr"), F.when(enough, ring).alias("ring"))


def quality_summary(metrics: DataFrame) -> DataFrame:
    """Of several images: mean sharpness and ring, all peaks, best signal to noise."""
    return metrics.agg(F.avg("sharp").alias("sharp"), F.sum("peaks").alias("peaks"), F.max("snr").alias("snr"), F.avg("ring").alias("ring"))


def frequency_mask(radius, mode: str, cutoff: float | None = None, center: float = 0.3, width: float = 0.12, edge: float = 0.035):
    """Logistic low-, high- and band-pass over radius 0 to 1 (Nyquist)."""
    edge = max(0.002, edge)
    step = lambda x: 1 / (1 + np.exp(-x / edge))
    if mode == "none":
        return np.ones_like(radius)
    if mode == "lowpass":
        return 1 - step(radius - (0.25 if cutoff is None else cutoff))
    if mode == "highpass":
        return step(radius - (0.08 if cutoff is None else cutoff))
    if mode != "bandpass":
        raise ValueError(f"unknown filter {mode!r}")
    half = max(edge, width / 2)
    return step(radius - max(0, center - half)) * (1 - step(radius - min(1, center + half)))


def frequency_filter(image: DataFrame, mode: str, keys: list[str] | None = None, shape: tuple[int, int] | None = None, **options) -> DataFrame:
    """shape as for fft2: with one, an image is spread over the tasks."""

    def mask(u: np.ndarray, w: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        fr, fc = (np.minimum(k, n - k) / max(1, n / 2) for k, n in zip((u, w), shape, strict=True))
        return frequency_mask(np.minimum(1, np.hypot(fr, fc)), mode, **options)

    if shape is None and not keys:
        shape = fourier.shape_of(image, ["row", "col"])
    if shape is not None:
        return fourier.filtered(image, ["row", "col"], ["value"], shape, "value", lambda s, u, w: s * mask(u, w, shape), keys or [])

    def run(v: np.ndarray) -> dict[str, np.ndarray]:
        u, w = np.ogrid[: v.shape[0], : v.shape[1]]
        return {"value": np.fft.ifft2(np.fft.fft2(v) * mask(u, w, v.shape)).real}

    return fourier.per_image(image, keys or [], ["row", "col"], ["value"], {"value": "double"}, run)


def unit_scaled(image: DataFrame) -> DataFrame:
    """Values by their rank among equals' range: (value - least) / (most - least) over the image (one row joined to all)."""
    ends = F.broadcast(image.agg(F.min("value").alias("a"), F.max("value").alias("b")))
    return image.join(ends).select("row", "col", F.when(F.col("b") > F.col("a"), (F.col("value") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.5).alias("value"))


def local_maxima(image: DataFrame) -> DataFrame:
    """Pixels above all of their up to eight neighbours, by two windows."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    rows = image.withColumn("_left", F.lag("value").over(across)).withColumn("_right", F.lead("value").over(across))
    rows = rows.withColumn("_span", F.greatest("_left", "value", "_right"))
    rows = rows.withColumn("_up", F.lag("_span").over(down)).withColumn("_down", F.lead("_span").over(down))
    beats = lambda c: F.col(c).isNull() | (F.col("value") > F.col(c))
    return rows.where(beats("_left") & beats("_right") & beats("_up") & beats("_down")).select("row", "col", "value")
