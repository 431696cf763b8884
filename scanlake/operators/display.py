"""Display values: scaling, statistics, histograms, percentiles and colours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The control points of the colour maps.
COLORMAPS = {
    "gray": [[0, 0, 0], [255, 255, 255]],
    "viridis": [[68, 1, 84], [72, 36, 117], [65, 68, 135], [53, 95, 141], [42, 120, 142], [33, 145, 140], [34, 168, 132], [68, 191, 112], [122, 209, 81], [189, 223, 38], [253, 231, 37]],
    "plasma": [[13, 8, 135], [75, 3, 161], [126, 3, 168], [168, 34, 150], [203, 70, 121], [229, 107, 93], [248, 148, 65], [253, 195, 40], [240, 249, 33]],
    "inferno": [[0, 0, 4], [40, 11, 84], [101, 21, 110], [159, 42, 99], [212, 72, 66], [245, 125, 21], [252, 193, 57], [252, 255, 164]],
    "magma": [[0, 0, 4], [28, 16, 68], [79, 18, 123], [129, 37, 129], [181, 54, 122], [229, 80, 100], [251, 135, 97], [254, 194, 135], [252, 253, 191]],
    "magenta": [[5, 0, 8], [74, 0, 56], [154, 0, 120], [208, 32, 168], [255, 64, 208], [255, 144, 232]],
    "hot": [[0, 0, 0], [87, 0, 0], [173, 0, 0], [255, 0, 0], [255, 87, 0], [255, 173, 0], [255, 255, 0], [255, 255, 128], [255, 255, 255]],
    "hsv": [[255, 0, 0], [255, 255, 0], [0, 255, 0], [0, 255, 255], [0, 0, 255], [255, 0, 255], [255, 0, 0]],
    "turbo": [[48, 18, 59], [69, 55, 161], [66, 107, 230], [30, 162, 230], [29, 212, 169], [79, 241, 89], [175, 240, 32], [244, 195, 12], [248, 118, 11], [207, 46, 3], [122, 4, 2]],
    "RdBu": [[103, 0, 31], [178, 24, 43], [214, 96, 77], [244, 165, 130], [253, 219, 199], [247, 247, 247], [209, 229, 240], [146, 197, 222], [67, 147, 195], [33, 102, 172], [5, 48, 97]],
    "cividis": [[0, 32, 76], [0, 42, 102], [13, 64, 117], [42, 80, 125], [70, 97, 125], [99, 113, 124], [127, 130, 121], [156, 148, 117], [187, 167, 105], [221, 188, 80], [253, 215, 21]],
    "seismic": [[0, 0, 76], [0, 0, 153], [0, 0, 255], [124, 124, 255], [255, 255, 255], [255, 124, 124], [255, 0, 0], [153, 0, 0], [76, 0, 0]],
}
_HALF = [[225, 216, 226], [184, 192, 224], [136, 158, 213], [101, 124, 197], [80, 92, 174], [69, 64, 135], [57, 36, 87], [40, 17, 47]]
# Those that follow from others: a reversed one, and one that goes there and back, from either end.
COLORMAPS |= {"RdBu_r": COLORMAPS["RdBu"][::-1], "twilight": _HALF + _HALF[-2::-1], "twilight_shifted": _HALF[::-1] + _HALF[1:]}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def transform(x: Column, scale: str = "linear") -> Column:
    if scale not in ("linear", "log"):
        raise ValueError(f"unknown scale {scale!r}")
    return x if scale == "linear" else signed_log(x)


def normalize(x: Column, low: float, high: float, scale: str = "linear") -> Column:
    """0 to 1; an empty range gives 0.5, NaN 0, infinities the ends. Spans beyond a double are halved first."""
    high = max(low, high)
    of = (lambda v: math.copysign(math.log1p(abs(v)), v)) if scale == "log" else float
    a, b = of(low), of(high)
    if not b > a:
        return F.lit(0.5)
    t = transform(x, scale)
    share = (t - a) / (b - a) if math.isfinite(b - a) else (t / 2 - a / 2) / (b / 2 - a / 2)
    return F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def histogram(image: DataFrame, low: float, high: float, scale: str = "linear", bins: int = 256) -> DataFrame:
    """bin, count of the finite values; empty bins included."""
    at = F.least(F.floor(normalize(F.col("value"), low, high, scale) * bins), F.lit(bins - 1)).cast("int")
    counts = image.where(_finite(F.col("value"))).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = image.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def histogram_shares(image: DataFrame, low: float, high: float, bins: int = 256) -> DataFrame:
    """The histogram with its highest bin as 1."""
    h = histogram(image, low, high, bins=bins)
    return h.join(F.broadcast(h.agg(F.max("count").alias("most")))).select("bin", F.when(F.col("most") > 0, F.col("count") / F.col("most")).otherwise(0.0).alias("share"))


def colormap_lut(name: str) -> np.ndarray:
    """(256, 3) bytes, linear between the control points."""
    if name not in COLORMAPS:
        raise ValueError(f"unknown colour map {name!r}; there are {', '.join(COLORMAPS)}")
    points = np.array(COLORMAPS[name], float)
    at = np.linspace(0, len(points) - 1, 256)
    return np.floor(np.stack([np.interp(at, range(len(points)), points[:, i]) for i in range(3)], 1) + 0.5).astype(np.uint8)


def lut_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(i, *map(int, rgb)) for i, rgb in enumerate(colormap_lut(name))], "level int, r int, g int, b int")


def colorize(image: DataFrame, lut: DataFrame, low: float, high: float, scale: str = "linear") -> DataFrame:
    """row, col, r, g, b, a through a table of 256 levels."""
    level = F.least(F.floor(normalize(F.col("value"), low, high, scale) * 255), F.lit(255)).cast("int")
    return image.withColumn("level", level).join(F.broadcast(lut), "level").select("row", "col", "r", "g", "b", F.lit(255).alias("a"))


def data_range(image: DataFrame) -> DataFrame:
    """Of the finite values; 0 and 0 if there are none."""
    found = image.where(_finite(F.col("value"))).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return found.select(F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("most", F.lit(0.0)).alias("most"))


def stats(image: DataFrame) -> DataFrame:
    """mean, least, most and population deviation of the finite values."""
    v = image.where(_finite(F.col("value"))).agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_pop("value").alias("std"))
    return v.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in v.columns])


def slider_range(low: float, high: float, low_percent: float, high_percent: float) -> tuple[float, float]:
    return low + low_percent / 100 * (high - low), low + high_percent / 100 * (high - low)


def percentile_linear(image: DataFrame, *percents: float) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbours, a column p0, p1, ... for each."""
    return image.agg(*[F.percentile("value", p / 100).alias(f"p{i}") for i, p in enumerate(percents)])


def percentile_clip(image: DataFrame, low: float, high: float, bins: int = 1024) -> DataFrame:
    """vmin, vmax, least, most: percentiles from a histogram, linear inside the bin that reaches the count."""
    finite = image.where(_finite(F.col("value")))
    ends = F.broadcast(finite.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n")))
    span = F.col("most") - F.col("least")
    at = F.when(span > 0, F.floor((F.col("value") - F.col("least")) * ((bins - 1) / span))).otherwise(0)
    counts = finite.join(ends).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    up = Window.orderBy("bin")  # one row for each bin
    cumulative = counts.select("bin", "c", F.sum("c").over(up).alias("upto"))
    found = cumulative.join(ends)
    edges = []
    for name, p in (("vmin", low), ("vmax", high)):
        target = F.col("n") * (p / 100)
        # an empty first bin can hold the target 0 too: then the range's end is meant
        value = F.col("least") + (F.col("bin") + (target - (F.col("upto") - F.col("c"))) / F.greatest(F.lit(1), F.col("c"))) / bins * span
        edges.append(F.min_by(F.when(F.col("upto") >= target, value), F.when(F.col("upto") >= target, F.col("bin"))).alias(name))
    out = found.agg(*edges, F.first("least").alias("least"), F.first("most").alias("most"))
    flat = F.col("least") == F.col("most")
    return out.select(*[F.coalesce(F.when(flat, F.col("least")).otherwise(F.col(c)), F.lit(0.0)).alias(c) for c in ("vmin", "vmax", "least", "most")])


def contrast_window(histogram_: DataFrame, low: float, high: float) -> DataFrame:
    """low_bin, high_bin: the first bins at which the cumulative share reaches low and high (0 to 1)."""
    up = Window.orderBy("bin")  # one row for each bin
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = histogram_.select("bin", (F.sum("count").over(up) / F.sum("count").over(every)).alias("share"))
    return share.agg(F.min(F.when(F.col("share") >= low, F.col("bin"))).alias("low_bin"), F.min(F.when(F.col("share") >= high, F.col("bin"))).alias("high_bin"))


def enhance_fft(magnitude: DataFrame, shape: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The centre replaced by the mean of its four neighbours; and the range up to the 99.9 % value, found in a
    histogram of 1024 bins and a second one inside the bin that it lies in."""
    h, w = shape
    row, col = h // 2, w // 2
    near = (F.abs(F.col("row") - row) + F.abs(F.col("col") - col)) == 1
    mean = F.broadcast(magnitude.agg(F.avg(F.when(near, F.col("value"))).alias("_mean")))
    out = magnitude.join(mean).select("row", "col", F.when((F.col("row") == row) & (F.col("col") == col), F.col("_mean")).otherwise(F.col("value")).alias("value"))
    n = h * w
    least, most = out.agg(F.min("value"), F.max("value")).first()
    low, high, skip = least, most, 0
    if most > least:
        for _ in range(2):
            at = F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((F.col("value") - F.lit(low)) / F.lit(high - low) * 1024)))
            bins = out.where((F.col("value") >= low) & (F.col("value") <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
            target, seen = math.ceil(n * 0.999), skip
            for bin_, c in bins.orderBy("bin").collect():  # 1024 rows at most
                if seen + c >= target:
                    break
                seen += c
            width = (high - low) / 1024
            low, high, skip = low + bin_ * width, high if bin_ == 1023 else low + (bin_ + 1) * width, seen
            if not high > low:
                break
    return out, magnitude.sparkSession.createDataFrame([(float(least), float(high))], "least double, most double")
