"""Centre of mass, rotation search and phase integration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fourier
from ..plans.model import Scan
from .reduce import dataset_of, keys_of, one_dataset, sums_of


def center_of_mass(source: Scan | DataFrame, mask: Column | None = None) -> DataFrame:
    """Absolute centre of mass of each frame of a scan (or of pixels): com_row, com_col; 0 where a frame has no counts (in the mask)."""
    inside = F.lit(1) if mask is None else F.when(mask, 1).otherwise(0)
    sums = sums_of(source, {"t": inside, "r": inside * F.col("det_row"), "c": inside * F.col("det_col")})
    return sums.select(*keys_of(sums), *[F.when(F.col("t") > 0, F.col(x) / F.col("t")).otherwise(0.0).alias(f"com_{name}") for x, name in (("r", "row"), ("c", "col"))])


def centered(com: DataFrame) -> DataFrame:
    """The centre of mass minus its mean over the scan (one row for each dataset, joined to all)."""
    of = dataset_of(com)
    means = F.broadcast(com.groupBy(*of).agg(F.avg("com_row").alias("_r"), F.avg("com_col").alias("_c")))
    return com.join(means, of or None).select(*keys_of(com), (F.col("com_row") - F.col("_r")).alias("com_row"), (F.col("com_col") - F.col("_c")).alias("com_col"))


def rotate(row: Column, col: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return c * row - s * col, s * row + c * col


def components(com: DataFrame) -> DataFrame:
    return com.select(*keys_of(com), "com_row", "com_col", F.hypot("com_row", "com_col").alias("magnitude"))


def differences(com: DataFrame) -> DataFrame:
    """Central differences inside the grid: d(row)/dcol and so on, for positions with all four neighbours."""
    of = dataset_of(com)
    across, down = Window.partitionBy(*of, "scan_row").orderBy("scan_col"), Window.partitionBy(*of, "scan_col").orderBy("scan_row")
    half = lambda c, w: 0.5 * (F.lead(c).over(w) - F.lag(c).over(w))
    out = com.select(
        *of, "scan_row", "scan_col", half("com_row", across).alias("row_dcol"), half("com_col", across).alias("col_dcol"), half("com_row", down).alias("row_drow"), half("com_col", down).alias("col_drow")
    )
    return out.where(F.col("row_dcol").isNotNull() & F.col("row_drow").isNotNull())


def curl_score(com: DataFrame) -> DataFrame:
    """Mean squared curl."""
    curl = F.col("col_drow") - F.col("row_dcol")
    return differences(com).groupBy(*dataset_of(com)).agg(F.avg(curl * curl).alias("score"))


def rotation_scores(com: DataFrame, steps: int = 180) -> DataFrame:
    """angle_index, transposed, angle_deg, score: mean squared curl of the field turned by each angle, as it is and with
    its components exchanged. Turning mixes curl and divergence, so three sums give all the angles."""
    d = differences(com)
    sums = []
    for transposed, (r_dc, c_dr, r_dr, c_dc) in ((False, ("row_dcol", "col_drow", "row_drow", "col_dcol")), (True, ("col_dcol", "row_drow", "col_drow", "row_dcol"))):
        curl, div = F.col(c_dr) - F.col(r_dc), F.col(r_dr) + F.col(c_dc)
        sums.append(F.struct(F.lit(transposed).alias("transposed"), F.avg(curl * curl).alias("cc"), F.avg(div * div).alias("dd"), F.avg(curl * div).alias("cd")))
    of = dataset_of(com)
    moments = d.groupBy(*of).agg(F.array(*sums).alias("m")).select(*of, F.explode("m").alias("m")).select(*of, "m.*")
    step = math.pi / (steps - 1)
    angle = F.col("angle_index") * F.lit(step)
    found = moments.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("angle_index"))
    score = F.cos(angle) * F.cos(angle) * F.col("cc") + F.sin(angle) * F.sin(angle) * F.col("dd") + 2 * F.cos(angle) * F.sin(angle) * F.col("cd")
    return found.select(*of, "angle_index", "transposed", F.degrees(angle).alias("angle_deg"), score.alias("score"))


def find_rotation(com: DataFrame, steps: int = 180) -> tuple[float, bool]:
    """The angle and transposition of the least curl; (0, False) for grids narrower than three."""
    one_dataset(com)
    best = rotation_scores(com, steps).where("score is not null").orderBy("score", "transposed", "angle_index").first()
    return (best["angle_deg"], best["transposed"]) if best else (0.0, False)


def rotated(com: DataFrame, degrees: float, transposed: bool = False) -> DataFrame:
    r, c = (F.col("com_col"), F.col("com_row")) if transposed else (F.col("com_row"), F.col("com_col"))
    row, col = rotate(r, c, degrees)
    return com.select(*keys_of(com), row.alias("com_row"), col.alias("com_col"))


def _poisson_spectrum(row: np.ndarray, col: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Of the phase, from those of its gradient at the frequencies k0 and k1; 0 at frequency 0."""
    k2 = k0**2 + k1**2
    return np.where(k2 > 0, 0.25j * (k0 * row + k1 * col) / np.where(k2 > 0, k2, 1), 0)


def poisson_phase(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The phase whose gradient is (row, col), by Fourier integration; mean 0."""
    k0, k1 = np.meshgrid(np.fft.fftfreq(row.shape[0]), np.fft.fftfreq(row.shape[1]), indexing="ij")
    return np.fft.ifft2(_poisson_spectrum(np.fft.fft2(row), np.fft.fft2(col), k0, k1)).real


def integrate(gradient: DataFrame, keys: list[str] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """scan_row, scan_col, com_row, com_col to phase. shape: that of the phase (else the gradient's own); rows beyond it still count, see
    fourier.to_array. An image is spread over the tasks, but one of several (with keys) without a shape is one task's array."""
    if shape is None and not keys:
        shape = fourier.shape_of(gradient, ["scan_row", "scan_col"])
    if shape is not None:
        f = lambda r, c, u, w: _poisson_spectrum(r, c, *(np.fft.fftfreq(n)[k] for n, k in zip(shape, (u, w), strict=True)))
        return fourier.filtered(gradient, ["scan_row", "scan_col"], ["com_row", "com_col"], shape, "phase", f, keys or [])
    return fourier.per_image(gradient, keys or [], ["scan_row", "scan_col"], ["com_row", "com_col"], {"phase": "double"}, lambda r, c: {"phase": poisson_phase(r, c)}, shape)


def run(source: Scan | DataFrame, rotation_deg: float | None = None, steps: int = 180, mask: Column | None = None) -> tuple[DataFrame, DataFrame, float, bool]:
    """Centred and rotated centre of mass, phase, rotation and transposition."""
    com = centered(center_of_mass(source, mask)).cache()
    one_dataset(com)
    angle, transposed = find_rotation(com, steps) if rotation_deg is None else (rotation_deg, False)
    turned = rotated(com, angle, transposed)
    gradient = turned.select("scan_row", "scan_col", *([F.col("com_col").alias("com_row"), F.col("com_row").alias("com_col")] if transposed else ["com_row", "com_col"]))
    return turned, integrate(gradient, shape=source.scan_shape if isinstance(source, Scan) else None), angle, transposed


def service_modes(com: DataFrame) -> DataFrame:
    """What the service shows of the absolute centre of mass: its parts, and its magnitude for both magnitude and DPC."""
    m = F.hypot("com_row", "com_col")
    return com.select(*keys_of(com), F.col("com_col").alias("com_x"), F.col("com_row").alias("com_y"), m.alias("com_mag"), m.alias("dpc"))


def angles(spark: SparkSession, steps: int) -> DataFrame:
    return spark.range(steps).select(F.col("id").cast("int").alias("angle_index"), F.degrees(F.col("id") * math.pi / (steps - 1)).alias("angle_deg"))
