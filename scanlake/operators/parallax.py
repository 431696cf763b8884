"""Tilt-corrected bright field: shifts between virtual bright-field images, their synchronisation, the aligned sum
and the aberrations that the shifts show."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import fourier, optics

AXES = ["scan_row", "scan_col"]


def _parabola(a: float, b: float, c: float) -> float:
    d = 4 * b - 2 * c - 2 * a
    return (c - a) / d if d else 0.0


def correlation_shift(reference: np.ndarray, image: np.ndarray, upsample: int = 2) -> tuple[float, float]:
    """The shift that moves image onto reference, to 1 / upsample of a pixel: the correlation's peak, a parabola
    through its neighbours, rounded to half pixels; beyond 2, the correlation is evaluated on a finer grid there."""
    spectrum = np.fft.fft2(reference) * np.conj(np.fft.fft2(image))
    near = np.fft.ifft2(spectrum).real
    h, w = near.shape
    r, c = np.unravel_index(int(near.argmax()), near.shape)
    at = np.array([r + _parabola(near[r - 1, c], near[r, c], near[(r + 1) % h, c]), c + _parabola(near[r, c - 1], near[r, c], near[r, (c + 1) % w])])
    at = np.round(at * 2) / 2
    if upsample > 2:
        at = np.round(at * upsample) / upsample
        n = math.ceil(1.5 * upsample)
        offsets = (np.arange(n) - math.floor(n / 2)) / upsample
        fr, fc = np.fft.fftfreq(h), np.fft.fftfreq(w)
        rows = np.exp(2j * np.pi * np.outer(at[0] + offsets, fr))
        cols = np.exp(2j * np.pi * np.outer(fc, at[1] + offsets))
        fine = (rows @ spectrum @ cols).real
        i, j = np.unravel_index(int(fine.argmax()), fine.shape)
        step = [0.0, 0.0]
        if 0 < i < n - 1 and 0 < j < n - 1:
            step = [_parabola(fine[i - 1, j], fine[i, j], fine[i + 1, j]), _parabola(fine[i, j - 1], fine[i, j], fine[i, j + 1])]
        at = at + np.array([offsets[i] + step[0] / upsample, offsets[j] + step[1] / upsample])
    return float((at[0] + h / 2) % h - h / 2), float((at[1] + w / 2) % w - w / 2)


def _image(pdf: pd.DataFrame, value: str, shape: tuple[int, int]) -> np.ndarray:
    """Positions that were not scanned (as after the end of an incomplete row) have the mean of the others, and so no contrast."""
    out = np.full(shape, pdf[value].mean())
    out[pdf[AXES[0]].to_numpy(), pdf[AXES[1]].to_numpy()] = pdf[value].to_numpy()
    return out


def reference_shifts(images: DataFrame, reference: np.ndarray, upsample: int = 2) -> DataFrame:
    """images: bf_idx, scan_row, scan_col, value. The shift of each to one reference image, an image to a task."""
    shape = reference.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = correlation_shift(reference, _image(pdf, "value", shape), upsample)
        return pd.DataFrame({"bf_idx": [int(pdf["bf_idx"].iloc[0])], "shift_row": [r], "shift_col": [c]})

    return images.groupBy("bf_idx").applyInPandas(run, "bf_idx int, shift_row double, shift_col double")


def periodic_pairs(bf: DataFrame, shape: tuple[int, int], connectivity: int = 4) -> DataFrame:
    """bf: bf_idx, q, r on a periodic grid. Pairs i < j of neighbours, each once."""
    steps = {4: [(1, 0), (-1, 0), (0, 1), (0, -1)], 8: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]}.get(connectivity)
    if steps is None:
        raise ValueError("connectivity is 4 or 8")
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    around = bf.select(F.col("bf_idx").alias("own"), F.explode(moves).alias("m"), "q", "r")
    around = around.select("own", F.pmod(F.col("q") + F.col("m.a"), F.lit(shape[0])).alias("q"), F.pmod(F.col("r") + F.col("m.b"), F.lit(shape[1])).alias("r"))
    found = around.join(bf, ["q", "r"])
    return found.select(F.least("own", "bf_idx").alias("i"), F.greatest("own", "bf_idx").alias("j")).distinct()


def pairwise_shifts(images: DataFrame, pairs: DataFrame, shape: tuple[int, int], upsample: int = 2) -> DataFrame:
    """The shift of image j against image i for each pair; a pair's two images meet in one task."""
    sides = pairs.select("i", "j", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("bf_idx")), F.struct(F.lit(1).alias("side"), F.col("j").alias("bf_idx")))).alias("s")).select("i", "j", "s.side", "s.bf_idx")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (_image(pdf[pdf["side"] == s], "value", shape) for s in (0, 1))
        r, c = correlation_shift(a, b, upsample)
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "j": [int(pdf["j"].iloc[0])], "shift_row": [r], "shift_col": [c]})

    return sides.join(images, "bf_idx").groupBy("i", "j").applyInPandas(run, "i int, j int, shift_row double, shift_col double")


def synchronize(n: int, relative: DataFrame, tolerance: float = 1e-13) -> np.ndarray:
    """Shifts of n images from those of pairs: the graph's normal equations, with image 0 at rest. The sums are
    Spark's; the driver holds a row for each pair of neighbours and solves by conjugate gradients."""
    rows = relative.groupBy("i", "j").agg(F.sum("shift_row"), F.sum("shift_col"), F.count("*")).collect()
    if n < 2 or not rows:
        return np.zeros((n, 2))
    i, j = (np.array([r[k] for r in rows]) for k in (0, 1))
    shifts, weight = np.array([r[2:4] for r in rows], float), np.array([r[4] for r in rows], float)[:, None]

    def gathered(flow: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(j, flow[:, k], n) - np.bincount(i, flow[:, k], n) for k in (0, 1)], 1)
        out[0] = 0
        return out

    x = np.zeros((n, 2))
    left = gathered(shifts)
    way, was = left.copy(), (left**2).sum(0)
    goal = was * tolerance**2
    for _ in range(4 * n):
        if (was <= goal).all():
            break
        changed = gathered(weight * (way[j] - way[i]))
        norm = (way * changed).sum(0)
        step = np.divide(was, norm, out=np.zeros(2), where=norm > 0)
        x, left = x + step * way, left - step * changed
        now = (left**2).sum(0)
        way, was = left + np.divide(now, was, out=np.zeros(2), where=was > 0) * way, now
    return x


def binned_grid(bf: DataFrame, shape: tuple[int, int], factor: int) -> DataFrame:
    """bf: bf_idx, q, r with frequency 0 in the corner. Adds q_bin, r_bin and bin_idx (numbered by q_bin, r_bin)."""
    from pyspark.sql import Window

    def binned(c: str, n: int):
        if factor == 1:
            return F.col(c)
        m = math.ceil(n / factor)
        middle = F.pmod(F.floor((F.pmod(F.col(c) + n // 2, F.lit(n)) + factor // 2) / factor), F.lit(m))
        return F.pmod(middle - m // 2, F.lit(m))

    rows = bf.withColumn("q_bin", binned("q", shape[0]).cast("int")).withColumn("r_bin", binned("r", shape[1]).cast("int"))
    if factor == 1:
        return rows.withColumn("bin_idx", F.col("bf_idx"))
    return rows.withColumn("bin_idx", (F.dense_rank().over(Window.orderBy("q_bin", "r_bin")) - 1).cast("int"))  # bright-field pixels only


def _ramp(shape: tuple[int, int], row: float, col: float) -> np.ndarray:
    return np.exp(-2j * np.pi * (np.fft.fftfreq(shape[0])[:, None] * row + np.fft.fftfreq(shape[1])[None, :] * col))


def shift_and_sum(images: DataFrame, shifts: DataFrame, shape: tuple[int, int], upsampling: int = 1) -> DataFrame:
    """The images moved by their shifts and added, as row, col, value, density; with upsampling the spectrum is tiled.
    Each image becomes its shifted spectrum in its own task; spectra are added by frequency. Only positions that were scanned come back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.fft2(_image(pdf, "value", shape)) * _ramp(shape, pdf["shift_row"].iloc[0], pdf["shift_col"].iloc[0])
        scanned = np.zeros(shape, np.int32)
        scanned[pdf[AXES[0]].to_numpy(), pdf[AXES[1]].to_numpy()] = 1
        return fourier.to_rows({"re": f.real, "im": f.imag, "scanned": scanned}, ["row", "col"])

    spectra = images.join(F.broadcast(shifts), "bf_idx").groupBy("bf_idx").applyInPandas(run, "row int, col int, re double, im double, scanned int")
    total = spectra.groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"), F.max("scanned").alias("scanned"))

    def back(re: np.ndarray, im: np.ndarray, n: np.ndarray, scanned: np.ndarray) -> dict[str, np.ndarray]:
        out = np.fft.ifft2(np.tile(re + 1j * im, (upsampling, upsampling))).real
        return {"value": out, "density": np.full(out.shape, n[0, 0]), "scanned": np.kron(scanned, np.ones((upsampling, upsampling)))}

    summed = fourier.per_image(total, [], ["row", "col"], ["re", "im", "n", "scanned"], {"value": "double", "density": "double", "scanned": "double"}, back)
    return summed.where("scanned > 0").drop("scanned")


def align(images: DataFrame, bf: DataFrame, grid_shape: tuple[int, int], scan_shape: tuple[int, int], factors: tuple[int, ...] = (3, 2, 1), upsample: int = 4, connectivity: int = 4, by_reference: bool = False) -> DataFrame:
    """Coarse to fine: images of neighbouring bright-field pixels are added in bins, the bins aligned (pair by pair, or to a
    running mean), and the shifts handed to the members. Returns bf_idx, shift_row, shift_col."""
    spark = images.sparkSession
    ids = [r[0] for r in bf.select("bf_idx").orderBy("bf_idx").collect()]  # bright-field pixels
    moved = {i: np.zeros(2) for i in ids}
    mean = None
    for step, factor in enumerate(factors, 1):
        bins = binned_grid(bf, grid_shape, factor).cache()
        table = spark.createDataFrame([(i, float(s[0]), float(s[1])) for i, s in moved.items()], "bf_idx int, shift_row double, shift_col double")
        members = images.join(F.broadcast(table), "bf_idx").join(F.broadcast(bins.select("bf_idx", "bin_idx")), "bf_idx")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            f = np.fft.fft2(_image(pdf, "value", scan_shape)) * _ramp(scan_shape, pdf["shift_row"].iloc[0], pdf["shift_col"].iloc[0])
            rows = fourier.to_rows({"value": np.fft.ifft2(f).real}, AXES)
            rows.insert(0, "bf_idx", int(pdf["bin_idx"].iloc[0]))
            return rows

        binned = members.groupBy("bf_idx").applyInPandas(run, "bf_idx int, scan_row int, scan_col int, value double").groupBy("bf_idx", *AXES).agg(F.sum("value").alias("value")).cache()
        nodes = bins.select(F.col("bin_idx").alias("bf_idx"), F.col("q_bin").alias("q"), F.col("r_bin").alias("r")).distinct()
        n = nodes.count()
        if by_reference:
            now = binned.groupBy(*AXES).agg((F.sum("value") / len(ids)).alias("value")).toPandas()  # one scan-shaped image
            now = _image(now, "value", scan_shape)
            mean = now if mean is None else mean * (step / (step + 1)) + now / (step + 1)
            found = {r[0]: (r[1], r[2]) for r in reference_shifts(binned, mean, upsample).collect()}
        else:
            m = [math.ceil(x / factor) for x in grid_shape]
            shifts = synchronize(n, pairwise_shifts(binned, periodic_pairs(nodes, (m[0], m[1]), connectivity), scan_shape, upsample))
            found = dict(enumerate(map(tuple, shifts)))
        for i, b in bins.select("bf_idx", "bin_idx").collect():
            moved[i] = moved[i] + np.array(found[b])
    return spark.createDataFrame([(i, float(s[0]), float(s[1])) for i, s in moved.items()], "bf_idx int, shift_row double, shift_col double")


@dataclass(frozen=True)
class Parallax:
    image: DataFrame
    shifts: DataFrame
    aberrations: dict[str, float]

    def ssb_parameters(self) -> dict[str, float]:
        """C10, C12 in nm, phi12 and rotation in degrees."""
        a = self.aberrations
        return {"C10_nm": a["C10"] / 10, "C12_nm": a["C12"] / 10, "phi12_deg": math.degrees(a["phi12"]), "rotation_deg": math.degrees(a["rotation_angle"])}


def run(images: DataFrame, bf: DataFrame, grid_shape: tuple[int, int], scan_shape: tuple[int, int], voltage_kV: float, scan_step_A: float, det_step: float, upsampling: int = 1, **options) -> Parallax:
    """det_step: detector pixel in 1 / A. The aligned image, the shifts, and the aberrations fitted to them."""
    shifts = align(images, bf, grid_shape, scan_shape, **options).cache()
    signed = lambda c, n: F.when(F.col(c) * 2 < n, F.col(c)).otherwise(F.col(c) - n) * F.lit(det_step)
    table = shifts.join(bf, "bf_idx").select(signed("q", grid_shape[0]).alias("kx"), signed("r", grid_shape[1]).alias("ky"), (F.col("shift_row") * scan_step_A).alias("shift_row"), (F.col("shift_col") * scan_step_A).alias("shift_col"))
    return Parallax(shift_and_sum(images, shifts, scan_shape, upsampling), shifts, optics.fit_polar(table, optics.wavelength_A(voltage_kV)))
