"""Single-sideband ptychography: double-overlap correction per bright-field pixel, object, phase, loss and fits.

A prepared table has one row for each bright-field pixel with the scan spectrum of its image. An evaluation maps
over it: every task adds up its pixels for all candidates and hands on one row for each, so what is shuffled does
not grow with the number of bright-field pixels. Fits are loops of such evaluations on the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fourier, optics

#: Fixed ranges of the search: defocus (nm), astigmatism (nm) and its angle (degrees).
RANGES = {"C10": (-400.0, 400.0), "C12": (0.0, 100.0), "phi12": (-90.0, 90.0)}

#: Numbers that a task's sums over bright-field pixels have at most (64 MB), if those of one candidate are no more.
SUMS = 1 << 23


@dataclass(frozen=True)
class Geometry:
    """voltage (kV), convergence semi-angle (mrad), scan step (A), detector step (mrad per pixel), centre, rotation (degrees)."""

    voltage_kV: float
    semiangle_mrad: float
    scan_shape: tuple[int, int]
    scan_step_A: tuple[float, float]
    det_step_mrad: tuple[float, float]
    center: tuple[float, float]
    rotation_deg: float = 0.0

    @property
    def wavelength(self) -> float:
        return optics.wavelength_A(self.voltage_kV)


@dataclass(frozen=True)
class Aberrations:
    """Either the three of a fit (A, rad) or any of the fourteen polar coefficients (A, rad)."""

    C10: float = 0.0
    C12: float = 0.0
    phi12: float = 0.0
    more: dict[str, float] = field(default_factory=dict)
    angles: dict[str, float] = field(default_factory=dict)

    def chi(self, alpha: np.ndarray, phi: np.ndarray, wavelength: float) -> np.ndarray:
        return optics.chi_polar_array(alpha, phi, {"C10": self.C10, "C12": self.C12, **self.more}, {"C12": self.phi12, **self.angles}, wavelength)


def default_det_step(semiangle_mrad: float, bf_radius: float) -> float:
    """Where no calibration is given: twice the semi-angle over the detected radius (the convention in use, kept as it is)."""
    return 2 * semiangle_mrad / bf_radius


def det_frequencies(rows: np.ndarray, cols: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """1 / A, turned by the rotation."""
    kr, kc = ((x - c) * s * 1e-3 / g.wavelength for x, c, s in zip((rows, cols), g.center, g.det_step_mrad, strict=True))
    a = math.radians(g.rotation_deg)
    return kr * math.cos(a) - kc * math.sin(a), kr * math.sin(a) + kc * math.cos(a)


def _probe(kr: np.ndarray, kc: np.ndarray, g: Geometry, theta: Aberrations) -> np.ndarray:
    """Aperture (soft over a detector pixel) times the aberrations' phase."""
    alpha, phi = np.hypot(kr, kc) * g.wavelength, np.arctan2(kc, kr)
    width = np.hypot(np.cos(phi) * g.det_step_mrad[0], np.sin(phi) * g.det_step_mrad[1]) * 1e-3
    aperture = np.clip((g.semiangle_mrad * 1e-3 - alpha) / width + 0.5, 0, 1)
    return aperture * np.exp(-1j * theta.chi(alpha, phi, g.wavelength))


def corrected(spectrum: np.ndarray, kr: float, kc: float, dc: complex, g: Geometry, theta: Aberrations) -> np.ndarray:
    """The object wave that one bright-field pixel gives: its spectrum with the overlap's phase taken off."""
    qr, qc = np.meshgrid(np.fft.fftfreq(g.scan_shape[0], g.scan_step_A[0]), np.fft.fftfreq(g.scan_shape[1], g.scan_step_A[1]), indexing="ij")
    own = _probe(np.array(kr), np.array(kc), g, theta)
    overlap = _probe(kr - qr, kc - qc, g, theta) * np.conj(own) - np.conj(_probe(kr + qr, kc + qc, g, theta)) * own
    out = spectrum * np.conj(overlap) / np.maximum(np.abs(overlap), 1e-8)
    out[0, 0] = dc
    return np.fft.ifft2(out)


def prepare(columns: DataFrame, bf: DataFrame, g: Geometry, gain: DataFrame | None = None) -> DataFrame:
    """columns: bf_idx, scan_row, scan_col, n. bf: bf_idx, det_row, det_col. gain: det_row, det_col, gain.
    One row for each bright-field pixel: bf_idx, k_row, k_col, re, im (the scan spectrum, row by row). Rows beyond the geometry's
    scan_shape (a last, incomplete one) count in it, see fourier.to_array."""
    if gain is not None:
        gains = bf.join(gain, ["det_row", "det_col"]).select("bf_idx", "gain")
        columns = columns.join(F.broadcast(gains), "bf_idx").select("bf_idx", "scan_row", "scan_col", (F.col("n") * F.col("gain")).alias("n"))
    shape = g.scan_shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.fft2(fourier.to_array(pdf, ["scan_row", "scan_col"], "n", shape))
        kr, kc = det_frequencies(pdf["det_row"].to_numpy()[:1].astype(float), pdf["det_col"].to_numpy()[:1].astype(float), g)
        return pd.DataFrame({"bf_idx": [int(pdf["bf_idx"].iloc[0])], "k_row": kr, "k_col": kc, "re": [f.real.ravel()], "im": [f.imag.ravel()]})

    named = columns.join(F.broadcast(bf), "bf_idx")
    return named.groupBy("bf_idx").applyInPandas(run, "bf_idx int, k_row double, k_col double, re array<double>, im array<double>")


def dc_value(prepared: DataFrame) -> complex:
    re, im = prepared.agg(F.avg(F.col("re")[0]), F.avg(F.col("im")[0])).first()
    return complex(re, im)


def moments(prepared: DataFrame, g: Geometry, candidates: Sequence[Aberrations], dc: complex | None = None) -> DataFrame:
    """candidate, row, col, n, phase, phase_sq, re, im: sums over bright-field pixels of the corrected waves."""
    dc, shape, todo = dc_value(prepared) if dc is None else dc, g.scan_shape, list(candidates)
    names = ["phase", "phase_sq", "re", "im"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((len(todo), 4, shape[0] * shape[1])), 0
        for pdf in parts:
            for kr, kc, re, im in zip(pdf["k_row"], pdf["k_col"], pdf["re"], pdf["im"], strict=True):
                spectrum = (np.asarray(re) + 1j * np.asarray(im)).reshape(shape)
                for i, theta in enumerate(todo):
                    wave = corrected(spectrum, kr, kc, dc, g, theta).ravel()
                    phase = np.angle(wave)
                    sums[i] += (phase, phase * phase, wave.real, wave.imag)
                n += 1
        if n:
            yield pd.DataFrame({"candidate": np.arange(len(todo), dtype=np.int32), "n": n} | {c: list(sums[:, k]) for k, c in enumerate(names)})

    parts = prepared.select("k_row", "k_col", "re", "im").mapInPandas(run, "candidate int, n long, phase array<double>, phase_sq array<double>, re array<double>, im array<double>")
    each = parts.select("candidate", "n", F.posexplode(F.arrays_zip(*names)).alias("p", "s"))
    total = each.groupBy("candidate", "p").agg(F.sum("n").alias("n"), *[F.sum(f"s.{c}").alias(c) for c in names])
    return total.select("candidate", F.floor(F.col("p") / shape[1]).cast("int").alias("row"), (F.col("p") % shape[1]).cast("int").alias("col"), "n", *names)


def object_wave(sums: DataFrame) -> DataFrame:
    """re, im: the mean over bright-field pixels (by linearity the inverse transform of the mean spectrum)."""
    return sums.select("candidate", "row", "col", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def mean_phase(sums: DataFrame) -> DataFrame:
    """The mean of the pixels' phases; not the phase of the mean wave."""
    return sums.select("candidate", "row", "col", (F.col("phase") / F.col("n")).alias("phase"))


def losses(sums: DataFrame) -> DataFrame:
    """candidate, loss: the variance of the phase over bright-field pixels, averaged over the scan."""
    mean = F.col("phase") / F.col("n")
    return sums.groupBy("candidate").agg(F.avg(F.col("phase_sq") / F.col("n") - mean * mean).alias("loss"))


def _from_units(x: Sequence[float]) -> Aberrations:
    """From nm, nm, degrees."""
    return Aberrations(x[0] * 10, x[1] * 10, math.radians(x[2]))


def nelder_mead(f: Callable[[list[np.ndarray]], list[float]], start: Sequence[float], xatol: float = 0.1, fatol: float = 1e-8, max_iter: int = 300) -> tuple[np.ndarray, float, int]:
    """The downhill simplex (1, 2, 1/2, 1/2) from a simplex 5 % wide. f takes several points, so that reflection,
    expansion and both contractions are evaluated in one go."""
    points = [np.array(start, float)]
    for i in range(len(start)):
        p = points[0].copy()
        p[i] += max(abs(p[i]) * 0.05, 0.00025)
        points.append(p)
    values, used = f(points), len(points)
    for _ in range(max_iter):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(points[-1] - points[0])) < xatol and abs(values[-1] - values[0]) < fatol:
            break
        middle = np.mean(points[:-1], axis=0)
        tries = [middle + t * (middle - points[-1]) for t in (1.0, 2.0, 0.5, -0.5)]
        reflected, expanded, outside, inside = f(tries)
        used += 4
        if reflected < values[0]:
            k, v = (1, expanded) if expanded < reflected else (0, reflected)
        elif reflected < values[-2]:
            k, v = 0, reflected
        else:
            k, v = (2, outside) if reflected < values[-1] else (3, inside)
            if v > min(reflected, values[-1]):  # the simplex shrinks
                points[1:] = [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values[1:] = f(points[1:])
                used += len(points) - 1
                continue
        points[-1], values[-1] = tries[k], v
    best = int(np.argmin(values))
    return points[best], float(values[best]), used


@dataclass(frozen=True)
class Fit:
    C10_nm: float
    C12_nm: float
    phi12_deg: float
    loss: float
    evaluations: int

    def aberrations(self) -> Aberrations:
        return _from_units((self.C10_nm, self.C12_nm, self.phi12_deg))


class SSB:
    """A reconstruction session over one prepared table."""

    def __init__(self, prepared: DataFrame, g: Geometry):
        self.prepared, self.g = prepared.cache(), g
        self.dc = dc_value(self.prepared)

    @classmethod
    def open(cls, pixels: DataFrame, bf: DataFrame, g: Geometry, gain: DataFrame | None = None) -> SSB:
        from .select import bf_columns

        return cls(prepare(bf_columns(pixels, bf), bf, g, gain), g)

    def __enter__(self) -> SSB:
        return self

    def __exit__(self, *_) -> None:
        self.prepared.unpersist()

    def set_rotation(self, degrees: float) -> SSB:
        """The same spectra with the detector turned: only the pixels' frequencies change."""
        a = math.radians(degrees - self.g.rotation_deg)
        k_row, k_col = F.col("k_row") * math.cos(a) - F.col("k_col") * math.sin(a), F.col("k_row") * math.sin(a) + F.col("k_col") * math.cos(a)
        return SSB(self.prepared.select("bf_idx", k_row.alias("k_row"), k_col.alias("k_col"), "re", "im"), replace(self.g, rotation_deg=degrees))

    def preview(self, ratio: float) -> SSB:
        """The session over every k-th bright-field pixel, k = round(1 / ratio)."""
        return SSB(self.prepared.where(F.col("bf_idx") % max(1, round(1 / ratio)) == 0), self.g)

    def moments(self, candidates: Sequence[Aberrations]) -> DataFrame:
        return moments(self.prepared, self.g, candidates, self.dc)

    def loss(self, candidates: Sequence[Aberrations]) -> list[float]:
        """In order; on large scans a few candidates at a time, see SUMS."""
        step, values = max(1, SUMS // (4 * math.prod(self.g.scan_shape))), []
        for a in range(0, len(candidates), step):
            found = dict(map(tuple, losses(self.moments(candidates[a : a + step])).collect()))
            values += [found[i] for i in range(len(found))]
        return values

    def reconstruct(self, theta: Aberrations | None = None) -> tuple[DataFrame, DataFrame]:
        """The object wave and the mean phase."""
        sums = self.moments([theta or Aberrations()]).cache()
        return object_wave(sums).drop("candidate"), mean_phase(sums).drop("candidate")

    def grid_search(self, batch: int = 20, **steps: Sequence[float]) -> Fit:
        """Over all combinations of C10, C12 (nm) and phi12 (degrees). A task holds a batch's sums at a time."""
        axes = [list(steps.get(k, (0.0,))) for k in RANGES]
        points = [(a, b, c) for a in axes[0] for b in axes[1] for c in axes[2]]
        values = [v for a in range(0, len(points), batch) for v in self.loss([_from_units(p) for p in points[a : a + batch]])]
        best = int(np.argmin(values))
        return Fit(*points[best], values[best], len(points))

    def optimize(self, trials: int = 200, seed: int = 42, batch: int = 20) -> Fit:
        """Seeded search: a third of the trials over the whole ranges, the rest around the best ones so far, closer and closer."""
        rng = np.random.default_rng(seed)
        low, high = (np.array([r[i] for r in RANGES.values()]) for i in (0, 1))
        points: list[np.ndarray] = [np.zeros(3)]
        values: list[float] = self.loss([_from_units(points[0])])
        while len(points) < trials:
            n = min(batch, trials - len(points))
            if len(points) < trials / 3:
                new = [rng.uniform(low, high) for _ in range(n)]
            else:
                best = np.argsort(values)[: max(3, len(values) // 10)]
                spread = (high - low) * 0.25 * (1 - len(points) / trials)
                new = [np.clip(points[rng.choice(best)] + rng.normal(0, 1, 3) * spread, low, high) for _ in range(n)]
            points += new
            values += self.loss([_from_units(p) for p in new])
        k = int(np.argmin(values))
        return Fit(*map(float, points[k]), values[k], len(points))

    def refine(self, start: Fit, max_iter: int = 300) -> Fit:
        x, loss, used = nelder_mead(lambda points: self.loss([_from_units(p) for p in points]), (start.C10_nm, start.C12_nm, start.phi12_deg), max_iter=max_iter)
        return Fit(*map(float, x), loss, used) if loss <= start.loss else start

    def fit(self, trials: int = 200, seed: int = 42, max_iter: int = 300) -> Fit:
        return self.refine(self.optimize(trials, seed), max_iter)


# ---- series

def series_metrics(fits: dict[str, Fit], spark) -> DataFrame:
    return spark.createDataFrame([(name, *asdict(f).values()) for name, f in fits.items()], "dataset_id string, C10_nm double, C12_nm double, phi12_deg double, loss double, evaluations long")


def natural_key(name: str) -> list:
    """Numbers in names sort by value."""
    import re

    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name)]


def reconstruct_series(sessions: dict[str, SSB], first: str | None = None, last: str | None = None, probe_reference: str | None = None, trials: int = 60) -> dict[str, tuple[Fit, DataFrame]]:
    """Sessions by name in natural order, both ends included; each fitted by itself, or all with the fit of one of them."""
    names = sorted(sessions, key=natural_key)
    names = names[names.index(first) if first else 0 : names.index(last) + 1 if last else None]
    fixed = sessions[probe_reference].fit(trials) if probe_reference else None
    out = {}
    for name in names:
        fit = fixed or sessions[name].fit(trials)
        out[name] = fit, sessions[name].reconstruct(fit.aberrations())[1]
    return out


def fourier_shift(image: np.ndarray, shift: tuple[float, float]) -> np.ndarray:
    ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(image.shape[0])[:, None] * shift[0] + np.fft.fftfreq(image.shape[1])[None, :] * shift[1]))
    out = np.fft.ifft2(np.fft.fft2(image) * ramp)
    return out if np.iscomplexobj(image) else out.real


def shifted_waves(waves: DataFrame, shifts: DataFrame) -> DataFrame:
    """waves: t, row, col, re, im; shifts: t, shift_row, shift_col. Each wave moved, a wave to a task."""

    def run(re: np.ndarray, im: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        out = fourier_shift(re + 1j * im, (r[0, 0], c[0, 0]))
        return {"re": out.real, "im": out.imag}

    return fourier.per_image(waves.join(F.broadcast(shifts), "t"), ["t"], ["row", "col"], ["re", "im", "shift_row", "shift_col"], {"re": "double", "im": "double"}, run)


def phase_aligned(waves: DataFrame) -> DataFrame:
    """Each wave turned by the global phase that it has against wave 0 (sums by wave, then a product)."""
    first = waves.where("t = 0").select("row", "col", F.col("re").alias("a"), F.col("im").alias("b"))
    both = waves.join(first, ["row", "col"])
    turn = both.groupBy("t").agg(F.atan2(F.sum(F.col("im") * F.col("a") - F.col("re") * F.col("b")), F.sum(F.col("re") * F.col("a") + F.col("im") * F.col("b"))).alias("angle"))
    turned = waves.join(F.broadcast(turn), "t")
    c, s = F.cos("angle"), F.sin("angle")
    return turned.select("t", "row", "col", (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im"))


def join_object_waves(waves: DataFrame, shifts: DataFrame | None = None, weights: dict[int, float] | None = None, align_phase: bool = True) -> DataFrame:
    """The weighted mean of the moved and phase-aligned waves: row, col, re, im."""
    if shifts is not None:
        waves = shifted_waves(waves, shifts)
    if align_phase:
        waves = phase_aligned(waves)
    if weights is None:
        return waves.groupBy("row", "col").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    total = sum(weights.values())
    if any(w < 0 for w in weights.values()) or not (math.isfinite(total) and total > 0):
        raise ValueError("weights are not negative and have a positive sum")
    table = waves.sparkSession.createDataFrame([(t, w / total) for t, w in weights.items()], "t int, w double")
    return waves.join(F.broadcast(table), "t").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"))


def time_average(waves: DataFrame, first: int, last: int) -> DataFrame:
    """The mean of the waves first to last, both included."""
    return waves.where(F.col("t").between(first, last)).groupBy("row", "col").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def running_average(waves: DataFrame, width: int) -> DataFrame:
    """Of each wave and the width - 1 before it."""
    w = Window.partitionBy("row", "col").orderBy("t").rowsBetween(1 - width, 0)
    return waves.select("t", "row", "col", F.avg("re").over(w).alias("re"), F.avg("im").over(w).alias("im"))


# ---- results on disk

def signature(g: Geometry, identity: str) -> str:
    import hashlib

    return hashlib.sha256(json.dumps([asdict(g), identity], sort_keys=True).encode()).hexdigest()


def save_result(path: str, phase: DataFrame, fit: Fit, signed: str) -> None:
    phase.write.mode("overwrite").parquet(f"{path}/phase")
    row = [(json.dumps({"fit": asdict(fit), "signature": signed}),)]
    phase.sparkSession.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_result(spark, path: str, signed: str) -> tuple[DataFrame, Fit] | None:
    """What was saved, if it was made from the same source with the same geometry."""
    found = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return (spark.read.parquet(f"{path}/phase"), Fit(**found["fit"])) if found["signature"] == signed else None
