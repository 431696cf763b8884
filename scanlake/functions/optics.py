"""Electron optics: wavelength, aberration functions and their fit. Column expressions, with plain numbers alike."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# SI constants (exact, and CODATA 2018 for the mass), and wavelengths (Angstrom) by voltage (kV).
PLANCK, CHARGE, LIGHT, MASS = 6.62607015e-34, 1.602176634e-19, 299792458.0, 9.1093837015e-31
WAVELENGTHS = {80: 0.041757160772834, 120: 0.033492152726724, 200: 0.025079340450548, 300: 0.019687489006849, 400: 0.016439434169908}
#: Radial order n and multiplicity m of the coefficients C(n, m), in order.
ORDERS = ((1, 0), (1, 2), (2, 1), (2, 3), (3, 0), (3, 2), (3, 4), (4, 1), (4, 3), (4, 5), (5, 0), (5, 2), (5, 4), (5, 6))
NAMES = tuple(f"C{n}{m}" for n, m in ORDERS)


def wavelength_A(kV: float) -> float:
    if kV in WAVELENGTHS:
        return WAVELENGTHS[kV]
    volts = kV * 1000
    return PLANCK / math.sqrt(2 * MASS * CHARGE * volts * (1 + CHARGE * volts / (2 * MASS * LIGHT**2))) * 1e10


def wavelength_column(kV: Column) -> Column:
    """Angstrom, relativistic."""
    volts = kV * 1000
    known = F.lit(PLANCK) / F.sqrt(F.lit(2 * MASS * CHARGE) * volts * (1 + F.lit(CHARGE / (2 * MASS * LIGHT**2)) * volts)) * 1e10
    for v, x in WAVELENGTHS.items():
        known = F.when(kV == v, F.lit(x)).otherwise(known)
    return known


def wavelength_nm(kV: float) -> float:
    return wavelength_A(kV) / 10


def wavelength_m(kV: float) -> float:
    return wavelength_A(kV) * 1e-10


def wavelength_m_from_eV(eV: float) -> float:
    return wavelength_m(eV / 1000)


def k_max(semiangle_mrad: float, kV: float) -> float:
    """1 / Angstrom."""
    return semiangle_mrad * 1e-3 / wavelength_A(kV)


def chi_polar(points: DataFrame, coefficients: DataFrame, wavelength: float) -> DataFrame:
    """points: point, alpha (rad), phi. coefficients: n, m, magnitude (same unit as wavelength), angle; 14 rows.
    Returns point, chi = 2 pi / wavelength * sum of C / (n + 1) * alpha^(n + 1) * cos(m (phi - angle))."""
    term = F.col("magnitude") / (F.col("n") + 1) * F.pow("alpha", F.col("n") + 1) * F.cos(F.col("m") * (F.col("phi") - F.col("angle")))
    return points.join(F.broadcast(coefficients)).groupBy("point").agg((F.lit(2 * math.pi / wavelength) * F.sum(term)).alias("chi"))


def polar_table(spark: SparkSession, magnitudes: dict[str, float], angles: dict[str, float] | None = None) -> DataFrame:
    unknown = {*magnitudes, *(angles or {})} - {*NAMES}
    if unknown:
        raise ValueError(f"unknown aberrations {sorted(unknown)}")
    rows = [(n, m, float(magnitudes.get(name, 0.0)), float((angles or {}).get(name, 0.0))) for name, (n, m) in zip(NAMES, ORDERS, strict=True)]
    return spark.createDataFrame(rows, "n int, m int, magnitude double, angle double")


def chi_polar_array(alpha: np.ndarray, phi: np.ndarray, magnitudes: dict[str, float], angles: dict[str, float], wavelength: float) -> np.ndarray:
    out = np.zeros_like(alpha, dtype=float)
    for name, (n, m) in zip(NAMES, ORDERS, strict=True):
        if magnitudes.get(name):
            out = out + magnitudes[name] / (n + 1) * alpha ** (n + 1) * np.cos(m * (phi - angles.get(name, 0.0)))
    return 2 * np.pi / wavelength * out


def cartesian_basis(x, y) -> dict[str, object]:
    """alpha^(n+1) cos(m phi) and sin(m phi), over (n + 1), as polynomials in x and y; columns, arrays or numbers.

    They follow from the real and imaginary part of (x + iy)^m times (x^2 + y^2)^((n + 1 - m) / 2)."""
    powers, re, im = {0: (1.0, 0.0)}, 1.0, 0.0
    for m in range(1, 7):
        re, im = re * x - im * y, re * y + im * x
        powers[m] = re, im
    r2 = x * x + y * y
    out: dict[str, object] = {}
    for n, m in ORDERS:
        scale = 1.0 / (n + 1)
        for _ in range((n + 1 - m) // 2):
            scale = scale * r2
        if m == 0:
            out[f"C{n}{m}"] = scale
        else:
            out[f"C{n}{m}a"], out[f"C{n}{m}b"] = scale * powers[m][0], scale * powers[m][1]
    return out


def gradient_basis(x, y) -> dict[str, tuple[object, object]]:
    """Gradients of cartesian_basis along x and y."""
    powers, re, im = {0: (1.0, 0.0)}, 1.0, 0.0
    for m in range(1, 7):
        re, im = re * x - im * y, re * y + im * x
        powers[m] = re, im
    r2 = x * x + y * y
    out: dict[str, tuple[object, object]] = {}
    for n, m in ORDERS:
        k = (n + 1 - m) // 2  # r2^k * Re or Im of z^m
        rk, rk1 = 1.0, 1.0
        for _ in range(k):
            rk, rk1 = rk * r2, rk
        scale = 1.0 / (n + 1)
        for part, name in enumerate(("", ) if m == 0 else ("a", "b")):
            p = powers[m][part]
            px, py = (0.0, 0.0) if m == 0 else (m * powers[m - 1][part], m * (-powers[m - 1][1] if part == 0 else powers[m - 1][0]))
            dx, dy = scale * rk * px, scale * rk * py
            if k:
                dx, dy = dx + scale * (2 * k) * rk1 * x * p, dy + scale * (2 * k) * rk1 * y * p
            out[f"C{n}{m}{name}"] = dx, dy
    return out


def chi_cartesian(x: Column, y: Column, coefficients: dict[str, float], wavelength: float) -> Column:
    basis = cartesian_basis(x, y)
    total = F.lit(0.0)
    for name, c in coefficients.items():
        total = total + F.lit(float(c)) * basis[name]
    return F.lit(2 * math.pi / wavelength) * total


def forward_shifts(x: Column, y: Column, coefficients: dict[str, float]) -> tuple[Column, Column]:
    """The shifts that aberrations give at angles (x, y): the gradient of their sum."""
    basis, row, col = gradient_basis(x, y), F.lit(0.0), F.lit(0.0)
    for name, c in coefficients.items():
        row, col = row + F.lit(float(c)) * basis[name][0], col + F.lit(float(c)) * basis[name][1]
    return row, col


class AberrationFitter:
    """Least squares of shifts at fixed angles; the pseudo-inverse is made once and used for many sets of shifts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: tuple[str, ...] | None = None):
        basis = gradient_basis(np.asarray(x, float), np.asarray(y, float))
        self.names = names or tuple(basis)
        ones = np.ones(len(x))
        self.design = np.concatenate([np.stack([basis[n][i] * ones for n in self.names], 1) for i in (0, 1)])
        self.inverse = np.linalg.pinv(self.design)

    def fit(self, rows: np.ndarray, cols: np.ndarray) -> dict[str, float]:
        return dict(zip(self.names, (self.inverse @ np.concatenate([rows, cols])).tolist(), strict=True))

    def fit_batch(self, shifts: DataFrame) -> DataFrame:
        """shifts: batch, bf_idx, shift_row, shift_col. Returns batch, name, value; a product with the broadcast inverse."""
        n = len(self.design) // 2
        table = shifts.sparkSession.createDataFrame([(i, name, float(self.inverse[j, i]), float(self.inverse[j, i + n])) for j, name in enumerate(self.names) for i in range(n)], "bf_idx int, name string, on_row double, on_col double")
        value = F.sum(F.col("shift_row") * F.col("on_row") + F.col("shift_col") * F.col("on_col"))
        return shifts.join(F.broadcast(table), "bf_idx").groupBy("batch", "name").agg(value.alias("value"))


def fit_polar(shifts: DataFrame, wavelength: float) -> dict[str, float]:
    """shifts: kx, ky (1 / A), shift_row, shift_col (A). C10, C12 (A), phi12 and rotation (rad): a 2 x 2 least-squares
    matrix from seven sums, split by polar decomposition into a rotation and a symmetric part."""
    x, y, r, c = F.col("kx") * wavelength, F.col("ky") * wavelength, F.col("shift_row"), F.col("shift_col")
    xx, xy, yy, xr, yr, xc, yc = shifts.agg(F.sum(x * x), F.sum(x * y), F.sum(y * y), F.sum(x * r), F.sum(y * r), F.sum(x * c), F.sum(y * c)).first()
    m = np.linalg.lstsq(np.array([[xx, xy], [xy, yy]]), np.array([[xr, xc], [yr, yc]]), rcond=None)[0]
    u, s, vt = np.linalg.svd(m)
    rotation, symmetric = u @ vt, vt.T @ np.diag(s) @ vt
    angle = float(-np.arctan2(rotation[1, 0], rotation[0, 0]))
    if 2 * abs((angle + np.pi) % (2 * np.pi) - np.pi) > np.pi:
        angle, symmetric = angle % (2 * np.pi) - np.pi, -symmetric
    a, b, d = symmetric[0, 0], (symmetric[0, 1] + symmetric[1, 0]) / 2, symmetric[1, 1]
    return {"C10": float((a + d) / 2), "C12": float(np.hypot((a - d) / 2, b)), "phi12": float(np.arctan2(b, (a - d) / 2) / 2), "rotation_angle": angle}
