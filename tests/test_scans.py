"""Operators against NumPy on small scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.functions import optics
from scanlake.operators import binning, display, dpc, image, movie, parallax, reduce, screening, select, ssb
from scanlake.plans.model import Scan, square_shape
from scanlake.sources import bitshuffle, frames, shards
from scanlake.streaming import watch


def scan_of(spark, data, **calibration):
    rows, cols, h, w = data.shape
    table = [("scan", r * cols + c, r, c, data[r, c].ravel().tolist()) for r in range(rows) for c in range(cols)]
    return Scan(spark.createDataFrame(table, "dataset_id string, frame_idx int, scan_row int, scan_col int, counts array<int>"), (rows, cols), (h, w), **calibration)


def to_array(df, rows, cols, value, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[rows], r[cols]] = r[value]
    return out


def scan_image(df, value, shape):
    return to_array(df, "scan_row", "scan_col", value, shape)


def image_of(spark, a):
    return spark.createDataFrame([(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, value double")


@pytest.fixture(scope="module")
def data():
    """A disk of radius 2.5 on noise."""
    out = np.random.default_rng(7).integers(0, 200, (4, 5, 8, 8))
    y, x = np.mgrid[:8, :8]
    out[:, :, (y - 3.5) ** 2 + (x - 3.5) ** 2 <= 6.25] += 25
    return out


@pytest.fixture(scope="module")
def scan(spark, data):
    return scan_of(spark, data, semiangle_mrad=20.0)


def distance(center):
    y, x = np.mgrid[:8, :8]
    return np.hypot(y - center[0], x - center[1])


def test_virtual_detectors(scan, data):
    mean = data.mean((0, 1))
    assert np.allclose(to_array(reduce.mean_dp(scan.pixels()), "det_row", "det_col", "value", (8, 8)), mean)
    on = mean > mean.mean() + mean.std()
    y, x = np.nonzero(on)
    probe = reduce.fitted_probe(scan)
    assert (probe.row, probe.col, probe.radius) == pytest.approx((y.mean(), x.mean(), math.sqrt(on.sum() / math.pi)))
    d, r = distance((probe.row, probe.col)), probe.radius
    for got, mask in ((reduce.bf(scan), d <= r), (reduce.adf(scan), (d >= r) & (d <= 2 * r)), (reduce.df(scan), d >= r), (reduce.adf(scan, 10, 30), (d >= 0.5 * r) & (d <= 1.5 * r)), (reduce.virtual(scan, "abf"), (d >= r / 2) & (d <= r)), (reduce.virtual(scan, "annular", inner=0.2, outer=0.9), (d >= 0.2 * r) & (d <= 0.9 * r))):
        assert (scan_image(got, "value", (4, 5)) == (data * mask).sum((2, 3))).all()


def test_probe_of_a_flat_pattern_is_the_middle(spark):
    flat = scan_of(spark, np.full((2, 2, 6, 8), 5))
    p = reduce.fitted_probe(flat)
    assert (p.row, p.col, p.radius) == (3, 4, 1.5)
    with pytest.raises(ValueError):
        reduce.to_pixels(flat, 10, "mrad", 2)


def test_exact_sums_of_large_counts(spark):
    big = scan_of(spark, np.full((2, 3, 20, 20), 100_000))
    assert {r.value for r in reduce.total_counts(big.pixels()).collect()} == {40_000_000}


def test_center_of_mass(scan, data):
    y, x = np.mgrid[:8, :8]
    total = data.sum((2, 3))
    got = dpc.center_of_mass(scan.pixels())
    assert np.allclose(scan_image(got, "com_row", (4, 5)), (data * y).sum((2, 3)) / total)
    mask = np.zeros((8, 8), bool)
    mask[2:6, 1:4] = True
    got = dpc.center_of_mass(scan.pixels(), F.col("det_row").between(2, 5) & F.col("det_col").between(1, 3))
    assert np.allclose(scan_image(got, "com_col", (4, 5)), (data * x * mask).sum((2, 3)) / (data * mask).sum((2, 3)))
    none = dpc.center_of_mass(scan.pixels(), F.lit(False))
    assert {(r.com_row, r.com_col) for r in none.collect()} == {(0.0, 0.0)}


def com_table(spark, rows, cols):
    return spark.createDataFrame([(int(r * rows.shape[1] + c), r, c, float(rows[r, c]), float(cols[r, c])) for r in range(rows.shape[0]) for c in range(rows.shape[1])], "frame_idx int, scan_row int, scan_col int, com_row double, com_col double")


def test_rotation_undoes_a_turn(spark):
    y, x = np.mgrid[:16, :20] / 6
    phase = np.sin(x) * np.cos(0.7 * y)
    row, col = np.gradient(phase)
    a = math.radians(-25)
    com = com_table(spark, math.cos(a) * row - math.sin(a) * col, math.sin(a) * row + math.cos(a) * col)
    angle, transposed = dpc.find_rotation(com, 181)
    assert (angle, transposed) == (pytest.approx(25, abs=1.5), False)
    angle, transposed = dpc.find_rotation(com.select("frame_idx", "scan_row", "scan_col", F.col("com_col").alias("com_row"), F.col("com_row").alias("com_col")), 181)
    assert transposed
    assert dpc.find_rotation(com.where("scan_row < 2")) == (0.0, False)


def test_integration_follows_the_gradient(spark):
    n = 16
    y, x = np.mgrid[:n, :n] * 2 * np.pi / n
    phase = np.sin(x) + np.cos(2 * y)
    row, col = -2 * np.sin(2 * y) * 2 * np.pi / n, np.cos(x) * 2 * np.pi / n
    got = scan_image(dpc.integrate(com_table(spark, row, col)), "phase", (n, n))
    assert abs(np.corrcoef(got.ravel(), phase.ravel())[0, 1]) > 0.999


def test_bins(scan, data, spark):
    got = binning.bin_pixels(scan.pixels(), 3, {"det_row": 8, "det_col": 8})
    assert got.where("scan_row = 1 and scan_col = 2 and det_row = 1 and det_col = 0").first().n == data[1, 2, 3:6, :3].sum()
    partial = binning.bin_pixels(scan.pixels(), 3, {"det_row": 8, "det_col": 8}, edge="partial")
    assert partial.where("scan_row = 0 and scan_col = 0 and det_row = 2 and det_col = 2").first().n == data[0, 0, 6:, 6:].sum()
    with pytest.raises(ValueError):
        binning.bin_pixels(scan.pixels(), 3, {"det_row": 8}, "mean", "partial")
    assert binning.binned_sampling(0.5, 8, 3) == (1.5, False)
    bad = frames.pixel_mask(spark, [[0, 1], [0, 0]])
    assert binning.bin_detector(scan, 8, bad).where("scan_row = 0 and scan_col = 0").first().n == data[0, 0].sum() - data[0, 0, 0, 1]


def test_packed_counts(spark):
    for n in (0, 1, 7, 8):
        v = np.arange(n) % 16
        assert (binning.unpack_uint4(binning.pack_uint4(v), n) == v).all()
        df = spark.createDataFrame([(v.tolist(),)], "c array<int>").select(binning.pack_counts(F.col("c")).alias("p"))
        assert bytes(df.first().p) == binning.pack_uint4(v)
    with pytest.raises(ValueError):
        binning.pack_uint4(np.array([16]))


def test_selections(scan, data, spark):
    crop = select.detector_crop(select.scan_crop(scan, (1, 3, 2, 5)), (2, 6, 1, 4))
    got = {(r.scan_row, r.scan_col): r.counts for r in crop.validate().frames.collect()}
    assert all(got[r, c] == data[r + 1, c + 2, 2:6, 1:4].ravel().tolist() for r in range(2) for c in range(3))
    with pytest.raises(ValueError):
        select.scan_crop(scan, (0, 9, 0, 1))
    with pytest.raises(ValueError):
        select.requested(spark, [20], (4, 5))
    with pytest.raises(ValueError):
        scan.with_frames(scan.frames.where("frame_idx > 0")).validate()
    assert select.selected_position(-3, 99, (4, 5)) == 4
    again = select.random_scan_indices(5, (4, 5), 2, 3, same_for_all_files=False)
    rng = np.random.default_rng(3)
    assert again == [rng.choice(20, 5, False).tolist() for _ in range(2)]
    assert square_shape(49) == (7, 7)
    with pytest.raises(ValueError):
        square_shape(50)


def test_screening_bundle(scan, data, tmp_path):
    path = str(tmp_path / "bundle")
    first = screening.prepared(scan, path, "source 1")
    total = scan_image(first.products, "total", (4, 5))
    assert (total == data.sum((2, 3))).all()
    again = screening.load(scan.frames.sparkSession, path, "source 1")
    assert (again.rotation_deg, again.probe) == (first.rotation_deg, first.probe) and again.phase.count() == 20
    assert screening.load(scan.frames.sparkSession, path, "source 2") is None
    assert screening.load(scan.frames.sparkSession, str(tmp_path / "none"), "source 1") is None
    assert screening.rows_per_chunk(100, 10, 2000) == 10 and screening.rows_per_chunk(1 << 28, 100, 1 << 30) == 2


def test_display_values(spark):
    values = [0.0, 1.0, 5.0, -3.0, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "row int, col int, value double")
    got = [r[0] for r in df.select(display.normalize(F.col("value"), 0, 5)).collect()]
    assert got == [0.0, 0.2, 1.0, 0.0, 0.0, 1.0, 0.0]
    assert {r[0] for r in df.select(display.normalize(F.col("value"), 2, 1)).collect()} == {0.5}
    wide = [r[0] for r in df.select(display.normalize(F.col("value"), -1.5e308, 1.5e308)).collect()][:3]
    assert wide == pytest.approx([0.5] * 3)
    h = display.histogram(df, 0, 5)
    assert sum(r["count"] for r in h.collect()) == 4 and h.count() == 256
    assert tuple(display.stats(df).first()) == pytest.approx((0.75, -3, 5, np.std([0, 1, 5, -3])))
    assert tuple(display.data_range(df.where("false")).first()) == (0, 0)
    assert tuple(display.percentile_clip(df.where("value = 1"), 1, 99).first()) == (1, 1, 1, 1)
    assert display.slider_range(0, 10, 10, 90) == (1, 9)
    with pytest.raises(ValueError):
        display.colormap_lut("none")
    assert len(display.COLORMAPS) == 15 and all(display.colormap_lut(n).shape == (256, 3) for n in display.COLORMAPS)
    assert display.colormap_lut("twilight")[[0, 255]].tolist() == [[225, 216, 226]] * 2 and display.colormap_lut("RdBu_r")[0].tolist() == [5, 48, 97]
    assert display.colormap_lut("viridis")[[0, 255]].tolist() == [[68, 1, 84], [253, 231, 37]]


def bilinear(a, y, x):
    y, x = min(max(y, 0), a.shape[0] - 1), min(max(x, 0), a.shape[1] - 1)
    r, c = int(y), int(x)
    r1, c1 = min(r + 1, a.shape[0] - 1), min(c + 1, a.shape[1] - 1)
    fy, fx = y - r, x - c
    return a[r, c] * (1 - fy) * (1 - fx) + a[r, c1] * (1 - fy) * fx + a[r1, c] * fy * (1 - fx) + a[r1, c1] * fy * fx


def test_geometry(spark):
    a = np.random.default_rng(1).random((7, 9))
    img = image_of(spark, a)
    assert image.rotate(img, a.shape, 360) is img
    got = to_array(image.rotate(img, a.shape, 30), "row", "col", "value", a.shape)
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    want = [[bilinear(a, s * (x - 4) + c * (y - 3) + 3, c * (x - 4) - s * (y - 3) + 4) for x in range(9)] for y in range(7)]
    assert np.allclose(got, want)
    for bad in (True, float("nan"), "1"):
        with pytest.raises(ValueError):
            image.rotate(img, a.shape, bad)
    line = [r.value for r in image.line_profile(img, a.shape, (0, 0), (6, 8)).orderBy("i").collect()]
    assert np.allclose(line, [bilinear(a, 6 * i / 9, 8 * i / 9) for i in range(10)])
    assert image.crop_masked(img, a.shape, (0, 0), radius=0.4) is None
    crop = image.crop_masked(img, a.shape, (3, 4), size=(4, 6))
    assert np.allclose(to_array(crop, "row", "col", "value", (4, 6)), a[1:5, 1:7])


def test_blur_and_filters(spark):
    a = np.random.default_rng(2).random((6, 8))
    k = dict(image.gaussian_kernel(1.0))
    padded = np.pad(a, 4, mode="symmetric")
    want = sum(k[i] * k[j] * padded[4 + i : 10 + i, 4 + j : 12 + j] for i in k for j in k)
    img = image_of(spark, a)
    assert np.allclose(to_array(image.gaussian_blur(img, a.shape, 1.0), "row", "col", "value", a.shape), want)
    small = image.gaussian_blur(image_of(spark, a[:2, :2]), (2, 2), 1.0)  # the kernel is wider than the image
    assert small.agg(F.sum("value")).first()[0] == pytest.approx(a[:2, :2].sum())
    for mode in ("none", "gaussian", "anscombe", "bin2", "bin4_anscombe"):
        assert image.display_filter(img, a.shape, mode, 1.0).count() == 48
    with pytest.raises(ValueError):
        image.display_filter(img, a.shape, "other")
    low = to_array(image.frequency_filter(img, "lowpass", cutoff=0.2), "row", "col", "value", a.shape)
    high = to_array(image.frequency_filter(img, "highpass", cutoff=0.2), "row", "col", "value", a.shape)
    assert np.allclose(low + high, a) and low.std() < a.std()


def test_spectra(spark):
    y, x = np.mgrid[:64, :64]
    a = 5 + np.cos(2 * np.pi * (10 * y + 6 * x) / 64)
    shape = a.shape
    mag = image.shifted(image.magnitude(image.fft2(image_of(spark, a))), shape).cache()
    assert np.allclose(to_array(mag, "row", "col", "value", shape), np.abs(np.fft.fftshift(np.fft.fft2(a))))
    peak = image.fft_peak(mag, shape, (41, 37), 3).first()
    assert (peak.row, peak.col) == (pytest.approx(42), pytest.approx(38))
    q = image.fft_quality(mag, shape).first()
    assert q.peaks == 2 and q.sharp == pytest.approx(100) and q.snr > 10
    both = image.quality_summary(image.fft_quality(mag, shape).union(image.fft_quality(mag, shape))).first()
    assert both.peaks == 4
    back = image.ifft2(image.fft2(image_of(spark, a))).select("row", "col", F.col("re").alias("value"))
    assert np.allclose(to_array(back, "row", "col", "value", shape), a)
    assert tuple(image.fft_quality(mag, (20, 64)).first()) == (None,) * 4  # too small to measure


def test_optics(spark):
    assert optics.wavelength_A(200) == 0.025079340450548
    assert optics.wavelength_A(199.999) == pytest.approx(optics.wavelength_A(200), rel=1e-4)
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 0.02, (2, 40))
    basis, grads = optics.cartesian_basis(x, y), optics.gradient_basis(x, y)
    assert len(basis) == len(grads) == 25
    e = 1e-7
    for name, (gx, gy) in grads.items():
        num = (optics.cartesian_basis(x + e, y)[name] - optics.cartesian_basis(x - e, y)[name]) / (2 * e)
        assert np.allclose(gx * np.ones(40), num, rtol=1e-4, atol=1e-9), name
        num = (optics.cartesian_basis(x, y + e)[name] - optics.cartesian_basis(x, y - e)[name]) / (2 * e)
        assert np.allclose(gy * np.ones(40), num, rtol=1e-4, atol=1e-9), name
    names = ("C10", "C12a", "C12b", "C21a")
    fitter = optics.AberrationFitter(x, y, names)
    truth = np.array([-500.0, 30.0, 20.0, 100.0])
    shifts = fitter.design @ truth
    assert list(fitter.fit(shifts[:40], shifts[40:]).values()) == pytest.approx(truth)
    table = spark.createDataFrame([(b, i, float(shifts[i] * (b + 1)), float(shifts[i + 40] * (b + 1))) for b in range(2) for i in range(40)], "batch int, bf_idx int, shift_row double, shift_col double")
    got = {(r.batch, r.name): r.value for r in fitter.fit_batch(table).collect()}
    assert got[1, "C12b"] == pytest.approx(40)
    lam, kx, ky = optics.wavelength_A(300), x / 0.02, y / 0.02
    m = np.array([[-470.0, 20.0], [20.0, -530.0]])
    a = math.radians(12)
    turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    s = np.stack([kx, ky], 1) * lam @ (turn.T @ m)
    fit = optics.fit_polar(spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([kx, ky, s])], "kx double, ky double, shift_row double, shift_col double"), lam)
    assert fit["C12"] == pytest.approx(math.hypot(30, 20), rel=1e-6) and abs(fit["C10"]) == pytest.approx(500, rel=1e-6) and abs(fit["rotation_angle"]) == pytest.approx(a, rel=1e-6)


def shifted_images(spark, step=0.15, n=3):
    rng = np.random.default_rng(11)
    f = np.fft.fft2(rng.random((24, 24)))
    f *= np.exp(-(np.fft.fftfreq(24)[:, None] ** 2 + np.fft.fftfreq(24)[None, :] ** 2) * 40)
    base = np.fft.ifft2(f).real
    rows, truth = [], {}
    for i in range(n * n):
        q, r = i // n - n // 2, i % n - n // 2
        truth[i] = (step * q, -0.12 * r)
        v = ssb.fourier_shift(base, (-truth[i][0], -truth[i][1]))
        rows += [(i, int(y), int(x), float(v[y, x])) for y in range(24) for x in range(24)]
    bf = spark.createDataFrame([(i, (i // n - n // 2) % 8, (i % n - n // 2) % 8) for i in range(n * n)], "bf_idx int, q int, r int")
    return spark.createDataFrame(rows, "bf_idx int, scan_row int, scan_col int, value double").cache(), bf, truth, base


def test_correlation_shift():
    rng = np.random.default_rng(5)
    a = np.fft.ifft2(np.fft.fft2(rng.random((32, 28))) * np.exp(-(np.fft.fftfreq(32)[:, None] ** 2 + np.fft.fftfreq(28)[None, :] ** 2) * 60)).real
    for shift in ((0, 0), (3, -5), (2.25, -1.5), (-0.4, 7.3)):
        moved = ssb.fourier_shift(a, tuple(-s for s in shift))
        assert parallax.correlation_shift(a, moved, 20) == pytest.approx(shift, abs=0.06)


def test_parallax(spark):
    images, bf, truth, base = shifted_images(spark, step=1.0)
    pairs = parallax.periodic_pairs(bf, (8, 8), 8)
    assert pairs.count() == 20
    relative = parallax.pairwise_shifts(images, pairs, (24, 24), 10)
    t = parallax.synchronize(9, relative)
    for i, (r, c) in truth.items():
        assert t[i] == pytest.approx((r - truth[0][0], c - truth[0][1]), abs=0.1)
    for by_reference in (False, True):
        got = {r.bf_idx: (r.shift_row, r.shift_col) for r in parallax.align(images, bf, (8, 8), (24, 24), (1,), 10, by_reference=by_reference).collect()}
        zero = got[4]
        assert all((got[i][0] - zero[0], got[i][1] - zero[1]) == pytest.approx(truth[i], abs=0.2) for i in truth)
    shifts = spark.createDataFrame([(i, *map(float, s)) for i, s in truth.items()], "bf_idx int, shift_row double, shift_col double")
    out = to_array(parallax.shift_and_sum(images, shifts, (24, 24)), "row", "col", "value", (24, 24))
    assert np.allclose(out, 9 * base, atol=1e-6)
    assert parallax.shift_and_sum(images, shifts, (24, 24), 2).count() == 48 * 48


def test_ssb_against_a_direct_computation(spark):
    rng = np.random.default_rng(3)
    data = rng.integers(1, 50, (6, 6, 8, 8))
    scan = scan_of(spark, data)
    bf = spark.createDataFrame([(i, 3 + i // 2, 3 + i % 2) for i in range(4)], "bf_idx int, det_row int, det_col int")
    g = ssb.Geometry(300.0, 20.0, (6, 6), (0.5, 0.5), (7.0, 7.0), (3.5, 3.5), 10.0)
    theta = ssb.Aberrations(C10=150.0, C12=30.0, phi12=0.4, more={"C30": 1e6})
    with ssb.SSB.open(scan.pixels(), bf, g) as session:
        wave, phase = session.reconstruct(theta)
        loss = session.loss([theta, ssb.Aberrations()])
    spectra = [np.fft.fft2(data[:, :, 3 + i // 2, 3 + i % 2]) for i in range(4)]
    dc = np.mean([s[0, 0] for s in spectra])
    waves = []
    for i, s in enumerate(spectra):
        kr, kc = ssb.det_frequencies(np.array([3 + i // 2]), np.array([3 + i % 2]), g)
        waves.append(ssb.corrected(s, kr[0], kc[0], dc, g, theta))
    mean = np.mean(waves, axis=0)
    assert np.allclose(to_array(wave, "row", "col", "re", (6, 6)), mean.real) and np.allclose(to_array(wave, "row", "col", "im", (6, 6)), mean.imag)
    phases = np.angle(waves)
    assert np.allclose(to_array(phase, "row", "col", "phase", (6, 6)), phases.mean(0))
    assert loss[0] == pytest.approx(phases.var(0).mean()) and len(loss) == 2
    plain = ssb.Geometry(300.0, 20.0, (6, 6), (0.5, 0.5), (7.0, 7.0), (3.5, 3.5))
    with ssb.SSB.open(scan.pixels(), bf, plain) as session:
        assert session.set_rotation(10.0).loss([theta]) == pytest.approx(loss[:1])


def test_nelder_mead_and_search(spark):
    x, v, _ = ssb.nelder_mead(lambda ps: [float((p[0] - 3) ** 2 + (p[1] + 2) ** 2 + p[2] ** 2) for p in ps], (10, 5, 1), xatol=1e-4)
    assert x == pytest.approx((3, -2, 0), abs=1e-2) and v < 1e-4
    data = np.random.default_rng(0).integers(1, 50, (4, 4, 8, 8))
    bf = spark.createDataFrame([(i, 3 + i // 2, 3 + i % 2) for i in range(4)], "bf_idx int, det_row int, det_col int")
    session = ssb.SSB.open(scan_of(spark, data).pixels(), bf, ssb.Geometry(300.0, 20.0, (4, 4), (0.5, 0.5), (7.0, 7.0), (3.5, 3.5)))
    fit = session.fit(trials=12, max_iter=3)
    assert fit.loss <= session.loss([ssb.Aberrations()])[0]
    assert session.optimize(trials=8, batch=4).C10_nm == session.optimize(trials=8, batch=4).C10_nm
    series = ssb.reconstruct_series({"a10": session, "a2": session}, probe_reference="a2", trials=4)
    assert list(series) == ["a2", "a10"]
    assert ssb.series_metrics({k: f for k, (f, _) in series.items()}, spark).count() == 2


def test_object_waves(spark):
    rng = np.random.default_rng(9)
    w = rng.random((12, 12)) + 1j * rng.random((12, 12))
    w = np.fft.ifft2(np.fft.fft2(w) * (np.hypot(np.fft.fftfreq(12)[:, None], np.fft.fftfreq(12)[None, :]) < 0.3))
    other = ssb.fourier_shift(w, (-2.25, 1.5)) * np.exp(0.7j)
    rows = [(t, r, c, float(v[r, c].real), float(v[r, c].imag)) for t, v in enumerate((w, other)) for r in range(12) for c in range(12)]
    waves = spark.createDataFrame(rows, "t int, row int, col int, re double, im double")
    shifts = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.25, -1.5)], "t int, shift_row double, shift_col double")
    for weights in (None, {0: 1.0, 1: 3.0}):
        out = ssb.join_object_waves(waves, shifts, weights)
        assert np.allclose(to_array(out, "row", "col", "re", (12, 12)), w.real) and np.allclose(to_array(out, "row", "col", "im", (12, 12)), w.imag)
    with pytest.raises(ValueError):
        ssb.join_object_waves(waves, shifts, {0: -1.0, 1: 3.0})
    assert ssb.running_average(waves, 2).count() == 288


def gif_frames(data):
    """A plain GIF reader: sizes and bytes of the frames."""
    w, h = (int.from_bytes(data[i : i + 2], "little") for i in (6, 8))
    at, out = 13 + 768, []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        at += 11
        raw = bytearray()
        while data[at]:
            raw += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        bits, place = int.from_bytes(raw, "little"), 0
        table, width, last, pixels = {}, 9, None, bytearray()
        while True:
            code = bits >> place & (1 << width) - 1
            place += width
            if code == 257:
                break
            if code == 256:
                table, width, last = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, 9, None
                continue
            entry = table[code] if code in table else last + last[:1]
            pixels += entry
            if last is not None and len(table) < 4096:
                table[len(table)] = last + entry[:1]
            last = entry
            if len(table) == 1 << width and width < 12:
                width += 1
        out.append(np.frombuffer(bytes(pixels), np.uint8).reshape(h, w))
    return out


def test_gif_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    stack = [rng.integers(0, 256, (90, 110), dtype=np.uint8), np.tile(np.arange(110, dtype=np.uint8), (90, 1))]
    assert all((a == b).all() for a, b in zip(gif_frames(movie.gif(stack)), stack, strict=True))
    rows = spark.createDataFrame([(f, r, c, int(v[r, c])) for f, v in enumerate(stack) for r in range(5) for c in range(6)], "frame int, row int, col int, level int")
    movie.save_gif(rows, (5, 6), str(tmp_path / "m.gif"))
    assert (gif_frames((tmp_path / "m.gif").read_bytes())[0] == stack[0][:5, :6]).all()


def test_codec_round_trip():
    rng = np.random.default_rng(6)
    for dtype in ("uint8", "uint16", "uint32"):
        for n in (0, 5, 8, 100, 9000, 40_001):
            v = rng.poisson(2, n).astype(dtype)
            assert (bitshuffle.decompress(bitshuffle.compress(v), dtype) == v).all()
    assert len(bitshuffle.compress(np.zeros(30_000, "uint16"))) < 1000
    for raw in (b"", b"abcd" * 3, b"a" * 1000, bytes(range(256)) * 9 + b"tail"):
        assert bitshuffle.lz4_decode(bitshuffle.lz4_encode(raw), len(raw)) == raw
    with pytest.raises(ValueError):
        bitshuffle.lz4_decode(b"\x10a\x09\x00", 5)


def test_shard_source(spark, tmp_path):
    shards.register(spark)
    counts = np.random.default_rng(8).poisson(3, (10, 4, 6)).astype("uint16")
    for k in range(2):
        shards.write_shard(str(tmp_path / f"part{k}.shard"), counts[5 * k : 5 * k + 5], "s", 5 * k)
    df = spark.read.format("scan_shards").load(str(tmp_path))
    got = {r.frame_idx: r.counts for r in df.collect()}
    assert all(got[i] == counts[i].ravel().tolist() for i in range(10))
    some = spark.read.format("scan_shards").option("firstFrame", 3).option("lastFrame", 6).load(str(tmp_path))
    assert sorted(r.frame_idx for r in some.collect()) == [3, 4, 5, 6]
    scan = frames.scan_of(df, (4, 6), (2, 5), "serpentine")
    assert scan.frames.where("frame_idx = 5").first().scan_col == 4
    scan.validate()


def test_saved_scans(scan, data, spark, tmp_path):
    path = str(tmp_path / "one")
    frames.save(scan, path, "u8", {"sample": "gold"})
    assert frames.metadata(spark, path)["sample"] == "gold"
    assert frames.load(spark, path).validate().frames.count() == 20
    assert frames.discover(spark, str(tmp_path)) == [f"file:{path}"] and frames.is_ready(spark, path)
    with pytest.raises(FileNotFoundError):
        frames.discover(spark, str(tmp_path), "two*")
    some = frames.load(spark, path, scan_indices=[3, 3, (1, 0)])
    assert [r.counts for r in some.frames.orderBy("frame_idx").collect()] == [data[0, 3].ravel().tolist()] * 2 + [data[1, 0].ravel().tolist()]
    binned = frames.load(spark, path, scan_region=(0, 2, 0, 2), det_bin=4)
    assert binned.det_shape == (2, 2) and binned.frames.where("frame_idx = 3").first().counts == data[1, 1].reshape(2, 4, 2, 4).sum((1, 3)).ravel().tolist()
    for bad in ({"scan_region": (0, 1, 0, 1), "scan_indices": [0]}, {"detector_region": (0, 1, 0, 1)}):
        with pytest.raises(ValueError):
            frames.load(spark, path, **bad)
    assert frames.load_many(spark, [path, path]).count() == 40
    assert frames.emd_sibling("/x/a_master.h5", ["b.emd", "a.emd"]) == "a.emd" and frames.emd_sibling("/x/a.h5", ["b.emd", "c.emd"]) is None
    expected = spark.createDataFrame([("scan", 21), ("other", 5)], "dataset_id string, expected int")
    assert {r.dataset_id: r.reason for r in frames.readiness(scan.frames, expected).collect()} == {"scan": "incomplete", "other": "no frames"}


def test_watched_folder(scan, spark, tmp_path):
    home = str(tmp_path)
    scan.frames.where("frame_idx < 12").coalesce(1).write.parquet(f"{home}/in/a")
    stream = watch.ready_datasets(watch.arriving(spark, f"{home}/in"), 20)
    out = spark.read.schema("dataset_id string, n_frames long").option("recursiveFileLookup", "true")
    watch.poll(stream, f"{home}/check", watch.append_to(f"{home}/out"), "update")
    assert out.parquet(f"{home}/out").count() == 0
    scan.frames.where("frame_idx >= 10").coalesce(1).write.parquet(f"{home}/in/b")  # two frames come again
    for _ in range(2):
        watch.poll(stream, f"{home}/check", watch.append_to(f"{home}/out"), "update")
    assert [tuple(r) for r in out.parquet(f"{home}/out").collect()] == [("scan", 20)]
    query = watch.watch(watch.running_products(watch.arriving(spark, f"{home}/in")), f"{home}/check2", watch.append_to(f"{home}/out2"), 1, "complete")
    watch.stop(query)
    assert not query.isActive


def test_a_dataset_rests_before_it_is_reported(scan, spark, tmp_path):
    import time

    home = str(tmp_path)
    scan.frames.coalesce(1).write.parquet(f"{home}/in/a")
    query = watch.watch(watch.ready_datasets(watch.arriving(spark, f"{home}/in"), 20, rest_ms=1500), f"{home}/check", watch.append_to(f"{home}/out"), 0.5, "update")
    out = spark.read.schema("dataset_id string, n_frames long").option("recursiveFileLookup", "true")
    try:
        found = []
        for _ in range(120):
            time.sleep(0.5)
            if (tmp_path / "out").exists() and (found := out.parquet(f"{home}/out").collect()):
                break
        assert [tuple(r) for r in found] == [("scan", 20)]
    finally:
        query.stop()
