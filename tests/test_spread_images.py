"""Transforms of images whose rows and columns are spread over the tasks."""

import duckdb
import numpy as np
import pytest

from scanlake.functions import fourier
from scanlake.operators import dpc, image
from scanlake.plans import catalog, queries_image  # noqa: F401


def rows_of(spark, a: np.ndarray, axes=("row", "col")):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(a)], f"{axes[0]} int, {axes[1]} int, value double")


def array_of(df, value: str, shape, axes=("row", "col")) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.select(*axes, value).collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.mark.parametrize("limit", [0, 1024])
def test_lines_by_fft_and_by_sums(monkeypatch, limit):
    monkeypatch.setattr(fourier, "DIRECT", limit)
    a = np.random.default_rng(2).normal(5, 2, (3, 41))
    whole = np.pad(a, ((0, 0), (0, 19))).reshape(3, 3, 20).sum(1)
    assert np.allclose(fourier.turned(a, 20), np.fft.fft(whole)) and np.allclose(fourier.turned(a * 1j, 20, inverse=True), np.fft.ifft(whole * 1j))


def test_transforms_are_those_of_the_whole_image(spark, monkeypatch):
    """With groups of a few lines; a row beyond the shape counts as if it were a period earlier."""
    monkeypatch.setattr(fourier, "GROUP", 100)
    a = np.random.default_rng(4).normal(5, 2, (32, 14))
    a[31, 3:] = 0
    folded = a[:31].copy()
    folded[0] += a[31]
    f = image.fft2(rows_of(spark, a), shape=(31, 14)).cache()
    assert np.allclose(array_of(f, "re", (31, 14)) + 1j * array_of(f, "im", (31, 14)), np.fft.fft2(folded))
    assert np.allclose(array_of(image.ifft2(f, shape=(31, 14)), "re", (31, 14)), folded)
    u, w = np.abs(np.fft.fftfreq(31))[:, None] * 2, np.abs(np.fft.fftfreq(14))[None, :] * 2
    mask = image.frequency_mask(np.minimum(1, np.hypot(u, w)), "lowpass", cutoff=0.3)
    low = image.frequency_filter(rows_of(spark, a), "lowpass", shape=(31, 14), cutoff=0.3)
    assert np.allclose(array_of(low, "value", (31, 14)), np.fft.ifft2(np.fft.fft2(folded) * mask).real)
    at = ("scan_row", "scan_col")
    gradient = rows_of(spark, a, at).selectExpr(*at, "value as com_row", "value * 2 as com_col")
    assert np.allclose(array_of(dpc.integrate(gradient, shape=(31, 14)), "phase", (31, 14), at), dpc.poisson_phase(folded, 2 * folded))
    with pytest.raises(ValueError):
        image.fft2(rows_of(spark, a), shape=(0, 14))


def test_a_task_holds_a_few_lines(spark, monkeypatch):
    """Groups are as large as GROUP, or one line, whatever the image's size."""
    monkeypatch.setattr(fourier, "GROUP", 600)
    for n in (60, 240):
        img = rows_of(spark, np.ones((n, 30)))
        for k, length in ((0, n), (1, 30)):
            held = fourier._by_lines(img, [], ["row", "col"], k, length, [("value", None)], ["size"], lambda a, _: [np.full(a[0].shape, float(a[0].size))])
            assert held.agg({"size": "max"}).first()[0] <= 600
            assert held.count() == n * 30


@pytest.mark.parametrize("n", [506, 534])
def test_quality_with_an_incomplete_row(spark, tmp_path, n):
    duckdb.sql(f"copy (select i as vec_id, embedding, label from range({n}) t(i) join '/root/testdata/sf0.001/embeddings.parquet' on vec_id = i % 500 order by i) to '{tmp_path}/embeddings.parquet' (format parquet)")
    frames = duckdb.sql(f"select embedding from '{tmp_path}/embeddings.parquet' order by vec_id").fetchnumpy()["embedding"]
    rows = n // 25
    img = np.zeros((rows * 8, 200))
    for i, e in enumerate(frames):
        r, c = i // 25 % rows * 8, i % 25 * 8
        img[r : r + 8, c : c + 8] += np.floor((np.array(e, np.float64).reshape(8, 8) + 1) * 100)
    power = np.abs(np.fft.fftshift(np.fft.fft2(img))) ** 2
    h, w = img.shape
    reach = min(h, w) / 2
    r2 = (np.arange(h)[:, None] - h / 2) ** 2 + (np.arange(w)[None, :] - w / 2) ** 2
    whole = (r2 > max(2, reach * 0.015) ** 2) & (r2 < (reach - 1) ** 2)
    band = whole & (r2 >= (0.15 * reach) ** 2) & (r2 <= (0.6 * reach) ** 2)
    got = catalog.QUERIES["img_10_fft_quality"](spark, str(tmp_path)).first()
    assert got.sharp == pytest.approx(100 * power[band].sum() / power[whole].sum(), abs=1e-3)
