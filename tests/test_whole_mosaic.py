"""The spectrum's quality is that of all frames, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scanlake.plans.model import embeddings_scan

SF = "/root/testdata/sf0.001"


def test_quality_is_that_of_all_frames(spark):
    scan = embeddings_scan(spark, SF)
    h, w = scan.scan_shape[0] * 8, scan.scan_shape[1] * 8
    img = np.zeros((h, w))
    for r in scan.pixels().select((F.col("scan_row") * 8 + F.col("det_row")).alias("r"), (F.col("scan_col") * 8 + F.col("det_col")).alias("c"), "n").collect():
        img[r.r, r.c] = r.n
    power = np.abs(np.fft.fftshift(np.fft.fft2(img))) ** 2
    reach = min(h, w) / 2
    r2 = (np.arange(h)[:, None] - h / 2) ** 2 + (np.arange(w)[None, :] - w / 2) ** 2
    whole = (r2 > max(2, reach * 0.015) ** 2) & (r2 < (reach - 1) ** 2)
    band = whole & (r2 >= (0.15 * reach) ** 2) & (r2 <= (0.6 * reach) ** 2)
    got = __spark_entry__.queries()["img_10_fft_quality"](spark, SF).first()
    assert got.sharp == pytest.approx(100 * power[band].sum() / power[whole].sum(), rel=1e-3)
