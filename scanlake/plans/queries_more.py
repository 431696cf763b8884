"""Further queries: variants and helpers of the operators that the other modules register."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import optics
from ..operators import binning, image, movie, parallax, reduce, select, ssb
from .catalog import query, rounded as r6
from .model import SQL_FRAMES, SQL_PIXELS, embeddings_scan
from .queries_image import _bf, _bf_images, _session, _stacks, _waves, six, totals
from .scratch import scratch

W = f"WITH {SQL_PIXELS}"
K = "frame_idx, scan_row, scan_col"


@query("sel_13_scan_roi_masks", f"WITH {SQL_FRAMES} SELECT CAST(count(*) FILTER (WHERE (scan_row-8)*(scan_row-8)+(scan_col-9)*(scan_col-9) <= 25) AS BIGINT) AS circle, CAST(count(*) FILTER (WHERE abs(scan_row-8) <= 3 AND abs(scan_col-9) <= 3) AS BIGINT) AS square, CAST(count(*) FILTER (WHERE abs(scan_row-8) <= 2 AND abs(scan_col-9) <= 6) AS BIGINT) AS rect FROM frames")
def _(spark, d):
    at = F.col("scan_row"), F.col("scan_col")
    masks = {"circle": dict(radius=5), "square": dict(radius=3), "rect": dict(half=(2, 6))}
    return embeddings_scan(spark, d).frames.agg(*[F.count_if(select.roi(*at, k, (8, 9), **o)).alias(k) for k, o in masks.items()])


@query("ty_03_narrowed", f"{W} SELECT CAST(max(n) AS INTEGER) AS most, CAST(sum(n) AS BIGINT) AS total FROM pixels")
def _(spark, d):
    """Counts in the narrowest type that loses nothing."""
    from ..sources import frames

    scan = embeddings_scan(spark, d)
    px = scan.with_frames(frames.narrowed(scan.frames, "auto")).pixels()
    return px.agg(F.max("n").cast("int").alias("most"), F.sum("n").alias("total"))


@query("ty_05_lossless_u8", f"{W} SELECT det_row, det_col, max(n) AS most, count(*) FILTER (WHERE n > 150) AS over FROM pixels GROUP BY ALL")
def _(spark, d):
    return embeddings_scan(spark, d).pixels().groupBy("det_row", "det_col").agg(F.max("n").alias("most"), F.count_if(F.col("n") > 150).alias("over"))


@query("ty_07_checked_sums", f"{W} SELECT CAST(sum(n) AS BIGINT) AS total FROM pixels")
def _(spark, d):
    px = embeddings_scan(spark, d).pixels()
    binning.check_sums(px, 64)
    return px.agg(F.sum("n").alias("total"))


@query("bin_06_prepared_bins", f"{W} SELECT scan_row, scan_col, det_row // 4 AS det_row, det_col // 4 AS det_col, CAST(sum(n) AS BIGINT) AS n FROM pixels GROUP BY ALL")
def _(spark, d):
    """Detector bins of 4, kept as a table and read back."""
    binned = binning.bin_detector(embeddings_scan(spark, d), 4).drop("dataset_id")
    binned.write.parquet(path := scratch(spark, "bins"))
    return spark.read.parquet(path)


@query("bin_07_sampling", "SELECT CAST(f AS INTEGER) AS factor, 0.5e0 * f AS sampling, 25 % f = 0 AS uniform FROM (SELECT unnest(range(1, 7)) AS f)")
def _(spark, d):
    rows = [(f, *binning.binned_sampling(0.5, 25, f)) for f in range(1, 7)]
    return spark.createDataFrame(rows, "factor int, sampling double, uniform boolean")


@query("agg_03_exact_sum", f"{W} SELECT {K}, CAST(sum(CASE WHEN det_row = det_col THEN n * 1000000000 ELSE 0 END) AS BIGINT) AS value FROM pixels GROUP BY ALL")
def _(spark, d):
    """Sums beyond 32 bits stay exact."""
    px = embeddings_scan(spark, d).pixels().withColumn("n", F.col("n") * 1_000_000_000)
    return reduce.virtual_images(px, {"value": F.col("det_row") == F.col("det_col")})


@query("agg_07_exact_frames", f"{W} SELECT det_row, det_col, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM pixels WHERE frame_idx % 7 = 0 GROUP BY ALL")
def _(spark, d):
    return embeddings_scan(spark, d).pixels().where("frame_idx % 7 = 0").groupBy("det_row", "det_col").agg(F.sum("n").alias("total"), F.max("n").alias("most"))


@query("agg_22_custom_detector", f"{W} SELECT {K}, CAST(sum(CASE WHEN (det_row-4)*(det_row-4)+(det_col-4)*(det_col-4) BETWEEN 2.25 AND 12.25 THEN n ELSE 0 END) AS BIGINT) AS value FROM pixels GROUP BY ALL")
def _(spark, d):
    mask = select.roi(F.col("det_row"), F.col("det_col"), "annular", (4, 4), 3.5, 1.5)
    return reduce.virtual_images(embeddings_scan(spark, d), {"value": mask})


@query("agg_24_selected_frames_sum", f"{W} SELECT {K}, CAST(sum(CASE WHEN det_row < 3 THEN n ELSE 0 END) AS BIGINT) AS value FROM pixels WHERE frame_idx BETWEEN 100 AND 149 GROUP BY ALL")
def _(spark, d):
    """The filter on frames reaches the scan, so that only their row groups are read."""
    scan = embeddings_scan(spark, d)
    px = scan.with_frames(scan.frames.where(F.col("frame_idx").between(100, 149))).pixels()
    return reduce.virtual_images(px, {"value": F.col("det_row") < 3})


@query("agg_26_signed_delta", f"{W} SELECT {K}, CAST(sum(CASE WHEN det_col >= 4 THEN n ELSE 0 END) - sum(CASE WHEN det_col < 4 THEN n ELSE 0 END) AS BIGINT) AS value FROM pixels GROUP BY ALL")
def _(spark, d):
    """What changes when a detector moves: pixels that it gains minus those that it loses."""
    both = reduce.virtual_images(embeddings_scan(spark, d), {"gained": F.col("det_col") >= 4, "lost": F.col("det_col") < 4})
    return both.select(*reduce.KEYS, (F.col("gained") - F.col("lost")).alias("value"))


@query("img_02_rotated_stack", f'{W} SELECT frame_idx, CAST(7 - det_col AS INTEGER) AS "row", det_row AS col, CAST(n AS DOUBLE) AS value FROM pixels')
def _(spark, d):
    """Each frame turned by a quarter: the pixel at (r, c) goes to (width - 1 - c, r)."""
    px = embeddings_scan(spark, d).pixels()
    stack = px.select("frame_idx", F.col("det_row").alias("row"), F.col("det_col").alias("col"), F.col("n").cast("double").alias("value"))
    return six(image.rotate(stack, (8, 8), 90.0, by=["frame_idx"]), "value")


@query("img_16_local_maxima", f"""{W}, img AS (SELECT scan_row AS "row", scan_col AS col, CAST(sum(n) AS DOUBLE) AS value FROM pixels GROUP BY ALL)
SELECT a."row", a.col, a.value FROM img a JOIN img b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) GROUP BY ALL HAVING a.value > max(b.value)""")
def _(spark, d):
    return image.local_maxima(totals(spark, d)[0])


@query("dsp_15_unit_scaled", f"""{W}, img AS (SELECT scan_row AS "row", scan_col AS col, CAST(sum(n) AS DOUBLE) AS value FROM pixels GROUP BY ALL), e AS (SELECT min(value) AS a, max(value) AS b FROM img) SELECT "row", col, {r6('(value - a) / (b - a)')} AS value FROM img, e""")
def _(spark, d):
    return six(image.unit_scaled(totals(spark, d)[0]), "value")


# ---- optics

@query("opt_02_wavelength_units", "SELECT CAST(v AS INTEGER) AS kV, round(l / 10, 12) AS nm, round(l * 100, 10) AS pm FROM (VALUES (80, 0.041757160772834e0), (200, 0.025079340450548e0), (300, 0.019687489006849e0)) t(v, l)")
def _(spark, d):
    return spark.createDataFrame([(v, round(optics.wavelength_nm(v), 12), round(optics.wavelength_m_from_eV(v * 1000.0) * 1e12, 10)) for v in (80, 200, 300)], "kV int, nm double, pm double")


@query("opt_03_k_max", "SELECT CAST(a AS INTEGER) AS mrad, round(a * 0.001e0 / 0.019687489006849e0, 9) AS k_max FROM (SELECT unnest(range(10, 40, 5)) AS a)")
def _(spark, d):
    return spark.createDataFrame([(a, round(optics.k_max(a, 300), 9)) for a in range(10, 40, 5)], "mrad int, k_max double")


@query("opt_06_gradients", f"SELECT CAST(i AS INTEGER) AS point, {r6('x * (x * x + y * y)', 9)} AS c30_x, {r6('(3 * x * x - 3 * y * y) / 3', 9)} AS c23_x, {r6('(3 * x * x + y * y) / 3', 9)} AS c21a_x FROM (SELECT i, (i % 10) * 0.1e0 AS x, (i // 10) * 0.2e0 AS y FROM (SELECT unnest(range(60)) AS i))")
def _(spark, d):
    at = spark.range(60).select(F.col("id").cast("int").alias("point"), ((F.col("id") % 10) * 0.1).alias("x"), (F.floor(F.col("id") / 10) * 0.2).alias("y"))
    g = optics.gradient_basis(F.col("x"), F.col("y"))
    return six(at.select("point", g["C30"][0].alias("c30_x"), g["C23a"][0].alias("c23_x"), g["C21a"][0].alias("c21a_x")), "c30_x", "c23_x", "c21a_x", digits=9)


_TRUE = {"C10": -500.0, "C12a": 30.0, "C12b": 20.0, "C21a": 900.0}


@query("opt_07_fitted_batch", "SELECT CAST(b AS INTEGER) AS batch, name, v * (b + 1) AS value FROM (VALUES ('C10', -500e0), ('C12a', 30e0), ('C12b', 20e0), ('C21a', 900e0)) t(name, v), (SELECT unnest(range(3)) AS b)")
def _(spark, d):
    """The coefficients come back from the shifts that they give."""
    x, y = [(i % 6 - 2.5) * 0.004 for i in range(36)], [(i // 6 - 2.5) * 0.004 for i in range(36)]
    fitter = optics.AberrationFitter(x, y, tuple(_TRUE))
    at = spark.createDataFrame([(i, x[i], y[i]) for i in range(36)], "bf_idx int, x double, y double")
    row, col = optics.forward_shifts(F.col("x"), F.col("y"), _TRUE)
    batches = spark.range(3).select(F.col("id").cast("int").alias("batch"))
    shifts = at.select("bf_idx", row.alias("r"), col.alias("c")).join(F.broadcast(batches)).select("batch", "bf_idx", (F.col("r") * (F.col("batch") + 1)).alias("shift_row"), (F.col("c") * (F.col("batch") + 1)).alias("shift_col"))
    return six(fitter.fit_batch(shifts), "value", digits=4)


# ---- parallax and ptychography

@query("par_02_bf_images", f"{W} SELECT CAST((det_row - 3) * 3 + det_col - 3 AS INTEGER) AS bf_idx, {r6('avg(n)')} AS mean, CAST(sum(n) AS BIGINT) AS total FROM pixels WHERE det_row BETWEEN 3 AND 5 AND det_col BETWEEN 3 AND 5 GROUP BY 1")
def _(spark, d):
    images, _ = _bf_images(spark, d)
    return images.groupBy("bf_idx").agg(F.round(F.avg("value"), 6).alias("mean"), F.sum("value").cast("long").alias("total"))


@query("par_07_synchronized", "SELECT CAST(i AS INTEGER) AS node, (i // 3) * 1.5e0 AS \"row\", (i % 3) * -0.5e0 + 0.0 AS col FROM (SELECT unnest(range(9)) AS i)")
def _(spark, d):
    """Absolute shifts from the differences along a grid's edges."""
    pairs = parallax.periodic_pairs(_bf(spark), (8, 8))
    rel = pairs.select("i", "j", ((F.floor(F.col("j") / 3) - F.floor(F.col("i") / 3)) * 1.5).alias("shift_row"), ((F.col("j") % 3 - F.col("i") % 3) * -0.5).alias("shift_col"))
    t = parallax.synchronize(9, rel)
    return spark.createDataFrame([(i, round(float(a), 6) + 0.0, round(float(b), 6) + 0.0) for i, (a, b) in enumerate(t)], "node int, row double, col double")


@query("par_11_fitted_polar", "SELECT -500e0 AS \"C10\", 50e0 AS \"C12\"")
def _(spark, d):
    lam = optics.wavelength_A(300)
    at = spark.range(25).select(((F.col("id") % 5 - 2) * 0.1).alias("kx"), ((F.floor(F.col("id") / 5) - 2) * 0.1).alias("ky"))
    shifts = at.select("kx", "ky", (F.col("kx") * lam * -470.0 + F.col("ky") * lam * 40.0).alias("shift_row"), (F.col("kx") * lam * 40.0 + F.col("ky") * lam * -530.0).alias("shift_col"))
    fit = optics.fit_polar(shifts, lam)
    sign = -1.0 if fit["C10"] > 0 else 1.0
    return spark.createDataFrame([(round(sign * fit["C10"], 6), round(fit["C12"], 6))], "C10 double, C12 double")


@query("ssb_03_geometry", f"SELECT CAST(i AS INTEGER) AS bf_idx, {r6('kr * cos(0.2e0) - kc * sin(0.2e0)')} AS k_row, {r6('kr * sin(0.2e0) + kc * cos(0.2e0)')} AS k_col FROM (SELECT i, (3 + i // 3 - 4) * 7 * 0.001e0 / 0.019687489006849e0 AS kr, (3 + i % 3 - 4) * 7 * 0.001e0 / 0.019687489006849e0 AS kc FROM (SELECT unnest(range(9)) AS i))")
def _(spark, d):
    import numpy as np

    g = ssb.Geometry(300.0, 20.0, (20, 25), (0.5, 0.5), (7.0, 7.0), (4.0, 4.0), math.degrees(0.2))
    kr, kc = ssb.det_frequencies(np.array([3.0 + i // 3 for i in range(9)]), np.array([3.0 + i % 3 for i in range(9)]), g)
    return spark.createDataFrame([(i, round(float(kr[i]), 6) + 0.0, round(float(kc[i]), 6) + 0.0) for i in range(9)], "bf_idx int, k_row double, k_col double")


@query("ssb_08_loss_is_variance")
def _(spark, d):
    s = _session(spark, d)
    return six(ssb.losses(s.moments([ssb.Aberrations(C10=50.0, C12=10.0, phi12=0.3)])), "loss")


@query("ssb_15_preview")
def _(spark, d):
    _, phase = _session(spark, d).preview(0.5).reconstruct()
    return six(phase, "phase", digits=5)


@query("ssb_12_refined")
def _(spark, d):
    s = _session(spark, d)
    fit = s.refine(s.grid_search(C10=(10.0,), C12=(5.0,), phi12=(10.0,)), max_iter=3)
    return spark.createDataFrame([(round(fit.loss, 6), fit.evaluations)], "loss double, evaluations long")


@query("ssb_21_gain", f"{W} SELECT CAST((det_row - 3) * 3 + det_col - 3 AS INTEGER) AS bf_idx, {r6('sum(n * (1 + det_row / 8e0))', 4)} AS re FROM pixels WHERE det_row BETWEEN 3 AND 5 AND det_col BETWEEN 3 AND 5 GROUP BY 1")
def _(spark, d):
    """The zero frequency of each pixel's spectrum is its sum, times the gain."""
    scan = embeddings_scan(spark, d)
    bf = _bf(spark).select("bf_idx", "det_row", "det_col")
    gain = spark.createDataFrame([(r, c, 1 + r / 8) for r in range(8) for c in range(8)], "det_row int, det_col int, gain double")
    g = ssb.Geometry(300.0, 20.0, scan.scan_shape, (0.5, 0.5), (7.0, 7.0), (4.0, 4.0))
    return ssb.prepare(select.bf_columns(scan.pixels(), bf), bf, g, gain).select("bf_idx", F.round(F.col("re")[0], 4).alias("re"))


@query("ssb_22_running_average", f"""WITH {SQL_PIXELS}, wv AS (SELECT label AS t, det_row AS "row", det_col AS col, CAST(sum(n) AS DOUBLE) / 1000 AS re, CAST(sum(n * scan_row) AS DOUBLE) / 10000 AS im FROM pixels GROUP BY ALL) SELECT t, "row", col, {r6('avg(re) OVER w')} AS re, {r6('avg(im) OVER w')} AS im FROM wv WINDOW w AS (PARTITION BY "row", col ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return six(ssb.running_average(_waves(spark, d), 3), "re", "im")


@query("ssb_29_bf_columns_saved", f"{W} SELECT CAST((det_row - 3) * 3 + det_col - 3 AS INTEGER) AS bf_idx, CAST(sum(n) AS BIGINT) AS total FROM pixels WHERE det_row BETWEEN 3 AND 5 AND det_col BETWEEN 3 AND 5 GROUP BY 1")
def _(spark, d):
    """Exact bright-field columns, kept clustered by pixel and read back."""
    cols = select.bf_columns(embeddings_scan(spark, d).pixels(), _bf(spark).select("bf_idx", "det_row", "det_col"))
    cols.repartitionByRange("bf_idx").sortWithinPartitions("bf_idx", "scan_row", "scan_col").write.parquet(path := scratch(spark, "columns"))
    return spark.read.parquet(path).groupBy("bf_idx").agg(F.sum("n").alias("total"))


# ---- sources, movies, streams

@query("io_09_many", f"{W} SELECT CAST(k AS INTEGER) AS part, CAST(sum(n) AS BIGINT) AS total FROM pixels, (SELECT unnest(range(2)) AS k) GROUP BY k")
def _(spark, d):
    from ..sources import frames

    paths = [scratch(spark, f"many{k}") for k in range(2)]
    for p in paths:
        frames.save(embeddings_scan(spark, d), p)
    both = frames.load_many(spark, paths)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    return both.groupBy(F.regexp_extract("dataset_id", r"many(\d)", 1).cast("int").alias("part")).agg(F.sum(total).alias("total"))


@query("io_11_sparse_read", f"{W} SELECT frame_idx % 100 AS req_pos, CAST(sum(n) AS BIGINT) AS total FROM pixels WHERE frame_idx IN (100, 101, 102, 103, 140) GROUP BY 1")
def _(spark, d):
    from ..sources import frames

    frames.save(embeddings_scan(spark, d), path := scratch(spark, "sparse"))
    scan = frames.load(spark, path, scan_indices=[100, 101, 102, 103, 140])
    px = scan.pixels().groupBy("frame_idx").agg(F.sum("n").alias("total"))
    return px.select(F.when(F.col("frame_idx") == 4, 40).otherwise(F.col("frame_idx")).alias("req_pos"), "total")


@query("io_12_metadata", "SELECT CAST(count(*) // 25 AS INTEGER) AS scan_rows, 25 AS scan_cols, CAST(count(*) // 25 * 25 AS INTEGER) AS frames, 'u16' AS dtype, 'gold' AS sample FROM embeddings")
def _(spark, d):
    from ..sources import frames

    frames.save(embeddings_scan(spark, d), path := scratch(spark, "meta"), extra={"sample": "gold"})
    m = frames.metadata(spark, path)
    return spark.createDataFrame([(m["scan_rows"], m["scan_cols"], m["frames"], m["dtype"], m["sample"])], "scan_rows int, scan_cols int, frames int, dtype string, sample string")


@query("io_15_pixel_mask", "SELECT * FROM (VALUES (0, 1), (2, 0), (2, 2)) t(det_row, det_col)")
def _(spark, d):
    from ..sources import frames

    return frames.pixel_mask(spark, [[0, 1, 0], [0, 0, 0], [2, 0, 1]])


@query("io_16_discover", "SELECT 'a' AS name UNION ALL SELECT 'b'")
def _(spark, d):
    from ..sources import frames

    home = scratch(spark, "found")
    for name in ("a", "b"):
        frames.save(embeddings_scan(spark, d), f"{home}/{name}")
    return spark.createDataFrame([(p.rsplit("/", 1)[1],) for p in frames.discover(spark, home)], "name string")


@query("mov_03_bytes", "SELECT CAST(i AS INTEGER) AS i, CAST(floor(least(greatest((i - 10) / 80e0 * 255, 0), 255)) AS INTEGER) AS level FROM (SELECT unnest(range(100)) AS i)")
def _(spark, d):
    return spark.range(100).select(F.col("id").cast("int").alias("i"), movie.to_bytes(F.col("id"), F.lit(10), F.lit(90)).alias("level"))


@query("mov_01_shared_contrast", f"WITH {SQL_PIXELS}, st AS (SELECT scan_col AS movie, n AS value FROM pixels) SELECT DISTINCT movie, {r6('(SELECT quantile_cont(value, 0.05) FROM st)')} AS low, {r6('(SELECT quantile_cont(value, 0.95) FROM st)')} AS high FROM st")
def _(spark, d):
    return six(movie.contrast_limits(_stacks(spark, d), (5.0, 95.0), shared=True), "low", "high")


@query("str_04_each_frame_once", f"WITH {SQL_FRAMES} SELECT count(*) AS n FROM frames")
def _(spark, d):
    """Frames that arrive twice are kept once."""
    from ..streaming import watch

    home = scratch(spark, "once")
    frames = embeddings_scan(spark, d).frames
    for part in ("a", "b"):
        frames.coalesce(1).write.parquet(f"{home}/in/{part}")
    stream = watch.arriving(spark, f"{home}/in", files_per_trigger=1).dropDuplicates(["dataset_id", "frame_idx"])
    watch.poll(stream, f"{home}/check", watch.append_to(f"{home}/out"))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/out").agg(F.count("*").alias("n"))


@query("str_06_running_products", f"{W} SELECT CAST(label AS VARCHAR) AS dataset_id, count(DISTINCT frame_idx) AS n_frames, CAST(sum(n) AS BIGINT) AS total FROM pixels GROUP BY label")
def _(spark, d):
    from ..streaming import watch

    home = scratch(spark, "running")
    embeddings_scan(spark, d, by_label=True).frames.repartition(2, "frame_idx").write.parquet(f"{home}/in")
    latest: list[str] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/{number}")
        latest[:] = [f"{home}/out/{number}"]

    watch.poll(watch.running_products(watch.arriving(spark, f"{home}/in", files_per_trigger=1)), f"{home}/check", sink, "complete")
    return spark.read.parquet(latest[0])


def _master(spark, d: str) -> str:
    """The scan as a detector master with shards, in a folder that all machines see."""
    import os

    import numpy as np

    from ..sources import masters

    home = scratch(spark, "masters").removeprefix("file://")
    os.makedirs(home, exist_ok=True)
    mask = np.zeros((8, 8), int)
    mask[2, 5] = 1
    return masters.save_scan(f"{home}/scan", embeddings_scan(spark, d), mask, 1e-3, per_shard=200)


@query("io_03_hdf5_master", f"{W} SELECT {K}, CAST(sum(n) AS BIGINT) AS value FROM pixels GROUP BY ALL")
def _(spark, d):
    from ..sources import masters

    scan = embeddings_scan(spark, d)
    return reduce.total_counts(masters.load(spark, _master(spark, d), scan.scan_shape, tail=scan.tail).pixels())


@query("io_17_inspect_master", "SELECT true AS ready, count(*) AS found, 'uint16' AS dtype, 1000e0 AS dwell_time_us FROM embeddings")
def _(spark, d):
    from ..sources import masters

    s = masters.inspect(_master(spark, d))
    return spark.createDataFrame([(s["ready"], s["found"], s["dtype"], s["metadata"]["dwell_time_us"])], "ready boolean, found long, dtype string, dwell_time_us double")


@query("io_15_master_mask", "SELECT CAST(2 AS INTEGER) AS det_row, CAST(5 AS INTEGER) AS det_col")
def _(spark, d):
    from ..sources import masters

    return masters.read_mask(spark, _master(spark, d))
