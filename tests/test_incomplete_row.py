"""Scans whose last row is incomplete: all of its frames count, as in the SQL."""

from dataclasses import replace

import duckdb
import numpy as np
import pytest

from scanlake.operators import parallax, ssb
from scanlake.plans import catalog, queries_image, queries_kept, queries_more, queries_scan  # noqa: F401
from scanlake.plans.model import embeddings_scan
from scanlake.sources import frames

SF = "/root/testdata/sf0.001"
#: An even and an odd number of complete rows of 25.
SIZES = (506, 534)
AS_SQL = ["scr_01_prepare", "io_26_screening_saved", "scr_01_prepare_by_dataset", "scr_06_cache_validity", "scr_07_forced_rotation", "dpc_08_integrate", "dpc_09_run", "io_03_hdf5_master", "par_10_shift_and_sum", "ssb_02_scan_spectra", "ssb_21_gain", "bin_01_all_mean", "img_05_fft_peak", "img_06_fft2", "img_07_shifted_magnitude", "img_11_frequency_filter"]


@pytest.fixture(scope="module", params=SIZES)
def folder(request, tmp_path_factory):
    """The table of vectors, grown by copies of its first rows under new keys."""
    out = tmp_path_factory.mktemp(f"n{request.param}")
    duckdb.sql(f"copy (select i as vec_id, embedding, label from range({request.param}) t(i) join '{SF}/embeddings.parquet' on vec_id = i % 500 order by i) to '{out}/embeddings.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", AS_SQL)
def test_query_as_sql(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
        found = con.execute(catalog.ORACLES[name])
        names = [x[0] for x in found.description]
        want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want and want


def test_positions_of_the_incomplete_row_are_asked_for(spark, tmp_path):
    """Frames 500 to 505, with labels that the query wants."""
    duckdb.sql(f"copy (select i as vec_id, embedding, (i % 10)::integer as label from range(506) t(i) join '{SF}/embeddings.parquet' on vec_id = i % 500) to '{tmp_path}/embeddings.parquet' (format parquet)")
    asked = catalog.QUERIES["sel_05_sparse_positions_by_dataset"](spark, str(tmp_path))
    assert {r.frame_idx for r in asked.collect()} == {i for i in range(506) if i % 50 < 10}


def test_saved_with_its_tail(spark, folder, tmp_path):
    scan = embeddings_scan(spark, folder)
    n = scan.scan_shape[0] * 25 + scan.tail
    frames.save(scan, path := str(tmp_path / "scan"))
    assert frames.is_ready(spark, path) and frames.load(spark, path).validate().tail == scan.tail and n in SIZES
    assert len(frames.discover(spark, str(tmp_path), frames=n)) == 1
    with pytest.raises(ValueError):
        replace(scan, tail=scan.tail + 1).validate()
    assert frames.load(spark, path, scan_region=(1, 4, 2, 7)).validate().frames.count() == 15


# ---- ptychography: the spectra hold the incomplete row a period earlier, as ssb_02's SQL has it; the rest against NumPy

def bright(folder: str) -> np.ndarray:
    """Counts of the 3 x 3 pixels in the middle, by pixel and frame."""
    rows = duckdb.sql(f"select floor((embedding[(3 + i // 3) * 8 + 4 + i % 3]::double + 1) * 100) from '{folder}/embeddings.parquet', range(9) t(i) order by i, vec_id").fetchnumpy()
    return np.asarray(next(iter(rows.values()))).reshape(9, -1)


class Direct:
    def __init__(self, folder: str, every: int = 1):
        counts = bright(folder)
        rows = counts.shape[1] // 25
        self.g = ssb.Geometry(300.0, 20.0, (rows, 25), (0.5, 0.5), (7.0, 7.0), (4.0, 4.0))
        self.pixels = range(0, 9, every)
        at = np.arange(counts.shape[1])
        u, w = np.arange(rows), np.arange(25)
        by_row = np.exp(-2j * np.pi * np.outer(u, at // 25) / rows)
        by_col = np.exp(-2j * np.pi * np.outer(at % 25, w) / 25)
        self.spectra = {i: by_row @ (counts[i][:, None] * by_col) for i in self.pixels}
        self.dc = np.mean([s[0, 0] for s in self.spectra.values()])

    def waves(self, theta: ssb.Aberrations) -> np.ndarray:
        k = {i: ssb.det_frequencies(np.array([3.0 + i // 3]), np.array([3.0 + i % 3]), self.g) for i in self.pixels}
        return np.array([ssb.corrected(self.spectra[i], k[i][0][0], k[i][1][0], self.dc, self.g, theta) for i in self.pixels])

    def loss(self, points) -> list[float]:
        return [float(np.angle(self.waves(ssb._from_units(p))).var(0).mean()) for p in points]


def image_rows(**images: np.ndarray) -> list[tuple]:
    shape = next(iter(images.values())).shape
    return [(r, c, *(float(v[r, c]) for v in images.values())) for r in range(shape[0]) for c in range(shape[1])]


def _object(folder):
    mean = Direct(folder).waves(ssb.Aberrations(C10=100.0, more={"C30": 1.0e7})).mean(0)
    return image_rows(re=mean.real, im=mean.imag)


def _refined(folder):
    _, loss, used = ssb.nelder_mead(Direct(folder).loss, (10.0, 5.0, 10.0), max_iter=3)
    return [(loss, used)]


def _grid(folder):
    points = [(a, b, c) for a in (-20.0, 0.0, 20.0) for b in (5.0, 10.0) for c in (0.0, 45.0)]
    return [points[int(np.argmin(Direct(folder).loss(points)))]]


DIRECT = {
    "ssb_06_object": _object,
    "ssb_07_phase": lambda f: image_rows(phase=np.angle(Direct(f).waves(ssb.Aberrations(C10=100.0))).mean(0)),
    "ssb_08_loss_is_variance": lambda f: [(0, float(np.angle(Direct(f).waves(ssb.Aberrations(50.0, 10.0, 0.3))).var(0).mean()))],
    "ssb_10_candidate_losses": lambda f: list(enumerate(Direct(f).loss([(x, 0, 0) for x in (-20, 0, 20)]))),
    "ssb_12_refined": _refined,
    "ssb_13_grid_search": _grid,
    "ssb_15_preview": lambda f: image_rows(phase=np.angle(Direct(f, 2).waves(ssb.Aberrations())).mean(0)),
}


@pytest.mark.parametrize("name", DIRECT)
def test_ptychography_against_numpy(spark, folder, name):
    got, want = sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect())), sorted(DIRECT[name](folder))
    assert len(got) == len(want) and np.allclose(got, want, rtol=0, atol=2e-4)


def test_losses_a_few_at_a_time(spark, folder, monkeypatch):
    """A task's sums don't grow with the number of candidates."""
    session, held = queries_image._session(spark, folder), []
    candidates, moments = [ssb.Aberrations(C10=x) for x in (-200.0, 0.0, 200.0, 50.0, 70.0)], ssb.moments
    want = session.loss(candidates)
    monkeypatch.setattr(ssb, "moments", lambda prepared, g, these, dc: held.append(len(these)) or moments(prepared, g, these, dc))
    monkeypatch.setattr(ssb, "SUMS", 4 * 25 * session.g.scan_shape[0] * 2 + 7)
    assert np.allclose(session.loss(candidates), want, rtol=0, atol=1e-12) and held == [2, 2, 1]


# ---- parallax: positions that were not scanned have no contrast

def test_pairwise_shifts_against_numpy(spark, folder):
    counts = bright(folder)
    images = np.repeat(counts.mean(1)[:, None], -(-counts.shape[1] // 25) * 25, 1)
    images[:, : counts.shape[1]] = counts
    images = images.reshape(9, -1, 25)
    for r in catalog.QUERIES["par_06_pairwise_shifts"](spark, folder).collect():
        assert (r.shift_row, r.shift_col) == pytest.approx(parallax.correlation_shift(images[r.i], images[r.j]), abs=1e-4)


def test_alignment_with_an_incomplete_row(spark, folder):
    assert catalog.QUERIES["par_01_run"](spark, folder).count() == 9
    rng = np.random.default_rng(8)
    base = 100 + 40 * np.fft.ifft2(np.fft.fft2(rng.normal(0, 1, (24, 25))) * np.exp(-(np.hypot(np.fft.fftfreq(24)[:, None], np.fft.fftfreq(25)[None, :]) ** 2) * 40)).real
    truth = {i: ((i // 3 - 1) * 2, (i % 3 - 1) * -1) for i in range(9)}
    rows = [(i, r, c, float(v)) for i, s in truth.items() for (r, c), v in np.ndenumerate(np.roll(base, (-s[0], -s[1]), (0, 1))) if r * 25 + c < 23 * 25 + 6]
    images = spark.createDataFrame(rows, "bf_idx int, scan_row int, scan_col int, value double")
    found = {r.bf_idx: np.array((r.shift_row, r.shift_col)) for r in parallax.align(images, queries_image._bf(spark), (8, 8), (24, 25), (1,)).collect()}
    assert all(np.allclose(found[i] - found[4], truth[i], atol=0.3) for i in truth)
    still = spark.createDataFrame([(i, 0.0, 0.0) for i in range(9)], "bf_idx int, shift_row double, shift_col double")
    assert parallax.shift_and_sum(images, still, (24, 25), 2).count() == (23 * 25 + 6) * 4
