"""Queries of what is kept beside scans: bundles, signatures, readiness, packed frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import reduce, screening
from ..sources import bitshuffle, frames
from .catalog import query, rounded as r6
from .model import SQL_PIXELS, embeddings_scan
from .queries_scan import _SCREEN, COM, K
from .scratch import scratch

W = f"WITH {SQL_PIXELS}"
SIX = lambda c: F.round(c, 6).alias(c)
_PRODUCTS = f"""{_SCREEN}, c AS (SELECT *, CAST(row_moment AS DOUBLE) / CAST(total AS DOUBLE) AS cr, CAST(col_moment AS DOUBLE) / CAST(total AS DOUBLE) AS cc FROM s)
SELECT {K}, total, bf, abf, adf, df, {r6('cr - avg(cr) OVER ()')} AS com_row, {r6('cc - avg(cc) OVER ()')} AS com_col FROM c"""


@query("io_14_emd_sibling", "SELECT * FROM (VALUES (0, 'a.emd'), (1, 'only.emd'), (2, NULL), (3, NULL)) AS t(place, sibling)")
def _(spark, d):
    cases = (("/x/a_master.h5", ["b.emd", "a.emd"]), ("/x/a.h5", ["only.emd", "a.txt"]), ("/x/a.h5", ["b.emd", "c.emd"]), ("/x/a.h5", []))
    return spark.createDataFrame([(i, frames.emd_sibling(*c)) for i, c in enumerate(cases)], "place int, sibling string")


@query("io_19_is_ready", "SELECT true AS whole, false AS cut")
def _(spark, d):
    """A saved scan is ready; without some of its frames it isn't."""
    scan, path = embeddings_scan(spark, d), scratch(spark, "ready")
    frames.save(scan, path)
    whole = frames.is_ready(spark, path)
    scan.frames.where("frame_idx % 7 <> 3").write.mode("overwrite").parquet(f"{path}/frames")
    return spark.createDataFrame([(whole, frames.is_ready(spark, path))], "whole boolean, cut boolean")


@query("io_20_signature", "SELECT true AS same, false AS changed")
def _(spark, d):
    """The signature of a saved scan stays while its files do, and changes with them."""
    scan, path = embeddings_scan(spark, d), scratch(spark, "signed")
    frames.save(scan, path)
    first, again = frames.signature(spark, path), frames.signature(spark, path)
    scan.frames.where("frame_idx = 0").write.mode("append").parquet(f"{path}/frames")
    return spark.createDataFrame([(first == again, first == frames.signature(spark, path))], "same boolean, changed boolean")


def _packed_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        back = [bitshuffle.decompress(bitshuffle.compress(np.array(c, np.uint16)), np.uint16) for c in b.column(3).to_pylist()]
        sums = [pa.array([f(x.astype(np.int64)) for x in back], pa.int64()) for f in (lambda x: int(x.sum()), lambda x: int(x @ np.arange(len(x))))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *sums], names=["frame_idx", "scan_row", "scan_col", "total", "moment"])


@query("io_24_packed_frames", f"{W} SELECT {K}, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * (det_row * 8 + det_col)) AS BIGINT) AS moment FROM pixels GROUP BY ALL")
def _(spark, d):
    """Frames through bit shuffling and LZ4 and back."""
    return embeddings_scan(spark, d).frames.select(*reduce.KEYS, "counts").mapInArrow(_packed_and_back, "frame_idx int, scan_row int, scan_col int, total long, moment long")


@query("io_26_screening_saved", _PRODUCTS)
def _(spark, d):
    """A bundle as it is read back."""
    path = scratch(spark, "bundle")
    screening.save(screening.prepare(embeddings_scan(spark, d), rotation_deg=0.0), path, "source")
    return screening.load(spark, path, "source").products.select(*reduce.KEYS, "total", "bf", "abf", "adf", "df", SIX("com_row"), SIX("com_col"))


@query("scr_06_cache_validity", "SELECT true AS valid, false AS other_source, false AS no_manifest")
def _(spark, d):
    """A bundle is taken for the source that it was made from only, and not without a manifest."""
    path = scratch(spark, "bundle")
    screening.save(screening.prepare(embeddings_scan(spark, d), rotation_deg=0.0), path, "source")
    found = [screening.load(spark, *x) is not None for x in ((path, "source"), (path, "other"), (f"{path}/products", "source"))]
    return spark.createDataFrame([tuple(found)], "valid boolean, other_source boolean, no_manifest boolean")


@query("scr_07_forced_rotation", f"{COM} SELECT {K}, {r6(f'{math.cos(math.radians(30))!r} * com_row - {math.sin(math.radians(30))!r} * com_col')} AS com_row, {r6(f'{math.sin(math.radians(30))!r} * com_row + {math.cos(math.radians(30))!r} * com_col')} AS com_col, false AS transposed FROM cen")
def _(spark, d):
    """The rotation that is asked for, and no transposition."""
    made = screening.prepare(embeddings_scan(spark, d), rotation_deg=30.0)
    return made.products.select(*reduce.KEYS, SIX("com_row"), SIX("com_col"), F.lit(made.transposed).alias("transposed"))
