"""Screening bundles: mean pattern, probe, BF/DF and other bands, centre of mass, rotation and phase, kept in a
folder with a manifest that says what they were made from."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.model import Scan
from . import dpc, reduce
from .reduce import Probe, keys_of, one_dataset

VERSION = 1
TABLES = ("mean_dp", "products", "phase")


@dataclass(frozen=True)
class Screening:
    mean_dp: DataFrame
    products: DataFrame  # total, bands and centred, rotated centre of mass, by scan position
    phase: DataFrame
    probe: Probe
    rotation_deg: float
    transposed: bool


def source_identity(frames: DataFrame) -> str:
    """Of the files that frames are read from: their paths, sizes and times."""
    meta = frames.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    rows = sorted(tuple(map(str, r)) for r in meta.collect())  # a row for each file
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def prepare(scan: Scan, rotation_steps: int = 90, rotation_deg: float | None = None) -> Screening:
    """Two passes over the frames: the first for the mean pattern and the probe, the second for all the rest."""
    scan.validate()
    one_dataset(scan.frames)
    mean = reduce.mean_dp(scan).drop("dataset_id").cache()
    probe = Probe(*reduce.auto_probe(mean).first())
    sums = reduce.screening_sums(scan, probe).drop("dataset_id")
    at = lambda m: F.when(F.col("total") > 0, F.col(m) / F.col("total")).otherwise(0.0)
    products = sums.withColumn("com_row", at("row_moment")).withColumn("com_col", at("col_moment")).cache()
    com = dpc.centered(products.select(*keys_of(products), "com_row", "com_col"))
    angle, transposed = dpc.find_rotation(com, rotation_steps) if rotation_deg is None else (rotation_deg, False)
    turned = dpc.rotated(com, angle, transposed)
    gradient = turned if not transposed else turned.select(*keys_of(turned), F.col("com_col").alias("com_row"), F.col("com_row").alias("com_col"))
    return Screening(mean, products.drop("com_row", "com_col").join(turned, keys_of(products)), dpc.integrate(gradient, shape=scan.scan_shape), probe, angle, transposed)


def save(result: Screening, path: str, identity: str) -> None:
    """The tables, then the manifest: a folder without one is not a bundle."""
    for name in TABLES:
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = result.mean_dp.sparkSession
    manifest = {"version": VERSION, "identity": identity, "probe": asdict(result.probe), "rotation_deg": result.rotation_deg, "transposed": result.transposed}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, identity: str) -> Screening | None:
    """The bundle, or None unless its version and source are those asked for."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as missing:  # noqa: BLE001  Spark's error for a path that isn't there
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    if (manifest.get("version"), manifest.get("identity")) != (VERSION, identity):
        return None
    return Screening(*[spark.read.parquet(f"{path}/{t}") for t in TABLES], Probe(**manifest["probe"]), manifest["rotation_deg"], manifest["transposed"])


def prepared(scan: Scan, path: str, identity: str, refresh: bool = False, **options) -> Screening:
    """From the bundle at path if it is valid, else made anew and kept there."""
    spark = scan.frames.sparkSession
    if not refresh and (found := load(spark, path, identity)):
        return found
    save(prepare(scan, **options), path, identity)
    return load(spark, path, identity)


def rows_per_chunk(bytes_per_row: int, rows: int, free: int) -> int:
    """Scan rows that fit in memory: all within nine tenths of it, else those of half of it (512 MiB at least)."""
    if bytes_per_row * rows <= 0.9 * free:
        return rows
    return max(1, min(rows, math.floor(max(512 << 20, free // 2) / bytes_per_row)))
