"""The data model: a 4D scan is a table of frames, one row for each scan position.

frames: dataset_id string, frame_idx int, scan_row int, scan_col int, counts array<int> (the detector, row-major)
pixels: frames with one row for each detector pixel: det_row, det_col int, n long
image:  row int, col int, value double (scan- or detector-shaped products)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Scan:
    """Frames with their shapes and calibration. tail: frames of a last scan row that is incomplete; scan_shape counts complete rows only."""

    frames: DataFrame
    scan_shape: tuple[int, int]
    det_shape: tuple[int, int]
    semiangle_mrad: float | None = None
    voltage_kV: float | None = None
    scan_step_A: float | None = None
    tail: int = 0

    @property
    def grid(self) -> tuple[int, int]:
        """The smallest whole grid that holds all frames."""
        return self.scan_shape[0] + (self.tail > 0), self.scan_shape[1]

    def pixels(self) -> DataFrame:
        return pixels(self.frames, self.det_shape[1])

    def with_frames(self, frames: DataFrame, **changes) -> Scan:
        return replace(self, frames=frames, **changes)

    def validate(self) -> Scan:
        """Raises unless there is a frame for each scan position (and those of the tail), each with a count for each detector pixel."""
        n = self.det_shape[0] * self.det_shape[1]
        rows, least, most, odd = self.frames.agg(F.count("*"), F.min("frame_idx"), F.max("frame_idx"), F.count_if((F.size("counts") != n) | F.exists("counts", lambda c: c.isNull() | (c < 0)))).first()
        want = self.scan_shape[0] * self.scan_shape[1] + self.tail
        if rows != want or (want and (least, most) != (0, want - 1)):
            raise ValueError(f"a scan of {self.scan_shape}{f' and {self.tail} frames more' if self.tail else ''} has {want} frames, numbered from 0; there are {rows}")
        if odd:
            raise ValueError(f"{odd} frames don't have {n} counts of 0 or more")
        return self


def square_shape(n: int) -> tuple[int, int]:
    """The scan shape of n frames where none is given: a square, or an error."""
    side = round(n**0.5)
    if side * side != n:
        raise ValueError(f"{n} frames are no square scan; give scan_shape")
    return side, side


def pixels(frames: DataFrame, det_cols: int) -> DataFrame:
    """One row for each detector pixel; made in the scan's own stage, so sums over them start before any shuffle.

    The outer form with a filter behind it: before an inner one Spark tests the array's size, for which it would work out
    a computed array again."""
    keys = [c for c in ("dataset_id", "frame_idx", "scan_row", "scan_col") if c in frames.columns]
    out = frames.select(*keys, F.posexplode_outer("counts").alias("p", "n")).where("p is not null")
    return out.select(*keys, F.floor(F.col("p") / det_cols).cast("int").alias("det_row"), (F.col("p") % det_cols).cast("int").alias("det_col"), F.col("n").cast("long").alias("n"))


#: The carrier that the queries use: rows of ``embeddings`` are frames of 8 x 8 counts on a scan 25 wide.
SCAN_COLS, DET = 25, (8, 8)


def position(frame_idx: Column, cols: int = SCAN_COLS) -> tuple[Column, Column]:
    return F.floor(frame_idx / cols).cast("int"), (frame_idx % cols).cast("int")


def embeddings_scan(spark: SparkSession, sf_dir: str, by_label: bool = False) -> Scan:
    """A scan from the table of vectors: count = floor(100 * (value + 1)). by_label: labels are the datasets."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    row, col = position(F.col("vec_id"))
    counts = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int"))
    frames = table.select(F.col("label").cast("string").alias("dataset_id") if by_label else F.lit("scan").alias("dataset_id"), F.col("vec_id").cast("int").alias("frame_idx"), row.alias("scan_row"), col.alias("scan_col"), counts.alias("counts"))
    n = table.count()  # from the file footers
    return Scan(frames, (n // SCAN_COLS, SCAN_COLS), DET, semiangle_mrad=20.0, voltage_kV=300.0, scan_step_A=0.5, tail=n % SCAN_COLS)


#: SQL for the same tables.
SQL_FRAMES = f"frames AS (SELECT CAST(vec_id AS INTEGER) AS frame_idx, CAST(vec_id // {SCAN_COLS} AS INTEGER) AS scan_row, CAST(vec_id % {SCAN_COLS} AS INTEGER) AS scan_col, label, embedding FROM embeddings)"
SQL_PIXELS = SQL_FRAMES + ", pixels AS (SELECT frame_idx, scan_row, scan_col, label, CAST(i // 8 AS INTEGER) AS det_row, CAST(i % 8 AS INTEGER) AS det_col, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 100) AS BIGINT) AS n FROM frames, (SELECT unnest(range(64)) AS i))"
