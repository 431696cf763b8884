"""Movies: contrast, bytes, tiles, and GIF files."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def contrast_limits(stacks: DataFrame, percent: tuple[float, float] = (1.0, 99.0), shared: bool = False) -> DataFrame:
    """stacks: movie, frame, row, col, value. movie, low, high by exact percentiles, of each movie or of all together;
    high is low + 1 if it isn't above it."""
    ends = [F.percentile("value", p / 100).alias(n) for n, p in zip(("low", "high"), percent, strict=True)]
    limits = stacks.agg(*ends) if shared else stacks.groupBy("movie").agg(*ends)
    limits = limits.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1).otherwise(F.col("high")))
    return stacks.select("movie").distinct().join(F.broadcast(limits)) if shared else limits


def to_bytes(value: Column, low: Column, high: Column) -> Column:
    return F.floor(F.least(F.greatest((value - low) / (high - low) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def byte_stacks(stacks: DataFrame, limits: DataFrame) -> DataFrame:
    return stacks.join(F.broadcast(limits), "movie").select("movie", "frame", "row", "col", to_bytes(F.col("value"), F.col("low"), F.col("high")).alias("level"))


def tiled(stacks: DataFrame, shape: tuple[int, int], movies: int, cols: int | None = None, gap: int = 0) -> tuple[DataFrame, tuple[int, int]]:
    """Movies 0 to movies - 1 side by side, three in a row unless cols says otherwise. Rows and columns of the canvas."""
    cols = min(movies, 3) if cols is None else max(1, cols)
    rows = math.ceil(movies / cols)
    row, col = F.floor(F.col("movie") / cols), F.col("movie") % cols
    out = stacks.select("frame", (F.col("row") + row * (shape[0] + gap)).cast("int").alias("row"), (F.col("col") + col * (shape[1] + gap)).cast("int").alias("col"), "level")
    return out, (rows * shape[0] + (rows - 1) * gap, cols * shape[1] + (cols - 1) * gap)


def _lzw(data: bytes) -> bytes:
    """GIF's variable-width codes for bytes, the lowest bit first."""
    table, next_, width, held, bits, out = {bytes([i]): i for i in range(256)}, 258, 9, 256, 9, bytearray()
    now = b""

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    # the stream starts with the code that clears the table
    while bits >= 8:
        out.append(held & 255)
        held >>= 8
        bits -= 8
    for i in data:
        more = now + bytes([i])
        if more in table:
            now = more
            continue
        put(table[now])
        if next_ < 4096:
            table[more] = next_
            if next_ == 1 << width:
                width += 1
            next_ += 1
        else:
            put(256)
            table, next_, width = {bytes([k]): k for k in range(256)}, 258, 9
        now = bytes([i])
    if now:
        put(table[now])
    put(257)
    if bits:
        out.append(held & 255)
    return bytes(out)


def gif(frames: Sequence[np.ndarray], fps: float = 10.0, palette: np.ndarray | None = None) -> bytes:
    """A looping animation of byte images of one shape; grey unless a palette (256, 3) is given."""
    h, w = frames[0].shape
    colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1) if palette is None else palette
    delay = max(1, round(100 / fps))
    word = lambda n: int(n).to_bytes(2, "little")
    out = [b"GIF89a", word(w), word(h), b"\xf7\x00\x00", colours.astype(np.uint8).tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for f in frames:
        if f.shape != (h, w):
            raise ValueError("frames differ in shape")
        packed = _lzw(np.ascontiguousarray(f, np.uint8).tobytes())
        out += [b"\x21\xf9\x04\x00", word(delay), b"\x00\x00", b"\x2c", word(0), word(0), word(w), word(h), b"\x00\x08"]
        out += [bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)] + [b"\x00"]
    return b"".join(out) + b"\x3b"


def save_gif(stacks: DataFrame, shape: tuple[int, int], path: str, fps: float = 10.0) -> None:
    """stacks: frame, row, col, level. Frames are put together on the tasks, a row of bytes each; the driver gathers these and
    writes the file, which is for viewing. Frames and pixels that are missing are 0."""
    places = F.collect_list(F.struct((F.col("row") * shape[1] + F.col("col")).cast("int").alias("at"), F.col("level").cast("int").alias("level")))
    frames: dict[int, np.ndarray] = {}
    for r in stacks.groupBy("frame").agg(places.alias("p")).select("frame", F.col("p.at").alias("at"), F.col("p.level").alias("level")).toLocalIterator():
        frames[r["frame"]] = image = np.zeros(shape, np.uint8)
        image.ravel()[r["at"]] = r["level"]
    blank = np.zeros(shape, np.uint8)
    with open(path, "wb") as f:
        f.write(gif([frames.get(i, blank) for i in range(max(frames) + 1)], fps))
