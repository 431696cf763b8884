"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, a bit set where over half of the hashes of the word shingles have it. Covering masks
(Pagh's construction): bit i gets a non-zero vector m(i) of radius+1 bits, mask v holds the bits with odd
<m(i), v>. Two fingerprints that differ in at most ``radius`` bits agree under at least one of the
2^(radius+1) - 1 masks, because radius vectors cannot span radius+1 dimensions. So no link is missed.

Work is on distinct fingerprints. A bucket of up to SMALL fingerprints is compared pair by pair. In a larger
one each fingerprint names itself and its one-bit neighbours inside the bucket: two fingerprints are within
2 bits exactly if they share a named point, and at most 65 fingerprints can name a point, so a large bucket
costs rows in proportion to its size and no group grows with the data.

Defined cases: null and wordless texts have fingerprint 0 and link like others; fewer words than a shingle
make one shingle; a null id never becomes a component id unless its component has no other; repeated rows
each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_map, fewer_parts, removed, row_key, signed, written
from .components import components

#: RADIUS is fixed: shared one-bit neighbours mean a distance of two at most.
RADIUS, SHINGLE, SEED, SMALL = 2, 3, 42, 24
#: Rows (of 16 bytes) to drop up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes.lower() is A-Z only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(_POWERS[counts.ravel() * 2 > len(h)].sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = pa.array([signed(fingerprint(t)) for t in b.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (of the text), fp (long with the fingerprint's bits)."""
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(asked, _fingerprints, "doc_id long, row_key long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks of so many bits; the vectors m(i) take the non-zero values in turn."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(bits)]
    return [sum((bin(m & v).count("1") & 1) << i for i, m in enumerate(vectors)) for v in range(1, 1 << radius + 1)]


def links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """fps: fp, distinct. Returns pairs a, b; their components are those of all pairs within RADIUS bits."""
    parts = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for t, m in enumerate(covering_masks())])
    rows = fps.select("fp", F.explode(parts).alias("x")).select("fp", "x.t", "x.part")
    sizes = rows.groupBy("t", "part").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(sizes, ["t", "part"]), "buckets")
    few, many = rows.where(F.col("n") <= small), rows.where(F.col("n") > small).select("fp").distinct()
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    pairs = few.alias("x").join(few.alias("y"), [F.col("x.t") == F.col("y.t"), F.col("x.part") == F.col("y.part"), F.col("x.fp") < F.col("y.fp")]).where(near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = F.array(*[F.lit(x) for x in (0, *(signed(1 << i) for i in range(64)))])
    named = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    first = F.min("fp").over(Window.partitionBy("point"))
    stars = named.select(first.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, row_key, fp, root (the component), component_id (the smallest doc_id reachable)."""
    made = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(fps.select("fp")))
    rooted = written(fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fewer_parts(made.join(rooted.select("fp", "root").join(named, "root"), "fp"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs, with their own columns, that stand for their group: of its smallest id, once. groups gives doc_id, row_key and root."""
    found = written(groups(docs, id_col, text_col).select("root", "doc_id", "row_key"), "found")
    # a table of its own: the join of a large group's rows to it then reads a plain exchange, which Spark can split
    best = written(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")), "best")
    rows = found.join(best, "root").select(F.col("doc_id").alias("_bad_id"), F.col("row_key").alias("_bad_key"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))).alias("stays"))
    rows = written(rows.groupBy("_bad_id", "_bad_key", "stays").count(), "verdicts")
    removed(found, best)
    gone, repeated = rows.where("not stays").drop("stays", "count"), rows.where("stays and count > 1")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn("_scanlake_row_key", row_key(text_col))
    kept = keyed.join(gone, keyed[id_col].cast("long").eqNullSafe(gone["_bad_id"]) & (keyed["_scanlake_row_key"] == gone["_bad_key"]), "left_anti")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, "_scanlake_row_key"])
    return fewer_parts(kept.drop("_scanlake_row_key"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
