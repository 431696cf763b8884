"""Sharding by sampled splitters: equal bytes, in order of a text hash, without Python.

Rows are ordered by (text hash, id, place). A size-weighted sample of keys (a row is drawn with a probability in
proportion to its size) gives quantile boundaries, which deal the rows into ranges; ranges that come out
overfull get further splitters, drawn only from them. Sums over the ranges and prefix sums within each then
give every row its exact place in bytes, and the shard is the part of the whole that this place lies in.

Equal texts are neighbours in this order. A group of up to GROUP_SHARE of a shard is never cut: all of it goes
where its first row lies. A larger group may be cut between its rows, so a text that fills a third of the
table fills several shards, and its ranges are cut like any others. Shard sizes differ by a group of that
share, or one row, at most.

Defined cases: a null text has size 1 and CRC 0 and groups with other nulls; null ids come first within their
group; rows that repeat an id and a text are told apart by their place in the written table; extra columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import written

SHARDS, GROUP_SHARE = 16, 0.01
#: A range holds so many rows at best; there are so many ranges at most, each with OVERSAMPLE sampled keys.
RANGE_ROWS, MAX_RANGES, OVERSAMPLE = 100_000, 8192, 16
#: Ranges above OVERFULL times their share are cut again, in so many rounds at most.
OVERFULL, ROUNDS = 4, 3

_KEY = ("h", "g_id", "g_at")


def _drawn(rows: DataFrame, n: int, total: int, salt: int) -> list[tuple]:
    """About n keys, each row drawn with probability n * size / total (a large one surely); at most about n rows."""
    u = F.pmod(F.xxhash64("h", "doc_id", "at", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return [tuple(r) for r in rows.where(u * float(total) < F.col("size") * float(n)).select(*_KEY).orderBy(*_KEY).collect()]


def _range_of(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Adds range: how many splitters are at most the row's key, found by halving a sorted array."""
    levels = len(splitters).bit_length()
    top = ((1 << 63) - 1,) * 3
    filled = sorted(splitters) + [top] * ((1 << levels) - 1 - len(splitters))
    arrays = [F.array(*[F.lit(s[i]).cast("long") for s in filled]) if filled else F.array(F.lit(top[0])) for i in range(3)]
    out = rows.withColumn("range", F.lit(0))
    for step in (1 << k for k in reversed(range(levels))):
        at = F.col("range") + step  # arrays count from 1: the last of the next step's splitters
        h, i, p = (F.element_at(a, at) for a in arrays)
        below = (h < F.col("h")) | (h == F.col("h")) & ((i < F.col("g_id")) | (i == F.col("g_id")) & (p <= F.col("g_at")))
        out = out.withColumn("range", F.col("range") + F.when(below, step).otherwise(0))
    return out


def _splitters(rows: DataFrame, n_rows: int, total: int) -> list[tuple]:
    n = max(16, min(MAX_RANGES, n_rows // RANGE_ROWS))
    keys = _drawn(rows, n * OVERSAMPLE, total, 0)
    splitters = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    for salt in range(1, ROUNDS + 1):
        sums = _range_of(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct(*_KEY).alias("keys"))
        over = sums.where(((F.col("bytes") > OVERFULL * total / n) | (F.col("n") > OVERFULL * n_rows / n)) & (F.col("keys") > 1)).select("range", "bytes", "n").collect()
        if not over:
            break
        named = F.broadcast(rows.sparkSession.createDataFrame([r["range"] for r in over], "int").toDF("range"))  # at most the number of ranges
        inside = _range_of(rows, splitters).join(named, "range").drop("range")
        # by rows as by bytes: many small rows need splitters too
        share = sum(r["bytes"] for r in over)
        more = _drawn(inside, 8 * OVERSAMPLE * len(over), share, salt) + _drawn(inside.withColumn("size", F.lit(1)), 8 * OVERSAMPLE * len(over), sum(r["n"] for r in over), -salt)
        splitters = sorted({*splitters, *sorted(more)[:: OVERSAMPLE]})
    return splitters


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, shard, slot; with carry also row, a struct of the row itself."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.xxhash64(text_col)).alias("h"), *([F.struct("*").alias("row")] if carry else []),
    )
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "keys")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    limit = GROUP_SHARE * total / shards
    groups = rows.groupBy("h").agg(F.sum("size").alias("group_bytes")).where(F.col("group_bytes") > limit).select(F.col("h").alias("large_h"))
    # each is over GROUP_SHARE of a shard, so there are fewer than shards / GROUP_SHARE of them
    large = F.broadcast(written(groups, "groups"))
    rows = rows.join(large, F.col("h") == F.col("large_h"), "left").withColumn("large", F.col("large_h").isNotNull())
    # in a small group all rows have one key, so no splitter cuts it
    own = lambda c: F.when(F.col("large"), F.coalesce(F.col(c), F.lit(-(1 << 63)))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("g_id", own("doc_id")).withColumn("g_at", own("at")).drop("large_h")
    lean = [c for c in rows.columns if c != "row"]
    splitters = _splitters(rows.select(*lean), n_rows, total)
    ranged = _range_of(rows.select(*lean), splitters)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in (("bytes", "bytes_before"), ("n", "rows_before"))])
    inside = Window.partitionBy("range").orderBy("h", F.col("doc_id").asc_nulls_first(), "at")
    placed = ranged.withColumn("start", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rank", F.row_number().over(inside) - 1)
    first = F.min("start").over(Window.partitionBy("range", "h"))
    placed = placed.withColumn("start", F.when(F.col("large"), F.col("start")).otherwise(first))
    placed = placed.join(F.broadcast(bases), "range")  # at most MAX_RANGES and what the rounds added
    place = F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + F.col("start")) * F.lit(shards) / F.lit(total))).cast("int")
    placed = written(placed.select("doc_id", "size", "text_crc32", "at", place.alias("shard"), (F.col("rows_before") + F.col("rank")).alias("rank")), "placed")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "at", "shard", (F.col("rank") - F.col("first")).alias("slot"))
    return out.join(rows.select("at", "row"), "at").drop("at") if carry else out.drop("at")


def query(spark, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
