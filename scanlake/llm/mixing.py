"""Mixing sources to target weights by hash-threshold histograms, without sorting or Python.

Targets: the words of all sources are shared by weight; a source's target stops at ``max_repeats`` times its
words and the excess is reshared by weight until none is above (the level that fills: sources in order of
cap per weight). A source takes each document floor(target / words) times, and once more those documents
whose hash lies under the source's threshold. The threshold is found digit by digit: words are summed by
source and the hash's next digit, the digits below the budget are taken whole, and only the bucket that the
budget cuts is refined. Thresholds of larger budgets contain those of smaller ones.

The hash is 60 bits of MD5 over id and text. Rows that repeat an id and a text have equal hashes; a second
hash, of their place in the written table, tells them apart, so a run of equal rows is cut inside.

Defined cases: a null text has no words and is never taken; null is a source of its own, last in order; a
null id counts as an empty one in the hash; a source without words has target 0; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fewer_parts, written

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: Bits of one digit, and digits of the first and the second hash.
DIGIT, FIRST, SECOND = 12, 5, 2
_BITS = DIGIT * FIRST
#: Up to this many sources (under 100 bytes each) their plan is broadcast.
BROADCAST_SOURCES = 50_000


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(id_col: str, text_col: str) -> Column:
    whole = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, _BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target.

    The windows are over one row for each source, not over documents."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_repeats)
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("w", weight).withColumn("cap", cap)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        rows.withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_after", F.sum("w").over(every) - F.coalesce(F.sum("w").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        # the level if the sources before this one are full; the first source that it doesn't fill fixes it for the rest
        .withColumn("level", (F.col("all_words") - F.col("cap_before")) / F.col("w_after"))
        .withColumn("fills", F.col("level") * F.col("w") >= F.col("cap"))
        .withColumn("fixed", F.min(F.when(~F.col("fills"), F.struct((F.col("cap") / F.col("w")).alias("rate"), F.col("level").alias("level")))).over(every))
    )
    return rows.select("source", "source_size", F.when(F.col("fills") | F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed.level") * F.col("w"))).alias("target"))


def _digit(column: str, bits: int, place: int) -> Column:
    return F.shiftright(F.col(column), bits - DIGIT * (place + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: source, size, h1, h2. budgets: source, budget (words under the threshold).

    Returns source, t1, t2: a row is under its source's threshold if (h1, h2) < (t1, t2). Of the two cuts around
    the budget that the last bucket allows, the nearer one is taken."""
    open_rows, state = rows.where("size > 0"), budgets.select("source", "budget", F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"))
    done = None
    for place in range(FIRST + SECOND):
        column, bits, at = ("h1", _BITS, place) if place < FIRST else ("h2", DIGIT * SECOND, place - FIRST)
        digits = open_rows.groupBy("source", _digit(column, bits, at).alias("d")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        up = Window.partitionBy("source").orderBy("d")
        before = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = digits.withColumn("before", before).alias("g").join(state.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).where("before <= budget and budget < before + words")
        step = 1 << (bits - DIGIT * (at + 1))
        name = "t1" if column == "h1" else "t2"
        last = place == FIRST + SECOND - 1
        over = (F.col("budget") - F.col("before")) * 2 > F.col("words")
        cut = written(
            cut.select(
                "s.source", (F.col("budget") - F.col("before")).alias("budget"), "d", "n",
                # a bucket of one row, or the last one, isn't refined: the nearer cut is taken
                *[(F.col(t) + ((F.col("d") + F.when(((F.col("n") == 1) | F.lit(last)) & over, 1).otherwise(0)) * F.lit(step) if t == name else F.lit(0))).alias(t) for t in ("t1", "t2")],
            ),
            "cut",
        )
        settled = cut.where((F.col("n") == 1) | F.lit(last)).select("source", "t1", "t2")
        done = settled if done is None else done.union(settled)
        state = cut.where(F.col("n") > 1)
        if last or state.isEmpty():
            break
        open_rows = written(open_rows.alias("r").join(state.select("source", "d").alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (_digit(column, bits, at) == F.col("c.d"))).select("r.*"), "boundary")
        state = state.select("source", "budget", "t1", "t2")
    return done


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, carry: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, times, taken; with carry also row, a struct of the row itself."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), document_hash(id_col, text_col).alias("h1"), *([F.struct("*").alias("row")] if carry else [])
    )
    rows = written(rows.withColumn("h2", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << DIGIT * SECOND) - 1))), "sizes")
    shares = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    shares = shares.withColumn("whole", whole.cast("long"))
    cuts = thresholds(rows.select("source", "size", "h1", "h2"), shares.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    plan = written(shares.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "t1", "t2"), "plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    under = (F.col("h1") < F.col("t1")) | (F.col("h1") == F.col("t1")) & (F.col("h2") < F.col("t2"))
    times = F.col("whole") + F.when(under, 1).otherwise(0)
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select("doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **asked) -> DataFrame:
    """The rows of docs, with their own columns, as often as the mix takes them."""
    taken = mix(docs, carry=True, **asked).where("taken > 0")
    return fewer_parts(taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("times")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0e0 AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl
      FROM r WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lvl * w >= cap AS fills FROM l),
g AS (SELECT arg_min(lvl, cap / w) AS lvl FROM f WHERE NOT fills),
t AS (SELECT f.source, f.source_size, CASE WHEN f.fills OR g.lvl IS NULL THEN f.cap ELSE least(f.cap, g.lvl * f.w) END AS target FROM f CROSS JOIN g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.size > 0, d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN before + size <= budget OR (before <= budget AND (budget - before) * 2 > size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
