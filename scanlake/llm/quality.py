"""Quality rules: word and repetition rules of single documents, then line frequency across documents.

Lines are normalised (ASCII lower case, digits as 0, white space collapsed) and hashed; per host the
distinct documents of each line are counted, lines above both limits are removed, and documents of which
less than ``min_kept_share`` of the words is left are rejected. ``quality_rules`` gives the verdicts,
``kept_documents`` the documents that stay, without the lines removed.

What counts as one document: rows of the same text count once, by a hash of the whole text, so a group of
exact copies does not make its own text look like boilerplate. Texts that differ at all are documents of their own.

Defined cases: a null text has no words (base_failed, not kept); a null host is a host of its own; rows
that repeat an id are judged row by row; extra columns stay as they are, whatever their names; an empty table
gives an empty result. Lines are cut at "\n" alone; a line without a word is never removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, fewer_parts, row_key, signed, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A line is removed if it stands in more distinct documents of its host than MIN_DOCS and than MAX_SHARE of them.
MIN_DOCS, MAX_SHARE, MIN_KEPT_SHARE = 10, 0.005, 0.5
#: Changed documents are broadcast while they and their removed lines are up to this number (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
#: The seed of Spark's xxhash64, so that a line has the same hash in Python and in SQL.
SEED = 42


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words in 3-word windows that occur twice or more; ids are the words, numbered from 0."""
    n = len(ids)
    if n < 4:
        return 0
    if n_distinct < 2_000_000:
        v = np.int64(n_distinct)
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # the product would not fit: number the pairs first
        pair = np.unique(ids[:-2] * np.int64(n_distinct) + ids[1:-1], return_inverse=True)[1]
        key = pair * np.int64(n_distinct) + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    mark = np.zeros(n, bool)
    mark[:-2] |= hit
    mark[1:-1] |= hit
    mark[2:] |= hit
    return int(mark.sum())


def document_rules(text: str | None) -> tuple[int, int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, identity, {line hash: words}."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes.split() splits at the six ASCII spaces
    number: dict[bytes, int] = {}
    n = len(words)
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    found: dict[int, int] = {}
    for line in lines:
        own = line.lower().translate(_DIGITS).split()
        h = signed(xxhash.xxh64_intdigest(b" ".join(own), SEED))
        found[h] = found.get(h, 0) + len(own)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(ids, len(number)), signed(xxhash.xxh64_intdigest(raw)), found


_FEATURES = (
    "doc_id long, host string, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, identity long, lines array<struct<h:long,words:long>>"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        ends, hashes, words = [0], [], []
        for text in b.column(3).to_pylist():
            *numbers, found = document_rules(text)
            for c, x in zip(cols, numbers, strict=True):
                c.append(x)
            hashes += found
            words += found.values()
            ends.append(len(hashes))
        n, repeat = np.array(cols[0], np.int64), np.array(cols[4], np.int64)
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        kind = pa.struct([("h", pa.int64()), ("words", pa.int64())])
        parts = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int64())], fields=list(kind))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(failed), pa.array(cols[5], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)],
            names=["doc_id", "host", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "identity", "lines"],
        )


def line_limits(lines: DataFrame, sizes: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """lines: host, h, uid, identity, words. sizes: host, n_docs. The rows of lines that are above both limits."""
    many = lines.groupBy("host", "h").count().where(F.col("count") > min_docs).drop("count")
    some = written(lines.alias("l").join(many.alias("m"), F.col("l.host").eqNullSafe(F.col("m.host")) & (F.col("l.h") == F.col("m.h"))).select("l.*"), "lines")
    docs = some.groupBy("host", "h").agg(F.countDistinct("identity").alias("docs"))
    over = docs.alias("d").join(sizes.alias("z"), F.col("d.host").eqNullSafe(F.col("z.host"))).where((F.col("docs") > min_docs) & (F.col("docs") > max_share * F.col("n_docs"))).select("d.host", "d.h")
    return some.alias("l").join(over.alias("o"), F.col("l.host").eqNullSafe(F.col("o.host")) & (F.col("l.h") == F.col("o.h"))).select("l.*")


def line_hash(line: Column) -> Column:
    """The hash that document_rules gives a line; null for a line without a word."""
    words = F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.when(words != "", F.xxhash64(words))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, max_share: float, min_kept_share: float) -> DataFrame:
    """The rows of quality_rules, with gone: the hashes of the lines removed (null if none)."""
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), row_key(host_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    made = written(arrow_map(asked, _features, _FEATURES).withColumn("uid", F.monotonically_increasing_id()), "features")
    lines = made.select("host", "uid", "identity", F.explode("lines").alias("x")).select("host", "uid", "identity", "x.h", "x.words")
    sizes = made.groupBy("host").agg(F.countDistinct("identity").alias("n_docs"))
    # a list holds lines of one document only
    removed = line_limits(lines, sizes, min_docs, max_share).groupBy("uid").agg(F.sum("words").alias("removed"), F.collect_list("h").alias("gone"))
    n_gone = F.coalesce(F.col("removed"), F.lit(0))
    return (
        made.drop("lines", "identity", "host")
        .join(removed, "uid", "left")
        .select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", n_gone.alias("removed_words"), (~F.col("base_failed") & (F.col("n_words") - n_gone >= min_kept_share * F.col("n_words"))).alias("kept"), "gone")
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """A row for each row of docs: doc_id, row_key, the base counts, base_failed, removed_words, kept."""
    return _judged(docs, id_col, text_col, host_col, min_docs, max_share, min_kept_share).drop("gone")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The rows of docs, with their own columns, that the rules keep, without their lines above the limits.

    chars_col, if docs has it, is counted anew where lines are removed."""
    judged = _judged(docs, id_col, text_col, host_col, min_docs, max_share, min_kept_share).where("not kept or gone is not null")
    # equal rows have equal verdicts
    judged = judged.select(F.col("doc_id").alias("_bad_id"), F.col("row_key").alias("_bad_key"), F.col("kept").alias("_kept"), F.when(F.col("kept"), F.array_sort("gone")).alias("_gone"))
    changed = written(judged.groupBy("_bad_id", "_bad_key").agg(F.first("_kept").alias("_kept"), F.first("_gone").alias("_gone")), "changed")
    if (changed.agg(F.sum(1 + F.greatest(F.size("_gone"), F.lit(0)))).first()[0] or 0) <= BROADCAST_ROWS:
        changed = F.broadcast(changed)
    keyed = docs.withColumn("_scanlake_row_key", row_key(host_col, text_col))
    rows = keyed.join(changed, keyed[id_col].cast("long").eqNullSafe(changed["_bad_id"]) & (keyed["_scanlake_row_key"] == changed["_bad_key"]), "left").where("_kept is null or _kept")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.coalesce(F.array_contains("_gone", line_hash(x)), F.lit(False))), "\n")
    changes = {text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)}
    rows = rows.withColumns(changes)
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.when(F.col("_gone").isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return fewer_parts(rows.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
