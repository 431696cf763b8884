"""Near-duplicates by the Jaccard similarity of word shingles.

Candidates come from min-hashes in bands of ROWS: a pair of similarity s shares a band with probability
1 - (1 - s^ROWS)^bands, and there are as many bands as it takes for a pair at the threshold to be missed with
a probability of MISSED at most. Candidates are checked on their whole shingle sets, so no pair below the
threshold is linked.

Work is on distinct word sequences. In bands of at most SMALL members every pair is a candidate. In larger ones the
members are first held against two of them, then those outside the band's largest component against one member of
it, another one in each band; this joins true groups in rows that grow with the members alone.
Members of larger bands that are still in different components at last meet by prefixes: their shingles are ordered
by how many of these members have them, rarest first, and sets of similarity s share one of the first
n - ceil(s n) + 1 of both. Texts that are much alike but below the threshold thus don't meet at what all of
them have. Where many members of one component share such a shingle, only members of others are held against
them. No pair that could join two components is left out.

Before sets are fetched, pairs meet a bound that holds for certain: a set's sketch has the parity of its hashes
at SKETCH places, so two sketches differ in no more places than the sets differ in shingles, and sets of
similarity s differ in (1 - s) / (1 + s) of their sizes' sum at most. Texts that share a prefix are compared by their
sketches within the join, so that only pairs that may be similar become rows; where very many are alike but below
the threshold, that still takes time in proportion to the square of their number.

Defined cases: null and wordless texts are one group; fewer words than a shingle make one shingle; repeated
rows each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_map, removed, row_key, signed, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
ROWS, MISSED = 3, 1e-8
#: Keys to look up (16 bytes each) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Members of a band up to which every pair is a candidate.
SMALL = 8
#: Places of a sketch; its bits lie in longs.
SKETCH = 512
_LONGS = [f"s{i}" for i in range(SKETCH // 64)]
#: Shingles hashed at a time, so that a long text's table of hashes stays small.
_CHUNK = 4096


def n_bands(similarity: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(similarity**ROWS)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes.lower() is A-Z only


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The set's hashes, ascending."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(shingle, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * _ODD[1] + own[i : n - k + 1 + i]
    return np.unique(_mixed(h))


def multipliers(bands: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, (bands * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), _CHUNK):
        np.minimum(least, _mixed(h[a : a + _CHUNK] * by).min(axis=1), out=least)
    least = least.reshape(-1, ROWS)
    out = np.arange(len(least), dtype=np.uint64)
    for i in range(ROWS):
        out = _mixed(out * _ODD[1] + least[:, i])
    return out.view(np.int64)


def _shingled(shingle: int, bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers(bands)
        for b in batches:
            nodes, counts, found = [], [], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                h = shingle_hashes(words, shingle)
                nodes.append(signed(xxhash.xxh64_intdigest(b" ".join(words))))
                counts.append(len(h))
                found.append(band_hashes(h, by) if len(h) else np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "row_key", "node", "n", "bands"],
            )

    return run


def sketch(h: np.ndarray) -> list[int]:
    odd = np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):  # a row at a time: a set is larger than its text
                h = shingle_hashes(words_of(text), shingle)
                grams, bits = pa.array([h.view(np.int64)], pa.list_(pa.int64())), [pa.array([x], pa.int64()) for x in sketch(h)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(h)], pa.int64()), grams, *bits], names=["node", "n", "grams", *_LONGS])

    return run


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have the similarity."""
    both = F.size(F.array_intersect("x.grams", "y.grams"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets.select("node", "grams").join(_few(nodes), "node", "left_semi")  # else a few pairs would move all sets
    found = pairs.join(sets.alias("x"), F.col("a") == F.col("x.node")).join(sets.alias("y"), F.col("b") == F.col("y.node"))
    return found.where(both / (F.size("x.grams") + F.size("y.grams") - both) >= similarity).select("a", "b")


def _pair(on: DataFrame, x: str = "x.node", y: str = "y.node") -> DataFrame:
    """a, b of the joined sides x and y."""
    return on.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _allowed(similarity: float) -> Column:
    """Whether the sketches of x and y allow the similarity."""
    apart = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _LONGS), F.lit(0))
    return apart <= (F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _plain(sets: DataFrame) -> DataFrame:
    """Numbers and sketches, without the sets."""
    return sets.select(*[c for c, kind in sets.dtypes if not kind.startswith("array")])


def _near(pairs: DataFrame, sets: DataFrame, allowed: Column) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    own = _plain(sets)
    return pairs.join(own.alias("x"), F.col("a") == F.col("x.node")).join(own.alias("y"), F.col("b") == F.col("y.node")).where(allowed).select("a", "b")


def _open_members(many: DataFrame, labels: DataFrame | None) -> DataFrame:
    """band, node, label of the bands whose members have different labels. A label is looked up once for each node."""
    now = many.groupBy("node").agg(F.collect_list("band").alias("bands")).withColumn("label", F.col("node"))
    if labels is not None:
        now = now.drop("label").join(labels.select(F.col("node").alias("_node"), F.col("root").alias("label")), F.col("node") == F.col("_node"), "left").select("node", "bands", F.coalesce("label", "node").alias("label"))
    each = Window.partitionBy("band")
    now = now.select("node", "label", F.explode("bands").alias("band")).select("band", "node", "label", F.min("label").over(each).alias("low"), F.max("label").over(each).alias("high"))
    return written(now.where("low <> high").select("band", "node", "label"), "open")


def _by_lead(members: DataFrame) -> DataFrame:
    """Candidates between a band's members and one of its largest component, another one in each band."""
    one = F.min(F.struct(F.xxhash64("node", "band").alias("at"), "node")).alias("one")
    tops = members.groupBy("band", "label").agg(F.count("*").alias("n"), one).groupBy("band").agg(F.max(F.struct("n", "label", "one.node")).alias("top"))
    tops = written(tops.select("band", F.col("top.label").alias("lead"), F.col("top.node").alias("node")), "leads")
    return _pair(members.alias("x").join(tops.alias("y"), "band").where("label <> lead"))


def _by_prefix(members: DataFrame, sets: DataFrame, similarity: float, allowed: Column) -> DataFrame:
    """Candidates among the members, of different labels, that share a shingle of both prefixes and whose sketches allow the similarity."""
    nodes = members.select("node", "label").distinct()
    asked = sets.select("node", "n", "grams").join(_few(nodes), "node")
    grams = written(asked.select("node", "label", "n", F.explode("grams").alias("gram")), "grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node").orderBy("often", "gram")
    first = grams.join(often, "gram").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    first = written(first.select("gram", "node", "label"), "prefixes")
    removed(grams)
    tops = first.groupBy("gram", "label").agg(F.count("*").alias("many")).groupBy("gram").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    tops = written(tops.select("gram", F.col("top.label").alias("lead")), "leads")
    first = written(first.join(tops, "gram").join(_plain(sets), "node"), "postings")
    return _pair(first.where("label <> lead").alias("x").join(first.alias("y"), "gram").where((F.col("x.label") != F.col("y.label")) & allowed))


def _banded(rows: DataFrame, small: int) -> DataFrame:
    """band, node, large, others, of bands with two nodes or more: the other nodes to hold a node against, in small bands those that follow it."""
    each = Window.partitionBy("band").orderBy("node")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("band", "node", F.count("*").over(whole).alias("members"), F.min("node").over(whole).alias("low"), F.min(F.struct(F.xxhash64("node").alias("at"), "node")).over(whole).alias("any"))
    rows = rows.where("members > 1").withColumn("after", F.collect_list("node").over(each.rowsBetween(1, small - 1)))
    large = F.col("members") > small
    return rows.select("band", "node", large.alias("large"), F.when(large, F.array("low", "any.node")).otherwise(F.col("after")).alias("others"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose members have different labels."""
    for k in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(k), F.col("root").alias(f"of_{k}")), k, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _linked(near: DataFrame, sets: DataFrame, similarity: float, edges: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges and labels with the pairs of near that are alike, but for those whose members other pairs have joined.

    Each node is held against the least one that it is near to; then pairs follow whose members are still apart."""
    first = written(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "firsts")
    for pairs in (first, None):
        if pairs is None:
            pairs = near.join(first, ["a", "b"], "left_anti")
            pairs = written(pairs if labels is None else _apart(pairs, labels), "rest")
        fresh = written(alike(pairs, sets, similarity), "alike")
        if not fresh.isEmpty():
            edges = fresh if edges is None else edges.union(fresh)
            labels = written(components(edges), "labels")
    return edges, labels


def labels_of(rows: DataFrame, sets: DataFrame, similarity: float, small: int = SMALL, *, allowed: Column | None = None) -> DataFrame | None:
    """rows: band, node. Returns node, root as components() does; None without links.

    allowed: whether the columns of sets that aren't arrays, of x and y, allow the similarity; by the sketches if not given."""
    allowed = _allowed(similarity) if allowed is None else allowed
    bands = written(_banded(rows, small), "bands")
    # a table of its own, so that a large band's members are dealt by a plain exchange, which Spark can split
    many = written(bands.where("large").select("band", "node"), "members")
    found = _pair(bands.select("node", F.explode("others").alias("other")).where("node <> other"), "node", "other")
    tried = edges = labels = None
    for way in (None, _by_lead, lambda members: _by_prefix(members, sets, similarity, allowed)):
        if way is not None:
            members = _open_members(many, labels)
            if members.isEmpty():
                break
            found = way(members).join(tried, ["a", "b"], "left_anti")
        found = written(found, "pairs")
        if way is None:
            removed(bands)
        tried = found if tried is None else tried.union(found)
        near = written(_near(found, sets, allowed), "near")
        if not near.isEmpty():
            edges, labels = _linked(near, sets, similarity, edges, labels)
    return labels


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, row_key (of the text), root (the component of all pairs of the similarity)."""
    if shingle < 1 or not 0 < similarity <= 1:
        raise ValueError("shingle must be 1 or more, similarity above 0 and at most 1")
    text = F.col(text_col).cast("string").alias("text")
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("row_key"), text)
    made = written(arrow_map(asked, _shingled(shingle, n_bands(similarity)), "doc_id long, row_key long, node long, n long, bands array<long>"), "shingled")
    own = made.where("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = written(own, "nodes").select("node", "n", "row_key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").count().where("count > 1").select("band")
    rows = written(rows.join(shared, "band"), "bands")
    keys = written(rows.select("row_key", "node").distinct(), "keys")
    keyed = docs.select(row_key(text_col).alias("_key"), text)
    texts = keyed.join(_few(keys), F.col("_key") == F.col("row_key")).groupBy("node").agg(F.first("text").alias("text"))
    sets = written(arrow_map(texts, _sets(shingle), f"node long, n long, grams array<long>, {', '.join(f'{s} long' for s in _LONGS)}"), "sets")
    labels = labels_of(rows.select("band", "node"), sets, similarity)
    if labels is None:
        return made.select("doc_id", "row_key", F.col("node").alias("root"))
    labels = labels.withColumnRenamed("node", "_node")
    return made.join(labels, F.col("node") == F.col("_node"), "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))
