"""Near-duplicates by SimHash covering, checked on whole sets of word shingles.

Fingerprints are long: of each of many 64-bit words a bit is set where over half of the hashes of the text's distinct shingles,
mixed anew for the word, have it. A fingerprint is cut into parts, and under the covering masks of ``simhash`` two
texts meet if some part's masked bits agree; they do for certain if a part differs in RADIUS bits or fewer. Bits of sets of
similarity s differ with a probability of acos(2 s / (1 + s)) / pi at most, and there are as many parts as it takes for such
a pair to meet nowhere with a probability of MISSED at most. Parts grow with the logarithm of the number of
texts, so that the texts that meet by chance stay in proportion to it.

Small sets' bits differ more often than the angle says, by up to SLACK for over FEW shingles at similarity 0.8; smaller sets
also meet by their shingles themselves.

Before fingerprints are made, texts that have no similar text leave: of the LEAST smallest hashes of two sets' union
each is in both sets with probability s, so a text few of whose own smallest hashes are among another's is
similar to none (again but for a probability of MISSED). Texts that meet are compared by ``similar.labels_of``: by
sketches that allow or rule out the similarity for certain, by the first PRINT words of their fingerprints, which are
further apart than ``n_apart`` with a probability of MISSED at most if the texts are similar, then on the whole sets; in large
buckets by two members, by the largest component and by prefixes of rare shingles.

Defined cases: those of ``similar``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import simhash
from .common import arrow_map, brief_shuffles, removed, row_key, signed, written
from .similar import _LONGS, _ODD, _allowed, _few, _mixed, MISSED, SHINGLE, SIMILARITY, labels_of, shingle_hashes, sketch, words_of

RADIUS, LEAST, FEW, SLACK = 2, 32, 16, 0.007
#: Bits of a part at least, and by how many bits a masked part is longer than the logarithm of the number of texts.
PART_BITS, SPARE_BITS = 28, 3
#: Words of the fingerprint that texts are compared by.
PRINT = 8
_PRINTS = [f"f{i}" for i in range(PRINT)]
_LANES = np.uint64(0x0101010101010101)


def part_bits(texts: int) -> int:
    """Masks leave 4 of 7 bits of a part."""
    return min(64, max(PART_BITS, math.ceil((math.log2(max(texts, 1)) + SPARE_BITS) * 7 / 4)))


def meeting(bits: int, apart: float) -> float:
    """The probability that a part's masked bits agree under some mask, if each bit differs with probability apart."""
    masks, p = simhash.covering_masks(RADIUS, bits), 0.0
    for size in range(1, len(masks) + 1):
        for some in combinations(masks, size):
            seen = 0
            for m in some:
                seen |= m
            p += (-1) ** (size + 1) * (1 - apart) ** seen.bit_count()
    return p


def bit_apart(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi + SLACK if similarity < 1 else 0.0


def n_parts(similarity: float, bits: int) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-meeting(bits, bit_apart(similarity))))


def n_apart(similarity: float) -> int:
    """In how many of 64 * PRINT bits similar texts differ at most, but for a probability of MISSED."""
    p, n, above = bit_apart(similarity), 64 * PRINT, 0.0
    for k in range(n, 0, -1):
        above += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if above > MISSED:
            return k
    return 0


def allowed(similarity: float) -> Column:
    """Whether the sketches and fingerprints of x and y allow the similarity; small sets go by their sketches."""
    apart = sum((F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))) for f in _PRINTS), F.lit(0))
    return _allowed(similarity) & ((F.least("x.n", "y.n") <= FEW) | (apart <= n_apart(similarity)))


def n_shared(similarity: float) -> int:
    """How many of its LEAST smallest hashes a text shares with a similar one, but for a probability of MISSED."""
    below = 0.0
    for k in range(LEAST):
        below += math.comb(LEAST, k) * similarity**k * (1 - similarity) ** (LEAST - k)
        if below > MISSED:
            return k
    return LEAST


def long_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """A row of 64 bits for each word, of a set's hashes."""
    by = np.random.default_rng(43).integers(0, 1 << 63, (words, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.zeros((8, words, 8), np.int64)
    for a in range(0, len(h), 255):  # eight counters of a byte each in a long
        mixed = _mixed(h[a : a + 255] * by)
        for i in range(8):
            counts[i] += ((mixed >> np.uint64(i)) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(words, 8)
    return (counts * 2 > len(h)).transpose(1, 2, 0).reshape(words, 64)


def buckets(h: np.ndarray, made: np.ndarray, parts: int, bits: int, masks: np.ndarray) -> np.ndarray:
    """A long for each part and mask of a set's fingerprint, and one for each shingle of a small set."""
    held = np.zeros((parts, 64), np.uint8)
    held[:, :bits] = made.ravel()[: parts * bits].reshape(parts, bits)
    masked = np.packbits(held, axis=1, bitorder="little").view(np.uint64) & masks
    found = _mixed(np.arange(1, masked.size + 1, dtype=np.uint64) * _ODD[1] + masked.ravel())
    return (np.concatenate([found, _mixed(h * _ODD[2])]) if len(h) <= FEW else found).view(np.int64)


def _least(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, counts, found = [], [], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                h = shingle_hashes(words, shingle)
                nodes.append(signed(xxhash.xxh64_intdigest(b" ".join(words))))
                counts.append(len(h))
                found.append(h[:LEAST].view(np.int64))
            least = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), least], names=["doc_id", "row_key", "node", "n", "least"])

    return run


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):  # a row at a time: a set is larger than its text
                h = shingle_hashes(words_of(text), shingle)
                longs = [*sketch(h), *np.packbits(long_fingerprint(h, PRINT), axis=1).view(np.int64).ravel().tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(h)], pa.int64()), pa.array([h.view(np.int64)], pa.list_(pa.int64())), *[pa.array([x], pa.int64()) for x in longs]], names=["node", "n", "grams", *_LONGS, *_PRINTS])

    return run


def _bands(parts: int, bits: int) -> Callable:
    masks = simhash.covering_masks(RADIUS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.array(masks, np.uint64)
        for b in batches:
            for i in range(b.num_rows):
                h = b.column(1)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = buckets(h, long_fingerprint(h, -(-parts * bits // 64)), parts, bits, by)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), b.column(0)[i].as_py()), pa.int64())], names=["band", "node"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, row_key (of the text), root (the component of all pairs of the similarity)."""
    if shingle < 1 or not 0 < similarity <= 1:
        raise ValueError("shingle must be 1 or more, similarity above 0 and at most 1")
    with brief_shuffles(docs.sparkSession):
        rows, labels = _grouped(docs, id_col, text_col, shingle, similarity)
    if labels is None:
        return rows.select("doc_id", "row_key", F.col("node").alias("root"))
    labels = labels.withColumnRenamed("node", "_node")
    return rows.join(labels, F.col("node") == F.col("_node"), "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, row_key, node of each row, and the labels of nodes."""
    text = F.col(text_col).cast("string").alias("text")
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("row_key"), text)
    made = written(arrow_map(asked, _least(shingle), "doc_id long, row_key long, node long, n long, least array<long>"), "least")
    nodes = written(made.where("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("least").alias("least")), "nodes")
    rows = written(made.select("doc_id", "row_key", "node"), "rows")
    removed(made)
    grams = nodes.select("node", F.explode("least").alias("gram"))
    shared = grams.groupBy("gram").count().where("count > 1").select("gram")
    enough = F.least(F.lit(n_shared(similarity)), F.ceil(F.col("n") * similarity - 1e-9))
    found = grams.join(shared, "gram").groupBy("node").count()
    keys = written(found.join(nodes.select("node", "n", "row_key"), "node").where(F.col("count") >= enough).select("row_key", "node"), "keys")
    removed(nodes)
    bits = part_bits(keys.count())
    keyed = docs.select(row_key(text_col).alias("_key"), text)
    texts = keyed.join(_few(keys), F.col("_key") == F.col("row_key")).groupBy("node").agg(F.first("text").alias("text"))
    sets = written(arrow_map(texts, _sets(shingle), f"node long, n long, grams array<long>, {', '.join(f'{s} long' for s in (*_LONGS, *_PRINTS))}"), "sets")
    # buckets aren't written: they take more room than the sets
    met = arrow_map(sets.select("node", "grams"), _bands(n_parts(similarity, bits), bits), "band long, node long")
    labels = labels_of(met, sets, similarity, allowed=allowed(similarity))
    removed(sets)
    return rows, labels
