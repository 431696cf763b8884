"""The pipeline's near-duplicates by SimHash covering: fingerprints and buckets against brute force, and the probabilities."""

import math
import os
import random

import numpy as np
import pytest

import corpus_pipeline
from scanlake.llm import common, covering, simhash, similar

from .test_similar import DOCS, SF, alike_below, grouped, planted, roots, wanted


def hashes(n, seed=1):
    return similar.shingle_hashes([str(random.Random(f"{seed} {i}").random()).encode() for i in range(n)], 1)


@pytest.mark.parametrize("n", [1, 4, 255, 256, 700])
def test_long_fingerprint(n):
    h = hashes(n)
    by = np.random.default_rng(43).integers(0, 1 << 63, (3, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    want = [[2 * sum(int(x) >> i & 1 for x in row) > n for i in range(64)] for row in similar._mixed(h * by)]
    assert covering.long_fingerprint(h, 3).tolist() == want


@pytest.mark.parametrize("bits", [28, 32, 41, 64])
def test_buckets_are_masked_parts(bits):
    masks, parts = simhash.covering_masks(2, bits), 9
    a, b = hashes(300), np.unique(np.concatenate([hashes(300)[30:], hashes(30, 2)]))
    made = [covering.long_fingerprint(h, 10) for h in (a, b)]
    x, y = ([int(sum(int(v) << i for i, v in enumerate(part))) for part in m.ravel()[: parts * bits].reshape(parts, bits)] for m in made)
    by = np.array(masks, np.uint64)
    got = covering.buckets(a, made[0], parts, bits, by) == covering.buckets(b, made[1], parts, bits, by)
    assert got.tolist() == [(p ^ q) & m == 0 for p, q in zip(x, y, strict=True) for m in masks]
    for i in range(bits):  # the radius is covered
        for j in range(i, bits):
            assert any(m & (1 << i | 1 << j) == 0 for m in masks)


def apart(c, x, y):
    """The probability that a bit differs between sets of c common shingles and x and y others."""
    odds = [[math.comb(n, k) / 2**n for k in range(n + 1)] for n in (c, x, y)]
    p = 0
    for k, w in enumerate(odds[0]):
        a, b = (sum(v for i, v in enumerate(o) if 2 * (k + i) > c + n) for o, n in ((odds[1], x), (odds[2], y)))
        p += w * (a * (1 - b) + b * (1 - a))
    return p


def test_a_similar_pair_is_missed_next_to_never():
    for texts in (1, 1000, 30_000, 2_000_000):
        bits = covering.part_bits(texts)
        parts = covering.n_parts(0.8, bits)
        for union in range(covering.FEW + 1, 90):
            c = math.ceil(0.8 * union)
            for x in range(union - c + 1):
                if min(c + x, union - x) > covering.FEW:
                    assert (1 - covering.meeting(bits, apart(c, x, union - c - x))) ** parts <= similar.MISSED
    need = covering.n_shared(0.8)
    assert sum(math.comb(32, k) * 0.8**k * 0.2 ** (32 - k) for k in range(need)) <= similar.MISSED and need > 8
    far = covering.n_apart(0.8)
    for c, x, y in ((18, 2, 2), (31, 3, 4), (40, 4, 5), (80, 10, 10), (120, 0, 30)):
        p = apart(c, x, y)
        assert sum(math.comb(512, k) * p**k * (1 - p) ** (512 - k) for k in range(far + 1, 513)) <= similar.MISSED and far < 160


def small_sets():
    """Pairs of 4 and 5 shingles up to 20 and 25, of similarity 0.8 and more, and texts of a few words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for n in range(5, 30):
        base = [word() for _ in range(n)]
        rows += [base, [*base, word()], [word(), *base], base[1:], [*base[:-1], word()]]
    return [(9000 + i, " ".join(r)) for i, r in enumerate(rows)]


def test_every_similar_pair_is_linked(spark):
    rows = planted() + alike_below() + small_sets() + [(1, None), (2, " \t"), (3, ""), (4, "one two"), (5, "One  TWO"), (6, "two one")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    assert grouped(covering.near_copies(docs).collect()) == wanted(rows)
    assert covering.near_copies(docs.limit(0)).count() == 0


def test_the_stage_goes_by_fingerprints(spark, monkeypatch):
    """With one part only, and that of 64 bits, copies are found but most near copies don't meet."""
    rows = planted()
    rows += [(i + 5000, t.upper()) for i, t in rows[:10]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(set(roots(rows).values()))
    monkeypatch.setattr(covering, "n_parts", lambda similarity, bits: 1)
    monkeypatch.setattr(covering, "part_bits", lambda texts: 64)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert len(set(roots(rows).values())) + 20 < len(left) and not any(i >= 5000 for i in left)


def test_tables_go_when_they_have_been_read(spark):
    top = common.shared_dir(spark).removeprefix("file://") + "/scanlake"
    rows, key = planted() + alike_below(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs, was, set_to = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS), set(os.listdir(top) if os.path.isdir(top) else ()), spark.conf.get(key, None)
    found = covering.near_copies(docs)
    left = {name.split("-")[0] for name in set(os.listdir(top)) - was}
    assert "rows" in left and not left & {"least", "nodes", "sets", "bands", "grams"}
    assert spark.conf.get(key, None) == set_to and grouped(found.collect()) == wanted(rows)


def test_a_few_pairs_move_few_sets(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f", "s") for i in range(50)], DOCS)
    sets = docs.selectExpr("doc_id as node", "array(1L, 2L) as grams")
    plan = similar.alike(spark.createDataFrame([(1, 2)], "a long, b long"), sets, 0.8)
    assert [tuple(r) for r in plan.collect()] == [(1, 2)]
    assert "LeftSemi" in plan._jdf.queryExecution().optimizedPlan().toString()
