"""Near-duplicates by shingle similarity, and the pipeline's stage, against brute force."""

import random

import duckdb
import pytest

import corpus_pipeline
from scanlake.llm import similar

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def roots(rows, similarity=0.8):
    """doc_id: the smallest id reachable over pairs of the similarity."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for m, (i, a) in enumerate(sets):
        for j, b in sets[m + 1 :]:
            if a == b or len(a & b) / len(a | b) >= similarity:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def planted():
    """Texts of 200 words with 1 to 6 words changed at places apart, chains of such, and pairs just below the threshold."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        rows.append(base)
        for changes in (1, 2, 3, 4, 5, 6):
            near = list(base)
            for i in range(changes):
                near[10 + 30 * i] = word()
            rows.append(near)
    chain = [word() for _ in range(200)]
    for i in range(30):  # the first and the last have little in common
        chain = list(chain)
        chain[(37 * i) % 200] = word()
        rows.append(chain)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(1000 + i, " ".join(rows[k])) for i, k in enumerate(order)]


def grouped(rows, column="root"):
    found = {}
    for r in rows:
        found.setdefault(r[column], set()).add(r["doc_id"])
    return sorted(map(sorted, found.values()))


def wanted(rows):
    found = {}
    for i, r in roots(rows).items():
        found.setdefault(r, set()).add(i)
    return sorted(map(sorted, found.values()))


def alike_below():
    """A large band: 60 texts that share two thirds, of which some pairs are similar, and 40 copies with one word changed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, rows = [word() for _ in range(60)], []
    for _ in range(30):
        own = [word() for _ in range(30)]
        near = list(own)
        near[rng.randrange(30)] = word()
        rows += [shared + own, shared + near]
    for _ in range(40):
        near = list(shared)
        near[rng.randrange(60)] = word()
        rows.append(near)
    return [(5000 + i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("small", [2, 8, 1000])
def test_large_bands_leave_no_pair_out(spark, monkeypatch, small):
    monkeypatch.setattr(similar.labels_of, "__defaults__", (small,))
    rows = alike_below() + planted()[:40]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    assert grouped(similar.similar_documents(docs).collect()) == wanted(rows)


def test_every_similar_pair_is_linked(spark):
    rows = planted() + alike_below() + [(1, None), (2, " \t"), (3, ""), (4, "one two"), (5, "One  TWO"), (6, "two one")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    assert grouped(similar.similar_documents(docs).collect()) == wanted(rows)
    assert similar.similar_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_bands_miss_next_to_nothing(similarity):
    assert (1 - similarity**similar.ROWS) ** similar.n_bands(similarity) <= similar.MISSED


def test_stage_leaves_one_of_each_group(spark):
    rows = planted() + duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(got) == sorted(set(roots(rows).values()))
