"""Quality rules, near-duplicates, mixing and packing against brute force, and their defined cases."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scanlake.llm import components, mixing, packing, quality, simhash

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, h1 string, fp string"


def odd_documents(spark, extra=()):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(3)
    clean = " ".join(rng.choice(words) for _ in range(120))
    rows = [(1, clean, "a"), (2, clean, "a"), (2, clean, "a"), (None, clean, None), (3, None, "a"), (4, "", "b"), (5, " \t\n", None), (6, "x " * 30000, "b"), (None, None, None), (7, clean + " tail", "b"), (8, "Ünïcode ﬀ     İ ǅ ς Σ", "c"), *extra]
    return spark.createDataFrame([(i, t, "en", s, 0, "k", "z", "h", "f") for i, t, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return duckdb.connect().execute(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()


# ---- quality rules

def test_base_rules_as_brute_force(spark):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    for i, text, _ in texts():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x85 é#|", max_size=60))
def test_document_rules(text):
    n, chars, symbols, dup, repeat, _, found = quality.document_rules(text)
    assert (n, chars, symbols, dup, repeat) == brute.base_rules(text)[:5]
    assert sum(found.values()) == n


def test_lines_above_limits_deplete(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    boiler = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = []
    for i in range(60):  # 40 documents share three lines of 30 words; every fourth of them has little else
        own = " ".join(word() for _ in range(20 if i % 4 == 0 else 200))
        rows.append((100 + i, "\n".join([*boiler, own]) if i < 40 else own + " " + own[:-1] + "x" * 60, "h"))
    copy = "\n".join(" ".join(word() for _ in range(15)) for _ in range(10))
    rows += [(500 + i, copy, "h") for i in range(50)]  # a group of copies counts as one document
    got = {r.doc_id: r for r in quality.quality_rules(odd_documents(spark, rows)).collect()}
    assert all(got[100 + i].removed_words == 90 and got[100 + i].kept == (i % 4 != 0) for i in range(40))
    assert all(got[500 + i].kept and got[500 + i].removed_words == 0 for i in range(50))
    left = {r.doc_id: r.text for r in quality.kept_documents(odd_documents(spark, rows)).collect() if (r.doc_id or 0) >= 100}
    assert set(left) == {i for i in got if (i or 0) >= 100 and got[i].kept}
    assert not any(line in text for line in boiler for text in left.values())


def normal(line):
    return " ".join(brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if c in "123456789" else c for c in line)))


def removal_by_hand(rows, min_docs, max_share):
    """rows: id, text, host. For each row: words removed, the text left, and whether enough words are left."""
    stands, docs = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        docs[host].add(text or "")
        for line in (text or "").split("\n"):
            stands[host, normal(line)].add(text)
    out = []
    for i, text, host in rows:
        over = lambda x: normal(x) and len(stands[host, normal(x)]) > max(min_docs, max_share * len(docs[host]))  # noqa: B023, E731
        lines = (text or "").split("\n")
        removed = sum(len(normal(x).split(" ")) for x in lines if over(x))
        n = len(brute.WORD.findall(text or ""))
        out.append((i, removed, text and "\n".join(x for x in lines if not over(x)), n - removed >= 0.5 * n))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_removed_lines_as_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["Ab", "ab", "x1", "x2", "é", "\x85", "Q"]
    line = lambda: rng.choice([" ", "", "\t"]) + rng.choice([" ", "  ", "\x0b"]).join(rng.choice(words) for _ in range(rng.randint(0, 2))) + rng.choice(["", " ", "\r"])
    rows = [(i, rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(line() for _ in range(rng.randint(1, 5))) + "\n" + " ".join(f"u{i}w{j}" for j in range(rng.choice([0, 1, 40, 60]))), rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(i + 1000, t, h) for i, t, h in rows if rng.random() < 0.3]  # copies count once
    docs = spark.createDataFrame([(i, t, "en", h, -1, "k", "z", "h", "f") for i, t, h in rows], DOCS)
    asked = {"min_docs": 3, "max_share": 0.06}
    got = {r.doc_id: r for r in quality.quality_rules(docs, **asked).collect()}
    want = removal_by_hand(rows, 3, 0.06)
    assert len({w[1] for w in want}) > 3
    for i, removed, _, enough in want:
        assert (got[i].removed_words, got[i].kept) == (removed, enough and not got[i].base_failed)
    left = {r.doc_id: r for r in quality.kept_documents(docs, **asked).collect()}
    assert {i: t for i, _, t, _ in want if got[i].kept} == {i: r.text for i, r in left.items()}
    assert all(r.n_chars == (len(r.text) if got[i].removed_words else -1) and r.kept == "k" and r.h1 == "h" for i, r in left.items())


def test_quality_defined_cases(spark):
    docs = odd_documents(spark)
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 5  # 1, 2 twice, the null id, 7
    assert quality.quality_rules(empty(spark)).count() == 0 and quality.kept_documents(empty(spark)).count() == 0


# ---- near-duplicates

def test_masks_cover():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            flips = 1 << i | 1 << j
            assert any(m & flips == 0 for m in masks)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉ é\t\n\x0b .", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def test_near_duplicates_as_brute_force(spark):
    want = brute.component_ids([(i, brute.fingerprint(t)) for i, t, _ in texts()])
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.query(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert len({c for *_, c in got}) < len(got)


@pytest.mark.parametrize("small", [0, 3, 1000])
def test_links_in_small_and_large_buckets(spark, small):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:4]:  # chains and clouds around some
        x = base
        for _ in range(40):
            x ^= 1 << rng.randrange(64)
            prints.add(x)
        prints |= {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)}
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    fps = spark.createDataFrame([(simhash.signed(f),) for _, f in rows], "fp long")
    edges = simhash.links(fps, small=small)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in edges.collect())
    label = {r.node: r.root for r in components.components(edges).collect()}
    want = defaultdict(set)
    for i, f, c in brute.component_ids(rows):
        want[c].add(simhash.signed(f))
    got = defaultdict(set)
    for _, f in rows:
        f = simhash.signed(f)
        got[label.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(2000 - i, 2001 - i) for i in range(50)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(301)) and all(got[1951 + i] == 1951 for i in range(51))


def test_near_duplicates_defined_cases(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(3) == 1 and None not in ids
    twice = simhash.one_of_each(docs.where("doc_id = 2"))
    assert twice.count() == 1
    assert simhash.one_of_each(docs.where("doc_id is null and text is not null")).count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


# ---- mixing

def filled(sizes, weights, repeats):
    """The contract's resharing, step by step."""
    total, cap, fixed = sum(sizes), [repeats * s for s in sizes], set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(cap[i] for i in fixed)) / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if level * weights[i] > cap[i]]
        if not over:
            return [cap[i] if i in fixed else level * weights[i] for i in range(len(sizes))]
        fixed |= set(over)


def test_targets_as_resharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 20):
        sizes = [rng.choice([0, 1, 10, 500, 10000]) for _ in range(n)]
        names = sorted(f"s{i}" for i in range(n - 1)) + [None]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
        want = filled(sizes, [i % 3 + 1 for i in range(n)], 3)
        assert [got[s] for s in names] == pytest.approx(want)


def test_mix_meets_targets(spark):
    rows = mixing.query(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for (target, size), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)


def test_mix_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.query(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_mix_cuts_inside_equal_rows(spark):
    rows = [(1, "one two three", "a")] * 400 + [(i, "x " * 10, "b") for i in range(102, 140)] + [(150, "y " * 900, "c")]
    docs = odd_documents(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    a = [r for r in got if r.doc_id == 1]
    assert abs(sum(r.taken for r in got if r.source_size == a[0].source_size) - a[0].target) <= 120
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (3, 4, 5))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.n_words("text"))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# ---- packing

@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    return packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzÉéßÿ×÷ªº²'st re’“–¡¿ 09\t\n\r\x0b\x85 <|>é̂İΣς\x1c¼"), st.characters(codec="utf-8")), max_size=30))
def test_words_give_the_tokenizer_ids(words, text):
    assert words.ids(text).tolist() == words.whole.encode(text, add_special_tokens=False).ids


def test_words_of_documents(words):
    for _, text, _ in texts()[:120]:
        assert words.ids(text).tolist() == words.whole.encode(text, add_special_tokens=False).ids


def valid(patterns, counts, capacity):
    used = Counter()
    for inside, times in patterns:
        assert sum(n * c for n, c in inside) <= capacity and times > 0
        for n, c in inside:
            used[n] += c * times
    assert used == Counter({n: c for n, c in counts.items() if c})
    return sum(t for _, t in patterns)


def fewest(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[i] <= capacity:
                k = bins.index(b)
                go(i + 1, [*bins[:k], b + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=400, deadline=None)
@given(st.integers(4, 30).flatmap(lambda room: st.tuples(st.just(room), st.lists(st.integers(1, room), max_size=10) | st.lists(st.integers(max(1, room // 6), max(1, room // 2)), max_size=11))))
def test_pack_is_optimal_on_small_sets(case):
    capacity, lengths = case
    counts = Counter(lengths)
    n = valid(packing.pack(counts, capacity, 1_000_000), counts, capacity)
    assert packing.lower_bound(counts, capacity) <= n == fewest(sorted(lengths, reverse=True), capacity)


def replaceable(filling, counts, room):
    """Whether some of the filling's lengths can make way for one that is left over, as long as they and fitting."""
    left = Counter(counts)
    left.subtract(filling)
    spare = room - sum(filling)
    parts = [c for k in range(3) for c in itertools.combinations(range(len(filling)), k)]
    return any(n > 0 and sum(filling[i] for i in c) + (len(c) == 1) <= y <= sum(filling[i] for i in c) + spare for y, n in left.items() for c in parts)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 14), st.lists(st.integers(1, 14), max_size=8))
def test_fillings_are_the_undominated_sets(room, lengths):
    counts = Counter(lengths)
    got = [f for f in packing.fillings(sorted(counts), counts, room) if f is not None]
    every = {tuple(sorted(c, reverse=True)) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room}
    want = {f for f in every if not replaceable(f, counts, room)}
    if counts[room]:  # one length alone stands for all
        want = {(room,)}
    assert sorted(got) == sorted(want) and [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["abc 12 ", "é中文 ", "́ſ ß", "<|endoftext|>", "don't\n", "Σα σ ", "x"]), max_size=60))
def test_long_texts_in_parts(words, some):
    text = "".join(some)
    packing.CHUNK, was = 40, packing.CHUNK
    try:
        assert "".join(packing.parts_of(text)) == text
        assert words.ids(text).tolist() == words.whole.encode(text, add_special_tokens=False).ids
    finally:
        packing.CHUNK = was


def test_bin_completion_beats_best_fit():
    counts = Counter([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])  # fills 4 sequences of 10 exactly
    assert valid(packing.pack(counts, 10), counts, 10) == 4
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(100, 1500, 4000).tolist())
    n = valid(packing.pack(counts), counts, 2048)
    assert packing.lower_bound(counts) <= n <= sum(t for _, t in packing.best_fit_decreasing(counts))


def check_packed(rows, want):
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(spans)


def expected(rows, words):
    out = []
    for i, text in rows:
        ids = [*words.whole.encode(text or "", add_special_tokens=False).ids, 0]
        out += [(-1 if i is None else i, k, a, len(ids[a : a + 2048]), brute.crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    return out


def test_packed_documents(spark, words):
    rows = packing.query(spark, SF).collect()
    n = check_packed(rows, expected([(i, t) for i, t, _ in texts()], words))
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_packing_defined_cases(spark, words):
    import public_tokenizers

    path, docs = public_tokenizers.path("word_bpe_49k.json"), odd_documents(spark)
    check_packed(packing.pack_documents(docs, path).collect(), expected([(r.doc_id, r.text) for r in docs.collect()], words))
    assert packing.pack_documents(empty(spark), path).count() == 0


