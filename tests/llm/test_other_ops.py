"""License scans, sharding, URL filters, chat formatting, WARC and lossless WebP against brute force, and their defined cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scanlake.llm import chat, common, licenses, sharding, urls, warc, webp

SF = "/root/testdata/sf0.001"


def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def texts():
    return con().execute("select doc_id, text from documents").fetchall()


def odd(spark, extra=()):
    rows = [(1, "same text"), (2, "same text"), (2, "same text"), (None, "same text"), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, "long words " * 20000), (7, "Ünïcode ﬀ İ \x00 \x85"), *extra]
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, size string, shard string, at string")


def empty(df):
    return df.limit(0)


# ---- licence scans

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = LICENSE_WORD.findall(low)
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_as_brute_force(spark):
    got = {r.doc_id: r for r in licenses.query(spark, SF).collect()}
    for i, text in texts():
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


SCANNER = licenses.Scanner()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("cc by general public license all rights reserved GNU under the MIT x é, 2.0".split()), max_size=25))
def test_license_phrases(words):
    assert SCANNER.row(" ".join(words))[:5] == base_places(" ".join(words))


def longest(strings, words):
    """Matching statistics, by trying."""
    parts = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max((k for k in range(1, i + 1) if tuple(words[i - k : i]) in parts), default=0) for i in range(1, len(words) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=2, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_automaton_gives_matching_statistics(strings, words):
    a = licenses.Automaton(strings)
    seen = list(a.stream(words))
    assert [n for _, n in seen] == longest(strings, words)
    for at, (v, n) in enumerate(seen, 1):
        if n:
            part = words[at - n : at]
            assert set(a.ends[v]) == {(k, e) for k, s in enumerate(strings) for e in range(n - 1, len(s)) if s[e - n + 1 : e + 1] == part}


def test_license_spans():
    text = "Some code.\n" + licenses.TEMPLATES[2][1].replace("to deal in", "and to deal with") + " More words here."
    row = SCANNER.row(text)
    assert row[5] == "mit" and 0.9 < row[6] < 1
    span = row[7][0]
    words = licenses.words_of(text)
    assert words[span["first_word"]] == b"permission" and words[span["end"] - 1] == b"software"
    assert SCANNER.row("to use and to copy the software without fee")[5:7] == ("", pytest.approx(0, abs=0.3))
    assert SCANNER.row("This work is licensed under the GNU General Public License, version 3.")[4:6] == ("gpl", "gpl,gpl-3.0")


def test_license_defined_cases(spark):
    docs = odd(spark)
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == docs.count() and all(r.n_words == 0 and r.score == 0 and r.first_word is None for r in rows if r.doc_id in (3, 4, 5))
    assert licenses.license_scan(empty(docs)).count() == 0


# ---- sharding

def check_shards(rows, docs, shards=16, tolerance=0.05):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total = sum(sizes.values())
    spare = max((len((t or "").encode()) + 1 for _, t in docs), default=0) + sharding.GROUP_SHARE * total / shards
    assert all(abs(sizes[s] - total / shards) <= spare for s in range(shards))
    of = defaultdict(set)
    weight = Counter()
    for i, t in docs:
        weight[t] += len((t or "").encode()) + 1
    for r in rows:
        of[r.text_crc32].add(r.shard)
    for t, w in weight.items():
        if w <= sharding.GROUP_SHARE * total / shards:
            assert len(of[zlib.crc32((t or "").encode())]) == 1
    return sizes


def test_shards_of_documents(spark):
    check_shards(sharding.query(spark, SF).collect(), texts())


def test_shards_split_a_large_group(spark):
    rng = random.Random(4)
    rows = [(i, "copy " * 20) for i in range(3000)] + [(9000, "again")] * 2000 + [(i, f"{rng.random()} " * rng.randrange(1, 12)) for i in range(10000, 14000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, shards=5)
    check_shards(got.collect(), rows, shards=5)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, sharding.shard(docs.coalesce(1), shards=5).collect()))


def test_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    rows = [(i, "copy") for i in range(2000)] + [(10_000 + i, f"text {i}") for i in range(1000)]
    check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_sharding_defined_cases(spark):
    docs = odd(spark)
    rows = sharding.shard(docs).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.size == 1 and r.text_crc32 == 0 for r in rows if r.doc_id in (3, 4))
    assert sharding.shard(empty(docs)).count() == 0
    carried = sharding.shard(docs, carry=True).select("row.*")
    assert carried.columns == docs.columns and carried.count() == docs.count()


# ---- URL filters

def judged(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        of, at = rule.split("/", 1)
        if (host == of or host.endswith("." + of)) and path.startswith("/" + at) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


ODD_URLS = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com/en", "http://com/en/", "http://a.net/es/", "http://anet/es/", "http://x.net?/es/", "http://Ä.NET/fr/é",
            "a://b://c/d", "http://a.org/x\ny/z", "http://h.org/" + "/".join(map(str, range(300))), "http://h.org//a///b/", "http://h.org/*/**/+"]


def test_rules_as_brute_force(spark):
    rows = [(i, u) for i, u in enumerate([*ODD_URLS, *(x[0] for x in con().execute("select url from pages").fetchall())])]
    df = spark.createDataFrame([*rows, (None, "http://q.org/1"), (0, None)], "page_id long, url string").selectExpr("*", "'x' host", "'y' path", "'z' verdict")
    got = urls.url_verdicts(df).collect()
    assert len(got) == len(rows) + 2
    by = {r.page_id: r for r in got}
    for i, u in rows:
        host, path, rule = judged(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule[0] if rule else None), u
        if rule:
            assert by[i].verdict == rule[1]
    assert urls.url_verdicts(empty(df)).count() == 0


def test_templates_and_purity(spark):
    rows, labels = [], []

    def add(path, n, bad, host="h.org"):
        for i in range(n):
            rows.append((len(rows), f"http://{host}{path.format(i=i)}"))
            if bad is not None:
                labels.append((rows[-1][0], bad > rows[-1][0] % 10))

    add("/user/{i}", 40, 0)
    add("/spam/{i}.html", 40, 10)  # all bad: rejected
    add("/spam/{i}.html", 40, None)  # and so are those without a label
    add("/a/name{i}x/edit", 40, 5)  # wide: a wildcard; half are bad
    for b in "pq":  # alike, so merged
        add(f"/news/{b}/{{i}}", 30, 1)
    add("/news/bad/{i}", 30, 10)
    got = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad boolean")).collect()}
    by = defaultdict(set)
    for i, u in rows:
        by[u.split("/")[3]].add((got[i].template, got[i].verdict))
    assert by["user"] == {("/user/*", "allow")} and by["spam"] == {("/spam/*", "block")} and by["a"] == {("/a/*/edit", "allow")}
    assert by["news"] == {("/news/bad/*", "block"), ("/news/p/*", "allow"), ("/news/q/*", "allow")} or by["news"] == {("/news/bad/*", "block"), ("/news/+/*", "allow")}


# ---- chat formatting

@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb", "x<|im_end|>", "\\n"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "n", "<", "|im_end|>", "\n", "é", "<|im_start|>assistant\nx<|im_end|>\n"]), max_size=6).map("".join)), max_size=4))
def test_chat_round_trip(turns):
    out = "".join(chat.render(r, t) for r, t in turns)
    assert chat.parse(out) == [(r, t, r == "assistant") for r, t in turns]
    for _, t in turns:
        escaped = chat.escape(t, chat.CONTROLS)
        assert chat.unescape(escaped) == t and not any(c in escaped for c in chat.CONTROLS)


def test_chat_as_sql(spark):
    want = con().execute(chat.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in chat.query(spark, SF).collect()]
    assert sorted(got) == sorted(want) and -7 in {r[0] for r in got}


def test_chat_defined_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, 0, "assistant", "y"), (2, 0, "system", "z" * 100_000)]
    rows += [(3, i, "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' formatted")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(df)).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[None].n_turns == 2 and got[2].loss_chars == 0
    assert got[3].n_turns == 3000 and got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(3000)).encode()).hexdigest()
    assert chat.conversation_digests(chat.formatted_turns(empty(df))).count() == 0


# ---- WARC

def test_warc_as_sql(spark):
    want = con().execute(warc.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in warc.query(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_records_and_defined_cases(spark):
    long = "é<p>" * 300_000
    rows = [(1, "http://a.org/x?y#z", "same"), (2, "http://a.org/ b\r\nEvil: 1", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"), (8, "u", "\r\n\r\n"), (9, "u", "x"), (9, "u", "x"), (None, "n", "null id"), (None, "n", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' digest", "'w' lead")
    warc.write_archives(df, path := common.scratch_path(spark, "archives"))
    found = warc.read_records(spark, path, with_payload=True)
    assert found.count() == 3 * len(rows)
    got = warc.transactions(found).collect()
    assert len(got) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    by = {r.page_id: r for r in got}
    texts = {i: h for i, _, h in rows if i}
    for i, h in texts.items():
        assert (by[i].payload_bytes, by[i].payload_digest) == (len((h or "").encode()), digest(h))
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5, 6, 7, 9)] == [("revisit", 3), ("revisit", 3), ("response", None), ("revisit", 5), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert sum(r.page_id is None and r.record_type == "revisit" and r.refers_to == 3 for r in got) == 1
    assert bytes(by[6].response.payload).decode() == long and by[6].metadata.page_id == "6" and by[6].request.concurrent_to is None
    warc.write_archives(empty(df), path := common.scratch_path(spark, "archives"))
    assert warc.transactions(warc.read_records(spark, path)).count() == 0


def test_warc_reads_members_of_each_record():
    import gzip

    record = lambda t: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(t), t)
    blocks = [b"", b"a" * 3_000_000, b"\r\n\r\nb"]
    for raw in (b"".join(gzip.compress(record(b)) for b in blocks), b"".join(map(record, blocks))):
        assert [b for _, b in warc.records(raw)] == blocks
    with pytest.raises(ValueError):
        list(warc.records(record(b"abc")[:-6]))


# ---- lossless WebP

def picture(rng, h, w, colours):
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    out = table[rng.integers(0, colours, (h, w))]
    out[h // 2 :] = out[: h - h // 2]  # something to refer back to
    return out


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0), (0, 1, 2), (1, 0), (3, 0), (2, 1, 0)])
@pytest.mark.parametrize("cache_bits, references", [(0, False), (0, True), (3, False), (11, True)])
def test_webp_round_trip(transforms, cache_bits, references):
    rng = np.random.default_rng(len(transforms) + cache_bits)
    for h, w, colours in ((1, 1, 1), (5, 7, 2), (9, 13, 4), (20, 33, 16), (31, 17, 200)):
        p = picture(rng, h, w, colours)
        assert (webp.decode(webp.encode(p, transforms, cache_bits, references)) == p).all()


def test_webp_smooth_picture_with_every_predictor():
    y, x = np.mgrid[0:40, 0:40].astype(np.uint32)
    p = webp.OPAQUE | (x * 5) << 16 | (y * 6) << 8 | (x + y) & 255
    p = p.astype(np.uint32)
    for mode in range(14):
        got = webp.encode(p, (0,), modes=np.full(100, mode))
        assert (webp.decode(got) == p).all()


def by_hand(bits):
    """A RIFF file from (value, bits) pairs."""
    w = webp._Writer()
    for v, n in bits:
        w.write(v, n)
    data = w.bytes()
    return b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) % 2)


def test_webp_stream_by_hand():
    # 3 x 1, no transform, cache or groups; green has symbols 10 and 200, the others 1, 2, 255
    head = [(0x2F, 8), (2, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    simple = lambda *s: [(1, 1), (len(s) - 1, 1), (1, 1), *((x, 8) for x in s)]
    codes = [*simple(10, 200), *simple(1), *simple(2), *simple(255), *simple(0)]
    assert webp.decode(by_hand([*head, *codes, (1, 1), (0, 1), (1, 1)])).tolist() == [[0xFF01C802, 0xFF010A02, 0xFF01C802]]
    with pytest.raises(ValueError):
        webp.decode(by_hand([*head, *codes[:9]]))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text(max_size=800).map(str.encode), st.binary(min_size=1, max_size=9).map(lambda b: b * 200)))
def test_webp_stores_payloads(raw):
    payload = webp.padded(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and webp.load(webp.store(payload)) == payload


def test_webp_chains_over_windows():
    rng = np.random.default_rng(0)
    samples = np.minimum(rng.geometric(0.05, 400_000), 255).astype(np.uint32).reshape(-1, 500)
    data = webp.encode(samples << np.uint32(8) | np.uint32(webp.OPAQUE))
    assert (webp.decode(data) >> np.uint32(8) & np.uint32(255) == samples).all()
    reader, code = webp._Reader(data[20:]), None
    reader.at = 40
    reader.read(3)
    code = webp._read_code(reader, 280)
    far = [webp._read_code(reader, a) for a in (256, 256, 256, webp.DISTANCES)][-1]
    at = reader.at
    for window, jumps in ((64, 2), (1 << 12, 5), (1 << 19, 5)):
        reader.at = at
        assert (webp._chain(reader, code, far, 500, samples.size, window, jumps) == samples.ravel()).all()


def test_webp_many_images(monkeypatch):
    monkeypatch.setattr(webp, "MAX_HEIGHT", 3)
    payload = webp.padded(bytes(range(256)) * 20)
    stored = webp.store(payload)
    assert len(list(webp.images(stored))) == 3 and webp.load(stored) == payload


def test_webp_rows_and_defined_cases(spark):
    docs = odd(spark, texts())
    rows = [r.asDict() for r in webp.media_columns(docs).collect()]
    assert len(rows) == docs.count()
    seen = {}
    for r, d in zip(rows, docs.collect(), strict=True):
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.pop("doc_id"), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (d.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert seen.setdefault(raw, r) == r
    stored = {r.doc_id: bytes(r.media) for r in webp.stored_media(docs.where("doc_id = 7")).collect()}[7]
    assert [r["media_sha256"] for r in rows if r["media_bytes"] == len(stored)].count(hashlib.sha256(stored).hexdigest()) == 1
    assert webp.media_columns(empty(docs)).count() == 0
