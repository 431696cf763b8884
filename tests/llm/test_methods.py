"""The methods of the URL, licence, chat, WARC and WebP operators against plain restatements, and streams made by hand."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scanlake.llm import chat, common, licenses, urls, warc, webp

from .test_other_ops import SF, by_hand, con, judged

# ---- URL filters


def templates_by_hand(rows, fanout, depth):
    """rows: host, path. The segments of each one's template."""
    parts = []
    for _, path in rows:
        p = ["*" if re.match(urls.VARIABLE, x) else x for x in path.split("/") if x]
        parts.append(p[:depth] + ["**"] * (len(p) > depth))
    for level in range(max(map(len, parts), default=0)):
        children = defaultdict(set)
        for (host, _), p in zip(rows, parts, strict=True):
            if len(p) > level and p[level] != "*":
                children[host, tuple(p[:level])].add(p[level])
        wide = {k for k, v in children.items() if len(v) > fanout}
        parts = [p[:level] + ["*"] + p[level + 1 :] if len(p) > level and (host, tuple(p[:level])) in wide else p for (host, _), p in zip(rows, parts, strict=True)]
    return [tuple(p) for p in parts]


def merged_by_hand(stats):
    """stats: (host, parts): [labelled, bad]. (host, parts): parts with merged segments."""
    now = {k: k[1] for k in stats}
    for level in range(max((len(p) for _, p in stats), default=0) - 1, -1, -1):
        own, pool = defaultdict(lambda: [0, 0]), defaultdict(dict)
        for (host, parts), m in now.items():
            for i in (0, 1):
                own[host, m][i] += stats[host, parts][i]
        for (host, m), nb in own.items():
            if len(m) > level and m[level] not in ("*", "**", "+"):
                pool[host, m[:level] + ("+",) + m[level + 1 :]][m] = nb
        like = {}
        for (host, shape), branches in pool.items():
            n_all, b_all = (sum(x[i] for x in branches.values()) for i in (0, 1))
            for m, (n, b) in branches.items():
                rest = n_all - n
                if len(branches) > 1 and n >= urls.MERGE_LEAST and rest >= urls.MERGE_LEAST:
                    share = b_all / n_all
                    if abs(b / n - (b_all - b) / rest) <= urls.MERGE_Z * math.sqrt(share * (1 - share) * (1 / n + 1 / rest)):
                        like[host, m] = shape
        now = {k: like.get((k[0], m), m) for k, m in now.items()}
    return now


def verdicts_by_hand(rows, labels, fanout=urls.FANOUT, depth=urls.MAX_DEPTH):
    """rows: id, url. id: verdict, template, labelled, lent, purity."""
    split = {i: judged(u) for i, u in rows}
    parts = dict(zip(split, templates_by_hand([(h, p) for h, p, _ in split.values()], fanout, depth), strict=True))
    bad = {i: labels.get(i, None if r is None else r[1] == "block") for i, (_, _, r) in split.items()}
    stats = defaultdict(lambda: [0, 0])
    for i, (host, _, _) in split.items():
        stats[host, parts[i]][0] += bad[i] is not None
        stats[host, parts[i]][1] += bool(bad[i])
    merged, sums, shapes = merged_by_hand(stats), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0, 0])
    for (host, p), (n, b) in stats.items():
        for into in (sums[host, merged[host, p]], shapes[p]):
            into[0] += n
            into[1] += b
        shapes[p][2] += n > 0
    n_all, b_all = (sum(x[i] for x in stats.values()) for i in (0, 1))
    prior, w = b_all / n_all if n_all else 0, urls.PRIOR_WEIGHT
    out = {}
    for i, (host, _, rule) in split.items():
        (n, b), (lent, lent_bad, hosts) = sums[host, merged[host, parts[i]]], shapes[parts[i]]
        purity = (b + w * (lent_bad + w * prior) / (lent + w)) / (n + w)
        known = n >= urls.LEAST or lent >= urls.LEAST and hosts >= urls.LEAST_HOSTS
        out[i] = (rule[1] if rule else "block" if known and purity >= urls.REJECT - 1e-12 else "allow", "/" + "/".join(merged[host, parts[i]]), n, lent, purity)
    return out


def same_verdicts(got, want):
    assert len(got) == len(want)
    for r in got:
        verdict, template, n, lent, purity = want[r.page_id]
        assert (r.verdict, r.template, r.labelled, r.lent) == (verdict, template, n, lent) and abs(r.purity - purity) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_url_verdicts_as_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, labels = [], {}
    badness = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.5}
    for i in range(1500):
        parts = [rng.choice("abcd") for _ in range(rng.randint(1, 2))] + rng.choice([[], [str(rng.randrange(50))], [f"n{rng.randrange(30)}x"], ["7.html"] * 3])
        rows.append((i, f"http://{rng.choice(['h.org', 'h.org', 'g.org', 'k.io', 'x.example.com'])}/" + "/".join(parts)))
        if parts and rng.random() < 0.6:
            labels[i] = rng.random() < badness.get(parts[0], 0.5)
    got = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "id long, bad boolean")).collect()
    want = verdicts_by_hand(rows, labels)
    same_verdicts(got, want)
    assert {v[0] for v in want.values()} == {"allow", "block"} and any("+" in v[1] for v in want.values())


def test_hosts_lend_evidence(spark):
    """Without labels of their own, addresses of the given tables are judged by their shape on other hosts."""
    rows = con().execute("select page_id, url from pages").fetchall()
    rows += [(10_000 + i, f"http://h{i % 4}.example.com/en/{i}") for i in range(20)] + [(20_000, "http://q.org/en/5"), (20_001, "http://q.org/other/5")]
    got = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()
    same_verdicts(got, verdicts_by_hand(rows, {}))
    by = {r.page_id: r for r in got}
    assert (by[20_000].rule, by[20_000].verdict, by[20_000].labelled) == (None, "block", 0) and by[20_001].verdict == "allow"


def test_unruled_addresses_get_both_verdicts(spark):
    pages = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.1/pages.parquet")
    assert {r.verdict for r in urls.url_verdicts(pages).where("rule is null").select("verdict").distinct().collect()} == {"allow", "block"}


# ---- licence scans

SCANNER = licenses.Scanner()
NOTICES = {
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 International License.": "",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "",
    "This work is licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
    "This work is licensed under CC BY-SA 4.0.": "cc-by",
    "This work is licensed under CC BY-NC 4.0.": "cc-by",
    "This work is licensed under CC BY 3.0.": "cc-by",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Licensed under the Apache License, Version 1.1.": "",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "gpl",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl",
}


@pytest.mark.parametrize("notice", NOTICES)
def test_variants_of_licences(notice):
    assert SCANNER.row(f"Some words first. {notice} And some after it.")[5] == NOTICES[notice]


@pytest.mark.parametrize("which", range(len(licenses.TEMPLATES)))
def test_each_notice_is_found_wherever_it_stands(which):
    label, notice = licenses.TEMPLATES[which]
    words = licenses.words_of(notice)
    text = f"Zzz. {notice} Qqq rrr.\n{notice}\nsss " + notice.upper() + " ttt"
    row = SCANNER.row(text)
    own = [s for s in row[7] if s["label"] == label]
    assert label in row[5].split(",") and {s["first_word"] for s in own if s["coverage"] == 1} >= {1, 3 + len(words), 4 + 2 * len(words)}
    assert {s["label"] for s in row[7]} == {label}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, len(licenses.TEMPLATES) - 1), st.lists(st.sampled_from("alpha beta gamma delta".split()), max_size=8), st.data())
def test_cut_notices(which, noise, data):
    """The first words of a notice give its label if they are enough and have all the words that tell."""
    label, notice = licenses.TEMPLATES[which]
    words = [w.decode() for w in licenses.words_of(notice)]
    n = data.draw(st.integers(0, len(words)))
    row = SCANNER.row(" ".join([*noise, *words[:n], *noise]))
    tells = [w for w in words if licenses.tells(w.encode())]
    if n >= max(licenses.MIN_MATCH, licenses.MIN_COVER * len(words)) and [w for w in words[:n] if licenses.tells(w.encode())] == tells:
        assert label in row[5].split(",")
    assert row[6] == 1 or row[6] <= max(n / len(words), licenses.MIN_COVER) + 1e-9 or label not in row[5]


# ---- chat formatting

@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "é"]), max_size=5).map("".join)), max_size=4), st.integers(1, 7))
def test_whole_conversations_are_parsed_again(turns, step):
    whole = "".join(chat.render(r, t) for r, t in turns)
    reader, got = chat.Reader(), []
    for a in range(0, len(whole), step):  # wherever the parts are cut
        got += reader.feed(whole[a : a + step])
    reader.close()
    assert got == [(r, t, r == "assistant") for r, t in turns]


def test_text_beside_the_grammar_is_an_error():
    with pytest.raises(ValueError):
        chat._Digest(1).add("<|im_start|>user\nx<|im_start|>y<|im_end|>\n")
    with pytest.raises(ValueError):
        chat._Digest(1).add("stray <|im_end|>\n")
    cut = chat._Digest(1)
    cut.add("<|im_start|>user\nx")
    with pytest.raises(ValueError):
        cut.row()


# ---- WARC

def test_warc_identifiers_are_unique(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(9, "u", "x"), (9, "u", "x"), (9, "v", "x"), (3, "u", "x"), (None, "n", "x"), (None, "n", "null id"), (None, "n", "null id"), (5, "a", "once")] + [(100 + i, "w", "y" * 500 + str(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, path := common.scratch_path(spark, "archives"))
    found = warc.read_records(spark, path)
    ids = [r.record_id for r in found.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
    refers = {r.refers_to for r in found.where("type = 'revisit'").collect()}
    assert len(refers) == 1 and refers <= {r.record_id for r in found.where("type = 'response'").collect()}
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.transactions(found).collect()), key=str)
    assert got == sorted([(9, "response", None)] * 3 + [(3, "revisit", 9), (None, "revisit", 9)] + [(None, "response", None)] * 2 + [(5, "response", None)] + [(100 + i, "response", None) for i in range(30)], key=str)
    files = spark.read.format("binaryFile").load(path)
    per_file = [sum(1 for _ in warc.records(bytes(r.content))) for r in files.select("content").collect()]
    assert sum(per_file) == 3 * len(rows) and max(per_file) <= 3 * (2000 * len(rows) // 15_000 + 1)


# ---- lossless WebP

HEAD = [(0x2F, 8), (2, 14), (1, 14), (0, 1), (0, 3)]  # 3 x 2 pixels


def one(symbol):
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def code(first_bit):
    """Prefix codes are read from their highest bit on."""
    return [(int(b), 1) for b in first_bit]


def lengths(alphabet, two, of):
    """The description of a code: of has the symbols of one bit (one of them) and two bits (two) in order, with the lengths in two."""
    # the code of code lengths: 18 (a run of zeros) is 0, length 1 is 10, length 2 is 11; in the order 17, 18, 0, 1, 2
    out = [(0, 1), (1, 4), (0, 3), (1, 3), (0, 3), (2, 3), (2, 3), (0, 1)]
    at = 0
    for symbol, n in [*zip(of, two, strict=True), (alphabet, None)]:
        run = symbol - at
        while run:
            part = min(run, 138)
            assert part >= 11
            out += [*code("0"), (part - 11, 7)]
            run -= part
        if n:
            out += code("10" if n == 1 else "11")
        at = symbol + 1
    return out


def test_back_reference_by_hand():
    # green: 20 is 10, 40 is 11, a copy of length 2 (symbol 256 + 1) is 0; the distance code 0 is the pixel above
    green = lengths(280, [2, 2, 1], [20, 40, 257])
    stream = [*HEAD, (0, 1), (0, 1), (0, 1), *green, *one(1), *one(2), *one(255), *one(0), *code("10"), *code("11"), *code("11"), *code("0"), *code("10")]
    a, b = 0xFF011402, 0xFF012802
    assert webp.decode(by_hand(stream)).tolist() == [[a, b, b], [a, b, a]]


def test_colour_cache_by_hand():
    place = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 28  # noqa: E731  of 16
    colour = lambda green: 0xFF010002 | green << 8
    x = next(g for g in range(20, 100) if place(colour(g)) <= 4)
    y, z = (next(g for g in range(x + 20, 200) if (place(colour(g)) == place(colour(x))) == same) for same in (True, False))
    for other in (y, z):  # one that takes the cached colour's place, and one that doesn't
        a, b = colour(x), colour(other)
        # x is 10, other is 11, the cache place of x is 0
        green = lengths(296, [2, 2, 1], [x, other, 280 + place(a)])
        stream = [*HEAD, (0, 1), (1, 1), (4, 4), (0, 1), *green, *one(1), *one(2), *one(255), *one(0), *code("10"), *code("0"), *code("11"), *code("0"), *code("10"), *code("0")]
        assert webp.decode(by_hand(stream)).tolist() == [[a, a, b], [b if other == y else a, a, a]]


def channels(p):
    return [int(p) >> s & 255 for s in (24, 16, 8, 0)]


def joined(c):
    return sum((x & 255) << s for x, s in zip(c, (24, 16, 8, 0), strict=True))


def prediction(mode, left, above, right, corner):
    """The format's fourteen predictions, a channel at a time."""
    x, t, r, c = map(channels, (left, above, right, corner))
    mean = lambda a, b: [(i + j) // 2 for i, j in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        estimate = [i + j - k for i, j, k in zip(x, t, c, strict=True)]
        to_left, to_top = (sum(abs(e - v) for e, v in zip(estimate, side, strict=True)) for side in (x, t))
        return left if to_left < to_top else above
    if mode == 13:
        m = mean(x, t)
        return joined([clamp(i + math.trunc((i - k) / 2)) for i, k in zip(m, c, strict=True)])
    ways = [None, x, t, r, c, mean(mean(x, r), t), mean(x, c), mean(x, t), mean(c, t), mean(t, r), mean(mean(x, c), mean(t, r)), None, [clamp(i + j - k) for i, j, k in zip(x, t, c, strict=True)]]
    return joined(ways[mode]) if mode else 0xFF000000


@pytest.mark.parametrize("mode", range(14))
def test_predictors_by_hand(mode):
    rng = np.random.default_rng(mode)
    p = rng.integers(0, 1 << 32, (7, 9), dtype=np.uint32)
    left = np.zeros_like(p)
    for y in range(7):
        for x in range(9):
            if y == 0:
                guess = 0xFF000000 if x == 0 else p[0, x - 1]
            elif x == 0:
                guess = p[y - 1, 0]
            else:
                right = p[y - 1, x + 1] if x < 8 else p[y, 0]
                guess = prediction(mode, p[y, x - 1], p[y - 1, x], right, p[y - 1, x - 1])
            left[y, x] = joined([a - b for a, b in zip(channels(p[y, x]), channels(guess), strict=True)])
    w = webp._Writer()
    for v, n in [(0x2F, 8), (8, 14), (6, 14), (1, 1), (0, 3), (1, 1), (0, 2), (1, 3)]:  # blocks of 8
        w.write(v, n)
    webp._write_pixels(w, np.full((1, 2), 0xFF000000 | mode << 8, np.uint32), False)
    w.write(0, 1)
    webp._write_pixels(w, left, True)
    data = w.bytes()
    riff = b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) % 2)
    assert (webp.decode(riff) == p).all()


def test_cross_colour_by_hand():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 1 << 32, (4, 6), dtype=np.uint32)
    small = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    to_red, to_blue, red_to_blue = 200, 37, 130
    changed = np.zeros_like(p)
    for y in range(4):
        for x in range(6):
            a, r, g, b = channels(p[y, x])
            changed[y, x] = joined([a, r - (small(to_red) * small(g) >> 5), g, b - (small(to_blue) * small(g) >> 5) - (small(red_to_blue) * small(r) >> 5)])
    w = webp._Writer()
    for v, n in [(0x2F, 8), (5, 14), (3, 14), (1, 1), (0, 3), (1, 1), (1, 2), (1, 3)]:
        w.write(v, n)
    webp._write_pixels(w, np.array([[0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red]], np.uint32), False)
    w.write(0, 1)
    webp._write_pixels(w, changed, True)
    data = w.bytes()
    riff = b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) % 2)
    assert (webp.decode(riff) == p).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=40), st.integers(1, 60)), max_size=8), st.integers(1, 700))
def test_copies_and_bulk_decoding(parts, width):
    """What is stored with back-references is read alike symbol by symbol and in bulk."""
    raw = b"".join(p * n for p, n in parts) + b"".join(p * n for p, n in parts[::-1])
    samples = np.frombuffer(raw + bytes(-len(raw) % width), np.uint8).reshape(-1, width)
    copies = webp.copies_in(samples.ravel())
    at, flat = 0, samples.ravel().tolist()
    for place, length, far in copies:
        assert at <= place and 0 < far <= place and flat[place : place + length] == [flat[i - far] for i in range(place, place + length)]
        at = place + length
    if copies:
        pixels = samples.astype(np.uint32) << np.uint32(8) | np.uint32(webp.OPAQUE)
        stored = webp.encode(pixels, copied=webp._Copied(samples.ravel(), copies))
        assert (webp.decode(stored) == pixels).all()
        assert (webp.decode(webp.encode(pixels, (), 0, True)) == pixels).all()


def test_copies_over_windows_and_far_back(monkeypatch):
    rng = np.random.default_rng(4)
    once = np.minimum(rng.geometric(0.05, 700_000), 255).astype(np.uint8)
    far = np.concatenate([once, once[:3000], once[::-1][:500], once[100:900]])
    near = np.concatenate([np.tile(once[a : a + 30], 3) for a in range(0, 60_000, 30)])
    for samples in (far, near):
        payload = webp.padded(samples.tobytes())
        stored = webp.store(payload)
        assert len(stored) < len(payload) and webp.load(stored) == payload
        for window, jumps in ((1 << 8, 2), (1 << 13, 3)):
            monkeypatch.setattr(webp._chain, "__defaults__", (window, jumps))
            if len(samples) < 300_000 or window > 256:
                assert webp.load(stored) == payload
        monkeypatch.undo()


def forms(raw):
    seen, encode = [], webp.encode

    def noted(pixels, transforms=(), **asked):
        seen.append("copies" if asked.get("copied") else (*transforms, *asked.get("modes", [])[:1]))
        return encode(pixels, transforms, **asked)

    webp.encode = noted
    try:
        payload = webp.padded(raw)
        assert webp.load(webp.store(payload)) == payload
    finally:
        webp.encode = encode
    return seen


def test_forms_are_chosen_by_size():
    rng = np.random.default_rng(2)
    steps = np.cumsum(rng.integers(0, 2, 576 * 20)).astype(np.uint8)
    rows = np.cumsum(rng.integers(0, 2, (40, 576)), 0).astype(np.uint8)
    assert forms(rng.choice([97, 98, 99], 3000).astype(np.uint8).tobytes()) == [(webp.PALETTE,)]
    assert forms(steps.tobytes()) == [(webp.PREDICTOR, webp.LEFT)] and forms((rows + rng.integers(0, 256, 576).astype(np.uint8)).tobytes()) == [(webp.PREDICTOR, webp.ABOVE)]
    assert forms(np.minimum(rng.geometric(0.1, 5760), 255).astype(np.uint8).tobytes()) == [()]
    text = " ".join(f"word{i % 700}" for i in range(2000)).encode()
    assert forms(text)[-1] == "copies"  # after the palette, which is larger


def test_pixel_arrays(spark):
    p = np.arange(12, dtype=np.uint32).reshape(3, 4) | np.uint32(webp.OPAQUE)
    rows = [(1, webp.encode(p) + webp.encode(p[:2], (0,))), (2, None), (None, webp.encode(p[:1], (3,)))]
    df = spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "'x' pixels")
    got = sorted(((r.doc_id, r.image, r.width, r.height, r.pixels) for r in webp.pixel_arrays(df).collect()), key=str)
    flat = [int(x) for x in p.ravel()]
    assert got == sorted([(1, 0, 4, 3, flat), (1, 1, 4, 2, flat[:8]), (None, 0, 4, 1, flat[:4])], key=str)
    assert webp.pixel_arrays(df.limit(0)).count() == 0
