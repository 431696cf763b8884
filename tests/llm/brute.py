"""Plain restatements of the contracts, for small tables."""

import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    marked = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    dup = sum(n - 1 for n in lines.values())
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(rows):
    """rows: (doc_id, fingerprint). The smallest id reachable over fingerprints at most 2 bits apart."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f, least.get(find(f))) for d, f in rows]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def similar_groups(texts, shingle=5, similarity=0.8):
    """For each text the number of its component, over all pairs whose sets of word shingles have the similarity."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(shingle, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]
