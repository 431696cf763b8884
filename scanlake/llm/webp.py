"""Lossless WebP (VP8L) of byte payloads: a full decoder, an encoder, and the columns made from them.

The decoder reads every part of the lossless format: prefix codes (simple and normal, several groups),
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Where an
image has one group of codes, no cache and literals of one channel only, the codes of literals and of
back-references are decoded for all bit positions at once and the chain of codes is followed by doubled jumps; then
literals are laid down together and copies one by one. Other images go symbol by symbol.

Stored form of a payload: its bytes are the green samples of images 576 pixels wide and at most 16,383 high;
several images follow one another. Each is stored in the smallest of these forms, by exact counts of bits for all but
the codes' own descriptions: a palette (for at most 16 different bytes, with several samples in a pixel), literals,
literals and back-references, or what is left of literals after prediction from the left or from above. The
other parts cannot shrink an image of one channel: a cached colour is another symbol for the same literal, so
it splits that literal's count; and red and blue are constant, so that the colour transforms only add to them.

Defined cases: a null or empty text is one row of 576 bytes 255; repeated rows each get a row; null ids stay;
extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

UNIT, MAX_HEIGHT = 576, 16383

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120 as (x, y): x to the left and y above.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR, SIGNATURE = 0x1E35A7BD, 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


# ---- bits and prefix codes ------------------------------------------------------------------------------------

class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.padded = data + bytes(32)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image ends early")
        out = int.from_bytes(self.padded[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


class _Writer:
    """Numbers and arrays of (value, bits), packed from the lowest bit."""

    def __init__(self):
        self.values: list = []
        self.sizes: list = []
        self.held: list[int] = []  # numbers, and their bits
        self.bits: list[int] = []

    def write(self, value: int, n: int) -> None:
        if n > 16:
            self.write(value & 0xFFFF, 16)
            value, n = value >> 16, n - 16
        self.held.append(value)
        self.bits.append(n)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Of at most 17 bits each."""
        self.values += [np.array(self.held, np.int64), values]
        self.sizes += [np.array(self.bits, np.int64), sizes]
        self.held, self.bits = [], []

    def bytes(self) -> bytes:
        self.extend(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        places = ends - sizes
        at, v = places >> 3, values << (places & 7)
        n = (total >> 3) + 4
        # the parts of different values in one byte are disjoint, so their sum is their union
        out = np.bincount(at, v & 255, n) + np.bincount(at + 1, v >> 8 & 255, n) + np.bincount(at + 2, v >> 16 & 255, n)
        return out.astype(np.uint8)[: (total + 7) >> 3].tobytes()


_MIRROR = [int(f"{x:08b}"[::-1], 2) for x in range(256)]


def _reverse(code: int, n: int) -> int:
    return (_MIRROR[code & 255] << 8 | _MIRROR[code >> 8]) >> 16 - n


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes for the lengths, in the order of the bit stream (reversed)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    code, last, made = 0, 0, []
    order = used[np.argsort(lengths[used], kind="stable")]
    for n in lengths[order].tolist():
        code <<= n - last
        made.append(_reverse(code, n))
        code, last = code + 1, n
    codes[order] = made
    return codes


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of a prefix code for the counts; symbols without a count get 0, a lone symbol 1."""
    out = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts).tolist()
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), i) for i, s in enumerate(symbols)]
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        new = len(symbols)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            heapq.heappush(heap, (a + b, new))
            new += 1
        depth = {new - 1: 0}
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth.values()) <= limit:
            out[symbols] = [depth[i] for i in range(len(symbols))]
            return out
        least *= 2


@functools.cache
def _mirrored(bits: int) -> np.ndarray:
    """The numbers of so many bits, each with its bits in reverse order."""
    n, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for i in range(bits):
        out |= (n >> i & 1) << bits - 1 - i
    return out


class _Code:
    """A prefix code as a table over the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray | None, only: int | None = None):
        self.only, self.bits, self._table = only, 0, None  # a lone symbol takes no bits
        if lengths is None:
            return
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.only = int(used[0]) if len(used) else 0
            return
        own = lengths[used]
        self.bits = int(own.max())
        if (1 << self.bits) != int((1 << (self.bits - own)).sum()):
            raise ValueError("the prefix code is not complete")
        # in the order of codes each symbol has a run of places, as long as its code is short
        order = np.argsort(own, kind="stable")
        runs = np.repeat(order, 1 << (self.bits - own[order]))[_mirrored(self.bits)]
        self.symbol, self.length = used[runs].astype(np.int32), own[runs].astype(np.uint8)

    def table(self) -> list[tuple[int, int]]:
        """Symbol and bits for what the next bits can be."""
        if self._table is None:
            self._table = [(self.only, 0)] if self.only is not None else list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))
        return self._table

    def read(self, r: _Reader) -> int:
        if self.only is not None:
            return self.only
        at = r.at
        window = int.from_bytes(r.padded[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << self.bits) - 1)
        symbol, n = (self._table or self.table())[window]
        r.at = at + n
        if r.at > 8 * len(r.data):
            raise ValueError("the image ends early")
        return symbol


def _read_code(r: _Reader, alphabet: int) -> _Code:
    if r.read(1):
        two = r.read(1)
        first = r.read(8 if r.read(1) else 1)
        second = r.read(8) if two else first
        if max(first, second) >= alphabet:
            raise ValueError("a code has a symbol beyond its alphabet")
        if first == second:
            return _Code(None, first)
        lengths = np.zeros(alphabet, np.int64)
        lengths[[first, second]] = 1
        return _Code(lengths)
    lengths = np.zeros(alphabet, np.int64)
    order = np.zeros(19, np.int64)
    for i in range(4 + r.read(4)):
        order[CODE_LENGTH_ORDER[i]] = r.read(3)
    of_lengths = _Code(order)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, previous, made = 0, 8, []
    # the bits that the rest can take at most, as one number that is shifted along
    held = int.from_bytes(r.padded[r.at >> 3 : (r.at + 14 * alphabet >> 3) + 1], "little") >> (r.at & 7)
    used, mask, table = 0, (1 << of_lengths.bits) - 1, of_lengths.table()
    while at < alphabet and left:
        left -= 1
        n, size = table[held & mask]
        held >>= size
        used += size
        if n < 16:
            made.append(n)
            at += 1
            previous = n or previous
            continue
        least, size = (3, 2) if n == 16 else (3, 3) if n == 17 else (11, 7)
        times = least + (held & (1 << size) - 1)
        held >>= size
        used += size
        made += [previous if n == 16 else 0] * times
        at += times
    if at > alphabet:
        raise ValueError("a run of code lengths is too long")
    r.at += used
    if r.at > 8 * len(r.data):
        raise ValueError("the image ends early")
    lengths[:at] = made
    return _Code(lengths)


def _write_code(w: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256) or len(used) == 2 and used[1] < 256:
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(1, 1)
        for s in used:
            w.write(s, 8)
        return
    w.write(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, its bits
    at, values = 0, lengths.tolist()
    for s in [*used, len(values)]:
        run = s - at
        while run > 0:
            part = min(run, 138)
            tokens += [(18, part - 11, 7)] if part >= 11 else [(17, part - 3, 3)] if part >= 3 else [(0, 0, 0)] * part
            run -= part
        if s < len(values):
            tokens.append((values[s], 0, 0))
        at = s + 1
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    own = code_lengths(counts, 7)
    n = max(4, max(i + 1 for i, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    w.write(n - 4, 4)
    for s in CODE_LENGTH_ORDER[:n]:
        w.write(int(own[s]), 3)
    w.write(0, 1)  # all of the alphabet follows
    codes = canonical(own).tolist()
    sizes = [0] * 19 if np.count_nonzero(own) == 1 else own.tolist()  # a lone symbol takes no bits
    w.held += [x for s, extra, _ in tokens for x in (codes[s] if sizes[s] else 0, extra)]
    w.bits += [x for s, _, bits in tokens for x in (sizes[s], bits)]


# ---- decoding -------------------------------------------------------------------------------------------------

def _extra_bits(code: np.ndarray) -> np.ndarray:
    """How many bits follow a length's or distance's prefix code."""
    return np.maximum(0, code - 2 >> 1)


def _value(code: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.where(code < 4, code + 1, (2 + (code & 1) << _extra_bits(code)) + extra + 1)


def _chain(r: _Reader, code: _Code, far: _Code, width: int, n: int, window: int = 1 << 16, jumps: int = 4) -> np.ndarray:
    """n samples: literals of one code, and back-references whose distances the code far has."""
    raw = np.frombuffer(r.padded, np.uint8)
    out = np.empty(n, np.uint8)
    done, at, mask = 0, r.at, (1 << code.bits) - 1
    copies = bool(code.lengths[LITERALS:].any())
    steps = code.length.astype(np.int64)
    if copies:
        steps[code.symbol >= LITERALS] = 0  # found by that
    shifts = np.arange(8)
    while done < n:
        first = at >> 3
        size = min(window, 8 * (len(r.data) - first))
        if size <= at - 8 * first:
            raise ValueError("the image ends early")
        # 40 bits from each byte on, and from those that a copy which begins in this window may reach
        b = raw[first : first + (size >> 3) + 20].astype(np.int64)
        words = b[:-4] | b[1:-3] << 8 | b[2:-2] << 16 | b[3:-1] << 24 | b[4:] << 32
        windows = ((words[: size >> 3, None] >> shifts) & mask).ravel()
        # from its end on a place stays where it is
        after = np.arange(size + 96)
        step = steps.take(windows, mode="clip")
        after[:size] += step
        if copies:
            bits_at = lambda p, k: words[p >> 3] >> (p & 7) & ((1 << k) - 1)
            starts = np.flatnonzero(step == 0)
            kind = code.symbol[windows[starts]].astype(np.int64) - LITERALS
            p = starts + code.length[windows[starts]] + _extra_bits(kind)
            if far.only is None:
                there = bits_at(p, far.bits)
                p = p + far.length[there]
                kind = far.symbol[there]
            else:
                kind = np.full(len(p), far.only)
            after[starts] = p + _extra_bits(kind)
        jump = after
        for _ in range(jumps):
            jump = jump.take(jump, mode="clip")
        places, place = [], at - 8 * first
        limit = (n - done >> jumps) + 1
        while place < size and len(places) < limit:
            places.append(place)
            place = int(jump[place])
        row = np.array(places)
        every = np.empty((1 << jumps, len(row)), np.int64)
        for i in range(1 << jumps):
            every[i] = row
            row = after.take(row, mode="clip")
        every = every.T.ravel()
        every = every[every < size][: n - done]
        symbols = code.symbol.take(windows.take(every))
        if not copies:
            out[done : done + len(every)] = symbols
            done += len(every)
        else:
            which = np.flatnonzero(symbols >= LITERALS)
            counts = np.ones(len(every), np.int64)
            if len(which):
                kind, p = symbols[which].astype(np.int64) - LITERALS, every[which] + code.length[windows[every[which]]]
                counts[which] = _value(kind, bits_at(p, _extra_bits(kind)))
            ends = done + np.cumsum(counts)
            cut = int(np.searchsorted(ends, n)) + 1
            every, symbols, ends, which = every[:cut], symbols[:cut], ends[:cut], which[which < cut]
            if ends[-1] > n:
                raise ValueError("a back-reference leaves the image")
            literal = np.ones(len(every), bool)
            literal[which] = False
            out[ends[literal] - 1] = symbols[literal]
            if len(which):
                kind = symbols[which].astype(np.int64) - LITERALS
                p = every[which] + code.length[windows[every[which]]] + _extra_bits(kind)
                if far.only is None:
                    there = bits_at(p, far.bits)
                    p, kind = p + far.length[there], far.symbol[there].astype(np.int64)
                else:
                    kind = np.full(len(p), far.only)
                back = _value(kind, bits_at(p, _extra_bits(kind)))
                near = back <= 120
                x, y = np.array(NEAR)[np.minimum(back, 120) - 1].T
                back = np.where(near, np.maximum(1, x + y * width), back - 120)
                for a, e, d in zip((ends[which] - counts[which]).tolist(), ends[which].tolist(), back.tolist(), strict=True):
                    if d > a:
                        raise ValueError("a back-reference leaves the image")
                    if d >= e - a:
                        out[a:e] = out[a - d : e - d]
                    else:
                        out[a:e] = np.resize(out[a - d : a], e - a)
            done = int(ends[-1])
        at = 8 * first + int(after[every[-1]])
        if at > 8 * len(r.data):
            raise ValueError("the image ends early")
    r.at = at
    return out


def _extra(r: _Reader, code: int) -> int:
    """A length or distance from its prefix code."""
    if code < 4:
        return code + 1
    bits = (code - 2) >> 1
    return ((2 + (code & 1)) << bits) + r.read(bits) + 1


def _pixels(r: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB values, row by row."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    n, group_of, block = width * height, None, 0
    if main and r.read(1):
        block = r.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        group_of = (_pixels(r, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).tolist()
    green = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    groups = [[_read_code(r, a) for a in (green, 256, 256, 256, DISTANCES)] for _ in range(max(group_of) + 1 if group_of else 1)]
    codes = groups[0]
    rest = [c.only for c in codes[1:4]]
    if len(groups) == 1 and not cache_bits and None not in rest:
        fixed = np.uint32(rest[0] << 16 | rest[1] | rest[2] << 24)
        if codes[0].only is not None and codes[0].only < LITERALS:
            return np.full(n, fixed | np.uint32(codes[0].only << 8), np.uint32)
        if codes[0].only is None and max(codes[0].bits, codes[4].bits) <= 14:
            return _chain(r, codes[0], codes[4], width, n).astype(np.uint32) << np.uint32(8) | fixed
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    at = 0
    while at < n:
        if group_of:
            codes = groups[group_of[(at // width >> block) * across + (at % width >> block)]]
        s = codes[0].read(r)
        if s < LITERALS:
            red, blue, alpha = (c.read(r) for c in codes[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
            new = 1
        elif s < LITERALS + LENGTHS:
            new = _extra(r, s - LITERALS)
            far = _extra(r, codes[4].read(r))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + new > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(new):
                out[at] = out[at - far]
                at += 1
        else:
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
            new = 1
        if cache_bits:
            for p in out[at - new : at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


def _average(a: int, b: int) -> int:
    return ((a ^ b) >> 1 & 0x7F7F7F7F) + (a & b)


def _channels(p: int) -> tuple[int, ...]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _packed(c: list[int]) -> int:
    a, r, g, b = (min(255, max(0, x)) for x in c)
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    a, b, c = _channels(left), _channels(top), _channels(corner)
    # the estimate is left + top - corner; the nearer neighbour is taken
    return left if sum(abs(y - z) for y, z in zip(b, c, strict=True)) < sum(abs(x - z) for x, z in zip(a, c, strict=True)) else top


def _predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """right: above right; corner: above left."""
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _packed([x + y - z for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True)])
    if mode == 13:
        mean = _channels(_average(left, top))
        return _packed([m + int((m - c) / 2) for m, c in zip(mean, _channels(corner), strict=True)])
    return {
        0: lambda: OPAQUE, 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner), 7: lambda: _average(left, top),
        8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
    }.get(mode, lambda: OPAQUE)()


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _subtract(a: int, b: int) -> int:
    return sum(((x - y) & 255) << s for x, y, s in zip(_channels(a), _channels(b), (24, 16, 8, 0), strict=True))


def _walk_predictor(pixels: np.ndarray, modes: list[int], across: int, block: int, inverse: bool) -> np.ndarray:
    """Adds (or, not inverse, subtracts) what the neighbours predict. The pixel above right of a row's last is the row's first."""
    h, w = pixels.shape
    given = pixels.ravel().tolist()
    full = [0] * (h * w) if inverse else given
    out = [0] * (h * w)
    for i, p in enumerate(given):
        y, x = divmod(i, w)
        if y == 0:
            guess = OPAQUE if x == 0 else full[i - 1]
        elif x == 0:
            guess = full[i - w]
        else:
            guess = _predicted(modes[(y >> block) * across + (x >> block)], full[i - 1], full[i - w], full[i - w + 1], full[i - w - 1])
        out[i] = _add(p, guess) if inverse else _subtract(p, guess)
        if inverse:
            full[i] = out[i]
    return np.array(out, np.uint32).reshape(h, w)


LEFT, ABOVE = 1, 2


def _left_over(samples: np.ndarray, mode: int) -> np.ndarray:
    """8-bit samples (height, width, ...) less their prediction from the left or from above; the first row is predicted from the left, the first column from above."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    if mode == ABOVE:
        out[1:] -= samples[:-1]
    else:
        out[1:, 0] -= samples[:-1, 0]
        out[1:, 1:] -= samples[1:, :-1]
    return out


def _summed(left: np.ndarray, mode: int) -> np.ndarray:
    """What _left_over was made of."""
    out = left.copy()
    out[0] = np.cumsum(out[0], 0, dtype=np.uint8)
    if mode == ABOVE:
        return np.cumsum(out, 0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.uint8)
    out[1:] = np.cumsum(out[1:], 1, dtype=np.uint8)
    return out


def _uniform(pixels: np.ndarray, mode: int, inverse: bool) -> np.ndarray:
    """_walk_predictor where all blocks predict from the left, or all from above."""
    samples = np.array(pixels, np.uint32, order="C").view(np.uint8).reshape(*pixels.shape, 4)
    if inverse:
        samples[0, 0, 3] = int(samples[0, 0, 3]) + 255 & 255
        out = _summed(samples, mode)
    else:
        out = _left_over(samples, mode)
        out[0, 0, 3] = int(out[0, 0, 3]) + 1 & 255
    return out.view(np.uint32).reshape(pixels.shape)


def _predict(pixels: np.ndarray, modes: list[int], across: int, block: int, inverse: bool) -> np.ndarray:
    if modes[0] in (LEFT, ABOVE) and len(set(modes)) == 1:
        return _uniform(pixels, modes[0], inverse)
    return _walk_predictor(pixels, modes, across, block, inverse)


def _signed8(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, elements: np.ndarray, block: int, sign: int) -> np.ndarray:
    """sign 1 inverts the cross-colour transform, -1 applies it."""
    h, w = pixels.shape
    e = np.repeat(np.repeat(elements, 1 << block, 0)[:h], 1 << block, 1)[:, :w]
    to_red, to_blue, red_to_blue = _signed8(e & 255), _signed8(e >> 8 & 255), _signed8(e >> 16 & 255)
    green, red, blue = _signed8(pixels >> 8 & 255), (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    new_red = red + sign * (to_red * green >> 5) & 255
    plain_red = new_red if sign > 0 else red
    new_blue = blue + sign * ((to_blue * green >> 5) + (red_to_blue * _signed8(plain_red) >> 5)) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def _green_added(pixels: np.ndarray, sign: int) -> np.ndarray:
    g = pixels >> np.uint32(8) & np.uint32(255)
    r, b = ((pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) + sign * g.astype(np.int32) & 255 for s in (16, 0))
    return pixels & np.uint32(0xFF00FF00) | r.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """ARGB values (height, width) of a RIFF file with a lossless image."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack("<I", data[16:20])
    r = _Reader(data[20 : 20 + size])
    if r.read(8) != SIGNATURE:
        raise ValueError("not a lossless image")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    transforms, seen, w = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform is used twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = r.read(3) + 2
            across, down = (w + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            transforms.append((kind, w, block, _pixels(r, across, down, False).reshape(down, across)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            steps = _pixels(r, n, 1, False)
            colours = sum(((np.cumsum(steps >> np.uint32(s) & np.uint32(255)) & 255).astype(np.uint32) << np.uint32(s) for s in (24, 16, 8, 0)), np.zeros(n, np.uint32))
            transforms.append((kind, w, _bundle(n), np.concatenate([colours, np.zeros(256 - n, np.uint32)])))
            w = (w + (1 << _bundle(n)) - 1) >> _bundle(n)
        else:
            transforms.append((kind, w, 0, None))
    out = _pixels(r, w, height, True).reshape(height, w)
    for kind, w, block, table in reversed(transforms):
        if kind == SUBTRACT_GREEN:
            out = _green_added(out, 1)
        elif kind == CROSS_COLOUR:
            out = _cross(out, table, block, 1)
        elif kind == PREDICTOR:
            out = _predict(out, (table >> np.uint32(8) & np.uint32(15)).ravel().tolist(), table.shape[1], block, True)
        else:
            green = out >> np.uint32(8) & np.uint32(255)
            if block:
                each = 8 >> block
                green = (green[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :w]
            out = table[green]
    return out


# ---- encoding -------------------------------------------------------------------------------------------------

def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and its bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    bits = value.bit_length() - 2
    return 2 * bits + 2 + (value >> bits & 1), value & (1 << bits) - 1, bits


def _tokens(pixels: list[int], cache_bits: int, references: bool) -> list[tuple]:
    """("literal", p), ("cache", index) or ("copy", length, distance), greedily from a table of three-pixel starts."""
    out, seen, at, n = [], {}, 0, len(pixels)
    cache = [0] * (1 << cache_bits)
    place = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> 32 - cache_bits
    while at < n:
        start = seen.get(tuple(pixels[at : at + 3])) if references else None
        new = 1
        if start is not None and at + 3 <= n:
            new = 3
            while at + new < n and new < 4096 and pixels[start + new] == pixels[at + new]:
                new += 1
            out.append(("copy", new, at - start))
        elif cache_bits and cache[place(pixels[at])] == pixels[at]:
            out.append(("cache", place(pixels[at])))
        else:
            out.append(("literal", pixels[at]))
        for i in range(at, at + new):
            if references:
                seen[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[place(pixels[i])] = pixels[i]
        at += new
    return out


#: Bytes of the least back-reference that is looked for in payloads, and the format's longest.
LEAST_COPY, MOST_COPY = 16, 4096


def copies_in(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """Place, length and distance of back-references in flat 8-bit samples, taken greedily: each from the last place that has the same LEAST_COPY samples."""
    n = len(samples) - LEAST_COPY + 1
    if n < 2:
        return []
    padded_ = np.concatenate([samples, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded_, (len(samples), 8), (1, 1)).copy().view(np.uint64).ravel()
    key = eight[:n] * np.uint64(0x9E3779B185EBCA87) ^ eight[LEAST_COPY - 8 : LEAST_COPY - 8 + n]
    order = np.argsort(key)
    own = key[order]
    same = np.zeros(n + 1, bool)  # as the key before, and at the place after the last
    same[1:n] = own[1:] == own[:-1]
    again = np.flatnonzero(same[1:] | same[:-1])
    if not len(again):
        return []
    order, run = order[again], np.cumsum(~same[:-1])[again]
    by_place = np.argsort(run * np.int64(len(samples)) + order)
    order, run = order[by_place], run[by_place]
    same = np.flatnonzero(run[1:] == run[:-1])
    last = np.full(n, -1, np.int64)
    last[order[same + 1]] = order[same]
    starts = np.flatnonzero(last >= 0)
    out, at, raw = [], 0, samples.tobytes()
    while (i := int(np.searchsorted(starts, at))) < len(starts):
        at = int(starts[i])
        back = int(last[at])
        length, most = 0, min(MOST_COPY, len(raw) - at)
        while (step := min(64, most - length)) and raw[at + length : at + length + step] == raw[back + length : back + length + step]:
            length += step
        while length < most and raw[at + length] == raw[back + length]:
            length += 1
        if length < LEAST_COPY:  # the keys of different samples were equal
            at += 1
            continue
        out.append((at, length, at - back))
        at += length
    return out


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix of an array."""
    less = values - 1
    bits = np.maximum(0, np.frexp(np.maximum(less, 1).astype(float))[1] - 2)
    code = np.where(values <= 4, less, 2 * bits + 2 + (less >> bits & 1))
    bits = np.where(values <= 4, 0, bits)
    return code, less & (1 << bits) - 1, bits


class _Copied:
    """Flat samples as literals and back-references, with the codes and the bits that these take."""

    def __init__(self, samples: np.ndarray, copies: list[tuple[int, int, int]]):
        place, length, far = (np.array(x, np.int64) for x in zip(*copies, strict=True))
        literal = np.ones(len(samples), bool)
        edges = np.zeros(len(samples) + 1, np.int64)
        np.add.at(edges, place, 1)
        np.add.at(edges, place + length, -1)
        literal = np.cumsum(edges[:-1]) == 0
        self.length, self.far = _prefixes(length), _prefixes(far + 120)
        at = np.concatenate([np.flatnonzero(literal), place])
        order = np.argsort(at, kind="stable")
        symbols = np.concatenate([samples[literal].astype(np.int64), LITERALS + self.length[0]])
        self.symbols = symbols[order]
        self.green = code_lengths(np.bincount(symbols, minlength=LITERALS + LENGTHS), 14)
        self.distances = code_lengths(np.bincount(self.far[0], minlength=DISTANCES), 14)
        extra = int((self.length[2] + self.far[2]).sum())
        self.bits = int(self.green[symbols].sum()) + extra + (int(self.distances[self.far[0]].sum()) if np.count_nonzero(self.distances) > 1 else 0)

    def write(self, w: _Writer) -> None:
        w.write(0, 1)  # no cache
        w.write(0, 1)  # one group of codes
        _write_code(w, self.green)
        for constant in (0, 0, 255):  # red, blue, alpha
            for value, bits in ((1, 1), (0, 1), (1, 1), (constant, 8)):
                w.write(value, bits)
        _write_code(w, self.distances)
        copied = self.symbols >= LITERALS
        ends = np.cumsum(np.where(copied, 5, 1))  # a copy has five parts, some of which may be of no bits
        at = ends - np.where(copied, 5, 1)
        values, sizes = np.zeros((2, int(ends[-1])), np.int64)
        if np.count_nonzero(self.green) > 1:
            values[at], sizes[at] = canonical(self.green)[self.symbols], self.green[self.symbols]
        at = at[copied]
        values[at + 1], sizes[at + 1] = self.length[1:]
        if np.count_nonzero(self.distances) > 1:
            values[at + 2], sizes[at + 2] = canonical(self.distances)[self.far[0]], self.distances[self.far[0]]
        values[at + 3], sizes[at + 3] = self.far[1] & 0xFFFF, np.minimum(self.far[2], 16)
        values[at + 4], sizes[at + 4] = self.far[1] >> 16, np.maximum(self.far[2] - 16, 0)
        w.extend(values, sizes)


def _write_pixels(w: _Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, limit: int = 12, copied: _Copied | None = None) -> None:
    if copied is not None:
        return copied.write(w)
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)  # one group of codes
    flat = pixels.ravel()
    if not cache_bits and not references:
        channels = [flat >> np.uint32(s) & np.uint32(255) for s in (8, 16, 0, 24)]
        lengths = [code_lengths(np.bincount(c, minlength=256), limit) for c in channels]
        lengths[0] = np.pad(lengths[0], (0, LENGTHS))
        for n in lengths:
            _write_code(w, n)
        _write_code(w, np.zeros(DISTANCES, np.int64))
        coded = [(canonical(n)[c], n[c]) for n, c in zip(lengths, channels, strict=True) if np.count_nonzero(n) > 1]
        if coded:
            w.extend(np.stack([c for c, _ in coded], 1).ravel(), np.stack([n for _, n in coded], 1).ravel())
        return
    symbols: list[list[tuple[int, int, int, int]]] = []  # alphabet, symbol, extra, bits
    for kind, *x in _tokens(flat.tolist(), cache_bits, references):
        if kind == "literal":
            a, red, green, blue = _channels(x[0])
            symbols.append([(0, green, 0, 0), (1, red, 0, 0), (2, blue, 0, 0), (3, a, 0, 0)])
        elif kind == "cache":
            symbols.append([(0, LITERALS + LENGTHS + x[0], 0, 0)])
        else:
            length, far = _prefix(x[0]), _prefix(x[1] + 120)
            symbols.append([(0, LITERALS + length[0], *length[1:]), (4, *far)])
    sizes = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    counts = [np.zeros(n, np.int64) for n in sizes]
    for a, s, _, _ in (x for t in symbols for x in t):
        counts[a][s] += 1
    lengths = [code_lengths(c, 15) for c in counts]
    for n in lengths:
        _write_code(w, n)
    codes, lone = [canonical(n) for n in lengths], [np.count_nonzero(n) < 2 for n in lengths]
    for a, s, extra, bits in (x for t in symbols for x in t):
        if not lone[a]:
            w.write(int(codes[a][s]), int(lengths[a][s]))
        if bits:
            w.write(extra, bits)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, block: int = 2, modes=None, elements=None, copied: _Copied | None = None) -> bytes:
    """A RIFF file of ARGB values (height, width). transforms are applied in the order given; modes and elements are
    the predictor's modes and the cross-colour elements of the blocks (all modes in turn, and some, if not given).
    copied: the green samples as literals and back-references, if the other channels are constant."""
    height, width = pixels.shape
    w = _Writer()
    w.write(SIGNATURE, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(int(bool(((pixels >> np.uint32(24)) != 255).any())), 1)
    w.write(0, 3)
    for kind in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        h, wide = pixels.shape
        shape = (h + (1 << block) - 1) >> block, (wide + (1 << block) - 1) >> block
        n = shape[0] * shape[1]
        if kind == PREDICTOR:
            own = np.arange(n) % 14 if modes is None else np.asarray(modes)
            w.write(block - 2, 3)
            _write_pixels(w, (own.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE)).reshape(shape), False)
            pixels = _predict(pixels, own.ravel().tolist(), shape[1], block, False)
        elif kind == CROSS_COLOUR:
            own = (np.arange(n, dtype=np.uint32) * np.uint32(0x0B1735) & np.uint32(0xFFFFFF) | np.uint32(OPAQUE) if elements is None else np.asarray(elements, np.uint32)).reshape(shape)
            w.write(block - 2, 3)
            _write_pixels(w, own, False)
            pixels = _cross(pixels, own, block, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green_added(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has at most 256 colours")
            w.write(len(colours) - 1, 8)
            before = np.concatenate([[np.uint32(0)], colours[:-1]])
            steps = sum((((colours >> np.uint32(s) & np.uint32(255)).astype(np.int32) - (before >> np.uint32(s) & np.uint32(255)).astype(np.int32) & 255).astype(np.uint32) << np.uint32(s) for s in (24, 16, 8, 0)), np.zeros(len(colours), np.uint32))
            _write_pixels(w, steps.reshape(1, -1), False)
            bundle = _bundle(len(colours))
            index = np.pad(index.reshape(h, wide).astype(np.uint32), ((0, 0), (0, -wide % (1 << bundle))))
            shifts = np.arange(1 << bundle, dtype=np.uint32) * np.uint32(8 >> bundle)
            pixels = (index.reshape(h, -1, 1 << bundle) << shifts).sum(2, dtype=np.uint32) << np.uint32(8) | np.uint32(OPAQUE)
    w.write(0, 1)
    _write_pixels(w, pixels, True, cache_bits, references, copied=copied)
    data = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# ---- payloads and columns ---------------------------------------------------------------------------------------

def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _literal_bits(samples: np.ndarray) -> int:
    counts = np.bincount(samples.ravel(), minlength=256)
    return int((code_lengths(counts, 12) * counts).sum()) if np.count_nonzero(counts) > 1 else 0


def _least_bits(samples: np.ndarray) -> float:
    """The entropy: no prefix code takes less."""
    counts = np.bincount(samples.ravel())
    counts = counts[counts > 0]
    return float((counts * np.log2(samples.size / counts)).sum())


def stored_image(samples: np.ndarray) -> bytes:
    """8-bit samples (height, width) in the smallest of the forms named above."""
    pixels = samples.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE)
    # a form's bits are counted only if the least that they can be is fewer than another's
    bits, how = math.inf, {}
    if copies := copies_in(samples.ravel()):
        copied = _Copied(samples.ravel(), copies)
        bits, how = copied.bits, {"copied": copied}
    for mode in (None, LEFT, ABOVE):
        left = samples if mode is None else _left_over(samples, mode)
        if _least_bits(left) < bits and (n := _literal_bits(left)) < bits:
            blocks = -(-samples.shape[0] // 512) * -(-samples.shape[1] // 512)
            bits, how = n, {} if mode is None else {"transforms": (PREDICTOR,), "block": 9, "modes": [mode] * blocks}
    if np.count_nonzero(np.bincount(samples.ravel(), minlength=256)) <= 16 and 8 * len(few := encode(pixels, (PALETTE,))) < bits:
        return few
    return encode(pixels, **how)


def store(payload: bytes) -> bytes:
    """The payload, a positive multiple of 576 bytes, as one lossless image after another."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return b"".join(stored_image(samples[a : a + MAX_HEIGHT]) for a in range(0, len(samples), MAX_HEIGHT))


def images(stored: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(stored):
        size = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        yield decode(stored[at : at + size])
        at += size


def load(stored: bytes) -> bytes:
    """The payload, from the green samples of the images."""
    return b"".join((i >> np.uint32(8) & np.uint32(255)).astype(np.uint8).tobytes() for i in images(stored))


def feature(payload: bytes) -> str:
    """Mean and entropy of the samples, and 64 bits: which of 64 equal parts have a mean above the whole's."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    means = samples.reshape(64, -1).mean(1)
    bits = int("".join("01"[int(x)] for x in means > samples.mean()), 2)
    return f"{samples.mean():.3f}:{abs(float(-(share * np.log2(share)).sum())):.3f}:{bits:016x}"


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_row(raw: bytes) -> tuple:
    stored = store(padded(raw))
    payload = load(stored)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = [media_row(x or b"") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs, read back from its stored form."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")), _media, _SCHEMA)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the stored form itself, for writing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([store(padded(x or b"")) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")), run, "doc_id long, media binary")


def pixel_arrays(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, image (from 0), width, height and pixels (ARGB, row by row) of the lossless WebP images that follow one another in media; a null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "image", "width", "height", "pixels"]
        for b in batches:
            for i in range(b.num_rows):  # an image at a time
                for k, image in enumerate(images(b.column(1)[i].as_py() or b"")):
                    height, width = image.shape
                    arrays = [pa.array([k], pa.int32()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([image.ravel().astype(np.int64)], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *arrays], names=names)

    return arrow_map(media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")), run, "doc_id long, image int, width int, height int, pixels array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
