"""Bit-shuffled, LZ4-compressed blocks of counts: the codec of detector files.

A block's counts are turned from count-major to bit-major order and then compressed. A stream starts with its
size and block size (big-endian, 8 and 4 bytes); each block follows its compressed length (4 bytes). Counts
that don't fill a group of eight at the end stand as they are.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

BLOCK = 8192


def shuffle(counts: np.ndarray) -> bytes:
    """Bit-major bytes of a multiple of eight counts."""
    raw = np.ascontiguousarray(counts).view(np.uint8).reshape(counts.size, counts.itemsize)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes()


def unshuffle(data: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(8 * size, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view(dtype)


def lz4_decode(data: bytes, size: int) -> bytes:
    """One LZ4 block of size bytes when unpacked."""
    try:
        out = pa.Codec("lz4_raw").decompress(data, size, asbytes=True)
    except (OSError, ValueError) as wrong:
        raise ValueError(f"not an LZ4 block of {size} bytes") from wrong
    return out


def lz4_encode(data: bytes) -> bytes:
    """A valid LZ4 block; four-byte repeats are looked up in a table."""
    out, seen, start, at, end = bytearray(), {}, 0, 0, len(data)

    def put(n: int) -> None:
        n -= 15
        while n >= 255:
            out.append(255)
            n -= 255
        out.append(n)

    def sequence(stop: int, back: int, n: int) -> None:
        literals = stop - start
        out.append(min(literals, 15) << 4 | (min(n - 4, 15) if back else 0))
        if literals >= 15:
            put(literals)
        out.extend(data[start:stop])
        if back:
            out.extend(struct.pack("<H", back))
            if n - 4 >= 15:
                put(n - 4)

    while at + 12 < end:  # the last bytes are literals
        word = data[at : at + 4]
        before = seen.get(word)
        seen[word] = at
        if before is None or at - before > 65535:
            at += 1
            continue
        n = 4
        while at + n < end - 5 and data[before + n] == data[at + n]:
            n += 1
        sequence(at, at - before, n)
        at += n
        start = at
    sequence(end, 0, 0)
    return bytes(out)


def compress(counts: np.ndarray, block: int = BLOCK) -> bytes:
    flat = np.ascontiguousarray(counts).ravel()
    per = max(8, block // flat.itemsize // 8 * 8)
    whole = flat.size // 8 * 8
    out = [struct.pack(">QI", flat.nbytes, per * flat.itemsize)]
    for a in range(0, whole, per):
        packed = lz4_encode(shuffle(flat[a : min(a + per, whole)]))
        out += [struct.pack(">I", len(packed)), packed]
    return b"".join(out) + flat[whole:].tobytes()


def decompress(data: bytes, dtype: np.dtype) -> np.ndarray:
    total, block = struct.unpack(">QI", data[:12])
    dtype, at, out = np.dtype(dtype), 12, []
    whole = total // dtype.itemsize // 8 * 8
    for a in range(0, whole, block // dtype.itemsize):
        n = min(block // dtype.itemsize, whole - a)
        (size,) = struct.unpack(">I", data[at : at + 4])
        out.append(unshuffle(lz4_decode(data[at + 4 : at + 4 + size], n * dtype.itemsize), n, dtype))
        at += 4 + size
    return np.concatenate([*out, np.frombuffer(data[at:], dtype)])
