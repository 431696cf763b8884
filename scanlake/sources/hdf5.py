"""The part of the HDF5 file format that detector files use, read and written with NumPy.

Reading: superblocks 0 to 3; object headers 1 and 2; groups as symbol tables or link messages (hard, soft and external
links); integers, floats and fixed strings; compact, contiguous and B-tree-chunked data; deflate, shuffle and
bit-shuffle/LZ4 filters. Anything else raises Unsupported. Writing: superblock 0, groups of link messages,
contiguous or chunked data with the bit-shuffle filter.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from .bitshuffle import compress, decompress

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
# Numbers of messages and filters.
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, GROUP_INFO, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0A, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, BITSHUFFLE = 1, 2, 32008


class Unsupported(ValueError):
    pass


class External:
    """A link into another file."""

    def __init__(self, file: str, path: str):
        self.file, self.path = file, path


class Dataset:
    def __init__(self, file: File, messages: list[tuple[int, bytes]]):
        found = dict(reversed(messages))
        self.file = file
        self.shape = _shape(found[DATASPACE])
        self.dtype = _dtype(found[DATATYPE])
        self.layout = found[LAYOUT]
        self.filters = _filters(found[FILTERS]) if FILTERS in found else []

    def __len__(self) -> int:
        return self.shape[0]

    def read(self) -> np.ndarray:
        version, kind = self.layout[0], self.layout[1]
        if version != 3:
            raise Unsupported(f"data layout {version}")
        n = int(np.prod(self.shape, dtype=np.int64)) * self.dtype.itemsize
        if kind == 0:
            (size,) = struct.unpack_from("<H", self.layout, 2)
            return np.frombuffer(self.layout[4 : 4 + size], self.dtype).reshape(self.shape)
        if kind == 1:
            at, _ = struct.unpack_from("<QQ", self.layout, 2)
            raw = bytes(n) if at == NOWHERE else self.file.at(at, n)
            return np.frombuffer(raw, self.dtype).reshape(self.shape)
        out = np.zeros(self.shape, self.dtype)
        for offset, chunk in self.chunks():
            place = tuple(slice(o, min(o + c, s)) for o, c, s in zip(offset, chunk.shape, self.shape, strict=True))
            out[place] = chunk[tuple(slice(0, p.stop - p.start) for p in place)]
        return out

    def places(self) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Offset, address, stored size and filter mask of the chunks, from the index alone."""
        rank = self.layout[2] - 1
        (tree,) = struct.unpack_from("<Q", self.layout, 3)
        if tree == NOWHERE:
            return
        key = 8 + 8 * (rank + 1)
        nodes = [tree]
        while nodes:
            head = self.file.at(at := nodes.pop(), 24)
            if head[:4] != b"TREE" or head[4] != 1:
                raise Unsupported("chunk index")
            level, n = head[5], struct.unpack_from("<H", head, 6)[0]
            body = self.file.at(at + 24, n * (key + 8))
            for i in range(n):
                size, mask, *offset = struct.unpack_from(f"<II{rank + 1}Q", body, i * (key + 8))
                (child,) = struct.unpack_from("<Q", body, i * (key + 8) + key)
                if level:
                    nodes.append(child)
                else:
                    yield tuple(offset[:rank]), child, size, mask

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        rank = self.layout[2] - 1
        return struct.unpack_from(f"<{rank}I", self.layout, 11)

    def chunks(self) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        for offset, at, size, mask in sorted(self.places()):
            yield offset, self.decoded(self.file.at(at, size), mask)

    def decoded(self, raw: bytes, mask: int = 0) -> np.ndarray:
        n = int(np.prod(self.chunk_shape, dtype=np.int64))
        for i, (kind, values) in reversed(list(enumerate(self.filters))):
            if mask >> i & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(self.dtype.itemsize, -1).T.tobytes()
            elif kind == BITSHUFFLE and len(values) > 4 and values[4] == 2:
                raw = decompress(raw, self.dtype).tobytes()
            else:
                raise Unsupported(f"filter {kind} {values}")
        return np.frombuffer(raw, self.dtype, n).reshape(self.chunk_shape)

    def frames(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and values along the first axis; one chunk is held at a time."""
        if self.layout[1] != 2:
            yield from enumerate(self.read())
            return
        if self.chunk_shape[1:] != self.shape[1:]:
            yield from enumerate(self.read())
            return
        for offset, chunk in self.chunks():
            for i, frame in enumerate(chunk):
                if offset[0] + i < self.shape[0]:
                    yield offset[0] + i, frame


def _shape(m: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{m[1]}Q", m, 8 if m[0] == 1 else 4)


def _dtype(m: bytes) -> np.dtype:
    kind, bits = m[0] & 15, m[1]
    (size,) = struct.unpack_from("<I", m, 4)
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    raise Unsupported(f"data type {kind}")


def _filters(m: bytes) -> list[tuple[int, tuple[int, ...]]]:
    version, n, at, out = m[0], m[1], 8 if m[0] == 1 else 2, []
    for _ in range(n):
        (kind,) = struct.unpack_from("<H", m, at)
        named = version == 1 or kind >= 256
        length = struct.unpack_from("<H", m, at + 2)[0] if named else 0
        at += 4 if named else 2
        _, values = struct.unpack_from("<HH", m, at)
        at += 4 + (-(-length // 8) * 8 if version == 1 else length)
        out.append((kind, struct.unpack_from(f"<{values}I", m, at)))
        at += 4 * (values + (values % 2 if version == 1 else 0))
    return out


class File:
    """Opened for reading; paths lead through groups, soft links and (other files') external links."""

    def __init__(self, path: str):
        self.path = path
        self.handle = os.open(path, os.O_RDONLY)
        head = self.at(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError(f"{path} is no HDF5 file")
        version = head[8]
        sizes = head[13:15] if version < 2 else head[9:11]
        if tuple(sizes) != (8, 8):
            raise Unsupported("addresses of another size than 8 bytes")
        if version < 2:
            entry = 24 + (4 if version == 1 else 0) + 32
            self.root = struct.unpack_from("<Q", head, entry + 8)[0]
        else:
            self.root = struct.unpack_from("<Q", head, 36)[0]

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        os.close(self.handle)

    def at(self, place: int, n: int) -> bytes:
        out = os.pread(self.handle, n, place)
        if len(out) < n and place + n > os.fstat(self.handle).st_size and place:
            raise ValueError(f"{self.path} ends early")
        return out

    def messages(self, place: int) -> list[tuple[int, bytes]]:
        head = self.at(place, 16)
        out: list[tuple[int, bytes]] = []
        if head[:4] == b"OHDR":
            flags, at = head[5], place + 6 + (16 if head[5] & 0x20 else 0) + (4 if head[5] & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks = [(at + width, int.from_bytes(self.at(at, width), "little"))]
            step = 4 + (2 if flags & 4 else 0)
        else:
            blocks, step = [(place + 16, struct.unpack_from("<I", head, 8)[0])], 8
        for start, size in blocks:
            raw, at = self.at(start, size), 0
            while at + step <= len(raw):
                if step == 8:
                    kind, n = struct.unpack_from("<HH", raw, at)
                else:
                    kind, n = raw[at], struct.unpack_from("<H", raw, at + 1)[0]
                body = raw[at + step : at + step + n]
                if kind == CONTINUED:
                    to, length = struct.unpack("<QQ", body[:16])
                    blocks.append((to, length) if step == 8 else (to + 4, length - 8))  # newer blocks have a mark and a checksum
                out.append((kind, body))
                at += step + n
        return out

    def links(self, place: int) -> dict[str, int | str | External]:
        """Of a group: addresses, paths of soft links, external links."""
        out: dict[str, int | str | External] = {}
        for kind, body in self.messages(place):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                (names,) = struct.unpack("<Q", self.at(heap + 24, 8))
                for name, to, cache, scratch in self._symbols(tree):
                    text = self._text(names + name)
                    out[text] = self._text(names + struct.unpack_from("<I", scratch)[0]) if cache == 2 else to
            elif kind == LINK:
                name, link = _link(body)
                out[name] = link
            elif kind == LINK_INFO and struct.unpack_from("<Q", body, 2 + (8 if body[1] & 1 else 0))[0] != NOWHERE:
                raise Unsupported("a group with densely stored links")
        return out

    def _symbols(self, tree: int) -> Iterator[tuple[int, int, int, bytes]]:
        head = self.at(tree, 24)
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        body = self.at(tree + 24, 16 * n + 8)
        for i in range(n):
            (child,) = struct.unpack_from("<Q", body, 16 * i + 8)
            if level:
                yield from self._symbols(child)
                continue
            (count,) = struct.unpack("<H", self.at(child + 6, 2))
            for j in range(count):
                entry = self.at(child + 8 + 40 * j, 40)
                name, to, cache = struct.unpack_from("<QQI", entry)
                yield name, to, cache, entry[24:]

    def _text(self, place: int) -> str:
        raw = b""
        while b"\0" not in raw:
            more = os.pread(self.handle, 256, place + len(raw))
            if not more:
                break
            raw += more
        return raw.split(b"\0")[0].decode()

    def _find(self, path: str) -> int | External:
        here: int | External = self.root
        parts = [p for p in path.split("/") if p]
        for i, p in enumerate(parts):
            found = self.links(here)
            if p not in found:
                raise KeyError(path)
            here = found[p]
            if isinstance(here, str):
                base = "" if here.startswith("/") else "/".join(parts[:i]) + "/"
                here = self._find(base + here)
            if isinstance(here, External):
                if i + 1 < len(parts):
                    here = External(here.file, here.path + "/" + "/".join(parts[i + 1 :]))
                return here
        return here

    def keys(self, path: str = "/") -> list[str]:
        return sorted(self.links(self._find(path)))

    def external(self, path: str) -> External | None:
        found = self._find(path)
        return found if isinstance(found, External) else None

    def dataset(self, path: str) -> Dataset:
        found = self._find(path)
        if isinstance(found, External):
            other = File(os.path.join(os.path.dirname(self.path), found.file))
            return other.dataset(found.path)
        messages = self.messages(found)
        if not any(k == LAYOUT for k, _ in messages):
            raise KeyError(f"{path} is a group")
        return Dataset(self, messages)

    def walk(self, path: str = "") -> Iterator[str]:
        """Paths of the datasets in this file, links to other files left out."""
        for name, to in sorted(self.links(self._find(path)).items()):
            if isinstance(to, External):
                continue
            whole = f"{path}/{name}" if path else name
            place = self._find(whole) if isinstance(to, str) else to
            if isinstance(place, External):
                continue
            if any(k == LAYOUT for k, _ in self.messages(place)):
                yield whole
            else:
                yield from self.walk(whole)


def _link(body: bytes) -> tuple[str, int | str | External]:
    flags, at = body[1], 2
    kind = body[at] if flags & 8 else 0
    at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
    width = 1 << (flags & 3)
    n = int.from_bytes(body[at : at + width], "little")
    at += width
    name = body[at : at + n].decode()
    at += n
    if kind == 0:
        return name, struct.unpack_from("<Q", body, at)[0]
    (size,) = struct.unpack_from("<H", body, at)
    value = body[at + 2 : at + 2 + size]
    if kind == 1:
        return name, value.decode()
    if kind == 64:
        file, path = value[1:].split(b"\0")[:2]
        return name, External(file.decode(), path.decode())
    raise Unsupported(f"link {kind}")


# ---- writing ------------------------------------------------------------------------------------------------------

class Writer:
    """Collects datasets and links by path and writes them in one go."""

    def __init__(self, path: str):
        self.path = path
        self.tree: dict = {}
        self.out = bytearray(96)

    def _place(self, path: str, what: object) -> None:
        *groups, name = [p for p in path.split("/") if p]
        here = self.tree
        for g in groups:
            here = here.setdefault(g, {})
        here[name] = what

    def add(self, path: str, data: np.ndarray, packed: bool = False) -> None:
        """packed: chunks of one frame (along the first axis) each, bit-shuffled and compressed."""
        self._place(path, (np.asarray(data), packed))

    def link(self, path: str, file: str, target: str) -> None:
        self._place(path, External(file, target))

    def close(self) -> None:
        root = self._group(self.tree)
        head = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.out), NOWHERE)
        head += struct.pack("<QQII", 0, root, 0, 0) + bytes(16)
        self.out[: len(head)] = head
        with open(self.path, "wb") as f:
            f.write(self.out)

    def _put(self, data: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, data in messages:
            data += bytes(-len(data) % 8)
            body += struct.pack("<HHB3x", kind, len(data), 0) + data
        return self._put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def _group(self, tree: dict) -> int:
        messages = [(LINK_INFO, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), (GROUP_INFO, b"\0\0")]
        for name, what in tree.items():
            raw = name.encode()
            if isinstance(what, External):
                value = b"\0" + what.file.encode() + b"\0" + what.path.encode() + b"\0"
                messages.append((LINK, bytes([1, 8, 64, len(raw)]) + raw + struct.pack("<H", len(value)) + value))
                continue
            to = self._group(what) if isinstance(what, dict) else self._dataset(*what)
            messages.append((LINK, bytes([1, 0, len(raw)]) + raw + struct.pack("<Q", to)))
        return self._header(messages)

    def _dataset(self, data: np.ndarray, packed: bool) -> int:
        size = data.dtype.itemsize
        if data.dtype.kind in "ui":
            dtype = struct.pack("<BBBBIHH", 0x10, 8 if data.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
        elif data.dtype.kind == "S":
            dtype = struct.pack("<BBBBI", 0x13, 0, 0, 0, size)
        elif data.dtype == np.float64 or data.dtype == np.float32:
            sign, exponent, mantissa, bias = (63, (52, 11), 52, 1023) if size == 8 else (31, (23, 8), 23, 127)
            dtype = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, size, 0, 8 * size, *exponent, 0, mantissa, bias)
        else:
            raise Unsupported(f"{data.dtype}")
        space = struct.pack("<BBB5x", 1, data.ndim, 0) + struct.pack(f"<{data.ndim}Q", *data.shape)
        messages = [(DATASPACE, space), (DATATYPE, dtype)]
        if not packed:
            at = self._put(np.ascontiguousarray(data).tobytes())
            return self._header([*messages, (LAYOUT, struct.pack("<BBQQ", 3, 1, at, data.nbytes))])
        chunk = (1, *data.shape[1:])
        key = lambda n, i: struct.pack(f"<II{data.ndim + 1}Q", n, 0, i, *[0] * data.ndim)
        nodes: list[tuple[bytes, int]] = []
        for i, frame in enumerate(data):
            raw = compress(frame)
            nodes.append((key(len(raw), i), self._put(raw)))
        level = 0
        while True:
            above = []
            for a in range(0, len(nodes) or 1, 64):
                part = nodes[a : a + 64]
                last = nodes[a + 64][0] if a + 64 < len(nodes) else key(0, len(data))
                body = b"".join(k + struct.pack("<Q", to) for k, to in part) + last
                above.append((part[0][0] if part else last, self._put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(part), NOWHERE, NOWHERE) + body)))
            nodes, level = above, level + 1
            if len(nodes) == 1:
                break
        layout = struct.pack("<BBBQ", 3, 2, data.ndim + 1, nodes[0][1]) + struct.pack(f"<{data.ndim + 1}I", *chunk, size)
        name = b"bitshuffle\0"
        name += bytes(-len(name) % 8)
        pipeline = struct.pack("<BB6x", 1, 1) + struct.pack("<HHHH", BITSHUFFLE, len(name), 1, 5) + name + struct.pack("<5I4x", 0, 2, size, 0, 2)
        return self._header([*messages, (FILTERS, pipeline), (LAYOUT, layout)])
