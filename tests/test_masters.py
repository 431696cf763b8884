import struct
import zlib

import numpy as np
import pytest

from scanlake.operators import reduce
from scanlake.sources import hdf5, masters


def test_datasets_round_trip(tmp_path):
    path, rng = str(tmp_path / "a.h5"), np.random.default_rng(0)
    data = {
        "entry/a/u2": rng.integers(0, 60000, (3, 5)).astype("u2"), "entry/a/i8": np.array(-7, "i8"), "entry/f4": rng.random(4).astype("f4"),
        "f8": np.array([1.5, -2e300]), "entry/text": np.array(b"detector", "S8"), "entry/empty": np.zeros((0, 4, 4), "u2"),
    }
    w = hdf5.Writer(path)
    for k, v in data.items():
        w.add(k, v)
    frames = rng.poisson(3, (200, 6, 7)).astype("u2")  # more chunks than a node of the index holds
    w.add("entry/packed", frames, packed=True)
    w.link("entry/other", "b.h5", "entry/data")
    w.close()
    b = hdf5.Writer(str(tmp_path / "b.h5"))
    b.add("entry/data", frames[:3])
    b.close()
    with hdf5.File(path) as f:
        for k, v in data.items():
            got = f.dataset(k).read()
            assert got.dtype == v.dtype and got.shape == v.shape and (got == v).all()
        assert (f.dataset("entry/packed").read() == frames).all()
        assert all((x == frames[i]).all() for i, x in f.dataset("entry/packed").frames())
        assert (f.dataset("entry/other").read() == frames[:3]).all()
        assert f.keys("entry/a") == ["i8", "u2"] and set(f.walk()) == {*data, "entry/packed"}
        with pytest.raises(KeyError):
            f.dataset("entry/none")


def test_symbol_tables_new_headers_and_other_filters(tmp_path):
    """A file laid down by hand: superblock 2, an object header 2 with a link, and a group as a symbol table with chunks under
    shuffle and deflate."""
    out = bytearray(48)

    def put(b):
        out.extend(bytes(-len(out) % 8))
        out.extend(b)
        return len(out) - len(b)

    def header1(messages):
        body = b"".join(struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + bytes(-len(d) % 8) for k, d in messages)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    data = np.arange(24, dtype="<u4").reshape(6, 4) * 1000
    leaves = []
    for r in (0, 4):  # chunks of 4 x 4; the second one hangs over
        chunk = np.zeros((4, 4), "<u4")
        chunk[: len(data[r : r + 4])] = data[r : r + 4]
        raw = zlib.compress(chunk.reshape(-1, 1).view(np.uint8).T.tobytes())
        leaves.append((struct.pack("<II3Q", len(raw), 0, r, 0, 0), put(raw)))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 2, hdf5.NOWHERE, hdf5.NOWHERE) + b"".join(k + struct.pack("<Q", a) for k, a in leaves) + struct.pack("<II3Q", 0, 0, 8, 0, 0))
    filters = struct.pack("<BB", 2, 2) + struct.pack("<HHHI", hdf5.SHUFFLE, 0, 1, 4) + struct.pack("<HHHI", hdf5.DEFLATE, 0, 1, 6)
    messages = [(1, struct.pack("<BBBB2Q", 2, 2, 0, 1, 6, 4)), (3, struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 4, 0, 32)), (0x0B, filters), (8, struct.pack("<BBBQ3I", 3, 2, 3, tree, 4, 4, 4))]
    # the last message stands in a continuation
    body = struct.pack("<HHB3x", 8, 24, 0) + messages[3][1] + bytes(1)
    more = put(body)
    dataset = header1([*messages[:3], (0x10, struct.pack("<QQ", more, len(body)))])
    names = put(b"\0\0\0\0\0\0\0\0x\0\0\0\0\0\0\0alias\0\0\0/group/x\0\0\0\0\0\0\0\0")
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, 40, 1, names))
    snod = put(b"SNOD" + struct.pack("<BxH", 1, 2) + struct.pack("<QQII16x", 8, dataset, 0, 0) + struct.pack("<QQIII12x", 16, hdf5.NOWHERE, 2, 0, 24))
    group_tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE) + struct.pack("<QQQ", 0, snod, 16))
    group = header1([(0x11, struct.pack("<QQ", group_tree, heap))])
    link = bytes([1, 0, 5]) + b"group" + struct.pack("<Q", group)
    root = put(b"OHDR" + bytes([2, 0, 4 + len(link)]) + struct.pack("<BHB", 6, len(link), 0) + link + bytes(4))
    out[:48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, hdf5.NOWHERE, len(out), root) + bytes(4)
    path = str(tmp_path / "hand.h5")
    with open(path, "wb") as f:
        f.write(out)
    with hdf5.File(path) as f:
        assert f.keys("group") == ["alias", "x"]
        for name in ("group/x", "group/alias"):
            assert (f.dataset(name).read() == data).all()


def test_masters(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = rng.poisson(4, (9, 8, 10)).astype("u2")
    mask = np.zeros((8, 10), int)
    mask[2, 3] = 1
    master = masters.save(str(tmp_path / "scan"), frames, mask, 1e-3, per_shard=4)
    state = masters.inspect(master)
    assert state["ready"] and state["found"] == 9 and state["metadata"]["scan_shape"] == (3, 3) and state["metadata"]["dwell_time_us"] == 1000
    assert [tuple(r) for r in masters.read_mask(spark, master).collect()] == [(2, 3)]
    scan = masters.load(spark, master).validate()
    got = {r.frame_idx: r.counts for r in scan.frames.collect()}
    assert all(got[i] == frames[i].ravel().tolist() for i in range(9)) and scan.det_shape == (8, 10)
    assert {r.frame_idx: r.value for r in reduce.total_counts(scan.pixels()).collect()} == {i: int(frames[i].sum()) for i in range(9)}
    some = spark.read.format("scan_hdf5").option("firstFrame", 3).option("lastFrame", 5).load(master)
    assert sorted(r.frame_idx for r in some.collect()) == [3, 4, 5]
    assert masters.inspect(master, (2, 5))["reason"] == "incomplete" and masters.inspect(master, (2, 2))["reason"] == "too many frames"
    (tmp_path / "scan_data_000002.h5").unlink()
    assert "missing shards" in masters.inspect(master)["reason"]
    with pytest.raises(ValueError):
        masters.load(spark, master)
    (tmp_path / "bad.h5").write_bytes(b"nothing")
    assert not masters.inspect(str(tmp_path / "bad.h5"))["ready"]
