import json
import time
from urllib.error import HTTPError
from urllib.request import urlopen

import numpy as np
import pytest

from scanlake import service
from scanlake.sources import frames

from .test_scans import scan_of


def test_service(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 50, (3, 4, 6, 6))
    frames.save(scan_of(spark, data), str(tmp_path / "one"), "u8")
    s = service.Service(spark, str(tmp_path))
    s.add("two", scan_of(spark, data[:2]))
    server = service.serve(s)

    def ask(path):
        with urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=60) as r:
            return json.load(r)

    names = [a["name"] for a in ask("/acquisitions")]
    assert len(names) == 2 and s.refresh() == [] and ask("/capabilities")["cores"] > 0
    one = names[0]
    assert ask(f"/cbed?name={one}&row=9&col=1") == data[2, 1].tolist()
    assert np.allclose(ask(f"/cbed-region?name={one}&kind=square&row=1&col=1&radius=1&how=sum"), data[:3, :3].sum((0, 1)))
    y, x = np.mgrid[:6, :6]
    assert np.allclose(ask(f"/realspace-shape?name={one}&row=2&col=3&radius=2"), (data * ((y - 2) ** 2 + (x - 3) ** 2 <= 4)).sum((2, 3)))
    assert np.allclose(ask(f"/realspace?name={one}&mode=comy"), (data * y).sum((2, 3)) / data.sum((2, 3)))
    for mode in ("BF", "DF", "ICOM"):
        assert np.array(ask(f"/realspace?name=two&mode={mode}")).shape == (2, 4)
    for path, code in ((f"/realspace?name={one}&mode=none", 400), ("/cbed?name=three", 404), ("/nothing", 404)):
        with pytest.raises(HTTPError) as wrong:
            ask(path)
        assert wrong.value.code == code
    job = s.submit(lambda: s.scan(one).frames.count(), "count")
    assert s.submit(lambda: 0, "count") == job
    for _ in range(100):
        if (state := s.job(job))["state"] == "done":
            break
        time.sleep(0.1)
    assert state["result"] == 12
    s.close()
    server.shutdown()
