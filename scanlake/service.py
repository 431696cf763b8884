"""A thin facade over scans for viewers: browsing, products, and jobs; and a loopback HTTP server for it.

Answers are plain values; images are collected because a viewer shows them whole. Jobs run under a Spark tag, so
cancelling one cancels its Spark jobs.
"""

from __future__ import annotations

import json
import math
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import dpc, reduce, select
from .plans.model import Scan
from .sources import frames

MODES = ("BF", "ABF", "ADF", "HAADF", "DF", "COMX", "COMY", "COMMAG", "DPC", "ICOM")


def _image(df: DataFrame, row: str, col: str, value: str, shape: tuple[int, int]) -> list[list[float]]:
    out = np.zeros(shape)
    for r in df.select(row, col, value).collect():  # an image for a viewer
        out[r[0], r[1]] = r[2]
    return out.tolist()


class Service:
    """Scans by name; the last ``resident`` ones that were used stay cached."""

    def __init__(self, spark: SparkSession, folder: str | None = None, resident: int = 2):
        self.spark, self.folder, self.resident = spark, folder, resident
        self.scans: OrderedDict[str, Scan] = OrderedDict()
        self.kept: OrderedDict[str, Scan] = OrderedDict()
        self.jobs: dict[str, tuple[Future, str]] = {}
        self.pool = ThreadPoolExecutor(2)
        self.lock = threading.Lock()
        self.refresh()

    # ---- browsing

    def refresh(self) -> list[str]:
        """Scans of the folder that are new since the last look."""
        if self.folder is None:
            return []
        try:
            found = frames.discover(self.spark, self.folder)
        except FileNotFoundError:
            return []
        new = [p for p in found if p not in self.scans and frames.is_ready(self.spark, p)]
        for p in new:
            self.scans[p] = frames.load(self.spark, p)
        return new

    def add(self, name: str, scan: Scan) -> None:
        self.scans[name] = scan.validate()

    def scan(self, name: str) -> Scan:
        """The scan with its frames cached; the one that was used longest ago makes room."""
        with self.lock:
            if name not in self.scans:
                raise KeyError(name)
            if name not in self.kept:
                scan = self.scans[name]
                self.kept[name] = scan.with_frames(scan.frames.cache())
                while len(self.kept) > self.resident:
                    self.kept.popitem(last=False)[1].frames.unpersist()
            self.kept.move_to_end(name)
            return self.kept[name]

    def capabilities(self) -> dict:
        sc = self.spark.sparkContext
        return {"spark": sc.version, "cores": sc.defaultParallelism, "modes": list(MODES)}

    def acquisitions(self) -> list[dict]:
        return [{"name": n, "scan_shape": list(s.scan_shape), "det_shape": list(s.det_shape), "semiangle_mrad": s.semiangle_mrad} for n, s in self.scans.items()]

    # ---- products

    def cbed(self, name: str, row: int, col: int) -> list[list[float]]:
        """The pattern at a position, moved into the scan."""
        scan = self.scan(name)
        at = select.selected_position(row, col, scan.scan_shape)
        return _image(scan.with_frames(select.frame(scan.frames, at)).pixels(), "det_row", "det_col", "n", scan.det_shape)

    def cbed_region(self, name: str, kind: str, row: float, col: float, radius: float, how: str = "mean") -> list[list[float]]:
        scan = self.scan(name)
        inside = select.roi(F.col("scan_row"), F.col("scan_col"), kind, (row, col), radius)
        return _image(reduce.roi_diffraction(scan.pixels(), inside, how), "det_row", "det_col", "value", scan.det_shape)

    def realspace(self, name: str, mode: str = "BF", inner: float = 1.0, outer: float = 2.0) -> list[list[float]]:
        scan, mode = self.scan(name), mode.upper()
        at = ("scan_row", "scan_col")
        if mode in ("COMX", "COMY", "COMMAG", "DPC"):
            column = {"COMX": "com_x", "COMY": "com_y", "COMMAG": "com_mag", "DPC": "dpc"}[mode]
            return _image(dpc.service_modes(dpc.center_of_mass(scan)), *at, column, scan.grid)
        if mode == "ICOM":
            return _image(dpc.integrate(dpc.center_of_mass(scan).select(*at, "com_row", "com_col"), shape=scan.scan_shape), *at, "phase", scan.scan_shape)
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        probe = reduce.fitted_probe(scan)
        bands = {"BF": (0.0, 1.0), "ABF": (0.5, 1.0), "ADF": (inner, outer), "HAADF": (2.0, 4.0), "DF": (1.0, math.inf)}
        return _image(reduce.service_image(scan, probe, mode, *bands[mode]), *at, "value", scan.grid)

    def realspace_shape(self, name: str, kind: str, row: float, col: float, radius: float, inner: float = 0.0) -> list[list[float]]:
        """What a detector of a given shape sees."""
        scan = self.scan(name)
        mask = select.roi(F.col("det_row"), F.col("det_col"), kind, (row, col), radius, inner)
        return _image(reduce.virtual_images(scan, {"value": mask}), "scan_row", "scan_col", "value", scan.grid)

    # ---- jobs

    def submit(self, call: Callable[[], object], key: str | None = None) -> str:
        """Runs a call in the background; the same key gives the same job."""
        with self.lock:
            name = key or uuid.uuid4().hex
            if name in self.jobs:
                return name
            tag = f"scanlake-{uuid.uuid4().hex}"

            def run() -> object:
                self.spark.addTag(tag)
                try:
                    return call()
                finally:
                    self.spark.removeTag(tag)

            self.jobs[name] = self.pool.submit(run), tag
            return name

    def job(self, name: str) -> dict:
        future, _ = self.jobs[name]
        if future.cancelled():
            return {"state": "cancelled"}
        if not future.done():
            return {"state": "running" if future.running() else "waiting"}
        failed = future.exception()
        return {"state": "failed", "error": str(failed)} if failed else {"state": "done", "result": future.result()}

    def cancel(self, name: str) -> None:
        future, tag = self.jobs[name]
        future.cancel()
        self.spark.interruptTag(tag)

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)
        for scan in self.kept.values():
            scan.frames.unpersist()


def _answer(service: Service, path: str, asked: dict[str, str]) -> object:
    number = lambda k, default=0.0: float(asked.get(k, default))
    name = asked.get("name", "")
    routes: dict[str, Callable[[], object]] = {
        "/capabilities": service.capabilities,
        "/acquisitions": service.acquisitions,
        "/refresh": service.refresh,
        "/cbed": lambda: service.cbed(name, int(number("row")), int(number("col"))),
        "/cbed-region": lambda: service.cbed_region(name, asked.get("kind", "circle"), number("row"), number("col"), number("radius", 1), asked.get("how", "mean")),
        "/realspace": lambda: service.realspace(name, asked.get("mode", "BF"), number("inner", 1), number("outer", 2)),
        "/realspace-shape": lambda: service.realspace_shape(name, asked.get("kind", "circle"), number("row"), number("col"), number("radius", 1), number("inner")),
        "/job": lambda: service.job(asked["id"]),
    }
    return routes[path]()


def serve(service: Service, port: int = 0) -> ThreadingHTTPServer:
    """A server on this machine only; GET requests give JSON."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802  the name is given
            url = urlparse(self.path)
            try:
                code, body = 200, _answer(service, url.path, dict(parse_qsl(url.query)))
            except KeyError as missing:
                code, body = 404, {"error": f"there is no {missing}"}
            except ValueError as wrong:
                code, body = 400, {"error": str(wrong)}
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            return

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
