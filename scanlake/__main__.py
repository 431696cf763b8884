"""``python -m scanlake FOLDER [--port N]``: serves the scans in a folder to viewers on this machine."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .plans.ship import ship
from .service import Service, serve


def main() -> None:
    asked = argparse.ArgumentParser(prog="scanlake", description=__doc__)
    asked.add_argument("folder")
    asked.add_argument("--port", type=int, default=8766)
    asked.add_argument("--refresh", type=float, default=5.0, help="seconds between looks for new scans")
    options = asked.parse_args()
    spark = SparkSession.builder.appName("scanlake").getOrCreate()
    ship(spark)
    service = Service(spark, options.folder)
    server = serve(service, options.port)
    print(f"http://127.0.0.1:{server.server_port}/acquisitions")
    try:
        while True:
            time.sleep(options.refresh)
            service.refresh()
    except KeyboardInterrupt:
        server.shutdown()
        service.close()


if __name__ == "__main__":
    main()
