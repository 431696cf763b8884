"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query: module. Each module has query(spark, sf_dir), and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_line_frequency": "quality",
    "op2_license_scan": "licenses",
    "op3_sharding": "sharding",
    "op4_simhash_covering": "simhash",
    "op5_url_filter": "urls",
    "op6_chat_format": "chat",
    "op7_warc": "warc",
    "op8_webp": "webp",
    "op9_mixing": "mixing",
    "op10_packing": "packing",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
