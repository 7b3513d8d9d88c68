"""Rows as JSON objects, and small reports of a driver."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """One column, json: each row as an object whose names are in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_report(path: str, payload: Any, ordered: bool = False) -> None:
    """A small report as indented JSON with a line end, letters as they are; with names in order if asked for. The folder is made. For a driver's own file system."""
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=ordered) + "\n")
