"""Parquet tables with one timestamp type.

The files hold timestamps without a zone. They are cast to ``TIMESTAMP`` once,
at the scan, under the session zone UTC; filters on them still reach parquet.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``, every ``timestamp_ntz`` cast to ``timestamp``.

    The session's zone is set to UTC if it is another, since the files mean UTC.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def state(folder: str, name: str) -> str:
    """What tells one state of a table from another: its path, and size and time of change of its files."""
    root = Path(f"{folder}/{name}.parquet")
    files = sorted(root.rglob("*.parquet")) if root.is_dir() else [root] if root.exists() else []
    return "|".join([str(root), *(f"{p.stat().st_size}:{p.stat().st_mtime_ns}" for p in files)])
