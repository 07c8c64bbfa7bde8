"""File trees as a source: observation, change detection, content-addressed blobs, decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.operators.relational import glob_excluded

MOST_BYTES = 50 * 1024 * 1024


def observe(spark: SparkSession, root: str, include: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files under ``root``: external_key (relative path), modified_at, bytes, content.

    ``include`` is a glob on names, ``exclude`` globs on relative paths or, without
    a slash, on names. Files above 50 MB are left out before they are read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root)
    base = root if "://" in root else "file:" + root
    key = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace("file:", "").rstrip("/") + "/+", "")
    out = df.where(F.col("length") <= MOST_BYTES).select(key.alias("external_key"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"), "content")
    return out.where(~glob_excluded("external_key", exclude)) if exclude else out


def changed(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (modified_at, bytes) are not known; only those need hashing. ``known``: external_key, modified_at, bytes."""
    return observed.join(known.select("external_key", "modified_at", "bytes"), ["external_key", "modified_at", "bytes"], "left_anti")


def vanished(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Known keys that were not observed."""
    return known.select("external_key").distinct().join(observed.select("external_key"), "external_key", "left_anti")


def blobs(files: DataFrame) -> DataFrame:
    """Content-addressed blobs: hash, bytes, content; equal content once, null content not at all."""
    hashed = files.where("content IS NOT NULL").select(F.sha2("content", 256).alias("hash"), F.length("content").alias("bytes"), "content")
    return hashed.dropDuplicates(["hash"])


def unknown_blobs(new: DataFrame, stored: DataFrame) -> DataFrame:
    """S3: blobs whose hash is not stored yet."""
    return new.join(stored.select("hash"), "hash", "left_anti")


@F.pandas_udf(T.StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return b.decode("utf-8-sig")
        except UnicodeDecodeError:
            return b.decode("latin-1")

    return pd.Series([one(b) for b in raw], dtype=object)


def decode(content: str | Column) -> Column:
    """UTF-8 with or without a mark, else Latin-1; null stays null."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(c.cast("string")) & ~F.startswith(F.hex(c), F.lit("EFBBBF")), c.cast("string")).otherwise(_decoded(c))


def parser_of(key: str | Column) -> Column:
    """Which parser reads a file."""
    suffix = F.lower(F.regexp_extract(key, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("md", "markdown"), "markdown").when(suffix.isin("py", "js", "ts", "go", "rs", "java", "c", "h", "sh"), "code").when(suffix == "pdf", "pdf").otherwise("text")
