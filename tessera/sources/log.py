"""The append-only event log and its exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut


def append(log: DataFrame, events: DataFrame, order: list[Column], recorded_at: str) -> DataFrame:
    """``events`` with the sequence numbers after the largest of ``log``, in ``order``, and ``recorded_at``."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top")).scalar()
    return numbered(events, order).withColumn("seq", F.col("seq") + top).withColumn("recorded_at", F.lit(recorded_at).cast("timestamp"))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``seq`` from 1 in a total order without one task seeing all rows.

    Rows are parted into ranges of the whole order, sorted and counted off within
    their range; the written table keeps the counts, which are shifted by the sizes of
    the ranges before. There are as many ranges as the session has partitions.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # below the partition's number
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = cut(ranged.withColumns({"_b": F.spark_partition_id(), "_r": within + 1}), "numbered")
    sizes = counted.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return counted.join(F.broadcast(starts), "_b").withColumn("seq", F.col("_s") + F.col("_r")).drop("_b", "_r", "_s")


def scan(log: DataFrame, after: int, limit: int | None = None) -> DataFrame:
    """Events after a sequence number, in order. The range reaches the file scan."""
    out = log.where(F.col("seq") > after).orderBy("seq")
    return out.limit(limit) if limit is not None else out


def export_lines(versions: DataFrame, source: str, key: str, columns: list[str]) -> DataFrame:
    """One JSON line per version: source, key, line. Nested by item only when read, since an item has no length limit."""
    return versions.select(source, key, F.to_json(F.struct(source, key, *columns)).alias("line"))


def export_markdown(versions: DataFrame, title: str, body: str) -> DataFrame:
    """Each version as a Markdown text; untitled and empty ones too."""
    return versions.withColumn("markdown", F.concat(F.lit("# "), F.coalesce(title, F.lit("(untitled)")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n")))


def read_golden(spark, path: str) -> DataFrame:
    """Judgements from a golden-set file: query_text, source_name, external_key, chunk_ordinal, verdict, rank."""
    raw = spark.read.option("multiLine", "true").schema(
        "queries array<struct<query_text: string, items: array<struct<source_name: string, external_key: string, chunk_ordinal: int, verdict: string, rank: int>>>>"
    ).json(path)
    q = raw.select(F.explode("queries").alias("q"))
    return q.select("q.query_text", F.explode("q.items").alias("i")).select("query_text", "i.*")


def golden_json(judgements: DataFrame) -> DataFrame:
    """One JSON object per query, its items sorted by natural key; judgements of a query are made by hand and few."""
    items = F.sort_array(F.collect_list(F.struct("source_name", "external_key", "chunk_ordinal", "verdict", "rank")))
    return judgements.groupBy("query_text").agg(items.alias("items")).select(F.to_json(F.struct("query_text", "items")).alias("json"))
