"""Parquet tables of the document library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of ``<name>.parquet`` files or directories."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_meta(meta: DataFrame, *columns: str) -> DataFrame:
    """The extraction that holds for each entry: the one of the latest ``extracted_at``.

    Redelivered rows collapse. A null time counts as the oldest; of rows with the
    same time the greatest (extractor, confidence, ...) is taken, so that the result
    does not depend on row order. Aggregates map-side before the shuffle.
    """
    columns = columns or ("extractor", "confidence", "chars", "source_pages", "indexed_pages")
    newest = F.max(F.struct("extracted_at", *columns)).alias("m")
    return meta.groupBy("entry_id").agg(newest).select("entry_id", *[F.col(f"m.{c}").alias(c) for c in columns])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Pages without their redeliveries (rows equal in all columns share the page_id)."""
    return pages.dropDuplicates(["page_id"])
