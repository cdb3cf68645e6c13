"""Structured Streaming over reads as they come (STR1); all state is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(reads: DataFrame, time: str, late: str) -> DataFrame:
    """Streams get a watermark, which wants a time with a zone; tables stay as they are."""
    return reads.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if reads.isStreaming else reads


def tag_counts(reads: DataFrame, time: str, tags: Sequence[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, tags, n): reads of each tag in each window of time; later rows than ``late`` are dropped. Works on tables too."""
    own = _watermarked(reads, time, late)
    return own.groupBy(F.window(time, window).alias("w"), *tags).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *tags, "n")


def first_of_molecule(reads: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """One read of each molecule, as they come; state goes with the watermark."""
    return _watermarked(reads, time, late).dropDuplicatesWithinWatermark(list(keys)) if reads.isStreaming else reads.dropDuplicates(list(keys))
