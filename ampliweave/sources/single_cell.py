"""Tables of single-cell runs (SRC8 to SRC10, PIPE6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(barcode): what is before the first hyphen of each line (SRC8)."""
    return spark.read.text(path).select(F.substring_index("value", "-", 1).alias("barcode"))


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    """(source: second column, target: first column) (SRC9). Where a source comes twice, the greatest target stays, whatever the order of reading."""
    rows = spark.read.option("sep", "\t").csv(path)
    return rows.groupBy(F.col("_c1").alias("source")).agg(F.max("_c0").alias("target"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(column, total) of a Matrix Market file (SRC10); columns count from 1. The line of sizes is the one whose three numbers are rows, columns and entries."""
    rows = spark.read.text(path).where(~F.col("value").startswith("%")).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("v"))
    n = rows.count() - 1
    head = rows.where((F.col("v")[2] == n)).agg(F.max(F.struct(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))).alias("h"))  # sizes are the greatest of each
    entries = rows.join(F.broadcast(head)).where(~((F.col("v")[2] == n) & (F.col("v")[0] == F.col("h.a")) & (F.col("v")[1] == F.col("h.b"))) | F.lit(n == 0))
    return entries.groupBy(F.col("v")[1].cast("long").alias("column")).agg(F.sum(F.col("v")[2]).alias("total"))


def coverage_of(barcodes: DataFrame, cells: DataFrame, cell: str = "barcode") -> DataFrame:
    """One row (listed, found): barcodes, and those among the cells."""
    known = cells.select(F.col(cell).alias("barcode")).distinct().withColumn("__k", F.lit(1))
    return barcodes.distinct().join(known, "barcode", "left").agg(F.count("*").alias("listed"), F.count("__k").alias("found"))
