"""Total orders without a window over all rows (SRT1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import cut


def numbered(df: DataFrame, by: Sequence[str], name: str = "place") -> DataFrame:
    """df with the place of each row, from 1. Rows are range-sorted into a table; a part's rows are counted in it, and earlier parts' sizes added."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id() % (1 << 33)), "ordered")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a part
    return rows.join(before, "__part").withColumn(name, F.col("__before") + F.col("__in") + 1).drop("__part", "__in", "__before")
