"""Reading tables, and cutting lineage by tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the files read that a partition is made of; partitions are PARTS for each core at least.
PART_BYTES, PARTS = 4 << 20, 2


def parts_of(df: DataFrame) -> int:
    """Partitions for df, in proportion to the files that its plan reads; inputs of an unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 50)
    return max(PARTS * df.sparkSession.sparkContext.defaultParallelism, min(-(-known // PART_BYTES), 10_000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own (a temporary one only in local mode)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    own = getattr(spark, "_ampliweave_shared_dir", None)
    if own is None:
        if spark.sparkContext.master.split("[")[0] == "local":
            own = "file://" + tempfile.mkdtemp(prefix="ampliweave-")
        else:
            own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.ampliweave"
        spark._ampliweave_shared_dir = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
