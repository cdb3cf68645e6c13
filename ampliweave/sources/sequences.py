"""FASTQ, FASTA, whitelists (SRC2 to SRC4, SRC6, SRC7) and simulated-read reports (SNK5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import sequence as S


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line: from 0, value) of text files, compressed or not.

    Lines of a split are counted in it; splits are few, and their sizes add up to where each one starts. So a file of any size is read in parallel.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    splits = splits.select("file", "block", "first", before.alias("before"))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx: place in the file from 0, id, seq, qual: array of Phred numbers) (SRC2). Records that aren't whole or whose lengths differ have null in seq and qual."""
    rows = _numbered_lines(spark, path).withColumn("idx", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4)
    part = lambda n: F.max(F.when(F.col("part") == n, F.col("value")))
    rec = rows.groupBy("file", "idx").agg(part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("q"))
    ok = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("q"))
    qual = F.transform(F.split("q", ""), lambda c: F.ascii(c) - 33)
    return rec.where("head != '' OR seq IS NOT NULL").select(
        "file", "idx", F.regexp_extract("head", r"^@?(\S*)", 1).alias("id"), F.when(ok, F.col("seq")).alias("seq"),
        F.when(ok, F.when(F.length("q") == 0, F.array().cast("array<int>")).otherwise(qual)).alias("qual"),
    )


def zip_mates(first: DataFrame, **others: DataFrame) -> DataFrame:
    """Mates by place in their files (SRC3, JON1): idx, id1, seq1, qual1 and those of read2, index1, index2; a missing mate is null.

    Read 1 decides: rows from its first damaged record on are left out. Each input is one file.
    """
    stop = first.where(F.col("seq").isNull()).agg(F.min("idx").alias("stop"))
    one = first.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).select("idx", F.col("id").alias("id1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    names = {"read2": "2", "index1": "_index1", "index2": "_index2"}
    for name, df in others.items():
        one = one.join(df.select("idx", *[F.col(c).alias(f"{c}{names[name]}") for c in ("id", "seq", "qual")]), "idx", "left")
    return one


def write_fastq(df: DataFrame, path: str, name: str = "id", seq: str = "seq", qual: str = "qual", compression: str = "gzip") -> None:
    letters = F.array_join(F.transform(qual, lambda q: F.char(q + 33)), "")
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), name), seq, F.lit("+"), letters)).write.option("compression", compression).text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence); case is kept (SRC4)."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) != ''")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rec.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), body.alias("sequence"))


def read_whitelist(spark: SparkSession, path: str, reverse_complement: bool = False) -> DataFrame:
    """(seq) of distinct lines (SRC6, SRC7)."""
    seq = F.trim("value")
    lines = spark.read.text(path).where(F.length(seq) > 0)
    return lines.select((S.reverse_complement(seq) if reverse_complement else seq).alias("seq")).distinct()


def simulated_read_report(fastq: DataFrame, head: str = "head") -> DataFrame:
    """length, error, identity and chimera from the names of simulated reads (SNK5)."""
    number = lambda name, kind: F.regexp_extract(head, rf"\b{name}=([0-9.]+)", 1).try_cast(kind)
    return fastq.select(head, number("length", "long").alias("length"), number("error", "double").alias("error"), number("read_identity", "double").alias("identity"), F.contains(head, F.lit("chimera")).alias("chimera"))
