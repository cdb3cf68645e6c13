"""Deterministic reads from the driver's tables, for queries and tests: the same text in Spark and in SQL.

dna(x) is 32 bases from the MD5 of x. A molecule is dna(user:event type); every tenth event's read has one base exchanged or unread, every seventh
an insertion and every fifth a deletion against its molecule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def dna(x: Column) -> Column:
    return F.translate(F.md5(x.cast("string").cast("binary")), _HEX, _BASES)


def sql_dna(x: str) -> str:
    return f"translate(md5(CAST({x} AS VARCHAR)), '{_HEX}', '{_BASES}')"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, ref_name, molecule, seq (32 bases), ref_aln, read_aln, tagged (ref_aln with tag symbols 0 and 1), cell_tag, umi, flag."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    e = e.withColumn("molecule", dna(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")))
    i = F.col("event_id")
    p = (i % 32).cast("int")
    odd = F.when(i % 20 == 0, "N").otherwise(F.translate(F.substr("molecule", p + 1, F.lit(1)), "ACGT", "CGTA"))
    seq = F.when(i % 10 == 0, F.concat(F.substr("molecule", F.lit(1), p), odd, F.substr("molecule", p + 2, F.lit(32)))).otherwise(F.col("molecule"))
    e = e.withColumn("seq", seq)
    d, k, at, j = ((i % 10) + 15).cast("int"), ((i % 4) + 1).cast("int"), ((i % 11) + 2).cast("int"), ((i % 3) + 1).cast("int")
    gaps = lambda n: F.repeat(F.lit("-"), n)
    read = F.when(i % 5 == 0, F.concat(F.substr("seq", F.lit(1), d), gaps(k), F.substr("seq", d + k + 1, F.lit(32)))).otherwise(F.col("seq"))
    e = e.withColumn("_read", read).withColumn("_tagged", F.concat(F.lit("00000000111111"), F.substr("molecule", F.lit(15), F.lit(32))))
    insert = lambda c, what: F.when(i % 7 == 0, F.concat(F.substr(c, F.lit(1), at), what, F.substr(c, at + 1, F.lit(32)))).otherwise(F.col(c))
    return e.select(
        i.alias("read_id"), F.col("event_type").alias("ref_name"), "molecule", "seq", insert("molecule", gaps(j)).alias("ref_aln"),
        insert("_read", F.substr(F.lit("ACGTA"), F.lit(1), j)).alias("read_aln"), insert("_tagged", gaps(j)).alias("tagged"),
        F.substr("seq", F.lit(1), F.lit(8)).alias("cell_tag"), F.substr("seq", F.lit(9), F.lit(6)).alias("umi"),
        F.when(i % 13 == 0, 4).when(i % 17 == 0, 256).otherwise(0).alias("flag"),
    )


#: The same as a common table expression for DuckDB, to stand behind WITH.
READS = f"""
    e0 AS (SELECT event_id AS i, event_type, {sql_dna("user_id || ':' || event_type")} AS molecule FROM events),
    e1 AS (SELECT *, CASE WHEN i % 10 = 0 THEN substr(molecule, 1, CAST(i % 32 AS INT)) || CASE WHEN i % 20 = 0 THEN 'N' ELSE translate(substr(molecule, CAST(i % 32 AS INT) + 1, 1), 'ACGT', 'CGTA') END || substr(molecule, CAST(i % 32 AS INT) + 2, 32)
                          ELSE molecule END AS seq FROM e0),
    e2 AS (SELECT *, CAST(i % 10 + 15 AS INT) AS d, CAST(i % 4 + 1 AS INT) AS k, CAST(i % 11 + 2 AS INT) AS p, CAST(i % 3 + 1 AS INT) AS j, '00000000111111' || substr(molecule, 15, 32) AS t FROM e1),
    e3 AS (SELECT *, CASE WHEN i % 5 = 0 THEN substr(seq, 1, d) || repeat('-', k) || substr(seq, d + k + 1, 32) ELSE seq END AS r FROM e2),
    reads AS (SELECT i AS read_id, event_type AS ref_name, molecule, seq,
                     CASE WHEN i % 7 = 0 THEN substr(molecule, 1, p) || repeat('-', j) || substr(molecule, p + 1, 32) ELSE molecule END AS ref_aln,
                     CASE WHEN i % 7 = 0 THEN substr(r, 1, p) || substr('ACGTA', 1, j) || substr(r, p + 1, 32) ELSE r END AS read_aln,
                     CASE WHEN i % 7 = 0 THEN substr(t, 1, p) || repeat('-', j) || substr(t, p + 1, 32) ELSE t END AS tagged,
                     substr(seq, 1, 8) AS cell_tag, substr(seq, 9, 6) AS umi, CASE WHEN i % 13 = 0 THEN 4 WHEN i % 17 = 0 THEN 256 ELSE 0 END AS flag FROM e3)"""
