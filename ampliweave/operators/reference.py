"""Choice of a reference by k-mers (SEQ11, AGG9, AGG10, JON6, the vote of ALN14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

KMER, STEP, SHARE = 8, 4, 0.9
#: Bytes up to which k-mers of references are broadcast; beyond, the vote is a shuffle join.
BROADCAST_BYTES = 32 << 20


def unique_kmers(references: DataFrame, k: int = KMER) -> DataFrame:
    """(kmer, ref_name) of k-mers that occur once over all references (name, sequence) (AGG9)."""
    rows = references.select(F.col("name").alias("ref_name"), F.explode(S.kmers(F.col("sequence"), k)).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("ref_name").alias("ref_name")).where("n = 1").select("kmer", "ref_name")


def without_unique(references: DataFrame, k: int = KMER) -> DataFrame:
    """References that have no k-mer of their own (AGG9)."""
    return references.join(unique_kmers(references, k), references.name == F.col("ref_name"), "left_anti")


def votes(reads: DataFrame, ref_kmers: DataFrame, k: int = KMER, step: int = STEP, key: str = "read_id", seq: str = "seq") -> DataFrame:
    """(key, ref_name, n): how many of a read's k-mers are unique to a reference (JON6). The k-mers are broadcast where their number allows it."""
    rows = reads.select(key, F.explode(S.kmers(F.col(seq), k, step)).alias("kmer"))
    small = ref_kmers.limit(BROADCAST_BYTES // 64 + 1).count() <= BROADCAST_BYTES // 64
    return rows.join(F.broadcast(ref_kmers) if small else ref_kmers, "kmer").groupBy(key, "ref_name").agg(F.count("*").alias("n"))


def voted(counted: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, refs): the references with a vote, in order (AGG10)."""
    return counted.groupBy(key).agg(F.array_sort(F.collect_set("ref_name")).alias("refs"))


def choose(counted: DataFrame, share: float = SHARE, key: str = "read_id") -> DataFrame:
    """(key, ref_name, refs): ref_name where the winner has more than that share of the votes, else null and the candidates to align to in refs (ALN14)."""
    top = counted.groupBy(key).agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.array_sort(F.collect_list("ref_name")).alias("refs"), F.max_by("ref_name", "n").alias("best"))
    return top.select(key, F.when(F.col("top") > share * F.col("total"), F.col("best")).alias("ref_name"), "refs")
