"""Merging of read pairs (MRG*). Qualities are arrays of raw Phred numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import sequence as S
from .align import MERGE, Scoring, align

SPACER_QUALITY = 39
#: Ends of the column names of each kind of read.
_PARTS = {"Read1": "1", "Read2": "2", "Index1": "_index1", "Index2": "_index2"}


def concatenated(parts: Sequence[tuple]) -> tuple[Column, Column]:
    """(sequence, qualities) of parts in order (MRG1): ("read", seq, qual, orientation) or ("spacer", text). Reversed bases have reversed qualities."""
    seqs, quals = [], []
    for p in parts:
        if p[0] == "spacer":
            seqs.append(F.lit(p[1]))
            quals.append(F.array_repeat(F.lit(SPACER_QUALITY), len(p[1])))
        else:
            _, seq, qual, how = p
            seqs.append(S.orient(seq, how))
            quals.append(qual if how == "forward" else F.reverse(qual))
    return F.concat(*seqs), F.concat(*quals)


def pair_consensus(a: Column, qa: Column, b: Column, qb: Column) -> Column:
    """(seq, qual) of two gapped reads (MRG3): equal bases support each other, a base beats a gap, of different ones the better quality wins and the first of equal ones.

    Columns of two gaps are left out.
    """
    agree = lambda x, y: Q.combine_ascii(x + 33, y + 33, True) - 33
    differ = lambda x, y: F.greatest(F.lit(0), F.abs(x - y))

    def step(s: Column, x: Column) -> Column:
        p, q = x["a"], x["b"]
        i, j = F.get(qa, s["i"]), F.get(qb, s["j"])
        base = F.when(p == "-", q).when(q == "-", p).when(p == q, p).when(i >= j, p).otherwise(q)
        qual = F.when(p == "-", j).when(q == "-", i).when(p == q, agree(i, j)).otherwise(differ(i, j)).cast("int")
        none = (p == "-") & (q == "-")
        return F.struct(
            (s["i"] + (p != "-").cast("int")).alias("i"), (s["j"] + (q != "-").cast("int")).alias("j"),
            F.when(none, s["seq"]).otherwise(F.concat(s["seq"], base)).alias("seq"), F.when(none, s["qual"]).otherwise(F.concat(s["qual"], F.array(qual))).alias("qual"),
        )

    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("").alias("seq"), F.array().cast("array<int>").alias("qual"))
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return F.aggregate(pairs, begin, step, lambda s: F.struct(s["seq"].alias("seq"), s["qual"].alias("qual")))


def overlapped(df: DataFrame, scoring: Scoring = MERGE) -> DataFrame:
    """df (seq1, qual1, seq2, qual2) with seq and qual: read 1 aligned with read 2's reverse complement, and their consensus (MRG2)."""
    turned = df.withColumn("__s", S.reverse_complement(F.col("seq2"))).withColumn("__q", F.reverse("qual2"))
    done = align(turned, scoring, "seq1", "__s")
    done = done.withColumn("__m", pair_consensus(F.col("ref_aln"), F.col("qual1"), F.col("read_aln"), F.col("__q")))
    return done.select(*df.columns, F.col("__m.seq").alias("seq"), F.col("__m.qual").alias("qual"))


def merged(df: DataFrame, strategy: str | None, has_second: bool, reads: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """df with seq and qual by the layout's strategy and its reads, (Read1, Read2, Index1 or Index2: orientation) and (Spacer: sequence) (MRG4).

    align: reads 1 and 2 by their overlap. concatenate: the layout's parts in its order (without any: read 1, and read 2 turned and complemented);
    concatenate_both_forward: the same, no part turned. Without a second read and an index: read 1 alone, in its orientation. The columns of df tell which
    indices there are; ValueError where the layout and the strategy don't fit the reads. A row that lacks a part has null.
    """
    here = {kind for kind, c in _PARTS.items() if f"seq{c}" in df.columns and (has_second or kind != "Read2")}
    how = dict(r for r in reads if r[0] != "Spacer")
    if here == {"Read1"}:
        parts = [("Read1", how.get("Read1", "forward"))]
    elif strategy == "align":
        if here != {"Read1", "Read2"}:
            raise ValueError(f"only reads 1 and 2 can be merged by their overlap, not {sorted(here)}")
        return overlapped(df)
    elif strategy in ("concatenate", "concatenate_both_forward"):
        parts = list(reads) or [("Read1", "forward"), ("Read2", "reverse_complement")]
        if {kind for kind, _ in parts} - {"Spacer"} != here:
            raise ValueError(f"the layout's reads {parts} aren't those given, {sorted(here)}")
    else:
        raise ValueError(f"reads {sorted(here)} need a merge strategy, not {strategy!r}")
    turn = lambda o: "forward" if strategy == "concatenate_both_forward" else o
    columns = [("spacer", o) if kind == "Spacer" else ("read", F.col(f"seq{_PARTS[kind]}"), F.col(f"qual{_PARTS[kind]}"), turn(o)) for kind, o in parts]
    seq, qual = concatenated(columns)
    return df.withColumn("seq", seq).withColumn("qual", qual)
