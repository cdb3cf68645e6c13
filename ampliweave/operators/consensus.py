"""Pileups and consensus reads (AGG3 to AGG7, CON1 to CON7).

Columns of a pileup are keyed by (position in the reference, place in an insertion), so the result doesn't depend on the order of reads. Reads are dealt by their group
before they become columns, so only reads are shuffled; groups of over HOT reads, of which there are few, are summed by partial aggregation where the reads are, so a
group may have any size. Only the few hundred columns of a consensus meet in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import cigar as C
from ..functions import quality as Q
from ..tables import parts_of

BASES = ("A", "C", "G", "T")
#: Reads of a group that are summed in one task; larger groups are summed where their reads are.
HOT = 20_000


def places_of(aligned: Column) -> Column:
    """For each column of an aligned sequence (pos, ins): the characters other than gaps up to it, and the gaps since the last of them. Linear in its length."""
    groups = F.regexp_extract_all(F.concat(F.lit("^"), aligned), F.lit("[^-]-*"), F.lit(0))
    each = lambda g, k: F.transform(F.sequence(F.lit(0), F.length(g) - 1), lambda j: F.struct(k.alias("pos"), j.alias("ins")))
    return F.slice(F.flatten(F.transform(groups, each)), F.lit(2), F.length(aligned))


def columns_of(ref_aln: Column, read_aln: Column, quality: Column | None = None) -> Column:
    """Array of (at: pos and ins, ref, base and, with an array of qualities of the read's bases, q): pos counts reference bases, ins the inserted ones since."""
    parts = [places_of(ref_aln).alias("at"), F.split(ref_aln, "").alias("ref"), F.split(read_aln, "").alias("base")]
    if quality is not None:
        parts.append(F.transform(places_of(read_aln), lambda p: F.when(p["ins"] == 0, F.get(quality, p["pos"] - 1))).alias("q"))
    return F.arrays_zip(*parts)


def by_group(reads: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(reads of groups of HOT or fewer, dealt by group; the others where they are), both with __n, the reads of their group. Nulls are a key like any other."""
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    hot = F.broadcast(reads.groupBy(*k).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    some = reads.join(hot, same, "left_anti").repartition(parts_of(reads), *keys)
    some = some.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return some, reads.join(hot, same).drop(*(f"__k{i}" for i in range(len(keys))))


def pileup(reads: DataFrame, keys: Sequence[str], quality: Column | None = None) -> DataFrame:
    """keys, pos, ins, ref, n_a, n_c, n_g, n_t, n_n, n_gap (AGG6) and, with a quality, the log2 sums of the alleles.

    quality: a number for all bases of a read, or an array with one for each of its bases.
    """
    own = reads.select(*keys, "ref_aln", "read_aln", *([quality.alias("__quality")] if quality is not None else []))
    some, hot = (_columns(part, keys, F.col("__quality") if quality is not None else None) for part in by_group(own, keys))
    return some.unionByName(hot).drop("__n")


def _columns(reads: DataFrame, keys: Sequence[str], quality: Column | None) -> DataFrame:
    """pileup() with __n of reads with __n."""
    keys = [*keys, "__n"]
    each = quality is not None and isinstance(reads.select(quality).schema[0].dataType, ArrayType)
    own = [quality.alias("__q")] if quality is not None and not each else []
    rows = reads.where(F.length("ref_aln") > 0).select(*keys, *own, F.explode(columns_of(F.col("ref_aln"), F.col("read_aln"), quality if each else None)).alias("x"))
    base = F.col("x.base")
    counts = [F.count_if(base == b).alias(f"n_{n}") for b, n in zip((*BASES, "N", "-"), ("a", "c", "g", "t", "n", "gap"))]
    logs = []
    if quality is not None:
        error = Q.phred_to_error(F.col("x.q" if each else "__q"))
        known = base.isin(*Q.ALLELES) & error.isNotNull()
        logs = [F.sum(F.when(known, F.when(base == a, F.log2(1 - error)).otherwise(F.log2(error / 3))).otherwise(0.0)).alias(f"log_{a.lower()}") for a in Q.ALLELES]
    return rows.groupBy(*keys, F.col("x.at.pos").alias("pos"), F.col("x.at.ins").alias("ins")).agg(F.min("x.ref").alias("ref"), *counts, *logs)


def placeable(ref_aln: Column, read_aln: Column, reference: Column | None = None) -> Column:
    """Whether a read can join a pileup (CON6): as many columns as its reference, none of them of two gaps, and, where it is given, the group's reference without its gaps."""
    pairs = F.arrays_zip(F.split(ref_aln, "").alias("r"), F.split(read_aln, "").alias("q"))
    ok = (F.length(ref_aln) > 0) & (F.length(ref_aln) == F.length(read_aln)) & ~F.exists(pairs, lambda x: (x["r"] == "-") & (x["q"] == "-"))
    if reference is not None:
        ok = ok & (F.replace(ref_aln, F.lit("-"), F.lit("")) == reference)
    return F.coalesce(ok, F.lit(False))


def quarantined(reads: DataFrame, keys: Sequence[str], reference: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads that can join the pileup of their group; keys, n and held: the reads of each group and how many of them cannot) (CON6). No read ends the job."""
    ok = placeable(F.col("ref_aln"), F.col("read_aln"), reference)
    return reads.where(ok), reads.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~ok).alias("held"))


def base_share(column: str) -> Column:
    """Share of a base among all six counts (AGG7)."""
    return F.try_divide(F.col(column), sum((F.col(f"n_{x}") for x in ("c", "g", "t", "n", "gap")), F.col("n_a")))


def _most() -> Column:
    """(count, base) of the most frequent of A, C, G, T; of equals the last."""
    return F.greatest(*[F.struct(F.col(f"n_{b.lower()}").alias("n"), F.lit(b).alias("base")) for b in BASES])


def call(piles: DataFrame, keys: Sequence[str], sizes: DataFrame | None, gap_share: float = 0.75, insertion_share: float = 0.75) -> DataFrame:
    """keys, pos, ins, ref, base: one row a column of the consensus (CON2, CON4). sizes: keys and n, the reads of each group; without
    them piles have n.

    A reference column is a gap where gaps reach gap_share; a column of nothing but N is N. An insertion stays where its most frequent base is in
    insertion_share of all reads.
    """
    df = (piles if sizes is None else piles.join(sizes, list(keys))).withColumn("top", _most())
    called = F.when(F.col("top.n") > 0, F.col("top.base")).when(F.col("n_n") > 0, "N").otherwise("-")
    base = F.when(F.col("ins") > 0, F.col("top.base")).otherwise(F.when(F.col("n_gap") >= gap_share * F.col("n"), "-").otherwise(called))
    return df.withColumn("base", base).where((F.col("ins") == 0) | (F.col("top.n") >= insertion_share * F.col("n")))


def consensus(reads: DataFrame, keys: Sequence[str], quality: Column | None = None, gap_share: float = 0.75, insertion_share: float = 0.75, prior: float = 0.75) -> DataFrame:
    """keys, n, ref_aln, read_aln, cigar and, with a quality, quals (one for each base of the read): one row a group (CON1 to CON5).

    Reads of a group are aligned to one reference. A single read comes out as it went in (CON7): its own bases win every vote but an insertion's, which it has in full.
    """
    known = reads.select(*keys, "ref_aln", "read_aln", *([quality.alias("__quality")] if quality is not None else [])).dropna(subset=list(keys))
    out = [_consensus(part, keys, F.col("__quality") if quality is not None else None, gap_share, insertion_share, prior) for part in by_group(known, keys)]
    return out[0].unionByName(out[1])


def called(reads: DataFrame, keys: Sequence[str], gap_share: float = 0.75, insertion_share: float = 0.75) -> DataFrame:
    """call() of the pileup of reads, with the sizes of their groups (CON2, CON4)."""
    known = reads.select(*keys, "ref_aln", "read_aln").dropna(subset=list(keys))
    out = [call(_columns(part, keys, None).withColumnRenamed("__n", "n"), keys, None, gap_share, insertion_share) for part in by_group(known, keys)]
    return out[0].unionByName(out[1])


def _consensus(reads: DataFrame, keys: Sequence[str], quality: Column | None, gap_share: float, insertion_share: float, prior: float) -> DataFrame:
    df = call(_columns(reads, keys, quality).withColumnRenamed("__n", "n"), keys, None, gap_share, insertion_share)
    item = [F.col("pos"), F.col("ins"), F.when(F.col("ins") > 0, "-").otherwise(F.col("ref")).alias("ref"), F.col("base")]
    if quality is not None:
        start = lambda a: F.log2(F.when(F.col("ref") == a, F.lit(prior)).otherwise(F.lit((1 - prior) / 4)))
        shares = Q.normalised([F.col(f"log_{a.lower()}") + start(a) for a in Q.ALLELES])
        own = F.coalesce(*[F.when(F.col("base") == a, p) for a, p in zip(Q.ALLELES, shares)])
        item.append(Q.certainty_to_phred(own).alias("q"))
    rows = df.groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(*item))).alias("x"))
    text = lambda f: F.array_join(F.transform("x", lambda c: c[f]), "")
    out = rows.select(*keys, "n", text("ref").alias("ref_aln"), text("base").alias("read_aln"), *([F.transform(F.filter("x", lambda c: c["base"] != "-"), lambda c: c["q"]).alias("quals")] if quality is not None else []))
    return out.withColumn("cigar", C.render(C.of_pair(F.col("ref_aln"), F.col("read_aln"))))


def collapse(reads: DataFrame, keys: Sequence[str], name: str = "read_name", quality: Column | None = None, most_names: int | None = None) -> DataFrame:
    """Consensus reads with rc (reads), dc (reads, 40 at most), ar (their names in order, joined by commas; with most_names only so many) and rm (AGG3)."""
    names = F.array_sort(F.collect_list(F.col(name).cast("string")))
    info = reads.groupBy(*keys).agg((F.slice(names, 1, most_names) if most_names else names).alias("__names"))
    out = consensus(reads, keys, quality).join(info, list(keys))
    return out.select(
        *keys, F.col("n").alias("rc"), F.least("n", F.lit(40)).cast("int").alias("dc"), F.array_join("__names", ",").alias("ar"),
        C.match_rate(F.col("ref_aln"), F.col("read_aln")).alias("rm"), "ref_aln", "read_aln", "cigar", *(["quals"] if quality is not None else []),
    )


def majority(reads: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value in each group, of equals the least (AGG5, TOP1)."""
    n = reads.groupBy(*keys, column).agg(F.count("*").alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("n"))
    return n.join(top, [*keys, "n"]).groupBy(*keys).agg(F.min(column).alias(column), F.first("n").alias("n"))


def modal_bases(reads: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The sequence of each place's most frequent character in a group; N and - lose ties, then the greatest character wins (AGG14)."""
    some, hot = (_modal(part, keys, seq) for part in by_group(reads.select(*keys, seq), keys))
    return some.unionByName(hot)


def _modal(reads: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    rows = reads.select(*keys, F.posexplode(F.split(seq, "")).alias("pos", "base")).groupBy(*keys, "pos", "base").agg(F.count("*").alias("n"))
    best = rows.groupBy(*keys, "pos").agg(F.max(F.struct("n", (~F.col("base").isin("N", "-")).alias("real"), "base")).alias("b"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("b.base").alias("base")))).alias("x")).select(*keys, F.array_join(F.transform("x", lambda c: c["base"]), "").alias("seq"))
