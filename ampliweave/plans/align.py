"""The align job: reads to alignments with their reference (PIPE1)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S
from ..functions import tags as T
from ..operators import align as A
from ..operators import filters, reference


def align_reads(reads: DataFrame, references: DataFrame, scoring: A.Scoring | None = None, known_strand: bool = True, multiplier: float = 2.0, least: int = 0, key: str = "read_id", exhaustive: bool = False, aligner: str | None = None) -> DataFrame:
    """key, ref_name, reference, seq, ref_aln, read_aln, score, cigar for reads (key, seq) and references (name, sequence) (ALN13).

    One reference: all reads go to it. Several: a read goes to the reference that wins its k-mer votes; without a clear winner, to the best alignment among those with a
    vote; without any vote (or with exhaustive), among all. Reads of an unknown strand are turned first, by seeds for one reference and by votes for several.
    aligner: see operators.align.aligner(). Reads outside of the length bounds are left out. The list of names is on the driver: references are as many as amplicons.
    """
    sizes = references.agg(F.count("*"), F.max(F.length("sequence"))).first()
    if not sizes[0]:
        raise ValueError("no references")
    reads = reads.where(filters.fitting_length(F.length("seq"), sizes[1], multiplier, least)).select(key, "seq")
    if sizes[0] == 1:
        name, sequence = references.select("name", "sequence").first()
        one = reads.withColumn("ref_name", F.lit(name)).withColumn("reference", F.lit(sequence))
        if not known_strand:
            one = A.oriented(one).withColumn("seq", F.when(F.col("forward"), F.col("seq")).otherwise(S.reverse_complement(F.col("seq")))).drop("forward")
        using, scoring = A.aligner(aligner, scoring or A.SIMPLE)
        return using(one, scoring)
    kmers = reference.unique_kmers(references)
    if not known_strand:
        total = lambda df, n: reference.votes(df, kmers, key=key).groupBy(key).agg(F.sum("n").alias(n))
        turned = reads.withColumn("seq", S.reverse_complement(F.col("seq")))
        sums = reads.join(total(reads, "__f"), key, "left").join(total(turned, "__r"), key, "left")
        forward = F.coalesce("__f", F.lit(0)) > F.coalesce("__r", F.lit(0))
        reads = sums.select(key, F.when(forward, F.col("seq")).otherwise(S.reverse_complement(F.col("seq"))).alias("seq"))
    names = F.array(*[F.lit(r[0]) for r in references.select("name").distinct().orderBy("name").collect()])
    some = reads if exhaustive else reads.join(reference.choose(reference.votes(reads, kmers, key=key), key=key), key, "left")
    candidates = names if exhaustive else F.when(F.col("ref_name").isNotNull(), F.array("ref_name")).otherwise(F.coalesce("refs", names))
    using, scoring = A.aligner(aligner, scoring or A.ALIGN)
    return A.align_to_best(some.select(key, "seq", candidates.alias("candidates")), references, "candidates", scoring, key, using=using)


def with_read_qualities(aligned: DataFrame, reads: DataFrame, key: str = "read_id") -> DataFrame:
    """aligned with qual, the qualities of reads (key, seq, qual) in the order of the aligned bases: turned round where the read was; null where a stretch of it is inverted."""
    own = reads.select(key, F.col("seq").alias("__seq"), F.col("qual").alias("__qual"))
    joined = aligned.join(own, key)
    return joined.withColumn("qual", F.when(F.contains("cigar", F.lit("<")), None).when(F.upper("seq") == F.upper("__seq"), F.col("__qual")).otherwise(F.reverse("__qual"))).drop("__seq", "__qual")


def with_record_tags(aligned: DataFrame, symbols: Mapping[str, Sequence[str]], key: str = "read_id") -> DataFrame:
    """aligned with tags, a map of e<symbol> (what the read has at each tag of its reference), rc (1), ar (its name), rm (match rate) and as (score) (TAG5).

    symbols: the tags' symbols for each reference's name.
    """
    fixed = [F.lit("rc"), F.lit("1"), F.lit("ar"), F.col(key).cast("string"), F.lit("rm"), C.match_rate(F.col("ref_aln"), F.col("read_aln")).cast("string"), F.lit("as"), F.col("score").cast("string")]
    tags = F.create_map(*fixed)
    for name, own in symbols.items():
        more = [x for s in own for x in (F.lit(f"e{s}"), T.extract(F.col("ref_aln"), F.col("read_aln"), s))]
        tags = F.when(F.col("ref_name") == name, F.create_map(*more, *fixed)).otherwise(tags)
    return aligned.withColumn("tags", F.map_filter(tags, lambda k, v: v.isNotNull()))
