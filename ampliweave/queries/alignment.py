"""Queries of alignment, merging, whole jobs and streams. SQL can't align, so most have none; tests hold them against vectors and a plain version."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from ..functions import cigar as C
from ..functions import sequence as S
from ..operators import align as A
from ..operators import correct, merge
from ..plans import align as align_job
from ..plans import collapse as collapse_job
from ..streaming import first_of_molecule, tag_counts
from ..synth import READS, dna, reads
from ..tables import table
from .relational import _references

QUERIES: dict = {}
SQL: dict[str, str] = {}
_c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pairs(spark, sf_dir):
    r = reads(spark, sf_dir)
    return r.select("read_id", _c("molecule").alias("reference"), S.strip_gaps(_c("read_aln")).alias("seq"))


def _clean(df):
    return df.select("read_id", "ref_aln", "read_aln", "score", "cigar")


@query()
def aln1_simple(spark, sf_dir):
    return _clean(A.align(_pairs(spark, sf_dir), A.SIMPLE))


@query()
def aln2_affine(spark, sf_dir):
    return _clean(A.align(_pairs(spark, sf_dir), A.ALIGN))


@query(f"WITH {READS} SELECT read_id, molecule AS reference, replace(read_aln, '-', '') AS seq FROM reads")
def aln6_gapless(spark, sf_dir):
    """Alignments without their gaps are what went in."""
    return A.align(_pairs(spark, sf_dir)).select("read_id", S.strip_gaps(_c("ref_aln")).alias("reference"), S.strip_gaps(_c("read_aln")).alias("seq"))


@query()
def aln16_scorings(spark, sf_dir):
    df = _pairs(spark, sf_dir)
    out = [_clean(A.align(df, s)).withColumn("scoring", F.lit(n)) for n, s in A.PRESETS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query()
def aln4_local(spark, sf_dir):
    return A.local(_pairs(spark, sf_dir)).select("read_id", "ref_part", "read_part")


@query()
def aln8_next_best(spark, sf_dir):
    return A.local(_pairs(spark, sf_dir), place=1).select("read_id", "ref_part", "read_part")


@query()
def aln9_inversions(spark, sf_dir):
    df = _pairs(spark, sf_dir)
    turned = F.concat(F.substr("reference", F.lit(1), F.lit(8)), S.reverse_complement(F.substr("reference", F.lit(9), F.lit(16))), F.substr("reference", F.lit(25), F.lit(8)))
    return _clean(A.with_inversions(df.withColumn("seq", F.when(_c("read_id") % 2 == 0, turned).otherwise(_c("seq"))), least=12))


@query()
def aln10_anchored(spark, sf_dir):
    fields = [StructField("ref_aln", StringType()), StructField("read_aln", StringType())]
    return A._mapped(_pairs(spark, sf_dir), ["reference", "seq"], fields, lambda a, b: [A.align_anchored(x, y)[:2] for x, y in zip(a, b)]).select("read_id", "ref_aln", "read_aln")


@query()
def aln11_seeds(spark, sf_dir):
    fields = [StructField("seeds", StringType())]
    return A._mapped(_pairs(spark, sf_dir), ["reference", "seq"], fields, lambda a, b: [(" ".join("{}:{}:{}".format(*s) for s in A.seeds(x, y)),) for x, y in zip(a, b)]).select("read_id", "seeds")


@query("SELECT event_id AS read_id, event_id % 2 = 0 AS forward FROM events")
def aln12_orientation(spark, sf_dir):
    df = reads(spark, sf_dir).select("read_id", _c("molecule").alias("reference"), F.when(_c("read_id") % 2 == 0, _c("molecule")).otherwise(S.reverse_complement(_c("molecule"))).alias("seq"))
    return A.oriented(df).select("read_id", "forward")


@query("SELECT event_id AS read_id, n_name AS ref_name FROM events JOIN nation ON user_id % 25 = n_nationkey")
def aln15_exhaustive(spark, sf_dir):
    """Every read against every reference; reads are 30 bases of their own one, so it must win."""
    refs = table(spark, sf_dir, "nation").select(_c("n_name").alias("name"), dna(_c("n_name")).alias("sequence"), "n_nationkey")
    r = table(spark, sf_dir, "events").join(refs, _c("user_id") % 25 == _c("n_nationkey")).select(_c("event_id").alias("read_id"), F.substr("sequence", (_c("event_id") % 3 + 1).cast("int"), F.lit(30)).alias("seq"))
    return align_job.align_reads(r, refs.drop("n_nationkey"), exhaustive=True).select("read_id", "ref_name")


@query()
def aln13_pipe1_align(spark, sf_dir):
    refs, r = _references(spark, sf_dir)
    return align_job.align_reads(r, refs)


@query(f"WITH {READS} SELECT read_id, seq || 'ACGT' || reverse(translate(molecule, 'ACGT', 'TGCA')) AS seq, CAST(68 AS INT) AS n_qual FROM reads")
def mrg1_concatenate(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("q", F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: i + 5))
    seq, qual = merge.concatenated([("read", _c("seq"), _c("q"), "forward"), ("spacer", "ACGT"), ("read", _c("molecule"), _c("q"), "reverse_complement")])
    return df.select("read_id", seq.alias("seq"), F.size(qual).alias("n_qual"))


def _mates(spark, sf_dir):
    qual = lambda seq, k: F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: ((_c("read_id") * k + i) % 38 + 2).cast("int"))
    first, second = F.substr("seq", F.lit(1), F.lit(24)), S.reverse_complement(F.substr("molecule", F.lit(9), F.lit(24)))
    return reads(spark, sf_dir).select("read_id", first.alias("seq1"), qual(first, 3).alias("qual1"), second.alias("seq2"), qual(second, 5).alias("qual2"))


@query()
def mrg2_overlap_merge(spark, sf_dir):
    return merge.merged(_mates(spark, sf_dir), "align", True).select("read_id", "seq", "qual")


@query(f"""WITH {READS} SELECT read_id, array_to_string(list_transform(list_filter(list_zip(string_split(ref_aln, ''), string_split(read_aln, '')), lambda x: NOT (x[1] = '-' AND x[2] = '-')),
           lambda x: CASE WHEN x[1] = '-' THEN x[2] ELSE x[1] END), '') AS seq FROM reads""")
def mrg3_pair_consensus(spark, sf_dir):
    """Qualities are all equal here, so the first read wins where bases differ."""
    q = F.array_repeat(F.lit(30), 40)
    return reads(spark, sf_dir).select("read_id", merge.pair_consensus(_c("ref_aln"), q, _c("read_aln"), q)["seq"].alias("seq"))


@query()
def mrg4_strategies(spark, sf_dir):
    m = _mates(spark, sf_dir)
    out = [merge.merged(m, s, True).select("read_id", "seq", F.lit(s).alias("strategy")) for s in ("align", "concatenate", "concatenate_both_forward")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {READS} SELECT read_id, molecule AS reference, seq AS read FROM reads")
def cig9_clip_recovery(spark, sf_dir):
    """Reads clipped by four bases on either side, laid along the whole reference again."""
    fields = [StructField("ref_aln", StringType()), StructField("read_aln", StringType())]
    df = A._mapped(reads(spark, sf_dir).select("read_id", "molecule", "seq"), ["molecule", "seq"], fields, lambda a, b: A.recovered_clips(a, b, [[("S", 4), ("M", 24), ("S", 4)]] * len(a), [4] * len(a)))
    return df.select("read_id", S.strip_gaps(_c("ref_aln")).alias("reference"), S.strip_gaps(_c("read_aln")).alias("read"))


@query()
def pipe2_collapse(spark, sf_dir):
    """Aligned reads with two tags, corrected level by level and collapsed."""
    tagged = collapse_job.with_tags(reads(spark, sf_dir).withColumn("ref", _c("tagged")), {"cell": "0", "umi": "1"}, "tagged")
    listed = reads(spark, sf_dir).where("read_id % 10 <> 0").select(F.substr("molecule", F.lit(1), F.lit(8)).alias("seq")).distinct()
    good = collapse_job.usable(tagged, 25, 0.8)
    return collapse_job.collapse(good, [correct.Level("cell", 8, 1, listed), correct.Level("umi", 6, 1, ratio=2.0)])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str1_windowed_tags(spark, sf_dir):
    return tag_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query("SELECT count(DISTINCT (user_id, event_type)) AS molecules FROM events")
def str1_molecules(spark, sf_dir):
    return first_of_molecule(table(spark, sf_dir, "events"), "ts", ["user_id", "event_type"]).agg(F.count("*").alias("molecules"))


@query(f"WITH {READS} SELECT read_id, ref_name, CAST(1 AS INT) AS pos, replace(read_aln, '-', '') AS seq, cell_tag AS e0 FROM reads")
def snk2_records(spark, sf_dir):
    from ..sources.alignments import records

    r = records(reads(spark, sf_dir), {"e0": "cell_tag", "e1": "umi"}, "read_id")
    return r.select(_c("read_name").cast("long").alias("read_id"), "ref_name", "pos", "seq", _c("tags")["e0"].alias("e0"))


@query()
def cig3_of_alignments(spark, sf_dir):
    """Operations of the alignments that the align job makes."""
    return A.align(_pairs(spark, sf_dir)).select("read_id", C.render(C.simplify(C.parse(_c("cigar")))).alias("cigar"))
