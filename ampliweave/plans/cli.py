"""Command line: align and collapse (PIPE3)."""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import layout as L
from ..operators import correct, merge
from ..sources import alignments, sequences
from .align import align_reads, with_read_qualities, with_record_tags
from .collapse import collapse, usable, with_tags


def levels_of(spark: SparkSession, reference: L.Reference, folder: str) -> list[correct.Level]:
    """Correction levels of a reference's tags, whitelists read from their files."""
    lists = {t.name: sequences.read_whitelist(spark, t.file if ":" in t.file or t.file.startswith("/") else f"{folder}/{t.file}", t.reverse_complement) for t in reference.tags if t.file and t.sort_type == "KnownTag"}
    return [correct.Level(f"tag{t.order}", t.length, t.max_distance, lists.get(t.name), t.metric, t.ratio, t.max_gaps) for t in reference.tags]


def run_align(spark: SparkSession, layout: L.Layout, read1: str, read2: str | None, out: str, sam: str | None = None, index1: str | None = None, index2: str | None = None) -> None:
    """FASTQ to a parquet table of alignments with their qualities and record tags, and with sam to SAM files of them too."""
    others = {name: sequences.read_fastq(spark, path) for name, path in (("read2", read2), ("index1", index1), ("index2", index2)) if path}
    mates = sequences.zip_mates(sequences.read_fastq(spark, read1), **others)
    reads = merge.merged(mates, layout.merge, bool(read2), layout.reads).select(F.col("id1").alias("read_id"), "seq", "qual")
    refs = spark.createDataFrame([(r.name, r.sequence) for r in layout.references], "name string, sequence string")
    done = with_read_qualities(align_reads(reads, refs, known_strand=layout.known_strand, aligner=layout.aligner), reads)
    with_record_tags(done, {r.name: [t.symbol for t in r.tags] for r in layout.references}).withColumn("flag", F.lit(0)).write.parquet(out)
    if sam:
        written = spark.read.parquet(out).withColumn("quals", F.col("qual")).withColumnRenamed("tags", "__tags")
        alignments.write_sam(alignments.records(written, {}, "read_id", "__tags"), [(r.name, len(r.sequence)) for r in layout.references], sam, "align")


def run_collapse(spark: SparkSession, layout: L.Layout, aligned: str, out: str, folder: str, mode: str = "collapse") -> None:
    """Alignments to SAM files of consensus reads, or of corrected reads, a folder for each set of references with the same tags, named by the first of them.

    References of one set go through one plan (SET4); the alignments are partly read again only for another set.
    """
    rows = usable(spark.read.parquet(aligned))
    sizes = [(r.name, len(r.sequence)) for r in layout.references]
    sets: dict[tuple[L.Tag, ...], list[str]] = {}
    for r in layout.references:
        sets.setdefault(r.tags, []).append(r.name)
    for r in (next(r for r in layout.references if r.name == names[0]) for names in sets.values()):
        own = with_tags(rows.where(F.col("ref_name").isin(sets[r.tags])), {f"tag{t.order}": t.symbol for t in r.tags})
        qual = F.col("qual") if "qual" in rows.columns else None
        done = collapse(own, levels_of(spark, r, folder), mode, quality=qual)
        if mode == "correct" and qual is not None:
            done = done.withColumn("quals", qual)
        done = done.withColumn("name", F.concat_ws("_", "ref_name", *[f"tag{t.order}_corr" for t in r.tags]) if mode == "collapse" else F.col("read_id"))
        tags = {f"e{t.symbol}": f"tag{t.order}_corr" for t in r.tags} | ({"rc": "rc", "dc": "dc", "ar": "ar", "rm": "rm"} if mode == "collapse" else {f"o{t.symbol}": f"tag{t.order}" for t in r.tags})
        alignments.write_sam(alignments.records(done, tags, "name"), sizes, f"{out}/{r.name}", f"mode {mode}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ampliweave")
    jobs = parser.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("align")
    a.add_argument("--layout", required=True)
    a.add_argument("--read1", required=True)
    a.add_argument("--read2")
    a.add_argument("--index1")
    a.add_argument("--index2")
    a.add_argument("--aligner", choices=("wfa", "degenerate", "inversion"), type=str.lower, help="instead of the layout's")
    a.add_argument("--out", required=True)
    a.add_argument("--sam")
    c = jobs.add_parser("collapse")
    c.add_argument("--layout", required=True)
    c.add_argument("--aligned", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--mode", choices=("collapse", "correct"), default="collapse")
    o = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ampliweave").getOrCreate()
    spec = L.load(Path(o.layout).read_text())
    if o.job == "align":
        spec = replace(spec, aligner=o.aligner) if o.aligner else spec
        run_align(spark, spec, o.read1, o.read2, o.out, o.sam, o.index1, o.index2)
    else:
        run_collapse(spark, spec, o.aligned, o.out, str(Path(o.layout).resolve().parent), o.mode)


if __name__ == "__main__":
    main()
