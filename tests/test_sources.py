import gzip
import textwrap

import pytest
from pyspark.sql import functions as F

from ampliweave import layout as L
from ampliweave.operators import align as A
from ampliweave.sources import alignments, sequences, single_cell


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i} extra\n{'ACGT' * (i % 5)}\n+\n{'@I!5' * (i % 5)}\n" for i in range(900))
    for name, data in (("a.fastq", text.encode()), ("b.fastq.gz", gzip.compress(text.encode()))):
        (tmp_path / name).write_bytes(data)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = sequences.read_fastq(spark, f"file://{tmp_path}/{name}").orderBy("idx").collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.idx, r.id, r.seq) for r in got] == [(i, f"r{i}", "ACGT" * (i % 5)) for i in range(900)]
        assert got[1].qual == [31, 40, 0, 20] and got[5].qual == []
    (tmp_path / "m.fastq").write_text("@x1\nAC\n+\nII\n@x2\nGT\n+\nI\n@x3\nGG\n+\nII\n")
    first, second = (sequences.read_fastq(spark, f"file://{tmp_path}/{n}") for n in ("a.fastq", "m.fastq"))
    zipped = sequences.zip_mates(first, read2=second).orderBy("idx").collect()
    assert len(zipped) == 900 and zipped[0].seq2 == "AC" and zipped[1].seq2 is None and zipped[2].id2 == "x3" and zipped[3].id2 is None
    assert [r.id1 for r in sequences.zip_mates(second).collect()] == ["x1"]
    sequences.write_fastq(first.where("length(seq) > 0"), f"file://{tmp_path}/out")
    again = sequences.read_fastq(spark, f"file://{tmp_path}/out")
    assert again.count() == 720 and again.where("seq IS NULL").count() == 0


def test_fasta_and_lists(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one some text\nACGT\nacgn\n>two\nTT\n\nWW\n")
    got = {r.name: r.sequence for r in sequences.read_fasta(spark, f"file://{tmp_path}/r.fa").collect()}
    assert got == {"one": "ACGTacgn", "two": "TTWW"}
    (tmp_path / "w.txt").write_text("AACC\nAACC\n\nGGGT \n")
    read = lambda rc: sorted(r.seq for r in sequences.read_whitelist(spark, f"file://{tmp_path}/w.txt", rc).collect())
    assert read(False) == ["AACC", "GGGT"] and read(True) == ["ACCC", "GGTT"]
    (tmp_path / "b.tsv").write_text("ACGT-1\nTTTT-1\nAAAA\n")
    barcodes = single_cell.read_barcodes(spark, f"file://{tmp_path}/b.tsv")
    assert sorted(r.barcode for r in barcodes.collect()) == ["AAAA", "ACGT", "TTTT"]
    (tmp_path / "t.tsv").write_text("X\tACGT\nY\tTTTT\nZ\tTTTT\n")
    assert {r.source: r.target for r in single_cell.read_translation(spark, f"file://{tmp_path}/t.tsv").collect()} == {"ACGT": "X", "TTTT": "Z"}
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n9 5 4\n1 1 3\n2 1 4\n9 5 7\n3 2 1\n")
    assert {r.column: r.total for r in single_cell.read_coverage(spark, f"file://{tmp_path}/m.mtx").collect()} == {1: 7.0, 5: 7.0, 2: 1.0}
    assert tuple(single_cell.coverage_of(barcodes, spark.createDataFrame([("ACGT",)], "barcode string")).first()) == (3, 1)
    report = sequences.simulated_read_report(spark.createDataFrame([("r1 length=120 error=0.05 read_identity=95.5",), ("x chimera length=9",)], "head string")).collect()
    assert tuple(report[0])[1:] == (120, 0.05, 95.5, False) and report[1].chimera and report[1].error is None


def test_sam_and_bam(spark, tmp_path):
    rows = [(f"n{i}", ["a", "b"][i % 2], "ACG-TACGT", "ACGGTA-GT", [30 + i % 5] * 8, i, f"T{i}", i / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "read_name string, ref_name string, ref_aln string, read_aln string, quals array<int>, ref_start int, cell string, rm double")
    rec = alignments.records(df, {"e0": "cell", "rm": "rm", "rc": "ref_start"}).repartition(3)
    want = sorted(map(str, rec.select("read_name", "flag", "ref_name", "pos", "cigar", "seq", "qual", F.array_sort(F.map_entries("tags")).alias("t")).collect()))
    refs = [("b", 500), ("a", 400)]
    alignments.write_sam(rec, refs, f"file://{tmp_path}/sam", "made here")
    assert len(alignments.write_bam(rec, refs, f"file://{tmp_path}/bam", "made here")) == 3
    for back in (alignments.read_sam(spark, f"file://{tmp_path}/sam"), alignments.read_bam(spark, f"file://{tmp_path}/bam")):
        assert sorted(map(str, back.select("read_name", "flag", "ref_name", "pos", "cigar", "seq", "qual", F.array_sort(F.map_entries("tags")).alias("t")).collect())) == want
        assert alignments.lineage_reads(back, ["GGTA"], 50.0, 10).count() == 100
        assert alignments.cells_of(back, ["e0"]).count() == 300
    assert alignments.read_bam(spark, f"file://{tmp_path}/bam", "b").count() == 150
    bad = next((tmp_path / "bam").glob("*.bam"))
    data = bytearray(bad.read_bytes())
    data[40] ^= 255
    with pytest.raises(Exception):
        list(alignments.parse_bam(bytes(data)))


LAYOUT = textwrap.dedent("""
    merge: Align
    known_strand: true
    reads:
      - !Read1 {orientation: Forward}
      - !Spacer {spacer_sequence: ACGT}
      - !Read2 {orientation: ReverseComplement}
    references:
      amplicon:
        sequence: ACGT00000000TTGCA111111GGCATTTTACGGACTGATCAGG
        targets: [GGCATTTTACGG]
        target_types: [Cas9WT]
        umi_configurations:
          umi: {symbol: '1', sort_type: DegenerateTag, length: 6, order: 1, max_distance: 1}
          cell: {symbol: '0', file: cells.txt, sort_type: KnownTag, length: 8, order: 0, max_distance: 1, levenshtein_distance: false}
""")


def test_layout():
    one = L.load(LAYOUT)
    r = one.references[0]
    assert [t.name for t in r.tags] == ["cell", "umi"] and r.tags[0].metric == "hamming" and r.tags[1].metric == "levenshtein" and r.target_places() == [23]
    assert one.merge == "align" and one.reads == (("Read1", "forward"), ("Spacer", "ACGT"), ("Read2", "reverse_complement"))
    for old, new in (("order: 1", "order: 2"), ("symbol: '1'", "symbol: '7'"), ("[Cas9WT]", "[]"), ("[GGCATTTTACGG]", "[AAAAAAAAAA]"), ("merge: Align", "merge: Odd"), ("DegenerateTag", "OddTag")):
        with pytest.raises(ValueError):
            L.load(LAYOUT.replace(old, new))


def test_command_line(spark, tmp_path):
    import random

    from ampliweave.plans import cli

    rng = random.Random(6)
    text = LAYOUT.replace("merge: Align\n", "").replace("GATCAGG", "GATCAGG" + "".join(rng.choices("ACGT", k=40)))
    (tmp_path / "layout.yaml").write_text(text)
    cells = ["".join(rng.choices("ACGT", k=8)) for _ in range(5)]
    (tmp_path / "cells.txt").write_text("\n".join(cells))
    ref = L.load(text).references[0].sequence
    lines, n = [], 0
    for c in cells:
        for umi in ("ACGTAC", "TTGGCC"):
            for k in range(6):
                tag = ("A" if c[0] != "A" else "C") + c[1:] if k == 5 else c
                qual = "".join(chr(33 + 20 + (n + i) % 20) for i in range(len(ref)))
                lines.append(f"@r{n}\n{ref.replace('0' * 8, tag).replace('1' * 6, umi)}\n+\n{qual}\n")
                n += 1
    (tmp_path / "r.fastq").write_text("".join([*lines, f"@bad\n{ref[22:40]}\n+\n{'I' * 18}\n"]))  # too short for the collapse job
    layout = L.load(text)
    cli.run_align(spark, layout, f"file://{tmp_path}/r.fastq", None, f"file://{tmp_path}/aligned", f"file://{tmp_path}/sam")
    rows = spark.read.parquet(f"file://{tmp_path}/aligned")
    assert rows.count() == 61 and rows.where(f"cigar != '{len(ref)}M'").count() == 1
    reads = {r.read_name: r for r in alignments.read_sam(spark, f"file://{tmp_path}/sam").collect()}
    for i, line in enumerate(lines):
        _, seq, _, qual, _ = line.split("\n")
        got = reads[f"r{i}"]
        assert got.seq == seq and got.qual == [ord(q) - 33 for q in qual]
        assert (got.tags["e0"], got.tags["e1"], got.tags["rc"], got.tags["ar"], float(got.tags["rm"])) == (seq[4:12], seq[17:23], "1", f"r{i}", 1.0) and float(got.tags["as"]) > 0
    cli.run_collapse(spark, layout, f"file://{tmp_path}/aligned", f"file://{tmp_path}/out", f"file://{tmp_path}")
    got = alignments.read_sam(spark, f"file://{tmp_path}/out/amplicon").collect()
    assert sorted((r.tags["e0"], r.tags["e1"], r.tags["rc"]) for r in got) == sorted((c, u, "6") for c in cells for u in ("ACGTAC", "TTGGCC"))
    assert all(len(r.qual) == len(r.seq) for r in got)
    assert all(min(r.qual[23:]) == 40 for r in got)  # six reads agree, and 40 is the most
    cli.run_collapse(spark, layout, f"file://{tmp_path}/aligned", f"file://{tmp_path}/each", f"file://{tmp_path}", "correct")
    each = {r.read_name: r for r in alignments.read_sam(spark, f"file://{tmp_path}/each/amplicon").collect()}
    assert len(each) == 60 and all(each[k].qual == reads[k].qual and each[k].tags["o0"] == reads[k].tags["e0"] for k in each)


def test_layout_of_reads(spark, tmp_path):
    """Index, spacer, turned mate and two references with the same tags."""
    from ampliweave.operators import merge
    from ampliweave.plans import cli

    text = LAYOUT.replace("merge: Align", "merge: Concatenate").replace("  - !Read1", "  - !Index1 {orientation: Reverse}\n  - !Read1").replace("{spacer_sequence: ACGT}", "{spacer_sequence: GTGTGTGT}")
    head = text[: text.index("  amplicon:")]
    one = text[text.index("  amplicon:") :].replace("cells.txt", "").replace(", file: ,", ",").replace("KnownTag", "DegenerateTag")
    parts = {"amplicon": ("CAAG", "GGCATTTTACGGACTGATCAGGACTTGC"), "other": ("GTTC", "GGCATTTTACGGTTAACCGGATATCGGA")}
    refs = {n: i + "ACGT00000000TTGCA111111" + "GTGTGTGT" + end for n, (i, end) in parts.items()}
    body = one.replace("ACGT00000000TTGCA111111GGCATTTTACGGACTGATCAGG", refs["amplicon"])
    text = head + body + body.replace("amplicon:", "other:").replace(refs["amplicon"], refs["other"])
    layout = L.load(text)
    assert [k for k, _ in layout.reads] == ["Index1", "Read1", "Spacer", "Read2"] and layout.references[0].tags == layout.references[1].tags
    files, want = {"1": [], "2": [], "i": []}, {}
    for n, (name, (index, end)) in enumerate(parts.items()):
        for k in range(4):
            for file, seq in (("1", f"ACGT{'ACACGTGT'}TTGCA{'AACCGG'}"), ("2", A.reverse_complement(end)), ("i", index[::-1])):
                files[file].append(f"@r{n}{k}\n{seq}\n+\n{''.join(chr(50 + j) for j in range(len(seq)))}\n")
            want[f"r{n}{k}"] = refs[name].replace("0" * 8, "ACACGTGT").replace("1" * 6, "AACCGG")
    for name, lines in files.items():
        (tmp_path / f"{name}.fastq").write_text("".join(lines))
    path = lambda name: f"file://{tmp_path}/{name}"
    cli.run_align(spark, layout, path("1.fastq"), path("2.fastq"), path("aligned"), index1=path("i.fastq"))
    got = {r.read_id: r for r in spark.read.parquet(path("aligned")).collect()}
    assert {k: r.seq for k, r in got.items()} == want and {k: r.ref_name for k, r in got.items()} == {f"r{n}{k}": name for n, name in enumerate(parts) for k in range(4)}
    assert all(len(r.qual) == len(r.seq) and list(r.qual[:4]) == [20, 19, 18, 17] and list(r.qual[27:35]) == [39] * 8 for r in got.values())
    cli.run_collapse(spark, layout, path("aligned"), path("out"), str(tmp_path))
    made = {r.ref_name: r for r in alignments.read_sam(spark, path("out/amplicon")).collect()}
    assert {n: (r.tags["e0"], r.tags["e1"], r.tags["rc"]) for n, r in made.items()} == {n: ("ACACGTGT", "AACCGG", "4") for n in parts}
    assert not (tmp_path / "out" / "other").exists()
    pair = spark.createDataFrame([("AC", [1, 2], "GT", [3, 4], "T", [5])], "seq1 string, qual1 array<int>, seq2 string, qual2 array<int>, seq_index1 string, qual_index1 array<int>")
    for strategy, reads in (("align", layout.reads), ("concatenate", layout.reads[1:]), (None, ())):
        with pytest.raises(ValueError):
            merge.merged(pair, strategy, True, reads)


def test_streaming(spark, tmp_path):
    from ampliweave.streaming import first_of_molecule, tag_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for name, df in (("counts", tag_counts(stream, "ts", ["event_type"], late="3650 days")), ("molecules", first_of_molecule(stream, "ts", ["user_id", "event_type"], "3650 days"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
    want = {(r.start, r.event_type): r.n for r in tag_counts(events, "ts", ["event_type"]).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("counts").collect()} == want
    assert spark.table("molecules").count() == events.select("user_id", "event_type").distinct().count()
