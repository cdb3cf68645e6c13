import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ampliweave.operators import align as A


def plain(ref, read, s):
    """The recurrences cell by cell."""
    t, never = s.table(), A.NEVER
    n, m = len(ref), len(read)
    sc = [[[never] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    way = [[[0] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    sc[0][0][0] = 0.0
    for x in range(1, n + 1):
        sc[x][0][1] = sc[x][0][2] = (s.gap_open + x * s.gap_extend) * s.final
    for y in range(1, m + 1):
        sc[0][y][1] = sc[0][y][2] = (s.gap_open + y * s.gap_extend) * s.final

    def best(up, left, diag):
        if up > left:
            return (up, 1) if up > diag else (diag, 0)
        return (left, 2) if left > diag else (diag, 0)

    for x in range(1, n + 1):
        for y in range(1, m + 1):
            e = s.gap_extend * (s.final if x == n or y == m else 1.0)
            o, v = s.gap_open + e, t[ord(ref[x - 1]), ord(read[y - 1])]
            p, u, w = sc[x - 1][y - 1], sc[x - 1][y], None
            sc[x][y][0], way[x][y][0] = best(p[1] + v, p[2] + v, p[0] + v)
            sc[x][y][1], way[x][y][1] = best(u[1] + e, u[2] + o, u[0] + o)
            w = sc[x][y - 1]
            sc[x][y][2], way[x][y][2] = best(w[1] + o, w[2] + e, w[0] + o)
    x, y, z = n, m, max(range(3), key=lambda c: (sc[n][m][c], c))
    score, a, b = sc[n][m][z], "", ""
    while x and y:
        to = way[x][y][z]
        a, b = ("-" if z == 2 else ref[x - 1]) + a, ("-" if z == 1 else read[y - 1]) + b
        x, y, z = x - (z != 2), y - (z != 1), to
    return ref[:x] + "-" * y + a, "-" * x + read[:y] + b, score


@settings(max_examples=400, deadline=None)
@given(st.text("ACGTN0", min_size=1, max_size=14), st.text("ACGTN", min_size=1, max_size=14), st.sampled_from(list(A.PRESETS.values())))
def test_global_against_cell_by_cell(ref, read, scoring):
    assert A.align_pairs([ref], [read], scoring)[0] == plain(ref, read, scoring)


def test_batches_and_long_pairs(monkeypatch):
    monkeypatch.setattr(A, "HELD", 5000)
    rng = random.Random(1)
    refs = ["".join(rng.choices("ACGT", k=rng.choice([20, 30]))) for _ in range(60)]
    reads = [r[:7] + "A" * rng.randint(0, 3) + r[7 + rng.randint(0, 3) :] for r in refs]
    assert A.align_pairs(refs, reads) == [plain(a, b, A.ALIGN) for a, b in zip(refs, reads)]
    assert A.align_pairs(["", "AC", ""], ["AC", "", ""]) == [("--", "AC", -24.0), ("AC", "--", -24.0), ("", "", 0.0)]


def test_vectors():
    s = A.Scoring(10, -9, 8, -20, -10)
    assert A.align_pairs(["AAAA"], ["AATAA"], A.Scoring(6, -6, 8, -10, -10))[0][:2] == ("AA-AA", "AATAA")
    assert A.align_pairs(["AAAANAAAA"], ["AAAAAAAA"])[0][1] == "AAAA-AAAA"
    pair = ("CCAATCTACTACTGCTTGCAGTAC", "AGTCCGAGGGCTACTCTACTGAAC")
    assert A.local_alignments(*pair, s)[0][:2] == ("CCAATCTACT", "CTACTCTACT")
    two = A.local_alignments(*pair, A.Scoring(10, -9, 8, -10, -10), 2)
    assert two[1][:2] == ("CTACTACTGCT", "CTACT-CTACT")
    ref = "CCAATCTACTACTGCTTGCA"
    assert A.align_with_inversion(ref, "CCGTAGATTTACTGCTTGCA", A.Scoring(10, -11, 7, -15, -5), 2, -2.0)[:2] == (ref, ref)


def test_any_number_of_inversions():
    rng = random.Random(8)
    refs, reads = [], []
    for n in (1, 2, 3, 6) * 3:
        spans = ["".join(rng.choices("ACGT", k=14 + rng.randint(0, 6))) for _ in range(n)]
        gaps = ["".join(rng.choices("ACGT", k=9 + rng.randint(0, 3))) for _ in range(n + 1)]
        refs.append(gaps[0] + "".join(s + g for s, g in zip(spans, gaps[1:])))
        reads.append(gaps[0] + "".join(A.reverse_complement(s) + g for s, g in zip(spans, gaps[1:])))
    reads = [r if k % 2 else r[3:40] + "G" + r[42:] for k, r in enumerate(reads)]
    for ref, read, (a, b, score, cigar) in zip(refs, reads, A.pairs_with_inversion(refs, reads, least=12)):
        local = A.local_pairs([ref], [A.reverse_complement(read)], A.ALIGN, 4, 12)[0]
        ends = [(0, 0, 0.0)]
        found = []
        for x, y, inner, at, start in local:
            n, m = len(x.replace("-", "")), len(y.replace("-", ""))
            if n >= 12:
                found.append((at, len(read) - start - m, at + n, len(read) - start, inner - 10.0))
        for p, q, u, v, inner in sorted(found):
            ends.append((u, v, max(t + A.align_pairs([ref[i:p]], [read[j:q]])[0][2] for i, j, t in ends if i <= p and j <= q) + inner))
        assert score == max(t + A.align_pairs([ref[i:]], [read[j:]])[0][2] for i, j, t in ends)
        assert a.replace("-", "") == ref and len(a) == len(b)
    for k in range(1, 12, 2):
        a, b, _, cigar = A.align_with_inversion(refs[k], reads[k], A.Scoring(10, -20, 9, -60, -10), least=12)
        assert a.replace("-", "") == refs[k] and cigar.count("<") == cigar.count(">") == (1, 2, 3, 6)[k % 4]


def test_seeds_orientation_anchors_and_clips():
    rng = random.Random(2)
    ref = "".join(rng.choices("ACGT", k=80))
    read = ref[:30] + "A" + ref[34:]
    assert A.is_forward(ref, read) and not A.is_forward(ref, A.reverse_complement(read)) and not A.is_forward(ref, "")
    a, b, _ = A.align_anchored(ref, read)
    assert a.replace("-", "") == ref and b.replace("-", "") == read
    assert A.align_anchored(ref, ref) == (ref, ref, 800.0) and A.align_anchored("", "AC")[:2] == ("--", "AC")
    ops = [("S", 5), ("M", 60), ("S", 4)]
    for mode in ("realign", "match", "clip"):
        a, b = A.recover_clips(ref, ref[5:74], ops, 10, mode)
        assert a.replace("-", "") == ref and len(a) == len(b) and b.replace("-", "") in ref[5:74]
    assert A.recover_clips(ref, ref[5:74], ops, 10)[1].strip("-") == ref[5:74]
    with pytest.raises(UnicodeEncodeError):
        A.align_pairs(["Ж"], ["A"])


def test_jobs_and_merging(spark):
    from ampliweave.operators import merge
    from ampliweave.plans.align import align_reads

    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=60)) for _ in range(4)]
    refs = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(seqs)], "name string, sequence string")
    rows = [(i, seqs[i % 4][:25] + seqs[i % 4][27:] if i % 2 else A.reverse_complement(seqs[i % 4])) for i in range(16)] + [(99, None), (100, ""), (101, "A" * 500)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    got = {r.read_id: r for r in align_reads(reads, refs, known_strand=False).collect()}
    assert set(got) == {*range(16), 100} and all(got[i].ref_name == f"r{i % 4}" for i in range(16))
    assert all(got[i].cigar == ("60M" if i % 2 == 0 else got[i].cigar) and got[i].ref_aln.replace("-", "") == seqs[i % 4] for i in range(16))
    one = align_reads(reads, refs.limit(1), known_strand=False, least=1).where("read_id = 0").first()
    assert one.read_aln == seqs[0] and one.score == 60.0
    with pytest.raises(ValueError):
        align_reads(reads, refs.limit(0))
    pair = spark.createDataFrame([(1, seqs[0][:40], [30] * 40, A.reverse_complement(seqs[0][20:]), list(range(1, 41)))], "read_id long, seq1 string, qual1 array<int>, seq2 string, qual2 array<int>")
    m = merge.merged(pair, "align", True).first()
    assert m.seq == seqs[0] and len(m.qual) == 60 and m.qual[:20] == [30] * 20 and m.qual[40:] == list(range(20, 0, -1))
    assert merge.merged(pair, "concatenate", True).first().seq == seqs[0][:40] + seqs[0][20:]
    assert merge.merged(pair, None, False).first().seq == seqs[0][:40]
    with pytest.raises(ValueError):
        merge.merged(pair, None, True)


def test_band():
    rng = random.Random(3)
    for _ in range(150):
        ref = "".join(rng.choices("ACGT", k=rng.randint(1, 20)))
        read = "".join(c for c in ref if rng.random() > 0.1) + "".join(rng.choices("ACGT", k=rng.randint(0, 4))) or "A"
        for scoring in A.PRESETS.values():
            whole = A.align_pairs([ref], [read], scoring)[0]
            assert A.align_pairs([ref], [read], scoring, min(len(ref), len(read)))[0] == whole
            last = None
            for band in (0, 1, 3):
                a, b, score = A.align_pairs([ref], [read], scoring, band)[0]
                assert a.replace("-", "") == ref and b.replace("-", "") == read
                x, y, off = 0, 0, []
                for p, q in zip(a, b):
                    x, y = x + (p != "-"), y + (q != "-")
                    off.append(y - x)
                side = len(read) - len(ref)
                assert min(off) >= min(0, side) - band and max(off) <= max(0, side) + band
                assert score <= whole[2] and (last is None or score >= last)
                last = score
    with pytest.raises(ValueError):
        A.align_pairs(["A"], ["A"], band=-1)


def all_alignments(ref, read):
    if not ref and not read:
        yield "", ""
    if ref and read:
        yield from ((ref[0] + a, read[0] + b) for a, b in all_alignments(ref[1:], read[1:]))
    if ref:
        yield from ((ref[0] + a, "-" + b) for a, b in all_alignments(ref[1:], read))
    if read:
        yield from (("-" + a, read[0] + b) for a, b in all_alignments(ref, read[1:]))


@settings(max_examples=40, deadline=None)
@given(st.text("ACG", max_size=5), st.text("ACG", max_size=5), st.sampled_from([A.Convex(), A.Convex(1, -1, -1, -3), A.Convex(5, -4, 0, 0, -2)]))
def test_convex_against_all_alignments(ref, read, scoring):
    import itertools

    def cost(a, b):
        total = sum(scoring.match if p == q else scoring.mismatch for p, q in zip(a, b) if "-" not in (p, q))
        kinds = [(k, len(list(g))) for k, g in itertools.groupby(zip(a, b), lambda c: "D" if c[1] == "-" else "I" if c[0] == "-" else "M")]
        return total + sum(float(scoring.gaps(n)[-1]) for k, n in kinds if k != "M")

    a, b, score = A.align_convex(ref, read, scoring)
    assert a.replace("-", "") == ref and b.replace("-", "") == read
    assert score == pytest.approx(max(cost(*p) for p in all_alignments(ref, read)))
    if scoring.gap_scale:
        assert cost(a, b) == pytest.approx(score)


def test_aligner_choice(spark):
    rng = random.Random(8)
    ref = "".join(rng.choices("ACGT", k=140))
    turned = ref[:50] + A.reverse_complement(ref[50:90]) + ref[90:]
    df = spark.createDataFrame([(0, ref, ref), (1, ref, turned), (2, ref, None)], "read_id int, reference string, seq string")
    cigars = {}
    for name in ("wfa", "Degenerate", "inversion", None):
        using, scoring = A.aligner(name, A.ALIGN)
        cigars[name] = {r.read_id: r.cigar for r in using(df, scoring).collect()}
    assert cigars["inversion"][0] == "140M" and cigars["inversion"][2] is None and "<" not in cigars["wfa"][1] and cigars[None] == cigars["Degenerate"]
    assert re.search("<[^>]*40M[^>]*>", cigars["inversion"][1])  # the whole stretch is inside; few bases beside it may match by chance
    assert A.align_pairs(["ANA"], ["ACA"], A.aligner("wfa", A.ALIGN)[1])[0][2] == 11.0 and A.align_pairs(["ANA"], ["ACA"])[0][2] == 29.0
    assert A.convex(df.where("read_id = 0")).first().cigar == "140M"
    with pytest.raises(ValueError):
        A.aligner("odd", A.ALIGN)


def _edited(rng, ref):
    s = list(ref)
    for _ in range(rng.choice([0, 1, 2, 4])):
        i = rng.randrange(len(s))
        s[i : i + rng.randint(0, 4)] = rng.choices("ACGTN0", k=rng.randint(0, 3))
    return "".join(s)


def test_scores_alone_and_bands_are_those_of_whole_matrices(monkeypatch):
    """Pairs that a band settles, and those that it doesn't, have the alignment and the ties of the whole matrix."""
    rng = random.Random(12)
    refs = ["".join(rng.choices(rng.choice(["ACGT", "AC"]), k=rng.choice([12, 24]))) for _ in range(80)]
    reads = [_edited(rng, r) if rng.random() < 0.8 else "".join(rng.choices("ACGT", k=rng.randint(0, 30))) for r in refs]
    monkeypatch.setattr(A, "TOGETHER", 16)
    for scoring in (*A.PRESETS.values(), A.INVERTED, A.Scoring(1, -2, 1, -1, 0, 1.0)):
        whole = [plain(a, b, scoring) if a and b else A._edge(a.encode(), b.encode(), scoring) for a, b in zip(refs, reads)]
        assert A.align_pairs(refs, reads, scoring) == whole
        assert A.pair_scores(refs, reads, scoring) == [r[2] for r in whole]


def test_equal_pairs_are_aligned_once():
    """aln15_exhaustive: a batch of equal reads costs one alignment, and a read is scored once against each reference."""
    seen = []
    rows = A._sound(lambda a, b: seen.append(len(a)) or [(x + y,) for x, y in zip(a, b)])
    assert rows(["A", "A", None, "C", "A"], ["G", "G", "G", None, "T"]) == [("AG",), ("AG",), None, None, ("AT",)] and seen == [2]


def test_best_of_all_references_with_equal_reads_and_ties(spark):
    refs = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "ACGTACGTAC"), ("c", "TTTTTTTTTT")], "name string, sequence string")
    rows = [(i, "ACGTACGTAC" if i % 2 else "TTTTTNTTTT", ["a", "b", "c"] if i != 3 else ["a", "c"]) for i in range(6)]
    done = A.align_to_best(spark.createDataFrame(rows, "read_id long, seq string, names array<string>"), refs, "names")
    got = {r.read_id: (r.ref_name, r.cigar, r.score) for r in done.collect()}
    assert got == {i: (("b" if i != 3 else "a"), "10M", 100.0) if i % 2 else ("c", "10M", 99.0) for i in range(6)}
    assert done.columns == ["read_id", "ref_name", "seq", "reference", "ref_aln", "read_aln", "score", "cigar"]


def test_clipped_ends_are_aligned_together(monkeypatch):
    """cig9_clip_recovery: one call for the ends of a batch, not two a read."""
    rng, calls, whole = random.Random(5), [], A.align_pairs
    refs = ["".join(rng.choices("ACGT", k=32)) for _ in range(40)]
    reads = [_edited(rng, r) + "ACGTACGTACGT" for r in refs]
    ops = [[("S", 4), ("M", 8), ("S", len(r) - 12)] for r in reads]
    want = [A.recover_clips(a, b, o, 4) for a, b, o in zip(refs, reads, ops)]
    monkeypatch.setattr(A, "align_pairs", lambda *a, **k: calls.append(1) or whole(*a, **k))
    assert A.recovered_clips(refs, reads, ops, [4] * 40) == want and len(calls) == 1


def test_local_alignments_take_no_call_a_cell(monkeypatch):
    """aln8_next_best, aln9_inversions: the matrices of a batch and the ways back of all its pairs go a step at a time."""
    rng = random.Random(6)
    refs = ["".join(rng.choices("ACGT", k=20)) for _ in range(30)]
    want = [A.local_pairs([r], [r[::-1]], A.ALIGN, 2)[0] for r in refs]
    monkeypatch.setattr(A, "_best", None)
    assert A.local_pairs(refs, [r[::-1] for r in refs], A.ALIGN, 2) == want
    for ref, read, found in zip(refs, (r[::-1] for r in refs), want):
        for a, b, score, x, y in found:
            assert len(a) == len(b) and ref[x:].startswith(a.replace("-", "")) and read[y:].startswith(b.replace("-", "")) and score > 0


def test_equal_reads_need_no_matrix(monkeypatch):
    """aln1_simple, aln2_affine, aln16_scorings: a read without a difference is settled by what any gap would cost."""
    monkeypatch.setattr(A, "_global", None)
    monkeypatch.setattr(A, "_exact", None)
    refs = ["ACGTTGCAACGTTGCA", "TTGACCATTGACCATG"]
    for s in A.PRESETS.values():
        assert A.align_pairs(refs, refs, s) == [(r, r, 16 * s.match) for r in refs]
