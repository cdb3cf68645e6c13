"""Sequence scalars (SEQ*, DIST*). Every function takes and returns columns; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "-"
# IUPAC complements, and the bases that each code stands for.
COMPLEMENT = ("ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN")
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def reverse_complement(s: Column) -> Column:
    """Upper case; bytes that are no IUPAC code stay (SEQ1)."""
    return F.reverse(F.translate(F.upper(s), *COMPLEMENT))


def reverse_complement_or_n(s: Column) -> Column:
    """The case of acgt is kept, all else becomes N (SEQ2)."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def complement_keeping_case(s: Column) -> Column:
    """The case is kept; all but acgt becomes n above 'a' and N otherwise."""
    odd = F.regexp_replace(F.regexp_replace(s, "[^ACGTacgt\\x00-\\x61]", "n"), "[^ACGTacgtn]", "N")
    return F.translate(odd, "ACGTacgt", "TGCAtgca")


def reverse_complement_keeping_case(s: Column) -> Column:
    """complement_keeping_case() reversed (SEQ3, and SEQ4 on upper case)."""
    return F.reverse(complement_keeping_case(s))


def orient(s: Column, how: str) -> Column:
    """how: forward, reverse or reverse_complement (SEQ7); anything else is an error when the plan is built."""
    try:
        return {"forward": lambda x: x, "reverse": F.reverse, "reverse_complement": reverse_complement}[how](s)
    except KeyError:
        raise ValueError(f"unknown orientation: {how}") from None


def strip_gaps(s: Column) -> Column:
    return F.replace(s, F.lit(GAP), F.lit(""))


def pad_right(s: Column, n: int) -> Column:
    """n characters: gaps are added, or the end is cut off (SEQ9)."""
    return F.rpad(s, n, GAP)


def is_base(s: Column) -> Column:
    """Whether a character is an IUPAC code of DNA or RNA (SEQ10)."""
    return s.rlike("^[ACGTURYSWKMBDHVNacgturyswkmbdhvn]$")


def is_ambiguity_of(code: Column, base: Column) -> Column:
    """Whether a base is among those that a code stands for, case ignored; sets hold only concrete bases (SEQ6)."""
    sets = F.create_map(*[F.lit(x) for pair in AMBIGUITY.items() for x in pair])
    return F.coalesce(F.contains(sets[F.upper(code)], F.upper(base)) & base.rlike("^[ACGTacgt]$"), F.lit(False))


def kmers(s: Column, k: int, step: int = 1) -> Column:
    """Upper-case windows of k characters at every step-th place (WIN1)."""
    last = F.length(s) - k + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step)), lambda i: F.substr(F.upper(s), i, F.lit(k))))


def combinations(k: int, alphabet: str = "ACGT") -> Column:
    """For a number below len(alphabet) ** k in column id, the string of k characters that it numbers (SEQ13): spark.range over all of them gives all strings in order."""
    n = len(alphabet)
    return F.concat(*[F.substr(F.lit(alphabet), (F.floor(F.col("id") / F.lit(n ** (k - 1 - i))) % n + 1).cast("int"), F.lit(1)) for i in range(k)])


def kmer_runs(s: Column, k: int, step: int = 1) -> Column:
    """Array of (kmer, n): equal neighbours of kmers() are one entry (SEQ11)."""
    kind = "array<struct<kmer:string,n:int>>"

    def add(done: Column, kmer: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        one = F.array(F.struct(kmer.alias("kmer"), F.lit(1).alias("n")))
        more = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(kmer.alias("kmer"), (last["n"] + 1).alias("n"))))
        return F.when(last["kmer"] == kmer, more).otherwise(F.concat(done, one)).cast(kind)

    return F.aggregate(kmers(s, k, step), F.array().cast(kind), add)


def gap_share(s: Column) -> Column:
    """Share of gaps (SEQ12); null for the empty sequence."""
    return F.try_divide(F.length(s) - F.length(strip_gaps(s)), F.length(s))


def tag_base_score(a: Column, b: Column) -> Column:
    """10 for equal concrete bases (case ignored), -8 for different ones, 7 where either is anything else (SEQ15)."""
    known = a.rlike("^[ACGTacgt]$") & b.rlike("^[ACGTacgt]$")
    return F.when(known & (F.upper(a) == F.upper(b)), 10).when(known, -8).otherwise(7)


def motif_at(s: Column, motif: Column) -> Column:
    """Place of the first occurrence, from 0; -1 if there is none (SEQ16)."""
    return F.position(motif, s) - 1


def motif_places(s: Column, motif: Column) -> Column:
    """Places of all occurrences that don't overlap, leftmost first (JON15)."""
    step = lambda a, part: F.struct((a["at"] + F.length(part) + F.length(motif)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(part))).alias("out"))
    parts = F.split(s, F.concat(F.lit("\\Q"), motif, F.lit("\\E")), -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), begin, step, lambda a: a["out"])


def _count_pairs(a: Column, b: Column, differs) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: differs(x, y).cast("int")), F.lit(0), lambda n, x: n + x)


def hamming(a: Column, b: Column) -> Column:
    """Null where the lengths differ (DIST1, DIST4)."""
    return F.when(F.length(a) == F.length(b), _count_pairs(a, b, lambda x, y: x != y))


def hamming_prefix(a: Column, b: Column, most: int | None = None) -> Column:
    """Over the shorter one's length; with most, nothing above most + 1 (DIST2)."""
    n = F.least(F.length(a), F.length(b))
    out = F.when(n == 0, 0).otherwise(_count_pairs(F.substr(a, F.lit(1), n), F.substr(b, F.lit(1), n), lambda x, y: x != y))
    return out if most is None else F.least(out, F.lit(most + 1))


def hamming_iupac(a: Column, b: Column) -> Column:
    """Characters count as equal if either is a code for the other's base (DIST3)."""
    return F.when(F.length(a) == F.length(b), _count_pairs(a, b, lambda x, y: ~(is_ambiguity_of(x, y) | is_ambiguity_of(y, x))))


def levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance; with most, -1 beyond it (DIST5)."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)
