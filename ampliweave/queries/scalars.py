"""One query for each scalar operator: read_id and the operator's value over all synthetic reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import events as E
from ..functions import quality as Q
from ..functions import sequence as S
from ..functions import tags as T
from ..synth import READS, reads

_c = F.col
_RC = "reverse(translate(upper({0}), 'ACGTRYKMBVDHSWN', 'TGCAYRMKVBHDSWN'))"
_PAIRS = "list_zip(string_split(ref_aln, ''), string_split(read_aln, ''))"
# (operator, column, the same in SQL); mixed is a sequence with both cases and odd letters
_MIXED_SQL = "(lower(substr(seq, 1, 10)) || 'RyxZ' || read_aln)"
_QSQL = "CAST((read_id * 7) % 41 AS DOUBLE)"
_Q2SQL = "(CAST((read_id * 5) % 37 AS DOUBLE) + 1)"
_OPS_SQL = f"""list_transform(regexp_extract_all(array_to_string(list_transform({_PAIRS}, lambda x: CASE WHEN x[2] = '-' AND x[1] = '-' THEN '' WHEN x[2] = '-' THEN 'D' WHEN x[1] = '-' THEN 'I' ELSE 'M' END), ''), 'M+|D+|I+'), lambda x: length(x) || substr(x, 1, 1))"""
_CIGAR_SQL = f"array_to_string({_OPS_SQL}, '')"
_ALIGNED = f"list_filter({_PAIRS}, lambda x: unicode(x[1]) > 64 AND x[1] <> 'N' AND unicode(x[2]) > 64)"
_EVENT_SQL = "((read_id % 9 + 1) || CASE WHEN read_id % 3 = 0 THEN 'D+' || (read_id % 90) ELSE 'I+' || (read_id % 90) || '+' || substr(molecule, 1, CAST(read_id % 9 + 1 AS INT)) END || CASE WHEN read_id % 4 = 0 THEN '&NONE' ELSE '' END)"
_KIND_SQL = "([" + ", ".join(f"'{k}'" for k in E.TARGETS) + "])[CAST(read_id % 5 + 1 AS INT)]"
_TARGET_SQL = "substr(molecule, 1, CAST(23 + read_id % 4 AS INT))"
_DEGENERATE_SQL = "CASE upper({0}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.AMBIGUITY.items()) + " ELSE '' END"
_IN_CODE = f"(regexp_full_match({{1}}, '[ACGTacgt]') AND contains({_DEGENERATE_SQL}, upper({{1}})))"

def _mixed() -> Column:
    return F.concat(F.lower(F.substr("seq", F.lit(1), F.lit(10))), F.lit("RyxZ"), F.col("read_aln"))


def _q() -> Column:
    return F.pmod(F.col("read_id") * 7, F.lit(41)).cast("double")


def _q2() -> Column:
    return F.pmod(F.col("read_id") * 5, F.lit(37)).cast("double") + 1


def _cigar() -> Column:
    return C.render(C.of_pair(_c("ref_aln"), _c("read_aln")))


def _event() -> Column:
    size, place = _c("read_id") % 9 + 1, (_c("read_id") % 90).cast("string")
    what = F.when(_c("read_id") % 3 == 0, F.concat(F.lit("D+"), place)).otherwise(F.concat(F.lit("I+"), place, F.lit("+"), F.substr("molecule", F.lit(1), size.cast("int"))))
    return F.concat(size.cast("string"), what, F.when(_c("read_id") % 4 == 0, "&NONE").otherwise(""))


def _kind() -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in E.TARGETS]), (_c("read_id") % 5 + 1).cast("int"))


def _target() -> Column:
    return F.substr("molecule", F.lit(1), F.lit(23) + (_c("read_id") % 4).cast("int"))


def _window_sql(i: int) -> str:
    return "CASE " + _KIND_SQL + " " + " ".join(f"WHEN '{k}' THEN CASE WHEN read_id % 2 = 0 THEN {v[1][i]} ELSE {v[2][i]} END" for k, v in E.TARGETS.items()) + " END"


SCALARS: dict[str, tuple[Callable[[], Column], str]] = {
    "seq1_revcomp": (lambda: S.reverse_complement(_mixed()), _RC.format(_MIXED_SQL)),
    "seq2_revcomp_or_n": (lambda: S.reverse_complement_or_n(_mixed()), f"reverse(translate(regexp_replace({_MIXED_SQL}, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca'))"),
    "seq3_revcomp_keeping_case": (lambda: S.reverse_complement_keeping_case(_mixed()), f"reverse(array_to_string(list_transform(string_split({_MIXED_SQL}, ''), lambda x: CASE WHEN contains('ACGTacgt', x) THEN translate(x, 'ACGTacgt', 'TGCAtgca') WHEN x > 'a' THEN 'n' ELSE 'N' END), ''))"),
    "seq4_revcomp_upper": (lambda: S.reverse_complement_or_n(F.upper(_mixed())), f"reverse(translate(regexp_replace(upper({_MIXED_SQL}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"),
    "seq5_complement": (lambda: S.complement_keeping_case(_mixed()), f"array_to_string(list_transform(string_split({_MIXED_SQL}, ''), lambda x: CASE WHEN contains('ACGTacgt', x) THEN translate(x, 'ACGTacgt', 'TGCAtgca') WHEN x > 'a' THEN 'n' ELSE 'N' END), '')"),
    "seq6_ambiguity": (lambda: S.is_ambiguity_of(F.substr(F.lit("ACGTRYKMSWBDHVN"), (_c("read_id") % 15 + 1).cast("int"), F.lit(1)), F.substr("seq", F.lit(1), F.lit(1))), _IN_CODE.format("substr('ACGTRYKMSWBDHVN', CAST(read_id % 15 + 1 AS INT), 1)", "substr(seq, 1, 1)")),
    "seq7_orient": (lambda: F.when(_c("read_id") % 3 == 0, S.orient(_c("seq"), "forward")).when(_c("read_id") % 3 == 1, S.orient(_c("seq"), "reverse")).otherwise(S.orient(_c("seq"), "reverse_complement")), f"CASE read_id % 3 WHEN 0 THEN seq WHEN 1 THEN reverse(seq) ELSE {_RC.format('seq')} END"),
    "seq8_strip_gaps": (lambda: S.strip_gaps(_c("read_aln")), "replace(read_aln, '-', '')"),
    "seq9_pad_right": (lambda: S.pad_right(_c("read_aln"), 34), "rpad(read_aln, 34, '-')"),
    "seq10_is_base": (lambda: S.is_base(F.substr("tagged", (_c("read_id") % 32 + 1).cast("int"), F.lit(1))), "regexp_full_match(substr(tagged, CAST(read_id % 32 + 1 AS INT), 1), '[ACGTURYSWKMBDHVNacgturyswkmbdhvn]')"),
    "seq11_kmer_runs": (lambda: F.array_join(F.transform(S.kmer_runs(_c("seq"), 2, 1), lambda x: F.concat_ws(":", x["kmer"], x["n"].cast("string"))), ","), "(SELECT string_agg(v || ':' || n, ',' ORDER BY g) FROM (SELECT v, island, min(q) AS g, count(*) AS n FROM (SELECT q, v, q - row_number() OVER (PARTITION BY v ORDER BY q) AS island FROM (SELECT q, upper(substr(seq, CAST(q AS INT), 2)) AS v FROM range(1, 32) AS t(q))) GROUP BY v, island))"),
    "seq12_gap_share": (lambda: F.round(S.gap_share(_c("read_aln")), 6), "round(CAST(length(read_aln) - length(replace(read_aln, '-', '')) AS DOUBLE) / length(read_aln), 6)"),
    "seq15_tag_base_score": (lambda: S.tag_base_score(F.substr("ref_aln", F.lit(5), F.lit(1)), F.substr("read_aln", F.lit(6), F.lit(1))), "CASE WHEN NOT (regexp_full_match(substr(ref_aln, 5, 1), '[ACGTacgt]') AND regexp_full_match(substr(read_aln, 6, 1), '[ACGTacgt]')) THEN 7 WHEN upper(substr(ref_aln, 5, 1)) = upper(substr(read_aln, 6, 1)) THEN 10 ELSE -8 END"),
    "seq16_motif_at": (lambda: S.motif_at(_c("seq"), F.substr("molecule", F.lit(20), F.lit(3))), "CAST(strpos(seq, substr(molecule, 20, 3)) - 1 AS INT)"),
    "seq17_slice": (lambda: F.substr("seq", F.lit(5), F.lit(12)), "substr(seq, 5, 12)"),
    "qual1_ascii_to_error": (lambda: F.round(Q.ascii_to_error(_q() + 33), 9), f"round(pow(10.0, -({_QSQL}) / 10.0), 9)"),
    "qual2_error_to_ascii": (lambda: Q.error_to_ascii(F.pow(F.lit(10.0), -_q() / 10)), f"CAST(greatest(0, least(255, floor(round(-10 * log10(pow(10.0, -({_QSQL}) / 10)) + 33, 9)))) AS INT)"),
    "qual3_combine": (lambda: Q.combine_ascii(_q() + 33, _q2() + 33, True), f"CAST(greatest(0, least(255, floor(round(-10 * log10(pow(10.0, -({_QSQL}) / 10.0) * pow(10.0, -({_Q2SQL}) / 10.0)) + 33, 9)))) AS INT)"),
    "qual4_phred_to_error": (lambda: F.round(Q.phred_to_error(_q()), 9), f"round(pow(10.0, -({_QSQL}) / 10.0), 9)"),
    "qual5_certainty_to_phred": (lambda: Q.certainty_to_phred(1 - Q.phred_to_error(_q())), f"CASE WHEN 1 - pow(10.0, -({_QSQL}) / 10.0) < 1e-8 THEN 0 ELSE CAST(least(40, round(-10 * log10(1 + 1e-11 - (1 - pow(10.0, -({_QSQL}) / 10.0))))) AS INT) END"),
    "dist1_hamming": (lambda: S.hamming(_c("molecule"), _c("seq")), "CAST(hamming(molecule, seq) AS INT)"),
    "dist2_hamming_prefix": (lambda: S.hamming_prefix(_c("molecule"), _c("read_aln"), 20), "CAST(least(21, hamming(molecule, substr(read_aln, 1, 32))) AS INT)"),
    "dist3_hamming_iupac": (lambda: S.hamming_iupac(_c("molecule"), F.lower(_c("seq"))), f"CAST(len(list_filter(list_zip(string_split(molecule, ''), string_split(lower(seq), '')), lambda x: NOT ({_IN_CODE.format('x[1]', 'x[2]')} OR {_IN_CODE.format('x[2]', 'x[1]')}))) AS INT)"),
    "dist4_hamming_gapped": (lambda: S.hamming(_c("ref_aln"), _c("read_aln")), "CAST(hamming(ref_aln, read_aln) AS INT)"),
    "dist5_levenshtein": (lambda: S.levenshtein(_c("molecule"), S.strip_gaps(_c("read_aln"))), "CAST(levenshtein(molecule, replace(read_aln, '-', '')) AS INT)"),
    "cig1_parse": (lambda: F.array_join(F.transform(C.parse(_cigar()), lambda x: F.concat(x["op"], (x["len"] * 2).cast("string"))), " "), f"array_to_string(list_transform({_OPS_SQL}, lambda x: right(x, 1) || (2 * CAST(x[:-2] AS INT))), ' ')"),
    "cig2_render": (lambda: C.render(C.parse(F.concat(_cigar(), F.lit("3S2H")))), f"{_CIGAR_SQL} || '3S2H'"),
    "cig3_simplify": (lambda: C.render(C.simplify(F.concat(C.of_pair(_c("ref_aln"), _c("read_aln")), C.parse(F.lit("2M3M1S1S1D2D"))))), f"CASE WHEN {_CIGAR_SQL} LIKE '%M' THEN regexp_replace({_CIGAR_SQL}, '[0-9]+M$', '') || (CAST(regexp_extract({_CIGAR_SQL}, '([0-9]+)M$', 1) AS INT) + 5) || 'M' ELSE {_CIGAR_SQL} || '5M' END || '1S1S3D'"),
    "cig4_expand": (lambda: C.expand(C.of_pair(_c("ref_aln"), _c("read_aln")), _c("molecule"), S.strip_gaps(_c("read_aln")))["read_aln"], "read_aln"),
    "cig5_expand_from": (lambda: C.expand(C.parse(F.lit("4M2D3I5M")), _c("molecule"), _c("seq"), F.lit(3))["ref_aln"], "substr(molecule, 1, 9) || '---' || substr(molecule, 10, 5)"),
    "cig6_of_pair": (lambda: _cigar(), _CIGAR_SQL),
    "cig7_fits": (lambda: C.fits(C.parse(F.lit("32M")), _c("ref_aln"), _c("read_aln")), f"{_CIGAR_SQL} = '32M'"),
    "cig8_pair_score": (lambda: C.pair_score(_c("ref_aln"), _c("read_aln"), 10.0, -9.0, -20.0, -2.0), f"list_sum(list_transform({_PAIRS}, lambda x: CASE WHEN x[1] = '-' AND x[2] = '-' THEN 0.0 WHEN x[1] = '-' OR x[2] = '-' THEN -2.0 WHEN x[1] = x[2] THEN 10.0 ELSE -9.0 END))::DOUBLE - 20.0::DOUBLE * len(list_filter({_OPS_SQL}, lambda x: right(x, 1) <> 'M'))"),
    "cig10_stretch": (lambda: C.stretch(S.strip_gaps(_c("ref_aln")), _c("ref_aln")), "ref_aln"),
    "cig11_match_rate": (lambda: F.round(C.match_rate(_c("ref_aln"), _c("read_aln")), 6), f"round(CAST(len(list_filter({_ALIGNED}, lambda x: x[1] = x[2])) AS DOUBLE) / len({_ALIGNED}), 6)"),
    "flt2_enough_aligned": (lambda: C.enough_aligned(_c("ref_aln"), _c("read_aln"), 30, 0.8), f"len({_ALIGNED}) >= 30 AND len(list_filter({_ALIGNED}, lambda x: x[1] = x[2])) >= 0.8 * len({_ALIGNED})"),
    "flt4_valid_tag": (lambda: T.valid(T.extract(_c("tagged"), _c("read_aln"), "1"), 6, 1), "len(list_filter(list_zip(string_split(tagged, ''), string_split(read_aln, '')), lambda x: x[1] = '1' AND x[2] = '-')) <= 1"),
    "flt5_near_length": (lambda: T.near_length(F.substr("read_aln", F.lit(12), F.lit(8)), 8, 1), "length(replace(substr(read_aln, 12, 8), '-', '')) BETWEEN 7 AND 9"),
    "flt10_valid_target": (lambda: E.valid_target(_kind(), _target()), f"length({_TARGET_SQL}) = CASE {_KIND_SQL} WHEN 'CAS9_PAL_ABE' THEN 26 WHEN 'CAS12A_DSB' THEN 24 ELSE 23 END AND CASE {_KIND_SQL} WHEN 'CAS9_PAL_ABE' THEN {_TARGET_SQL} LIKE 'CC%' AND {_TARGET_SQL} LIKE '%GG' WHEN 'CAS12A_DSB' THEN {_TARGET_SQL} LIKE 'TTT%' OR {_TARGET_SQL} LIKE '%AAA' ELSE {_TARGET_SQL} LIKE 'CC%' OR {_TARGET_SQL} LIKE '%GG' END"),
    "tag1_extract": (lambda: F.concat_ws("/", T.extract(_c("tagged"), _c("read_aln"), "0"), T.extract(_c("tagged"), _c("read_aln"), "1")), "array_to_string(list_transform(list_filter(list_zip(string_split(tagged, ''), string_split(read_aln, '')), lambda x: x[1] = '0'), lambda x: x[2]), '') || '/' || array_to_string(list_transform(list_filter(list_zip(string_split(tagged, ''), string_split(read_aln, '')), lambda x: x[1] = '1'), lambda x: x[2]), '')"),
    "evt1_parse": (lambda: F.to_json(F.transform(E.parse(_event()), lambda e: F.concat_ws("|", e["type"], F.coalesce(e["len"], F.lit(-1)).cast("string"), e["pos"].cast("string"), F.coalesce(e["bases"], F.lit(""))))), "'[\"' || CASE WHEN read_id % 3 = 0 THEN 'D|' || (read_id % 9 + 1) || '|' || (read_id % 90) || '|' ELSE 'I|' || (read_id % 9 + 1) || '|' || (read_id % 90) || '|' || substr(molecule, 1, CAST(read_id % 9 + 1 AS INT)) END || '\"' || CASE WHEN read_id % 4 = 0 THEN ',\"NONE|-1|-1|\"' ELSE '' END || ']'"),
    "evt2_render": (lambda: E.render(E.parse(_event())), _EVENT_SQL),
    "evt3_sound": (lambda: F.forall(E.parse(F.concat(_event(), F.when(_c("read_id") % 8 == 0, "&3I+5+AC").otherwise(""))), E.sound), "read_id % 8 <> 0"),
    "evt4_same": (lambda: E.same(E.parse(_event())[0], E.parse(F.concat(F.lit("4D+"), (_c("read_id") % 90).cast("string")))[0]), "read_id % 3 = 0 AND read_id % 9 + 1 = 4"),
    "evt5_window": (lambda: F.concat_ws("-", E.window(_kind(), _c("read_id") % 50, _c("read_id") % 2 == 0)["lo"].cast("string"), E.window(_kind(), _c("read_id") % 50, _c("read_id") % 2 == 0)["hi"].cast("string")), f"(read_id % 50 + {_window_sql(0)}) || '-' || (read_id % 50 + {_window_sql(1)})"),
    "jon15_motif_places": (lambda: F.array_join(S.motif_places(F.concat("seq", "seq"), F.substr("molecule", F.lit(9), F.lit(2))).cast("array<string>"), ","), "coalesce(array_to_string(list_transform(range(1, len(string_split(seq || seq, substr(molecule, 9, 2)))), lambda n: CAST(CAST(list_sum(list_transform(string_split(seq || seq, substr(molecule, 9, 2))[1:n], lambda z: length(z))) + 2 * (n - 1) AS INT) AS VARCHAR)), ','), '')"),
    "win1_kmers": (lambda: F.array_join(S.kmers(_c("seq"), 8, 4), ","), "array_to_string(list_transform(range(1, 26, 4), lambda q: upper(substr(seq, CAST(q AS INT), 8))), ',')"),
}


def _query(value: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: reads(spark, sf_dir).select("read_id", value().alias("value"))


QUERIES: dict = {name: _query(value) for name, (value, _) in SCALARS.items()}
SQL = {name: f"WITH {READS}\nSELECT read_id, {sql} AS value FROM reads" for name, (_, sql) in SCALARS.items()}
