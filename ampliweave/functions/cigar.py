"""CIGAR strings and gapped pairs (CIG*). Operations are array<struct<op:string,len:int>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<op:string,len:int>>"
_ITEM = r"([0-9]+)([MIDNSHP=X<>])"


def parse(cigar: Column) -> Column:
    """Operations of a CIGAR (CIG1); an error where it isn't one."""
    sizes, ops = F.regexp_extract_all(cigar, F.lit(_ITEM), F.lit(1)), F.regexp_extract_all(cigar, F.lit(_ITEM), F.lit(2))
    out = F.zip_with(ops, sizes, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))
    return F.when(cigar.rlike(f"^({_ITEM})*$"), out).otherwise(F.raise_error(F.concat(F.lit("no CIGAR: "), cigar)).cast(OPS))


def render(ops: Column) -> Column:
    """CIG2."""
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def simplify(ops: Column) -> Column:
    """Neighbours of one kind among M, D and I become one; clips are left as they are (CIG3)."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(x["op"].alias("op"), (last["len"] + x["len"]).alias("len"))))
        return F.when((last["op"] == x["op"]) & x["op"].isin("M", "D", "I"), joined).otherwise(F.concat(done, F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"))))).cast(OPS)

    return F.aggregate(ops, F.array().cast(OPS), add)


def expand(ops: Column, reference: Column, read: Column, start: Column | None = None) -> Column:
    """(ref_aln, read_aln) of ungapped sequences; M, =, X use both, D and N the reference, I and S the read, H and P nothing (CIG4).

    With start, both are padded on the left by the reference before it, against gaps (CIG5).
    """
    at = F.lit(0) if start is None else start
    state = lambda r, q, x, y: F.struct(r.alias("r"), q.alias("q"), x.alias("ref_aln"), y.alias("read_aln"))
    gaps = lambda n: F.repeat(F.lit("-"), n)

    def step(a: Column, x: Column) -> Column:
        uses_ref, uses_read = x["op"].isin("M", "=", "X", "D", "N"), x["op"].isin("M", "=", "X", "I", "S")
        any_ = uses_ref | uses_read
        ref = F.when(uses_ref, F.substr(reference, a["r"] + 1, x["len"])).when(any_, gaps(x["len"])).otherwise("")
        own = F.when(uses_read, F.substr(read, a["q"] + 1, x["len"])).when(any_, gaps(x["len"])).otherwise("")
        return state(a["r"] + F.when(uses_ref, x["len"]).otherwise(0), a["q"] + F.when(uses_read, x["len"]).otherwise(0), F.concat(a["ref_aln"], ref), F.concat(a["read_aln"], own))

    first = state(at.cast("int"), F.lit(0), F.lit("") if start is None else F.substr(reference, F.lit(1), at), F.lit("") if start is None else gaps(at))
    return F.aggregate(ops, first, step, lambda a: F.struct(a["ref_aln"].alias("ref_aln"), a["read_aln"].alias("read_aln")))


def of_pair(ref_aln: Column, read_aln: Column) -> Column:
    """Operations of a gapped pair (CIG6); columns of two gaps have none."""
    kind = F.zip_with(F.split(ref_aln, ""), F.split(read_aln, ""), lambda x, y: F.when((x == "-") & (y == "-"), "").when(y == "-", "D").when(x == "-", "I").otherwise("M"))
    runs = F.regexp_extract_all(F.array_join(kind, ""), F.lit("(M+|D+|I+)"), F.lit(1))
    return F.transform(runs, lambda x: F.struct(F.substr(x, F.lit(1), F.lit(1)).alias("op"), F.length(x).alias("len")))


def fits(ops: Column, ref_aln: Column, read_aln: Column) -> Column:
    """Whether operations describe a gapped pair (CIG7)."""
    return (F.length(ref_aln) == F.length(read_aln)) & (render(simplify(ops)) == render(of_pair(ref_aln, read_aln)))


def pair_score(ref_aln: Column, read_aln: Column, match: float, mismatch: float, gap_open: float, gap_extend: float) -> Column:
    """Affine score of a gapped pair: a gap of n costs gap_open + n * gap_extend (CIG8)."""
    both = F.zip_with(F.split(ref_aln, ""), F.split(read_aln, ""), lambda x, y: F.when((x == "-") & (y == "-"), 0.0).when((x == "-") | (y == "-"), gap_extend).when(x == y, match).otherwise(mismatch))
    opened = F.size(F.filter(of_pair(ref_aln, read_aln), lambda o: o["op"] != "M"))
    return F.aggregate(both, F.lit(0.0), lambda a, x: a + x) + opened * F.lit(float(gap_open))


def stretch(native: Column, gapped: Column) -> Column:
    """The ungapped sequence with the gaps of another sequence's alignment, those at the end too (CIG10)."""
    step = lambda a, c: F.struct((a["at"] + (c != "-").cast("int")).alias("at"), F.concat(a["out"], F.when(c == "-", "-").otherwise(F.substr(native, a["at"] + 1, F.lit(1)))).alias("out"))
    return F.aggregate(F.split(gapped, ""), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: a["out"])


def match_rate(ref_aln: Column, read_aln: Column) -> Column:
    """Matches over aligned columns: reference a letter other than N, read a letter; case counts. Null where there is none (CIG11)."""
    both = F.zip_with(F.split(ref_aln, ""), F.split(read_aln, ""), lambda x, y: F.when((F.ascii(x) > 64) & (x != "N") & (F.ascii(y) > 64), (x == y).cast("int")))
    both = F.filter(both, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(both, F.lit(0), lambda a, x: a + x), F.size(both))


def enough_aligned(ref_aln: Column, read_aln: Column, least: int = 45, rate: float = 0.8) -> Column:
    """The read filter FLT2: columns whose reference is above code 59 and not N, and whose read is above 59; at least so many, and such a share equal."""
    both = F.zip_with(F.split(ref_aln, ""), F.split(read_aln, ""), lambda x, y: F.when((F.ascii(x) > 59) & (x != "N") & (F.ascii(y) > 59), (x == y).cast("int")))
    both = F.filter(both, lambda x: x.isNotNull())
    return (F.size(both) >= least) & F.coalesce(F.try_divide(F.aggregate(both, F.lit(0), lambda a, x: a + x), F.size(both)) >= rate, F.lit(False))
