"""Tags in gapped pairs (TAG*, FLT4, FLT5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequence as S


def extract(ref_aln: Column, read_aln: Column, symbol: str) -> Column:
    """What the read has where the reference has the symbol, gaps included; insertions inside of a tag are not in it (TAG1)."""
    pairs = F.arrays_zip(F.split(ref_aln, "").alias("r"), F.split(read_aln, "").alias("q"))
    return F.array_join(F.transform(F.filter(pairs, lambda x: x["r"] == symbol), lambda x: x["q"]), "")


def regions(ref_aln: Column, read_aln: Column) -> Column:
    """Array of (reference, read) of capture regions: runs that an upper-case letter opens and that go on over upper-case letters, gaps and digits (TAG1)."""

    def step(a: Column, x: Column) -> Column:
        inside = F.size(a["open"]) > 0
        up, keep = x["r"].rlike("^[A-Z]$"), x["r"].rlike("^[-0-9]$")
        more = up | (inside & keep)
        piece = F.array(F.struct(x["r"].alias("r"), x["q"].alias("q")))
        closed = F.when(inside & ~more, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        return F.struct(closed.alias("done"), F.when(more, F.concat(a["open"], piece)).otherwise(F.array().cast("array<struct<r:string,q:string>>")).alias("open"))

    kind = "array<struct<r:string,q:string>>"
    pairs = F.arrays_zip(F.split(ref_aln, "").alias("r"), F.split(read_aln, "").alias("q"))
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("open"))
    runs = F.aggregate(pairs, begin, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    text = lambda run, f: F.array_join(F.transform(run, lambda x: x[f]), "")
    return F.transform(runs, lambda run: F.struct(text(run, "r").alias("reference"), text(run, "q").alias("read")))


def valid(tag: Column, length: int, max_gaps: int | None = None) -> Column:
    """The configured length, and at most max_gaps gaps (FLT4)."""
    ok = F.coalesce(F.length(tag) == length, F.lit(False))
    return ok if max_gaps is None else ok & (F.length(tag) - F.length(S.strip_gaps(tag)) <= max_gaps)


def near_length(tag: Column, length: int, max_distance: int) -> Column:
    """Gapless length within max_distance of the configured one (FLT5)."""
    return F.length(S.strip_gaps(tag)).between(length - max_distance, length + max_distance)


def flanks(ref_aln: Column, read_aln: Column, width: int = 10) -> Column:
    """Array of shares of equal bases on each side of each run of tag symbols, over the nearest width columns in which the reference has a letter other than N (WIN3)."""
    pairs = F.arrays_zip(F.split(ref_aln, "").alias("r"), F.split(read_aln, "").alias("q"))
    mark = lambda x: F.when(x["r"].rlike("^[0-9]$"), "T").when(~x["r"].rlike("^[A-MO-Za-mo-z]$"), "").when(x["r"] == x["q"], "1").otherwise("0")
    parts = F.split(F.array_join(F.transform(pairs, mark), ""), "T+")
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.right(p, F.lit(width)))
    after = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.left(p, F.lit(width)))
    sides = F.filter(F.concat(before, after), lambda p: F.length(p) > 0)
    return F.transform(sides, lambda p: F.length(F.replace(p, F.lit("0"), F.lit(""))) / F.length(p))


def well_flanked(ref_aln: Column, read_aln: Column, least: float = 0.5, width: int = 10) -> Column:
    """No side of a tag is below the least share of equal bases (FLT3); a reference without tags passes."""
    return F.forall(flanks(ref_aln, read_aln, width), lambda share: share >= least)
