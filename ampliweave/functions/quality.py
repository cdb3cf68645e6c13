"""Quality math (QUAL*). Qualities are raw Phred numbers unless a name says ascii."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLELES = ("A", "C", "G", "T", "N")


def ascii_to_error(q: Column) -> Column:
    """Error probability of a quality that is an ASCII code from 33 on (QUAL1)."""
    return F.pow(F.lit(10.0), -(q - 33) / 10.0)


def error_to_ascii(p: Column) -> Column:
    """ASCII code of an error probability, cut off to an integer within a byte (QUAL2)."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(-10 * F.log10(p) + 33, 9)))).cast("int")


def combine_ascii(q1: Column, q2: Column, agree: bool, compat: bool = False) -> Column:
    """Quality of two reads of one base (QUAL3). Where they disagree the error is that of either; compat gives the formula of older results."""
    p1, p2 = ascii_to_error(q1), ascii_to_error(q2)
    if agree:
        return error_to_ascii(p1 * p2)
    return error_to_ascii(1 - (1 - p2) * p1 if compat else F.least(F.lit(1.0), F.greatest(p1, p2) / (p1 + p2)))


def phred_to_error(q: Column) -> Column:
    """QUAL4."""
    return F.pow(F.lit(10.0), -q / 10.0)


def certainty_to_phred(p: Column) -> Column:
    """Quality, 0 to 40, of a probability to be right; 0 for NaN and below 1e-8 (QUAL5)."""
    return F.when(F.isnan(p) | (p < 1e-8), 0).otherwise(F.least(F.lit(40), F.round(-10 * F.log10(F.lit(1 + 1e-11) - p)).cast("int")))


def allele_log2(base: Column, q: Column, reference: Column, prior: float, total: Callable[[Column], Column] = F.sum) -> list[Column]:
    """log2 of prior times likelihood of each allele, as sums over the rows of a group (QUAL6). reference: a column that is constant in it.

    Bases that are no allele count for nothing. total may be another sum, such as one over a window.
    """
    error = phred_to_error(q)
    known = F.upper(base).isin(*ALLELES)
    start = lambda a: F.when(F.upper(reference) == a, F.lit(prior)).otherwise(F.lit((1 - prior) / 4))
    own = lambda a: F.when(known, F.when(F.upper(base) == a, F.log2(1 - error)).otherwise(F.log2(error / 3))).otherwise(F.lit(0.0))
    return [F.log2(start(a)) + total(own(a)) for a in ALLELES]


def normalised(logs: list[Column]) -> list[Column]:
    """Probabilities from log2 values (QUAL7); the greatest is taken off first, so long sums don't vanish."""
    top = F.greatest(*logs)
    powers = [F.pow(F.lit(2.0), x - top) for x in logs]
    whole = powers[0]
    for p in powers[1:]:
        whole = whole + p
    return [p / whole for p in powers]
