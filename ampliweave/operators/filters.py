"""Read filters and their counts (FLT1, FLT6 to FLT8, AGG8, UDF1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNMAPPED, SECONDARY = 0x4, 0x100


def primary(flag: Column) -> Column:
    """Mapped and not secondary (FLT1); supplementary and duplicate reads pass."""
    return flag.bitwiseAND(F.lit(UNMAPPED | SECONDARY)) == 0


def lineage_read(seq: Column, rate: Column, count: Column, anchors: Sequence[str], least_rate: float, least_count: int) -> Column:
    """Alignment rate and read count from their least values on, and any anchor in the sequence (FLT6)."""
    if isinstance(anchors, str):
        raise TypeError("anchors is a list of sequences")
    has = F.lit(False)
    for a in anchors:
        has = has | F.contains(seq, F.lit(a))
    return (rate >= least_rate) & (count >= least_count) & has


def fitting_length(n: Column, longest_reference: int, multiplier: float, least: int = 0) -> Column:
    """Read length from least on and below (longest reference + 1) * multiplier (FLT7, FLT8)."""
    return (n >= least) & (n < (longest_reference + 1) * multiplier)


#: Predicates by name; register() adds to them, and keep() uses them (UDF1).
REGISTRY: dict[str, Callable[..., Column]] = {"primary": primary, "lineage_read": lineage_read, "fitting_length": fitting_length}


def register(name: str, predicate: Callable[..., Column]) -> None:
    REGISTRY[name] = predicate


def keep(df: DataFrame, *predicates: tuple) -> DataFrame:
    """Rows that pass all of (name, *arguments)."""
    for name, *arguments in predicates:
        df = df.where(REGISTRY[name](*arguments))
    return df


def counts(df: DataFrame, **failures: Column) -> DataFrame:
    """One row: total, the rows of each kind of failure (one row may have several), and passing, the rows without any (AGG8)."""
    failed = F.lit(False)
    for c in failures.values():
        failed = failed | F.coalesce(c, F.lit(False))
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in failures.items()], F.count_if(~failed).alias("passing"))


def passing(total: int, *failures: int) -> int:
    """Rows left where the failures exclude one another."""
    return total - sum(failures)
