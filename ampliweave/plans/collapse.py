"""The collapse job: aligned reads to one consensus read for each group of corrected tags (PIPE2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import tags as T
from ..operators import consensus, correct, filters
from ..tables import cut


def with_tags(aligned: DataFrame, symbols: dict[str, str], reference: str = "ref_aln") -> DataFrame:
    """aligned with a column for each tag, by the symbol that marks it in the reference."""
    return aligned.withColumns({name: T.extract(F.col(reference), F.col("read_aln"), s) for name, s in symbols.items()})


def usable(aligned: DataFrame, least: int = 45, rate: float = 0.8) -> DataFrame:
    """Primary, mapped reads that are well aligned (FLT1, FLT2)."""
    return aligned.where(filters.primary(F.col("flag"))).where(C.enough_aligned(F.col("ref_aln"), F.col("read_aln"), least, rate))


def collapse(aligned: DataFrame, levels: Sequence[correct.Level], mode: str = "collapse", name: str = "read_id", quality: Column | None = None, ref: str = "ref_name") -> DataFrame:
    """mode "correct": every read with its corrected tags; "collapse": one consensus read for each reference and tags.

    All references go through one plan; the reference leads every key.
    """
    corrected = correct.hierarchical(aligned, levels, ref)
    if mode == "correct":
        return corrected
    if mode != "collapse":
        raise ValueError(f"unknown mode: {mode}")
    return consensus.collapse(cut(corrected, "corrected"), [ref, *(f"{x.column}_corr" for x in levels)], name, quality)
