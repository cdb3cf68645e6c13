"""Cells, integrations and barcode lists (JON8 to JON13, AGG12, AGG13, SET1, SET2), and calls at targets (PIPE4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import events as E
from ..functions import sequence as S
from ..tables import parts_of


def address(df: DataFrame, tags: Sequence[str], name: str = "cell") -> DataFrame:
    """Tag values joined by dots (AGG12)."""
    return df.withColumn(name, F.concat_ws(".", *tags))


def reads_of_cells(df: DataFrame, cell: str = "cell", read: str = "read_id") -> DataFrame:
    """(cell, reads: array in order, n) (AGG12)."""
    return df.groupBy(cell).agg(F.array_sort(F.collect_list(read)).alias("reads"), F.count("*").alias("n"))


def outcomes(df: DataFrame, cell: str, integration: str, outcome: str, count: str) -> DataFrame:
    """(cell, integration, outcomes in order, count) (AGG13)."""
    return df.groupBy(cell, integration).agg(F.array_sort(F.collect_list(outcome)).alias("outcomes"), F.sum(count).alias("count"))


def known_and_unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row (known, unknown): rows of df whose key is in the list or not (JON9, JON11)."""
    listed = known.select(key).distinct().withColumn("__known", F.lit(True))
    return df.join(listed, key, "left").agg(F.count_if(F.col("__known").isNotNull()).alias("known"), F.count_if(F.col("__known").isNull()).alias("unknown"))


def missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of df that the other table lacks (JON8, SET2)."""
    return df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")


def is_subset(df: DataFrame, other: DataFrame, key: str) -> bool:
    """SET1."""
    return missing(df, other, key).isEmpty()


def translated(df: DataFrame, translation: DataFrame, source: str, target: str) -> DataFrame:
    """df with target by a translation table (source, target); the query fails on a key that it lacks (JON10)."""
    last = translation.select(source, target)
    joined = df.join(last, source, "left")
    return joined.withColumn(target, F.coalesce(target, F.raise_error(F.concat(F.lit("no translation: "), F.col(source).cast("string"))).cast(last.schema[target].dataType)))


def integrations(df: DataFrame, known: DataFrame, cell: str, integration: str, above: int = 4000) -> DataFrame:
    """(integration, cells, n) of known ids in more than so many rows (JON12).

    Rows are dealt to partitions in proportion to the input and counted by id and cell, then by id; the list is joined with what is left.
    """
    own = df.where(F.col(integration).isNotNull()).select(integration, cell)
    each = own.repartition(parts_of(own), integration, cell).groupBy(integration, cell).agg(F.count("*").alias("n"))
    counted = each.groupBy(integration).agg(F.count(cell).alias("cells"), F.sum("n").alias("n")).where(F.col("n") > above)
    return counted.join(known.select(integration).distinct(), integration)


def events_in_windows(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events (start, stop) with targets (lo, hi) that they overlap, ends included (JON13).

    Both sides are dealt by the bins of WIDTH places that they touch, and a pair counts in the first bin that both have: an equi-join, no nested loop.
    """
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / WIDTH), F.floor(F.col(b) / WIDTH))
    e = events.withColumn("__bin", F.explode(bins("start", "stop")))
    t = targets.withColumn("__bin", F.explode(bins("lo", "hi")))
    first = F.floor(F.greatest("start", "lo") / WIDTH)
    return e.join(t, "__bin").where(E.overlaps(F.col("start"), F.col("stop"), F.col("lo"), F.col("hi")) & (F.col("__bin") == first)).drop("__bin")


#: Places in a bin of events_in_windows().
WIDTH = 64


def call_targets(aligned: DataFrame, targets: DataFrame, key: str = "read_id") -> DataFrame:
    """key, ref_name, target, call: what an aligned read has in the editing window of each target of its reference (PIPE4).

    targets: ref_name, target (its number), kind, position and forward. References are joined by name; a hot one is split by adaptive execution. A kind without windows is an error.
    """
    windows = targets.withColumn("__w", E.window(F.col("kind"), F.col("position"), F.col("forward")))
    sure = F.when(F.col("__w.lo").isNull(), F.raise_error(F.concat(F.lit("no target: "), F.coalesce("kind", F.lit("null")))).cast("int")).otherwise(F.col("__w.lo"))
    windows = windows.select("ref_name", "target", sure.alias("__lo"), F.col("__w.hi").alias("__hi"))
    events = E.from_cigar(C.of_pair(F.col("ref_aln"), F.col("read_aln")), S.strip_gaps(F.col("read_aln")))
    rows = aligned.select(key, "ref_name", events.alias("__events")).join(windows, "ref_name")
    return rows.select(key, "ref_name", "target", E.at_target(F.col("__events"), F.col("__lo"), F.col("__hi")).alias("call"))
