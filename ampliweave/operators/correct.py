"""Tag correction (AGG1, AGG2, JON5, CLU1, COR2): distinct tags are corrected, and reads joined with the result.

A level corrects one tag within the groups of the reference and the tags corrected before it. Its work is on distinct (group, tag) rows with counts, so a
hot group costs as many rows as it has different tags, and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import tags as T
from ..tables import cut
from .radius import corrected, levenshtein_pairs

_SEP = "\x1f"


@dataclass(frozen=True)
class Level:
    """How one tag is corrected: by a whitelist (a DataFrame of seq, one for all references) or, without one, by clustering."""

    column: str
    length: int
    max_distance: int
    whitelist: DataFrame | None = None
    metric: str = "levenshtein"
    ratio: float = 5.0
    max_gaps: int | None = None


def distinct_tags(reads: DataFrame, groups: Sequence[str], tag: str) -> DataFrame:
    """Reads of each distinct tag in its group (AGG1)."""
    return reads.groupBy(*groups, tag).agg(F.count("*").alias("n"))


def padded(tag: Column, length: int) -> Column:
    """Gapless, with gaps up to the length at its end."""
    s = S.strip_gaps(tag)
    return F.when(F.length(s) < length, F.rpad(s, length, "-")).otherwise(s)


def clusters(tags: DataFrame, max_distance: int, ratio: float = 5.0, length: int | None = None) -> DataFrame:
    """(g, tag, root) for rows (g, tag, n): a tag goes to the neighbour within max_distance that has ratio times its reads, and with it to that one's root (CLU1).

    Among several, the one of most reads, then the nearest, then the least. Pointers are jumped until none changes; each round is a table.
    """
    named = cut(tags.select("g", "tag", "n", F.concat_ws(_SEP, "g", "tag").alias("key")), "cluster-tags")
    same_group = named.select("g", F.col("tag").alias("b"), F.col("n").alias("nb"))
    # the group is part of the join key, so only tags of one group meet
    pairs = _pairs_in_groups(named, max_distance, length)
    offers = pairs.join(named.select("g", F.col("tag").alias("a"), F.col("n").alias("na")), ["g", "a"]).join(same_group, ["g", "b"]).where(F.col("nb") >= F.col("na") * ratio)
    best = offers.groupBy("g", "a").agg(F.max(F.struct("nb", (-F.col("distance")).alias("near"), F.col("b").alias("b"))).alias("best"), F.max("nb").alias("top"))
    # of equal reads and distance the least tag, not the greatest
    ties = offers.join(best.select("g", "a", F.col("best.nb").alias("tb"), F.col("best.near").alias("tn")), ["g", "a"]).where((F.col("nb") == F.col("tb")) & (-F.col("distance") == F.col("tn")))
    parent = ties.groupBy("g", "a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "tag")
    links = cut(named.select("g", "tag").join(parent, ["g", "tag"], "left").select("g", "tag", F.coalesce("parent", "tag").alias("root")), "cluster-links")
    while True:
        up = links.select("g", F.col("tag").alias("root"), F.col("root").alias("above"))
        links_now = cut(links.join(up, ["g", "root"]).select("g", "tag", F.col("root").alias("old"), F.col("above").alias("root")), "cluster-links")
        links = links_now.select("g", "tag", "root")
        if links_now.where("old != root").isEmpty():
            return links


def _pairs_in_groups(named: DataFrame, d: int, length: int | None) -> DataFrame:
    """(g, a, b, distance) of different tags of one group within edit distance d."""
    side = lambda name: named.select("g", F.col("tag").alias(name))
    return levenshtein_pairs(side("a"), side("b"), "a", "b", d, ["g"], length).where("a != b")


def correct_level(reads: DataFrame, groups: Sequence[str], level: Level, keep_all: bool = False) -> DataFrame:
    """reads with column <tag>_corr; reads whose tag can't be corrected are left out (JON5, FLT5, FLT9), or with keep_all have null."""
    tag, out = level.column, f"{level.column}_corr"
    ok = T.valid(F.col(tag), level.length, level.max_gaps) if level.max_gaps is not None else F.lit(True)
    usable = reads.where(ok & T.near_length(F.col(tag), level.length, level.max_distance))
    counted = distinct_tags(usable.withColumn("__tag", padded(F.col(tag), level.length)), groups, "__tag")
    if level.whitelist is not None:
        listed = level.whitelist.select(padded(F.col("seq"), level.length).alias("seq")).distinct()
        found = corrected(counted.select(F.col("__tag").alias("tag")).distinct(), listed, level.max_distance, level.metric, length=level.length)
        table, on = cut(found.select(F.col("tag").alias("__tag"), F.col("corrected").alias(out)), "corrections"), ["__tag"]
    else:
        key = F.concat_ws(_SEP, *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups]) if groups else F.lit("")
        roots = clusters(counted.select(key.alias("g"), F.col("__tag").alias("tag"), "n"), level.max_distance, level.ratio, level.length)
        table, on = roots.select(F.col("g").alias("__g"), F.col("tag").alias("__tag"), F.col("root").alias(out)), ["__g", "__tag"]
        usable, reads = usable.withColumn("__g", key), reads.withColumn("__g", key)
    left = (reads if keep_all else usable).withColumn("__tag", padded(F.col(tag), level.length))
    return left.join(table, on, "left" if keep_all else "inner").drop(*on)


def hierarchical(reads: DataFrame, levels: Sequence[Level], ref: str = "ref_name") -> DataFrame:
    """AGG2: the levels one after another, each within the reference and the tags corrected so far."""
    groups = [ref]
    for level in levels:
        reads = correct_level(reads, groups, level)
        groups = [*groups, f"{level.column}_corr"]
    return reads
