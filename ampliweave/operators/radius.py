"""Radius joins as equi-joins (JON2 to JON4, JON14, CLU2).

A string with at most d differences from another has one of its d + 1 segments unharmed. So pairs are found by equal segments (at offsets of up to d where
characters may be inserted or deleted) and verified before they are shuffled again; no cross join. A segment is a join key like any other: adaptive execution splits a
frequent one. Inputs are sets of distinct strings.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

#: Shortened forms of a string that may be join keys.
MOST_KEYS = 200
#: Partitions for each core of strings that become keys.
PARTS = 4


def _bounds(s: Column, i: int, parts: int) -> tuple[Column, Column]:
    """First place (from 0) and length of the i-th of so many segments."""
    n = F.length(s)
    first = F.floor(n * i / parts).cast("int")
    return first, F.floor(n * (i + 1) / parts).cast("int") - first


def _segments(s: Column, parts: int) -> Column:
    """Array of (i, n, text): n is the length of the string."""
    out = []
    for i in range(parts):
        first, size = _bounds(s, i, parts)
        out.append(F.struct(F.lit(i).alias("i"), F.length(s).alias("n"), F.substr(s, first + 1, size).alias("text")))
    return F.array(*out)


def _dealt(df: DataFrame) -> DataFrame:
    """df over all cores: distinct short strings are few bytes, so that they may be one partition, and each becomes many keys."""
    return df.repartition(PARTS * df.sparkSession.sparkContext.defaultParallelism)


def _masked(s: Column, n: int, d: int) -> Column:
    """Array of (i, n, text, more): the strings of n characters that are left when d characters of s are taken out, each with the characters taken; i names the places."""
    out = []
    for i, places in enumerate(combinations(range(n), d)):
        bounds = [-1, *places, n]
        kept = [F.substr(s, F.lit(x + 2), F.lit(y - x - 1)) for x, y in zip(bounds, bounds[1:]) if y - x > 1]
        out.append(F.struct(F.lit(i).alias("i"), F.length(s).alias("n"), F.concat(*kept).alias("text"), F.concat(*[F.substr(s, F.lit(p + 1), F.lit(1)) for p in places]).alias("more")))
    return F.array(*out)


def masked_pairs(left: DataFrame, right: DataFrame, a: str, b: str, n: int, d: int, by: Sequence[str] = ()) -> DataFrame:
    """hamming_pairs() of strings that all have n characters: they meet by what is left when d characters are taken out, so a key has as many strings as there are ways to put
    d characters back, however many strings there are. A pair counts once: of the ways to take its differences out the one whose other places are the first."""
    first = []
    for places in combinations(range(n), d):
        # the differences of a pair that counts here: whatever other places of the mask are equal are the least that differ from none
        ok = [sum(1 << k for k in range(d) if k in some) for size in range(1, d + 1) for some in map(set, combinations(range(d), size)) if _first(places, some, n)]
        first.append(F.array(*[F.lit(x) for x in sorted({*ok, 0} if places == tuple(range(d)) else ok)]))
    x = _dealt(left.where(F.length(a) == n)).select(*by, a, F.explode(_masked(F.col(a), n, d)).alias("__x"))
    y = _dealt(right.where(F.length(b) == n)).select(*by, b, F.explode(_masked(F.col(b), n, d)).alias("__y"))
    key = lambda df, s: df.withColumns({"__i": F.col(f"{s}.i"), "__t": F.col(f"{s}.text"), s: F.col(f"{s}.more")})
    pairs = key(x, "__x").join(key(y, "__y").hint("merge"), [*by, "__i", "__t"])  # the size of what is exploded is unknown when the plan is made: it may not be broadcast
    differs = [(F.substr("__x", F.lit(k + 1), F.lit(1)) != F.substr("__y", F.lit(k + 1), F.lit(1))).cast("int") for k in range(d)]
    which = sum((c * (1 << k) for k, c in enumerate(differs)), F.lit(0))
    counts = F.array_contains(F.get(F.array(*first), F.col("__i")), which)
    return pairs.where(counts).select(*by, a, b, sum(differs, F.lit(0)).alias("distance"))


def _first(places: tuple[int, ...], some: set[int], n: int) -> bool:
    """Whether places are those of the differences (some of them, by number) and, for the rest, the least places beside these."""
    apart = {places[k] for k in some}
    rest = [p for p in range(n) if p not in apart][: len(places) - len(apart)]
    return sorted(apart | set(rest)) == list(places)


def hamming_pairs(left: DataFrame, right: DataFrame, a: str, b: str, d: int, by: Sequence[str] = (), length: int | None = None) -> DataFrame:
    """(by, a, b, distance) of equally long strings at d or less, with equal columns in by. left has column a, right column b.

    length: how long most strings are. Where d characters can be taken out of one of that length in MOST_KEYS ways at most, these meet by what is left; segments of so short
    strings are few, so that the pairs that share one grow with the square of the strings. Strings of other lengths meet by segments.
    """
    if length is not None and 0 < d < length and comb(length, d) <= MOST_KEYS:
        short = masked_pairs(left, right, a, b, length, d, by)
        return short.unionByName(hamming_pairs(left.where(F.length(a) != length), right.where(F.length(b) != length), a, b, d, by))
    x = left.select(*by, a, F.explode(_segments(F.col(a), d + 1)).alias("seg"))
    y = right.select(*by, b, F.explode(_segments(F.col(b), d + 1)).alias("seg"))
    pairs = x.join(y, [*by, "seg"]).withColumn("distance", S.hamming(F.col(a), F.col(b))).where(F.col("distance") <= d)
    return pairs.select(*by, a, b, "distance").distinct()


def _shortened(s: Column, d: int) -> Column:
    """Array of the distinct strings that are left when up to d characters of s are taken out."""
    every = last = F.array(s)
    for _ in range(d):
        one = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda v: F.length(v) > 0), one)))
        every = F.concat(every, last)
    return F.array_distinct(every)


def levenshtein_pairs(left: DataFrame, right: DataFrame, a: str, b: str, d: int, by: Sequence[str] = (), length: int | None = None) -> DataFrame:
    """(by, a, b, distance) of strings at edit distance d or less, with equal columns in by; strings of d characters or fewer meet by length alone.

    length: how long the strings are, about. Short ones, with MOST_KEYS ways at most to take up to d characters out, meet by what is left, which few others share; long
    ones, and those of an unknown length, by segments. Both ways find all pairs, whatever the lengths.
    """
    if length is not None and sum(comb(length, i) for i in range(d + 1)) <= MOST_KEYS:
        x = _dealt(left).select(*by, a, F.explode(_shortened(F.col(a), d)).alias("seg"))
        y = _dealt(right).select(*by, b, F.explode(_shortened(F.col(b), d)).alias("seg"))
        pairs = x.join(y.hint("merge"), [*by, "seg"]).withColumn("distance", F.levenshtein(a, b, d)).where(F.col("distance") >= 0)
        return pairs.select(*by, a, b, "distance").distinct()
    y = right.select(*by, b, F.explode(_segments(F.col(b), d + 1)).alias("seg"))
    looks = []
    for i in range(d + 1):
        for delta in range(-d, d + 1):  # n of the other string is n - delta
            n = F.length(a) - delta
            first = F.floor(n * i / (d + 1)).cast("int")
            size = F.floor(n * (i + 1) / (d + 1)).cast("int") - first
            for offset in range(-d, d + 1):
                fits = (n >= 0) & (first + offset >= 0) & (first + offset + size <= F.length(a))
                looks.append(F.when(fits, F.struct(F.lit(i).alias("i"), n.alias("n"), F.substr(F.col(a), first + offset + 1, size).alias("text"))))
    x = left.select(*by, a, F.explode(F.array_distinct(F.array_compact(F.array(*looks)))).alias("seg"))
    pairs = x.join(y, [*by, "seg"]).withColumn("distance", F.levenshtein(a, b, d)).where(F.col("distance") >= 0)
    return pairs.select(*by, a, b, "distance").distinct()


def corrected(tags: DataFrame, whitelist: DataFrame, d: int, metric: str = "levenshtein", ambiguity: str | None = None, length: int | None = None) -> DataFrame:
    """(tag, corrected, distance) of the tags that the whitelist settles. tags: tag; whitelist: seq; both distinct.

    An exact hit wins. Otherwise ambiguity "unique_hit" wants a single entry within d (the rule with Hamming distance), "unique_min" a single nearest
    one (the rule with edit distance). Other tags are left out (FLT9).
    """
    ambiguity = ambiguity or {"hamming": "unique_hit", "levenshtein": "unique_min"}[metric]
    exact = tags.join(whitelist, tags.tag == whitelist.seq).select("tag", F.col("seq").alias("corrected"), F.lit(0).alias("distance"))
    rest = tags.join(whitelist, tags.tag == whitelist.seq, "left_anti").select("tag")
    listed = whitelist.select("seq")
    pairs = hamming_pairs(rest, listed, "tag", "seq", d) if metric == "hamming" else levenshtein_pairs(rest, listed, "tag", "seq", d, length=length)
    by_distance = pairs.groupBy("tag", "distance").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    near = by_distance.groupBy("tag").agg(F.min(F.struct("distance", "n", "seq")).alias("best"), F.sum("n").alias("hits"))
    near = near.where("hits = 1" if ambiguity == "unique_hit" else "best.n = 1")
    return exact.unionByName(near.select("tag", F.col("best.seq").alias("corrected"), F.col("best.distance").alias("distance")))


def close_pairs(strings: DataFrame, column: str, d: int, metric: str = "levenshtein", length: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b of one set of strings (JON14, CLU2). length: how long most of them are, if that is known."""
    left, right = strings.select(F.col(column).alias("a")).distinct(), strings.select(F.col(column).alias("b")).distinct()
    return {"hamming": hamming_pairs, "levenshtein": levenshtein_pairs}[metric](left, right, "a", "b", d, length=length).where("a < b")
