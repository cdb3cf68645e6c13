"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training progress t in [0, 1]: knots (t, w), linear in between. Its integral W gives the source's share of all words (the targets,
water-filled so that none is above MOST times its source's size) and its cumulative demand target * W(t) / W(1). A source's documents, in the order
of a hash, are laid end to end, epoch after epoch, until the target is used up; a copy that starts after c words takes the training position t at
which the cumulative demand reaches c, found by inverting the integral. Documents are range-sorted by position.

Prefix sums are distributed: documents fall into BUCKETS buckets of the hash for each source; a window runs within each (source, bucket), and another one over the
sums of the buckets. So a source of a third of all rows is ordered by thousands of tasks, and no window holds more than its 1/BUCKETS; rows without a
doc_id are dealt by their text. plan() reads the texts once, for their sizes, and shuffles sizes, ids and hashes; mix() also moves whole rows twice, to their bucket
and to their place in training order. Where a part of the training order ends is known beforehand: the words due before position t are the integrals of the
schedules up to t, so rows are range-partitioned without a sample.

Nulls: a null text has size 0, takes 0 words and has no copy; a null source is a source of its own, last in order; a null doc_id sorts by its text's hash.
Repeated rows are documents of their own; which of two equal rows comes first makes no difference. No words at all: all targets are 0. An empty table gives
an empty result. Further columns are passed on by mix(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

BUCKETS = 4096
#: Times its size that a source, and so a document, is used at most.
MOST = 3
#: Weights by the rank of the source, repeating, as schedules of equal integral 1, 2 and 3: the first is phased out, the last one phased in.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (0.5, 3.0), (1.0, 4.5)))
_P = "__mix_"


def integral(schedule: Sequence[tuple[float, float]]) -> float:
    return sum((u - t) * (v + w) / 2 for (t, v), (u, w) in zip(schedule, schedule[1:]))


def word_count(text: Column) -> Column:
    """Words of a text: once it is trimmed, words with what follows them tile it, and each becomes one character."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(trimmed, f"{WORD}[\\x20\\x09-\\x0D]*", "x")).cast("long")


def targets(sizes: DataFrame, curriculum=CURRICULUM, most: int = MOST) -> DataFrame:
    """source, source_size, target and knots, from rows of (source, size). One row a source; sources are few, documents many.

    With level L, a source's target is min(most * size, L * weight); L spends all words. The sources that stop are those of least most * size / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    knots, weights = [], []
    for schedule in curriculum:
        done, rows = 0.0, []
        for (t, v), (u, w) in zip(schedule, schedule[1:]):
            rows.append(F.struct(F.lit(float(t)).alias("t"), F.lit(done).alias("done"), F.lit(float(v)).alias("w"), F.lit((w - v) / (u - t)).alias("slope")))
            done += (u - t) * (v + w) / 2
        knots.append(F.array(*rows))
        weights.append(F.lit(float(done)))
    turn = (F.pmod(rank, F.lit(len(curriculum))) + 1).cast("int")
    df = by_source.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*weights), F.col("turn"))).withColumn("knots", F.element_at(F.array(*knots), F.col("turn")))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    df = (
        df.withColumn("total", F.sum("source_size").over(all_))
        .withColumn("left", F.col("total") - F.coalesce(most * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # this source and those after it share what is left while none stops; the first row where this one doesn't stop has the level
        .withColumn("stops", F.col("left") * F.col("weight") > most * F.col("source_size") * F.col("weight_left"))
        .withColumn("stopped", F.count_if("stops").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("first", F.min(F.when(~F.col("stops"), F.struct("place", "left", "weight_left"))).over(all_))
    )
    open_ = F.col("place") >= F.col("first.place")
    target = F.when(open_, F.col("first.left") * F.col("weight") / F.col("first.weight_left")).otherwise((most * F.col("source_size")).cast("double"))
    df = df.withColumn("target", target)
    due = F.array(*[F.sum(F.when(F.col("turn") == k + 1, F.col("target")).otherwise(0.0)).over(all_) for k in range(len(curriculum))])
    return df.select("source", "source_size", "target", F.col("weight").alias("integral"), "knots", due.alias("due"))


def _position(words: Column) -> Column:
    """The t at which the source's cumulative demand is ``words``: in the last knot's segment that starts below, w * d + slope * d^2 / 2 = rest."""
    need = words / F.col(_P + "target") * F.col(_P + "integral")
    knot = F.element_at(F.filter(_P + "knots", lambda k: k["done"] <= need), -1)
    rest = F.greatest(need - knot["done"], F.lit(0.0))
    root = F.sqrt(F.greatest(knot["w"] * knot["w"] + 2 * knot["slope"] * rest, F.lit(0.0)))
    return F.least(knot["t"] + F.when(rest == 0, 0.0).otherwise(2 * rest / (knot["w"] + root)), F.lit(1.0))


def _due_before(t: Column, due: Column, curriculum) -> Column:
    """The share of all words whose position is before t; due: the words of the sources of each schedule."""
    words, all_words = F.lit(0.0), F.lit(0.0)
    for k, schedule in enumerate(curriculum):
        done = F.lit(0.0)
        for (a, v), (b, w) in zip(schedule, schedule[1:]):
            x = F.greatest(F.lit(0.0), F.least(t, F.lit(float(b))) - float(a))
            done = done + x * (v + x * ((w - v) / (b - a) / 2))
        words = words + due[k] * done / integral(schedule)
        all_words = all_words + due[k]
    return words / all_words


def plan(docs: DataFrame, curriculum=CURRICULUM, most: int = MOST, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: an array of (epoch, words, position), due: the words of the sources of each schedule,
    and the columns named in keep (they may not clash).

    The last copy of the document at the target's edge has fewer words than the document; they are what is left of the target, rounded down.
    """
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # null-free, so window and join share one partitioning
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    first = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), BUCKETS + F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int")).otherwise(first)
    own = [name.alias("_s"), bucket.alias("_bucket"), "source", word_count(text_of()).alias("size")]
    rows = docs.select("doc_id", *own, digest.alias("_h"), F.xxhash64("text").alias("_x"), *keep)
    if not keep:
        rows = cut(rows, "mix-sizes")
    sums = cut(rows.groupBy("_s", "_bucket", "source").agg(F.sum("size").alias("size")), "mix-sums")  # sources times 2 * BUCKETS rows at most
    starts = sums.select("_s", "_bucket", "source", (F.sum("size").over(W.partitionBy("_s").orderBy("_bucket")) - F.col("size")).alias("_before"))
    by_source = targets(sums.select("source", "size"), curriculum, most).withColumn("_s", name)
    table = starts.drop("source").join(by_source, "_s").select(
        F.col("_s").alias(_P + "s"), F.col("_bucket").alias(_P + "bucket"), "_before", "source_size", "target",
        F.col("target").alias(_P + "target"), F.col("integral").alias(_P + "integral"), F.col("knots").alias(_P + "knots"), F.col("due").alias(_P + "due"),
    )
    in_order = W.partitionBy("_s", "_bucket").orderBy("_h", F.col("doc_id").asc_nulls_last(), "size", "_x")
    rows = rows.withColumn("_in", F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    df = rows.join(table, (F.col("_s") == F.col(_P + "s")) & (F.col("_bucket") == F.col(_P + "bucket")))
    df = df.withColumn("_at", F.col("_before") + F.col("_in"))
    goal = F.floor("target")
    epochs = F.sequence(F.lit(0), F.lit(most - 1)) if most > 1 else F.array(F.lit(0))
    words = lambda e: F.greatest(F.lit(0), F.least(F.col("size"), goal - e * F.col("source_size") - F.col("_at")))
    copies = F.transform(epochs, lambda e: F.struct(e.alias("epoch"), words(e).cast("long").alias("words"), _position((e * F.col("source_size") + F.col("_at")).cast("double")).alias("position")))
    copies = F.filter(copies, lambda c: c["words"] > 0)
    df = df.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.array().cast("array<struct<epoch:int,words:bigint,position:double>>")))
    return df.select("doc_id", "source", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"), "copies", F.col(_P + "due").alias("due"), *keep)


def mix(docs: DataFrame, curriculum=CURRICULUM, most: int = MOST) -> DataFrame:
    """docs in training order, each row as often as the mix takes it, with all columns and no others.

    Texts stay whole: the document at a source's edge is taken once more if at least half of its words are due.
    """
    whole = docs.withColumn(_P + "row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    df = plan(whole, curriculum, most, keep=(_P + "row",))
    whole = F.filter("copies", lambda c: 2 * c["words"] >= F.col("size"))
    out = df.select(F.explode(whole).alias("_copy"), "due", _P + "row").select(F.col("_copy.position").alias("_position"), "due", F.col(_P + "row"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(_due_before(F.col("_position"), F.col("due"), curriculum) * parts), F.lit(parts - 1)).cast("int")
    return out.repartitionById(parts, part).sortWithinPartitions("_position").select(F.col(_P + "row.*"))


def in_training_order(planned: DataFrame) -> DataFrame:
    """plan()'s rows, range-sorted by the position of the first copy; documents that the mix leaves out come last."""
    df = planned.withColumn("first_position", F.try_element_at("copies", F.lit(1))["position"]).withColumn("_sort", F.coalesce("first_position", F.lit(2.0)))
    df = df.withColumn("_tie", F.xxhash64("doc_id", "size"))  # what the mix leaves out has one place, which may be that of most rows
    df = cut(df, "mix-plan")  # the sort reads it twice, for its bounds and for its rows
    return df.repartitionByRange("_sort", "_tie").sortWithinPartitions("_sort", "_tie").drop("_sort", "_tie")
