"""Removal of repeated passages: a depth-limited radix sort of all byte suffixes, most significant digit first, over runs of suffixes.

Two strings of WINDOW bytes are equal exactly where two suffixes agree through WINDOW bytes. So suffixes are ordered only to that depth, by passes that each
look at one more digit and go on with the groups of at least two; a group that gets to the end is a repeated window. A pass handles suffixes
that follow each other in a text as one run with one digit:

0. Digit: the least-hashed K-gram of the suffix's first WINDOW bytes, and its place in them. It depends on those bytes only, so equal windows have equal digits; neighbouring
   suffixes mostly share it, so there is one run, and one row, for every 185 bytes of text. Runs whose K-gram is nowhere else leave.
1. Digit: all bytes that the run's windows cover. Equal runs are repeated through and through. Where a K-gram also has a run that is equal to no other, its
   distinct runs, one of each, are cut into blocks of BLOCK neighbouring suffixes.
2. Digit: the bytes that all windows of a block have in common. Blocks that are alone leave; blocks that are equal in all bytes they cover are repeated; what is
   undecided is cut into single suffixes.
3. Digit: the whole window. Equal groups are the repeated windows.

Digits are hashes of all 8-grams of what they cover, each mixed by itself, in their order: the deciding ones have 128 bits. A pass is a sum with map-side combine and joins of written tables (which Spark can split where one
passage is in a third of all texts); no group is ever gathered. Texts are shuffled once, into a bucketed table that later passes join by bucket.
Workers hold HELD bytes of texts (one text at least) and emit the rows of a buffer of BUFFER bytes at a time, however long a text is.

Nulls: a null text is empty; null doc_ids stay null. Texts shorter than WINDOW have no window. Rows of equal texts of WINDOW bytes or more lose everything.
Repeated rows count as documents of their own. Empty tables give empty results. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path

WINDOW = 400
K = 32
BLOCK = 16
#: Bytes of texts that a worker hashes at a time, and window starts in a piece of a long text.
BUFFER, STEP = 1 << 18, 1 << 17
#: Bytes of texts held as Python objects at a time (one text at least).
HELD = 1 << 22
#: Rows that go back at a time.
SENT = 1 << 14
_U = np.uint64
_PLACE = _U((1 << 19) - 1)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(m: int) -> np.ndarray:
    out = np.full(BUFFER + 1, _U(m))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(m) for m in _MULTIPLIERS]
_INVERSE = [_powers(pow(m, -1, 1 << 64)) for m in _MULTIPLIERS]


def _eights(data: bytes) -> np.ndarray:
    """A mixed number for the eight bytes at each place. Sums of these don't cancel where bytes alternate in a pattern, as sums over bytes would."""
    out = np.empty(len(data) - 7, _U)
    for i in range(8):
        own = np.frombuffer(data, np.uint64, (len(data) - i) // 8, i)
        out[i::8] = own[: len(out[i::8])]
    return _mixed(out ^ _U(0xA0761D6478BD642F))


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) for ranges first .. first + count - 1."""
    which = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return which, np.arange(len(which)) - np.repeat(before - first, count)


class Runs:
    """Runs of suffixes of a buffer of texts that share their least K-gram: text, place p of the K-gram, first and last suffix s0 and s1."""

    def __init__(self, parts: list[tuple[int, int, int, int, bytes]]):
        """parts: number of the text, where the piece starts in it, first window start and the end of window starts in it, the piece."""
        data = b"".join(p[4] for p in parts)
        n = len(data)
        values = _eights(data)
        self.sums = [np.concatenate([np.zeros(1, _U), np.cumsum(values * powers[: n - 7])]) for powers in _POWERS]
        length = np.array([len(p[4]) for p in parts])
        start = np.cumsum(length) - length
        offset = np.array([p[1] for p in parts])
        first, count = start + np.array([p[2] for p in parts]) - offset, np.array([p[3] - p[2] for p in parts])
        grams = _mixed(self.hash(0, np.arange(n - K + 1), np.arange(K, n + 1)))
        low = (grams & ~_PLACE) | np.arange(n - K + 1, dtype=_U)
        width, size = WINDOW - K + 1, 1
        while size * 2 <= width:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        part, s = _expand(first, count)
        p = (low[s] & _PLACE).astype(np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        part = part[at]
        self.p, self.s0, self.s1 = p[at], s[at], s[np.append(at[1:], len(s)) - 1]
        self.text = np.array([x[0] for x in parts])[part]
        self.shift = (offset - start)[part]  # from places in the buffer to places in the text
        self.low, self.high = start[part], (start + length)[part]
        self.gram = _mixed(grams[self.p] ^ _U(0x165667B19E3779F9))

    def hash(self, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the bytes from a to b, eight or more, wherever they are."""
        return (self.sums[m][b - 7] - self.sums[m][a]) * _INVERSE[m][a]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit digit of pass 1 of each run."""
        own = _mixed(self.gram + ((self.p - self.s0) << 20 | (self.s1 - self.s0)).astype(_U))
        return tuple(_mixed(self.hash(m, self.s0, self.s1 + WINDOW) + own) for m in (0, 1))

    def blocks(self, runs: np.ndarray) -> dict[str, np.ndarray]:
        """Blocks of the runs of these indexes: run, s0 and s1 within it, c (what all windows have), u1 and u2 (what they cover)."""
        p, gram = self.p[runs], self.gram[runs]
        j0 = (p - self.s1[runs]) // BLOCK
        which, j = _expand(j0, (p - self.s0[runs]) // BLOCK - j0 + 1)
        run, p = runs[which], p[which]
        top = p - j * BLOCK
        a, b = np.maximum(self.low[run], top - BLOCK + 1), np.minimum(self.high[run], top + WINDOW)
        own = _mixed(gram[which] + j.astype(_U))
        clipped = _mixed(own + ((a - top + BLOCK) << 20 | (top + WINDOW - b)).astype(_U))
        return {
            "run": run, "top": top, "s0": np.maximum(self.s0[run], top - BLOCK + 1), "s1": np.minimum(self.s1[run], top), "c": _mixed(self.hash(0, top, top - BLOCK + 1 + WINDOW) + own),
            "u1": _mixed(self.hash(0, a, b) + clipped), "u2": _mixed(self.hash(1, a, b) + clipped),
        }

    def windows(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_mixed(self.hash(m, s, s + WINDOW)) for m in (0, 1))


def buffers(texts: list[bytes]) -> Iterator[Runs]:
    """Runs of all suffixes with WINDOW bytes of the texts; long texts go in overlapping pieces."""
    parts: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        ends = len(text) - WINDOW + 1
        for w in range(0, ends, STEP):
            end = min(w + STEP, ends)
            a, b = max(0, w - BLOCK), min(len(text), end - 1 + WINDOW + BLOCK)
            if parts and size + b - a > BUFFER:
                yield Runs(parts)
                parts, size = [], 0
            parts.append((i, a, w, end, text[a:b]))
            size += b - a
    if parts:
        yield Runs(parts)


# -- rows of a pass ----------------------------------------------------------------------------------------------------------------------
_ROWS = "d binary, c long, u1 long, u2 long, multi boolean"
_PLACED = _ROWS + ", place long"
_EMPTY = {"text": np.int64, "place": np.int64, "c": _U, "u1": _U, "u2": _U, "multi": bool}


def _rows(parts: list[dict[str, np.ndarray]], digests: list[bytes], placed: bool = True) -> Iterator[pa.RecordBatch]:
    """Distinct digits of each text; multi: the text has it in several places, or it was so before; place: the first one."""
    x = {k: np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in _EMPTY.items()}
    order = np.lexsort((x["place"], x["u1"], x["text"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = (x["u1"][1:] != x["u1"][:-1]) | (x["text"][1:] != x["text"][:-1])
    more = x["multi"]
    more[1:] |= ~new[1:] & (x["place"][1:] != x["place"][:-1])
    at = np.flatnonzero(new)
    multi = np.logical_or.reduceat(more, at) if n else more
    names = ["d", "c", "u1", "u2", "multi", "place"][: 6 if placed else 5]
    own = pa.array(digests, pa.binary())
    for i in range(0, len(at), SENT):
        few = at[i : i + SENT]
        columns = [own.take(pa.array(x["text"][few])), *(pa.array(x[k][few].astype(np.int64)) for k in ("c", "u1", "u2")), pa.array(multi[i : i + SENT]), pa.array(x["place"][few])]
        yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most HELD bytes, or of one row."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").slice(at)), 0).to_numpy(zero_copy_only=False))
            n = max(1, int(np.searchsorted(size, HELD)))
            yield batch.slice(at, n)
            at += n


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted keys of the column asked, each mixed with the number of its row, and its other fields in that order."""
    own = batch.column("asked")
    flat, row = own.flatten(), pc.list_parent_indices(own).to_numpy(zero_copy_only=False)
    key = _of_row(flat.field("u").to_numpy(zero_copy_only=False).astype(_U), row)
    order = np.argsort(key)
    return key[order], [flat.field(i).to_numpy(zero_copy_only=False)[order] for i in range(1, flat.type.num_fields)]


def _of_row(u: np.ndarray, row: np.ndarray) -> np.ndarray:
    return _mixed(u + row.astype(_U) * _U(0x9E3779B97F4A7C15))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches):
        texts, parts = batch.column("text").to_pylist(), []
        for r in buffers(texts):
            u1, u2 = r.keys()
            parts.append({"text": r.text, "place": r.p + r.shift, "c": r.gram, "u1": u1, "u2": u2, "multi": np.zeros(len(r.p), bool)})
        yield from _rows(parts, [hashlib.md5(t).digest() for t in texts], placed=False)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches):
        keys, (multi,) = _asked(batch)
        digests = batch.column("d").to_pylist()
        for r in buffers(batch.column("text").to_pylist()):
            found = _find(keys, _of_row(r.keys()[0], r.text))
            x = r.blocks(np.flatnonzero(found >= 0))
            run = x["run"]
            yield from _rows([{"text": r.text[run], "place": x["top"] + r.shift[run], "multi": multi[found[run]].astype(bool)} | {k: x[k] for k in ("c", "u1", "u2")}], digests)


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches):
        keys, (multi,) = _asked(batch)
        digests = batch.column("d").to_pylist()
        for r in buffers(batch.column("text").to_pylist()):
            x = r.blocks(np.arange(len(r.p)))
            found = _find(keys, _of_row(x["u1"], r.text[x["run"]]))
            at = np.flatnonzero(found >= 0)
            which, s = _expand(x["s0"][at], x["s1"][at] - x["s0"][at] + 1)
            run = x["run"][at][which]
            u1, u2 = r.windows(s)
            yield from _rows([{"text": r.text[run], "place": s + r.shift[run], "c": u1, "u1": u1, "u2": u2, "multi": multi[found[at]][which].astype(bool)}], digests)


def _covered(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    """Maximal runs of removed bytes of each text, from its repeated digits of all passes (asked: u, pass)."""
    keys, (level,) = _asked(batch)
    level = level.astype(np.int64)
    texts = batch.column("text").to_pylist()

    def hit(u: np.ndarray, n: int, text: np.ndarray) -> np.ndarray:
        found = _find(keys, _of_row(u, text))
        return found >= 0 if not len(level) else (found >= 0) & (level[found] == n)

    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    merged = [np.zeros((2, 0), np.int64)]
    for r in buffers(texts):
        base = r.text * (1 << 40) + r.shift
        done = hit(r.keys()[0], 1, r.text)
        starts, ends = [(base + r.s0)[done]], [(base + r.s1)[done] + WINDOW]
        x = r.blocks(np.flatnonzero(~done))
        run = x["run"]
        done = hit(x["u1"], 2, r.text[run])
        starts.append((base[run] + x["s0"])[done])
        ends.append((base[run] + x["s1"])[done] + WINDOW)
        left = np.flatnonzero(~done)
        which, s = _expand(x["s0"][left], x["s1"][left] - x["s0"][left] + 1)
        run = run[left][which]
        done = hit(r.windows(s)[0], 3, r.text[run])
        starts.append((base[run] + s)[done])
        ends.append((base[run] + s)[done] + WINDOW)
        merged.append(_merged(np.concatenate(starts), np.concatenate(ends)))
    for p, q in _merged(*np.concatenate(merged, axis=1)).T.tolist():
        spans[p >> 40].append((p & (1 << 40) - 1, q & (1 << 40) - 1))
    return spans


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Starts and ends of the unions of ranges that meet."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return np.array([a[at], b[np.append(at[1:], len(b)) - 1] if len(at) else b])


_CUT = "d binary, spans array<struct<start:long,end:long>>, kept_sha256 string"


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in _held(batches):
        spans, shas = _covered(batch), []
        for text, own in zip(batch.column("text").to_pylist(), spans):
            shas.append(hashlib.sha256(without(text, own)).hexdigest())
        rows = [[{"start": a, "end": b} for a, b in own] for own in spans]
        yield pa.RecordBatch.from_arrays([batch.column("d").cast(pa.binary()), pa.array(rows, kind), pa.array(shas, pa.string())], names=["d", "spans", "kept_sha256"])


def without(text: bytes, spans: Iterable[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join((*out, text[at:]))


# -- passes ------------------------------------------------------------------------------------------------------------------------------
#: A digit is in several places. In the first pass a row is a place, or a copy of one in an equal text; later a text is there once, and one of its places
#: may come from two buffers.
def _row_twice() -> Column:
    return F.count("*") > 1


def _place_twice() -> Column:
    return F.min(F.xxhash64("d", "place")) != F.max(F.xxhash64("d", "place"))


def _refined(rows: DataFrame, twice: Column) -> tuple[DataFrame, DataFrame]:
    """(d, u of digits that repeat; d, u, multi of one text for each distinct digit whose group has undecided ones). rows must be a table."""
    distinct = cut(rows.groupBy("u1", "u2").agg(F.min("c").alias("c"), (twice | F.max("multi")).alias("multi"), F.min("d").alias("d")), "repeat-digits")
    undecided = cut(distinct.groupBy("c").agg(F.count("*").alias("n"), F.bool_and("multi").alias("all")).where("n > 1 AND NOT all").select("c"), "repeat-groups")
    on = distinct.join(undecided, "c").select("d", F.col("u1").alias("u"), "multi")
    repeated = rows.join(distinct.where("multi").select("u1", "u2"), ["u1", "u2"]).select("d", F.col("u1").alias("u"))
    return repeated, on


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """(table d, text of one row for each wanted digest, bucketed by d; its name). Texts move once."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("binary").alias("text")).where(F.octet_length("text") >= WINDOW)
    own = own.withColumn("d", F.unhex(F.md5("text")))
    least = own.groupBy("d").agg(F.min("k").alias("k")).join(wanted, "d")
    least = cut(least, "repeat-least")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"ampliweave_texts_{uuid.uuid4().hex}"
    one = own.join(least, ["d", "k"]).groupBy("d").agg(F.first("text").alias("text"))
    one.repartition(n, "d").write.bucketBy(n, "d").option("path", new_path(spark, "repeat-texts")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def _ask(texts: DataFrame, asked: DataFrame, do: Callable, schema: str) -> DataFrame:
    """do over the texts, each with the list of its rows in asked (d and a struct that starts with u)."""
    lists = asked.groupBy("d").agg(F.collect_set(F.struct(*[c for c in asked.columns if c != "d"])).alias("asked"))
    return texts.join(lists, "d").mapInArrow(do, schema)


def spans_of_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """d (MD5 of the text), spans and kept_sha256 of every distinct text that repeats something; a table. Texts in several rows have one span."""
    binary = docs.select(F.col(text).cast("binary").alias("text")).where(F.octet_length("text") >= WINDOW)
    rows = cut(binary.mapInArrow(_first, _ROWS), "repeat-runs")
    shared = cut(rows.groupBy("c").agg(F.count("*").alias("n"), F.max("multi").alias("multi")).where("n > 1 OR multi").select("c"), "repeat-grams")
    rows = cut(rows.join(shared, "c").select("d", "c", "u1", "u2", "multi"), "repeat-runs")
    repeated, undecided = _refined(rows, _row_twice())
    repeated, undecided = cut(repeated.distinct(), "repeat-repeated"), cut(undecided, "repeat-undecided")
    texts, name = _texts(docs, repeated.select("d").union(undecided.select("d")).distinct(), key, text)
    try:
        marks = [repeated.withColumn("pass", F.lit(1))]
        repeated, undecided = _refined(cut(_ask(texts, undecided, _blocks, _PLACED), "repeat-blocks"), _place_twice())
        marks.append(repeated.withColumn("pass", F.lit(2)))
        rows = cut(_ask(texts, undecided, _windows, _PLACED), "repeat-windows")
        again = cut(rows.groupBy("u1", "u2").agg((_place_twice() | F.max("multi")).alias("multi")).where("multi").select("u1", "u2"), "repeat-equal")
        marks.append(rows.join(again, ["u1", "u2"]).select("d", F.col("u1").alias("u"), F.lit(3).alias("pass")))
        return cut(_ask(texts, marks[0].unionByName(marks[1]).unionByName(marks[2]), _cut_out, _CUT), "repeat-spans")
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (the maximal removed runs of bytes) and kept_sha256 for every row of docs."""
    found = spans_of_texts(docs, key, text)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("_text"))
    rows = rows.select("_key", F.unhex(F.md5("_text")).alias("d"), F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = rows.join(found, "d", "left")
    return joined.select(F.col("_key").alias(key), "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 from remove()."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(key, "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
