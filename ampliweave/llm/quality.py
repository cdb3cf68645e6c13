"""Quality rules: a few countable faults, then a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Two multinomials over hashed uni- and bigrams of word and punctuation tokens are counted in one pass over all documents: of the raw corpus
(every row) and of the trusted target (rows labelled of good quality, at most ``trusted_rows`` of them). Unigrams and bigrams have hash buckets of their own; their number
grows with the third root of the number of documents, as new n-grams turn up ever more slowly: 2^17 of each over 50,000 documents, 2^20 over 15
million, 2^24 (a broadcast of 134 MB) over 5e10. A document's score is the mean
log-ratio of its n-grams; it is kept where no base rule fails and its score is at least ``threshold``. The verdict is the same for equal texts.

Nulls: a null text has no words and fails; a null doc_id is kept as it is and is never trusted. Without trusted rows every ratio is 0 and only
the base rules decide. Repeated rows get the same answer. A document is read whole. Extra columns stay only where ``keep`` is used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, slices, words_of

#: Hash buckets of unigrams, and of bigrams, over BASE_ROWS documents or fewer. The model that goes to every task is one 4-byte number for each.
BUCKETS, BASE_ROWS = 1 << 16, 1 << 14
#: Labelled rows of good quality that make the target, at most (the first by a hash of doc_id).
TRUSTED_ROWS = 20_000
#: Mean log-ratio from which a document is kept.
THRESHOLD = -0.25
#: Words that a worker remembers between documents.
REMEMBERED = 200_000
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_SYMBOLS = "#*$%&|<>"


class Words:
    """Numbers for words, and the hashes of each word's tokens in one array."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes, self.first, self.count = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def of(self, text: str) -> tuple[list[str], np.ndarray]:
        words = words_of(text)
        new = set(words).difference(self.number)
        if new:
            if len(self.number) + len(new) > REMEMBERED and self.number:
                self._forget()
                new = set(words)
            self._learn(new)
        return words, np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _learn(self, words: set[str]) -> None:
        hashes, counts = [], []
        for w in words:
            self.number[w] = len(self.number)
            own = (w,) if w.isalnum() else _TOKENS(w) or (w,)
            counts.append(len(own))
            hashes += [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in own]
        n, to = len(self.number), self.used + len(hashes)
        while n > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while to > len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * len(self.hashes))
        self.hashes[self.used : to] = hashes
        self.count[n - len(words) : n] = counts
        self.first[n - len(words) : n] = self.used + np.cumsum(counts) - counts
        self.used = to

    def grams(self, numbers: np.ndarray, buckets: int) -> np.ndarray:
        """Buckets of the text's unigrams, then of its bigrams, which follow those of the unigrams. buckets: a power of two."""
        count = self.count[numbers]
        place = np.arange(count.sum()) + np.repeat(self.first[numbers] - np.cumsum(count) + count, count)
        one = self.hashes[place]
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= two >> np.uint64(29)
        two *= np.uint64(0xBF58476D1CE4E5B9)
        return np.concatenate([one & np.uint64(buckets - 1), (two >> np.uint64(65 - buckets.bit_length())) + np.uint64(buckets)]).astype(np.int64)


def buckets_for(rows: int) -> int:
    """A power of two that grows with the third root of the number of documents."""
    return BUCKETS << max(0, math.ceil(math.log2(max(rows, 1) / BASE_ROWS) / 3))


def repeated_words(a: np.ndarray) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    n = len(a) - 2
    if n < 2:
        return 0
    if a.max() < 1 << 21:
        key = a[:-2] << 42 | a[1:-1] << 21 | a[2:]
    else:
        pair = np.unique(a[:-2] << 32 | a[1:-1], return_inverse=True)[1]
        key = pair << 32 | a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n + 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    window = hit.copy()
    window[1:] |= hit[:-1]
    window[2:] |= hit[:-2]
    return int(window.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> frozenset[int]:
    """doc_ids labelled only as good, the first ``rows`` by hash: a bounded list."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return frozenset(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id").collect())


def log_ratios(docs: DataFrame, trusted: frozenset[int]) -> np.ndarray:
    """log(target / raw) of each bucket, with its share of the raw corpus times the number of buckets added to the target's counts."""
    buckets = buckets_for(docs.count())
    n = 2 * buckets

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, raw, good = Words(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch):
                grams = [(doc in trusted, words.grams(words.of(text)[1], buckets)) for doc, text in zip(*(c.to_pylist() for c in part.columns)) if text]
                for out, own in ((raw, [g for _, g in grams]), (good, [g for t, g in grams if t])):
                    if own:
                        out += np.bincount(np.concatenate(own), minlength=n)
        has = np.flatnonzero(raw)
        for at in range(0, len(has), 1 << 16):
            some = has[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some], pa.int64()), pa.array(good[some], pa.int64())], names=["bucket", "raw", "good"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    counts = cut(counts, "quality-counts")
    all_raw, all_good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not all_good:
        return np.zeros(n, np.float32)
    ratio = lambda raw, good: F.log((good + n * (raw + 1) / (all_raw + n)) / (all_good + n)) - F.log((raw + 1) / (all_raw + n))
    out = np.full(n, math.log(n / (all_good + n)), np.float32)  # of a bucket that no text has
    for batch in counts.select(F.col("bucket").cast("int"), ratio(F.col("raw"), F.col("good")).cast("float").alias("ratio")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and COLUMNS for every row of docs (doc_id, text). labels: doc_id, quality."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted_ids(labels, trusted_rows)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), _rules(ratios, threshold), f"doc_id {kind}, {COLUMNS}")


def keep(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted_ids(labels, trusted_rows)))
    at = docs.columns.index("text")
    own = _rules(ratios, threshold)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                yield part.filter(pa.array([r[-1] for r in own(texts, texts)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def _rules(ratios, threshold: float):
    words = Words()

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        model = ratios.value
        buckets = len(model) // 2
        for k, text in zip(keys, texts):
            text = text or ""
            own, numbers = words.of(text)
            n, repeated = len(own), repeated_words(numbers)
            failed = n < 50 or 100 * repeated > 50 * n
            score = float(model[words.grams(numbers, buckets)].mean(dtype=np.float64)) if n else 0.0
            yield k, n, len("".join(own)), sum(map(text.count, _SYMBOLS)), duplicate_lines(text), repeated, failed, score, not failed and score >= threshold

    return rows
