"""Near-duplicate classes: ProbMinHash signatures of sets of five-word shingles, banding, exact verification, connected components.

1. Sketch (one narrow pass over the texts). All shingles of a text weigh the same, however often they occur. For each shingle a Poisson process, seeded by the shingle,
   hits random signature components; a component keeps the shingle that hit it first. Generation stops early for a document's shingles whose next hit comes after
   the latest first hit. Two components agree with a probability that is the Jaccard similarity of the sets, the one that is verified. Texts with equal words
   share a node (the digest of their words); from here on copies are one row.
2. Candidates. BANDS bands of ROWS_PER_BAND components each. Every member of a bucket is paired with the bucket's least node: n - 1 pairs, never all.
3. Verification. For every pair the Jaccard similarity of the shingle sets is computed exactly from the texts; no estimate drops one.
4. The rest, exactly. Where a bucket's members are in several components after step 3, its largest component is dealt into blocks of about BLOCK bytes of shingles by hash,
   so is the rest, and each pair of blocks with the rest in it goes to one group, which computes all similarities between components and emits a forest of links,
   fewer than the group has members. So no bucket has a cap, none lands in one task, and no pairs are listed.
5. Components by least labels with pointer jumping; edges and labels are tables in the shared folder.

Result: one row a document with its class_id, the least doc_id of its class.

Nulls: a null text counts as empty; texts without a word are copies of each other; texts of fewer than five words have one shingle, all their
words. Null doc_ids stay null, and a class of nothing else has a null class_id. Repeated rows are rows of one class. Empty tables give empty results.
Columns besides doc_id and text aren't read by classes(); dedup() passes them on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS_PER_BAND = 32, 4
SIZE = BANDS * ROWS_PER_BAND
#: Bytes of shingle hashes in a block, and its nodes, about; a group has two blocks.
BLOCK, BLOCK_ROWS = 1 << 21, 512
#: Shingles that are compared at a time.
COLUMNS = 4096
_U = np.uint64
_REMEMBERED = 200_000
_MULTIPLIERS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """64-bit hashes of a text's shingles, through remembered hashes of its words."""

    def __init__(self) -> None:
        self.hash: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        return words_of(text)

    def shingles(self, words: list[str]) -> np.ndarray:
        if len(self.hash) > _REMEMBERED:
            self.hash.clear()
        known = self.hash
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
        out = np.full(n, _U(min(len(h), SHINGLE)))
        for i in range(min(SHINGLE, len(h))):
            out = _mixed(out + h[i : i + n] * _MULTIPLIERS[i])
        return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash signatures (SIZE 64-bit element hashes) of weighted sets (distinct hashes, positive weights); zeros for empty sets."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    element = np.concatenate([s[0] for s in sets]) if n else np.zeros(0, _U)
    rate = np.concatenate([s[1] for s in sets]) if n else np.zeros(0)
    first = np.full(n * SIZE, np.inf)
    out = np.zeros(n * SIZE, _U)
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = _mixed(element + _U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = doc * SIZE + (_mixed(draw ^ _U(0xD1B54A32D192ED03)) % _U(SIZE)).astype(np.int64)
        better = time < first[at]
        np.minimum.at(first, at[better], time[better])
        won = better & (time == first[at])
        out[at[won]] = element[won]
        go = time < first.reshape(n, SIZE).max(axis=1)[doc]
        doc, element, rate, time = doc[go], element[go], rate[go], time[go]
    return out.reshape(n, SIZE)


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, x (a hash of the text), node (digest of the words) and bands (BANDS hashes; null for texts without words)."""
    shingler = Shingler()

    def rows(keys: list, texts: list, x: list) -> Iterator[tuple]:
        nodes, sets = [], []
        for t in texts:
            words = shingler.words(t or "")
            nodes.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
            values = np.unique(shingler.shingles(words))
            sets.append((values, np.ones(len(values))))
        mixed = _mixed(signatures(sets))
        band = np.zeros((len(sets), BANDS), _U) + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15)
        for i in range(ROWS_PER_BAND):
            band = _mixed(band + mixed[:, i::ROWS_PER_BAND])
        for k, h, node, s, b in zip(keys, x, nodes, sets, band.astype(np.int64)):
            yield k, h, node, b.tolist() if len(s[0]) else None

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text, F.xxhash64(text)), rows, f"`{key}` {kind}, x long, node binary, bands array<long>")


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and shingles (sorted distinct hashes as bytes) of the wanted nodes, from the text of one document each; a table.

    docs: doc, x and text; nodes: node and the doc and x of one row that has it.
    """
    wanted = wanted.join(nodes, "node").select("node", "doc", "x")
    shingler = Shingler()

    def rows(node: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(node, texts):
            yield k, np.unique(shingler.shingles(shingler.words(t))).tobytes()

    sets = map_rows(docs.join(wanted, ["doc", "x"]).select("node", "text"), rows, "node binary, shingles binary").dropDuplicates(["node"])
    return cut(sets, "near-sets")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of THRESHOLD or more."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, nodes)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = np.frombuffer(p, _U), np.frombuffer(q, _U)
            both = len(a) + len(b) - len(np.union1d(a, b))
            out.append(both >= THRESHOLD * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return pairs.join(left, "a").join(right, "b").where(similar("sa", "sb")).select("a", "b")


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, as products of 0/1 matrices a few thousand shingles wide."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set adds nothing
    use = count[place] > 1
    owner, place = owner[use], shared[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, (low, low + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], place[a:b] - low] = 1
        out += m @ m.T
    return out


def links(labels: list, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of pairs at THRESHOLD or more that joins the same labels as all such pairs do."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    size, both = np.array([len(s) for s in sets]), common_shingles(sets)
    alike = both >= THRESHOLD * (size[:, None] + size[None, :] - both)
    number = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(len(sets) - 1):
        for j in np.flatnonzero(alike[i, i + 1 :] & (number[i + 1 :] != number[i])) + i + 1:
            p, q = find(number[i]), find(number[j])
            if p != q:
                root[p] = q
                out.append((i, int(j)))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the least node of its connected component, for every node of an edge. edges must be a table (it is read again and again)."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u != v")
    both = cut(both.distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        offers = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("offer"))
        hooked = labels.join(offers, labels.node == offers.v, "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        # labels of labels: both sides of this join are read from the table, so a label that many nodes have can be split
        hooked = cut(hooked, "cc-labels")
        up = hooked.select(F.col("node").alias("n"), F.col("label").alias("above"))
        jumped = hooked.join(up, hooked.label == up.n, "left").select("node", "old", F.least("label", "above").alias("label"))
        jumped = cut(jumped, "cc-labels")
        labels = jumped.select("node", "label")
        if jumped.where("label != old").isEmpty():
            return labels


def _residual(buckets: DataFrame, labels: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of step 4: across components, in buckets with several, by blocks."""
    big = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 2")
    member = buckets.join(big.select("bucket"), "bucket").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    member = cut(member, "near-members")
    sizes = member.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    shape = sizes.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    # buckets of the same members, in several bands, are one
    same = member.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"), F.count("*").alias("m"))
    shape = shape.join(same.groupBy("h", "h2", "m").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")
    shape = cut(shape.select("bucket", F.col("top.label").alias("top")), "near-shapes")
    own = member.join(shape, "bucket").select("bucket", "node", "label", (F.col("label") == F.col("top")).alias("main"))
    sets = _sets(own.select("node").distinct(), texts, nodes)
    own = cut(own.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node"), "near-members")
    blocks = lambda which: F.least(F.count_if(which), F.greatest(F.ceil(F.count_if(which) / BLOCK_ROWS), F.ceil(F.sum(F.when(which, F.col("bytes"))) / BLOCK))).cast("int")
    dealt = own.groupBy("bucket").agg(blocks(F.col("main")).alias("main_blocks"), blocks(~F.col("main")).alias("rest_blocks"))
    m = own.join(cut(dealt, "near-shapes"), "bucket")
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    # Blocks of the rest are numbered from 0, those of the largest component from -1 downwards; a group is a block of the rest and one more block.
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))),
        F.transform(F.sequence(F.lit(1), F.col("main_blocks")), lambda j: F.struct(F.col("own").alias("i"), (-j).alias("j"))),
    )
    main = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j")))
    m = m.select("bucket", "node", "label", F.explode(F.when(F.col("main"), main).otherwise(rest)).alias("g"))
    m = m.join(sets, "node").select("bucket", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "node", "label", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        node = group["node"].to_pylist()
        found = links(group["label"].to_pylist(), [np.frombuffer(s, _U) for s in group["shingles"].to_pylist()])
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.binary()), "b": pa.array([node[j] for _, j in found], pa.binary())})

    return m.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def node_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of key, doc, x and node; nodes that are linked to another one, with the label of their class)."""
    own = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc")
    sketched = cut(sketch(docs, key, text).select("*", own), "near-sketch")
    per_node = sketched.where("bands IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc", "x")).alias("d"), F.min("bands").alias("bands"))
    per_node = cut(per_node.select("node", "d.doc", "d.x", "bands"), "near-nodes")
    nodes = per_node.select("node", "doc", "x")
    buckets = per_node.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select("bucket", "pivot")
    buckets = cut(buckets.join(shared, "bucket"), "near-buckets")
    pairs = buckets.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    texts = docs.select(own, F.xxhash64(text).alias("x"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edges = cut(_verified(cut(pairs, "near-pairs"), texts, nodes), "near-edges")
    labels = components(edges)
    more = cut(_residual(buckets.select("bucket", "node"), labels, texts, nodes), "near-edges")
    if not more.isEmpty():
        labels = components(edges.union(more))
    return sketched.select(key, "doc", "x", "node"), labels


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """node, label and first: the least row (non-null keys first) of each node."""
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "doc", "x")).alias("first")
    return rows.groupBy("node").agg(first).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and class_id for every row of docs. Copies meet only in sums and in a join whose two sides are tables, which Spark can split."""
    rows, labels = node_classes(docs, key, text)
    named = cut(_labelled(rows, labels, key).select("node", "label", F.col("first.key").alias("least")), "near-nodes")
    of_label = named.groupBy("label").agg(F.min("least").alias("class_id"))
    of_node = cut(named.join(of_label, "label").select("node", "class_id"), "near-nodes")
    return rows.select(key, "node").join(of_node, "node").select(key, "class_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each class (the least doc_id; of rows that repeat it, one), with all columns."""
    rows, labels = node_classes(docs, key, text)
    kept = _labelled(rows, labels, key).groupBy("label").agg(F.min("first").alias("first"))
    kept = cut(kept.select(F.col("first.doc").alias("doc"), F.col("first.x").alias("x")), "near-kept")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart from the names used here
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.xxhash64(text).alias("x"), whole)
    return own.join(kept, ["doc", "x"]).dropDuplicates(["doc", "x"]).select("row.*")
