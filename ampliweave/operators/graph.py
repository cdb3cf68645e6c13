"""Graphs of strings: components, bridge cuts, maximal complete subgraphs (CLU2 to CLU6)."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .radius import close_pairs

#: Strings in a block whose distances to another block are computed together, and positions at a time.
BLOCK, POSITIONS = 2048, 64


def similarity_graph(strings: DataFrame, column: str, d: int, length: int | None = None) -> DataFrame:
    """Edges (a, b, distance), a < b, of the distinct strings at Hamming distance d or less (CLU2). length: how long most of them are, if that is known."""
    return close_pairs(strings, column, d, "hamming", length)


def components(vertices: DataFrame, edges: DataFrame, vertex: str = "v", a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the least vertex of each connected component (CLU3). Least labels with pointer jumping; labels are tables, not lineage."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("w")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("w"))).where("u != w")
    both = cut(both.distinct(), "component-edges")
    labels = cut(vertices.select(F.col(vertex).alias("v")).distinct().withColumn("label", F.col("v")), "component-labels")
    while True:
        offers = both.join(labels, both.w == labels.v).groupBy("u").agg(F.min("label").alias("offer"))
        hooked = cut(labels.join(offers, labels.v == offers.u, "left").select("v", F.col("label").alias("old"), F.least("label", "offer").alias("label")), "component-labels")
        up = hooked.select(F.col("v").alias("at"), F.col("label").alias("above"))
        jumped = cut(hooked.join(up, hooked.label == up.at).select("v", "old", F.least("label", "above").alias("label")), "component-labels")
        labels = jumped.select("v", "label")
        if jumped.where("label != old").isEmpty():
            return labels.select(F.col("v").alias(vertex), F.col("label").alias("component"))


def single_linkage(strings: DataFrame, column: str, below: int = 2, length: int | None = None) -> DataFrame:
    """(column, component) of strings linked by edit distances under a bound (CLU6)."""
    return components(strings, close_pairs(strings, column, below - 1, length=length), column)


def _grouped(edges: DataFrame, a: str, b: str) -> DataFrame:
    v = edges.select(F.col(a).alias("v")).union(edges.select(F.col(b).alias("v")))
    return edges.join(components(v, edges, "v", a, b), edges[a] == F.col("v")).select("component", F.col(a).alias("a"), F.col(b).alias("b"))


def complete_subgraphs_of(neighbours: dict) -> list[tuple]:
    """Maximal complete subgraphs by Bron-Kerbosch with pivots; they and their members in order. A graph without vertices has the empty one."""
    out = []

    def grow(held: list, some: set, none: set) -> None:
        if not some and not none:
            out.append(tuple(sorted(held)))
            return
        pivot = max(some | none, key=lambda v: (len(neighbours[v] & some), v))
        for v in sorted(some - neighbours[pivot]):
            grow([*held, v], some & neighbours[v], none & neighbours[v])
            some = some - {v}
            none = none | {v}

    grow([], set(neighbours), set())
    return sorted(out)


def _neighbours(a, b) -> dict:
    out: dict = {}
    for x, y in zip(a, b):
        out.setdefault(x, set()).add(y)
        out.setdefault(y, set()).add(x)
    for v in out:
        out[v].discard(v)
    return out


def complete_subgraphs(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(component, members: array of vertices) of all maximal complete subgraphs (CLU5).

    Each is found at its member of the fewest neighbours, of equals the least, from that one's neighbours and what they share with it: a giant component is as many pieces of
    work as it has vertices, and no task holds it.
    """
    kind = edges.schema[a].dataType.simpleString()
    v = edges.select(F.col(a).alias("v")).union(edges.select(F.col(b).alias("v"))).distinct()
    own = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")).where("u != w").distinct(), "subgraph-edges")
    near = cut(own.union(own.select("w", "u")).groupBy("u").agg(F.collect_list("w").alias("near")), "subgraph-neighbours")
    one, two = near.select("u", F.col("near").alias("n1")), near.select(F.col("u").alias("w"), F.col("near").alias("n2"))
    both = own.join(one, "u").join(two, "w").select("u", "w", F.array_intersect("n1", "n2").alias("common"), (F.struct(F.size("n1"), "u") < F.struct(F.size("n2"), "w")).alias("first"))
    at = both.select(F.when(F.col("first"), F.col("u")).otherwise(F.col("w")).alias("v"), F.struct(F.when(F.col("first"), F.col("w")).otherwise(F.col("u")).alias("w"), "common").alias("x"))

    def run(batches):
        for batch in batches:
            vertices, members = [], []
            for v, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = complete_subgraphs_at(v, {r["w"]: set(r["common"]) for r in rows})
                vertices += [v] * len(found)
                members += found
            of = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(vertices, of), pa.array(members, pa.list_(of))], names=["v", "members"])

    found = at.groupBy("v").agg(F.collect_list("x").alias("x")).mapInArrow(run, f"v {kind}, members array<{kind}>")
    alone = v.join(near, F.col("v") == F.col("u"), "left_anti").select("v", F.array("v").alias("members"))
    return found.union(alone).join(components(v, own, "v", "u", "w"), "v").select("component", "members")


def complete_subgraphs_at(v, later: dict) -> list[tuple]:
    """Maximal complete subgraphs of v and later neighbours (with the neighbours of v that each one has, earlier ones too)."""
    neighbours = dict(later)
    for w, common in later.items():
        for x in common:
            if x not in later:
                neighbours.setdefault(x, set()).add(w)
    out = []

    def grow(held: list, some: set, none: set) -> None:
        if not some:
            if not none:
                out.append(tuple(sorted(held)))
            return
        pivot = max(some | none, key=lambda x: len(neighbours[x] & some))
        for w in some - neighbours[pivot]:
            grow([*held, w], some & neighbours[w], none & neighbours[w])
            some = some - {w}
            none = none | {w}

    grow([v], set(later), set(neighbours) - set(later))
    return out


def _within(neighbours: dict, start, d: int | None = None) -> set:
    """Vertices at d steps or less from one, without d all that are connected with it."""
    seen, last = {start}, [start]
    while last and d != 0:
        last = [*{w for v in last for w in neighbours[v] if w not in seen}]
        seen.update(last)
        d = None if d is None else d - 1
    return seen


def _bridges(neighbours: dict) -> list[tuple]:
    """Edges (v, w), v < w, that are on no circle of a connected graph."""
    root = next(iter(neighbours))
    number, low, out = {root: 0}, {root: 0}, []
    path = [(root, None, iter(neighbours[root]))]
    while path:
        v, above, rest = path[-1]
        for w in rest:
            if w not in number:
                number[w] = low[w] = len(number)
                path.append((w, v, iter(neighbours[w])))
                break
            if w != above:
                low[v] = min(low[v], number[w])
        else:
            path.pop()
            if path:
                low[above] = min(low[above], low[v])
                if low[v] > number[above]:
                    out.append((min(v, above), max(v, above)))
    return out


def split_balanced(neighbours: dict, d: int) -> list[list]:
    """Parts of a connected graph: while its diameter is above 2 d, the bridge with the most even sides is cut (CLU4). Ties go to the least bridge.

    Cutting a bridge makes no other and no path within a part longer, so bridges are found once, in linear time. The pieces between them are a tree; at the piece whose
    branches all have half the part's vertices at most, the most even bridge is the one to the largest branch, so each piece keeps a heap of its branches.
    """
    near = {v: set(n) for v, n in neighbours.items()}
    bridges = _bridges(near)
    for v, w in bridges:
        near[v].discard(w)
        near[w].discard(v)
    piece: dict = {}
    sizes, first = [], []
    for v in near:
        if v not in piece:
            own = _within(near, v)
            piece.update(dict.fromkeys(own, len(sizes)))
            sizes.append(len(own))
            first.append(v)
    beside: list[list] = [[] for _ in sizes]
    for v, w in bridges:
        near[v].add(w)
        near[w].add(v)
        beside[piece[v]].append((piece[w], (v, w)))
        beside[piece[w]].append((piece[v], (v, w)))
    order, above = [0], {0: None}
    for p in order:
        for q, _ in beside[p]:
            if q != above[p]:
                above[q] = p
                order.append(q)
    heaps: list[list] = [[] for _ in sizes]
    for p in reversed(order):
        for q, edge in beside[p]:
            if q != above[p]:
                sizes[p] += sizes[q]
                heaps[p].append((-sizes[q], edge, q))
        heapify(heaps[p])
    done, todo = [], [0]
    while todo:
        p = todo.pop()
        whole = sizes[p]
        while heaps[p] and -2 * heaps[p][0][0] > whole:
            _, edge, q = heappop(heaps[p])
            sizes[p] = whole - sizes[q]
            sizes[q] = whole
            heappush(heaps[q], (-sizes[p], edge, p))
            p = q
        some = _within(near, first[p], 2 * d)
        far = len(some) < whole or len(_within(near, first[p], d)) < whole and any(len(_within(near, v, 2 * d)) < whole for v in some)
        if not far or not heaps[p]:
            done.append(sorted(_within(near, first[p])))
            continue
        _, (v, w), q = heappop(heaps[p])
        near[v].discard(w)
        near[w].discard(v)
        sizes[p] -= sizes[q]
        todo += [p, q]
    return sorted(done)


def balanced_parts(edges: DataFrame, d: int, a: str = "a", b: str = "b") -> DataFrame:
    """(component, part, v) of over-connected components cut at bridges (CLU4); part is its least vertex. One component a task."""
    kind = edges.schema[a].dataType.simpleString()

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], p[0], v) for p in split_balanced(_neighbours(rows["a"], rows["b"]), d) for v in p], columns=["component", "part", "v"])

    return _grouped(edges, a, b).groupBy("component").applyInPandas(run, f"component {kind}, part {kind}, v {kind}")


def _codes(strings: list[str]) -> np.ndarray:
    """A row of characters (from 1) a string, zeros behind its end."""
    length = np.array([len(s) for s in strings])
    out = np.zeros((len(strings), max(length)), np.uint32)
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out


def greatest_hamming(left: list[str], right: list[str]) -> int:
    """The greatest Hamming distance of a string on the left and one on the right; of strings of two lengths the common start counts."""
    if not left or not right:
        return 0
    a, b = _codes(left), _codes(right)
    width = min(a.shape[1], b.shape[1])
    apart = np.minimum((a[:, :width] > 0).sum(axis=1)[:, None], (b[:, :width] > 0).sum(axis=1)[None, :])
    for at in range(0, width, POSITIONS):
        x, y = a[:, at : min(at + POSITIONS, width)], b[:, at : min(at + POSITIONS, width)]
        for c in np.intersect1d(x, y):
            if c:
                apart = apart - ((x == c).astype(np.float32) @ (y == c).astype(np.float32).T).astype(np.int64)
    return int(apart.max())


def mean_distance(strings: DataFrame, column: str) -> DataFrame:
    """One row (mean, greatest) of the Hamming distances of a set of strings (AGG11): the mean over all ordered pairs of distinct strings, a string with itself too.

    The mean is exact from the counts of each character at each position. The greatest distance compares all pairs, a pair of blocks a task, whose number
    grows with the square of the strings. Of strings of two lengths the common start counts. Nulls are left out; an empty set has 0 and 0.
    """
    own = cut(strings.select(F.col(column).alias("s")).where("s IS NOT NULL").distinct(), "distance-strings")
    size = own.count()
    whole = "decimal(38,0)"
    places = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.struct(i.alias("i"), F.substr("s", i, F.lit(1)).alias("c")))
    counts = own.where("length(s) > 0").select(F.inline(places)).groupBy("i", "c").agg(F.count("*").cast(whole).alias("n"))
    unlike = counts.groupBy("i").agg((F.sum("n") * F.sum("n")).cast(whole).alias("all"), F.sum((F.col("n") * F.col("n")).cast(whole)).cast(whole).alias("like"))
    mean = unlike.agg((F.coalesce(F.sum(F.col("all") - F.col("like")).cast("double"), F.lit(0.0)) / F.lit(float(max(size, 1)) ** 2)).alias("mean"))

    blocks = -(-max(size, 1) // BLOCK)
    dealt = own.withColumn("own", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = dealt.withColumn("g", F.explode(groups)).select("s", "own", F.col("g.i").alias("i"), F.col("g.j").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        members: dict[int, list[str]] = {i: [], j: []}
        for s, k in zip(group["s"].to_pylist(), group["own"].to_pylist()):
            members[k].append(s)
        return pa.table({"d": pa.array([greatest_hamming(members[i], members[j])], pa.int32())})

    greatest = dealt.groupBy("i", "j").applyInArrow(compare, "d int").agg(F.coalesce(F.max("d"), F.lit(0)).alias("greatest"))
    return mean.crossJoin(greatest)
