import random

from ampliweave.operators import graph
from ampliweave.synth import reads


def brute(strings):
    d = [sum(a != b for a, b in zip(x, y)) for x in strings for y in strings]
    return (sum(d) / len(d), max(d)) if d else (0.0, 0)


def close(row, want):
    return abs(row.mean - want[0]) < 1e-9 and row.greatest == want[1]


def test_mean_distance_of_whole_tags(spark, monkeypatch):
    """All reads and all their tags, and more strings than the operator took before."""
    r = reads(spark, "/root/testdata/sf0.001")
    rng = random.Random(2)
    many = spark.createDataFrame([("".join(rng.choices("ACGT", k=12)),) for _ in range(1300)], "s string")
    for tags, block in ((r.select("molecule"), graph.BLOCK), (r.select("molecule"), 20), (r.select("seq"), 200), (many, 400)):
        monkeypatch.setattr(graph, "BLOCK", block)
        column = tags.columns[0]
        whole = {t[0] for t in tags.collect()}
        assert len(whole) > 50 and min(map(len, whole)) >= 12
        assert close(graph.mean_distance(tags, column).first(), brute(whole))


def test_mean_distance_of_any_strings(spark, monkeypatch):
    rng = random.Random(4)
    some = sorted({"".join(rng.choices("ACGTNé\0", k=rng.choice([0, 3, 70, 150]))) for _ in range(60)})
    for block in (graph.BLOCK, 7):
        monkeypatch.setattr(graph, "BLOCK", block)
        df = spark.createDataFrame([(s,) for s in [*some, some[3], None]], "s string")
        assert close(graph.mean_distance(df, "s").first(), brute(some))
        assert close(graph.mean_distance(df.limit(0), "s").first(), (0.0, 0))


def test_complete_subgraphs_and_bridge_cuts_against_all_subsets(spark):
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(6):
        edges = {tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.choice([6, 12, 20]))}
        near = lambda a, b: (min(a, b), max(a, b)) in edges
        vertices = sorted({v for e in edges for v in e})
        full = [set(c) for n in range(1, 10) for c in combinations(vertices, n) if all(near(a, b) for a, b in combinations(c, 2))]
        want = sorted(tuple(sorted(c)) for c in full if not any(c < other for other in full))
        df = spark.createDataFrame(sorted(edges), "a int, b int")
        assert sorted(tuple(r.members) for r in graph.complete_subgraphs(df).collect()) == want
        parts = graph.balanced_parts(df, 1).collect()
        assert sorted(r.v for r in parts) == vertices and all(r.part <= r.v for r in parts)
    two = [(a, b) for s in (0, 10) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 10), (13, 20)]  # two full squares, a bridge, and a tail
    got = graph.balanced_parts(spark.createDataFrame(two, "a int, b int"), 1).collect()
    assert {(r.part, r.v) for r in got} == {(0, v) for v in range(4)} | {(10, v) for v in (*range(10, 14), 20)}


def test_pairs_stay_in_their_group(spark):
    from ampliweave.operators import correct

    rows = [("g1", "AAAA", 9), ("g1", "AAAC", 1), ("g2", "AAAC", 5), ("g2", "AACC", 1), ("g2", "TTTT", 3)]
    got = correct.clusters(spark.createDataFrame(rows, "g string, tag string, n long"), 1, 2.0).collect()
    assert {(r.g, r.tag): r.root for r in got} == {("g1", "AAAA"): "AAAA", ("g1", "AAAC"): "AAAA", ("g2", "AAAC"): "AAAC", ("g2", "AACC"): "AAAC", ("g2", "TTTT"): "TTTT"}


def test_qualities_of_each_base(spark):
    """Sums of the alleles' logarithms with a quality for each base, insertions and gaps too, and the posteriors that come of them."""
    from math import log2

    from pyspark.sql import functions as F

    from ampliweave.operators import consensus

    rows = [("g", "AC-GT", "ACTG-", [10, 20, 30, 40]), ("g", "ACGT", "AGGT", [15, 25, 35, 12]), ("g", "ACGT", "--GN", [7, 8])]
    piles = consensus.pileup(spark.createDataFrame(rows, "k string, ref_aln string, read_aln string, qual array<int>"), ["k"], F.col("qual")).collect()
    seen = {(1, 0): [("A", 10), ("A", 15)], (2, 0): [("C", 20), ("G", 25)], (2, 1): [("T", 30)], (3, 0): [("G", 40), ("G", 35), ("G", 7)], (4, 0): [("T", 12), ("N", 8)]}
    assert {(r.pos, r.ins) for r in piles} == set(seen)
    for r in piles:
        for a in "ACGT":
            want = sum(log2(1 - 10 ** (-q / 10)) if b == a else log2(10 ** (-q / 10) / 3) for b, q in seen[r.pos, r.ins])
            assert abs(r[f"log_{a.lower()}"] - want) < 1e-9


def test_both_ways_to_meet_find_all_pairs(spark):
    from ampliweave.operators import radius

    rng = random.Random(11)
    strings = sorted({"".join(rng.choices("AC", k=rng.randint(0, 7))) for _ in range(60)})

    def apart(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    left, right = spark.createDataFrame([(s,) for s in strings], "a string"), spark.createDataFrame([(s,) for s in strings], "b string")
    for d in (1, 2):
        want = sorted((x, y, apart(x, y)) for x in strings for y in strings if apart(x, y) <= d)
        for length in (None, 6):
            assert sorted(map(tuple, radius.levenshtein_pairs(left, right, "a", "b", d, length=length).collect())) == want


def test_short_strings_meet_by_what_is_left(spark):
    """clu2_similarity_graph: strings of the named length meet by all but d characters, each pair once; those of other lengths are found too."""
    from ampliweave.operators import radius

    rng = random.Random(13)
    strings = sorted({"".join(rng.choices("ACN", k=rng.choice([5, 5, 5, 5, 4, 7]))) for _ in range(90)} | {""})
    df = spark.createDataFrame([(s,) for s in strings], "v string")
    two = spark.createDataFrame([("g", "AAAAA"), ("h", "AAAAC")], "g string, a string"), spark.createDataFrame([("g", "AAACC"), ("h", "AAAAC")], "g string, b string")
    for d in (1, 2, 3):
        want = sorted((x, y, n) for x in strings for y in strings if x < y and len(x) == len(y) and (n := sum(p != q for p, q in zip(x, y))) <= d)
        assert sorted(map(tuple, radius.close_pairs(df, "v", d, "hamming", 5).collect())) == want
        assert sorted(map(tuple, radius.close_pairs(df, "v", d, "hamming").collect())) == want
        got = sorted(map(tuple, radius.hamming_pairs(*two, "a", "b", d, ["g"], 5).collect()))
        assert got == ([("g", "AAAAA", "AAACC", 2)] if d > 1 else []) + [("h", "AAAAC", "AAAAC", 0)]


def test_groups_of_any_size_and_columns_that_are_not_shuffled(spark, monkeypatch):
    """agg6_pileup and what comes of it: reads are dealt by group before they become columns; groups of over HOT reads, and null keys, have the same columns as before."""
    from ampliweave.operators import consensus

    rows = [(k, a, b, q, b) for k, n in (("x", 40), ("y", 3), (None, 12)) for i in range(n) for a, b, q in [("AC-GT", "ACTG-", i % 9 + 3), ("ACGT", "AGNT", 20)][i % 2 :][:1]]
    df = spark.createDataFrame(rows, "k string, ref_aln string, read_aln string, q int, seq string")
    near = lambda d: sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in d.collect()), key=str)
    makers = [lambda: consensus.pileup(df, ["k"]), lambda: consensus.called(df, ["k"]).select("k", "pos", "ins", "base", "n"), lambda: consensus.modal_bases(df, ["k"], "seq")]
    whole = [near(f()) for f in makers]
    assert {r[0] for r in whole[1]} == {"x", "y"} and {r[0] for r in whole[0]} == {r[0] for r in whole[2]} == {"x", "y", None}
    monkeypatch.setattr(consensus, "HOT", 10)
    assert [near(f()) for f in makers] == whole
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        consensus._columns(consensus.by_group(df, ["k"])[0], ["k"], None).explain()
    text = out.getvalue()
    assert "REPARTITION_BY_NUM" in text and text.index("Generate") < text.index("REPARTITION_BY_NUM") and "Exchange" not in text[: text.index("Generate")]


def _split_plainly(neighbours, d):
    """All distances and all edges tried at every cut."""

    def reach(graph, v):
        seen, todo = {v: 0}, [v]
        for x in todo:
            for y in graph[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    best = None
    if max(max(reach(neighbours, v).values()) for v in neighbours) > 2 * d:
        for v in sorted(neighbours):
            for w in sorted(x for x in neighbours[v] if v < x):
                less = {x: n - ({w} if x == v else {v} if x == w else set()) for x, n in neighbours.items()}
                side = set(reach(less, v))
                if w not in side and (best is None or abs(2 * len(side) - len(less)) < best[0]):
                    best = (abs(2 * len(side) - len(less)), side, less)
    if best is None:
        return [sorted(neighbours)]
    return sorted(p for s in (True, False) for p in _split_plainly({v: n for v, n in best[2].items() if (v in best[1]) == s}, d))


def test_even_cuts_of_large_components_and_plain_ones():
    """clu4_balanced_parts: the cuts are those of trying every edge, and a long path, a star and a large graph take no more than a pass or so."""
    rng = random.Random(14)
    for _ in range(250):
        n = rng.randint(2, 16)
        edges = {(rng.randrange(i), i) for i in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.choice([0, 0, 1, 3]))}
        near = graph._neighbours(*zip(*edges))
        for d in (0, 1, 2):
            assert graph.split_balanced(near, d) == _split_plainly(near, d)
    n = 3000
    assert len(graph.split_balanced(graph._neighbours(range(n - 1), range(1, n)), 1)) > n // 4
    assert len(graph.split_balanced(graph._neighbours([0] * n + [1], [*range(1, n + 1), n + 1]), 1)) == 2
    ring = graph._neighbours([*range(n), *range(n)], [*((i + 1) % n for i in range(n)), *range(n, 2 * n)])
    assert len(graph.split_balanced(ring, 1)) == n + 1


def test_complete_subgraphs_need_no_whole_component(spark):
    """clu5_complete_subgraphs: vertex by vertex they are those of the whole graph, also with names, self loops and both directions."""
    rng = random.Random(15)
    edges = [tuple(rng.choices("abcdefghijkl", k=2)) for _ in range(40)] + [("z", "z"), ("x", "y"), ("y", "x")]
    want = graph.complete_subgraphs_of(graph._neighbours(*zip(*edges)))
    done = graph.complete_subgraphs(spark.createDataFrame(edges, "a string, b string"))
    assert sorted(tuple(r.members) for r in done.collect()) == want
    assert {(r.component, r.members[0]) for r in done.where("component >= 'x'").collect()} == {("z", "z"), ("x", "x")}


def test_integrations_are_counted_in_parts_that_grow_with_the_input(spark):
    """jon12_integrations: rows are dealt by id and cell before they are counted; nulls and ids that aren't listed count as before."""
    from ampliweave.operators import cells

    rows = [(1, 7), (1, 7), (1, 8), (1, None), (2, 7), (2, 7), (3, 1), (3, 1), (3, 2), (None, 1), (None, 2), (None, 3)]
    done = cells.integrations(spark.createDataFrame(rows, "i long, c long"), spark.createDataFrame([(1,), (2,), (2,), (None,)], "i long"), "c", "i", 1)
    assert sorted(map(tuple, done.collect())) == [(1, 2, 4), (2, 1, 2)] and done.columns == ["i", "cells", "n"]
    assert "RepartitionByExpression [i" in done._jdf.queryExecution().optimizedPlan().toString()
