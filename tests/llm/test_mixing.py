from collections import Counter

from ampliweave.llm import mixing


def water_fill(sizes, weights, most=3):
    """The rule as it is told: share, stop, share the excess again."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def rows_of():
    rows = []
    for i in range(400):
        source = [None, "b", "a", "é", "z", "b", "b"][i % 7]
        rows.append((i, " \t\n".join(["w"] * (i * 37 % 90)) + "\x0bx" * (i % 2), source, "en", 0))
    return rows + [(5, "same row", "b", "en", 0)] * 3 + [(None, "no id here", "tiny", None, None), (None, None, None, None, None), (7, "", "empty", "en", 0), (8, "w " * 50_000, "long", "en", 0)]


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, source string, lang string, size long")
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows_of())
    sizes = {}
    for _, text, source, *_ in rows_of():
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    want, taken = water_fill(sizes, weights), {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert sum(c.words for c in r.copies) == r.taken and all(0 <= c.position <= 1 for c in r.copies)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.plan(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_positions_follow_the_schedule(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'one two' AS text", "concat('s', id % 3) AS source")
    early = {r.source: r.n for r in mixing.plan(docs).selectExpr("source", "explode(copies) AS c").where("c.position < 0.5").groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    # integrals to 0.5: 1.25 of 2 (weights 1.5 to 0.5), 1 of 2, 1.125 of 3
    total = {"s0": 1000.0, "s1": 2000.0, "s2": 3000.0}
    for s, share in (("s0", 0.625), ("s1", 0.5), ("s2", 1.125 / mixing.integral(mixing.CURRICULUM[2]))):
        assert abs(early[s] - share * total[s] / 2) < 3


def test_mix_emits_whole_rows(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, source string, lang string, size long")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    n = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(n[k] for k in n if k[0] not in (5,)) <= 3 and (7, "") not in n
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.plan(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect())


def test_mix_is_in_training_order(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, f"w{i} " * (1 + i % 40), f"s{i % 4}") for i in range(600)], "doc_id long, text string, source string")
    first = {}
    for place, r in enumerate(mixing.mix(docs).collect()):
        first.setdefault(r.text, place)
    planned = mixing.plan(docs, keep=("text",)).selectExpr("text", "get(filter(copies, c -> 2 * c.words >= size), 0).position AS p").where("p IS NOT NULL").collect()
    order = sorted(planned, key=lambda r: r.p)
    assert len(order) == len(first) > 300
    assert [first[r.text] for r in order] == sorted(first.values())
