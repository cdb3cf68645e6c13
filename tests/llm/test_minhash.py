import random
import re

import numpy as np
from pyspark.sql import functions as F

from ampliweave.llm import minhash
from ampliweave.llm.common import WORD


def shingles(text):
    words = re.findall(WORD, text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc_id -> class by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, least.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(30):
        base = rng.choices(vocab, k=rng.choice([40, 120, 400, 900]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 25])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words) if n % 3 else "\n".join(words)))
            n += 1
    passage = rng.choices(vocab, k=300)  # shared by many that are no duplicates
    for _ in range(40):
        rows.append((n, " ".join(passage + rng.choices(vocab, k=110))))
        n += 1
    rows += [(n, rows[-1][1]), (n, rows[-1][1]), (3, "a b"), (n + 1, "a b"), (n + 2, "a b c"), (None, rows[0][1]), (None, "only nulls here"), (None, None), (n + 3, ""), (n + 4, None), (n + 5, " \n"), (3, "another text of the same id")]
    return rows


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus()
    more = ["node", "bands", "doc", "x", "row", "__d", "__h", "__doc", "__x"]
    docs = spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in more))
    assert sorted(map(tuple, minhash.classes(docs).collect()), key=str) == brute(rows)
    out = minhash.dedup(docs)
    assert out.columns == docs.columns and {tuple(r[2:]) for r in out.collect()} == {tuple(more)}
    kept = sorted((r.doc_id for r in out.collect()), key=str)
    classes = {}
    for k, c in brute(rows):
        classes.setdefault(c, []).append(k)
    assert set(kept) - {None} == {c for c in classes if c is not None}
    assert minhash.classes(docs.limit(0)).count() == 0 and minhash.dedup(docs.limit(0)).count() == 0


def test_isolated_pairs_whose_differing_shingles_repeat(spark):
    rng = random.Random(7)
    rows = []
    for n in range(0, 40, 2):
        base = [f"b{n}x{i}" for i in range(204)]
        footer = " ".join(f"f{n}x{i}" for i in range(26))
        rows += [(n, " ".join(base)), (n + 1, " ".join(base + [footer] * rng.choice([60, 100])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, c in want}) == 20
    assert sorted(map(tuple, minhash.classes(docs).collect()), key=str) == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**63, 60, dtype=np.uint64)
    x, y = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    x[:10], y[50:] = 0, 0
    both = [i for i in range(60) if x[i] > 0 and y[i] > 0]
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(60)) for i in both)
    agree = []
    for salt in range(60):
        e = minhash._mixed(element + np.uint64(salt))
        a, b = minhash.signatures([(e[x > 0], x[x > 0]), (e[y > 0], y[y > 0])])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - want) < 0.02


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)], "a long, b long")
    got = {r.node: r.label for r in minhash.components(edges.where(F.lit(True))).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}
