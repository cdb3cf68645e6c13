import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ampliweave.llm import quality
from ampliweave.llm.common import WORD, words_of


@settings(max_examples=500, deadline=None)
@given(st.text("a b\n\t\x1c\x85\xa0 é,.#", max_size=60))
def test_words(text):
    assert words_of(text) == re.findall(WORD, text)


def base(text):
    words = re.findall(WORD, text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    inside = set()
    for i in range(n - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def grams(text):
    """Buckets of uni- and bigrams, token by token."""
    import zlib

    tokens = [zlib.crc32(t.encode()) for w in re.findall(WORD, text or "") for t in re.findall(r"\w+|[^\w\s]+", w) or [w]]
    out, full = [t % quality.BUCKETS for t in tokens], (1 << 64) - 1  # BUCKETS is 2^16, for so few documents
    for a, b in zip(tokens, tokens[1:]):
        x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & full
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & full
        out.append((x >> 48) + quality.BUCKETS)
    return out


def corpus():
    rng = random.Random(8)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}!{i}" for i in range(300)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choices(good if i % 3 else bad, k=rng.choice([30, 60, 200]))), "x"))
    spam = "buy now cheap\n" * 40
    long = " ".join(rng.choices(good, k=60_000))
    return rows + [(200, spam, "x"), (200, spam, "x"), (None, None, None), (201, "", "x"), (202, long, "x"), (None, rows[1][1], "x"), (203, " \n\t", "x"), (204, "a|b<c>#\n" * 60, "x")]


def test_judge_against_a_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 100, 2)] + [(4, 0), (None, 1)], "doc_id long, quality int")
    trusted = {i for i in range(0, 100, 2) if i % 3 and i != 4}
    assert quality.trusted_ids(labels) == trusted and len(quality.trusted_ids(labels, 5)) == 5
    raw, target = np.zeros(2 * quality.BUCKETS), np.zeros(2 * quality.BUCKETS)
    for k, t, _ in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += k in trusted
    share = (raw + 1) / (raw.sum() + 2 * quality.BUCKETS)
    ratio = np.log((target + 2 * quality.BUCKETS * share) / (target.sum() + 2 * quality.BUCKETS)) - np.log(share)
    score = [float(np.mean(ratio[grams(t)])) if grams(t) else 0.0 for _, t, _ in rows]
    threshold = (max(score[0:120:3]) + min(score[1:120:3] + score[2:120:3])) / 2  # such a small corpus moves little from the prior
    assert all(abs(s - threshold) > 1e-6 for s in score)
    want = [(k, *base(t), not base(t)[-1] and s >= threshold) for (k, t, _), s in zip(rows, score)]
    got = quality.judge(docs, labels, threshold=threshold)
    assert sorted((tuple(r[:7]) + (r.kept,) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = [w[-1] for w in want]
    assert any(kept) and any(not k and not w[-2] for k, w in zip(kept, want))  # the ratio rejects what no rule does
    own = quality.keep(docs, labels, threshold=threshold)
    assert own.columns == docs.columns and own.count() == sum(kept)
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.keep(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.0}


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t for _, t, _ in corpus() if t]
    whole = quality.Words()
    want = [whole.grams(whole.of(t)[1], quality.BUCKETS).tolist() for t in texts]
    monkeypatch.setattr(quality, "REMEMBERED", 500)
    short = quality.Words()
    assert [short.grams(short.of(t)[1], quality.BUCKETS).tolist() for t in texts] == want and want[0] == grams(texts[0]) and not math.isnan(sum(want[0]))


def test_buckets_grow_with_the_corpus():
    assert [quality.buckets_for(n).bit_length() - 1 for n in (0, 1 << 14, 51_282, 256_410, 15_000_000, 5 * 10**10)] == [16, 16, 17, 18, 20, 24]
    words = quality.Words()
    _, numbers = words.of("one two, three")
    assert words.grams(numbers, 1 << 20).max() < 1 << 21 and (words.grams(numbers, 1 << 20) >= 1 << 20).sum() == 3
