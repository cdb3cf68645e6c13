import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ampliweave.llm import repeats


def brute(texts, width):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text from a table of all windows."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            seen.setdefault(t[s : s + width], []).append((i, s))
    hit = [np.zeros(len(t) + 1, bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                hit[i][s : s + width] = True
    out = []
    for t, h in zip(texts, hit):
        spans = int((h[1:] & ~h[:-1]).sum() + h[0])
        out.append((len(t), int(h.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(t, h) if not x)).hexdigest()))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(140), prose(60)[:399]
    out = [prose(n) for n in (3, 90, 200, 400)]
    out += [prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)) for _ in range(12)]
    out += [prose(30) + short + prose(30) for _ in range(3)]
    out += [prose(20) + passage[i : i + 400 + i] for i in range(0, 200, 40)]
    base = prose(500)
    for _ in range(10):  # near copies
        words = base.split(" ")
        for _ in range(rng.choice([0, 1, 3, 8])):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [base, base, "x" * 399, "y" * 400, "y" * 400, "z" * 1500, "ab" * 300, "ab" * 190 + "c" + "ab" * 190, prose(100) + passage + passage, "", None, None]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(repeats, "HELD", 5000)
    texts = texts_of(seed)
    rows = [(i if i % 9 else None, t, "x", b"y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, d binary").repartition(3)
    got = repeats.digest(repeats.remove(docs)).collect()
    want = [(k, *w) for (k, *_), w in zip(rows, brute([(t or "").encode() for t in texts], 400))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_long_texts_in_pieces(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(700_000))
    a, b = 131_072 - 150, 262_144 - 405  # across the ends of pieces
    texts = [long, "." * 50 + long[a : a + 420], ";" * 7 + long[b : b + 900] + "!", long[:400], long[-400:] + "?", long[300_000:300_399]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in repeats.remove(docs).collect()}
    assert [tuple(s) for s in got[0]] == [(0, 400), (a, a + 420), (b, b + 900), (len(long) - 400, len(long))]
    assert [[tuple(s) for s in got[i]] for i in range(1, 6)] == [[(50, 470)], [(7, 907)], [(0, 400)], [(0, 400)], []]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert repeats.remove(docs.limit(0)).count() == 0
    assert repeats.digest(repeats.remove(docs)).first()[1:4] == (1, 0, 0)


def test_digits_tell_alternating_patterns_apart():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024)).encode()
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    for n in (256, 512, 1024):
        x, y = next(repeats.buffers([a])), next(repeats.buffers([b]))
        for m in (0, 1):
            apart = int(x.hash(m, np.array([0]), np.array([n]))[0]) ^ int(y.hash(m, np.array([0]), np.array([n]))[0])
            assert apart and apart & -apart < 1 << 16


def test_rows_of_a_pass_come_in_small_batches():
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 123) for _ in range(600_000))
    keys = np.concatenate([r.blocks(np.arange(len(r.p)))["u1"] for r in repeats.buffers([text])])
    asked = pa.array([[{"u": int(u), "multi": False} for u in keys.astype(np.int64)]], pa.list_(pa.struct([("u", pa.int64()), ("multi", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array([b"d" * 16]), pa.array([text]), asked], names=["d", "text", "asked"])
    out = list(repeats._windows([batch]))
    assert sum(b.num_rows for b in out) == len(text) - 399 and max(b.num_rows for b in out) <= repeats.SENT
