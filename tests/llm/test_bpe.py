import hashlib
import random

import pytest
from tokenizers import Tokenizer

from ampliweave.llm import bpe
from ampliweave.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    odd = ["é", "É", "é", "ß", "ς", "Σ", "İ", "ı", "😀", "👨‍👩‍👧", "中文", "日本語", "ﬁ", "​", "﻿", "\x1c", "\x85", "\xa0", "　", "don't", "we'll", "'s", "<|endoftext|>", "<|startoftext|>", "<|end", "$5", "x2", "_", "...", "\0"]
    out = ["", " ", "Hello, World!", "ΟΔΟΣ ΣΑΣ", "a" * 5000, "ab" * 3000, "🙂" * 300, "<|endoftext|><|endoftext|> x", "A<|startoftext|>B", "é Ẹ́"]
    for _ in range(400):
        out.append("".join(rng.choice(odd + list("abcdefgTHE 12,.!?\n\t'-")) for _ in range(rng.randint(1, 60))))
    return out


def test_ids_and_decoding_equal_the_library(library):
    own = bpe.PairIndexBpe(PATH)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(t)


def test_tables(spark, library):
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts()[:60])] + [(1, None, None), (1, "Hello, World!", "x"), (1, "Hello, World!", "x"), (5, "the quick brown fox " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode_documents(docs, PATH, emit=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
