"""run() against a plain version of every stage, over a small corpus with clean, copied, bad and private documents."""

import random
import sys

from pyspark.sql import functions as F
from test_minhash import brute as near_classes
from test_quality import base
from tokenizers import Tokenizer

import corpus_pipeline
from ampliweave.llm import mixing, pii, quality
from ampliweave.llm.queries import TOKENIZERS


def corpus():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(800)]
    rows = []
    for i in range(90):
        words = rng.choices(vocab, k=rng.choice([20, 80, 150]))
        if i % 4 == 0:
            words[5:6] = ["mail", "a.b@c.org", "or", "+1", "(555)", "123-4567"]
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 11 else None, len(" ".join(words))))
    for i in range(20):
        words = rows[i * 3][1].split(" ")
        words[-1] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s1", 0))
    rows += [(200 + i, "spam and eggs\n" * 60, "en", "s2", 0) for i in range(4)]
    return rows + [(300, None, None, None, None), (None, rows[1][1], "de", "s0", 3), (301, "", "en", "s0", 0), (1, rows[1][1], "en", "s1", 5)]


def test_run_against_plain_stages(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [r for r in rows if not base(r[1])[-1]]  # the ratio of so small a corpus rejects none: see below
    judged = quality.judge(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert judged.where("NOT base_failed AND NOT kept").count() == 0
    first = {}
    for i, (_, c) in enumerate(_labelled(docs)):
        key = (docs[i][0] is None, docs[i][0] if docs[i][0] is not None else 0)
        if c not in first or key < first[c][0]:
            first[c] = (key, i)
    docs = [docs[i] for _, i in first.values()]
    assert len(docs) < 70 and all(r[0] is not None for r in docs)
    docs = [(k, pii.redact(t, pii.find(t)), *rest) for k, t, *rest in docs]
    assert any("[EMAIL]" in r[1] and "[PHONE]" in r[1] for r in docs)
    planned = mixing.plan(spark.createDataFrame([(*r[:4], 0) for r in docs], schema)).collect()
    times = {r.doc_id: sum(2 * c.words >= r.size for c in r.copies) for r in planned}
    library = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    library.no_truncation()
    library.no_padding()
    want = []
    for k, t, *_ in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(k, len(ids), ids, library.decode(ids, skip_special_tokens=False))] * times[k]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _labelled(docs):
    """(doc_id, class) in the order of docs: near_classes() sorts, so rows get numbers for ids first."""
    classes = dict(near_classes([(i, r[1]) for i, r in enumerate(docs)]))
    return [(r[0], classes[i]) for i, r in enumerate(docs)]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "bpe"]
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "").schema.fieldNames() == docs.columns and stage(spark, docs.limit(0), "").count() == 0
    redacted = corpus_pipeline.redact_pii(spark, docs, "")
    assert redacted.count() == docs.count() and redacted.where(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).count() == 0


def test_the_rest_works_without_the_subpackage():
    import builtins
    import importlib

    real = builtins.__import__

    def refuse(name, *a, **k):
        if name.startswith(("ampliweave.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *a, **k)

    import __spark_entry__ as entry

    builtins.__import__ = refuse
    try:
        sys.modules.pop("__spark_entry__")
        bare = importlib.import_module("__spark_entry__")
        assert "pipeline" not in bare.queries() and "con5_consensus" in bare.queries() and set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        builtins.__import__ = real
        sys.modules["__spark_entry__"] = entry
