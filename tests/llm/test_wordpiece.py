import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ampliweave.llm import wordpiece
from ampliweave.llm.common import WORD
from ampliweave.llm.queries import TOKENIZERS


def greedy(word, first, rest):
    n, at, pieces = 0, 0, first
    while at < len(word):
        size = next((i for i in range(len(word) - at, 0, -1) if word[at : at + i] in pieces), 0)
        if not size:
            return 0
        n, at, pieces = n + 1, at + size, rest
    return n


_PIECES = st.sets(st.text("abc", min_size=1, max_size=6).map(str.encode), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(_PIECES, _PIECES, st.lists(st.text("abcd", min_size=1, max_size=25).map(str.encode), max_size=8))
def test_against_greedy(first, rest, words):
    own = wordpiece.LongestMatch(first, rest)
    assert [own.count(w) for w in words] == [greedy(w, first, rest) for w in words]


def test_lone_space_begins_what_no_other_piece_begins(spark):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    first, rest = map(set, wordpiece.read_vocabulary(path))
    words = ["рыба", "собака", "здравствуйте", "բարեւ", "สวัสดีครับ", "一二三四五六七", "不知道", "zebra", "\x01"]
    want = []
    for w in words:
        b = w.encode()
        covered = any(b[:i] in first for i in range(1, len(b) + 1))
        want.append(greedy(b, first, rest) if covered else 1 + greedy(b, rest, rest))
    assert all(want) and max(want) > 5
    docs = spark.createDataFrame([(i, w) for i, w in enumerate([*words, " ".join(words)])], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in wordpiece.count_tokens(docs, path).collect()}
    assert got == {i: (1, n, 0) for i, n in enumerate(want)} | {len(words): (len(words), sum(want), 0)}


def test_tables(spark, tmp_path):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    first, rest = map(set, wordpiece.read_vocabulary(path))
    long = "unbelievable" * 20_000
    texts = ["The quick brown föx, jumped!", "The quick brown föx, jumped!", None, "", " \t\n", long, "😀 naïve\x1cword antidisestablishmentarianism"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:] for r in wordpiece.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        if t != long:
            counts = [greedy(w.encode(), first, rest) for w in re.findall(WORD, t or "")]
            assert got[i or None] == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    assert got[5][0] == 1 and got[5][1] > 1000 and wordpiece.count_tokens(docs.limit(0), path).count() == 0
    (tmp_path / "vocab.txt").write_text("un\n##aff\n##able\n")
    r = wordpiece.count_tokens(spark.createDataFrame([(1, "unaffable unx un")], "doc_id long, text string"), str(tmp_path / "vocab.txt"), "##").first()
    assert tuple(r) == (1, 3, 5, 1)
