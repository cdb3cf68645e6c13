import hashlib
import re

import pytest

from ampliweave.llm import secrets

PATTERNS = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
TEXTS = [
    None, "", "password: hunter2hunter2", "Token = 'abcdefgh' é token=token =abcdefgh", "ñandú API_KEY:\"a.b/c+d=e\" apikey:short", "AKIAAKIA1234567890 xAKIA123456789012 AKIA1 AKIAABCDEFGHIJKL",
    "f" * 31 + " " + "0123456789abcdef" * 2 + "G" + "a" * 40, "secret==========x passwd='12345678'", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18 + " xoxb-123456789012", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
    "😀 token:12345678 " * 50, "x" * 500_000 + " secret=" + "y" * 100_000, "password secret token api_key AKIA", "pass word sec ret tok en",
]


def brute(text):
    text = text or ""
    spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in re.finditer(p, text) if len(m[g]) >= n]
    joined = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def test_queries_of_expressions():
    assert secrets.trigram_query("abcd?e") == {frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bce"})}
    assert secrets.trigram_query("[0-9a-f]{32,}") == {frozenset()} and secrets.trigram_query("ab") == {frozenset()}
    assert secrets.trigram_query("(foo|bar)+x*HELLO") == {frozenset({"foo", "hel", "ell", "llo"}), frozenset({"bar", "hel", "ell", "llo"})}
    assert secrets.trigram_query("(foo|z)*key") == {frozenset({"key"})}
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.BASE[0].pattern)


@pytest.mark.parametrize("pattern, text", [("gh[pousr]_[a-z]{3}", "ghp_abc"), (r"a(b|cd)?e\.f", "acde.f"), ("x{3}yz|q+rst", "qqrst"), ("(?i:Ab)c[^d]e", "aBcxe")])
def test_queries_hold_in_matches(pattern, text):
    assert re.search(pattern, text) and any(all(t in text.lower() for t in c) for c in secrets.trigram_query(pattern))


@pytest.mark.parametrize("broadcast", [0, 1 << 21])
def test_scan_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(secrets, "BROADCAST", broadcast)
    rows = [(i if i % 5 else None, t, "r") for i, t in enumerate([*TEXTS, *TEXTS[2:5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string")
    got = secrets.digest(secrets.scan(docs)).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted((str(i), *brute(t)) for i, t, _ in rows)
    kinds = {k.split(":")[0] for r in got for k in r.spans.split(",")}
    assert {"private_key", "github", "slack", "jwt"} <= kinds
    assert secrets.scan(docs.limit(0)).count() == 0
    assert secrets.candidates(secrets.index(docs)).count() == 10  # neither hex alone nor scattered syllables
