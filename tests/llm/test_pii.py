import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ampliweave.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return (True, all(int(p) <= 255 for p in s.split(".")) if kind == 1 else 0, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(k, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text("a@.+-5 0(1)é\nAx%", max_size=60) | st.lists(st.sampled_from(["a@b.c", "4111 1111 1111 1111", "+1 (743) 555-3824", "227.5.221.1", ".", "@", "-", " ", "9", "+", "x"]), max_size=9).map("".join))
def test_base_kinds_equal_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] < 4] == brute(text)


def test_added_kinds_and_redaction():
    text = "Mail a@b.co, see https://x.org/a?b=1. SSN 123-45-6789, IBAN GB82 WEST 1234 5698 7654 32 account no: 00123456!"
    spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == [
        ("email", "a@b.co"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("url", "https://x.org/a?b=1"), ("account", "00123456")
    ]
    assert pii.redact(text, spans) == "Mail [EMAIL], see [URL]. SSN [SSN], IBAN [IBAN] account no: [ACCOUNT]!"


def test_ibans_whatever_follows():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    longest = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    unknown = "ZZ" + next(f"{c:02d}" for c in range(98) if pii.iban_valid(f"ZZ{c:02d}12345678901234")) + " 1234 5678 9012 34"
    for text, found in [
        (f"Pay to {de} BIC COBADEFF", [de]), (f"{de} Thanks", [de]), (f"{gb} Amount due", [gb]), (f"{de} 5 days", [de]), (f"{de} {gb}", [de, gb]),
        (f"REF AB12 {de}", [de]), (de.replace(" ", "") + " BIC", [de.replace(" ", "")]), (f"{longest} EUR 1", [longest]), (f"{unknown} AND MORE", [unknown]),
        (de[:-1] + "1 BIC", []), (de[:-3] + " BIC", []), ("NO93 8601 1117 947 X", ["NO93 8601 1117 947"]),
    ]:
        assert [text[a:b] for k, a, b in pii.find(text) if pii.KINDS[k] == "iban"] == found, text


def test_long_runs_are_linear():
    assert pii.find("a" * 2_000_000 + "7" * 2_000_000 + "." * 1000 + "+1" + " " * 1_000_000) == []


def test_tables(spark):
    rows = [(1, "x@y.zz", "p"), (1, "x@y.zz", "p"), (None, None, None), (2, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.scan_digest(docs).collect()), key=str)
    assert [r[:2] for r in got] == [(1, 1), (1, 1), (2, 0), (None, 0)] and got[0][-1] == "email:0:6"
    assert pii.scan_digest(docs.limit(0)).count() == 0
    assert sorted(str(r.text) for r in pii.redact_documents(docs).collect()) == ["", "None", "[EMAIL]", "[EMAIL]"]
