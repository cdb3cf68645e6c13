"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. From its parse tree comes a Boolean query of trigrams in disjunctive form: clauses of trigrams of which every match must
hold all of one. The index has a posting (trigram, text id) for every trigram of a query in every text, case folded; text ids are 64-bit hashes of texts,
so copies share postings, and a collision only adds a candidate. A clause's postings are intersected by a bit-or over its trigrams, which combines before the shuffle; a rule's candidates
are the union over its clauses. Candidates are verified by the expression itself; rules without a mandatory trigram (hex) scan all texts.

Spans are code points, end exclusive: split() and regexp_extract_all() give what lies between and in the matches, and running lengths give the places.
The candidates are a table in the shared folder. Up to BROADCAST of them, by count, are broadcast; beyond that, texts with a posting are joined with them by text id
(hot ids may be split), and the others, which cannot be candidates, stay where they are.

Nulls: a null text is empty; null doc_ids stay null. Repeated rows give repeated results. Empty tables give empty results. Other columns aren't read, whatever their names.
Texts are scanned whole; of spans with one start, that of the earlier rule comes first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Strings that a piece of an expression may stand for before it counts as open.
STRINGS = 64
#: Candidates (16 bytes each) that may be broadcast.
BROADCAST = 1 << 21
Clause = frozenset[str]


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group whose length counts and its least length. Expressions are such that Java and RE2 read them alike."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough: a run is maximal either way
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


# -- Boolean trigram queries ---------------------------------------------------------------------------------------------------------
def _reduced(clauses: set[Clause]) -> set[Clause]:
    return {c for c in clauses if not any(d < c for d in clauses)}


def _all_of(a: set[Clause], b: set[Clause]) -> set[Clause]:
    out = _reduced({x | y for x in a for y in b})
    return out if len(out) <= STRINGS else min(a, b, key=len)  # a weaker query is still necessary


def _of_strings(strings: set[str]) -> set[Clause]:
    return _reduced({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


_ANY: set[Clause] = {frozenset()}


def _class(items: list) -> set[str] | None:
    """The characters of a class, case folded, or None where they are too many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < STRINGS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, set[Clause]]:
    """(all strings that the tree can match, None if open; a query that every match fulfils)."""
    query, now, closed = _ANY, {""}, True

    def flush() -> None:
        nonlocal query, now, closed
        query, now, closed = _all_of(query, _of_strings(now)), {""}, False

    for op, arg in tree:
        if op is C.LITERAL:
            own: set[str] | None = {chr(arg).lower()}
            inner = _ANY
        elif op is C.IN:
            own, inner = _class(arg), _ANY
        elif op is C.SUBPATTERN:
            own, inner = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            own = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            inner = _reduced(set().union(*(p[1] if p[0] is None else _of_strings(p[0]) for p in parts)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            own, inner = _walk(body)
            if low == 0 and high == 1 and own is not None:
                own = own | {""}
            elif low == high and own is not None and len(own) ** low <= STRINGS:
                own = {"".join(x) for x in product(own, repeat=low)}
            else:
                own, inner = None, inner if low else _ANY
        else:
            own, inner = None, _ANY
        if own is None:
            flush()
            query = _all_of(query, inner)
        else:
            if len(now) * len(own) > STRINGS:
                flush()
            now = {a + b for a in now for b in own}
    if closed:
        return now, _of_strings(now)
    flush()
    return None, query


def trigram_query(pattern: str) -> set[Clause]:
    """Clauses of lower-case trigrams: the lower case of any text with a match holds all of one clause. An empty clause: no trigram is mandatory."""
    strings, query = _walk(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


# -- index ---------------------------------------------------------------------------------------------------------------------------
def _clauses(rules) -> list[tuple[int, Clause]]:
    return [(r, c) for r, rule in enumerate(rules) for c in sorted(trigram_query(rule.pattern), key=sorted)]


def vocabulary(rules=RULES) -> list[str]:
    return sorted({t for _, c in _clauses(rules) for t in c})


def index(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Postings (trigram, text_id) of the trigrams that the rules' queries need, for all texts."""
    low = docs.select(F.xxhash64(text_of(text)).alias("text_id"), F.lower(text_of(text)).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary(rules))]))
    return low.select("text_id", F.explode(present).alias("trigram"))


def _has_posting(text: Column, rules) -> Column:
    return F.lower(text).rlike("|".join(re.escape(t) for t in vocabulary(rules)))


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """text_id and rules, the bits of the rules whose query its postings fulfil. Rules without a mandatory trigram are not in it."""
    words = {t: i for i, t in enumerate(vocabulary(rules))}
    clauses = _clauses(rules)
    entries = {i: [] for i in words.values()}
    for c, (_, clause) in enumerate(clauses):
        for bit, t in enumerate(sorted(clause)):
            entries[words[t]].append((c, 1 << bit))
    pair = lambda c, b: F.struct(F.lit(c).alias("clause"), F.lit(b).cast("long").alias("bit"))
    of_trigram = F.array(*[F.array(*[pair(c, b) for c, b in entries[i]]) for i in range(len(words))])
    hits = postings.select("text_id", F.explode(F.element_at(of_trigram, F.col("trigram") + 1)).alias("e"))
    full = F.element_at(F.array(*[F.lit((1 << len(c)) - 1).cast("long") for _, c in clauses]), F.col("clause") + 1)
    whole = hits.groupBy("text_id", F.col("e.clause").alias("clause")).agg(F.bit_or("e.bit").alias("bits")).where(F.col("bits") == full)
    rule_bit = F.element_at(F.array(*[F.lit(1 << r).cast("long") for r, _ in clauses]), F.col("clause") + 1)
    return whole.groupBy("text_id").agg(F.bit_or(rule_bit).alias("rules"))


# -- verification --------------------------------------------------------------------------------------------------------------------
def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end) of the rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    zipped = F.zip_with(F.zip_with(hits, sized, lambda h, s: F.struct(F.length(h).alias("n"), F.length(s).alias("size"))), F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h["n"].alias("n"), h["size"].alias("size"), F.length(g).alias("gap")))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["gap"] + x["n"]).alias("at"),
        F.when(x["size"] >= rule.least, F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(number).alias("kind"), (a["at"] + x["gap"] + x["n"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(zipped, begin, step, lambda a: a["spans"])


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, an array of (start, kind: number of the rule, end) in the order of start and kind, for every row of docs."""
    found = cut(candidates(index(docs, rules, text), rules), "secret-candidates")
    rows = docs.select(F.col(key), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("text_id"))
    if found.count() <= BROADCAST:
        joined = rows.join(F.broadcast(found), "text_id", "left")
    else:
        posted = _has_posting(F.col("text"), rules)
        joined = rows.where(posted).join(found, "text_id", "left").unionByName(rows.where(~posted), allowMissingColumns=True)
    joined = joined.select(key, "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    parts = []
    for n, rule in enumerate(rules):
        possible = F.col("rules").bitwiseAND(F.lit(1 << n)) != 0 if frozenset() not in trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern)
        parts.append(F.when(possible, _spans(F.col("text"), rule, n)).otherwise(none))
    return joined.select(key, F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column, rules=RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, counts of the base kinds, base_sha256 and spans as one string, from scan()."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return scanned.select(key, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle_sql() -> str:
    """digest(scan(documents)) for DuckDB, without an index."""
    places = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        places.append(f"""
            list_filter(list_transform(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1), lambda i: {{
                'start': CAST(coalesce(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}', 0)[1:i - 1], lambda h: length(h))), 0) AS BIGINT),
                'kind': {n}, 'n': length(regexp_extract_all(text, '{p}', 0)[i]), 'size': length(regexp_extract_all(text, '{p}', {r.group})[i]), 'name': '{r.kind}'}}), lambda s: s.size >= {r.least})""")
    text = lambda a: f"array_to_string(list_transform({a}, lambda s: s.name || ':' || s.start || ':' || (s.start + s.n)), ',')"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda s: s.kind = {n})) AS BIGINT) AS n_{r.kind}" for n, r in enumerate(BASE))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS (SELECT doc_id, list_sort({' || '.join(places)}) AS spans FROM d)
        SELECT doc_id, {counts}, sha256(coalesce({text(f'list_filter(spans, lambda s: s.kind < {len(BASE)})')}, '')) AS base_sha256, coalesce({text('spans')}, '') AS spans FROM s"""
