"""Edit events and guide targets (EVT*, FLT10, JON13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENTS = "array<struct<type:string,len:int,pos:int,bases:string>>"
# Target length, and the editing windows of forward and reverse targets, by kind.
TARGETS = {
    "CAS9_DSB": (23, (14, 19), (3, 9)),
    "CAS9_ABE": (23, (2, 19), (3, 21)),
    "CAS9_CBE": (23, (2, 19), (3, 21)),
    "CAS9_PAL_ABE": (26, (2, 19), (2, 19)),
    "CAS12A_DSB": (24, (14, 23), (1, 10)),
}


def parse(text: Column) -> Column:
    """Events of one target, joined by & (EVT1): 10D+44, 1I+177+T, 2S+5+AC, or NONE, WT, UNKNOWN. Anything else is an error."""
    form = r"^(([0-9]+)D\+([0-9]+)|([0-9]+)([IS])\+([0-9]+)\+([A-Za-z]+)|NONE|WT|UNKNOWN)$"
    bad = lambda x: F.raise_error(F.concat(F.lit("no event: "), x))

    def one(x: Column) -> Column:
        part = F.split(x, "\\+")
        short = F.size(part) == 1
        size = F.when(~short, F.regexp_extract(part[0], "^([0-9]+)", 1).try_cast("int"))
        kind = F.when(~x.rlike(form), bad(x).cast("string")).when(short, x).otherwise(F.right(part[0], F.lit(1)))
        return F.struct(kind.alias("type"), size.alias("len"), F.when(short, -1).otherwise(F.get(part, 1).try_cast("int")).alias("pos"), F.get(part, 2).alias("bases"))

    return F.transform(F.split(text, "&"), one).cast(EVENTS)


def render(events: Column) -> Column:
    """The text that parse() reads (EVT2)."""
    one = lambda e: F.when(e["len"].isNull(), e["type"]).otherwise(F.concat_ws("+", F.concat(e["len"].cast("string"), e["type"]), e["pos"].cast("string"), e["bases"]))
    return F.array_join(F.transform(events, one), "&")


def sound(event: Column) -> Column:
    """Whether an event makes sense (EVT3): a deletion has a length and place, an insertion or scar also as many bases of ACGTN."""
    placed = (event["len"] >= 1) & (event["pos"] >= 0)
    based = placed & event["bases"].rlike("^[ACGTNacgtn]+$") & (F.length(event["bases"]) == event["len"])
    return F.coalesce(F.when(event["type"].isin("NONE", "WT", "UNKNOWN"), event["len"].isNull()).when(event["type"] == "D", placed & event["bases"].isNull()).when(event["type"].isin("I", "S"), based), F.lit(False))


def same(a: Column, b: Column) -> Column:
    """All fields equal (EVT4)."""
    return a.eqNullSafe(b)


def from_cigar(ops: Column, read: Column) -> Column:
    """Deletions and insertions of an alignment as events at their place in the reference (EVT6)."""

    def step(a: Column, x: Column) -> Column:
        ref, own = x["op"].isin("M", "D"), x["op"].isin("M", "I", "S")
        event = F.array(F.struct(x["op"].alias("type"), x["len"].alias("len"), a["r"].alias("pos"), F.when(x["op"] == "I", F.substr(read, a["q"] + 1, x["len"])).alias("bases")))
        return F.struct((a["r"] + F.when(ref, x["len"]).otherwise(0)).alias("r"), (a["q"] + F.when(own, x["len"]).otherwise(0)).alias("q"), F.when(x["op"].isin("D", "I"), F.concat(a["out"], event)).otherwise(a["out"]).cast(EVENTS).alias("out"))

    return F.aggregate(ops, F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast(EVENTS).alias("out")), step, lambda a: a["out"])


def last_place(event: Column) -> Column:
    """The last place in the reference that an event touches; an insertion touches one."""
    return event["pos"] + F.when(event["type"] == "D", event["len"] - 1).otherwise(0)


def target_length(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in TARGETS.items() for x in (k, v[0])])[kind]


def window(kind: Column, position: Column, forward: Column) -> Column:
    """(lo, hi), inclusive: the editing window of a target that starts at a place (EVT5)."""
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in TARGETS.items() for x in (k, F.when(forward, v[1][i]).otherwise(v[2][i]))])[kind]
    return F.struct((position + pick(0)).alias("lo"), (position + pick(1)).alias("hi"))


def valid_target(kind: Column, s: Column) -> Column:
    """Length and PAM rules (FLT10); a wrong length is false, an unknown kind null."""
    u = F.upper(s)
    front, back = u.startswith("CC"), u.endswith("GG")
    rule = F.when(kind == "CAS9_PAL_ABE", front & back).when(kind == "CAS12A_DSB", u.startswith("TTT") | u.endswith("AAA")).otherwise(front | back)
    return (F.length(s) == target_length(kind)) & rule


def overlaps(start: Column, stop: Column, lo: Column, hi: Column) -> Column:
    """Inclusive intervals that share a place (JON13)."""
    return (start <= hi) & (stop >= lo)


def at_target(events: Column, lo: Column, hi: Column) -> Column:
    """The events that touch a target's window, as one text in order of their place; WT without any (EVT6, PIPE4)."""
    own = F.array_sort(F.filter(events, lambda e: overlaps(e["pos"], last_place(e), lo, hi)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return F.when(F.size(own) > 0, render(own)).otherwise("WT")
