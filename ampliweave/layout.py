"""The layout of an experiment: a YAML file of reads, references and tags (SRC1, TAG3, TAG4, SEQ16)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

SORT_TYPES = ("KnownTag", "DegenerateTag")
ORIENTATIONS = {"Forward": "forward", "Reverse": "reverse", "ReverseComplement": "reverse_complement"}
STRATEGIES = {"Align": "align", "Concatenate": "concatenate", "ConcatenateBothForward": "concatenate_both_forward"}


@dataclass(frozen=True)
class Tag:
    name: str
    symbol: str
    sort_type: str
    length: int
    order: int
    max_distance: int
    file: str | None = None
    reverse_complement: bool = False
    max_gaps: int | None = None
    ratio: float = 5.0
    metric: str = "levenshtein"


@dataclass(frozen=True)
class Reference:
    name: str
    sequence: str
    tags: tuple[Tag, ...] = ()
    targets: tuple[str, ...] = ()
    target_types: tuple[str, ...] = ()

    def target_places(self) -> list[int]:
        return [self.sequence.find(t) for t in self.targets]


@dataclass(frozen=True)
class Layout:
    references: tuple[Reference, ...]
    reads: tuple[tuple[str, str], ...] = ()  # (Read1, Read2, Index1, Index2: orientation; or Spacer: its sequence)
    merge: str | None = None
    known_strand: bool = True
    aligner: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


def _tag(name: str, d: dict[str, Any]) -> Tag:
    if d["sort_type"] not in SORT_TYPES:
        raise ValueError(f"tag {name}: unknown sort_type {d['sort_type']!r}")
    return Tag(
        name, str(d["symbol"]), d["sort_type"], int(d["length"]), int(d["order"]), int(d["max_distance"]), d.get("file"), bool(d.get("reverse_complement_sequences")),
        d.get("max_gaps"), float(d.get("minimum_collapsing_difference") or 5.0), "hamming" if d.get("levenshtein_distance") is False else "levenshtein",
    )


def build(spec: dict[str, Any]) -> Layout:
    """A layout from the mapping that its YAML has; ValueError where names repeat, orders aren't 0 to n - 1, targets and types differ in number or
    aren't in the sequence, or a tag's symbol isn't in it."""
    references, seen = [], set()
    for name, d in spec["references"].items():
        tags = tuple(sorted((_tag(n, t) for n, t in (d.get("umi_configurations") or {}).items()), key=lambda t: t.order))
        r = Reference(name, d["sequence"], tags, tuple(d.get("targets") or ()), tuple(d.get("target_types") or ()))
        names = {t.name for t in tags}
        if len(names) != len(tags) or name in seen:
            raise ValueError(f"reference {name}: a name is there twice")
        seen.add(name)
        if [t.order for t in tags] != list(range(len(tags))):
            raise ValueError(f"reference {name}: tag orders must be 0 to {len(tags) - 1}")
        if len(r.targets) != len(r.target_types):
            raise ValueError(f"reference {name}: {len(r.targets)} targets, {len(r.target_types)} target types")
        if -1 in r.target_places():
            raise ValueError(f"reference {name}: a target isn't in its sequence")
        for t in tags:
            if t.symbol not in r.sequence:
                raise ValueError(f"reference {name}: symbol {t.symbol!r} of tag {t.name} isn't in its sequence")
        references.append(r)
    merge = spec.get("merge")
    if merge is not None and merge not in STRATEGIES:
        raise ValueError(f"unknown merge strategy {merge!r}")
    reads = []
    for item in spec.get("reads") or ():
        kind, d = (item["kind"], item) if "kind" in item else next(iter(item.items()))
        reads.append((kind, d["spacer_sequence"] if kind == "Spacer" else ORIENTATIONS[d["orientation"]]))
    return Layout(tuple(references), tuple(reads), STRATEGIES.get(merge), bool(spec.get("known_strand", True)), spec.get("aligner"))


def load(text: str) -> Layout:
    """build() from YAML text; reads are tagged nodes such as !Read1."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, kind, node: {"kind": kind} | (loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else {}))
    return build(yaml.load(text, Loader))
