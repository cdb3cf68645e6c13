"""Token counts by a linear longest-match automaton.

Greedy word pieces: from the start of a word the longest piece of the vocabulary that begins there, then the longest continuation piece, and so on. The vocabulary
is a trie over bytes with two roots (pieces that begin a word, pieces that continue one). Each node has a failure link: the node of what is left when as many
pieces are popped as the greedy rule pops, and the number of those pieces, computed once, breadth first. Reading a word is one walk: a step
down the trie for each byte, and failure links when there is none, whose popped counts add up. Links shorten what is pending, so the walk is linear
in the word; no piece is ever built.

A word of which some part matches no piece is one unknown token, as in other word-piece encoders. Words are runs of anything but the six ASCII white-space characters.

Nulls: a null text has no words; null keys stay null. Repeated rows give repeated results. Empty tables give empty results. Texts are read whole, words of
any length. Columns besides the key and the text aren't read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import map_rows, words_of

#: Words whose counts a worker remembers (those of at most LONG characters); at the bound it forgets them and starts anew.
REMEMBERED = 500_000
LONG = 64
_NONE = -1


class LongestMatch:
    """Counts of greedy pieces over (first pieces, continuation pieces), both as bytes. An empty first piece begins the words that no other one begins."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node << 8 | byte -> node
        self.link: list[int] = [_NONE, _NONE]
        self.pops: list[int] = [0, 0]
        piece = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                node = root
                for b in p:
                    nxt = self.step.get(node << 8 | b)
                    if nxt is None:
                        nxt = self.step[node << 8 | b] = len(piece)
                        piece.append(False)
                    node = nxt
                if p or root == 0:
                    piece[node] = True
        self._link(piece)

    def _link(self, piece: list[bool]) -> None:
        below: dict[int, list[tuple[int, int]]] = {}
        for k, node in self.step.items():
            below.setdefault(k >> 8, []).append((k & 255, node))
        self.link = [_NONE] * len(piece)
        self.pops = [0] * len(piece)
        if piece[0]:  # the empty first piece
            self.link[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            above = todo.popleft()
            for b, node in below.get(above, ()):
                if piece[node]:
                    self.link[node], self.pops[node] = 1, 1
                else:
                    at, n = self.link[above], self.pops[above]
                    while at != _NONE and at << 8 | b not in self.step:
                        n += self.pops[at]
                        at = self.link[at]
                    if at != _NONE:
                        self.link[node], self.pops[node] = self.step[at << 8 | b], n
                todo.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of a word, or 0 where the pieces don't make it up."""
        step, link, pops = self.step.get, self.link, self.pops
        node = n = 0
        for b in word:
            while (nxt := step(node << 8 | b)) is None:
                n += pops[node]
                node = link[node]
                if node == _NONE:
                    return 0
            node = nxt
        while node != 1:
            n += pops[node]
            node = link[node]
            if node == _NONE:
                return 0
        return n


def read_vocabulary(path: str, continuation: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """(first, continuation pieces) of a file: with ``continuation`` (such as ##) a text file of one piece a line; else the JSON of a
    byte-level vocabulary, in which pieces that follow a space begin words; the lone space is the empty first piece."""
    if continuation is not None:
        with open(path, encoding="utf-8") as file:
            pieces = [line.rstrip("\n") for line in file]
        return [p.encode() for p in pieces if p and not p.startswith(continuation)], [p[len(continuation) :].encode() for p in pieces if p.startswith(continuation)]
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    value = {c: b for b, c in enumerate(byte_characters())}
    pieces = [bytes(value[c] for c in p) for p in spec["model"]["vocab"] if p not in special]
    return [p[1:] for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


@lru_cache(maxsize=2)
def automaton(path: str, continuation: str | None = None) -> LongestMatch:
    return LongestMatch(*read_vocabulary(path, continuation))


def count_tokens(docs: DataFrame, path: str, continuation: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens (an unknown word is one) and n_unknown of every row. Narrow, no shuffle. path: the vocabulary file on every machine."""
    known: dict[str, int] = {}

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        count = automaton(path, continuation).count
        for k, t in zip(keys, texts):
            words = words_of(t or "")
            try:
                counts = list(map(known.__getitem__, words))
            except KeyError:
                counts = []
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = count(w.encode("utf-8", "surrogatepass"))
                        if len(w) <= LONG:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = n
                    counts.append(n)
            unknown = counts.count(0)
            yield k, len(words), sum(counts) + unknown, unknown

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), rows, f"`{key}` {kind}, n_words long, n_tokens long, n_unknown long")
