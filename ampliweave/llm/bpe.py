"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct new pieces of a batch form one pool of linked symbols. The index maps each adjacent pair to all its positions in the pool;
the lowest active rank is taken from a heap, all its positions are merged from left to right, and the lists of the pairs that appear are
extended. Within a piece this is the usual order (lowest rank first, then leftmost), so ids equal those of the library that defines the file.

Nulls: a null text encodes as the empty text (no ids). Empty tables give empty results. A document is encoded whole, whatever its length.
Repeated rows give repeated results. Columns of the input other than the key and text columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Pieces, and words, in a generation of those whose ids a worker remembers; there are two generations.
REMEMBERED = 150_000
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACES = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the file's pattern doesn't
_SPLIT = regex.compile(f"[{_SPACES}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """A bounded dictionary: when a batch would make it larger than REMEMBERED, its entries become the old ones, and older ones are dropped."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys of a batch that aren't known. All others are in the dictionary afterwards, whatever it forgets."""
        new = keys.difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.old = dict(self)
            self.clear()
            new = keys
        again = new.intersection(self.old)
        self.update(zip(again, map(self.old.__getitem__, again)))
        return new.difference(again)

    def forget(self) -> None:
        self.clear()
        self.old = {}


def _joined(parts: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    """(ids, tokens, number) of a text from those of its parts."""
    if not parts:
        return "", "", 0
    ids, tokens, n = zip(*parts)
    return " ".join(ids), " ".join(tokens), sum(n)


class PairIndexBpe:
    """Encoder and decoder of one vocabulary file: white-space-free pieces, lower case, an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (*self.vocab.items(), *self.added.items())}
        self.digits = {i: str(i) for i in self.token}
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}  # of left << 20 | right
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(self.vocab[a] << 20 | self.vocab[b], len(self.merges))
            self.merges.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        chars = byte_characters()
        # symbols of the letters within a word, of final letters, and of a word's end, and the ranks of their pairs
        letters = [*(self.vocab[c] for c in chars), *(self.vocab[c + self.suffix] for c in chars)]
        self.letters = np.array([*letters, -1])
        self.letter_rank = np.full((513, 513), -1, np.int32)
        for i, a in enumerate(letters[:256]):
            self.letter_rank[i, :512] = [self.rank.get(a << 20 | b, -1) for b in letters]
        self.known = Recent()  # (ids, tokens, number) of white-space-free pieces of texts
        self.word = Recent()  # and of what they split into

    # -- merging ---------------------------------------------------------------------------------------------------------------
    def encode_pool(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (non-empty bytes), merged together through one pair index."""
        if not words:
            return []
        rank_of = self.rank.get
        letter = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        n = len(letter)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        letter[end - 1] += 256  # a final letter
        letter[end] = 512  # ends the word; no pair has it
        starts = [0, *(end[:-1] + 1).tolist()]
        sym = self.letters[letter].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.letter_rank[letter[:-1], letter[1:]]
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks, begin = np.unique(first[at], return_index=True)
        heap = ranks.tolist()
        index: dict[int, list[int]] = {k: own.tolist() for k, own in zip(heap, np.split(at, begin[1:]))}
        while heap:
            rank = heapq.heappop(heap)
            left, right, made = self.merges[rank]
            for i in sorted(index.pop(rank)):
                if sym[i] != left or sym[j := nxt[i]] != right:
                    continue
                sym[i], sym[j] = made, -2
                k = nxt[i] = nxt[j]
                prv[k] = i
                h = prv[i]
                if h >= 0 and (new := rank_of(sym[h] << 20 | made if sym[h] >= 0 else -1)) is not None:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(heap, new)
                if sym[k] >= 0 and (new := rank_of(made << 20 | sym[k])) is not None:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(heap, new)
        out = []
        for i in starts:
            ids = []
            while sym[i] >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    # -- texts -----------------------------------------------------------------------------------------------------------------
    def normalise(self, piece: str) -> str:
        """Composed and lower case; each code point by itself, so a final sigma keeps its usual form."""
        if piece.isascii():
            return piece.lower()
        piece = unicodedata.normalize("NFC", piece)
        return "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()

    def _split(self, piece: str) -> list[str]:
        piece = self.normalise(piece)
        if piece.isalpha():
            return [piece]
        if piece[:-1].isalpha() and piece[-1] in ",.!?;:":
            return [piece[:-1], piece[-1]]
        return self.words.findall(piece)

    def _learn(self, pieces: set[str]) -> None:
        split = [(p, self._split(p)) for p in pieces]
        words = self.word
        new = list(words.missing({w for _, own in split for w in own}))
        for w, ids in zip(new, self.encode_pool([w.encode() for w in new])):
            words[w] = (" ".join(map(self.digits.__getitem__, ids)), " ".join(map(self.token.__getitem__, ids)), len(ids))
        for piece, own in split:
            if len(own) == 1:
                self.known[piece] = words[own[0]]
            else:
                self.known[piece] = _joined([words[w] for w in own])

    def _pieces(self, text: str) -> list[str]:
        return [p for p in _SPLIT.split(text) if p] if _ODD_SPACES.search(text) else text.split()

    def encode_texts(self, texts: list[str]) -> Iterator[list[tuple[str, str, int]]]:
        """For each text its pieces as (ids joined by a space, tokens joined by a space, number of ids)."""
        parts = []
        for text in texts:
            own: list[tuple[bool, list[str]]] = []
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                own += [(False, self._pieces(text[at : m.start()])), (True, [m[0]])]
                at = m.end()
            own.append((False, self._pieces(text[at:] if at else text)))
            parts.append(own)
        seen: set[str] = set()
        for own in parts:
            for special, pieces in own:
                if not special:
                    seen.update(pieces)
        new = self.known.missing(seen)
        if new:
            self._learn(new)
        known = self.known
        for own in parts:
            out: list[tuple[str, str, int]] = []
            for special, pieces in own:
                out += [(str(self.added[p]), p, 1) for p in pieces] if special else map(known.__getitem__, pieces)
            yield out

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in next(self.encode_texts([text])) for i in x[0].split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library joins tokens where a file names no decoder; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


_EMIT = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _encoded(keys: list, encoded: Iterator[list[tuple[str, str, int]]], emit: tuple[str, ...]) -> Iterator[tuple]:
    for k, own in zip(keys, encoded):
        ids, decoded, n = _joined(own)
        got = {
            "n_tokens": lambda: n,
            "ids": lambda: array("i", map(int, ids.split(" "))) if ids else [],
            "decoded": lambda: decoded,
            "ids_sha256": lambda: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
        }
        yield (k, *(got[e]() for e in emit))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", emit: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """key and, as emit asks, n_tokens, ids, the text decoded from them, and their digests. path: the vocabulary file on every machine.

    Narrow: no shuffle, memory bounded by a batch of documents and twice REMEMBERED pieces and words, which a worker forgets at the end of a task.
    """

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        return _encoded(keys, encoder(path).encode_texts([t or "" for t in texts]), emit)

    def start() -> None:
        gc.freeze()  # the encoder and what is loaded have no cycles worth a search
        gc.disable()  # nor has what a task remembers

    def end() -> None:
        encoder(path).known.forget()
        encoder(path).word.forget()
        gc.enable()

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text)), rows, f"`{key}` {kind}, " + ", ".join(f"{e} {_EMIT[e]}" for e in emit), start, end)
