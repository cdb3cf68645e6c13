"""Pairwise alignment (ALN*, CIG9): numpy dynamic programming inside of Arrow maps.

Global alignment is affine with three states: match, deletion (the reference has more) and insertion (the read has more). Pairs of one shape in a batch are aligned
together, a row of all their matrices at a time; the only dependency within a row is the running insertion. Of equal scores
the diagonal wins, then the insertion; the last of equal final states starts the way back.

Most pairs need no whole matrix: what leaves a band has so many gaps and so few pairs at most, and where the best within the band scores more than that could, it is the
best of all, with the same ties. So pairs are tried without a gap first, then in bands that widen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

NEVER = -1e12
#: Bytes of ways back that are held at a time.
HELD = 48 << 20
#: Pairs whose matrices are computed together, and the bands that are tried before the whole matrix.
TOGETHER, BANDS = 2048, (1, 4)


@dataclass(frozen=True)
class Scoring:
    """A gap of n costs gap_open + n * gap_extend; at either end of both sequences the extension is scaled by final. N scores special, tag symbols (below ':') symbol;
    with special None they are letters as others are."""

    match: float = 10.0
    mismatch: float = -9.0
    special: float | None = 9.0
    gap_open: float = -20.0
    gap_extend: float = -2.0
    final: float = 1.0
    symbol: float | None = None

    def exact(self) -> bool:
        """Whether sums of these scores are exact in 32 bits and gaps never gain, so that scores can be summed in any order and bounded."""
        values = [v for v in (self.match, self.mismatch, self.special, self.gap_open, self.gap_extend, self.symbol, self.gap_open * self.final, self.gap_extend * self.final) if v is not None]
        return all(abs(v) <= 64 and (v * 16).is_integer() for v in map(float, values)) and self.final >= 0 and self.gap_open <= 0 and self.gap_extend <= 0

    def at_most(self, pairs: int, gaps: int) -> float:
        """No alignment of so many pairs at most and so many gap columns at least, one or more, scores above this."""
        best = max(v for v in (self.match, self.mismatch, self.special, self.symbol) if v is not None)
        return max(best, 0.0) * pairs + min(self.final, 1.0) * (self.gap_open + gaps * self.gap_extend)

    def table(self) -> np.ndarray:
        t = np.full((256, 256), self.mismatch)
        np.fill_diagonal(t, self.match)
        if self.special is None:
            return t
        t[:58] = t[:, :58] = self.special if self.symbol is None else self.symbol
        t[78] = t[:, 78] = self.special
        return t


# The scorings of the align job, of the nucleotide default, of read merging and of a single reference.
ALIGN = Scoring()
NUCLEOTIDE = Scoring(5.0, -4.0, 4.0, -10.0, -0.5, 0.5)
MERGE = Scoring(10.0, -5.0, 8.0, -15.0, -1.0, 0.25)
SIMPLE = Scoring(1.0, -1.0, 1.0, -5.0, -1.0, 1.0, -1.0)
# The scoring of inverted stretches, and what each one costs.
INVERTED, INVERSION = Scoring(9.0, -21.0, None, -25.0, -1.0), -40.0
PRESETS = {"align": ALIGN, "nucleotide": NUCLEOTIDE, "merge": MERGE, "simple": SIMPLE}
Aligned = tuple[str, str, float]
#: Place in ref and in read before and behind a jump, its score, and its (ref_aln, read_aln).
Jump = tuple[int, int, int, int, float, tuple[str, str]]


def _best(up: np.ndarray, left: np.ndarray, diag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, state: 0 diagonal, 1 up, 2 left)."""
    ups, lefts = (up > left) & (up > diag), (up <= left) & (left > diag)
    return np.where(ups, up, np.where(lefts, left, diag)), (ups + 2 * lefts).astype(np.int8)


def _global(ref: np.ndarray, read: np.ndarray, s: Scoring, jumps: Sequence[Sequence[Jump]] = (), band: int | None = None) -> list:
    """Alignments of n pairs of one shape; ref and read are matrices of bytes. With jumps, lists of them for each pair: (parts from the left, score), as _back_over() has them.
    With a band only cells at most so far beside the diagonals of both corners are computed.
    """
    n, rows, cols = len(ref), ref.shape[1], read.shape[1]
    if not rows or not cols:
        return [_edge(bytes(a), bytes(b), s) for a, b in zip(ref, read)]
    table, ways = s.table(), np.zeros((3, rows + 1, n, cols + 1), np.int8)
    place = np.arange(cols + 1, dtype=np.float64)
    edge = (s.gap_open + place * s.gap_extend) * s.final
    m, d, i = np.full((n, cols + 1), NEVER), np.tile(edge, (n, 1)), np.tile(edge, (n, 1))
    m[:, 0], d[:, 0], i[:, 0] = 0.0, NEVER, NEVER
    below, above = (rows, cols) if band is None else (band + max(rows - cols, 0), band + max(cols - rows, 0))
    d[:, above + 1 :] = i[:, above + 1 :] = NEVER
    begin: dict[int, list] = {}  # row -> jumps from it, and to it
    end: dict[int, list] = {}
    for k, own in enumerate(jumps):
        for jump in own:
            begin.setdefault(jump[0], []).append((k, jump))
            end.setdefault(jump[2], []).append((k, jump))
    corner: dict[tuple[int, int, int], tuple[float, int]] = {}
    taken: list[dict] = [{} for _ in range(n)]

    def leave(x: int) -> None:
        for k, jump in begin.get(x, ()):
            corner[k, x, jump[1]] = max((float(t[k, jump[1]]), z) for z, t in enumerate((m, d, i)))

    leave(0)
    for x in range(1, rows + 1):
        ext = np.full(cols + 1, s.gap_extend * (s.final if x == rows else 1.0))
        ext[cols] = s.gap_extend * s.final
        start = s.gap_open + ext
        low, high = max(1, x - below), min(cols, x + above)
        at, before, last = slice(low, high + 1), slice(low - 1, high), min(high, cols - 1) + 1
        score = table[ref[:, x - 1][:, None], read[:, before]]
        m2, d2, i2 = np.full_like(m, NEVER), np.full_like(m, NEVER), np.full_like(m, NEVER)
        if x <= below:
            d2[:, 0] = i2[:, 0] = (s.gap_open + x * s.gap_extend) * s.final
        m2[:, at], ways[0, x, :, at] = _best(d[:, before] + score, i[:, before] + score, m[:, before] + score)
        for k, jump in end.get(x, ()):
            value, z = corner[k, jump[0], jump[1]]
            if value + jump[4] > m2[k, jump[3]]:
                m2[k, jump[3]] = value + jump[4]
                taken[k][x, jump[3]] = (jump, z)
        d2[:, at], ways[1, x, :, at] = _best(d[:, at] + ext[at], i[:, at] + start[at], m[:, at] + start[at])
        e = ext[0]
        if low < last:
            from_base = np.maximum(m2, d2)[:, low - 1 : last - 1] + s.gap_open - e * place[low - 1 : last - 1]
            run = np.maximum.accumulate(np.concatenate([i2[:, low - 1 : low] - e * place[low - 1], from_base], axis=1), axis=1)
            i2[:, low:last] = run[:, 1:] + e * place[low:last]
        if high == cols:
            i2[:, cols] = np.maximum(np.maximum(m2[:, -2], d2[:, -2]) + start[cols], i2[:, cols - 1] + ext[cols])
        ways[2, x, :, at] = _best(d2[:, before] + start[at], i2[:, before] + ext[at], m2[:, before] + start[at])[1]
        m, d, i = m2, d2, i2
        leave(x)
    out = []
    for k in range(n):
        ends = (m[k, cols], d[k, cols], i[k, cols])
        z = max(range(3), key=lambda c: (ends[c], c))
        if jumps:
            out.append((_back_over(ways[:, :, k, :], bytes(ref[k]), bytes(read[k]), z, taken[k]), float(ends[z])))
        else:
            out.append((*_back(ways[:, :, k, :], bytes(ref[k]), bytes(read[k]), z), float(ends[z])))
    return out


def _edge(ref: bytes, read: bytes, s: Scoring) -> Aligned:
    n = len(ref) + len(read)
    return (ref + b"-" * len(read)).decode("latin-1"), (b"-" * len(ref) + read).decode("latin-1"), (s.gap_open + n * s.gap_extend) * s.final if n else 0.0


def _back(ways: np.ndarray, ref: bytes, read: bytes, z: int) -> tuple[str, str]:
    x, y, a, b = len(ref), len(read), bytearray(), bytearray()
    while x and y:
        to = ways[z, x, y]
        if z == 2:
            a.append(45)
        else:
            x -= 1
            a.append(ref[x])
        if z == 1:
            b.append(45)
        else:
            y -= 1
            b.append(read[y])
        z = to
    a += ref[:x][::-1] + b"-" * y
    b += b"-" * x + read[:y][::-1]
    return a[::-1].decode("latin-1"), b[::-1].decode("latin-1")


def _back_over(ways: np.ndarray, ref: bytes, read: bytes, z: int, taken: dict) -> list[tuple[str, str]]:
    """(ref_aln, read_aln) of the stretches from the left: every second one is a jump's, the others lie around the jumps."""
    x, y, end_x, end_y, last, out = len(ref), len(read), len(ref), len(read), z, []
    while x and y:
        if z == 0 and (x, y) in taken:
            jump, to = taken[x, y]
            out += (_back(ways[:, x:, y:], ref[x:end_x], read[y:end_y], last), jump[5])
            x, y = end_x, end_y = jump[:2]
            z = last = to
            continue
        to = int(ways[z, x, y])
        x, y, z = x - (z != 2), y - (z != 1), to
    out.append(_back(ways, ref[:end_x], read[:end_y], last))
    return out[::-1]


def _scores(ref: np.ndarray, read: np.ndarray, s: Scoring, kind: type = np.float32):
    """f(x, low, high): scores of the x-th character of all refs with the characters low to high of their reads, (characters, pairs). ref and read are (characters, pairs)."""
    odd = s.special is not None and bool(((ref < 58) | (ref == 78)).any() or ((read < 58) | (read == 78)).any())
    if not odd:
        gain, base = kind(s.match - s.mismatch), kind(s.mismatch)
        return lambda x, low, high: (read[low:high] == ref[x]) * gain + base
    letters = np.unique(np.concatenate([ref.ravel(), read.ravel()]))
    code = np.zeros(256, np.intp)
    code[letters] = np.arange(len(letters))
    flat = s.table()[np.ix_(letters, letters)].astype(kind).ravel()
    a, b = code[ref] * len(letters), code[read]
    return lambda x, low, high: flat.take(b[low:high] + a[x])


def _ahead(d, i, m, to_d, to_i, to_m):
    """The state that _best() takes of three values with what each one adds: 0 diagonal, 1 up, 2 left."""
    d, i, m = d + to_d, i + to_i, m + to_m
    return np.where(d > np.maximum(i, m), 1, np.where(i > m, 2, 0))


def _exact(ref: np.ndarray, read: np.ndarray, s: Scoring, band: int | None = None, ways: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(scores, operations) of n pairs of one shape by _global()'s rules, for scorings whose sums are exact: operations are (n, columns) of M, D and I, ends first.

    The values of all cells are kept and the ways back are read from them, all pairs a step at a time; without ways only two rows are kept.
    """
    n, rows, cols = len(ref), ref.shape[1], read.shape[1]
    ref, read = np.ascontiguousarray(ref.T), np.ascontiguousarray(read.T)
    kind, never = np.float32, np.float32(NEVER)
    below, above = (rows, cols) if band is None else (min(rows, band + max(rows - cols, 0)), min(cols, band + max(cols - rows, 0)))
    score = _scores(ref, read, s)
    cells = np.full((3, rows + 1 if ways else 2, cols + 1, n), never, kind)
    edge = ((s.gap_open + np.arange(cols + 1) * s.gap_extend) * s.final).astype(kind)[:, None]
    cells[1:, 0, 1 : above + 1] = edge[1 : above + 1]
    cells[0, 0, 0] = 0
    for x in range(1, rows + 1):
        (m, d, i), (m2, d2, i2) = (cells[:, x - 1], cells[:, x]) if ways else (cells[:, (x - 1) % 2], cells[:, x % 2])
        low, high = max(1, x - below), min(cols, x + above)
        e = s.gap_extend * (s.final if x == rows else 1.0)
        if not ways:
            m2[: low] = d2[: low] = i2[: low] = never
            m2[high + 1 :] = d2[high + 1 :] = i2[high + 1 :] = never
        if x <= below:
            m2[0], d2[0], i2[0] = never, (s.gap_open + x * s.gap_extend) * s.final, (s.gap_open + x * s.gap_extend) * s.final
        turn = np.maximum(i[low - 1 : high + 1], m[low - 1 : high + 1])
        np.add(np.maximum(turn[:-1], d[low - 1 : high]), score(x - 1, low - 1, high), out=m2[low : high + 1])
        np.maximum(d[low : high + 1] + kind(e), turn[1:] + kind(s.gap_open + e), out=d2[low : high + 1])
        last = s.gap_extend * s.final
        if high == cols and e != last:
            d2[cols] = np.maximum(d[cols] + kind(last), turn[-1] + kind(s.gap_open + last))
        new = np.maximum(m2[low - 1 : high], d2[low - 1 : high])
        for y in range(low, high + 1):
            ext = last if y == cols else e
            np.add(i2[y - 1], kind(ext), out=i2[y])
            np.maximum(i2[y], new[y - low] + kind(s.gap_open + ext), out=i2[y])
    ends = cells[:, rows if ways else rows % 2, cols]
    z = np.where(ends[2] >= np.maximum(ends[1], ends[0]), 2, np.where(ends[1] >= ends[0], 1, 0))
    best = np.take_along_axis(ends, z[None], axis=0)[0].astype(np.float64)
    if not ways:
        return best, None
    ops = np.zeros((rows + cols, n), np.uint8)
    flat, plane, width, own = cells.reshape(-1), (rows + 1) * (cols + 1) * n, (cols + 1) * n, np.arange(n)
    x, y = np.full(n, rows), np.full(n, cols)
    letter = np.frombuffer(b"MDI", np.uint8)
    for step in range(rows + cols):
        inside = (x > 0) & (y > 0)
        if not inside.any():
            if not (x + y).any():
                break
            ops[step] = np.where(x > 0, 68, np.where(y > 0, 73, 0))
            x, y = np.maximum(x - 1, 0), np.where(x > 0, y, np.maximum(y - 1, 0))
            continue
        kept_z = np.where(inside, z, np.where(x > 0, 1, 2))
        ops[step] = np.where(x + y > 0, letter[kept_z], 0)
        ext = np.where(z == 0, 0.0, np.where(((z == 1) & (y == cols)) | ((z == 2) & ((x == rows) | (y == cols))) | ((z == 1) & (x == rows)), s.gap_extend * s.final, s.gap_extend)).astype(kind)
        start = np.where(z == 0, 0.0, ext + kind(s.gap_open)).astype(kind)
        x, y = x - ((kept_z != 2) & (x > 0)), y - ((kept_z != 1) & (y > 0))
        at = x * width + y * n + own
        to = _ahead(flat.take(at + plane), flat.take(at + 2 * plane), flat.take(at), np.where(z == 1, ext, start), np.where(z == 2, ext, start), start)
        z = np.where(inside, to, z)
    return best, ops.T


def _texts(ref: bytes, read: bytes, ops: bytes) -> tuple[str, str]:
    """Gapped texts by operations from the left."""
    a, b, x, y = [], [], 0, 0
    for run in re.findall(rb"M+|D+|I+", ops):
        k, op = len(run), run[0]
        a.append(b"-" * k if op == 73 else ref[x : x + k])
        b.append(b"-" * k if op == 68 else read[y : y + k])
        x, y = x + k * (op != 73), y + k * (op != 68)
    return b"".join(a).decode("latin-1"), b"".join(b).decode("latin-1")


def _matrix(texts: Sequence[bytes], part: Sequence[int], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(texts[k] for k in part), np.uint8).reshape(len(part), width)


def _settled(a: list[bytes], b: list[bytes], own: list[int], s: Scoring, out: list, ways: bool) -> None:
    """Puts the alignments, or without ways the scores, of pairs of one shape into out: without gaps or in a band where that is enough, else of whole matrices."""
    n, m = len(a[own[0]]), len(b[own[0]])
    short, apart = min(n, m), abs(n - m)
    left = own
    if n == m:
        table, left = s.table(), []
        for at in range(0, len(own), TOGETHER):
            part = own[at : at + TOGETHER]
            for k, v in zip(part, table[_matrix(a, part, n), _matrix(b, part, n)].sum(axis=1).tolist()):
                if v > s.at_most(n - 1, 2):
                    out[k] = (a[k].decode("latin-1"), b[k].decode("latin-1"), v) if ways else v
                else:
                    left.append(k)
    for band in (*BANDS, None):
        band = None if band is None or apart + 2 * band >= short else band
        now, left = left, []
        size = max(1, min(TOGETHER, HELD // (12 * (n + 1) * (m + 1))))
        for at in range(0, len(now), size):
            part = now[at : at + size]
            scores, ops = _exact(_matrix(a, part, n), _matrix(b, part, m), s, band, ways)
            bound = -np.inf if band is None else s.at_most(short - band - 1, apart + 2 * (band + 1))
            for j, (k, v) in enumerate(zip(part, scores.tolist())):
                if v <= bound:
                    left.append(k)
                elif ways:
                    out[k] = (*_texts(a[k], b[k], ops[j].tobytes().rstrip(b"\0")[::-1]), v)
                else:
                    out[k] = v
        if not left:
            return


def _shapes(a: list[bytes], b: list[bytes], s: Scoring) -> dict[tuple, list[int]]:
    """Places of pairs by their lengths, those with a character of a score of its own apart."""
    odd = re.compile(rb"[\x00-\x39N]")
    out: dict[tuple, list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b)):
        out.setdefault((len(x), len(y), s.special is not None and bool(odd.search(x) or odd.search(y))), []).append(k)
    return out


def pair_scores(refs: Sequence[str], reads: Sequence[str], scoring: Scoring = ALIGN) -> list[float]:
    """The scores of align_pairs() alone."""
    if not scoring.exact():
        return [r[2] for r in align_pairs(refs, reads, scoring)]
    a, b = [r.encode("latin-1") for r in refs], [r.encode("latin-1") for r in reads]
    out: list = [None] * len(a)
    for (n, m, _), own in _shapes(a, b, scoring).items():
        if not n or not m:
            for k in own:
                out[k] = _edge(a[k], b[k], scoring)[2]
        else:
            _settled(a, b, own, scoring, out, False)
    return out


def align_pairs(refs: Sequence[str], reads: Sequence[str], scoring: Scoring = ALIGN, band: int | None = None) -> list[Aligned]:
    """Global alignments (ref_aln, read_aln, score) of pairs (ALN1, ALN2, ALN5, ALN6), with a band the best of those within it (ALN3).

    A band as wide as the shorter sequence leaves nothing out.
    """
    if band is not None and band < 0:
        raise ValueError(f"negative band {band}")
    a, b = [r.encode("latin-1") for r in refs], [r.encode("latin-1") for r in reads]
    out: list = [None] * len(a)
    for (n, m, _), own in _shapes(a, b, scoring).items():
        if n and m and band is None and scoring.exact() and n + m < 1 << 16:
            _settled(a, b, own, scoring, out, True)
            continue
        size = max(1, HELD // (3 * (n + 1) * (m + 1)))
        for at in range(0, len(own), size):
            part = own[at : at + size]
            for k, r in zip(part, _global(_matrix(a, part, n), _matrix(b, part, m), scoring, band=band)):
                out[k] = r
    return out


@dataclass(frozen=True)
class Convex:
    """A gap of n costs gap_open + gap_scale * log10(n) and n * gap_extend; bases score as in Scoring. With gap_scale and gap_open 0 gaps are linear."""

    match: float = 10.0
    mismatch: float = -9.0
    gap_open: float = -10.0
    gap_scale: float = -10.0
    gap_extend: float = 0.0

    def gaps(self, n: int) -> np.ndarray:
        """Costs of gaps of 1 to n."""
        length = np.arange(1, n + 1, dtype=np.float64)
        return self.gap_open + self.gap_scale * np.log10(length) + self.gap_extend * length


def align_convex(ref: str, read: str, scoring: Convex = Convex()) -> Aligned:
    """A global alignment whose gaps cost any function of their length (ALN16): each cell looks back over all lengths, cubic time.

    Of equal scores the diagonal wins, then a gap in the read, then the shorter gap.
    """
    a, b = (np.frombuffer(t.encode("latin-1"), np.uint8) for t in (ref, read))
    rows, cols = len(a), len(b)
    gap = scoring.gaps(max(rows, cols, 1))
    best, back = np.full((rows + 1, cols + 1), NEVER), np.zeros((rows + 1, cols + 1), np.int64)  # back: 0 diagonal, n > 0 n rows up, n < 0 -n columns left
    best[0, 0] = 0.0
    for x in range(rows + 1):
        if x:
            up = best[x - 1 :: -1] + gap[:x, None]
            n = up.argmax(axis=0)
            best[x], back[x] = up[n, np.arange(cols + 1)], n + 1
            diag = best[x - 1, :-1] + np.where(b == a[x - 1], scoring.match, scoring.mismatch)
            win = diag >= best[x, 1:]
            best[x, 1:][win], back[x, 1:][win] = diag[win], 0
        for y in range(1, cols + 1):
            left = best[x, y - 1 :: -1] + gap[:y]
            n = int(left.argmax())
            if left[n] > best[x, y]:
                best[x, y], back[x, y] = left[n], -n - 1
    x, y, p, q = rows, cols, "", ""
    while x or y:
        n = int(back[x, y])
        if n > 0:
            p, q, x = ref[x - n : x] + p, "-" * n + q, x - n
        elif n < 0:
            p, q, y = "-" * -n + p, read[y + n : y] + q, y + n
        else:
            p, q, x, y = ref[x - 1] + p, read[y - 1] + q, x - 1, y - 1
    return p, q, float(best[rows, cols])


def _local(ref: np.ndarray, read: np.ndarray, s: Scoring, held: np.ndarray | None) -> np.ndarray:
    """Scores (3, rows + 1, columns + 1, n) of n pairs of one shape, ref and read as (characters, n); nothing is below zero, and held cells are zero."""
    rows, cols, n = len(ref), len(read), ref.shape[1]
    kind = np.float32 if s.exact() else np.float64
    o, e, score = kind(s.gap_open + s.gap_extend), kind(s.gap_extend), _scores(ref, read, s, kind)
    sc = np.zeros((3, rows + 1, cols + 1, n), kind)
    for x in range(1, rows + 1):
        (m, d, i), (m2, d2, i2) = sc[:, x - 1], sc[:, x]
        free = None if held is None else ~held[x]
        turn = np.maximum(i, m)
        np.maximum(np.maximum(turn[:-1], d[:-1]) + score(x - 1, 0, cols), 0, out=m2[1:])
        np.maximum(np.maximum(d[1:] + e, turn[1:] + o), 0, out=d2[1:])
        if free is not None:
            m2[1:] *= free[1:]
            d2[1:] *= free[1:]
        new = np.maximum(np.maximum(m2, d2) + o, 0)
        for y in range(1, cols + 1):
            np.add(i2[y - 1], e, out=i2[y])
            np.maximum(i2[y], new[y - 1], out=i2[y])
            if free is not None:
                i2[y] *= free[y]
    return sc


Local = tuple[str, str, float, int, int]


def local_pairs(refs: Sequence[str], reads: Sequence[str], scoring: Scoring, n: int = 1, least: int | None = None) -> list[list[Local]]:
    """For each pair its n best local alignments that share no cell: (ref_aln, read_aln, score, place in ref, place in read) (ALN4, ALN7, ALN8).
    With ``least`` those behind them too, until one has fewer columns.

    After each one its cells are set to zero and the matrix is computed again. Of equal maxima the one nearest to the start is first, then the least place in ref.
    """
    a, b = [r.encode("latin-1") for r in refs], [r.encode("latin-1") for r in reads]
    out: list[list[Local]] = [[] for _ in refs]
    for (rows, cols, _), own in _shapes(a, b, scoring).items():
        if not rows or not cols:
            continue
        size = max(1, min(TOGETHER, HELD // (28 * (rows + 1) * (cols + 1))))
        for at in range(0, len(own), size):
            part = own[at : at + size]
            p, q = (np.ascontiguousarray(_matrix(t, part, width).T) for t, width in ((a, rows), (b, cols)))
            held, turn = None, 0
            while part and (turn < n or least is not None):
                turn += 1
                found, cells = _tops(_local(p, q, scoring, held), scoring)
                more = []
                for j, (k, (score, x, y, ops)) in enumerate(zip(part, found)):
                    if not score:
                        continue
                    u, v = x - ops.count(b"M") - ops.count(b"D"), y - ops.count(b"M") - ops.count(b"I")
                    out[k].append((*_texts(a[k][u:x], b[k][v:y], ops), score, u, v))
                    if turn < n or least is not None and len(ops) >= max(least, 1):
                        more.append(j)
                if turn >= n and least is None:
                    break
                held = np.zeros((rows + 1, cols + 1, len(part)), bool) if held is None else held
                for x, y, j in cells:
                    held[x, y, j] = True
                if len(more) < len(part):
                    part, p, q, held = [part[j] for j in more], p[:, more], q[:, more], held[:, :, more]
    return out


def _tops(sc: np.ndarray, s: Scoring) -> tuple[list[tuple[float, int, int, bytes]], list[tuple]]:
    """The best local alignment of each pair in _local()'s scores, as (score, ends in ref and read, operations from the left), and the cells of all of them."""
    _, rows, cols, n = sc.shape
    top = sc.max(axis=0).reshape(rows * cols, n)
    order = np.array(sorted(range(rows * cols), key=lambda c: (c // cols + c % cols, c // cols)))
    at = order[top[order].argmax(axis=0)]
    own = np.arange(n)
    score, x, y = top[at, own], at // cols, at % cols
    flat, plane, width = sc.reshape(-1), rows * cols * n, cols * n
    here = flat.take((np.arange(3) * plane)[:, None] + x * width + y * n + own)
    z = np.where(here[2] >= np.maximum(here[1], here[0]), 2, np.where(here[1] >= here[0], 1, 0))
    o, e, ends = sc.dtype.type(s.gap_open + s.gap_extend), sc.dtype.type(s.gap_extend), list(zip(score.tolist(), x.tolist(), y.tolist()))
    ops, cells, letter = np.zeros((rows + cols, n), np.uint8), [], np.frombuffer(b"MDI", np.uint8)
    for step in range(rows + cols):
        on = (x > 0) & (y > 0) & (flat.take(z * plane + x * width + y * n + own) > 0)
        if not on.any():
            break
        cells.append((x[on], y[on], own[on]))
        ops[step] = np.where(on, letter[z], 0)
        x, y = x - (on & (z != 2)), y - (on & (z != 1))
        at = x * width + y * n + own
        open_ = np.where(z == 0, 0, o).astype(sc.dtype)
        to = _ahead(flat.take(at + plane), flat.take(at + 2 * plane), flat.take(at), np.where(z == 1, e, open_), np.where(z == 2, e, open_), open_)
        z = np.where(on, to, z)
    ops = ops.T
    return [(*end, ops[j].tobytes().rstrip(b"\0")[::-1]) for j, end in enumerate(ends)], cells


def local_alignments(ref: str, read: str, scoring: Scoring, n: int = 1) -> list[Local]:
    return local_pairs([ref], [read], scoring, n)[0]


_RC = str.maketrans("ACGTRYKMBVDHSWNacgt", "TGCAYRMKVBHDSWNtgca")


def reverse_complement(s: str) -> str:
    return s.translate(_RC)[::-1]


def cigar_of(ref_aln: str, read_aln: str) -> str:
    if "-" not in ref_aln and "-" not in read_aln:
        n = min(len(ref_aln), len(read_aln))
        return f"{n}M" if n else ""
    out, last, n = [], "", 0
    for x, y in zip(ref_aln, read_aln):
        op = "D" if y == "-" else "I" if x == "-" else "M"
        if op == last:
            n += 1
        else:
            out.append(f"{n}{last}" if n else "")
            last, n = op, 1
    return "".join((*out, f"{n}{last}" if n else ""))


def pairs_with_inversion(refs: Sequence[str], reads: Sequence[str], scoring: Scoring = ALIGN, least: int = 20, penalty: float = -10.0, hits: int = 4, inner: Scoring | None = None) -> list[tuple[str, str, float, str]]:
    """(ref_aln, read_aln, score, cigar) of pairs where stretches of the read may be inverted (ALN9): each stands reverse-complemented, between < and > in the CIGAR.

    The stretches are local alignments with the read's reverse complement, of at least so many reference bases: the best ``hits`` and all behind them until one is
    shorter. They score by ``inner``, or else by scoring; where gaps are so cheap that unrelated bases align at a gain, they run past the ends of what is inverted.
    One global alignment may jump over any number of them; the plain alignment wins ties.
    """
    best = [(a, b, score, cigar_of(a, b)) for a, b, score in align_pairs(refs, reads, scoring)]
    shapes: dict[tuple[int, int], list[tuple[int, list[Jump]]]] = {}
    for k, found in enumerate(local_pairs(refs, [reverse_complement(r) for r in reads], inner or scoring, hits, least)):
        jumps = []
        for x, y, gain, at, start in found:
            n, m = len(x.replace("-", "")), len(y.replace("-", ""))
            if n >= max(least, 1):
                jumps.append((at, len(reads[k]) - start - m, at + n, len(reads[k]) - start, gain + penalty, (x, y)))
        if jumps:
            shapes.setdefault((len(refs[k]), len(reads[k])), []).append((k, jumps))
    for (rows, cols), own in shapes.items():
        size = max(1, HELD // (3 * (rows + 1) * (cols + 1)))
        for i in range(0, len(own), size):
            part = own[i : i + size]
            a, b = (np.frombuffer("".join(t[k] for k, _ in part).encode("latin-1"), np.uint8).reshape(len(part), -1) for t in (refs, reads))
            for (k, _), (parts, score) in zip(part, _global(a, b, scoring, [jumps for _, jumps in part])):
                if score > best[k][2]:
                    cigar = "".join(f"<{cigar_of(*p)}>" if j % 2 else cigar_of(*p) for j, p in enumerate(parts))
                    best[k] = ("".join(p[0] for p in parts), "".join(p[1] for p in parts), score, cigar)
    return best


def align_with_inversion(ref: str, read: str, scoring: Scoring = ALIGN, least: int = 20, penalty: float = -10.0, hits: int = 4) -> tuple[str, str, float, str]:
    return pairs_with_inversion([ref], [read], scoring, least, penalty, hits)[0]


# -- exact seeds -------------------------------------------------------------------------------------------------------------------------
def seeds(ref: str, read: str, least: int = 8) -> list[tuple[int, int, int]]:
    """(place in ref, place in read, length): from the left of the read the longest exact match of at least so many bases, case ignored (ALN11)."""
    ref, read = ref.upper(), read.upper()
    places: dict[str, list[int]] = {}
    for p in range(len(ref) - least + 1):
        places.setdefault(ref[p : p + least], []).append(p)
    out, i = [], 0
    while i + least <= len(read):
        best = (0, 0)
        for p in places.get(read[i : i + least], ()):
            n = least
            while p + n < len(ref) and i + n < len(read) and ref[p + n] == read[i + n] and ref[p + n] in "ACGT":
                n += 1
            best = max(best, (n, -p))
        if best[0]:
            out.append((-best[1], i, best[0]))
            i += best[0]
        else:
            i += 1
    return out


def is_forward(ref: str, read: str, least: int = 8) -> bool:
    """Whether the read's seeds are longer in sum than those of its reverse complement; equal sums mean reverse (ALN12)."""
    total = lambda s: sum(n for _, _, n in seeds(ref, s, least))
    return total(read) > total(reverse_complement(read))


def align_anchored(ref: str, read: str, scoring: Scoring = ALIGN, least: int = 8) -> Aligned:
    """Exact seeds in order, and alignments of what lies between; stretches of one length below 5 bases go base by base (ALN10, ALN17, ALN20)."""
    a, b, score, x, y = "", "", 0.0, 0, 0
    table = scoring.table()
    straight = lambda p, q: float(sum(table[ord(i), ord(j)] for i, j in zip(p, q)))
    for p, q, n in [*seeds(ref, read, least), (len(ref), len(read), 0)]:
        if p < x:
            continue
        u, v = ref[x:p], read[y:q]
        if len(u) == len(v) and len(u) < 5:
            part = (u, v, straight(u, v))
        else:
            part = align_pairs([u], [v], scoring)[0]
        a, b, score = a + part[0] + ref[p : p + n], b + part[1] + read[q : q + n], score + part[2] + straight(ref[p : p + n], read[q : q + n])
        x, y = p + n, q + n
    return a, b, score


# -- clips -------------------------------------------------------------------------------------------------------------------------------
def recover_clips(ref: str, read: str, ops: Sequence[tuple[str, int]], start: int, mode: str = "realign", scoring: Scoring = ALIGN) -> tuple[str, str]:
    """The gapped pair over the whole reference of an alignment at ``start`` (from 0) whose ends are soft-clipped (CIG9).

    mode "realign" aligns each clipped end with the reference that is left there, "match" lays it along the reference base by base, "clip" leaves it out.
    """
    return recovered_clips([ref], [read], [ops], [start], mode, scoring)[0]


def recovered_clips(refs: Sequence[str], reads: Sequence[str], ops: Sequence[Sequence[tuple[str, int]]], starts: Sequence[int], mode: str = "realign", scoring: Scoring = ALIGN) -> list[tuple[str, str]]:
    """recover_clips() of many alignments; their ends are aligned together."""
    out, again = [], []
    for k, (ref, read, own, start) in enumerate(zip(refs, reads, ops, starts)):
        own = [o for o in own if o[0] != "H"]
        left = own[0][1] if own and own[0][0] == "S" else 0
        right = own[-1][1] if len(own) > 1 and own[-1][0] == "S" else 0
        a, b, x, y = "", "", start, left
        for op, n in own[bool(left) : len(own) - bool(right)]:
            a += ref[x : x + n] if op in "MDN=X" else "-" * n
            b += read[y : y + n] if op in "MI=X" else "-" * n
            x, y = x + n * (op in "MDN=X"), y + n * (op in "MI=X")
        parts = [("", ""), (a, b), ("", "")]
        for rest, clip, place in ((ref[:start], read[:left], 0), (ref[x:], read[len(read) - right :] if right else "", 2)):
            if mode == "realign" and clip and rest:
                again.append((k, place, rest, clip))
                continue
            clip = "" if mode == "clip" else clip
            gap = "-" * abs(len(rest) - len(clip))
            if len(clip) < len(rest):
                clip = clip + gap if place else gap + clip
            else:
                rest = rest + gap if place else gap + rest
            parts[place] = (rest, clip)
        out.append(parts)
    for (k, place, *_), done in zip(again, align_pairs([e[2] for e in again], [e[3] for e in again], scoring)):
        out[k][place] = done[:2]
    return [("".join(p[0] for p in parts), "".join(p[1] for p in parts)) for parts in out]


# -- DataFrames --------------------------------------------------------------------------------------------------------------------------
#: Partitions for each core of what rows are dealt to before they are aligned.
PARTS = 4


def _mapped(df: DataFrame, columns: Sequence[str], fields: Sequence[StructField], rows) -> DataFrame:
    """df with further columns from rows(lists of the named columns).

    Rows are dealt out first: a small file is one partition or two, and what is done for each row takes far longer than reading it.
    """
    df = df.repartition(PARTS * df.sparkSession.sparkContext.defaultParallelism)
    at = [df.columns.index(c) for c in columns]
    schema = StructType([*df.schema.fields, *fields])
    kinds = [pa.float64() if isinstance(f.dataType, DoubleType) else pa.bool_() if f.dataType.typeName() == "boolean" else pa.string() for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(*(batch.column(i).to_pylist() for i in at))
            new = [pa.array([r[k] if r is not None else None for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


_ALIGNED = [StructField("ref_aln", StringType()), StructField("read_aln", StringType()), StructField("score", DoubleType()), StructField("cigar", StringType())]


def _sound(of_pairs):
    """of_pairs over the different pairs without a null; None for the others."""

    def rows(refs: list, reads: list) -> list:
        every = [None if a is None or b is None else (a, b) for a, b in zip(refs, reads)]
        pairs = [*dict.fromkeys(p for p in every if p)]
        done = dict(zip(pairs, of_pairs([a for a, _ in pairs], [b for _, b in pairs])))
        return [done.get(p) for p in every]

    return rows


def align(df: DataFrame, scoring: Scoring = ALIGN, reference: str = "reference", read: str = "seq", band: int | None = None) -> DataFrame:
    """df with ref_aln, read_aln, score and cigar of its pairs (ALN2, ALN3); null where either is null. """

    return _mapped(df, [reference, read], _ALIGNED, _sound(lambda a, b: [(*r, cigar_of(r[0], r[1])) for r in align_pairs(a, b, scoring, band)]))


def convex(df: DataFrame, scoring: Convex = Convex(), reference: str = "reference", read: str = "seq") -> DataFrame:
    """As align(), with gaps of convex cost."""
    return _mapped(df, [reference, read], _ALIGNED, _sound(lambda a, b: [(*r, cigar_of(r[0], r[1])) for r in (align_convex(x, y, scoring) for x, y in zip(a, b))]))


def with_inversions(df: DataFrame, scoring: Scoring = ALIGN, reference: str = "reference", read: str = "seq", least: int = 20, penalty: float = -10.0, inner: Scoring | None = None) -> DataFrame:
    """As align(), with inversions."""
    return _mapped(df, [reference, read], _ALIGNED, _sound(lambda a, b: pairs_with_inversion(a, b, scoring, least, penalty, inner=inner)))


def aligner(name: str | None, scoring: Scoring):
    """(function of align()'s kind, scoring) of a layout's aligner (ALN18): degenerate (N and tag symbols have their own score), wfa (all symbols are plain
    letters, the optimum that wavefronts find), inversion (scored by INVERTED and INVERSION). Case is ignored; None is degenerate."""
    name = (name or "degenerate").lower()
    if name not in ("degenerate", "wfa", "inversion"):
        raise ValueError(f"unknown aligner {name!r}")
    return partial(with_inversions, penalty=INVERSION, inner=INVERTED) if name == "inversion" else align, replace(scoring, special=None) if name == "wfa" else scoring


def local(df: DataFrame, scoring: Scoring = ALIGN, reference: str = "reference", read: str = "seq", place: int = 0) -> DataFrame:
    """df with ref_part and read_part of the best local alignment, or of the place-th next one; empty where there is none."""
    fields = [StructField("ref_part", StringType()), StructField("read_part", StringType())]
    return _mapped(df, [reference, read], fields, _sound(lambda a, b: [(f + [("", "")] * (place + 1))[place][:2] for f in local_pairs(a, b, scoring, place + 1)]))


def oriented(df: DataFrame, reference: str = "reference", read: str = "seq") -> DataFrame:
    """df with column forward: whether the read has the reference's strand (ALN12)."""
    from pyspark.sql.types import BooleanType

    return _mapped(df, [reference, read], [StructField("forward", BooleanType())], lambda refs, reads: [None if a is None or b is None else (is_forward(a, b),) for a, b in zip(refs, reads)])


def align_to_best(reads: DataFrame, references: DataFrame, candidates: str, scoring: Scoring = ALIGN, key: str = "read_id", read: str = "seq", using=align) -> DataFrame:
    """Each read with the best of its candidate references (an array of names), of equal scores the greatest name (ALN15, TOP1). using: align or with_inversions.

    Each different sequence is scored against each of its candidates once, and only the best one is aligned in full (with using=align). Candidates are exploded and joined
    by name, so what a task holds doesn't grow with the number of references.
    """
    names = references.select(F.col("name").alias("ref_name"), F.col("sequence").alias("reference"))
    own = reads.select(read, candidates).distinct()
    pairs = own.withColumn("ref_name", F.explode(candidates)).join(names, "ref_name")
    if using is align:
        done = _mapped(pairs, ["reference", read], [StructField("score", DoubleType())], _sound(lambda a, b: [(v,) for v in pair_scores(a, b, scoring)]))
    else:
        done = using(pairs, scoring, "reference", read)
    more = [c for c in done.columns if c not in ("ref_name", read, candidates)]
    best = done.groupBy(read, candidates).agg(F.max_by(F.struct("ref_name", *more), F.struct("score", "ref_name")).alias("__b")).select(read, candidates, "__b.*")
    if using is align:
        best = align(best.drop("score"), scoring, "reference", read)
        more = ["reference", "ref_aln", "read_aln", "score", "cigar"]
    best = best.select(F.col(read).alias("__seq"), F.col(candidates).alias("__names"), "ref_name", *more)
    joined = reads.join(best, F.col(read).eqNullSafe(F.col("__seq")) & F.col(candidates).eqNullSafe(F.col("__names")))
    return joined.select(key, "ref_name", *[c for c in reads.columns if c not in (key, candidates)], *more)
