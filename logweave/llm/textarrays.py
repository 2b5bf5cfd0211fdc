"""Whole texts as numpy arrays: bounded pieces, code points, token spans, span hashes.

Used inside Arrow tasks.  A task never holds more than one piece group (about
``PIECE_CHARS`` characters) in array form; a longer text is cut only at places
where no token or word can cross (before a space between two non-spaces).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PIECE_CHARS = 1 << 20

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
#: odd, so it has an inverse modulo 2**64
BASE = 0xD6E8FEB86659FD93


def batches(column, chars: int = PIECE_CHARS) -> Iterator[tuple[int, list]]:
    """Slices ``(first row, values)`` of an Arrow string column, about ``chars`` bytes each."""
    n, at = len(column), 0
    if n == 0:
        return
    step = max(1, int(n * chars / max(1, column.nbytes)))
    while at < n:
        yield at, column.slice(at, step).to_pylist()
        at += step


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut before a space that stands between
    two non-spaces; a run without such a place stays whole."""
    at, n = 0, len(text)
    while n - at > limit:
        cut = at + limit
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def groups(texts: list, limit: int = PIECE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """``(row of each piece, pieces)`` with about ``limit`` characters a group; null counts as empty."""
    rows: list[int] = []
    out: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in safe_pieces(text or "", limit):
            rows.append(i)
            out.append(piece)
            size += len(piece)
            if size >= limit:
                yield rows, out
                rows, out, size = [], [], 0
    if rows:
        yield rows, out


def codepoints(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all pieces in a row, and where each piece begins (one more entry than pieces)."""
    off = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=off[1:])
    cp = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, off


@lru_cache(maxsize=1)
def packed_classes() -> bytes:
    """Class of every code point (SPACE, LETTER, NUMBER, OTHER) as the tokenizers library sees it,
    compressed: made once on the driver, a few KB in the closure of a task."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(0x110000, OTHER, np.uint8)
    for lo in range(0, 0x110000, 1 << 16):
        chars = [chr(c) if not 0xD800 <= c <= 0xDFFF else "\x00" for c in range(lo, lo + (1 << 16))]
        text = "".join(chars)
        for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            split = pre_tokenizers.Split(Regex(pattern + "+"), behavior="removed", invert=True)
            for _, (a, b) in split.pre_tokenize_str(text):
                table[lo + a : lo + b] = kind
    return zlib.compress(table.tobytes())


@lru_cache(maxsize=1)
def unpacked(packed: bytes) -> np.ndarray:
    """The table of ``packed_classes()``."""
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _runs(cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal class; a piece boundary ends a run."""
    n = len(cls)
    brk = np.empty(n, bool)
    brk[0] = True
    np.not_equal(cls[1:], cls[:-1], out=brk[1:])
    inner = off[:-1]
    brk[inner[inner < n]] = True
    starts = np.flatnonzero(brk)
    ends = np.append(starts[1:], n)
    return starts, ends


def _contractions(cp, cls, rs, re, free) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are one apostrophe (``free``: at a token's start) before 's 't 'm 'd 're 've 'll,
    and how many letters each takes."""
    n = len(cp)
    first = np.flatnonzero(free & (re - rs == 1) & (cp[rs] == 0x27))
    first = first[first + 1 < len(rs)]
    follows = rs[first + 1]
    first, follows = first[cls[follows] == LETTER], follows[cls[follows] == LETTER]
    a = cp[follows]
    nxt = np.minimum(follows + 1, n - 1)
    b = np.where(re[first + 1] - follows >= 2, cp[nxt], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    take = np.where(one, 1, np.where(two, 2, 0))
    return first[take > 0], take[take > 0]


def byte_bpe_spans(cp: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the byte-level pre-tokens (they tile the text): contractions, runs of letters, numbers
    or other signs with one space before, and white space."""
    if not len(cp):
        return np.zeros(0, np.int64)
    cls = classes[cp]
    rs, re = _runs(cls, off)
    kind = cls[rs]
    mask = np.zeros(len(cp), bool)
    mask[rs] = True
    piece_end = np.zeros(len(cp) + 1, bool)
    piece_end[off] = True
    space = np.flatnonzero((kind == SPACE) & ~piece_end[re])
    last = re[space] - 1
    mask[last] = True
    glued = space[cp[last] == 0x20]
    mask[re[glued]] = False
    free = kind == OTHER
    free[glued + 1] = False
    # a run that begins a piece is free whatever stands before it
    at, take = _contractions(cp, cls, rs, re, free & (re < len(cp)) & ~piece_end[np.minimum(re, len(cp))])
    begin = rs[at + 1]
    mask[begin] = False
    rest = begin + take
    inside = rest < re[at + 1]
    mask[rest[inside]] = True
    return np.flatnonzero(mask)


def word_bpe_spans(cp: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of contractions, runs of letters, single numbers and runs of other signs;
    white space is dropped."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes[cp]
    rs, re = _runs(cls, off)
    kind = cls[rs]
    piece_end = np.zeros(len(cp) + 1, bool)
    piece_end[off] = True
    mask = cls == NUMBER
    mask[rs] = True
    at, take = _contractions(cp, cls, rs, re, (kind == OTHER) & ~piece_end[re])
    begin = rs[at + 1]
    mask[begin] = False
    rest = begin + take
    inside = rest < re[at + 1]
    mask[rest[inside]] = True
    starts = np.flatnonzero(mask)
    ends = np.append(starts[1:], len(cp))
    keep = cls[starts] != SPACE
    return starts[keep], ends[keep]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least up to the n-th."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for k, base in enumerate((BASE, inverse)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``values[start:end]``; the place of a span doesn't enter."""
    n = len(values)
    power, inverse = powers(n + 1)
    v = (values.astype(np.uint64) + np.uint64(1)) * _MIX
    v ^= v >> np.uint64(29)
    v *= _MULT
    v *= power[:n]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(v, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= (ends - starts).astype(np.uint64) * _MULT
    return mix64(h)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _MULT
    return h ^ (h >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``start, start + 1, ...`` of every span, one span after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total, dtype=np.int64)
