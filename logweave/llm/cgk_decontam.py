"""Benchmark decontamination by embedded windows.

The CGK embedding walks over a string: at step j it emits the sign it stands on and moves on by 0 or 1,
as a random function of j and the sign says.  Walks over strings a few edits apart fall into step again,
so edit distance becomes Hamming distance, and equal values at sampled steps are likely.  Each repetition
has its own walk and its own sampled steps; the values there are the key of a window.

For an item, a window begins at each of its bytes; in a document, at every ``STRIDE``-th.  Where keys are
equal, the window of the item's size that lies so is a candidate, and its exact edit distance decides.
Shorter items take more repetitions.

Items too short for walks are cut into one piece more than edits may be: one piece stands unchanged
wherever the item does, and around each place of a piece the exact edit distance decides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.shared import free_name, kept, written

#: Steps of a walk (half as many bytes) and sampled steps.
STEPS, SAMPLED = 48, 12
STRIDE = 12
#: Windows of an item that are tried over all repetitions: so many give a recall of 0.995 in simulations
#: of items of 65 to 160 signs with the most edits that count.  At least so many repetitions, at most.
TRIES, LEAST_REPEATS, MOST_REPEATS = 50, 3, 15
#: Items of up to so many signs are too short for walks: they are searched for by exact pieces.
SHORT_CHARS = 64
#: Signs of a piece that are looked up, at most.
PIECE_SIGNS = 8
#: Edits that still count, as a share of the item's length.
MOST_EDITS = 0.1
#: Text of the items that are searched for in one pass over the documents; more items take more passes.
BLOCK_BYTES = 1 << 20
SEED = 51
_FLAG_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: White space of one, two and three UTF-8 bytes, as ``str.split`` has it.
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WHITE_TWO = np.array([0x85, 0xA0], np.uint8)
_WHITE_THREE = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


class Walks:
    """Random functions and sampled steps of all repetitions."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.moves = rng.integers(0, 2, (MOST_REPEATS, STEPS, 256), dtype=np.int32)
        self.sampled = [set(rng.choice(STEPS, SAMPLED, replace=False).tolist()) | {0} for _ in range(MOST_REPEATS)]

    def keys(self, data: np.ndarray, starts: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks from ``starts``, and where they end; ``data`` is padded by ``STEPS``."""
        at = starts.astype(np.int32)
        key = np.zeros(len(at), np.uint64)
        for j in range(STEPS):
            sign = data.take(at)
            if j in self.sampled[repeat]:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key += sign
            at += self.moves[repeat, j].take(sign)
        return ta.mix64(key), at


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (UTF-8) with A-Z lower-cased, white space runs as one space and none at either end, and where
    each begins.  Items and documents are compared in this form."""
    white = _WHITE[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], _WHITE_TWO)]
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    code = (data[three].astype(np.int32) & 15) << 12 | (data[three + 1].astype(np.int32) & 63) << 6 | data[three + 2] & 63
    three = three[np.isin(code, _WHITE_THREE)]
    for places, size in ((two, 2), (three, 3)):
        for k in range(size):
            white[places + k] = True
    # of a run, its last byte stays if a word comes before it and after it in the text
    keep = ~white
    keep[:-1] |= white[:-1] & ~white[1:]
    last = off[1:][np.diff(off) > 0] - 1
    keep[last] &= ~white[last]
    words = np.concatenate(([0], np.cumsum(~white)))
    spaces = np.flatnonzero(keep & white)
    row = np.searchsorted(off, spaces, "right") - 1
    keep[spaces[words[spaces] == words[off[row]]]] = False
    return np.where(white, np.uint8(32), _LOWER[data])[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def _folded(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return folded(data, np.array([0, len(data)]))[0].tobytes().decode("utf-8", "surrogatepass")


def repeats(size: int) -> int:
    """Repetitions for an item of ``size`` bytes."""
    windows = (size - STEPS // 2) / STRIDE
    return min(MOST_REPEATS, max(LEAST_REPEATS, math.ceil(TRIES / windows))) if windows > 0 else MOST_REPEATS


def _flags(keys: np.ndarray) -> np.ndarray:
    """A bit for each value of the keys' first ``_FLAG_BITS`` bits."""
    flags = np.zeros(1 << _FLAG_BITS, bool)
    flags[keys >> np.uint64(64 - _FLAG_BITS)] = True
    return np.packbits(flags, bitorder="little")


def _flagged(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows whose key may be among those of the flags."""
    at = (keys >> np.uint64(64 - _FLAG_BITS)).astype(np.uint32)
    return np.flatnonzero((flags[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1))


class ShortItems:
    """Pieces of all items of up to ``SHORT_CHARS`` signs, by length, and the items' signs."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number = np.array([k for k, _ in items], np.int64)
        texts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for _, t in items]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.budget = (MOST_EDITS * self.size).astype(np.int64)
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *texts]))
        # bit masks of the signs of each item: (item, sign, mask) in order of item
        entries = sorted((i, c, m) for i, t in enumerate(texts) for c, m in _pattern((np.searchsorted(self.alphabet, t) + 1).tolist()).items())
        self.first = np.searchsorted([e[0] for e in entries], np.arange(len(items) + 1))
        self.sign = np.array([e[1] for e in entries], np.int64)
        self.mask = np.array([e[2] for e in entries], np.uint64)
        pieces: dict[int, list] = {}
        for i, t in enumerate(texts):
            n = int(self.budget[i]) + 1
            cuts = [j * len(t) // n for j in range(n + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                size = min(b - a, PIECE_SIGNS)
                pieces.setdefault(size, []).append((int(_rolling(t[a : a + size], size)[0]), i, a))
        self.tables = []
        for size, found in sorted(pieces.items()):
            found.sort()
            keys = np.array([f[0] for f in found], np.uint64)
            flags = _flags(keys)
            self.tables.append((size, keys, np.array([f[1] for f in found]), np.array([f[2] for f in found]), flags))

    def hits(self, data: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], int]:
        """Least edits by (row, item), where within the item's budget."""
        text, where = _signs(data, off)
        known = np.searchsorted(self.alphabet, text)
        known[known == len(self.alphabet)] = 0
        known = np.where(self.alphabet[known] == text, known + 1, 0)
        best: dict[tuple[int, int], int] = {}
        for size, keys, item, offset, flags in self.tables:
            own = _rolling(text, size)
            hit = _flagged(flags, own)
            lo, hi = np.searchsorted(keys, own[hit], "left"), np.searchsorted(keys, own[hit], "right")
            row = np.searchsorted(where, hit, "right") - 1
            real = (hi > lo) & (hit + size <= where[row + 1])
            hit, lo, hi, row = hit[real], lo[real], hi[real], row[real]
            ends = np.cumsum(hi - lo)
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), "right")))
                at = ta.ragged(lo[a:b], (hi - lo)[a:b])
                rows, places = (np.repeat(x[a:b], (hi - lo)[a:b]) for x in (row, hit))
                self._verify(known, where, rows, item[at], places - offset[at], best)
                a = b
        return best

    def _verify(self, known: np.ndarray, where: np.ndarray, row: np.ndarray, item: np.ndarray, place: np.ndarray, best: dict) -> None:
        """Exact edits of candidates, side by side (bit-parallel); a table of masks for some items at a time."""
        order = np.argsort(item, kind="stable")
        row, item, place = row[order], item[order], place[order]
        distinct = np.unique(item)
        width = len(self.alphabet) + 1
        some = max(1, (1 << 22) // width)
        for a in range(0, len(distinct), some):
            own = distinct[a : a + some]
            lo, hi = np.searchsorted(item, own[0], "left"), np.searchsorted(item, own[-1], "right")
            masks = np.zeros((len(own), width), np.uint64)
            n = self.first[own + 1] - self.first[own]
            at = ta.ragged(self.first[own], n)
            masks[np.repeat(np.arange(len(own)), n), self.sign[at]] = self.mask[at]
            r, i, p = row[lo:hi], item[lo:hi], place[lo:hi]
            edits = self._edits(known, where[r], where[r + 1], masks, np.searchsorted(own, i), self.size[i], self.budget[i], p)
            good = edits <= self.budget[i]
            for key, e in zip(zip(r[good].tolist(), self.number[i[good]].tolist(), strict=True), edits[good].tolist(), strict=True):
                best[key] = min(e, best.get(key, e))

    @staticmethod
    def _edits(known, begin, end, masks, line, size, budget, place) -> np.ndarray:
        plus, minus = np.full(len(place), (1 << 64) - 1, np.uint64), np.zeros(len(place), np.uint64)
        top, one = np.uint64(1) << (size - 1).astype(np.uint64), np.uint64(1)
        score, least = size.copy(), size.copy()
        begin, end = np.maximum(begin, place - budget), np.minimum(end, place + size + budget)
        for j in range(int((end - begin).max(initial=0))):
            at = begin + j
            inside = at < end
            eq = masks[line, np.where(inside, known[np.where(inside, at, 0)], 0)]
            zero = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(zero | plus), plus & zero
            score += ((up & top) != 0).astype(np.int64) - ((down & top) != 0)
            up, down = up << one, down << one
            plus, minus = down | ~(zero | up), up & zero
            np.minimum(least, score, out=least)
        return least


def _rolling(text: np.ndarray, size: int) -> np.ndarray:
    """Keys of the ``size`` signs from each place on."""
    n = max(0, len(text) - size + 1)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key *= np.uint64(ta.BASE)
        key += text[k : n + k]
    return ta.mix64(key + np.uint64(size))


def _signs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and where each text's begin; bytes that are no UTF-8 count as one sign each."""
    raw = data[: off[-1]]
    try:
        text = raw.tobytes().decode("utf-8", "surrogatepass")
        at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    except UnicodeDecodeError:
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        text, at = "".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), at


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.texts = [_folded(t) for _, t in items]
        raw = [t.encode("utf-8", "surrogatepass") for t in self.texts]
        self.walks = Walks()
        walked = [len(t) > SHORT_CHARS for t in self.texts]
        self.short = ShortItems([(k, t) for k, t in enumerate(self.texts) if t and not walked[k]])
        times = [repeats(len(raw[k])) if walked[k] else 0 for k in range(len(raw))]
        self.tables = []
        for r in range(max(times, default=0)):
            keys, item, offset = [], [], []
            for k, data in enumerate(raw):
                if r >= times[k]:
                    continue
                padded = np.frombuffer(data + bytes(STEPS), np.uint8)
                starts = np.arange(len(data))
                found, ends = self.walks.keys(padded, starts, r)
                inside = ends <= len(data)
                keys.append(found[inside])
                item.append(np.full(int(inside.sum()), k, np.int32))
                offset.append(starts[inside].astype(np.int32))
            key = np.concatenate([np.zeros(0, np.uint64), *keys])
            order = np.argsort(key, kind="stable")
            flags = _flags(key)
            self.tables.append((key[order], np.concatenate([np.zeros(0, np.int32), *item])[order], np.concatenate([np.zeros(0, np.int32), *offset])[order], flags))
        self.patterns = [_pattern(t) for t in self.texts]
        self.budget = [int(MOST_EDITS * len(t)) for t in self.texts]

    def candidates(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, place in ``data`` at which the item would begin) of equal keys."""
        lengths = np.diff(off)
        counts = np.maximum(0, (lengths - 1) // STRIDE + 1)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        anchors = np.repeat(off[:-1], counts) + (np.arange(counts.sum()) - np.repeat(first, counts)) * STRIDE
        found = set()
        for a in range(0, len(anchors), 1 << 15):
            part = anchors[a : a + (1 << 15)]
            for r, (keys, item, offset, flags) in enumerate(self.tables):
                key, _ = self.walks.keys(data, part, r)
                hit = _flagged(flags, key)
                lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                real = hi > lo
                hit, lo, hi = hit[real], lo[real], hi[real]
                if not len(hit):
                    continue
                at = ta.ragged(lo, hi - lo)
                place = np.repeat(part[hit], hi - lo)
                row = np.searchsorted(off, place, "right") - 1
                found.update(zip(row.tolist(), item[at].tolist(), (place - offset[at]).tolist(), strict=True))
        yield from sorted(found)


def _pattern(text: Iterable) -> dict:
    masks: dict = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def least_edits(text: str, masks: dict[str, int], size: int) -> int:
    """Least edit distance between a pattern of ``size`` signs and any part of ``text`` (bit-parallel)."""
    ones = (1 << size) - 1
    top = 1 << size - 1
    plus, minus = ones, 0
    score = best = size
    for c in text:
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus) & ones
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & ones
        down = down << 1 & ones
        plus = down | ~(zero | up) & ones
        minus = up & zero
        if score < best:
            best = score
    return best


def _hits(index: Index, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, item, edits) of the items that stand in a document within their budget of edits."""
    if index.short.tables:
        yield from ((*key, edits) for key, edits in index.short.hits(data, off).items())
    grouped: dict[tuple[int, int], list[int]] = {}
    for row, item, place in index.candidates(data, off):
        grouped.setdefault((row, item), []).append(place)
    raw = data.tobytes() if grouped else b""
    for (row, item), places in grouped.items():
        size = len(index.texts[item].encode("utf-8", "surrogatepass"))
        slack = 4 * index.budget[item] + 16
        best = index.budget[item] + 1
        end = None
        for k, place in enumerate(places):
            if end is None:
                begin = place
            end = place
            if k + 1 < len(places) and places[k + 1] - place <= slack and places[k + 1] - begin <= 4 * size:
                continue
            lo, hi = max(int(off[row]), begin - slack), min(int(off[row + 1]), end + size + slack)
            text = raw[lo:hi].decode("utf-8", "ignore")
            best = min(best, least_edits(text, index.patterns[item], len(index.texts[item])))
            end = None
        if best <= index.budget[item]:
            yield row, item, best


def utf8(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array and where each value begins (one more entry)."""
    _, offsets, values = part.buffers()
    if offsets is None or not len(part):
        return np.zeros(0, np.uint8), np.zeros(len(part) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(part.type) else np.int32
    off = np.frombuffer(offsets, kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_groups(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each; a longer text is a range of its own."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to
        at = to


SCHEMA = "doc_id long, h long, item long, n_edits int"


def _search(docs: DataFrame, items: list[tuple]) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(tuple(items)), uuid.uuid4().hex

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("item", pa.int64()), ("n_edits", pa.int32())])
        index = kept(("items", name), lambda: Index(list(shared.value)))
        for batch in parts:
            ids, hashes = batch.column(0), batch.column(1)
            data, off = utf8(batch.column(2))
            rows = []
            for a, b in row_groups(off, ta.PIECE_CHARS):
                part, where = folded(data[off[a] : off[b]], off[a : b + 1] - off[a])
                part = np.concatenate((part, np.zeros(STEPS, np.uint8)))
                rows += [(ids[a + row].as_py(), hashes[a + row].as_py(), item, edits) for row, item, edits in _hits(index, part, where)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = docs.mapInArrow(search, SCHEMA)
    names = docs.sparkSession.createDataFrame([(k, i, len(_folded(t))) for k, (i, t) in enumerate(items)], "item long, item_id long, item_chars int")
    return found.join(F.broadcast(names), "item").select("doc_id", "h", "item_id", "item_chars", "n_edits")


def _text_hash(text_col: str):
    """Hash that tells texts of one id (or of no id) apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _held(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, h, item_id, item_chars, n_edits) of the documents that hold an item; ``h``: the text's hash."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text_hash(text_col).alias("h"), F.coalesce(text, F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found = _search(rows, [(r.item_id, r.text) for r in block])
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, item_chars, n_edits (the least).

    Compared are texts with A-Z lower-cased and white space runs as one space; up to ``MOST_EDITS`` of the
    item's length may differ.  Null or empty texts hold nothing; null, empty and blank items are in no
    document; items of any other length are searched for, those of up to ``SHORT_CHARS`` signs exactly; items of equal text are reported each; repeated documents give
    one row an item.  Empty tables give no row; other columns are left out.

    Documents are read in place, without a shuffle, once for each block of items; a block is broadcast and
    has at most about ``block_bytes`` of text (or one item).
    """
    out = _held(docs, benchmark, id_col, text_col, block_bytes)
    return out.groupBy("doc_id", "item_id").agg(F.min("item_chars").alias("item_chars"), F.min("n_edits").alias("n_edits"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; same columns.  A document is its id and
    its text: other texts of the same id (or without an id) stay."""
    held = written(_held(docs, benchmark).select("doc_id", "h").distinct(), "leaks")
    name = free_name(docs, "_h")
    held = held.select(F.col("doc_id").alias("_" + name), F.col("h").alias("__" + name))
    own = docs.withColumn(name, _text_hash("text"))
    same = own["doc_id"].cast("long").eqNullSafe(held["_" + name]) & (own[name] == held["__" + name])
    return own.join(held, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
