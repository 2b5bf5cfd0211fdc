"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments, each padded to the 23 bits of the binary Golay code.
Every 23-bit word lies within three bits of exactly one codeword; a word at three bits lies four bits from
five more.  The indices of those codewords (one or six) are its fuzzy keys: two words that differ in up to
two bits have a key in common (tests go through all cosets).  Of two fingerprints that differ in up to two
bits, some segment has no error, and its neighbour at most two: so they meet under the key (segment, its
exact bits, a codeword index of the next segment).

Only different fingerprints are paired, and equal ones count as one vertex.  A bucket of up to ``BUCKET``
fingerprints is compared in one task; those of larger buckets are linked without pairs: two fingerprints
within two bits of each other share one of their 65 neighbours within one bit, and all that share such a
neighbour are within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.cgk_decontam import row_groups, utf8
from logweave.llm.components import Forest, components
from logweave.llm.shared import written

WORDS = 3
SEED = 42
#: bits in which linked fingerprints may differ: as many as the Golay keys of a segment allow
ERRORS = 2
#: bits of each segment, from the lowest
SEGMENTS = (22, 21, 21)
BUCKET = 256
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
#: shingles whose bits are counted at once
COUNTED = 1 << 15

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


# ---- fingerprints

def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes with one space between the words of a text, start and end of each word in
    them, and the first word of each text (one more entry than texts)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = _SPACE[low]
    inner = off[:-1][off[:-1] < len(low)]
    after_word = np.zeros(len(low), bool)
    after_word[1:] = ~space[:-1]
    after_word[inner] = False
    starts = np.flatnonzero(~space & ~after_word)
    stop = space.copy()
    stop[inner] = True
    stops = np.append(np.flatnonzero(stop), len(low))
    ends = stops[np.searchsorted(stops, starts, "right")]
    kept = ~space | after_word
    place = np.cumsum(kept)
    begin = place[starts] - 1 if len(starts) else starts
    norm = np.where(space, np.uint8(32), low)[kept]
    return norm, begin, begin + (ends - starts), np.searchsorted(starts, off)


def _hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of the spans."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def bit_counts(data: np.ndarray, off: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many of its shingles' hashes have each bit set, and how many shingles it has.
    ``whole``: a text of one or two words has one shingle of them all, else none."""
    norm, begin, end, first = words_of(data, off)
    n_words = np.diff(first)
    n = np.maximum(n_words - WORDS + 1, np.minimum(n_words, 1) if whole else 0)
    last = np.minimum(WORDS, n_words) - 1
    where = np.concatenate(([0], np.cumsum(n)))
    left = ta.ragged(first[:-1], n)
    right = left + np.repeat(last, n)
    raw, counts = norm.tobytes(), np.zeros((len(n), 64), np.int64)
    for at in range(0, len(left), COUNTED):
        to = min(at + COUNTED, len(left))
        h = _hashes(raw, begin[left[at:to]], end[right[at:to]])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = np.arange(np.searchsorted(where, at, "right") - 1, np.searchsorted(where, to, "left"))
        rows = rows[n[rows] > 0]
        cut = np.maximum(where[rows] - at, 0)
        counts[rows] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return counts, n


def _long_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bit_counts`` of one text, taken in pieces that end between words; each begins with the last words before it."""
    counts, n = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
    held, at = np.zeros(0, np.uint8), 0
    while at < len(data):
        to = at + ta.PIECE_CHARS
        while to < len(data):
            gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
            to = to + int(gap[0]) if len(gap) else to + 4096
            if len(gap):
                break
        piece = np.concatenate((held, data[at : min(to, len(data))]))
        span = np.array([0, len(piece)], np.int64)
        c, m = bit_counts(piece, span, whole=False)
        counts, n, at = counts + c, n + m, to
        norm, begin, _, first = words_of(piece, span)
        held = norm[begin[max(0, first[-1] - WORDS + 1)] :] if first[-1] else piece[:0]
    if not n[0]:  # fewer words than a shingle has: all of them are held
        return bit_counts(held, np.array([0, len(held)], np.int64))
    return counts, n


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprint of each text (signed 64-bit values)."""
    if len(off) == 2 and len(data) > 2 * ta.PIECE_CHARS:
        counts, n = _long_counts(data)
    else:
        counts, n = bit_counts(data, off)
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64).view(np.int64)


def _marked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        data, off = utf8(batch.column(1))
        for a, b in row_groups(off, ta.PIECE_CHARS):
            own = fingerprints(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.int64())], names=["doc_id", "fp"])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_marked, "doc_id long, fp long")


# ---- Golay keys

def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: zero for the codewords."""
    v = v.copy()
    for k in range(22, 10, -1):
        v ^= ((v >> k) & 1) * (GENERATOR << (k - 11))
    return v


@lru_cache(maxsize=1)
def _patterns() -> np.ndarray:
    """For each syndrome the errors (one of up to three bits, then those of four, -1: none) that lead from
    a word to the codewords nearby."""
    errors = [np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in range(5)]
    table = np.full((2048, 6), -1, np.int64)
    near = np.concatenate(errors[:4])
    table[syndromes(near), 0] = near
    used = np.ones(2048, np.int64)
    far = errors[4]
    for e, s in zip(far.tolist(), syndromes(far).tolist(), strict=True):
        table[s, used[s]] = e
        used[s] += 1
    return table


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word, six columns; -1: no more."""
    errors = _patterns()[syndromes(v)]
    return np.where(errors >= 0, (v[:, None] ^ errors) >> 11, -1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index of the fingerprint, key) of all keys of the fingerprints (signed 64-bit values)."""
    v = fp.view(np.uint64)
    at = np.concatenate(([0], np.cumsum(SEGMENTS)))
    parts = [((v >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in zip(at, SEGMENTS, strict=False)]
    rows, out = [], []
    for s, exact in enumerate(parts):
        near = codewords(parts[(s + 1) % len(parts)])
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        out.append((np.int64(s) << np.int64(34)) | (exact[row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        row, key = keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(key)], names=["fp", "key"])


def _near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the links within each bucket (a list of different fingerprints)."""
    for batch in parts:
        forest = Forest()
        for bucket in batch.column(0):
            fp = np.array(bucket.as_py(), np.int64)
            v = fp.view(np.uint64)
            i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= ERRORS)
            for a, b in zip(fp[i[i < j]].tolist(), fp[j[i < j]].tolist(), strict=True):
                forest.join(a, b)
        yield forest.batch()


def _around(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(neighbour, fp) for each fingerprint's 65 neighbours within one bit."""
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in parts:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
        near = (fp.view(np.uint64)[:, None] ^ flips[None, :]).reshape(-1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fp, len(flips)))], names=["neighbour", "fp"])


def links(different: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (``fp``, all different) as links of up to ``ERRORS`` bits do."""
    keyed = written(different.select("fp").mapInArrow(_keyed, "fp long, key long"), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(keyed.join(sizes, "key"), "simhash-buckets")
    small = met.where(F.col("size") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    near = small.mapInArrow(_near, "a long, b long")
    hot = met.where(F.col("size") > bucket).select("fp").distinct().mapInArrow(_around, "neighbour long, fp long")
    # at most 65 fingerprints have a neighbour in common
    hot = hot.groupBy("neighbour").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    hot = hot.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return near.unionByName(hot)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles are three words in a row,
    repeats included, joined by single spaces; a text of one or two words has one shingle of them all.  A bit
    of the fingerprint is one if it is set in the XXH64 (seed 42) of over half the shingles.  Fingerprints
    that differ in up to two bits are linked; ``component_id`` is the least id reachable through links, the
    document's own included.

    Null, empty and blank texts have the fingerprint zero and are linked like others.  Repeated rows stay
    and are copies.  Rows with a null id keep their fingerprint and component; null is the component's id only
    if no other row is in it.  An empty table gives no row; other columns are left out.
    """
    marks = written(marked(docs, id_col, text_col), "simhash-marks")
    different = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-different")
    roots = components(links(different, bucket), "simhash-components").toDF("fp", "root")
    named = different.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(ids, "root").select("fp", "component_id"), "simhash-named")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marks.join(named, "fp").select("doc_id", fingerprint, "component_id")
