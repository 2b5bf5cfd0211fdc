"""Context-triggered piecewise hashing of whole texts.

A rolling hash over 8 bytes ends a chunk where its low bits are all ones; each chunk adds one symbol of
12 bits (two base64 signs) to the signature.  The block size, 2**k bytes a chunk on average, is the
largest one at which the text has 32 chunks or more (or the least size); a fingerprint has the signatures
at that size and at twice that size.  Every chunk has its own symbol: most texts have 32 to 64 or a few
more, those with repeated lines as many as lines trigger.  Two fingerprints are compared where they have a size in common, by the edit
distance of their signatures (insertions and deletions; a change costs two), as a likeness of 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta

WINDOW = 8
LEAST_BITS, MOST_BITS = 3, 30
LEAST_CHUNKS = 32
#: Symbols of signatures that are compared side by side; longer ones are compared one pair at a time.
CHUNKS = 64
BLOCK = 1 << 20
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIGNS = np.frombuffer(SIGNS.encode(), np.uint8)
_BASE, _WORD = ta.BASE, 1 << 64
_BYTES = ta.mix64(np.arange(1, 257, dtype=np.uint64))
_ROLL = np.uint32(0x01000193)


def _block(data: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of the 8 bytes that end at each place from ``skip`` on, and prefix sums of the
    chunk hash over those places (one more)."""
    r = data.astype(np.uint32) + np.uint32(1)
    for step in (1, 2, 4):
        wide = r.copy()
        wide[step:] += r[:-step] * (_ROLL**step)
        r = wide
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x9E3779B1)
    r ^= r >> np.uint32(14)
    own = data[skip:]
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(_BYTES[own] * ta.powers(len(own))[0][: len(own)], out=sums[1:])
    return r[skip:], sums


def _signature(ends: np.ndarray, sums: np.ndarray) -> str:
    """Symbols of the chunks that end at ``ends`` (the last: the text's end); ``sums``: hash sums there."""
    starts = np.append([0], ends[:-1])
    inverse = ta.powers(1)[1]
    turn, place = np.divmod(starts, len(inverse))
    back = inverse[place]
    if turn[-1]:
        whole = [pow(_BASE, -k * len(inverse), _WORD) for k in range(int(turn[-1]) + 1)]
        back = back * np.array(whole, np.uint64)[turn]
    h = (sums - np.append(np.zeros(1, np.uint64), sums[:-1])) * back
    h = ta.mix64(h ^ (ends - starts).astype(np.uint64)) >> np.uint64(52)
    return _SIGNS[np.stack((h >> np.uint64(6), h & np.uint64(63)), 1).astype(np.intp)].tobytes().decode()


def _cuts(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ends of the chunks at 2**``bits``, how many low bits are ones there, hash sums there and of all."""
    n = len(data)
    ends, ones, sums = [], [], []
    before, scale = 0, 1
    low = np.uint32((1 << bits) - 1)
    for at in range(0, n, BLOCK):
        skip = min(at, WINDOW - 1)
        part = np.frombuffer(data, np.uint8, min(BLOCK, n - at) + skip, at - skip)
        roll, prefix = _block(part, skip)
        found = np.flatnonzero((roll & low) == low)
        ends.append(found + at + 1)
        ones.append(np.bitwise_count((~roll[found] & (roll[found] + np.uint32(1))) - np.uint32(1)))
        sums.append(np.uint64(before) + np.uint64(scale) * prefix[found + 1])
        before = (before + scale * int(prefix[-1])) % _WORD
        scale = scale * pow(_BASE, len(roll), _WORD) % _WORD
    return np.concatenate(ends), np.concatenate(ones), np.concatenate(sums), before


def fingerprint(data: bytes) -> str:
    """``block size:signature:signature at twice the size``; empty data have empty signatures."""
    n = len(data)
    if not n:
        return f"{1 << LEAST_BITS}::"
    # a first guess from the length; the boundaries found decide
    least = min(MOST_BITS, max(LEAST_BITS, (n // CHUNKS).bit_length() - 2))
    while True:
        ends, ones, sums, total = _cuts(data, least)
        fit = least
        while fit < MOST_BITS and _chunks(ends, ones, n, fit + 1) >= LEAST_CHUNKS:
            fit += 1
        if least == LEAST_BITS or _chunks(ends, ones, n, fit) >= LEAST_CHUNKS:
            break
        least = max(LEAST_BITS, least - 3)
    out = []
    for bits in (fit, fit + 1):
        own, upto = ends[ones >= bits], sums[ones >= bits]
        if not len(own) or own[-1] != n:
            own, upto = np.append(own, n), np.append(upto, np.uint64(total))
        out.append(_signature(own, upto))
    return f"{1 << fit}:{out[0]}:{out[1]}"


def _chunks(ends: np.ndarray, ones: np.ndarray, n: int, bits: int) -> int:
    """Chunks at 2**``bits``; the text's end ends one."""
    return int((ones >= bits).sum()) + (not len(ends) or ends[-1] != n or ones[-1] < bits)


def _symbols(signatures: list[str], fill: int) -> np.ndarray:
    """One row of up to 64 symbols a signature; ``fill`` behind them."""
    out = np.full((len(signatures), CHUNKS), fill, np.int32)
    for i, s in enumerate(signatures):
        raw = np.frombuffer(s.encode(), np.uint8).astype(np.int32)
        out[i, : len(raw) // 2] = raw[::2] << 8 | raw[1::2]
    return out


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence, in symbols, of each pair of signatures; bit-parallel over all pairs.
    The edit distance is both lengths less twice this."""
    long = [i for i, pair in enumerate(zip(a, b, strict=True)) if max(map(len, pair)) > 2 * CHUNKS]
    if long:
        out = np.zeros(len(a), np.int64)
        out[long] = [_common_long(a[i], b[i]) for i in long]
        rest = np.setdiff1d(np.arange(len(a)), long)
        out[rest] = common([a[i] for i in rest], [b[i] for i in rest])
        return out
    left, right = _symbols(a, -1), _symbols(b, -2)
    v = np.full(len(a), _WORD - 1, np.uint64)
    for j in range(CHUNKS):
        match = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & match
        v = (v + u) | (v & ~match)
    return np.bitwise_count(~v).astype(np.int64)


def _common_long(a: str, b: str) -> int:
    """The same of one pair of signatures of any length."""
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least - head) if x[-1 - i] != y[-1 - i]), least - head)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    ones = (1 << len(x)) - 1
    v = ones
    for c in y:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & ones
    return head + tail + len(x) - v.bit_count()


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of each pair of fingerprints: 1 - distance / both lengths, the best of the sizes that
    both have; 1 for equal ones, 0 without a common size."""
    best = np.zeros(len(a))
    rows, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            best[i] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for size, s in ((p, p1), (2 * p, p2)):
            for other, t in ((q, q1), (2 * q, q2)):
                if size == other and s and t:
                    rows.append(i)
                    left.append(s)
                    right.append(t)
    if rows:
        both = np.array([len(s) + len(t) for s, t in zip(left, right, strict=True)]) / 2
        np.maximum.at(best, rows, 2 * common(left, right) / both)
    return best


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tail, doc_id, text) in order; each with the next one's text gives a result row.  The last
    row of a partition is the first of the next (tail = 1) and gives none."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held: tuple | None = None
    closed = False
    for batch in parts:
        tails, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, texts in ta.batches(batch.column(2)):
            rows: list[tuple] = []
            for k, text in enumerate(texts):
                if closed:
                    break
                text = text or ""
                here = (ids[at + k], text, fingerprint(text.encode()))
                if held is not None:
                    doc_id, own, mark = held
                    half = len(own) // 2
                    edited = (own[: len(own) - half] + text[:half]).encode()
                    rows.append((doc_id, len(own), hashlib.sha256(edited).hexdigest(), mark, fingerprint(edited), here[2]))
                held, closed = here, tails[at + k] == 1
            if rows:
                columns = list(zip(*rows, strict=True))
                near = likeness(list(columns[3]), list(columns[4])), likeness(list(columns[3]), list(columns[5]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*columns[:5], *near], schema, strict=True)], schema=schema)


def _boundaries(docs: DataFrame, parts: int) -> list[float]:
    inner = docs.approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return [float("-inf"), *sorted({x for x in inner if x != float("-inf")}), float("inf")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Edited: the last ``n_chars // 2`` code points replaced by the first as many (or all) of the next
    document in ascending order of id; the first follows the last.  Null texts count as empty; null ids
    stand first, equal ids by a hash of the text; a sole document follows itself; an empty table gives
    no row.  Other columns are left out.

    Documents go to ranges of ids (one shuffle of the texts), each range with the first document of the
    next one at its end; a task holds two documents and a piece of a batch.  All rows of one id are in one
    range: ids are meant to tell documents apart.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("place", place)
    splits = _boundaries(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0.0))
    rows = rows.select(F.col("bucket").cast("int").alias("part"), "doc_id", F.xxhash64("text").alias("h"), "text")
    # one row a range: the ranges are as many as shuffle partitions
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first")).orderBy("part").collect()
    body = rows.select("part", F.lit(0).alias("tail"), "doc_id", "h", "text")
    for_part = {b.part: a.part for a, b in zip(heads, [*heads[1:], *heads[:1]], strict=True)}
    if heads:
        listed = spark.createDataFrame([(h.part, h.first.doc_id, h.first.h, for_part[h.part]) for h in heads], "head int, head_id long, head_h long, part int")
        at_head = rows.select(F.col("part").alias("own"), "doc_id", "h", "text").join(F.broadcast(listed), F.expr("own = head AND doc_id <=> head_id AND h = head_h"))
        body = body.unionByName(at_head.select("part", F.lit(1).alias("tail"), "doc_id", "h", "text"))
    ordered = body.repartitionById(len(splits) - 1, "part").sortWithinPartitions("tail", "doc_id", "h")
    return ordered.select("tail", "doc_id", "text").mapInArrow(_edited_rows, RESULT)
