"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as one symbol per byte in a doubly linked list; a heap
gives the adjacent pair of lowest rank (leftmost first), which is merged until
no listed pair is left.  The count is symbols minus merges; no ids are emitted.
Equal pre-tokens of a worker are merged once (a bounded memory of counts, which
is emptied when full and changes no result).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.shared import Remembered, kept

#: Bytes of pre-tokens' counts that a worker remembers.
REMEMBERED = 32 << 20
#: Longer pre-tokens are counted one by one, without being remembered.
LONG = 256
#: From here on, normalisation is left to the library; below, only case folding is needed.
PLAIN = 0x300


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself where printable,
    else the next sign from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Merge ranks of a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.first = [ids[s] for s in byte_symbols()]
        self.last = [ids[s + end] for s in byte_symbols()]
        self.merged: list[int] = []
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.append(ids[a + b])
            self.rank.setdefault(ids[a] << 20 | ids[b], rank)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        symbol = [self.first[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.rank.get, self.merged
        heap = []
        for i in range(n - 1):
            r = rank(symbol[i] << 20 | symbol[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        left = n
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or rank(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = merged[r], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = rank(symbol[i] << 20 | symbol[k])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank(symbol[h] << 20 | symbol[i])
                if r is not None:
                    heapq.heappush(heap, r << 32 | h)
        return left


class Counter:
    """Counts tokens of whole texts; lives in a Python worker."""

    def __init__(self, path: str, classes: bytes):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.classes = ta.unpacked(classes)
        self.known = Remembered(REMEMBERED)
        self.lower = np.arange(PLAIN, dtype=np.uint32)
        for c in range(PLAIN):
            low = chr(c).lower()
            if len(low) == 1:
                self.lower[c] = ord(low)

    def texts(self, texts: list) -> list[int]:
        """Token count of each text; null counts as empty."""
        total = np.zeros(len(texts), np.int64)
        special = self.merges.special
        for rows, pieces in ta.groups(texts):
            plain_rows, plain = [], []
            for row, piece in zip(rows, pieces, strict=True):
                if special and special.search(piece):
                    parts = special.split(piece)
                    total[row] += len(parts) - 1
                else:
                    parts = [piece]
                plain += [p if p.isascii() else self._normal(p) for p in parts]
                plain_rows += [row] * len(parts)
            np.add.at(total, plain_rows, self._pieces(plain))
        return total.tolist()

    def _normal(self, piece: str) -> str:
        if max(piece) < chr(PLAIN) and "İ" not in piece:
            return piece
        return self.normalizer.normalize_str(piece)

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        cp, off = ta.codepoints(pieces)
        if not len(cp):
            return np.zeros(len(pieces), np.int64)
        small = cp < PLAIN
        cp = np.where(small, self.lower[np.where(small, cp, 0)], cp)
        starts, ends = ta.word_bpe_spans(cp, off, self.classes)
        text = cp.tobytes().decode("utf-32-le", "surrogatepass")
        counts = np.zeros(len(starts), np.int64)
        long = np.flatnonzero(ends - starts > LONG)
        for i in long.tolist():
            counts[i] = self._one(text[starts[i] : ends[i]])
        short = np.flatnonzero(ends - starts <= LONG)
        key, first, back = np.unique(ta.span_hashes(cp, starts[short], ends[short]), return_index=True, return_inverse=True)
        counts[short] = self._distinct(key, text, starts[short][first], ends[short][first])[back]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(sums[np.searchsorted(starts, off)])

    def _distinct(self, key: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.known.size() > self.known.most:
            self.known.forget()
        at = self.known.find(key)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            spans = zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)
            at[missing] = self.known.add(key[missing], [[self._one(text[a:b])] for a, b in spans])
        return self.known.values[at].astype(np.int64)  # one value a slot

    def _one(self, word: str) -> int:
        return self.merges.count(word.encode("utf-8", "surrogatepass"))


def counter(path: str, classes: bytes) -> Counter:
    """The worker's counter of a vocabulary file, kept over tasks."""
    return kept(("counter", path), lambda: Counter(path, classes))


def token_count(text: Column | str, path: str) -> Column:
    """Column with the number of tokens that the vocabulary file at ``path`` (word-end BPE of the
    tokenizers library) gives for the whole text; null and empty texts have none."""
    classes = ta.packed_classes()

    @F.arrow_udf("long")
    def tokens(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path, classes)
        for part in column:
            counts: list[int] = []
            for _, texts in ta.batches(part):
                counts += own.texts(texts)
            yield pa.array(counts, pa.int64())

    return tokens(text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty: 0 bytes, 0 tokens.  Columns of those names are replaced; every other
    column, repeated rows and the number of rows stay.  An empty table stays empty.  No shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    counted = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": token_count(text, path)})
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
