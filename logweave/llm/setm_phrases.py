"""Phrase collocations by SETM relational mining.

The relation of length k has a row (place, word) for each word of an occurrence of a frequent phrase of k
words, sorted by place: the piece and the position in it as one number, counted up by one from word to word
and by two between pieces.  A step merge-joins the relation with itself at adjacent places into the
occurrences of k + 1 words, counts them by group, keeps the frequent groups and semi-joins the occurrences with
them; what is left is written as the relation of length k + 1.

Relations are written in blocks, a row for the words of about 64 KB of text, with its places and words as
sorted arrays.  Pieces don't cross documents, so a block joins with itself alone; a longer text goes
on in the next block, which begins with the last words of the one before (``known`` words, whose phrases are
counted there).  Words are 64-bit hashes of language and word; a pair of words with one
hash shows in the word counts, and the work begins again with another seed.

Counts are summed over arrays: a task sums those of its blocks up to ``HELD`` rows, cuts them into buckets by
hash and sends one row a bucket, its columns as packed arrays; a bucket is summed and filtered in one piece.
The JVM thus sees arrays and frequent phrases, never a row an occurrence.

The semi-join asks a filter of fixed size, broadcast: it passes all frequent groups and a few others, whose
phrases are counted exactly and go by their counts.  Beyond its size it passes more and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.cgk_decontam import row_groups, utf8
from logweave.llm.shared import written

MAX_WORDS, LEAST, TOP = 3, 10, 2_000
#: per cent of a candidate's occurrences within one longer candidate that make it go
COVERED = 50
SCALE = 1_000_000
#: the filter: so many parts of so many bits
FILTER_PARTS, PART_BITS, PROBES = 256, 1 << 19, 3
#: bytes of text whose words are hashed at once
BLOCK = 1 << 16
#: counted phrases that a task holds at once, buckets a shuffle partition has at least, occurrences a bucket has
#: about, bytes of buckets sent at once
HELD, SPREAD, PER_BUCKET, SENT = 1 << 20, 8, 1 << 20, 1 << 22
#: parts of a language that are ranked one by one before the best of them are ranked together
SHARES = 32
#: of relations: a writer holds one row group, and the arrays have nothing to gain from a dictionary
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}

_BREAK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + [10, 11, 12, 13])
_GAP = _BREAK | np.isin(np.arange(256), [9, 32])
_LOWER = bytes(range(256)).lower()
#: 0 in words, 1 between words, 2 between pieces
_CLASS = (_GAP.astype(np.uint8) + _BREAK).tobytes()
RELATION = "known int, place binary, word binary"


# ---- words and places

def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, starts and ends of the words, and their places."""
    raw = data.tobytes()
    low, kind = np.frombuffer(raw.translate(_LOWER), np.uint8), np.frombuffer(raw.translate(_CLASS), np.uint8)
    word = kind == 0
    inner = off[:-1][off[:-1] < len(low)]
    before = np.zeros(len(low), bool)
    before[1:] = word[:-1]
    before[inner] = False
    after = np.zeros(len(low), bool)
    after[:-1] = word[1:]
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    doc = np.searchsorted(off, starts, "right")
    new = np.zeros(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    return low, starts, ends, np.arange(len(starts)) + np.cumsum(new)


def language_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word with the key of its language."""
    return ta.mix64(ta.span_hashes(low.astype(np.uint32) + np.uint32(256 * seed), starts, ends) ^ langs)


def texts_in_blocks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, words known from the block before) for blocks of about
    ``BLOCK`` bytes; a longer text is cut between words into blocks of its own."""
    for a, b in row_groups(off, BLOCK):
        own = data[off[a] : off[b]]
        if b - a > 1 or len(own) <= 2 * BLOCK:
            yield a, b, own, off[a : b + 1] - off[a], 0
            continue
        at, held, known = 0, own[:0], 0
        while at < len(own):
            to = at + BLOCK
            while to < len(own):
                gap = np.flatnonzero(_GAP[own[to : to + 4096]])
                to += int(gap[0]) if len(gap) else 4096
                if len(gap):
                    break
            to = min(to, len(own))
            piece = np.concatenate((held, own[at:to]))
            span = np.array([0, len(piece)], np.int64)
            yield a, b, piece, span, known
            starts = words_of(piece, span)[1]
            known = min(len(starts), MAX_WORDS - 1)
            held = piece[starts[-known] :] if known else piece[:0]
            at = to


def _strings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    where = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    raw = low[ta.ragged(starts, ends - starts)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(raw))


def _blocks(parts: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    for batch in parts:
        names = batch.column(0).to_pylist()
        keys = np.array([language_key(x) for x in names], np.uint64)
        data, off = utf8(batch.column(1))
        for a, _, own, span, known in texts_in_blocks(data, off):
            low, starts, ends, place = words_of(own, span)
            doc = np.searchsorted(span, starts, "right") - 1 + a
            yield names, doc, low, starts, ends, place, word_hashes(low, starts, ends, keys[doc], seed), known


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each run of equal ones begins in it."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _counted_words(parts: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, f) for the words of each batch of texts."""
    for part in parts:
        texts, words, hashes, counts = [], [], [], []
        names: list[str] = []
        for names, doc, low, starts, ends, _, h, known in _blocks([part], seed):  # noqa: B007
            doc, starts, ends, h = doc[known:], starts[known:], ends[known:], h[known:]
            order, begin = runs(h)
            at = order[begin]
            texts.append(doc[at].astype(np.int32))
            words.append(_strings(low, starts[at], ends[at]))
            hashes.append(h[at])
            counts.append(np.diff(np.append(begin, len(h))))
        if hashes:
            yield _merged(names, np.concatenate(texts), pa.concat_arrays(words), np.concatenate(hashes), np.concatenate(counts))


def _merged(names: list[str], text: np.ndarray, word: pa.Array, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a hash; if two words, or one of two languages, have the same, all rows stay."""
    order, begin = runs(h)
    again = np.ones(len(h), bool)
    again[begin] = False
    (other,) = np.nonzero(again)
    ranks = {x: k for k, x in enumerate(dict.fromkeys(names))}
    lang = np.array([ranks[x] for x in names], np.int32)[text]
    same = pc.equal(word.take(pa.array(order[other])), word.take(pa.array(order[other - 1])))
    f = np.add.reduceat(n[order], begin) if len(h) else n
    if not (pc.all(same, min_count=0).as_py() and (lang[order[other]] == lang[order[other - 1]]).all()):
        begin, f = np.arange(len(h)), n[order]
    at = order[begin]
    langs = pa.array(list(ranks), pa.string()).take(pa.array(lang[at]))
    return pa.RecordBatch.from_arrays([langs, word.take(pa.array(at)), pa.array(h[at].view(np.int64)), pa.array(f)], names=["lang", "word", "h", "f"])


# ---- buckets

def _packed_schema(columns: list[tuple[str, str]]) -> str:
    """Of the buckets of rows with these columns (name, type): strings have their bytes and their lengths."""
    return ", ".join(["bucket int", *[f"{c} binary" + f", {c}_n binary" * (kind == "string") for c, kind in columns]])


def _packed(batch: pa.RecordBatch, cut: np.ndarray) -> pa.RecordBatch:
    """One row a bucket, whose columns (64-bit numbers and strings) are the packed arrays of its rows; bucket k has the rows from
    ``cut[k]`` to ``cut[k + 1]``."""
    names, out = ["bucket"], [pa.array(np.arange(len(cut) - 1, dtype=np.int32))]

    def add(name, raw, ends):
        names.append(name)
        out.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]))

    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_string(column.type):
            raw, off = utf8(column)
            add(name, raw, off[cut])
            add(f"{name}_n", np.diff(off), cut * 8)
        else:
            add(name, np.ascontiguousarray(column.to_numpy(zero_copy_only=False)), cut * 8)
    return pa.RecordBatch.from_arrays(out, names=names)


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows of a binary column."""
    return np.concatenate([np.zeros(0, np.uint8), *[utf8(x.cast(pa.binary()))[0] for x in column.chunks]])


def _unpacked(table: pa.Table, columns: list[tuple[str, str]]) -> dict[str, np.ndarray | pa.Array]:
    """The columns of the rows of packed buckets, numbers as unsigned ones."""
    out = {}
    for name, kind in columns:
        raw = _raw(table.column(name))
        if kind == "string":
            off = np.concatenate(([0], np.cumsum(_raw(table.column(f"{name}_n")).view(np.int64))))
            out[name] = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw)])
        else:
            out[name] = raw.view(np.uint64)
    return out


def _dealt(parts: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of each batch as packed buckets, by ``keys_of`` the batch; a few buckets at a time."""
    for batch in parts:
        keys = keys_of(batch)
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, batch = keys[order], batch.take(pa.array(order))
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        packed = _packed(batch, np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)))
        step = max(1, buckets * SENT // max(1, batch.nbytes))
        for a in range(0, buckets if batch.num_rows else 0, step):
            yield packed.slice(a, step)
        pa.default_memory_pool().release_unused()  # else the worker keeps it for the steps after


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)).view(np.uint64) for c in columns]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---- relations

def group_keys(words: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of each phrase (columns of words), for the filter."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = ta.mix64(out + w)
    return out


def _probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part of the filter and the bits in it that each key sets."""
    part = (keys >> np.uint64(48)).astype(np.int64) % FILTER_PARTS
    x, y = keys & np.uint64(0xFFFFFF), (keys >> np.uint64(24)) & np.uint64(0xFFFFFF) | np.uint64(1)
    bits = (x[:, None] + y[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(PART_BITS)
    return part, bits.astype(np.int64)


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        keys = group_keys([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).view(np.uint64) for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(_probes(keys)[0]), pa.array(keys.view(np.int64))], names=["part", "key"])


def _filter_part(table: pa.Table) -> pa.Table:
    bits = np.zeros(PART_BITS, bool)
    bits[_probes(table.column("key").to_numpy().view(np.uint64))[1].reshape(-1)] = True
    return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def group_filter(groups: DataFrame):
    """The filter over the phrases in ``groups`` (columns of words), broadcast: ``FILTER_PARTS`` times
    ``PART_BITS`` bits (16 MB) for any number of them."""
    keyed = groups.mapInArrow(_keyed, "part long, key long")
    bits = np.zeros((FILTER_PARTS, PART_BITS // 8), np.uint8)
    for row in keyed.groupBy("part").applyInArrow(_filter_part, "part long, bits binary").toLocalIterator():
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return groups.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter passes."""
    flat, out = bits.reshape(-1), np.ones(len(keys), bool)
    part, at = _probes(keys)
    for k in range(PROBES):
        byte = part * (PART_BITS // 8) + (at[:, k] >> 3)
        out &= ((flat[byte] >> (at[:, k] & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def joined(place: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a relation at which ``size`` words stand at adjacent places, and their words."""
    n = max(0, len(place) - size + 1)
    at = np.flatnonzero(place[size - 1 :] == place[:n] + (size - 1)) if n else np.zeros(0, np.int64)
    return at, [words[at + k] for k in range(size)]


def semi_joined(place: np.ndarray, words: np.ndarray, known: int, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The relation (and its number of known words) without the words that are in no phrase of ``size`` words
    that passes; a gap comes between neighbours that no such phrase holds both of."""
    at, phrase = joined(place, words, size)
    at = at[passes(bits, group_keys(phrase))]
    kept = np.zeros(len(place), bool)
    bound = np.full(len(place), size == 1)
    for k in range(size):
        kept[at + k] = True
        if k:
            bound[at + k] = True
    return place[kept] + np.cumsum(~bound[kept]), words[kept], int(kept[:known].sum())


def _relation(place: np.ndarray, words: np.ndarray, known: int) -> pa.RecordBatch:
    raw = [pa.array([x.tobytes()], pa.binary()) for x in (place.astype(np.int32), words)]
    return pa.RecordBatch.from_arrays([pa.array([known], pa.int32()), *raw], names=["known", "place", "word"])


def _arrays(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for batch in parts:
        for k in range(batch.num_rows):
            place, words = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((1, np.int32), (2, np.uint64)))
            yield place.astype(np.int64), words, batch.column(0)[k].as_py()


def summed(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Pieces (key, w1 .. w_size, f) as one, sorted by key, with one row a phrase; ``held`` is emptied."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    key, f = np.concatenate(columns.pop(0)), np.concatenate(columns.pop())
    order, begin = runs(key)
    new = np.zeros(len(order), bool)
    new[begin] = True
    words = []
    while columns:
        w = np.concatenate(columns.pop(0))[order]
        if (~new[1:] & (w[1:] != w[:-1])).any():  # two phrases of one key: sorted by all words as well
            words = [*[_back(x, order) for x in words], _back(w, order), *[np.concatenate(x) for x in columns]]
            order = np.lexsort([*words, key])
            words = [x[order] for x in words]
            for x in words:
                new[1:] |= x[1:] != x[:-1]
            begin = np.flatnonzero(new)
            break
        words.append(w)
    return [key[order][begin], *[w[begin] for w in words], np.add.reduceat(f[order], begin) if len(f) else f]


def _back(column: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A column as it was before it was put in this order."""
    out = np.empty_like(column)
    out[order] = column
    return out


def _phrases(size: int, words: list[np.ndarray], f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (*words, f)], names=[*_columns(size), "f"])


def _counted_phrases(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(w1 .. w_size, f) for the phrases of as many blocks as ``HELD`` rows allow; those within a block's known words are left out."""
    held: list[list[np.ndarray]] = []
    n = 0
    for place, words, known in _arrays(parts):
        at, phrase = joined(place, words, size)
        phrase = [w[at + size > known] for w in phrase]
        held.append([group_keys(phrase), *phrase, np.ones(len(phrase[0]), np.int64)])
        n += len(phrase[0])
        if n >= HELD:
            held = [summed(held)]
            n = len(held[0][0])
            if n > HELD // 2:
                _, *phrase, f = held.pop()
                yield _phrases(size, phrase, f)
                n = 0
    if held:
        _, *phrase, f = summed(held)
        yield _phrases(size, phrase, f)


def _columns(size: int) -> list[str]:
    return [f"w{k + 1}" for k in range(size)]


# ---- the steps

def _first_relation(pieces: DataFrame, bits, seed: int) -> DataFrame:
    """Occurrences of frequent words."""

    def rows(parts):
        for _, _, _, _, _, place, h, known in _blocks(parts, seed):
            yield _relation(*semi_joined(place, h, known, 1, bits.value))

    return pieces.mapInArrow(rows, RELATION)


def _next_relation(relation: DataFrame, bits, size: int) -> DataFrame:
    """Occurrences of frequent phrases of ``size`` words."""

    def rows(parts):
        for place, words, known in _arrays(parts):
            yield _relation(*semi_joined(place, words, known, size, bits.value))

    return relation.mapInArrow(rows, RELATION)


def _groups(relation: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """(w1 .. w_size, f) of the phrases with ``least`` occurrences or more."""
    columns = [(c, "long") for c in [*_columns(size), "f"]]

    def dealt(parts):
        yield from _dealt(_counted_phrases(parts, size), lambda batch: group_keys(_numbers(batch, _columns(size))), buckets)

    def frequent(table: pa.Table) -> pa.Table:
        *words, f = _unpacked(table, columns).values()
        _, *words, f = summed([[group_keys(words), *words, f.view(np.int64)]])
        return pa.Table.from_batches([_phrases(size, [w[f >= least] for w in words], f[f >= least])])

    found = relation.mapInArrow(dealt, _packed_schema(columns))
    return found.groupBy("bucket").applyInArrow(frequent, ", ".join(f"{c} long" for c, _ in columns))


def _one_row_a_word(table: pa.Table) -> pa.Table:
    """(lang, word, h, f) with the counts of equal words summed."""
    out = table.group_by(["lang", "word", "h"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
    return out.cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("f", pa.int64())]))


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted words of several batches as one."""
    held: list[pa.RecordBatch] = []
    for batch in parts:
        held.append(batch)
        if sum(x.nbytes for x in held) >= 4 * SENT:
            yield from _one_row_a_word(pa.Table.from_batches(held)).combine_chunks().to_batches()
            held = []
    if held:
        yield from _one_row_a_word(pa.Table.from_batches(held)).combine_chunks().to_batches()


def _words(pieces: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, f) of all words."""
    columns = [("lang", "string"), ("word", "string"), ("h", "long"), ("f", "long")]
    buckets = SPREAD * _partitions(pieces)

    def dealt(parts):
        yield from _dealt(_gathered(_counted_words(parts, seed)), lambda batch: _numbers(batch, ["h"])[0], buckets)

    def whole(table: pa.Table) -> pa.Table:
        own = _unpacked(table, columns)
        return _one_row_a_word(pa.table({"lang": own["lang"], "word": own["word"], "h": own["h"].view(np.int64), "f": own["f"].view(np.int64)}))

    found = pieces.mapInArrow(dealt, _packed_schema(columns))
    return found.groupBy("bucket").applyInArrow(whole, ", ".join(f"{c} {kind}" for c, kind in columns))


def _in_few_files(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` written and read again, in files of the size that adaptive execution asks for, not one a task."""
    return written(df.hint("rebalance", by), name)


def _occurrences(df: DataFrame, name: str) -> DataFrame:
    """``df``, a relation, written and read again."""
    return written(df, name, compression="zstd", **ROW_GROUPS)


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, max_words: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, word, h, f), and for each length from 2 the frequent phrases (w1 .. wk: hashes, f)."""
    pieces = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        words = _in_few_files(_words(pieces, seed), "h", "phrases-words")
        same = words.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).where((F.col("n") > 1) & (F.col("f") >= least))
        if same.isEmpty():
            break
        seed += 1
    groups = words.where(F.col("f") >= least).select(F.col("h").alias("w1"))
    bits = group_filter(groups)
    relation = _occurrences(_first_relation(pieces, bits, seed), "phrases-1")
    bits.unpersist()
    n = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = max(SPREAD * _partitions(docs), n // PER_BUCKET)
    out = []
    for size in range(2, max_words + 1):
        found = _in_few_files(_groups(relation, size, least, buckets), "w1", f"phrases-groups-{size}")
        out.append(found)
        if size < max_words:
            bits = group_filter(found.select(*_columns(size)))
            relation = _occurrences(_next_relation(relation, bits, size), f"phrases-{size}")
            bits.unpersist()
    return words, out


def _uncovered(shorter: DataFrame, size: int, longer: list[DataFrame]) -> DataFrame:
    """``shorter`` (w1 .. w_size, f) without the phrases of which a longer one holds ``COVERED`` per cent."""
    inside = None
    for k, phrases in enumerate(longer, size + 1):
        for at in range(k - size + 1):
            part = phrases.select(*[F.col(f"w{at + j + 1}").alias(f"w{j + 1}") for j in range(size)], F.col("f").alias("most"))
            inside = part if inside is None else inside.unionByName(part)
    if inside is None:
        return shorter
    most = inside.groupBy(*_columns(size)).agg(F.max("most").alias("most"))
    kept = shorter.join(most, _columns(size), "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * COVERED))
    return kept.drop("most")


def _scored(phrases: DataFrame, size: int, words: DataFrame, shorter: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases (w1 .. w_size, f): the lowest-scoring cut, the first of ties."""
    rows = phrases.withColumnRenamed("f", "a")
    for k in range(size):
        own = words.select(F.col("h").alias(f"w{k + 1}"), F.col("word").alias(f"t{k + 1}"), F.col("f").alias(f"f{k}_{k + 1}"), *([F.col("lang")] if k == 0 else []))
        rows = rows.join(own, f"w{k + 1}")
    for n in range(2, size):
        for at in (0, size - n):
            columns = [f"w{at + j + 1}" for j in range(n)]
            own = shorter[n - 2].select(*[F.col(f"w{j + 1}").alias(c) for j, c in enumerate(columns)], F.col("f").alias(f"f{at}_{at + n}"))
            rows = rows.join(own, columns)
    cuts = []
    for k in range(1, size):
        left, right = f"f0_{k}", f"f{k}_{size}"
        score = F.expr(f"(cast(a as decimal(38,0)) * a * {SCALE}) div (cast({left} as decimal(38,0)) * {right})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    phrase = F.concat_ws(" ", *[f"t{k + 1}" for k in range(size)]).alias("phrase")
    return rows.select("lang", phrase, "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line breaks into pieces, these at spaces and tabs
    into words.  Phrases are two to ``max_words`` words in a row within a piece; ``a`` counts all their
    occurrences in the language, overlaps included, ``n`` all words.  Candidates occur ``least`` times or more.
    A cut gives ``l`` and ``r``, the counts of the two parts, and the score floor(1000000 a^2 / (l r)); the
    lowest counts, the first of equal ones.  Candidates go of which a longer candidate holds half the
    occurrences or more.  ``rank`` is by score, a (both falling) and phrase (bytes), up to ``top``.

    A null language is ``und``; null, empty and blank texts have no words.  Repeated rows count again; ids,
    null or not, play no part.  Phrases differ in rank wherever they differ, so there are no ties.  An empty
    table gives no row; other columns, whatever their names, are left out.
    """
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"max_words must be from 2 to {MAX_WORDS}")
    words, groups = frequent_phrases(docs, lang_col, text_col, max_words, least)
    frequent = _in_few_files(words.where(F.col("f") >= least), "h", "phrases-frequent")
    scored = None
    for size, phrases in enumerate(groups, 2):
        rows = _scored(_uncovered(phrases, size, groups[size - 1 :]), size, frequent, groups)
        scored = rows if scored is None else scored.unionByName(rows)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    best = scored.withColumn("share", F.expr(f"pmod(xxhash64(phrase), {SHARES})"))
    for by in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
