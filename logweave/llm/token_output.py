"""Token ids as binary segments with Elias-Fano document boundaries.

Layout of the written table (Parquet, so that any store Spark reaches can hold
it), one row per segment: ``part`` and ``segment`` give the order; ``ids`` is
the concatenation of the documents' ids, little-endian, ``width`` bytes each;
``bounds`` is the Elias-Fano code of the documents' ends within ``ids``;
``doc_ids`` names the documents in order.  Offsets over the whole table come
from the segments' lengths, so no table of 64-bit document offsets exists.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.elias_fano import EliasFano
from logweave.llm.shared import Remembered, kept, written
from logweave.llm.token_counts import byte_symbols

#: Ids after which a segment ends (a document is never split).
SEGMENT_IDS = 1 << 18
#: Bytes of pre-tokens' ids that a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 32 << 20
END_ID = 2

SEGMENTS = "part long, segment long, start long, n_ids long, width int, doc_ids array<long>, bounds binary, ids binary"
LENGTHS = "doc_id long, part long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by the tokenizers library (byte-level BPE without normaliser); in a worker.

    Byte-level pre-tokens are encoded independently, so each distinct one goes to the library's model once.
    """

    def __init__(self, path: str, classes: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes = ta.unpacked(classes)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.signs = dict(enumerate(byte_symbols()))
        self.known = Remembered(REMEMBERED)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; null counts as empty.  Texts with a special token's string go to the
        library as they are."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        plain = []
        for i, text in enumerate(texts):
            if text and any(s in text for s in self.special):
                parts[i].append(np.array(self._library([text])[0], np.uint32))
                plain.append("")
            else:
                plain.append(text)
        for rows, pieces in ta.groups(plain):
            for row, ids in zip(rows, self._pieces(pieces), strict=True):
                parts[row].append(ids)
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.uint32), *p]) for p in parts]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        cp, off = ta.codepoints(pieces)
        if not len(cp):
            return [np.zeros(0, np.uint32)] * len(pieces)
        starts = ta.byte_bpe_spans(cp, off, self.classes)
        ends = np.append(starts[1:], len(cp))
        key, first, back = np.unique(ta.span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        at = self._distinct(key, "".join(pieces), starts[first], ends[first])[back]
        lengths = np.diff(self.known.first)[at]
        ids = self.known.values[ta.ragged(self.known.first[at], lengths)]
        cuts = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, off)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _distinct(self, key, text: str, starts, ends) -> np.ndarray:
        """Slots of the pre-tokens (sorted keys, all different)."""
        if self.known.size() > self.known.most:
            self.known.forget()
        at = self.known.find(key)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            signs = (text[a:b].encode("utf-8").decode("latin-1").translate(self.signs) for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True))
            at[missing] = self.known.add(key[missing], [[t.id for t in self.model.tokenize(x)] for x in signs])
        return at


def encoder(path: str, classes: bytes) -> Encoder:
    """The worker's encoder of a vocabulary file, kept over tasks."""
    return kept(("encoder", path), lambda: Encoder(path, classes))


def _segment(part: int, segment: int, start: int, doc_ids: list, ids: list[np.ndarray]) -> dict:
    flat = np.concatenate(ids)
    width = 2 if int(flat.max()) < 1 << 16 else 4
    return {
        "part": part,
        "segment": segment,
        "start": start,
        "n_ids": len(flat),
        "width": width,
        "doc_ids": doc_ids,
        "bounds": EliasFano.encode(np.cumsum([len(x) for x in ids])).to_bytes(),
        "ids": flat.astype(f"<u{width}").tobytes(),
    }


def _segment_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("bounds", pa.binary()), ("ids", pa.binary())])


def write_token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes the ids of every whole text, each followed by ``end_id``, and gives the written table.

    Documents stand in ascending order of id over the whole table: null ids first, equal ids by a hash
    of the text, so repeated rows stay beside each other and each has its own entry.  Null and empty
    texts have the end id alone.  Other columns are left out.  An empty table writes no segment.

    One range shuffle of id and text; each task encodes its sorted rows and closes a segment at the
    first document end after ``segment_ids`` ids, so a task holds one segment and one piece of text.
    """
    classes = ta.packed_classes()
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path, classes)
        part, schema = TaskContext.get().partitionId(), _segment_schema()
        segment = start = size = 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_segment(part, segment, start, doc_ids, held)], schema)

        for batch in parts:
            ids = batch.column(0).to_pylist()
            for at, texts in ta.batches(batch.column(1)):
                for k, own_ids in enumerate(own.texts(texts)):
                    doc_ids.append(ids[at + k])
                    held.append(np.concatenate((own_ids, end)))
                    size += len(own_ids) + 1
                    if size >= segment_ids:
                        yield closed()
                        segment, start, size, doc_ids, held = segment + 1, start + size, 0, [], []
        if held:
            yield closed()

    return written(rows.mapInArrow(encode, SEGMENTS), "token-ids")


def _documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in parts:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            ends = EliasFano.from_bytes(row["bounds"]).values()
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [row["doc_ids"], [row["part"]] * len(ends), starts + row["start"], ends - starts, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def read_boundaries(segments: DataFrame) -> DataFrame:
    """Documents of a written table: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian 32-bit integers).

    A segment knows its start within its part; the parts' totals (a row per task of the writer) give the rest.
    """
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    docs = segments.mapInArrow(_documents, LENGTHS)
    joined = docs.join(offsets, docs.part == offsets.p)
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_ids_of(segments: DataFrame, doc_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents that ``doc_ids`` names, by select in the segments: doc_id, ids."""
    wanted = doc_ids.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
    at = segments.select("part", "segment", F.posexplode("doc_ids").alias("i", "doc_id")).join(wanted, "doc_id")
    hits = at.groupBy("part", "segment").agg(F.collect_list("i").alias("wanted"))
    rows = segments.join(hits, ["part", "segment"]).select("wanted", "doc_ids", "bounds", "ids", "width")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in parts:
            for row in batch.to_pylist():
                ends, ids = EliasFano.from_bytes(row["bounds"]), np.frombuffer(row["ids"], f"<u{row['width']}")
                for i in sorted(row["wanted"]):
                    a, b = ends.select(i - 1) if i else 0, ends.select(i)
                    yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_ids"][i], "ids": ids[a:b].tolist()}], schema)

    return rows.mapInArrow(cut, "doc_id long, ids array<int>")
