"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns t1 .. tn has the fingerprint (n, t1 B + .. + tn B^n) modulo the prime 2^61 - 1, for two
bases B.  These form a monoid: (n, x)(m, y) = (n + m, x + B^n y).  A conversation that is rebuilt from the first
turns of its base and its own later turns gets the fingerprint of every prefix from three values of its own
(the base's head, its own head, both lengths) and the running products of its own turns: the rebuilt
turns are never put together, no text is read after the first pass.

Running products are made by one scan: turns are sorted in ranges of (conversation, turn), so that one
conversation can fill many ranges; each range gives its products and one row for the conversation that goes
on in the next.  Prefixes with one fingerprint form a node, if their last turns have the same stored reference
(SHA-256 of role and text) and their shorter prefixes one fingerprint, by induction the same turns; if not,
the work begins again with other bases.

Sums over subtrees follow chains: a node belongs to its smallest member, and a conversation's own nodes are the
last ones of its path.  So a subtree's sum is what is left of the node's chain, and all of the chains of the
other members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.shared import written

GROUP, HEADS = 100, 6
#: 2^61 - 1
PRIME = np.uint64((1 << 61) - 1)
LANES = 2
#: nodes of a chain summed in one window, ids of one piece of an end list
CHUNK = 4_096
NO_ENDS = hashlib.sha256(b"").hexdigest()

_REFS = ["r1", "r2", "r3", "r4"]
_NODE = ["depth", "f1", "f2"]


# ---- arithmetic modulo 2^61 - 1

def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of values below the prime."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    out = ah * bh * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl
    return reduced(out)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + b)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + (PRIME - b))


def bases_of(seed: int) -> list[int]:
    """One base a lane."""
    digests = (hashlib.blake2b(f"{seed},{lane}".encode(), digest_size=8).digest() for lane in range(LANES))
    return [2 + int.from_bytes(d, "little") % (int(PRIME) - 3) for d in digests]


@lru_cache(maxsize=8)
def powers(b: int, n: int) -> np.ndarray:
    """b^0 .. b^n."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate((out, times(out, np.uint64(pow(b, len(out), int(PRIME))))))
    return out[: n + 1]


def sums(x: np.ndarray) -> np.ndarray:
    """Running sums."""
    half = np.uint64(31)
    high, low = np.cumsum(x >> half, dtype=np.uint64), np.cumsum(x & np.uint64((1 << 31) - 1), dtype=np.uint64)
    return plus(times(reduced(high), np.uint64(1 << 31)), reduced(low))


# ---- the scan

TURNS = "conv_id long, part long, place long, p1 long, p2 long, q1 long, q2 long, r1 long, r2 long, r3 long, r4 long, chars long, first long"


class _Scan:
    """Running products of the turns of a range, from its first row on."""

    def __init__(self, bases: list[int]):
        self.bases = bases
        self.first = self.conv = None
        self.count, self.total = 0, [0] * len(bases)

    def rows(self, conv: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Place in the conversation (from 1) and product up to it, for the next rows."""
        n = len(conv)
        if self.first is None:
            self.first = int(conv[0])
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = int(conv[0]) != self.conv
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        went_on = np.cumsum(new) == 0
        place = np.arange(n) - begin + 1 + np.where(went_on, self.count, 0)
        out = []
        for lane, b in enumerate(self.bases):
            turn = reduced(refs[:, lane])
            run = sums(times(turn, powers(b, n)[:n]))
            before = np.where(begin > 0, run[begin - 1], np.uint64(0))
            back = powers(pow(b, -1, int(PRIME)), n)
            product = times(minus(run, before), times(back[begin], np.uint64(b)))
            shift = np.uint64(pow(b, self.count, int(PRIME)))
            product = np.where(went_on, plus(times(product, shift), np.uint64(self.total[lane])), product)
            out.append(product)
        self.conv, self.count, self.total = int(conv[-1]), int(place[-1]), [int(x[-1]) for x in out]
        return place, out


def _scanned(parts: Iterator[pa.RecordBatch], bases: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, chars, ref) in order, with their place and products in the range; at the end a row
    without references: the last conversation, its turns and product here, and the first conversation."""
    scan, part = _Scan(bases), TaskContext.get().partitionId()
    names = [x.split()[0] for x in TURNS.split(", ")]
    signed = lambda x: pa.array(x.view(np.int64))
    for batch in parts:
        n = batch.num_rows
        if not n:
            continue
        conv = np.ascontiguousarray(batch.column(0).to_numpy())
        refs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(n, 4).astype(np.uint64)
        carried = scan.conv, list(scan.total)
        place, product = scan.rows(conv, refs)
        before = []
        for lane, x in enumerate(product):
            own = np.concatenate((np.array([carried[1][lane] if conv[0] == carried[0] else 0], np.uint64), x[:-1]))
            before.append(np.where(place == 1, np.uint64(0), own))
        columns = [pa.array(conv), pa.array(np.full(n, part)), pa.array(place), *map(signed, product), *map(signed, before), *[signed(np.ascontiguousarray(refs[:, k])) for k in range(4)], batch.column(1), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    if scan.first is not None:
        last = [scan.conv, part, scan.count, *scan.total, None, None, None, None, None, None, None, scan.first]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last], names=names)


def carries(ends: list[tuple[int, int, int, tuple[int, ...], int]], bases: list[int]) -> dict[int, tuple[int, int, tuple[int, ...]]]:
    """For each range that begins within a conversation: (conversation, turns, product) before it; from the
    ranges' rows (range, last conversation, its turns, its product, first conversation)."""
    out, last = {}, None
    for part, conv, count, product, first in sorted(ends):
        if last and last[0] == first:
            out[part] = last
            if first == conv:
                shifted = (pow(b, last[1], int(PRIME)) * x for b, x in zip(bases, product, strict=True))
                product = tuple((x + y) % int(PRIME) for x, y in zip(last[2], shifted, strict=True))
                count += last[1]
        last = conv, count, product
    return out


def _carried(parts: Iterator[pa.RecordBatch], before: dict, bases: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows with places and products from the conversation's first turn on."""
    for batch in parts:
        columns = {name: batch.column(name).to_numpy().copy() for name in ("conv_id", "part", "place", "p1", "p2", "q1", "q2")}
        for part in np.unique(columns["part"]).tolist():
            if part not in before:
                continue
            conv, count, product = before[part]
            rows = np.flatnonzero((columns["part"] == part) & (columns["conv_id"] == conv))
            for lane, b in enumerate(bases):
                shift = np.uint64(pow(b, count, int(PRIME)))
                for name in (f"p{lane + 1}", f"q{lane + 1}"):
                    x = columns[name][rows].view(np.uint64)
                    columns[name][rows] = plus(times(x, shift), np.uint64(product[lane])).view(np.int64)
            columns["place"][rows] += count
        yield pa.RecordBatch.from_arrays([pa.array(columns[x]) if x in columns else batch.column(x) for x in batch.schema.names], names=batch.schema.names)


def scanned_turns(turns: DataFrame, seed: int) -> DataFrame:
    """``turns`` (conv_id, turn, chars, ref) numbered in each conversation, with the products up to and before each."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", F.asc_nulls_first("turn"), "ref"]
    ordered = turns.repartitionByRange(n, *key).sortWithinPartitions(*key).select("conv_id", "chars", "ref")
    bases = bases_of(seed)
    local = written(ordered.mapInArrow(lambda parts: _scanned(parts, bases), TURNS), "trie-scan")
    ends = [(r.part, r.conv_id, r.place, (r.p1, r.p2), r["first"]) for r in local.where("first IS NOT NULL").collect()]
    before = carries(ends, bases)
    rows = local.where("first IS NULL").drop("first").where("r1 IS NOT NULL")
    schema = rows.schema
    return written(rows.mapInArrow(lambda parts: _carried(parts, before, bases), schema).drop("part"), "trie-turns")


# ---- rebuilt prefixes

def _combined(parts: Iterator[pa.RecordBatch], bases: list[int]) -> Iterator[pa.RecordBatch]:
    """Own turns after the head: the product of the base's head and the own turns since ours."""
    for batch in parts:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        of = lambda name, b=batch, at=at: np.ascontiguousarray(b.column(at[name]).to_numpy())
        less = of("head") - of("base_head")
        out = []
        for kind in ("p", "q"):
            for lane, b in enumerate(bases):
                scale = powers(pow(b, -1, int(PRIME)), HEADS)[less]
                own = minus(of(f"{kind}{lane + 1}").view(np.uint64), of(f"s{lane + 1}").view(np.uint64))
                out.append(pa.array(plus(of(f"b{lane + 1}").view(np.uint64), times(own, scale)).view(np.int64)))
        depth = pa.array(of("base_head") + of("place") - of("head"))
        yield pa.RecordBatch.from_arrays([batch.column(at["conv_id"]), depth, *out, *[batch.column(at[c]) for c in [*_REFS, "chars", "length"]]], names=_PREFIX_NAMES)


PREFIX = "conv_id long, depth long, f1 long, f2 long, g1 long, g2 long, r1 long, r2 long, r3 long, r4 long, chars long, length long"
_PREFIX_NAMES = [x.split()[0] for x in PREFIX.split(", ")]


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: fingerprints of it (f) and of the one before (g), the
    reference of its last turn, and the conversation's whole length."""
    head = F.expr(f"crc32(cast(conv_id AS string)) % {HEADS}")
    at_head = lambda c: F.coalesce(F.max(F.when(F.col("place") == head, F.col(c))), F.lit(0).cast("long"))
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("own"), at_head("p1").alias("s1"), at_head("p2").alias("s2"))
    convs = convs.withColumn("head", head).withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    first = turns.where(f"place < {HEADS} AND conv_id % {GROUP} = 0")
    turn = F.struct("place", "p1", "p2", "q1", "q2", *_REFS, "chars")
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.join(first, "base", "left").withColumn("turns", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("head").cast("int")))
    convs = convs.withColumn("base_head", F.size("turns").cast("long")).withColumn("length", F.expr("base_head + greatest(own - head, 0)"))
    last = lambda c: F.expr(f"if(base_head > 0, turns[cast(base_head - 1 AS int)].{c}, 0L)")
    convs = written(convs.withColumn("b1", last("p1")).withColumn("b2", last("p2")), "trie-conversations")

    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in _PREFIX_NAMES[1:-1]], "length")
    heads = convs.select("conv_id", F.explode("turns").alias("t"), "length")
    heads = heads.select("conv_id", F.col("t.place").alias("depth"), F.col("t.p1").alias("f1"), F.col("t.p2").alias("f2"), F.col("t.q1").alias("g1"), F.col("t.q2").alias("g2"), *[f"t.{c}" for c in _REFS], "t.chars", "length")
    bases = bases_of(seed)
    own = turns.join(convs.select("conv_id", "head", "base_head", "s1", "s2", "b1", "b2", "length"), "conv_id").where("place > head")
    own = own.mapInArrow(lambda parts: _combined(parts, bases), PREFIX)
    return root.unionByName(heads).unionByName(own)


def nodes_of(rebuilt: DataFrame) -> DataFrame:
    """One row a node: its smallest member, members, the prefix before and the last turn's length; ``wrong`` if
    its members' last turns or shorter prefixes differ."""
    checked = ["g1", "g2", *_REFS]
    aggs = [f(c).alias(f"{name}_{c}") for c in checked for f, name in ((F.min, "min"), (F.max, "max"))]
    nodes = rebuilt.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *aggs)
    wrong = F.expr(" OR ".join(f"min_{c} <> max_{c}" for c in checked))
    return nodes.select(*_NODE, "conv_id", "n_convs", "chars", F.col("min_g1").alias("g1"), F.col("min_g2").alias("g2"), wrong.alias("wrong"))


# ---- ends

def _end_pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order as pieces of comma-joined ids, with the first id of each."""
    held: list[int] = []
    key = None
    rows: list[tuple] = []

    def close():
        if held:
            rows.append((*key, held[0], ",".join(map(str, held))))
            held.clear()

    def batch_of():
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array([r[4] for r in rows], pa.string())], names=[*_NODE, "first", "ids"])
        rows.clear()
        return out

    for batch in parts:
        for *node, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if node != key or len(held) >= CHUNK:
                close()
                key = node
            held.append(conv)
        yield batch_of()
    close()
    yield batch_of()


def _end_hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, first, ids) in order: SHA-256 of each node's joined pieces."""
    key, state = None, None
    rows: list[tuple] = []

    def batch_of():
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in rows], pa.string())], names=[*_NODE, "ends_sha256"])
        rows.clear()
        return out

    for batch in parts:
        for *node, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if node == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                rows.append((*key, state.hexdigest()))
            key, state = node, hashlib.sha256(ids.encode())
        yield batch_of()
    if key:
        rows.append((*key, state.hexdigest()))
    yield batch_of()


def end_hashes(rebuilt: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end.  Ids are sorted in ranges of (node, id), so
    a node's may lie in many; one task then hashes their pieces, a row for 4,096 ids, as they stream by."""
    n = int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_NODE, "conv_id"]
    ends = rebuilt.where("depth = length").select(*order)
    pieces = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_end_pieces, "depth long, f1 long, f2 long, first long, ids string")
    pieces = pieces.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first")
    return pieces.mapInArrow(_end_hashes, "depth long, f1 long, f2 long, ends_sha256 string")


# ---- the trie

def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % 100 (all if it has fewer, none if
    it isn't there) and its own turns after its first h; h is crc32 of c in decimal, modulo 6.  A node is a
    distinct sequence of first turns (role, text) of rebuilt conversations, its members those that begin with
    it; the root, without turns, has all.  ``conv_id`` is the smallest member, ``parent_conv_id`` that of the
    sequence without its last turn (null at the root), ``n_children`` counts nodes, ``n_leaves`` those without
    children in the subtree, ``saved_tokens`` adds up (members - 1) x code points of the last text over the
    subtree, ``ends_sha256`` hashes the ids of the members that end here.

    Turns are ordered by ``turn``, null first, ties by SHA-256 of role and text.  A null role or text is empty;
    an empty turn is a turn.  Repeated rows are turns of their own.  Rows without a conversation id belong to no
    conversation and are left out.  An empty table gives no row; other columns, whatever their names, play no
    part.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("ref"))
    turns = written(turns.where("conv_id IS NOT NULL"), "trie-references")
    seed = 0
    while True:
        rebuilt = written(prefixes(scanned_turns(turns, seed), seed), "trie-prefixes")
        nodes = written(nodes_of(rebuilt), "trie-nodes")
        if nodes.where("wrong").isEmpty():
            break
        seed += 1
    return _summed(rebuilt, nodes.drop("wrong"))


def _summed(rebuilt: DataFrame, nodes: DataFrame) -> DataFrame:
    up = [(F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("saved", F.expr("(n_convs - 1) * chars")).withColumn("chunk", F.expr(f"depth div {CHUNK}")), "trie-children")

    # what is left of each node's chain: the rest of its chunk, and the later chunks
    chunks = nodes.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("of_chunk"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("later", F.coalesce(F.sum("of_chunk").over(later), F.lit(0).cast("long"))).drop("of_chunk")
    rest = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.withColumn("rest", F.sum("saved").over(rest)).join(chunks, ["conv_id", "chunk"]).withColumn("chain", F.col("rest") + F.col("later"))

    # all of the other members' chains
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("total"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    members = rebuilt.select("conv_id", *_NODE).join(chains, "conv_id")
    members = members.groupBy(*_NODE).agg(F.sum(F.when(F.col("depth") < F.col("top"), F.col("total")).otherwise(0)).alias("others"), F.sum("leaf").cast("long").alias("n_leaves"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(members, _NODE).join(end_hashes(rebuilt), _NODE, "left").join(parents, ["depth", "g1", "g2"], "left")
    saved = (F.col("chain") + F.col("others")).cast("long").alias("saved_tokens")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
