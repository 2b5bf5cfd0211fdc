"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles.  Each tree of the forest is a prefix trie: a document's path in it is
the string of its MinHash values, a byte each.  The join descends from the whole paths to shorter prefixes,
level by level: documents under one node that aren't of one family yet are compared by all their signature
values, and those whose estimate is near or above the threshold become one family.  A node whose documents
are one family has no work left, so copies that met under long prefixes aren't compared again under short
ones.  A document goes down until a partner as unlike as its set's size allows has been met with the target
recall; sets that are too small for any partner but an equal set stay out.

Nodes of many documents are compared in blocks, at each level each block by itself (other blocks in each
tree).  When all levels are done, the blocks of the nodes of the shortest prefix, which hold those of the longer
ones, are compared across for what is still of different families.  In the end every pair of different sets of a family is
verified exactly, in blocks of documents.

Documents of equal sets count as one class before anything is paired.  Pairs themselves are never
written: a block gives counts for each class and the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.cgk_decontam import row_groups, utf8
from logweave.llm.components import Forest, components, contracted
from logweave.llm.shared import written

WORDS = 5
THRESHOLD = (4, 5)
TREES, DEPTH, RECALL = 32, 12, 0.999
#: Values by which prefixes are shortened from one level to the next.
STEP = 3
#: An estimate from all signature values may lie so many standard deviations below the threshold.
SIGMAS = 5.0
#: Documents of one block: two blocks are compared in one task.
BLOCK = 256
SEED = 77

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def matched_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Length of the longest prefix with which a pair of that similarity meets in some tree with probability
    ``recall``."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def least_similarity(n: int) -> float | None:
    """The least Jaccard similarity from the threshold on that a set of ``n`` shingles can have with a
    different set; None if it can have none."""
    num, den = THRESHOLD
    pairs = [(-(-num * union // den), union) for union in range(n, n * den // num + 1)]
    return min((both / union for both, union in pairs if both < union), default=None)


def own_depth() -> F.Column:
    """Length of the prefix at which a document (column n: shingles of its set) has the target recall; null
    if nothing but an equal set can be its partner."""
    num, den = THRESHOLD
    depth = F.lit(matched_depth(num / den))
    # sizes from here on allow a union that is a multiple of den: the threshold itself
    for n in range(num * (den - 1) - 1, 0, -1):
        s = least_similarity(n)
        depth = F.when(F.col("n") == n, F.lit(matched_depth(s)) if s else F.lit(None).cast("int")).otherwise(depth)
    return depth


def levels() -> list[int]:
    """Prefix lengths of the descent, the longest first."""
    num, den = THRESHOLD
    last = matched_depth(num / den)
    return [*range(DEPTH, last, -STEP), last]


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the five-word shingles of each text (bytes between white space are words; a text
    of one to four words has one shingle of them all), and where each text's begin."""
    n_docs = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    begin[inner] = ~space[inner]
    starts = np.flatnonzero(begin)
    stop = space.copy()
    stop[inner] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts + 1, "left")]
    words = ta.span_hashes(data, starts, ends)
    first = np.searchsorted(starts, off)
    count = np.diff(first)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    out_off = np.concatenate(([0], np.cumsum(n)))
    long = count >= WORDS
    at = ta.ragged(first[:-1][long], n[long])
    h = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        h = ta.mix64(h + words[at + k])
    out = np.empty(out_off[-1], np.uint64)
    out[np.repeat(long, n)] = h
    for d in np.flatnonzero((count > 0) & ~long).tolist():
        x = np.zeros(1, np.uint64)
        for w in words[first[d] : first[d + 1]]:
            x = ta.mix64(x + w)
        out[out_off[d]] = x[0]
    return out, out_off


def set_keys(sets: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """128 bits and the size of each text's set of shingles: equal for equal sets."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        s = np.unique(sets[a:b])
        with np.errstate(over="ignore"):
            x, y = ta.mix64(s).sum(dtype=np.uint64), ta.mix64(s ^ np.uint64(SEED)).sum(dtype=np.uint64)
        out.append((int(x.astype(np.int64)), int(y.astype(np.int64)), len(s)))
    return out


def signatures(sets: np.ndarray, off: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One byte of each MinHash value of each non-empty text, tree by tree: its paths in the tries."""
    full = np.flatnonzero(np.diff(off))
    starts = off[:-1][full]
    small = (sets >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * 2 + 1
    add = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    low = np.zeros((len(full), trees * depth), np.uint8)
    for k in range(trees * depth if len(full) else 0):
        least = np.minimum.reduceat(small * odd[k] + add[k], starts)
        low[:, k] = (ta.mix64(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
    return low


def _signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int32()), ("signature", pa.binary())])
    for batch in parts:
        data, off = utf8(batch.column(2))
        for a, b in row_groups(off, ta.PIECE_CHARS):
            sets, where = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
            keys = set_keys(sets, where)
            full = iter(signatures(sets, where, TREES, DEPTH))
            rows = []
            ids, hashes = (batch.column(c).slice(a, b - a).to_pylist() for c in range(2))
            for (x, y, n), doc_id, h in zip(keys, ids, hashes, strict=True):
                rows.append((doc_id, h, x, y, n, next(full).tobytes() if n else b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _near(parts: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, i, j, side, root, signature) in order of (node, i, j): edges between families (roots) with
    two documents in a pair of blocks whose signatures agree in ``least`` of their bytes.  What the task has
    joined in one block isn't compared again in the next."""
    forest = Forest()

    def compare(block: list[tuple]) -> None:
        family = np.array([forest.root(r[1]) for r in block])
        if (family == family[0]).all():
            return
        low = np.stack([np.frombuffer(r[2], np.uint8) for r in block])
        side = np.array([r[0] for r in block])
        for k in range(len(block) - 1):
            other = np.flatnonzero((family[k + 1 :] != family[k]) & ((side[k + 1 :] != side[k]) | (side[k] == 0))) + k + 1
            for m in other[(low[other] == low[k]).mean(1) >= least].tolist():
                a, b = int(family[k]), int(family[m])
                if forest.join(a, b):
                    family[family == max(a, b)] = min(a, b)

    held: list[tuple] = []
    key = None
    for batch in parts:
        cols = [c.to_pylist() for c in batch.columns]
        for node, i, j, side, root, low in zip(*cols, strict=True):
            if (node, i, j) != key:
                if len(held) > 1:
                    compare(held)
                held, key = [], (node, i, j)
            held.append((side, root, low))
    if len(held) > 1:
        compare(held)
    yield forest.batch()


def _compared(rows: DataFrame, least: float) -> DataFrame:
    """Edges between families, of rows (node, i, j, side, root, signature)."""
    rows = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").select("node", "i", "j", "side", "root", "signature")
    return rows.mapInArrow(lambda parts: _near(parts, least), "a long, b long")


def _trie(first: DataFrame) -> DataFrame:
    """(cls, own, tree, path, signature) of documents that share a node of the shortest prefix in the tree."""
    paths = F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(signature, t * {DEPTH} + 1, {levels()[-1]}))")
    first = first.select(F.col("rid").alias("cls"), own_depth().alias("own"), "signature").where("own IS NOT NULL")
    nodes = first.select("cls", F.posexplode(paths).alias("tree", "path")).select("cls", "tree", F.xxhash64("tree", "path").alias("node"))
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size >= 2").select("node")
    met = nodes.join(shared, "node", "left_semi").select("cls", "tree")
    return met.join(first, "cls").withColumn("path", F.expr(f"substring(signature, tree * {DEPTH} + 1, {DEPTH})"))


def _across(rows: DataFrame) -> DataFrame:
    """Rows (node, cls, root, ...) for each pair of blocks of their node that can hold two families.  A
    family of more than ``BLOCK`` rows under a node has blocks of its own, never paired with each other;
    smaller ones share blocks.  Pairs are formed of families and counts of blocks, not of rows."""
    per = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("size"))
    f = F.when(F.col("size") > BLOCK, F.col("root")).otherwise(F.lit(-1).cast("long"))
    per = per.withColumn("f", f)
    groups = per.groupBy("node", "f").agg(F.expr(f"(sum(size) + {BLOCK - 1}) div {BLOCK}").alias("blocks"), F.count(F.lit(1)).alias("roots"))
    left, right = (groups.select("node", F.col("f").alias(f"f{k}"), F.col("blocks").alias(f"n{k}"), F.col("roots").alias(f"r{k}")) for k in (1, 2))
    pairs = left.join(right, "node").where("f1 < f2 OR (f1 = -1 AND f2 = -1 AND r1 > 1)")
    pairs = pairs.withColumn("k1", F.explode(F.expr("sequence(0L, n1 - 1)"))).withColumn("k2", F.explode(F.expr("sequence(0L, n2 - 1)")))
    pairs = pairs.where("f1 < f2 OR k1 <= k2").select("node", "f1", "k1", "f2", "k2")
    ends = F.array(*[F.struct(F.col(f"f{k}").alias("f"), F.col(f"k{k}").alias("k"), F.when(F.expr("f1 = f2 AND k1 = k2"), 0).otherwise(k).alias("side")) for k in (1, 2)])
    pairs = pairs.select("node", F.xxhash64("f1", "k1").alias("i"), F.xxhash64("f2", "k2").alias("j"), F.explode(F.array_distinct(ends)).alias("end"))
    pairs = pairs.select("node", "i", "j", "end.f", "end.k", "end.side")
    k = F.pmod(F.xxhash64(F.lit(SEED), F.when(F.col("f") < 0, F.col("root")).otherwise(F.col("cls"))), F.col("blocks"))
    placed = rows.join(per.select("node", "root", "f"), ["node", "root"]).join(groups.drop("roots"), ["node", "f"]).withColumn("k", k)
    return placed.join(pairs, ["node", "f", "k"])


def _named(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows`` with the name of their document's family (root).  One name may be short of the component's least
    one: two names of a family cost a comparison, no link."""
    if links is None:
        return rows.withColumn("root", F.col("cls"))
    names = links.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("root"))
    return rows.join(names, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _families(first: DataFrame) -> DataFrame:
    """(vertex, root) of the classes (rows that stand for one) whose signatures are linked by estimates."""
    num, den = THRESHOLD
    least = num / den - SIGMAS * (num / den * (1 - num / den) / (TREES * DEPTH)) ** 0.5
    trie = written(_trie(first), "forest-trie")
    at = lambda depth: F.expr(f"xxhash64(tree, substring(path, 1, {depth}))").alias("node")
    links = None
    longer = DEPTH + 1
    for depth in levels():
        # documents that reached the recall at a longer prefix are done
        rows = _named(trie.where(F.col("own") < longer).select("cls", "signature", at(depth)), links)
        longer = depth
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        nodes = written(nodes.where("low <> high").select("node", "size"), "forest-nodes")
        if nodes.isEmpty():
            continue
        block = F.pmod(F.xxhash64("node", "cls"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}"))
        rows = rows.join(nodes, "node").withColumn("i", block).withColumn("j", block).withColumn("side", F.lit(0))
        edges = written(_compared(rows, least), "forest-edges")
        links = contracted(edges, "forest-contracted") if links is None else links.unionByName(edges)
    if links is None:
        return first.sparkSession.createDataFrame([], "vertex long, root long")
    # blocks of one node meet once, at the end: a node of the shortest prefix holds those of all longer ones.
    # Documents that were done before meet the others of their node once more
    under = trie.select("cls", "signature", at(levels()[-1]))
    wide = written(under.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("node"), "forest-nodes")
    if not wide.isEmpty():
        links = contracted(links, "forest-contracted")
        rows = _named(under.join(wide, "node", "left_semi"), links)
        links = links.unionByName(written(_compared(_across(rows), least), "forest-edges"))
    return written(components(links, "forest-components"), "forest-families")


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (group, cls, ...) for each pair of blocks of their group: i, j, side (0: within one block;
    1, 2: first or second of two).  A group of up to ``BLOCK`` rows is one block; rows go to blocks by hash."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    n = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")
    placed = rows.join(sizes, group).withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "cls"), F.col("blocks"))).drop("size")
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.select(*[c for c in placed.columns if c not in ("own", "other")], F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))


def _intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (sorted arrays), over shingles that both lists have."""
    shared = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(others)), assume_unique=True)
    out = np.zeros((len(sets), len(others)), np.float32)
    for at in range(0, len(shared), 1 << 13):
        part = shared[at : at + (1 << 13)]
        dense = []
        for side in (sets, others):
            x = np.zeros((len(side), len(part)), np.float32)
            for k, s in enumerate(side):
                where = np.searchsorted(part, s)
                where[where == len(part)] = 0
                x[k, where[part[where] == s]] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def _verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, side, cls, copies, shingles) in order: for each class the linked classes and their
    documents in this pair of blocks (kind 0), and edges of a spanning forest of the links (kind 1)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("texts", pa.int64()), ("docs", pa.int64())])
    num, den = THRESHOLD

    def compare(block: list[tuple]) -> pa.RecordBatch:
        within = block[0][1] == 0
        left = [r for r in block if r[1] != 2]
        right = left if within else [r for r in block if r[1] == 2]
        out: list[tuple] = []
        if left and right:
            sets = [np.frombuffer(r[3], np.uint64) for r in left]
            others = sets if within else [np.frombuffer(r[3], np.uint64) for r in right]
            both = _intersections(sets, others)
            union = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :] - both
            linked = den * both >= num * union
            if within:
                np.fill_diagonal(linked, False)
            copies = np.array([r[2] for r in left]), np.array([r[2] for r in right])
            out += [(r[0], None, int(t), int(d)) for r, t, d in zip(left, linked.sum(1), linked @ copies[1], strict=True) if t]
            if not within:
                out += [(r[0], None, int(t), int(d)) for r, t, d in zip(right, linked.sum(0), copies[0] @ linked, strict=True) if t]
            forest = Forest()
            for k, row in enumerate(linked):
                for m in np.flatnonzero(row).tolist():
                    forest.join(left[k][0], right[m][0])
            out += [(a, b, 0, 0) for a, b in forest.edges()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], schema=schema)

    held: list[tuple] = []
    key = None
    for batch in parts:
        for k in range(batch.num_rows):
            root, i, j, side, cls, copies, sets = (batch.column(c)[k].as_py() for c in range(7))
            if (root, i, j) != key:
                if len(held) > 1:
                    yield compare(held)
                held, key = [], (root, i, j)
            held.append((cls, side, copies, sets))
    if len(held) > 1:
        yield compare(held)


def _member_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, x, y, text): the sorted set of the texts whose key is that of the class."""
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])
    for batch in parts:
        data, off = utf8(batch.column(3))
        for a, b in row_groups(off, ta.PIECE_CHARS):
            sets, where = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
            keys = set_keys(sets, where)
            cls, x, y = (batch.column(c).slice(a, b - a).to_pylist() for c in range(3))
            keep = [k for k in range(b - a) if keys[k][:2] == (x[k], y[k])]
            raw = [np.unique(sets[where[k] : where[k + 1]]).tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([pa.array([cls[k] for k in keep], pa.int64()), pa.array(raw, pa.binary())], schema=schema)


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a document: doc_id, h (of the text), n, root and cls (of its class; null without words),
    class_id, text_id, copies, texts, docs."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    signed = rows.mapInArrow(_signed, "doc_id long, h long, x long, y long, n int, signature binary")
    signed = written(signed.withColumn("rid", F.monotonically_increasing_id()), "forest-signatures")

    full = signed.where("n > 0")
    # the first row of a class stands for it; its least id names it
    classes = full.groupBy("x", "y").agg(F.min("rid").alias("cls"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("text_id"), F.max(F.col("doc_id").isNull()).alias("null_id"))
    classes = written(classes, "forest-classes")
    first = full.join(classes.select(F.col("cls").alias("rid")), "rid")

    families = _families(first)

    # the members' sets, by the texts of the rows that stand for them
    ids = signed.join(families.select(F.col("vertex").alias("rid")), "rid").select(F.col("rid").alias("cls"), "x", "y", *_identity())
    texts = rows.select("text", *_identity()).join(ids, ["id", "no_id", "h"]).select("cls", "x", "y", "text")
    sets = texts.mapInArrow(_member_sets, "cls long, shingles binary").groupBy("cls").agg(F.min("shingles").alias("shingles"))
    sized = families.join(classes.select(F.col("cls").alias("vertex"), "copies"), "vertex").select(F.col("vertex").alias("cls"), "root", "copies")
    blocks = _blocks(sized, "root").join(sets, "cls")
    blocks = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("root", "i", "j", "side", "cls", "copies", "shingles")
    found = written(blocks.mapInArrow(_verified, "a long, b long, texts long, docs long"), "forest-links")

    links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), "forest-classes")
    named = classes.select("x", "y", "cls", "copies", "text_id", "null_id").join(links, "cls", "left").join(roots.select(F.col("vertex").alias("cls"), "root"), "cls", "left")
    least_id = lambda c, null: F.when(~null, c)  # noqa: E731  a null id is the least
    named = named.withColumn("text_id", least_id(F.col("text_id"), F.col("null_id"))).withColumn("root", F.coalesce("root", "cls"))
    names = named.groupBy("root").agg(F.when(~F.max("null_id"), F.min("text_id")).alias("class_id"))
    named = named.join(names, "root").select("x", "y", "root", "copies", "text_id", "class_id", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return signed.select("doc_id", "h", "x", "y", "n", "rid").join(named, ["x", "y"], "left")


def _identity() -> list:
    """A row's id, never null, whether it is null, and its text's hash: join keys that tell texts apart."""
    return [F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("h")]


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id, text_id, n_links, n_linked_texts.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
    ``class_id`` is the least id of the documents that are connected by links, ``text_id`` that of those
    with an equal set, ``n_links`` the documents linked to this one (copies too), ``n_linked_texts`` the
    different sets among them.

    Words are runs of bytes other than ASCII white space, compared as they are.  A text of one to four words
    has one shingle; null, empty and blank texts have none: they are linked to nothing and are classes of
    their own (by id).  Repeated rows are copies; null ids count as the least.  An empty table gives no row;
    other columns are left out.
    """
    linked = _classed(docs, id_col, text_col)
    empty = F.col("n") == 0
    return linked.select(
        "doc_id",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.when(empty, 0).otherwise(F.col("docs") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(empty, 0).otherwise(F.col("texts")).cast("long").alias("n_linked_texts"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class of linked ones, that with the least id; same columns.

    Rows without words all stay, those equal in every column once.  Rows with words that are equal in id and
    text count as one document: the one whose columns have the least hash stays.  Null ids count as the least."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    linked = _classed(docs, id_col, text_col).where("n > 0")
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.*")
    chosen = written(first.select(*_identity()), "forest-kept")
    key = ["id", "no_id", "h"]
    whole = [F.col(f"`{c}`") for c in docs.columns]
    blank = ~text.rlike(r"[^\x09-\x0D\x20]")
    own = docs.where(~blank).select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long")).alias("id"), F.col(f"`{id_col}`").isNull().alias("no_id"), F.xxhash64(text).alias("h"),
        F.struct(*whole).alias("row"), F.xxhash64(*whole).alias("of_row"),
    )
    # copies meet map-side: a task sends one row of each
    own = own.groupBy(*key).agg(F.min_by("row", "of_row").alias("row"))
    return own.join(chosen, key, "left_semi").select("row.*").unionByName(docs.where(blank).distinct())
