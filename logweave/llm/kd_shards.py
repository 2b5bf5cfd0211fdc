"""K-d tree sharding: cells split at weighted medians along their widest metadata dimension.

Every document has one 62-bit key a dimension: its value's place between the least and the greatest
value (31 bits; null lowest; texts by their rank among the distinct ones) and a hash of the row (31 bits), so equal values can be split anywhere.
A cell of ``c`` shards is cut along its widest dimension where ``c // 2`` shards' share of its bytes
lies to the left.  The cut is found by histograms of the cells' bytes, each 4,096 times finer than the
last, until the bin at the cut weighs next to nothing.  All rows stay distributed; the driver sees
one row a cell and round, and their number is the number of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.shared import written

DIMENSIONS = ("source", "lang", "n_chars")
BINS = 4096
PLACE_BITS = 31
#: A cut is exact to this share of a shard's bytes (or to one document, if that is heavier).
TOLERANCE = 0.002
#: Rows that are numbered together, about.
ROWS_A_CHUNK = 250_000


def _is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("string", "binary")


def _ranks(docs: DataFrame, name: str, i: int) -> DataFrame:
    """(value, c): the place of each distinct value of a text column in their order, from 0; values are sorted
    in ranges, whose counts (a row a range) give the offsets."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = docs.select(F.col(f"`{name}`").cast("string").alias(f"v{i}")).where(F.col(f"v{i}").isNotNull()).distinct()
    placed = values.repartitionByRange(n, f"v{i}").sortWithinPartitions(f"v{i}").withColumn("row", F.monotonically_increasing_id())
    placed = written(placed.select(f"v{i}", F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND((1 << 33) - 1).alias("at")), "kd-values")
    counts = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").select(f"v{i}", (F.col("offset") + F.col("at")).cast("double").alias(f"c{i}"))


def _codes(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """One slim row a document: id, size, checksum, a hash of the row, and c0, c1, ...: numbers in the order of
    the dimensions' values (a text's rank among the distinct ones, a number by its logarithm)."""
    text = F.col(f"`{text_col}`").cast("string")
    crc = F.coalesce(F.crc32(text), F.lit(0))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    tie = F.xxhash64(F.col(f"`{id_col}`"), crc, *[F.col(f"`{d}`") for d in dims])
    columns, texts = [], [i for i, d in enumerate(dims) if _is_text(docs, d)]
    for i, d in enumerate(dims):
        number = F.col(f"`{d}`").cast("double") if i not in texts else None
        columns.append(F.col(f"`{d}`").cast("string").alias(f"v{i}") if i in texts else (F.signum(number) * F.log1p(F.abs(number))).alias(f"c{i}"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), tie.alias("tie"), *columns)
    for i in texts:
        rows = rows.join(_ranks(docs, dims[i], i), f"v{i}", "left").drop(f"v{i}")
    return rows


def _numbers(values: list[int], index: Column) -> Column:
    """``values[index]``; the list is one literal."""
    listed = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    return F.get(listed, index)


def _keyed(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """One slim row a document: id, size, checksum and a key for each dimension."""
    rows = written(_codes(docs, dims, id_col, text_col), "kd-codes")
    ranges = rows.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(dims)) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    mask = (1 << PLACE_BITS) - 1
    keys = []
    for i in range(len(dims)):
        lo, hi = ranges[f"lo{i}"], ranges[f"hi{i}"]
        scale = (mask - 1) / (hi - lo) if lo is not None and hi > lo else 0.0
        place = F.coalesce(F.floor((F.col(f"c{i}") - F.lit(lo or 0.0)) * F.lit(scale)).cast("long") + 1, F.lit(0))
        keys.append((place * F.lit(1 << PLACE_BITS) + (F.col("tie").bitwiseAND(F.lit(mask)))).alias(f"k{i}"))
    return rows.select("doc_id", "size", "text_crc32", "tie", *keys, F.lit(0).cast("long").alias("cell"))


def _cuts(rows: DataFrame, n_dims: int, cells: list[int], share: float) -> list[tuple[int, int]]:
    """Dimension and least key of the right side, for each cell of at least two shards."""
    spans = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(n_dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()
    dims, low, high, goal, below, done = [0] * len(cells), [0] * len(cells), [0] * len(cells), [0.0] * len(cells), [0] * len(cells), [True] * len(cells)
    for s in spans:
        if cells[s.cell] >= 2:
            d = max(range(n_dims), key=lambda i: (s[f"hi{i}"] >> PLACE_BITS) - (s[f"lo{i}"] >> PLACE_BITS))  # noqa: B023
            dims[s.cell], low[s.cell], high[s.cell], done[s.cell] = d, s[f"lo{d}"], s[f"hi{d}"], False
            goal[s.cell] = s.bytes * (cells[s.cell] // 2) / cells[s.cell]
    cut = list(high)
    while not all(done):
        cell = F.col("cell")
        width = [(h - lo) // BINS + 1 for lo, h in zip(low, high, strict=True)]
        dim = _numbers(dims, cell)
        key = F.coalesce(*[F.when(dim == i, F.col(f"k{i}")) for i in range(n_dims)])
        open_rows = rows.where(_numbers([int(not x) for x in done], cell) == 1).select("cell", "size", key.alias("key"))
        open_rows = open_rows.where((F.col("key") >= _numbers(low, cell)) & (F.col("key") <= _numbers(high, cell)))
        at = (F.col("key") - _numbers(low, cell)) - F.pmod(F.col("key") - _numbers(low, cell), _numbers(width, cell))
        bins = open_rows.groupBy("cell", at.alias("at")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("cell").orderBy("at"))
        needed = F.get(F.split(F.lit(",".join(repr(g - b) for g, b in zip(goal, below, strict=True))), ",").cast("array<double>"), cell)
        crossing = bins.withColumn("upto", upto).where((F.col("upto") >= needed) & (F.col("upto") - F.col("bytes") < needed))
        for c in crossing.collect():
            i = c.cell
            before, left = below[i] + c.upto - c.bytes, low[i] + c.at
            right = min(high[i], left + width[i] - 1)
            low[i], high[i], below[i] = left, right, before
            if width[i] == 1 or c.bytes <= share:
                done[i] = True
                cut[i] = left if goal[i] - before < c.bytes / 2 else right + 1
    return list(zip(dims, cut, strict=True))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Give the number of shards, or the bytes a shard should have.  The size is the text's UTF-8 bytes
    and 16 (a null text has none and the checksum 0); shards have nearly equal sizes (law ``bytes``),
    to within one document or ``TOLERANCE``.  Slots count from 0 without gaps in each shard.
    Null metadata stand before all values; rows equal in id, text and metadata can't be told apart and
    stay in one shard; with fewer documents than shards some shards are empty, and an empty table gives
    no row.  Columns of other names are ignored.
    """
    if not shards and not target_bytes:
        raise ValueError("give shards or target_bytes")
    n_dims = len(dims)
    rows = written(_keyed(docs, dims, id_col, text_col), "kd-rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    shards = shards or max(1, -(-(total.bytes or 0) // target_bytes))
    cells = [shards]
    while max(cells) > 1:
        cuts = _cuts(rows, n_dims, cells, TOLERANCE * (total.bytes or 0) / shards)
        left, parts = [], []
        for c in cells:
            left.append(len(parts))
            parts += [c // 2, c - c // 2] if c >= 2 else [c]
        cell = F.col("cell")
        dim, cut = _numbers([d for d, _ in cuts], cell), _numbers([t for _, t in cuts], cell)
        split = _numbers([int(c >= 2) for c in cells], cell)
        key = F.coalesce(*[F.when(dim == i, F.col(f"k{i}")) for i in range(n_dims)])
        rows = written(rows.withColumn("cell", _numbers(left, cell) + F.when((split == 1) & (key >= cut), 1).otherwise(0)), "kd-cells")
        cells = parts
    chunks = max(1, total.rows // (ROWS_A_CHUNK * shards))
    rows = rows.withColumn("chunk", F.pmod(F.col("tie"), F.lit(chunks)))
    counts = rows.groupBy("cell", "chunk").count()
    before = Window.partitionBy("cell").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cell", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("cell", "chunk").orderBy("tie", "doc_id", "text_crc32", "size")
    placed = rows.withColumn("n", F.row_number().over(within) - 1).join(offsets, ["cell", "chunk"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("cell").cast("int").alias("shard"), (F.col("offset") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
