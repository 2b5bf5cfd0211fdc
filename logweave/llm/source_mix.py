"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source form one stream, cut into blocks.  Each output shard draws how many of its slots
each source gets: a multinomial draw with one stratified uniform a slot, so a count is within one of its
expectation.  A source's slots, numbered over all shards, run through its block indices in a
pseudorandom order, a new one each pass (swap-or-not permutation); slots and blocks meet by a join on
the block's index.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.shared import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
SLOTS_A_SHARD = 1 << 16
MOST_PASSES = 3
ROUNDS = 16
SEED = 20_240
#: Rows whose running sums are taken together, about.
ROWS_A_CHUNK = 8_192


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed, return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; a target stops at ``MOST_PASSES`` times the
    source's size and the excess goes to the others by weight.  In the order of cap over weight, the
    sources that stop come first; the level of the rest follows from what these leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    ranked = ranked.withColumns({"weight": F.pmod("rank", F.lit(3)) + 1, "cap": F.lit(MOST_PASSES) * F.col("source_size")})
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filled), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    levels = ranked.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))
    found = levels.withColumn("found", F.min(free).over(every)["level"])
    return found.select("source", "source_size", "rank", F.least(F.col("cap").cast("double"), F.coalesce("found", F.lit(0.0)) * F.col("weight")).alias("target"))


def permuted(df: DataFrame, index: str, size: str, out: str, *salt: str) -> DataFrame:
    """``df`` with ``out``: the place of ``index`` in a pseudorandom permutation of 0 .. size - 1, one for
    each value of ``salt``.  Each round pairs x with K - x and swaps the two or not by a bit of a hash that
    both share, which makes it a bijection of any size."""
    keys = [F.col(s) for s in salt]
    df = df.withColumn(out, F.col(index))
    for r in range(ROUNDS):
        offset = F.pmod(F.xxhash64(F.lit(SEED), F.lit(r), *keys), F.col(size))
        df = df.withColumn("_pair", F.pmod(offset - F.col(out), F.col(size)))
        bit = F.pmod(F.xxhash64(F.lit(SEED + 1), F.lit(r), F.greatest("_pair", out), *keys), F.lit(2))
        df = df.withColumn(out, F.when(bit == 1, F.col("_pair")).otherwise(F.col(out)))
    return df.drop("_pair")


def _slots(sources: DataFrame) -> DataFrame:
    """Blocks that the mix takes: rank, block, times."""
    # slots in proportion to the target over the mean words of a block
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    s = sources.withColumn("wanted", wanted)
    every = Window.partitionBy()
    s = s.withColumn("slots", F.ceil(F.sum("wanted").over(every)).cast("long")).where("slots > 0")
    upto = F.sum("wanted").over(Window.orderBy("rank")) / F.sum("wanted").over(every)
    s = s.withColumn("hi", F.least(upto, F.lit(1.0))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0.0)))
    s = s.withColumn("hi", F.when(F.col("rank") == F.max("rank").over(every), 1.0).otherwise(F.col("hi")))
    s = s.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {SLOTS_A_SHARD}"))))
    s = s.withColumn("n", F.least(F.lit(SLOTS_A_SHARD).cast("long"), F.col("slots") - F.col("shard") * SLOTS_A_SHARD))

    def below(edge: str) -> Column:
        """Slots of the shard whose uniform, drawn within the slot's own stratum, is below the edge."""
        place = F.col(edge) * F.col("n")
        stratum = F.floor(place).cast("long")
        uniform = F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", stratum), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return stratum + F.when((stratum < F.col("n")) & (uniform < place - stratum), 1).otherwise(0)

    s = s.withColumn("count", below("hi") - below("lo"))
    first = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("first", F.coalesce(F.sum("count").over(first), F.lit(0))).where("count > 0")
    # a task for each part of the shards' slots, not one for the few rows that they come from
    s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    slots = s.select("rank", "blocks", F.explode(F.expr("sequence(first, first + count - 1)")).alias("j"))
    # a draw beyond the passes is void
    slots = slots.where(F.col("j") < F.col("blocks") * MOST_PASSES)
    slots = slots.select("rank", "blocks", F.expr("j div blocks").alias("pass"), F.pmod("j", F.col("blocks")).alias("place"))
    times = permuted(slots, "place", "blocks", "block", "rank", "pass").groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    # written, so that a join's null test on the index isn't pushed through the rounds, doubling with each
    return written(times, "mix-slots")


def mix_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (rid, doc_id, source, size, h; rid unique) as (placed, takes).

    placed: rid, doc_id, size, rank, start (in the stream of its source), source_size, target.
    takes: rid, block, lo, hi (words of the document in that block), times.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n")).first().n
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes).withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    sources = written(sources, "mix-sources")
    ranked = docs.join(sources.select("source", "rank", "source_size", "target"), docs.source.eqNullSafe(sources.source)).drop("source")
    ranked = ranked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.lit(max(1, total // ROWS_A_CHUNK))))
    sums = ranked.groupBy("rank", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("rank", "chunk").orderBy("doc_id", "h", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["rank", "chunk"])
    placed = placed.select("rid", "doc_id", "size", "rank", (F.col("offset") + F.col("within")).alias("start"), "source_size", "target")
    spans = placed.where("size > 0").select("rid", "rank", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    lo = F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")
    hi = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")
    takes = spans.select("rid", "rank", "block", lo.alias("lo"), hi.alias("hi")).join(_slots(sources), ["rank", "block"])
    return placed, takes.select("rid", "block", "lo", "hi", "times")


def _slim(docs: DataFrame, rid: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(rid.alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target, taken.

    One row for each row of ``docs``.  Null or empty texts have size 0 and nothing taken; a null source is
    a source of its own, the last.  No document is taken more than ``MOST_PASSES`` times its size.
    Reruns give the same; rows equal in id and text are interchangeable.  An empty table gives no row.
    Columns of other names are ignored.
    """
    slim = written(_slim(docs, F.monotonically_increasing_id(), id_col, text_col, source_col), "mix-docs")
    placed, takes = mix_blocks(slim, block_words)
    taken = takes.groupBy("rid").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    out = placed.join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each text made of the words that the mix takes, pass after pass; same columns.

    A document of which nothing is taken goes; one that is taken once as a whole keeps its text as it is;
    passes stand on lines of their own.  Within a pass, words keep the white space after them.
    ``n_chars``, where there is one, is that of the new text.
    """
    rid, takes_col, words_col = (free_name(docs, n) for n in ("_rid", "_takes", "_words"))
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-texts")
    slim = written(_slim(numbered, F.col(rid), id_col, text_col, source_col), "mix-docs")
    _, takes = mix_blocks(slim, block_words)
    listed = takes.groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi", "times"))).alias(takes_col))
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    joined = numbered.join(listed, rid).withColumn(words_col, words)
    one_pass = F.transform(
        F.sequence(F.lit(1), F.lit(MOST_PASSES)),
        lambda p: F.array_join(F.flatten(F.transform(F.filter(takes_col, lambda t: t["times"] >= p), lambda t: F.slice(words_col, (t["lo"] + 1).cast("int"), (t["hi"] - t["lo"]).cast("int")))), ""),
    )
    whole = F.forall(takes_col, lambda t: t["times"] == 1) & (F.aggregate(takes_col, F.lit(0).cast("long"), lambda n, t: n + t["hi"] - t["lo"]) == F.size(words_col))
    text = F.when(whole, F.col(f"`{text_col}`")).otherwise(F.array_join(F.filter(one_pass, lambda s: s != ""), "\n"))
    out = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text_col}`")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
