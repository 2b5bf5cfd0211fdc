"""K-d shards and the source mix: laws, brute force, reruns, odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm import kd_shards as kd
from logweave.llm import source_mix as sm
from tests.llm.conftest import rows_of


def sharded(df, **kw):
    return [r.asDict() for r in kd.kd_shards(df, **kw).collect()]


def check_shards(rows, docs, n):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_nearly_equal(spark, small):
    rows = sharded(small, shards=7)
    check_shards(rows, small, 7)
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    mean, heaviest = sum(sums.values()) / 7, max(r["size"] for r in rows)
    assert max(abs(s - mean) for s in sums.values()) <= 2 * heaviest
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, sharded(small, shards=7)))


def test_one_hot_value_is_split(spark):
    """All metadata equal: the cut falls between rows of one value."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 30).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(90).cast("long").alias("n_chars"))
    counts = Counter(r["shard"] for r in sharded(docs, target_bytes=106 * 500))
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 6


def test_shards_of_odd_rows(clashing, none):
    check_shards(sharded(clashing, shards=4), clashing, 4)
    check_shards(sharded(clashing, shards=20), clashing, 20)
    assert sharded(none, shards=3) == [] and sharded(none, target_bytes=100) == []
    with pytest.raises(ValueError):
        kd.kd_shards(none)


def filled(sizes):
    """Targets by resharing the excess until none is above its cap."""
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in free)
        share = {s: rest * weights[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5000, "c": 30, None: 400}, {"a": 1, "b": 1, "c": 100000}, {"x": 0, "y": 9}, {"z": 0}])
def test_targets_equal_repeated_resharing(spark, sizes):
    got = {r.source: r.target for r in sm.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(filled(sizes))


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_permutation(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("s", F.lit(3))
    assert sorted(r.y for r in sm.permuted(df, "id", "n", "y", "s").collect()) == list(range(n))


def test_mix_comes_near_the_targets(spark, small):
    rows = sm.mix(small, block_words=32).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    by_doc = {r.doc_id: r for r in small.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == words(by_doc[r.doc_id].text) and 0 <= r.taken <= 3 * r["size"]
        sizes[by_doc[r.doc_id].source] += r["size"]
        taken[by_doc[r.doc_id].source] += r.taken
    target = filled(dict(sizes))
    for r in rows:
        s = by_doc[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
    assert all(abs(taken[s] - target[s]) <= 3 * 32 for s in sizes)
    again = {(r.doc_id, r.taken) for r in sm.mix(small.repartition(5), block_words=32).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixed_texts_have_the_taken_words(spark, small):
    taken = {r.doc_id: r.taken for r in sm.mix(small, block_words=16).collect()}
    mixed = sm.mixed_documents(small, block_words=16)
    assert mixed.columns == small.columns
    rows = mixed.collect()
    assert {r.doc_id: words(r.text) for r in rows} == {d: n for d, n in taken.items() if n}
    assert all(r.n_chars == len(r.text) for r in rows)
    own = {r.doc_id: r.text for r in small.collect()}
    assert all(set(r.text.split()) <= set(own[r.doc_id].split()) for r in rows)


def test_mix_of_odd_rows(clashing, none):
    rows = sm.mix(clashing, block_words=8).collect()
    assert len(rows) == clashing.count() and all(r.taken <= 3 * r["size"] for r in rows)
    assert sm.mix(none).count() == 0 and sm.mixed_documents(none).count() == 0
    out = sm.mixed_documents(clashing, block_words=8)
    assert out.columns == clashing.columns
    assert sorted(words(r.text) for r in out.collect()) == sorted(r.taken for r in rows if r.taken)


def test_main_paths_are_native(small):
    for df in (kd.kd_shards(small, shards=2), sm.mix(small)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert rows_of(small.limit(0)) == []


def test_texts_with_a_common_beginning_are_split_by_source(spark):
    """Sources that agree in their first signs have places of their own."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', 30) AS text", "'en' AS lang", "concat('https://common.example/crawl/', lpad(cast(id % 30 AS string), 3, '0')) AS source", "90L AS n_chars")
    shard = {r["doc_id"]: r["shard"] for r in sharded(docs, shards=10)}
    by_source = defaultdict(set)
    for d, s in shard.items():
        by_source[d % 30].add(s)
    # 30 sources of equal size over 10 shards: three whole sources a shard, cut at rows only near the edges
    assert sum(len(s) for s in by_source.values()) <= 40
    counts = Counter(shard.values())
    assert max(counts.values()) - min(counts.values()) <= 6
    codes = kd._codes(docs, ("source", "lang", "n_chars"), "doc_id", "text").select("doc_id", "c0").collect()
    assert {r.doc_id % 30: r.c0 for r in codes} == {k: float(k) for k in range(30)}
