"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from logweave.llm import setm_phrases as sp
from tests.llm.conftest import SCHEMA, prose, rows_of


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def best(rows, least, top):
    """The whole result by counting in dictionaries; rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces_of(text):
            n[lang] += len(ws)
            for size in (1, 2, 3):
                f.update((lang, *ws[i : i + size]) for i in range(len(ws) - size + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, a in found.items():
        if len(p) == 4:
            gone |= {q for q in ((p[0], *p[1:3]), (p[0], *p[2:4])) if 100 * a >= 50 * found[q]}
    out = {}
    for p, a in found.items():
        if p not in gone:
            cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return {(lang, i, t.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, t, left, right) in enumerate(sorted(rows)[:top], 1)}


def wordy(rng, docs):
    """Texts of few words, so that phrases repeat and scores tie."""
    words = ["of", "The", "rend", "and", "é", "a b", "x", "ZU"]
    for k in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "\x0b", " -"]) for _ in range(rng.randint(0, 60)))
        yield (k, text, rng.choice(["en", "en", "en", "fr", None, "und"]), "a", 1)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 64)


def test_blocks_cut_anywhere_count_the_same(tiny):
    rng = random.Random(1)
    texts = [t for _, t, _, _, _ in wordy(rng, 40)] + [" ".join(rng.choice("ab") for _ in range(700)), "q" * 400 + " b", "", "..."]
    batch = pa.record_batch({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})
    bits = np.full((sp.FILTER_PARTS, sp.PART_BITS // 8), 255, np.uint8)
    want = Counter(p for t in texts for ws in pieces_of(t) for p in zip(ws, ws[1:], ws[2:], strict=False))
    words, rows = {}, []
    for part in sp._counted_words([batch], 0):
        words.update(zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True))
    for _, _, _, _, _, place, h, known in sp._blocks([batch], 0):
        once = sp.semi_joined(place, h, known, 1, bits)
        rows.append(sp._relation(*sp.semi_joined(*once, 2, bits)))
    got = Counter()
    for part in sp._counted_phrases(rows, 3):
        for *p, f in zip(*[c.to_pylist() for c in part.columns], strict=True):
            got[tuple(words[w] for w in p)] += f
    assert got == want


def test_filter_passes_all_groups(spark):
    rng = np.random.default_rng(2)
    own = rng.integers(-(2**63), 2**63, (3_000, 2), dtype=np.int64)
    bits = sp.group_filter(spark.createDataFrame(own.tolist(), "w1 long, w2 long")).value
    assert sp.passes(bits, sp.group_keys(list(own.view(np.uint64).T))).all()
    other = rng.integers(0, 2**63, (200_000, 2), dtype=np.int64).view(np.uint64)
    assert sp.passes(bits, sp.group_keys(list(other.T))).mean() < 0.001


def test_phrases_equal_brute_force(spark, small, odd, clashing, none):
    rng = random.Random(4)
    made = spark.createDataFrame([*wordy(rng, 400), (-1, None, "en", "a", 1), (-2, "", None, "a", 1), (None, " . ", "fr", None, None)], SCHEMA).repartition(5)
    for docs, least, top in ((made, 10, 2_000), (made, 2, 30), (small, 10, 2_000), (odd, 2, 50), (clashing, 2, 50)):
        rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
        assert set(rows_of(sp.collocations(docs, least=least, top=top))) == best(rows, least, top)
    assert sp.collocations(none).count() == 0
    with pytest.raises(ValueError):
        sp.collocations(none, max_words=4)


def test_words_of_one_hash_begin_again(spark, small, monkeypatch):
    docs = small.limit(20).cache()
    want = rows_of(sp.collocations(docs))
    inner = sp._counted_words

    def weak(parts, seed):
        for batch in inner(parts, seed):
            if seed == 0:
                h = batch.column(2).to_numpy() % 97
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h), batch.column(3)], names=batch.schema.names)
            yield batch

    monkeypatch.setattr(sp, "_counted_words", weak)
    assert set(rows_of(sp.collocations(docs))) == set(want)


def test_large_counts_are_exact(spark):
    words = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 2, 10**13)], "lang string, word string, h long, f long")
    pair = spark.createDataFrame([(1, 2, 2 * 10**12 + 1)], "w1 long, w2 long, f long")
    got = sp._scored(pair, 2, words, []).collect()[0]
    assert got.score == 1_000_000 * (2 * 10**12 + 1) ** 2 // (3 * 10**12 * 10**13)


def test_very_long_text(spark):
    rng = random.Random(3)
    text = prose(rng, 40) + " alpha beta" * 200_000 + "\n" + "z" * 2_500_000
    got = sp.collocations(spark.createDataFrame([(1, text, "en", "a", 1)], SCHEMA)).collect()
    assert {(r.phrase, r.a) for r in got} == {("alpha beta alpha", 199_999), ("beta alpha beta", 199_999)}


def relation_of(*words):
    """A relation with one block for each list of words."""
    return [sp._relation(np.arange(len(ws)), np.array(ws, np.uint64), 0) for ws in words]


def totals(parts):
    got = Counter()
    for part in parts:
        for *p, f in zip(*[c.to_pylist() for c in part.columns], strict=True):
            got[tuple(p)] += f
    return got


def test_counts_of_many_blocks_are_held_together(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 9, 400) for _ in range(30)]
    want = Counter(p for ws in blocks for p in zip(ws.tolist(), ws[1:].tolist(), strict=False))
    (whole,) = sp._counted_phrases(iter(relation_of(*blocks)), 2)
    assert whole.num_rows == len(want) and totals([whole]) == want
    monkeypatch.setattr(sp, "HELD", 100)
    parts = list(sp._counted_phrases(iter(relation_of(*blocks)), 2))
    assert len(parts) > 5 and totals(parts) == want


def test_phrases_of_one_key_are_counted_apart(monkeypatch):
    monkeypatch.setattr(sp, "group_keys", lambda words: words[0] % np.uint64(3))
    rng = np.random.default_rng(6)
    ws = rng.integers(0, 7, 900)
    (got,) = sp._counted_phrases(iter(relation_of(ws)), 3)
    want = Counter(zip(ws.tolist(), ws[1:].tolist(), ws[2:].tolist(), strict=False))
    assert got.num_rows == len(want) and totals([got]) == want


def test_buckets_hold_all_rows_of_their_keys(monkeypatch):
    monkeypatch.setattr(sp, "SENT", 200)
    rng = np.random.default_rng(7)
    h = rng.integers(-(2**63), 2**63, 500, dtype=np.int64)
    rows = {"lang": ["en", "", "é"] * 166 + ["fr", "x"], "word": [chr(97 + k % 26) * (k % 40) for k in range(500)], "h": h, "f": np.arange(500)}
    columns = [("lang", "string"), ("word", "string"), ("h", "long"), ("f", "long")]
    parts = list(sp._dealt(iter([pa.record_batch(rows)] * 2), lambda batch: batch.column(2).to_numpy().view(np.uint64), 16))
    assert len(parts) > 4
    table = pa.Table.from_batches(parts)
    seen = []
    for bucket in range(16):
        own = sp._unpacked(table.filter(pc.equal(table["bucket"], bucket)), columns)
        assert ((own["h"] >> np.uint64(60)) == bucket).all()
        seen += zip(own["lang"].to_pylist(), own["word"].to_pylist(), own["h"].view(np.int64).tolist(), own["f"].tolist(), strict=True)
    assert Counter(seen) == Counter(list(zip(rows["lang"], rows["word"], h.tolist(), range(500), strict=True)) * 2)


def test_no_row_an_occurrence_is_summed_by_the_jvm(spark, small):
    text = small.selectExpr("'en' as lang", "text")
    relation = sp._first_relation(text, spark.sparkContext.broadcast(np.full((sp.FILTER_PARTS, sp.PART_BITS // 8), 255, np.uint8)), 0)
    for df in (sp._words(text, 0), sp._groups(relation, 2, 10, 8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan


def test_best_of_a_language_are_first_the_best_of_its_parts(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame(list(wordy(rng, 300)), SCHEMA)
    ranked = sp.collocations(docs, least=2, top=7)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert set(rows_of(ranked)) == best(rows, 2, 7)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(lang" in line and "share" in line for line in plan.split("\n"))
