"""Toxicity and quality: held-out accuracy, folding, exceptions, odd rows."""

import zlib

import numpy as np
import pytest

from logweave.llm import pu_quality as pq
from logweave.llm import toxicity as tx
from tests.conftest import SF_ORACLE
from tests.llm.conftest import SCHEMA


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(np.asarray(s)):
        at = np.flatnonzero(np.asarray(s)[order] == v)
        rank[order[at]] = at.mean() + 1
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def held(spark, fn, label, mod):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in fn(docs, labels).collect()}
    assert len(scores) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % mod[0] == mod[1]) for d, r in scores.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())
    rows = [(r[label], scores[r.doc_id]) for r in labels.collect() if r.doc_id in scores and scores[r.doc_id].held_out]
    y = [a for a, _ in rows]
    return auc(y, [r.score for _, r in rows]), [(a, r.predicted) for a, r in rows]


def test_quality_on_held_out_rows(spark):
    area, pairs = held(spark, pq.held_out_scores, "quality", (5, 0))
    assert area > 0.97
    assert np.mean([p for a, p in pairs if a]) > 0.95 and np.mean([p for a, p in pairs if not a]) < 0.35


def test_toxicity_on_held_out_rows(spark):
    area, pairs = held(spark, tx.held_out_scores, "toxic", (4, 2))
    assert area > 0.75  # 30 toxic rows to learn from, in four languages
    assert np.mean([p for a, p in pairs if not a]) < 0.05 and np.mean([p for a, p in pairs if a]) > 0.5


def test_non_negative_risk_and_prior():
    rng = np.random.default_rng(1)
    positives, negatives = rng.normal(1.5, 1, (4000, 2)), rng.normal(-1.5, 1, (1000, 2))
    unlabelled = np.concatenate((rng.normal(1.5, 1, (3000, 2)), negatives))
    edges = pq._edges(np.concatenate((positives, unlabelled)))
    p, u = pq._binned(positives, edges), pq._binned(unlabelled, edges)
    prior = pq.estimated_prior(p, u)
    assert prior == pytest.approx(0.75, abs=0.05)
    w = pq.non_negative_risk(p, u, prior)
    margin = u @ w
    assert np.mean((margin > pq.valley(margin, prior)) == (np.arange(4000) < 3000)) > 0.96


def test_prior_and_cut_come_from_all_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    model = pq.learn(docs, labels, unlabelled=200)
    rows = docs.select(pq.in_fold(docs.doc_id, 5, 0).alias("held"), pq.feature_column().alias("x")).where("NOT held").collect()
    margins = pq._binned(np.array([r.x for r in rows]), model.edges) @ model.weights
    assert model.cut == pytest.approx(pq.valley(margins, model.prior), abs=2 / pq.RESOLUTION)


def test_folding_and_matching():
    lexicon = tx.Lexicon({"idiot": 5.0, "clown": 4.0}, ["clown fish"], 1.0, -3.0)
    for text in ("1d10t", "ІDІОТ", "id\u200biot", "ｉｄｉｏｔ", "an idiot!", "idiots"):
        assert lexicon.matcher().evidence(text) > 4, text
    for text in (None, "", "clown fish", "the clown fish swims", "overidiot", "x" * 10):
        assert lexicon.matcher().evidence(text) == 0, text
    assert lexicon.matcher().evidence("clown fish and a clown") > 3
    short, long = (lexicon.matcher().evidence("idiot " + "word " * n) for n in (5, 5_000))
    assert short > long > 0


def test_learned_exceptions(spark):
    texts = [(i, f"a trashy thing {i}" if i % 2 else f"plain trashcan text {i}", "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    lexicon = tx.learn(docs, labels)
    assert lexicon.score(lexicon.matcher().evidence("trashy talk")) > 0.5 > 0.3 > lexicon.score(lexicon.matcher().evidence("a trashcan"))


def test_odd_rows(spark, clashing, none, labels):
    empty_labels = labels.limit(0)
    for module, score in ((pq, pq.score_quality), (tx, tx.score_toxicity)):
        model = module.learn(clashing, empty_labels)
        out = score(clashing, model)
        assert out.count() == clashing.count() and sorted(out.columns) == sorted(clashing.columns)
        assert all(0 <= r.score <= 1 for r in out.collect())
        assert module.held_out_scores(none, empty_labels).count() == 0
        odd_labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1), (3, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
        assert module.held_out_scores(clashing, odd_labels).count() == clashing.count()


def test_features_are_finite():
    for text in (None, "", " ", "a", "a" * 10, "\x00\x01", "Ab! | 12\n\n中", "x y " * 5000):
        assert np.isfinite(pq.features(text)).all() and len(pq.features(text)) == len(pq.FEATURES)


def test_share_of_the_most_frequent_word():
    """Any number of words, ties included: 0.25 of 8 words are 'b', also among hundreds of others."""
    at = pq.FEATURES.index("top_word")
    assert pq.features("a b c b d e f g")[at] == 0.25 == pq.features("b a b c d e a f")[at]
    assert pq.features(" ".join([f"w{k}" for k in range(300)] + ["same"] * 100))[at] == 0.25


def test_bin_edges_come_from_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, 3.0, (20_000, len(pq.FEATURES)))
    made = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    edges, again = pq._edges_of(made.repartition(7)), pq._edges_of(made.repartition(2))
    assert (edges == again).all()
    inner = np.linspace(0, 1, pq.BINS - 3)[1:-1]
    want = np.quantile(x, [0.01, 0.04, *inner, 0.96, 0.99], axis=0).T
    assert np.allclose(edges, want, rtol=0.02, atol=0.02)
