"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; all other text is unlabelled, and labels of
bad quality aren't used.  The share of positives in the unlabelled text is estimated first: a classifier
of positives against unlabelled rows ranks held-back rows of both, and the prior is the least ratio of
their tails (with a margin for the sample's size).  Then a linear model over binned features minimises
the non-negative unbiased risk: prior * loss+(positives) + max(0, loss-(unlabelled) - prior *
loss-(positives)); while the second part is negative, the step goes the other way.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.labelled import first_by_hash, in_fold, sample
from logweave.llm.shared import free_name, written

#: Rows of either kind that are learned from, at most.
POSITIVE_ROWS = 8_000
UNLABELLED_ROWS = 8_000
BINS = 12
STEPS = 400
#: Bins of a margin of 1, in histograms over all rows.
RESOLUTION = 1024

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_HIGH = np.arange(256) >= 128
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_CLAUSE = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\"()-"])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CONTROL = (np.arange(256) < 32) & ~_SPACE
_SIGN = ~(_UPPER | _LOWER | _HIGH | _DIGIT | _CLAUSE | _SPACE | _CONTROL)

FEATURES = (
    "log_words", "word_length", "distinct", "repeated_next", "top_word", "upper", "sign", "exclaim", "bar", "digit", "clause",
    "space", "newline", "control", "high", "same_lines", "line_words", "compressed",
)


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all 0 for an empty one (the first tells it apart)."""
    text = text or ""
    words = text.split()
    if not words:
        return [-1.0] + [0.0] * (len(FEATURES) - 1)
    data = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), len(data)
    letters = max(1, int(hist[_UPPER | _LOWER | _HIGH].sum()))
    distinct = Counter(words)
    lines = [x for x in text.split("\n") if x]
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[at : at + (1 << 20)])) for at in range(0, size, 1 << 20)) + len(packer.flush())
    return [
        math.log(n),
        (size - int(hist[_SPACE].sum())) / n,
        math.log(len(distinct)) / math.log(n) if n > 1 else 1.0,
        sum(map(eq, words, words[1:])) / n,
        max(distinct.values()) / n,
        int(hist[_UPPER].sum()) / letters,
        int(hist[_SIGN].sum()) / size,
        int(hist[ord("!")]) / n,
        int(hist[ord("|")]) / n,
        int(hist[_DIGIT].sum()) / size,
        int(hist[_CLAUSE].sum()) / n,
        int(hist[_SPACE].sum()) / size,
        int(hist[10]) / n,
        int(hist[_CONTROL].sum()) / size,
        int(hist[_HIGH].sum()) / letters,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log(n / max(1, len(lines))),
        packed / size,
    ]


@dataclass
class Model:
    """Bin edges and weights: a fixed small size.  ``cut`` is the margin that becomes ``at``."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float
    cut: float
    at: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_binned(x, self.edges) @ self.weights - self.cut + math.log(self.at / (1 - self.at)))


def _edges(x: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Bin edges of each feature (column; ``counts`` rows of each): quantiles, with more of them in both tails."""
    inner = np.linspace(0, 1, BINS - 3)[1:-1]
    shares = np.array([0.01, 0.04, *inner, 0.96, 0.99])
    out = []
    for column in x.T:
        order = np.argsort(column, kind="stable")
        upto = np.cumsum(np.ones(len(x), np.int64) if counts is None else counts[order])
        out.append(column[order][np.searchsorted(upto, shares * upto[-1])])
    return np.array(out)


def _edges_of(described: DataFrame) -> np.ndarray:
    """Bin edges over all rows with features ``x``.  Values count by their logarithm to 1 / ``RESOLUTION``: the
    driver gets a row a feature and step, and the edges depend neither on partitions nor on a sample."""
    place = F.round(F.signum("v") * F.log1p(F.abs("v")) * RESOLUTION).cast("long").alias("place")
    found = described.select(F.posexplode("x").alias("feature", "v")).groupBy("feature", place).count().collect()
    out = []
    for k in range(len(FEATURES)):
        at, n = np.array(sorted((r["place"], r["count"]) for r in found if r["feature"] == k), np.int64).T
        value = np.sign(at) * np.expm1(np.abs(at) / RESOLUTION)
        out.append(_edges(value[:, None], n)[0] + 1e-9)  # a value lies left of its own edge
    return np.array(out)


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of all features, and a constant."""
    n, k = x.shape
    width = edges.shape[1] + 1
    out = np.zeros((n, k * width + 1), np.float32)
    for j in range(k):
        out[np.arange(n), j * width + np.searchsorted(edges[j], x[:, j], side="left")] = 1
    out[:, -1] = 1
    return out


class _Adam:
    def __init__(self, n: int, rate: float = 0.05):
        self.rate, self.m, self.v, self.t = rate, np.zeros(n), np.zeros(n), 0

    def step(self, w: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad**2 - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a linear model with logistic loss that minimise the non-negative unbiased risk."""
    w = np.zeros(p.shape[1])
    adam = _Adam(len(w))
    for _ in range(steps):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up = p.T @ (_sigmoid(gp) - 1) / len(p)
        down = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        grad = prior * up + down if negative >= 0 else -down
        adam.step(w, grad + penalty * w)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, from every other row of both."""
    w = _ranking(p, u)
    return tail_ratio(p[1::2] @ w, u[1::2] @ w, np.ones(len(u[1::2]), np.int64))


def _ranking(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Weights that tell every other row of both apart; the rows between are held back."""
    w = np.zeros(p.shape[1])
    adam = _Adam(len(w))
    for _ in range(STEPS // 2):
        grad = p[::2].T @ (_sigmoid(p[::2] @ w) - 1) / len(p[::2]) + u[::2].T @ _sigmoid(u[::2] @ w) / len(u[::2])
        adam.step(w, grad + 1e-3 * w)
    return w


def tail_ratio(positives: np.ndarray, margins: np.ndarray, counts: np.ndarray) -> float:
    """The least ratio of the tails above a margin, where the margins of error of both still allow a
    statement; of the unlabelled rows, ``counts`` have each of ``margins``."""
    sp, n = np.sort(positives), int(counts.sum())
    if not len(sp) or not n:
        return 0.5
    order = np.argsort(margins, kind="stable")
    su, below = margins[order], np.concatenate(([0], np.cumsum(counts[order])))
    at = np.unique(sp)
    qp = 1 - np.searchsorted(sp, at, side="left") / len(sp)
    qu = 1 - below[np.searchsorted(su, at, side="left")] / n
    margin = math.sqrt(math.log(40) / 2 / n) + math.sqrt(math.log(40) / 2 / len(sp))
    best = int(np.argmin((qu + margin) / qp))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def valley(margins: np.ndarray, prior: float, slack: float = 0.03, counts: np.ndarray | None = None) -> float:
    """The middle of the widest gap between margins of unlabelled rows (``counts`` of each) near where the
    prior's share of them lies above: the risk leaves the margin's zero point free, the prior fixes it."""
    order = np.argsort(margins, kind="stable")
    m = margins[order]
    upto = np.cumsum(np.ones(len(m), np.int64) if counts is None else counts[order])
    n = int(upto[-1])
    lo, hi = (int(np.searchsorted(upto, int(np.clip((1 - prior + d) * n, 0, n - 1)), "right")) for d in (-slack, slack))
    if hi <= lo:
        return float(m[lo])
    k = lo + int(np.argmax(np.diff(m[lo : hi + 1])))
    return float((m[k] + m[k + 1]) / 2)


def feature_column(text: str = "text"):
    """Column of the features of a text, as an array."""

    @F.arrow_udf("array<double>")
    def described(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([features(t) for _, texts in ta.batches(part) for t in texts], pa.list_(pa.float64()))

    return described(F.col(f"`{text}`").cast("string"))


def _matrix(rows: DataFrame) -> np.ndarray:
    found = rows.select(feature_column().alias("x")).collect()
    return np.array([r.x for r in found], float).reshape(len(found), len(FEATURES))


def _histogram(described: DataFrame, edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of all rows of a table with features ``x``, to 1 / ``RESOLUTION``, and how many rows have each."""

    @F.arrow_udf("double")
    def margin(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x = np.asarray(part.flatten(), float).reshape(len(part), len(FEATURES))
            yield pa.array(_binned(x, edges) @ weights, pa.float64())

    found = described.groupBy(F.round(margin("x") * RESOLUTION).cast("long").alias("bin")).count().orderBy("bin").collect()
    return np.array([r["bin"] for r in found], float) / RESOLUTION, np.array([r["count"] for r in found], np.int64)


def learn(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS, threshold: float = 0.3) -> Model | None:
    """Model from at most ``positives`` good labelled documents and ``unlabelled`` others (either the
    least by a hash of the id) outside the fold ``crc32(doc_id) % n == k``; None without positives.
    The prior's share of the unlabelled rows gets scores from ``threshold`` on: bin edges, prior and cut come
    from histograms of all rows outside the fold; only the weights are fitted to the sample.  The prior is
    held between 0.02 and 0.98, below and above which nothing could be learned."""
    p = _matrix(sample(docs, labels.where("quality = 1"), "quality", held_out, positives).orderBy("doc_id"))
    others = first_by_hash(docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), *held_out)).distinct(), unlabelled)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(others), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = chosen.select("doc_id", feature_column().alias("x")).orderBy("doc_id").collect()
    u = np.array([r.x for r in found], float).reshape(len(found), len(FEATURES))
    if not len(p) or not len(u):
        return None
    described = written(texts.where(~in_fold(F.col("doc_id"), *held_out)).select("doc_id", feature_column().alias("x")), "quality-features")
    edges = _edges_of(described)
    bp, bu = _binned(p, edges), _binned(u, edges)
    ranking = _ranking(bp, bu)
    used = docs.sparkSession.createDataFrame([(r.doc_id,) for r in found[::2]], "doc_id long")
    prior = tail_ratio(bp[1::2] @ ranking, *_histogram(described.join(F.broadcast(used), "doc_id", "left_anti"), edges, ranking))
    weights = non_negative_risk(bp, bu, prior)
    margins, counts = _histogram(described, edges, weights)
    return Model(edges, weights, prior, valley(margins, prior, counts=counts), threshold)


def score_column(model: Model | None, text_col: str = "text"):
    """Column of the scores (0 to 1) of whole texts; null counts as empty, without a model all are 0.5."""

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = [np.zeros(0)]
            for _, texts in ta.batches(part):
                x = np.array([features(t) for t in texts], float)
                out.append(model.score(x) if model else np.full(len(texts), 0.5))
            yield pa.array(np.concatenate(out), pa.float64())

    return scored(F.col(f"`{text_col}`").cast("string"))


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null texts count as empty ones, which have a score of their own; without a model (nothing to learn
    from) every score is 0.5.  Whole texts are scored in place, without a shuffle; columns of those names
    are replaced, all others and repeated rows stay; an empty table stays empty.
    """
    rows = docs.withColumn("score", score_column(model, text_col))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns alone, whatever their names."""
    own = free_name(docs, "score")
    return docs.withColumn(own, score_column(model, text_col)).where(F.col(own) >= threshold).drop(own)


def held_out_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``docs`` by a model learned outside the fold."""
    model = learn(docs, labels, held_out)
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", in_fold(F.col("doc_id"), *held_out).alias("held_out"), "score", "predicted")
