"""Isolation forest over vectors (M1-M7, A10) as Spark jobs.

Training: every tree draws its own sub-sample from all rows by hashing
(key, tree, seed), so sampling does not depend on partitioning; a hash
threshold keeps a few hundred candidate rows per tree before the shuffle, and
each tree is grown by ``groupBy(tree).applyInPandas`` on at most
``max_samples`` rows.  The model is a table of nodes; scoring takes it in
blocks of trees, each broadcast once and kept by the model until released,
and adds up path lengths over the blocks.  The offset is the interpolated
contamination quantile of the training scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.config import DEFAULT
from logweave.functions.severity import anomaly_probability, severity
from logweave.session import written

TREES_A_BLOCK = 500  # trees of one broadcast
NODE_SCHEMA = ("tree long, node long, feature int, threshold double, left long, right long, "
               "size long, depth int")


def average_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): mean unsuccessful-search path length in a BST of n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow_tree(tree_id: int, x: np.ndarray, seed: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree_id])
    max_depth = int(math.ceil(math.log2(max(len(x), 2))))
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]  # (rows, depth, parent, side)
    while stack:
        rows, depth, parent, side = stack.pop()
        node = len(nodes)
        nodes.append([tree_id, node, -1, 0.0, -1, -1, len(rows), depth])
        if parent >= 0:
            nodes[parent][4 if side == 0 else 5] = node
        if depth >= max_depth or len(rows) <= 1:
            continue
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        nodes[node][2], nodes[node][3] = f, thr
        go_left = sub[:, f] < thr
        stack.append((rows[~go_left], depth + 1, node, 1))
        stack.append((rows[go_left], depth + 1, node, 0))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    nodes: DataFrame          # NODE_SCHEMA rows
    sample_size: int
    offset: float | None      # contamination quantile of training scores
    n_trees: int
    _blocks: list | None = None

    def blocks(self) -> list:
        """Broadcast node arrays of ``TREES_A_BLOCK`` trees each; made once."""
        if self._blocks is None:
            sc = self.nodes.sparkSession.sparkContext
            self._blocks = []
            for first in range(0, self.n_trees, TREES_A_BLOCK):
                block = self.nodes.filter((F.col("tree") >= first) & (F.col("tree") < first + TREES_A_BLOCK)).toPandas()
                self._blocks.append(sc.broadcast(_arrays(block)))
        return self._blocks

    def release(self) -> None:
        """Drops the broadcasts; the next score makes them anew."""
        for block in self._blocks or []:
            block.unpersist()
        self._blocks = None


def _sample(vecs: DataFrame, key: str, n: int, n_trees: int, max_samples: int, seed: int) -> DataFrame:
    """Per-tree sub-samples of ``min(max_samples, n)`` rows, drawn from all rows by one rule.

    Each row is hashed once per tree; the threshold lets through so many that
    a tree gets fewer than its sample with a probability below 1e-20, and the
    first ``size`` by hash are kept.  Deterministic and independent of
    partitioning and input size.
    """
    size = min(max_samples, n)
    modulus = 2 ** 31 - 1
    expected = size + 12 * math.sqrt(size) + 60
    cut = int(min(1.0, expected / max(n, 1)) * modulus)
    drawn = F.filter(
        F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long")),
        lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(modulus)) <= cut,
    )
    cand = vecs.select(key, "embedding", F.explode(drawn).alias("tree"))
    cand = cand.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)), F.lit(modulus)))
    w = Window.partitionBy("tree").orderBy("_h", key)
    return cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).drop("_r", "_h")


def interpolated_percentile(df: DataFrame, column: str, share: float, accuracy: int = 100_000) -> float:
    """The percentile between two order statistics, exactly, without a global sort: a sketch narrows the
    range, and the two neighbours are found by rank among the few values in it."""
    rows = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    place = (rows.count() - 1) * share
    rank, part = math.floor(place), place - math.floor(place)
    width = 2 / accuracy
    while True:
        ends = [max(0.0, share - width), min(1.0, share + width)]
        lo, hi = rows.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
        if width >= 1:
            lo, hi = rows.agg(F.min("v"), F.max("v")).first()
        below = rows.filter(F.col("v") < lo).count()
        upto = F.sum("n").over(Window.orderBy("v")) + F.lit(below)
        near = rows.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
        a, b = near.agg(F.min(F.when(F.col("upto") > rank, F.col("v"))), F.min(F.when(F.col("upto") > rank + 1, F.col("v")))).first()
        if part == 0 and a is not None and below <= rank:
            return float(a)
        if a is not None and b is not None and below <= rank:
            return float(a + (b - a) * part)
        if width >= 1:
            return float(hi)
        width *= 8


def train(vecs: DataFrame, key: str = "normalized_message",
          n_trees: int = DEFAULT.anomaly_n_estimators, max_samples: int = DEFAULT.anomaly_max_samples,
          contamination: float = DEFAULT.anomaly_contamination, seed: int = DEFAULT.anomaly_seed,
          ) -> IsolationForestModel | None:
    """M1: fit on all non-null vectors; ``None`` when there are none."""
    vecs = vecs.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    n = vecs.count()
    if n == 0:
        return None
    size = min(max_samples, n)
    sample = _sample(vecs, key, n, n_trees, max_samples, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < size:
            raise RuntimeError(f"tree {pdf['tree'].iloc[0]} has {len(pdf)} of {size} rows")
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame(_grow_tree(int(pdf["tree"].iloc[0]), x, seed),
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    nodes = written(sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA), "forest-nodes")
    model = IsolationForestModel(nodes, size, None, n_trees)
    scored = written(score_samples(vecs, model, key).select("score_sample"), "forest-scores")
    model.offset = interpolated_percentile(scored, "score_sample", contamination)
    return model


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values(["tree", "node"])
    trees = sorted(pdf["tree"].unique())
    width = int(pdf.groupby("tree")["node"].max().max()) + 1
    shape = (len(trees), width)
    feat = np.full(shape, -1, dtype=np.int64)
    thr = np.zeros(shape)
    left = np.full(shape, -1, dtype=np.int64)
    right = np.full(shape, -1, dtype=np.int64)
    size = np.zeros(shape)
    depth = np.zeros(shape)
    t_index = {t: i for i, t in enumerate(trees)}
    ti = pdf["tree"].map(t_index).to_numpy()
    ni = pdf["node"].to_numpy()
    feat[ti, ni] = pdf["feature"].to_numpy()
    thr[ti, ni] = pdf["threshold"].to_numpy()
    left[ti, ni] = pdf["left"].to_numpy()
    right[ti, ni] = pdf["right"].to_numpy()
    size[ti, ni] = pdf["size"].to_numpy()
    depth[ti, ni] = pdf["depth"].to_numpy()
    leaf_len = depth + average_path_length(size)
    return feat, thr, left, right, leaf_len


def _path_lengths(block):
    """Adds the path lengths of one block of trees to ``total``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feat, thr, left, right, leaf_len = block.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            rows = np.arange(len(x))
            total = pdf["total"].to_numpy(dtype=np.float64).copy()
            for t in range(feat.shape[0]):
                node = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feat[t, node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.where(inner, f, 0)] < thr[t, node]
                    nxt = np.where(go_left, left[t, node], right[t, node])
                    node = np.where(inner, nxt, node)
                total += leaf_len[t, node]
            yield pdf.assign(total=total)

    return run


def score_samples(vecs: DataFrame, model: IsolationForestModel, key: str = "normalized_message") -> DataFrame:
    """M2 core: ``score_sample`` = -(2 ** (-E[h(x)] / c(sample_size))) per vector."""
    c_n = float(average_path_length(np.array([model.sample_size]))[0]) or 1.0
    out = vecs.filter(F.col("embedding").isNotNull()).select(key, "embedding", F.lit(0.0).alias("total"))
    schema = f"{key} {dict(vecs.dtypes)[key]}, embedding {dict(vecs.dtypes)['embedding']}, total double"
    for block in model.blocks():
        out = out.mapInPandas(_path_lengths(block), schema)
    mean = F.col("total") / F.lit(float(model.n_trees))
    return out.select(key, (-F.pow(F.lit(2.0), -mean / F.lit(c_n))).alias("score_sample"))


def score(vecs: DataFrame, model: IsolationForestModel, key: str = "normalized_message") -> DataFrame:
    """M2/M3/M4: decision value, anomaly flag, probability and severity for
    every vector in one pass (the reference reloads the model per message)."""
    s = score_samples(vecs, model, key).withColumn("raw", F.col("score_sample") - F.lit(model.offset))
    prob = anomaly_probability(F.col("raw"))
    return s.select(
        key,
        (F.col("raw") < 0).alias("is_anomaly"),
        F.round(prob, 4).alias("anomaly_probability"),
        F.round("raw", 4).alias("raw_score"),
        severity(prob).alias("severity"),
    )


def summary(vecs: DataFrame, model: IsolationForestModel, key: str = "normalized_message",
            contamination: float = DEFAULT.anomaly_contamination) -> DataFrame:
    """A10: training summary — n, anomalies, contamination, mean and
    population std of the decision values."""
    s = score_samples(vecs, model, key).withColumn("raw", F.col("score_sample") - F.lit(model.offset))
    return s.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.when(F.col("raw") < 0, 1).otherwise(0)).cast("long").alias("n_anomalies"),
        F.lit(contamination).alias("contamination"),
        F.avg("raw").alias("score_mean"),
        F.stddev_pop("raw").alias("score_std"),
    )


def save(model: IsolationForestModel, path: str) -> str:
    """M6: nodes and the scalar parameters as Parquet (no pickles)."""
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(model.sample_size, model.offset, model.n_trees)],
                          "sample_size long, offset double, n_trees long").write.mode("overwrite").parquet(
        f"{path}/params")
    return path


def load(spark, path: str) -> IsolationForestModel:
    p = spark.read.parquet(f"{path}/params").first()
    return IsolationForestModel(spark.read.parquet(f"{path}/nodes"), int(p[0]), float(p[1]), int(p[2]))
