"""Approximate vector search (K7, K8): coarse cells + exact re-rank.

K7 fits spherical k-means (MLlib ``KMeans`` with cosine distance, a
distributed iterative job) over vectors staged once, writes them partitioned
by cell in a bounded number of files each, and stores the centroids beside
them, so an index can be opened from its path.  K8 scores the query against
the centroids on the driver (``n_cells`` x dim, bounded by the parameter),
reads only the ``nprobe`` nearest cell folders (partition pruning) and
re-ranks exactly.  With ``nprobe = n_cells`` it is exact; recall against the
exact search is measured by ``recall_at_k``.

For many queries at once the cells are compressed (``compress``): a vector's
unit length difference from its centroid is cut into subspaces, each with a
codebook that is fitted on all vectors, and kept as one byte a subspace.
``search_many`` sends each query to its nearest cells, scores codes by table
look-ups in blocks of bounded size, and re-ranks the best exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.vector import cosine_to_query, rank_key
from logweave.session import written


@dataclass
class AnnIndex:
    path: str
    centroids: np.ndarray  # n_cells x dim, unit norm
    key: str

    @property
    def cells(self) -> str:
        return f"{self.path}/cells"


def build(vecs: DataFrame, path: str, n_cells: int, key: str = "normalized_message",
          seed: int = 42, max_iter: int = 20, files_per_cell: int = 8) -> AnnIndex:
    """K7: fit ``n_cells`` cells (about the square root of the vectors is usual) and write
    ``(key, embedding, cell)`` and the centroids under ``path``, over any index that is there."""
    data = written(vecs.filter(F.col("embedding").isNotNull()).select(
        key, "embedding", array_to_vector(F.col("embedding")).alias("features")), "ann-features")
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                   featuresCol="features", predictionCol="cell").fit(data)
    placed = model.transform(data).select(key, "embedding", "cell")
    salt = F.pmod(F.xxhash64(key), F.lit(files_per_cell))
    placed.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    rows = [(i, [float(x) for x in c], key) for i, c in enumerate(model.clusterCenters())]
    spark = vecs.sparkSession
    spark.createDataFrame(rows, "cell int, centroid array<double>, key string").write.mode("overwrite").parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> AnnIndex:
    """An index that ``build`` has written, in this application or another (one row a cell is read)."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    cents = np.array([r.centroid for r in rows], dtype=np.float64)
    cents /= np.maximum(np.linalg.norm(cents, axis=1, keepdims=True), 1e-300)
    return AnnIndex(path, cents, rows[0].key)


def search(spark: SparkSession, index: AnnIndex, query, k: int = 20, nprobe: int = 4) -> DataFrame:
    """K8: top-``k`` by cosine among the ``nprobe`` nearest cells."""
    q = np.asarray(query, dtype=np.float64)
    q = q / max(np.linalg.norm(q), 1e-300)
    cells = [int(c) for c in np.argsort(-(index.centroids @ q))[:nprobe]]
    part = spark.read.parquet(index.cells).filter(F.col("cell").isin(cells))  # folder pruning
    sim = cosine_to_query(F.col("embedding"), list(query))
    return (
        part.select(index.key, sim.alias("similarity"), (1 - sim).alias("distance"))
        .orderBy(rank_key(F.col("distance")).asc_nulls_last(), F.col(index.key))
        .limit(k)
    )


def recall_at_k(approx: DataFrame, exact: DataFrame, key: str) -> float:
    """Share of the exact top-k keys the approximate search returned (k rows each)."""
    n = exact.count()
    if n == 0:
        return 1.0
    hit = approx.select(key).join(exact.select(key), key, "left_semi").count()
    return hit / n


# -- compressed cells, many queries ------------------------------------------------

SUBSPACES, CODEWORDS = 8, 256
#: codes, and queries, that one task scores against one another
CODE_BLOCK, QUERY_BLOCK = 100_000, 256


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _cuts(dim: int, subspaces: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def compress(spark: SparkSession, index: AnnIndex, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = 42,
             max_iter: int = 6) -> None:
    """Fit one codebook a subspace on the differences of all vectors from their cells' centroids, and write
    the codes by cell (``codes``) and the codebooks beside the cells.  A codebook has at most 256 words."""
    cents, key = index.centroids, index.key

    def difference(batches):
        for pdf in batches:
            if len(pdf):
                own = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64)) - cents[pdf["cell"].to_numpy()]
                yield pd.DataFrame({key: pdf[key], "cell": pdf["cell"], "rest": list(own)})

    cells = spark.read.parquet(index.cells).select(key, "embedding", F.col("cell").cast("int").alias("cell"))
    kind = dict(cells.dtypes)[key]
    rest = written(cells.mapInPandas(difference, f"{key} {kind}, cell int, rest array<double>"), "ann-rest")
    dim, words = cents.shape[1], max(1, min(codewords, 256, rest.count()))
    books = []
    for a, b in _cuts(dim, subspaces):
        part = rest.select(array_to_vector(F.slice("rest", a + 1, b - a)).alias("features"))
        books.append(np.array(KMeans(k=words, seed=seed, maxIter=max_iter).fit(part).clusterCenters()))

    def coded(batches):
        for pdf in batches:
            if len(pdf):
                own = np.stack(pdf["rest"].to_numpy())
                code = np.stack([_nearest(own[:, a:b], book) for (a, b), book in zip(_cuts(dim, subspaces), books, strict=True)], axis=1)
                yield pd.DataFrame({key: pdf[key], "cell": pdf["cell"], "code": [c.tobytes() for c in code]})

    codes = rest.mapInPandas(coded, f"{key} {kind}, cell int, code binary")
    codes.write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/codes")
    rows = [(i, j, [float(x) for x in w]) for i, book in enumerate(books) for j, w in enumerate(book)]
    spark.createDataFrame(rows, "subspace int, word int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/codebooks")


def _nearest(own: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The word of a codebook that is nearest to each row."""
    out = np.empty(len(own), np.uint8)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096]
        out[at : at + 4096] = ((book * book).sum(1)[None, :] - 2 * part @ book.T).argmin(1)
    return out


def _codebooks(spark: SparkSession, path: str) -> list[np.ndarray]:
    rows = spark.read.parquet(f"{path}/codebooks").orderBy("subspace", "word").collect()
    return [np.array([r.value for r in rows if r.subspace == s]) for s in range(rows[-1].subspace + 1)]


def _best(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query: first within parts of its rows, then of what these leave."""
    order = [F.desc(score), F.col(key)]
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(*order)
    some = rows.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r")
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_r") <= k)


def _probes(cents: np.ndarray, nprobe: int):
    """A row (query_id, cell, vector) for each of a query's nearest cells, ``QUERY_BLOCK`` queries at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                pdf = batch[at : at + QUERY_BLOCK]
                q = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
                cells = np.argsort(-(q @ cents.T), axis=1, kind="stable")[:, :nprobe]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), cells.shape[1]), "cell": cells.reshape(-1), "vector": list(np.repeat(q, cells.shape[1], axis=0))})

    return run


def search_many(spark: SparkSession, index: AnnIndex, queries: DataFrame, k: int = 20, nprobe: int = 12, rerank: int = 20) -> DataFrame:
    """K8 for a table of queries (query_id, embedding): query_id, rank, key, similarity of the ``k`` nearest
    among the ``nprobe`` nearest cells of each.

    Codes give an estimate, the ``rerank * k`` best of which are scored exactly.  A cell's codes, a third of the
    table or not, are dealt into blocks of about ``CODE_BLOCK`` and its queries into blocks of ``QUERY_BLOCK``; a
    task scores one pair of blocks and keeps the best of each query.  Queries without a vector have no
    rows; equal scores rank by key.
    """
    cents, books, key = index.centroids, _codebooks(spark, index.path), index.key
    cuts, keep = _cuts(cents.shape[1], len(books)), rerank * k

    asked = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    asked = written(asked.mapInPandas(_probes(cents, nprobe), "query_id long, cell int, vector array<double>"), "ann-probes")
    codes = spark.read.parquet(f"{index.path}/codes").withColumn("cell", F.col("cell").cast("int"))
    kind = dict(codes.dtypes)[key]
    # blocks of each cell: two small tables of counts
    sizes = codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    sizes = written(sizes.select("cell", F.expr(f"(n + {CODE_BLOCK - 1}) div {CODE_BLOCK}").alias("parts"), F.expr(f"(m + {QUERY_BLOCK - 1}) div {QUERY_BLOCK}").alias("qparts")), "ann-blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = codes.join(sizes, "cell").select("cell", key, "code", F.pmod(F.xxhash64(key), F.col("parts")).alias("part"), every("qparts").alias("qpart"))
    right = asked.join(sizes, "cell").select("cell", "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.col("qparts")).alias("qpart"), every("parts").alias("part"))

    def scored(block, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asks):
            return pd.DataFrame({"query_id": [], key: [], "estimate": []})
        code = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), len(books))
        ids, out = own[key].to_numpy(), []
        for qid, q in zip(asks["query_id"], asks["vector"], strict=True):
            tables = [book @ q[a:b] for (a, b), book in zip(cuts, books, strict=True)]
            estimate = float(cents[int(block[0])] @ q) + sum(t[code[:, j]] for j, t in enumerate(tables))
            top = np.argpartition(-estimate, keep - 1)[:keep] if len(estimate) > keep else np.arange(len(estimate))
            out.append(pd.DataFrame({"query_id": qid, key: ids[top], "estimate": estimate[top]}))
        return pd.concat(out)

    by = ["cell", "part", "qpart"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(scored, f"query_id long, {key} {kind}, estimate double")
    found = _best(found, "estimate", key, keep).select("query_id", key)

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.stack(v.to_numpy()).astype(np.float64) for v in (a, b))
        return pd.Series(np.round((_unit(x) * _unit(y)).sum(1), 9))

    vectors = spark.read.parquet(index.cells).select(key, "embedding")
    pairs = found.join(vectors, key).join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    best = _best(pairs.select("query_id", key, exact("embedding", "asked").alias("similarity")), "similarity", key, k)
    return best.select("query_id", F.col("_r").cast("long").alias("rank"), key, F.round("similarity", 6).alias("similarity"))


def recall_many(approx: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: queries, and the share of the exact rows (query_id, key) that the approximate search has."""
    both = exact.select("query_id", key).join(approx.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))
