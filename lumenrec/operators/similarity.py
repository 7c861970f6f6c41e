"""Similar items: vectors against a set of query vectors, in blocks; the best of each query.

Queries come to the workers in blocks of at most BLOCK vectors, each block a pass
over all vectors, multiplied in batches. For top-k a worker keeps the k best of
each query, so k rows for each query and task are shuffled, never all pairs.

Odd input: rows without a vector are compared with nothing; a zero vector is at
cosine 0 to all; ties go to the smaller key; equal rows are items of their own; an
empty table on either side gives an empty result; other columns are ignored, or
kept where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
#: Digits that count in a ranking: products may differ in the last bits.
DIGITS = 12


def similarities(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Query x vector; cosine with 0 for zero vectors, or the negated Euclidean distance."""
    if metric == "cosine":
        product = queries @ vectors.T
        norms = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((vectors**2).sum(axis=1))[None, :]
        out = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    elif metric == "euclidean":
        out = -np.stack([np.sqrt(((vectors - q) ** 2).sum(axis=1)) for q in queries])
    else:
        raise ValueError(f"unknown metric {metric}")
    return np.round(out, DIGITS)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, block = [], []
    for row in queries.filter(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        ids.append(row[0])
        block.append(row[1])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(block, np.float64)
            ids, block = [], []
    if ids:
        yield np.array(ids), np.array(block, np.float64)


def _against(items: DataFrame, queries: DataFrame, key: str, vector: str, metric: str, k: int | None) -> DataFrame:
    spark = items.sparkSession
    out = None
    for block in _blocks(queries, key, vector):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_m, best_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                if not len(batch):
                    continue
                m = np.broadcast_to(batch[key].to_numpy(np.int64), (len(ids), len(batch)))
                s = similarities(q, _stack(batch[vector]), metric)
                if k is None:
                    yield pd.DataFrame({"q": np.repeat(ids, len(batch)), "m": m.ravel(), "sim": s.ravel()})
                    continue
                m, s = np.concatenate([best_m, m], axis=1), np.concatenate([best_s, s], axis=1)
                order = np.lexsort((m, -s), axis=1)[:, :k]
                best_m, best_s = np.take_along_axis(m, order, 1), np.take_along_axis(s, order, 1)
            if best_m.size:
                yield pd.DataFrame({"q": np.repeat(ids, best_m.shape[1]), "m": best_m.ravel(), "sim": best_s.ravel()})

        part = items.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, "q long, m long, sim double")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "q long, m long, sim double") if out is None else out


def similarity_rows(items: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """q, m, sim: the rows of the similarity matrix that belong to the queries."""
    return _against(items, queries, key, vector, metric, None)


def neighbours(items: DataFrame, queries: DataFrame, first: int = 2, last: int = 100, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """q, m, sim, rank: ranks first to last of each query's most similar items, ties by ascending m.

    Rank 1 is left out by position, as it usually is the item itself; with
    exclude_self the item itself is left out instead, wherever it stands.
    """
    pairs = _against(items, queries, key, vector, metric, last + exclude_self)
    if exclude_self:
        pairs, first, last = pairs.filter("q <> m"), 1, last - first + 1
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "m")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank").between(first, last))


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to one vector as a built-in expression; 0 for a zero vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = F.array(*(F.lit(float(x)) for x in query))
    norms = F.sqrt(dot(vector, vector)) * F.sqrt(dot(q, q))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(vector, q) / norms)


def recommend(catalogue: DataFrame, queries: DataFrame, n: int = 5, exclude_self: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """q, pos, vec_id, title, score, year and the extra columns: of ranks 2 to 100 the items of the query's cluster, by score and year.

    The cluster filter stands above the rank cut, so fewer than n may be left.
    catalogue: vec_id, embedding, cluster, title, score, year.
    """
    near = neighbours(catalogue, queries, exclude_self=exclude_self)
    own = queries.select(F.col("vec_id").alias("q"), F.col("cluster").alias("q_cluster"))
    found = near.join(catalogue.drop("embedding"), F.col("m") == F.col("vec_id")).join(own, "q").filter("cluster = q_cluster")
    order = Window.partitionBy("q").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("year"), "rank")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n).select("q", F.col("pos").cast("int").alias("pos"), "vec_id", "title", "score", "year", *extra)


def recommend_by_title(catalogue: DataFrame, title: str, n: int = 5) -> DataFrame:
    """Recommendations for the first item of a title; an unknown title is an error."""
    query = catalogue.filter(F.col("title") == title).orderBy("vec_id").limit(1)
    if query.first() is None:
        raise KeyError(f"no item is called {title}")
    return recommend(catalogue, query, n)


# The reply for a recommendation.
REPLY = "%d. %s\nScore: %s\nYear: %s\nType: %s\nEpisodes: %s\nDescription:\n%s\n"


def replies(recommended: DataFrame) -> DataFrame:
    """What a chat user sees for each recommendation, in `line`; recommended has the extra columns type, episodes and synopsis.

    Episodes are shown as a whole number, its fraction cut off; what is missing is a question mark.
    """
    whole = {"year": F.col("year").cast("int"), "episodes": F.col("episodes").cast("int")}
    shown = [F.coalesce(whole.get(c, F.col(c)).cast("string"), F.lit("?")) for c in ("title", "score", "year", "type", "episodes", "synopsis")]
    return recommended.withColumn("line", F.format_string(REPLY, "pos", *shown))


def clusters(df: DataFrame, vector: str, k: int = 20, seed: int = 22) -> DataFrame:
    """df with `cluster`, 0 to k - 1, by k-means on an array column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("__features")
