"""Similarity search: exact top-k, hybrid text and vector ranking, clustered and quantised indexes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tensor as T
from ..functions import text as X


#: Candidates for each row asked for, times ``rerank``; tests measure the recall of every preset with it.
WIDEN = 64


@dataclass(frozen=True)
class SearchConfig:
    """How widely an index is searched: clusters probed by ``accuracy`` and rows re-ranked, ``k`` times ``rerank``."""

    clusters: int = 10
    rerank: float = 1.0

    @classmethod
    def default(cls) -> SearchConfig:
        return cls(10, 1.0)

    @classmethod
    def high(cls) -> SearchConfig:
        return cls(20, 8.0)

    @classmethod
    def balanced(cls) -> SearchConfig:
        return cls(5, 2.0)

    @classmethod
    def fast(cls) -> SearchConfig:
        return cls(1, 0.5)


def top_k(df: DataFrame, score: Column, k: int, key: str, ascending: bool = False, wide: Sequence[str] = ()) -> DataFrame:
    """The k best rows by ``score``, ties by key.  ``wide`` columns are fetched by key for the k rows alone."""
    narrow = df.drop(*wide) if wide else df
    order = F.asc_nulls_last("score") if ascending else F.desc_nulls_last("score")
    best = narrow.withColumn("score", score).orderBy(order, key).limit(k)
    if not wide:
        return best
    return df.select(key, *wide).join(F.broadcast(best), key)  # k rows


def cosine_top_k(df: DataFrame, column: str, query: Sequence[float], k: int, key: str) -> DataFrame:
    return top_k(df, T.cosine_to(F.col(column), query), k, key).select(key, "score")


def maxsim_top_k(df: DataFrame, column: str, query: Sequence[Sequence[float]], k: int, key: str) -> DataFrame:
    return top_k(df, T.maxsim_batch(query)(F.col(column)), k, key).select(key, "score")


def bm25_top_k(df: DataFrame, column: str, query: str, k: int, key: str) -> DataFrame:
    return X.bm25(df, column, key, query).orderBy(F.desc("score"), key).limit(k)


def softmax(scored: DataFrame, weight: float, name: str) -> DataFrame:
    """Weights of k scored rows: exponentials of scores, held at 700, over their sum."""
    e = F.exp(F.least("score", F.lit(700.0)))
    total = scored.agg(F.sum(e).alias("__t"))
    return scored.join(F.broadcast(total)).select(scored.columns[0], (weight * e / F.col("__t")).alias(name))  # one row


def hybrid(vectors: DataFrame, texts: DataFrame, k: int | None, key: str, w_vector: float = 0.5, w_text: float = 0.5) -> DataFrame:
    """Merges two top-k tables (key, score): each side's softmax over its own rows, weighted and added."""
    both = softmax(vectors, w_vector, "__v").join(softmax(texts, w_text, "__x"), key, "full")
    both = both.select(key, (F.coalesce("__v", F.lit(0.0)) + F.coalesce("__x", F.lit(0.0))).alias("score"))
    return both if k is None else both.orderBy(F.desc("score"), key).limit(k)


def hybrid_search(df: DataFrame, vector: str, text: str, key: str, q_vector: Sequence, q_text: str, k: int, w_vector: float = 0.5, w_text: float = 0.5) -> DataFrame:
    """Cosine (or MAXSIM for a query of rows) and BM25, k of each side."""
    find = maxsim_top_k if isinstance(q_vector[0], (list, tuple)) else cosine_top_k
    return hybrid(find(df, vector, q_vector, k, key), bm25_top_k(df, text, q_text, k, key), k, key, w_vector, w_text)


def _nearest(unit: Column, centres: list[list[float]]) -> Column:
    """The numbers of the two nearest centres, one matrix product for each Arrow batch."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    m = np.array(centres)
    half = (m * m).sum(1) / 2

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = b.flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[1])
            order = np.argsort(half - x @ m.T, axis=1, kind="stable")[:, :2].astype(np.int32)
            yield pa.array(list(order), pa.list_(pa.int32()))

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(find, "array<int>")(unit)


class ClusteredIndex:
    """k-means clusters of unit vectors as a table partitioned by cluster; searches read the nearest clusters only.

    The centres are fitted on at most ``fit_rows`` rows; every row is indexed, under its two nearest centres, and a
    search reads a row's second place only where its first is not read.  With ``quantised`` the signs of the
    vectors choose k * rerank * WIDEN rows of the probed clusters, which are then ranked exactly.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, column: str, centres: list[list[float]], size: int, quantised: bool):
        self.spark, self.path, self.key, self.column, self.centres, self.size, self.quantised = spark, path, key, column, centres, size, quantised

    @classmethod
    def build(cls, df: DataFrame, key: str, column: str, path: str, clusters: int = 16, fit_rows: int = 100_000, quantised: bool = False, seed: int = 1) -> ClusteredIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        unit = F.transform(column, lambda v: v.cast("double") / T.l2_norm(F.col(column)))
        rows = df.filter(T.l2_norm(F.col(column)) > 0).select(key, column, unit.alias("__u"))
        sample = rows.orderBy(F.xxhash64(key)).limit(fit_rows).select(array_to_vector("__u").alias("features"))
        model = KMeans(k=clusters, seed=seed, maxIter=20).fit(sample)
        centres = [list(map(float, c)) for c in model.clusterCenters()]
        places = rows.select(key, column, _nearest(F.col("__u"), centres).alias("__c"))
        assigned = places.select(key, column, F.inline(F.array(*(F.struct(F.get("__c", i).alias("cluster"), (F.lit(-1) if i == 0 else F.get("__c", 0)).alias("__first")) for i in range(min(2, len(centres)))))))
        if quantised:
            assigned = assigned.withColumn("__bits", T.sign_bits(F.col(column), len(centres[0])))
        # a cluster is many files when it is large: rows are dealt by cluster and key
        assigned.repartition("cluster", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("cluster").mode("overwrite").parquet(path)
        return cls(df.sparkSession, path, key, column, centres, len(centres[0]), quantised)

    def search(self, query: Sequence[float], k: int, config: SearchConfig | None = None, exact: bool = False) -> DataFrame:
        """The k nearest rows of the probed clusters; of a quantised index those among the candidates.  With ``exact``
        the search goes past the candidates, to every row whose signs allow a score as high as the k-th of theirs."""
        config = config or SearchConfig.default()
        norm = sum(v * v for v in query) ** 0.5
        near = sorted(range(len(self.centres)), key=lambda i: sum((a / norm - b) ** 2 for a, b in zip(query, self.centres[i])))
        probed = near[: config.clusters]
        rows = self.spark.read.parquet(self.path).filter(F.col("cluster").isin(probed))  # prunes partitions
        rows = rows.filter(~F.col("__first").isin(probed)).drop("__first")
        if self.quantised:
            apart = T.bits_apart(F.col("__bits"), T.sign_bits(T.vector(query), self.size))
            near = rows.withColumn("__d", apart).orderBy("__d", self.key).limit(max(k, int(k * config.rerank * WIDEN)))
            if exact:
                # where signs differ, products are 0 at most: the rest of the query's length bounds the cosine
                found = cosine_top_k(near, self.column, query, k, self.key)
                least = found.agg(F.when(F.count("score") >= k, F.min("score")).alias("__least"))
                same = F.aggregate(F.zip_with(F.col(self.column), T.vector(query), lambda v, q: F.when((v > 0) == (q > 0), q.cast("double") * q).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
                near = rows.join(F.broadcast(least)).filter(F.col("__least").isNull() | (F.sqrt(same) / norm + 1e-6 >= F.col("__least")))  # one row
            rows = near
        return cosine_top_k(rows, self.column, query, k, self.key)


def pooled_top_k(df: DataFrame, column: str, query: Sequence[Sequence[float]], k: int, key: str, config: SearchConfig | None = None, exact: bool = False) -> DataFrame:
    """Matrices: mean rows choose k * rerank * WIDEN candidates by cosine, MAXSIM ranks those.  Mean rows bound no MAXSIM, so
    with ``exact`` every row is ranked."""
    if exact:
        return maxsim_top_k(df, column, query, k, key)
    config = config or SearchConfig.default()
    pooled = [sum(r[j] for r in query) / len(query) for j in range(len(query[0]))]
    near = top_k(df, T.cosine_const(T.mean_rows(F.col(column)), pooled), max(k, int(k * config.rerank * WIDEN)), key).drop("score")
    return maxsim_top_k(near, column, query, k, key)


def top_k_per(df: DataFrame, group: str, score: Column, k: int, key: str) -> DataFrame:
    """Each group's k best rows; rank limits are pushed below the shuffle by Spark's window group limit."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
