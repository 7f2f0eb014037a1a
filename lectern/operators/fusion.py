"""Fusion and ranking of two channels' candidates, for many queries at once.

A channel has (query_id, chunk_id, rank, score); rank or score may be null. Results carry keyword_rank,
vector_rank, keyword_score, vector_score, fused_score and fused_rank, by query.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranges import stored

RRF_K = 60
TIED = 1e-12


def finite(score: str | Column) -> Column:
    """The score, or null where it is missing, infinite or not a number."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def best_per_chunk(channel: DataFrame) -> DataFrame:
    """One row a chunk: least rank, then greatest score."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.col("rank").asc_nulls_last(), finite("score").desc_nulls_last())
    return channel.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def both(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """The union of the channels' chunks, a full outer join."""
    k = best_per_chunk(keyword).select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"), finite("score").alias("keyword_score"))
    v = best_per_chunk(vector).select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), finite("score").alias("vector_score"))
    return k.join(v, ["query_id", "chunk_id"], "full_outer")


def ranked(fused: DataFrame) -> DataFrame:
    """fused_rank by score, best rank, keyword rank, vector rank and id."""
    least = F.least("keyword_rank", "vector_rank")
    order = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), least.asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "chunk_id")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def rrf(keyword: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return ranked(both(keyword, vector).withColumn("fused_score", F.round(part("keyword_rank") + part("vector_rank"), 12)))


def normalised(channel: DataFrame) -> DataFrame:
    """``unit``: scores from 0 to 1 by query; missing ones 0, all 1 where they are tied."""
    w = Window.partitionBy("query_id")
    s = finite("score")
    low, high = F.min(s).over(w), F.max(s).over(w)
    return channel.withColumn("unit", F.when(s.isNull(), 0.0).when(high - low <= TIED, 1.0).otherwise((s - low) / (high - low)))


def weighted(keyword: DataFrame, vector: DataFrame, keyword_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Weighted sum of normalised scores; a channel without any scores counts by 1/rank."""
    total = keyword_weight + vector_weight
    if total <= 0 or min(keyword_weight, vector_weight) < 0:
        raise ValueError("weights must not be negative, nor all zero")

    def unit(channel: DataFrame, name: str) -> DataFrame:
        one = normalised(best_per_chunk(channel))
        scored = F.max(finite("score").isNotNull()).over(Window.partitionBy("query_id"))
        return one.select("query_id", "chunk_id", F.when(scored, F.col("unit")).otherwise(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias(name))

    joined = both(keyword, vector).join(unit(keyword, "_k"), ["query_id", "chunk_id"], "left").join(unit(vector, "_v"), ["query_id", "chunk_id"], "left")
    score = F.coalesce("_k", F.lit(0.0)) * (keyword_weight / total) + F.coalesce("_v", F.lit(0.0)) * (vector_weight / total)
    return ranked(joined.withColumn("fused_score", F.round(score, 9)).drop("_k", "_v"))


def single(channel: DataFrame, name: str = "keyword") -> DataFrame:
    """One channel alone: by rank, score and id; fused score is the score, or 1/rank."""
    one = best_per_chunk(channel)
    order = Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), finite("score").desc_nulls_last(), "chunk_id")
    other = "vector" if name == "keyword" else "keyword"
    empty = {f"{other}_rank": F.lit(None).cast("int"), f"{other}_score": F.lit(None).cast("double")}
    own = {f"{name}_rank": F.col("rank"), f"{name}_score": finite("score")}
    score = F.coalesce(finite("score"), F.lit(1.0) / F.col("rank"), F.lit(0.0))
    return one.withColumns(own | empty | {"fused_score": score, "fused_rank": F.row_number().over(order)}).drop("rank", "score")


def fuse(keyword: DataFrame, vector: DataFrame, mode: str = "hybrid", method: str = "rrf", **more: float) -> DataFrame:
    """Dispatch: hybrid by rrf or weights, or one channel alone."""
    if mode == "keyword":
        return single(keyword, "keyword")
    if mode == "vector":
        return single(vector, "vector")
    if mode != "hybrid" or method not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {mode}/{method}")
    return rrf(keyword, vector, **more) if method == "rrf" else weighted(keyword, vector, **more)


def reranked(fused: DataFrame, score: Column, top_n: int = 8, threshold: float | None = None) -> DataFrame:
    """rerank_rank by score, fused rank and id; below ``threshold`` goes, after ranking and before the cut.

    A query any of whose scores is missing or not finite keeps its fused order, with null rerank fields.
    """
    w = Window.partitionBy("query_id")
    rows = fused.withColumn("rerank_score", finite(score))
    good = F.min(F.col("rerank_score").isNotNull()).over(w)
    last = F.coalesce(F.col("fused_rank"), F.lit(1_000_000_000))
    rows = rows.withColumn("_good", good)
    by_score = F.row_number().over(w.orderBy(F.when(F.col("_good"), F.col("rerank_score")).desc_nulls_last(), last, "chunk_id"))
    rows = rows.withColumn("position", by_score).withColumn("rerank_rank", F.when(F.col("_good"), F.col("position"))).withColumn("rerank_score", F.when(F.col("_good"), F.col("rerank_score")))
    if threshold is not None:
        rows = rows.filter(~F.col("_good") | (F.col("rerank_score") >= threshold))
        rows = rows.withColumn("position", F.row_number().over(w.orderBy("position")))
    return rows.filter(F.col("position") <= top_n).drop("_good")


def presented(rows: DataFrame) -> DataFrame:
    """``position`` by rerank, fused, then keyword or vector rank, and id."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_rank").asc_nulls_last(), F.col("fused_rank").asc_nulls_last(), F.coalesce("keyword_rank", "vector_rank").asc_nulls_last(), "chunk_id")
    return rows.withColumn("position", F.row_number().over(order))


def hybrid(keyword: Callable[[], DataFrame], vector: Callable[[], DataFrame], mode: str = "hybrid", method: str = "rrf", limit: int = 30) -> DataFrame:
    """Both channels side by side, fused, the best ``limit`` of each query; a channel that fails is left out, and only if all fail that is an error.

    A channel returns (query_id, chunk_id, score, rank); it is stored, for a failure shows only when it runs.
    """
    wanted = {"keyword": keyword, "vector": vector}
    wanted = wanted if mode == "hybrid" else {mode: wanted[mode]}
    with ThreadPoolExecutor(len(wanted)) as pool:
        running = {name: pool.submit(lambda make=make, name=name: stored(make(), name)) for name, make in wanted.items()}
    failed = {name: r.exception() for name, r in running.items() if r.exception()}
    if len(failed) == len(wanted):
        raise RuntimeError("every channel failed") from next(iter(failed.values()))
    good = {name: r.result() for name, r in running.items() if name not in failed}
    none = next(iter(good.values())).limit(0)
    # with one channel left, fusion ranks by that one alone
    left = next(iter(good)) if len(good) == 1 else "hybrid"
    return fuse(good.get("keyword", none), good.get("vector", none), mode=left, method=method).filter(F.col("fused_rank") <= limit)
