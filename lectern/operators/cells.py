"""A vector index: cells around centres, kept as a table in partitions, with exact bounds.

Centres are trained on a bounded sample; every vector is then assigned to its nearest centre and written to that cell's partition, with its distance to the centre.
Vectors are taken at unit length, so the distance d of two has the cosine 1 - d^2 / 2, and the triangle holds: no vector of a
cell is nearer to a query than the query's distance to the centre less the cell's radius.

A search scores each query's nearest cells, so many as held 0.95 of the sample's own neighbours when the index was made. That is approximate; of every answer it is known whether it is proved, namely if no
other cell can hold a nearer vector than the k-th found. With ``exact`` the cells that can are scored, too, and all answers are proved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import stored_copy, stored_path

#: Rows that centres are trained on at most, the cells of an index at most, and rounds of training.
SAMPLE, MOST_CELLS, ROUNDS = 50_000, 4096, 8
#: Vectors of a cell that a task scores at a time, and queries that it meets them with.
SLICE, QUERY_SLICE = 50_000, 16_384
#: What share of the sample's own nearest neighbours must lie in the cells that a search scores at first, out of how many, for how many of its rows.
RECALL, NEIGHBOURS, TRIED = 0.95, 30, 200


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` unit centres of unit vectors, by spherical k-means from evenly spread rows; a cell that runs empty takes the worst placed row."""
    made = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        likeness = sample @ made.T
        own = likeness.argmax(axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        sums[empty] = sample[np.argsort(likeness.max(axis=1))[: len(empty)]]
        made = _unit(sums)
    return made


def probed_share(sample: np.ndarray, made: np.ndarray) -> float:
    """The share of the cells, nearest first, that hold RECALL of the nearest neighbours within the sample."""
    own, few = (sample @ made.T).argmax(axis=1), sample[:TRIED]
    near = np.argsort(-(few @ sample.T), axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
    rank = np.argsort(np.argsort(-(few @ made.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(rank, own[near], axis=1) + 1
    return float(np.quantile(needed, RECALL, method="higher")) / len(made) if needed.size else 1.0


def _vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch (id, embedding) that have a vector of ``size`` other than zero, and these at unit length."""
    column = batch.column(1)
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size))
    x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), size) if len(good) else np.zeros((0, size))
    return good, _unit(x)


def create(chunks: DataFrame, size: int, path: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> str:
    """Index the vectors of ``size`` of (chunk_id, embedding) in a new folder; returns the folder. Other vectors and nulls are left out.

    ``cells`` is the square root of the rows if not given. The sample are the rows of least hash.
    """
    spark = chunks.sparkSession
    path = path or stored_path(spark, "cells")
    rows = chunks.select("chunk_id", "embedding").filter(F.size("embedding") == size)
    n = rows.count()
    few = rows.withColumn("_h", F.xxhash64("chunk_id")).orderBy("_h", "chunk_id").limit(sample).select("embedding").toPandas()
    wanted = max(1, min(cells or round(n**0.5), MOST_CELLS, len(few)))
    x = _unit(np.array(few.embedding.tolist(), float)) if len(few) else np.zeros((0, size))
    made = centres(x, wanted) if len(few) else np.zeros((1, size))
    share = probed_share(x, made) if len(few) else 1.0
    spark.createDataFrame([(i, c.tolist(), share) for i, c in enumerate(made)], _CENTRES).coalesce(1).write.parquet(f"{path}/centres")
    append(rows, path)
    return path


_CENTRES = "cell int, centre array<double>, probed double"


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, float]:
    """The centres, MOST_CELLS at most, and the share of cells that a search scores at first."""
    rows = spark.read.schema(_CENTRES).parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r.centre for r in rows]), rows[0].probed


def append(chunks: DataFrame, path: str) -> None:
    """Assign further vectors to the centres that there are."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(_centres(spark, path)[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            good, x = _vectors(batch, made.shape[1])
            for at in range(0, len(good), 4096):
                likeness = x[at : at + 4096] @ made.T
                cell = likeness.argmax(axis=1)
                # measured, not from the cosine, which would lose half the digits of small distances
                away = np.linalg.norm(x[at : at + 4096] - made[cell], axis=1)
                some = pa.array(good[at : at + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some).cast(pa.list_(pa.float64())), pa.array(away), pa.array(cell.astype(np.int32))], ["chunk_id", "embedding", "away", "cell"])

    placed = chunks.select("chunk_id", "embedding").mapInArrow(assign, "chunk_id long, embedding array<double>, away double, cell int")
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def search(queries: DataFrame, path: str, k: int, exact: bool = False, probed: float | None = None, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, proved) of the best ``k`` of each of (query_id, embedding); ties go by id."""
    spark = queries.sparkSession
    table = spark.read.schema("chunk_id long, embedding array<double>, away double, cell int").parquet(f"{path}/vectors")
    made, measured = _centres(spark, path)
    held = table.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()  # a row for each cell
    cells, radius = held.cell.to_numpy(np.int64), held.radius.to_numpy(float)
    first = max(1, round((probed or measured) * len(cells)))
    sent = spark.sparkContext.broadcast((cells, radius, made[cells] if len(cells) else made[:0]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every cell of every query with its bound, and whether it is among the nearest."""
        cells, radius, made = sent.value
        for batch in batches:
            good, x = _vectors(batch, made.shape[1])
            for at in range(0, len(good), max(1, (1 << 20) // max(1, len(cells)))):
                own = x[at : at + max(1, (1 << 20) // max(1, len(cells)))]
                away = np.sqrt(np.maximum(2 - 2 * own @ made.T, 0))
                order = np.argsort(away, axis=1, kind="stable")
                rank = np.argsort(order, axis=1)
                ids = batch.column(0).take(pa.array(np.repeat(good[at : at + len(own)], len(cells))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(cells, len(own)).astype(np.int32)), pa.array(np.maximum(away - radius - 1e-7, 0).reshape(-1)), pa.array((rank < first).reshape(-1))], ["query_id", "cell", "bound", "first"])

    asked = queries.select("query_id", "embedding").filter("embedding is not null")
    bounds = stored_copy(asked.mapInArrow(near, "query_id long, cell int, bound double, first boolean"), "bounds")
    slices = {int(c): -(-int(n) // SLICE) for c, n in zip(held.cell, held.n, strict=True)}
    found = stored_copy(_scored(bounds.filter("first"), asked, table, slices, k, digits), "near")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    best = lambda rows: rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    # scores are rounded: the k-th may stand for one lower by half a digit
    least = best(found).filter(F.col("_n") == k).select("query_id", (F.col("score") - 10**-digits).alias("least"))
    other = bounds.filter("not first").join(least, "query_id", "left").filter(F.col("least").isNull() | (1 - F.col("bound") * F.col("bound") / 2 >= F.col("least")))
    if exact:
        found = found.unionByName(_scored(other, asked, table, slices, k, digits))
        return best(found).select("query_id", "chunk_id", "score", F.lit(True).alias("proved"))
    open_ones = other.select(F.col("query_id").alias("_o")).distinct()
    return best(found).join(open_ones, F.col("query_id") == F.col("_o"), "left").select("query_id", "chunk_id", "score", F.col("_o").isNull().alias("proved"))


def _scored(pairs: DataFrame, asked: DataFrame, table: DataFrame, slices: dict[int, int], k: int, digits: int) -> DataFrame:
    """The best ``k`` of each slice of a cell for each (query_id, cell) of ``pairs``. Only the partitions of these cells are read."""
    wanted = [r.cell for r in pairs.select("cell").distinct().collect()]  # no more than MOST_CELLS
    many = F.element_at(F.create_map(*[F.lit(x) for c in wanted for x in (c, slices[c])]), F.col("cell")) if wanted else F.lit(1)
    q_slice = F.pmod(F.xxhash64("query_id"), F.lit(-(-max(asked.count(), 1) // QUERY_SLICE))).cast("int")
    n_q = -(-max(asked.count(), 1) // QUERY_SLICE)
    vectors = table.filter(F.col("cell").isin(wanted)).select("cell", F.pmod(F.xxhash64("chunk_id"), many).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), "chunk_id", "embedding")
    sent = pairs.select("query_id", "cell").join(asked, "query_id").select("cell", F.explode(F.sequence(F.lit(0), many - 1)).alias("slice"), q_slice.alias("q"), "query_id", "embedding")

    def score(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and wanted.num_rows:
            size = len(own["embedding"][0])
            x = _unit(own["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, size))
            ids = own["chunk_id"].to_numpy()
            x, ids = x[np.argsort(ids, kind="stable")], np.sort(ids)
            names = wanted["query_id"].to_numpy()
            y = _unit(wanted["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), size))
            for at in range(0, len(names), 256):
                s = np.round(y[at : at + 256] @ x.T, digits)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out.append((np.repeat(names[at : at + 256], top.shape[1]), ids[top].reshape(-1), np.take_along_axis(s, top, 1).reshape(-1)))
        parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float))]
        return pa.Table.from_arrays([pa.array(p) for p in parts], ["query_id", "chunk_id", "score"])

    key = ["cell", "slice", "q"]
    return vectors.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(score, "query_id long, chunk_id long, score double")
