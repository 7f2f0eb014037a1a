"""Keyword, trigram and vector top-k for many queries at once, and the predicates that go with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import grams
from lectern.session import spread

LIMIT = 200
TRIGRAM_THRESHOLD = 0.3
#: Query vectors that go to the executors at a time.
QUERY_BLOCK = 4096
#: Query vectors, and chunks, whose scores are held at once; scores that may be among the best, before they are sorted.
TILE, PENDING = 512, 1 << 14


def checked_limit(k: int) -> int:
    if not 1 <= k <= LIMIT:
        raise ValueError(f"limit must be 1 to {LIMIT}")
    return k


def active(rows: DataFrame) -> DataFrame:
    """Chunk and document not deleted, document active, source enabled."""
    return rows.filter(F.col("chunk_deleted_at").isNull() & F.col("document_deleted_at").isNull() & (F.col("status") == "active") & F.col("source_enabled"))


def in_list(column: str, values: list) -> Column:
    """Membership; an empty list is no filter."""
    return F.col(column).isin(values) if values else F.lit(True)


def any_metadata(columns: list[str], keys: list[str], values: list[str]) -> Column:
    """Whether any of the keys has any of the values in any of the JSON columns; no values, no filter."""
    if not values:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        for k in keys:
            out = out | F.coalesce(F.get_json_object(c, f"$.{k}").isin(values), F.lit(False))
    return out


def version_matches(version: Column, metadata: str, wanted: list[str]) -> Column:
    """A version, or a version in the JSON metadata, that is one of the wanted ones with or without their v; none wanted, no filter."""
    if not wanted:
        return F.lit(True)
    either = T.version_variants(F.array(*[F.lit(w) for w in wanted]))
    held = [version, *[F.get_json_object(metadata, f"$.{k}") for k in ("version", "kubernetes_version")]]
    return F.coalesce(F.greatest(*[F.coalesce(F.array_contains(either, h), F.lit(False)) for h in held]), F.lit(False))


def contains_all(have: Column, want: list[str]) -> Column:
    """Containment of a list."""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in want]), have)) == 0


def metadata_contains(metadata: str, filters: dict) -> Column:
    """Whether a JSON column holds every filter's value: scalars by value (numbers as numbers), lists as lists that hold all of them.

    ``api_versions`` is matched against the list of that name, or, with one value, against ``api_version``.
    """
    data = F.try_parse_json(F.col(metadata))
    out = F.lit(True)
    for key, value in validated_filters(filters).items():
        at = f"$['{key}']" if key.isidentifier() else f'$["{key}"]'
        if isinstance(value, list):
            held = F.coalesce(F.from_json(F.get_json_object(F.col(metadata), at), "array<string>"), F.array().cast("array<string>"))
            one = contains_all(held, [str(v).lower() if isinstance(v, bool) else str(v) for v in value])
            if key == "api_versions" and len(value) == 1:
                one = one | F.coalesce(F.get_json_object(F.col(metadata), "$.api_version") == F.lit(str(value[0])), F.lit(False))
        elif value is None:
            one = F.is_variant_null(F.try_variant_get(data, at, "variant"))
        else:
            kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"
            types = {"boolean": ("BOOLEAN",), "string": ("STRING",), "double": ("BIGINT", "DOUBLE", "DECIMAL", "INT", "TINYINT", "SMALLINT")}[kind]
            said = F.schema_of_variant(F.try_variant_get(data, at, "variant"))
            one = F.try_variant_get(data, at, kind).eqNullSafe(F.lit(value).cast(kind)) & F.greatest(F.lit(False), *[F.coalesce(said.startswith(t), F.lit(False)) for t in types])
        out = out & F.coalesce(one, F.lit(False))
    return out


def text_like(columns: list[str], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return out


def merged_metadata(document: Column, chunk: Column) -> Column:
    """Two maps in one; the chunk's entries win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(document), lambda e: ~F.map_contains_key(chunk, e["key"])), F.map_entries(chunk)))


def validated_filters(filters: dict) -> dict:
    """Metadata filters: at most 20 keys, scalars or flat lists of at most 50, strings of at most 512 characters."""
    import json
    import math

    if len(filters) > 20 or len(json.dumps(filters, default=str).encode()) > 8192:
        raise ValueError("too many metadata filters")
    for value in filters.values():
        every = value if isinstance(value, list) else [value]
        if len(every) > 50:
            raise ValueError("too many values of a metadata filter")
        for v in every:
            if not isinstance(v, str | int | float | bool) and v is not None:
                raise ValueError("metadata filters take scalars or flat lists")
            if isinstance(v, float) and not math.isfinite(v) or isinstance(v, str) and len(v) > 512:
                raise ValueError("a metadata filter's value is out of bounds")
    return filters


def top_k(scored: DataFrame, k: int, score: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """Per-query ranks 1..k by score, ids breaking ties; the rank limit goes below the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= checked_limit(k))


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int = 30, digits: int = 6, model: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top-k of (query_id, embedding) among (chunk_id, embedding).

    Null embeddings and ones of another size than the query's are no candidates; nor, with ``model``, are other models' (column model).

    Queries go out in blocks of at most QUERY_BLOCK; a task multiplies its batches with a block, tile by tile, and keeps
    k for each query, so what is shuffled is k rows for each query and task, and what it holds is a tile of scores besides.
    """
    k = checked_limit(k)
    spark = chunks.sparkSession
    chunks = chunks.filter(F.col("model") == model) if model else chunks

    def against(block: list) -> DataFrame:
        names = np.array([r[0] for r in block])
        matrix = np.array([r[1] for r in block], float)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            best = [_Best(matrix[at : at + TILE], k, digits) for at in range(0, len(names), TILE)]
            for batch in batches:
                column = batch.column(1)
                good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == matrix.shape[1]))
                if not len(good):
                    continue
                x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[good]
                for some in best:
                    some.add(ids, x)
            for at, some in enumerate(best):
                query, chunk, score = some.found()
                yield pa.RecordBatch.from_arrays([pa.array(names[at * TILE + query]), pa.array(chunk), pa.array(score)], ["query_id", "chunk_id", "score"])

        return spread(chunks.select("chunk_id", "embedding"), "chunk_id").mapInArrow(run, "query_id long, chunk_id long, score double")

    return _top_of_blocks(queries.select("query_id", "embedding").filter("embedding is not null"), against, k, spark)


class _Best:
    """The ``k`` best chunks of each of some unit vectors so far: what can't pass the k-th score isn't looked at again."""

    def __init__(self, vectors: np.ndarray, k: int, digits: int):
        self.vectors, self.k, self.digits = vectors, k, digits
        self.least = np.full(len(vectors), -np.inf)
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            # few chunks at first, for all of them count then
            end = at + (TILE if np.isfinite(self.least).all() else 64)
            s = self.vectors @ x[at:end].T
            query, column = np.nonzero(~(s < self.least[:, None] - 10.0**-self.digits))
            if len(query):
                self.pending.append((query, ids[at:end][column], np.round(s[query, column], self.digits)))
                self.n += len(query)
            if self.n >= PENDING:
                self.found()
            at = end

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the vector, chunk, score), best first, ids breaking ties; not a number counts as the greatest, as in Spark."""
        query, chunk, score = (np.concatenate(c) for c in zip(self.held, *self.pending, strict=True))
        order = np.lexsort((chunk, -np.where(np.isnan(score), np.inf, score), query))
        query, chunk, score = query[order], chunk[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.vectors)))
        good = np.arange(len(query)) - first[query] < self.k
        self.held, self.pending, self.n = (query[good], chunk[good], score[good]), [], 0
        last = np.flatnonzero(np.arange(len(query)) - first[query] == self.k - 1)
        self.least[query[last]] = score[last]
        return self.held


def trigram_top_k(queries: DataFrame, chunks: DataFrame, k: int = 30, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """(query_id, chunk_id, score, rank): trigram set similarity of at least ``threshold``, by a join of the sets (``grams``)."""
    asked = queries.select("query_id", "text").filter("text is not null")
    return top_k(grams.similar(asked, chunks.select("chunk_id", "text"), threshold), checked_limit(k))


def _top_of_blocks(queries: DataFrame, against: Callable[[list], DataFrame], k: int, spark) -> DataFrame:
    """The top k of all blocks of at most QUERY_BLOCK queries; each is a broadcast and a pass of its own."""
    out, held = None, []
    for row in queries.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == QUERY_BLOCK:
            out = against(held) if out is None else out.unionByName(against(held))
            held = []
    if held:
        out = against(held) if out is None else out.unionByName(against(held))
    if out is None:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    return top_k(out, k)
