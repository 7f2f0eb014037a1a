"""Ports for models, and the deterministic providers that stand in for them offline."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Credentials in messages. Fixed values.
SECRETS = ((r"(?i)((?:authorization|api[-_ ]?key|token)\s*[:=]\s*(?:bearer\s+)?)\S+", r"\1[REDACTED]"), (r"(https?://)[^/\s:@]+:[^/\s@]+@", r"\1[REDACTED]@"))


def hash_vector(text: str, dimension: int) -> np.ndarray:
    """A unit vector of the text's numbered SHA-256 digests, bytes mapped to -1..1."""
    blocks = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-dimension // 32)))
    v = np.frombuffer(blocks, np.uint8)[:dimension] / 127.5 - 1
    return v / (np.linalg.norm(v) or 1.0)


def embed(rows: DataFrame, dimension: int, make: Callable[[list[str]], list[np.ndarray]] | None = None, text_col: str = "text", batch_rows: int = 32) -> DataFrame:
    """Adds ``embedding``; ``make`` is a provider of a batch's vectors, the hash vector if none. Wrong counts or dimensions are errors."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    names = rows.columns
    at = names.index(text_col)
    part_rows = batch_rows * max(1, 256 // batch_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make or (lambda texts: [hash_vector(t, dimension) for t in texts])
        for batch in batches:
            for at_row in range(0, batch.num_rows, part_rows):  # texts of few rows at a time are Python strings
                part = batch.slice(at_row, part_rows)
                made: list[np.ndarray] = []
                texts = [t or "" for t in part.column(at).to_pylist()]
                for lo in range(0, len(texts), batch_rows):
                    some = provider(texts[lo : lo + batch_rows])
                    if len(some) != len(texts[lo : lo + batch_rows]) or any(len(v) != dimension for v in some):
                        raise ValueError("the provider returned a wrong count or dimension")
                    made += some
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v.tolist() for v in made], pa.list_(pa.float32()))], [*names, "embedding"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("embedding", ArrayType(FloatType())))


def overlap_score(query: str, document: str) -> Column:
    """The offline reranker: similarity of word sets."""
    words = lambda c: F.array_distinct(T.all_matches(T.casefold(c), r"[\p{L}\p{N}_.-]+"))
    return F.round(T.jaccard(words(query), words(document)), 9)


def redacted(message: str, secrets: list[str], longest: int = 2000) -> str:
    """An error message without secrets, cut to length."""
    for secret in secrets:
        if secret:
            message = message.replace(secret, "[REDACTED]")
    for pattern, instead in SECRETS:
        message = re.sub(pattern, instead, message)
    return message[:longest]


def token_counts(rows: DataFrame, make: Callable[[], Callable[[str], int]] | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``tokens``. ``make`` makes a model's counter once in each Python worker; without one, joined words and symbols are counted in the JVM."""
    if make is None:
        return rows.withColumn("tokens", F.size(T.chunk_tokens(text_col)).cast("long"))
    from pyspark.sql.types import LongType, StructField, StructType

    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([counter(t or "") for t in batch.column(at).to_pylist()], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def tokenizer_file(path: str) -> Callable[[], Callable[[str], int]]:
    """A counter by a tokenizer's file, without special tokens."""

    def make() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        return lambda text: len(loaded.encode(text, add_special_tokens=False).ids)

    return make
