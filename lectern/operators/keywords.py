"""Keyword search: three arms, the best of which counts.

* *English*: the query's words, quoted phrases, ``or`` and leading minus signs, on stems without stop words.
* *Plain*: all words of the query as they are, at 0.75.
* *Trigrams*: the similarity of query and text as sets of trigrams from 0.3 on, at 0.25.

The first two come from a stored positional index (``postings``) or, without one, from a pass over the texts (``scan``), the third from a join of trigram sets (``grams``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import postings, scan, search

TRIGRAM = 0.25


def keyword_top_k(queries: DataFrame, chunks: DataFrame, k: int = 30, index: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of (query_id, text) among chunks: (chunk_id, text), and title, headings and context if there are such columns.

    Without a context the text is its own. ``index`` is the folder of an index of these chunks; without one their texts are searched.
    """
    k = search.checked_limit(k)
    asked = queries.select("query_id", "text").filter("text is not null")
    dense = postings.search(asked, index, k) if index else dense_in_texts(asked, chunks, k)
    alike = search.trigram_top_k(asked, chunks, k).select("query_id", "chunk_id", F.round(TRIGRAM * F.col("score"), 6).alias("score"))
    # a chunk among a query's best is among the best of its better arm
    both = dense.unionByName(alike).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return search.top_k(both, k)


def dense_in_texts(queries: DataFrame, chunks: DataFrame, k: int, words_only: bool = False, split: int = scan.SPLIT) -> DataFrame:
    """(query_id, chunk_id, score) by the density arms without an index: one pass over the texts for at most ``split`` queries; for more, chunks are indexed first."""
    asked = queries.select("query_id", "text").filter("text is not null")
    block = [(r[0], r[1]) for r in asked.limit(split + 1).collect()]
    if len(block) > split:
        return postings.search(asked, postings.create(chunks), k, words_only=words_only)
    return scan.search(block, chunks, k, words_only)


def density_top_k(queries: DataFrame, index: str, k: int = 30, among: DataFrame | None = None) -> DataFrame:
    """``keyword_top_k`` by the two density arms alone, from an index and without any text of a chunk."""
    return search.top_k(postings.search(queries, index, search.checked_limit(k), among), k)
