"""Joins of the document store: chunks, documents, sources, versions, runs and citations.

All are equi-joins on keys, so the planner picks the strategy; source tables are small enough for it to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a candidate carries to fusion and context.
CANDIDATE = ("chunk_id", "document_id", "chunk_index", "content", "heading_path", "start_offset", "end_offset", "title", "url", "document_type", "source_version", "source_id", "source_name", "metadata")


def chunks_with_sources(chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Every chunk with its document's and its source's columns, for both search channels."""
    return chunks.join(documents, "document_id").join(sources, "source_id")


def candidates(joined: DataFrame) -> DataFrame:
    """The CANDIDATE columns: metadata is the document's and the chunk's, the chunk's winning, and names of the source where neither has them."""
    own = F.col("chunk_metadata")
    less = lambda have, more: F.concat(F.filter(F.map_entries(more), lambda e: ~F.map_contains_key(have, e["key"])), F.map_entries(have))
    both = F.map_from_entries(less(own, F.col("document_metadata")))
    named = F.map_from_entries(less(both, F.create_map(F.lit("source_name"), F.col("source_name"), F.lit("source_type"), F.col("source_type"))))
    return joined.select(*[c for c in CANDIDATE if c != "metadata"], named.alias("metadata"))


def documents_with_sources(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents for lists and details, newest first."""
    return documents.join(sources, "source_id").orderBy(F.col("created_at").desc(), F.col("document_id").desc())


def versions_of(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, title, version_id, hash, created_at, place): versions by document, the newest is 1."""
    newest = Window.partitionBy("document_id").orderBy(F.col("created_at").desc(), F.col("version_id").desc())
    rows = versions.join(documents.select("document_id", "title"), "document_id")
    return rows.select("document_id", "title", "version_id", "hash", "created_at", F.row_number().over(newest).alias("place"))


def chunk_details(chunks: DataFrame, documents: DataFrame, pending: Column | None = None) -> DataFrame:
    """Chunks with their document's title and status; with ``pending``, those that wait for an embedding, of documents that aren't deleted."""
    rows = chunks.join(documents.select("document_id", "title", "status", F.col("deleted_at").alias("document_deleted_at")), "document_id")
    return rows if pending is None else rows.filter(pending & F.col("document_deleted_at").isNull())


def active_counts(documents: DataFrame, chunks: DataFrame, active: Column) -> DataFrame:
    """(document_id, chunks): active chunks of every document, 0 where it has none."""
    n = chunks.filter(active).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return documents.select("document_id").join(n, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


def run_trace(runs: DataFrame, results: DataFrame, citations: DataFrame) -> DataFrame:
    """(run_id, message_id, results, citations): a run's results by rank and its message's citations by number, two joins for any number of runs."""
    listed = results.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("results"))
    cited = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("number", "chunk_id"))).alias("citations"))
    rows = runs.select("run_id", "message_id").join(listed, "run_id", "left").join(cited, "message_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    return rows.select("run_id", "message_id", none("results").alias("results"), none("citations").alias("citations"))


def selected_for_context(trace: DataFrame, context: DataFrame) -> DataFrame:
    """The trace's candidates, marked where their chunk is in the query's context."""
    used = context.select("query_id", "chunk_id", F.lit(True).alias("_used")).distinct()
    return trace.join(used, ["query_id", "chunk_id"], "left").withColumn("selected_for_context", F.coalesce("_used", F.lit(False))).drop("_used")


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation, in order of time."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n).drop("_n").orderBy("conv_id", "turn")


def message_page(messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of messages in order of time."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 messages from an offset on")
    return messages.orderBy("conv_id", "turn").offset(offset).limit(limit)


def embedding_dimension(chunks: DataFrame) -> DataFrame:
    """(embedded, least, most, uniform): how many chunks have embeddings, and whether all are of one size."""
    size = F.size("embedding")
    return chunks.filter("embedding is not null").agg(F.count(F.lit(1)).alias("embedded"), F.min(size).alias("least"), F.max(size).alias("most"), F.coalesce(F.min(size) == F.max(size), F.lit(True)).alias("uniform"))
