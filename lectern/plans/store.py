"""Queries over the document store: joins, candidates, upserts, soft deletes, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalogue, sync
from lectern.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as chunks, orders as documents, customers as sources."""
    chunks = t.lines(spark, sf).select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.concat_ws(" ", F.lit("part"), F.col("l_partkey").cast("string")).alias("content"),
        F.lit(None).cast("string").alias("heading_path"), F.lit(0).alias("start_offset"), F.lit(10).alias("end_offset"), F.create_map(F.lit("kind"), F.concat(F.lit("k"), (F.col("l_suppkey") % 3).cast("string"))).alias("chunk_metadata"), (F.col("l_tax") > 0.04).alias("embedded"),
    )
    documents = t.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderstatus").alias("document_type"),
        F.lit("v1").alias("source_version"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("active").alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"),
        F.create_map(F.lit("kind"), F.lit("order"), F.lit("priority"), F.col("o_orderpriority")).alias("document_metadata"),
    )
    sources = t.load(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"), F.lit("customer").alias("source_type"))
    return chunks, documents, sources


@_add("store_candidates", f"""WITH {t.LINES_SQL} SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS document_id, c_name AS source_name, o_orderpriority AS title, 'part ' || l_partkey AS content, '/o/' || o_orderkey AS url,
'kind=k' || (l_suppkey % 3) || ';priority=' || o_orderpriority || ';source_name=' || c_name || ';source_type=customer' AS metadata FROM lines JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def store_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalogue.candidates(catalogue.chunks_with_sources(*_store(spark, sf)))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("chunk_id", "document_id", "source_name", "title", "content", "url", said.alias("metadata"))


@_add("document_list", "SELECT o_orderkey AS document_id, o_orderpriority AS title, c_name AS source_name FROM orders JOIN customer ON c_custkey = o_custkey")
def document_list(spark: SparkSession, sf: str) -> DataFrame:
    _, documents, sources = _store(spark, sf)
    return catalogue.documents_with_sources(documents, sources).select("document_id", "title", "source_name")


@_add("document_versions", "SELECT c_custkey AS document_id, c_name AS title, o_orderkey AS version_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders JOIN customer ON c_custkey = o_custkey")
def document_versions(spark: SparkSession, sf: str) -> DataFrame:
    versions = t.load(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderstatus").alias("hash"), F.col("o_orderdate").alias("created_at"))
    titles = t.load(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return catalogue.versions_of(versions, titles).select("document_id", "title", "version_id", "place")


@_add("pending_chunks", f"WITH {t.LINES_SQL} SELECT l_orderkey * 10 + l_linenumber AS chunk_id, o_orderpriority AS title FROM lines JOIN orders ON o_orderkey = l_orderkey WHERE l_tax <= 0.04 AND o_orderstatus <> 'F'")
def pending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks, documents, _ = _store(spark, sf)
    return catalogue.chunk_details(chunks, documents, ~F.col("embedded")).select("chunk_id", "title")


@_add("run_trace", f"WITH {t.LINES_SQL} SELECT o_orderkey AS run_id, coalesce((SELECT string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber) FROM lines l WHERE l.l_orderkey = o_orderkey), '') AS results, coalesce((SELECT string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber) FROM lines l WHERE l.l_orderkey = o_orderkey AND l_tax > 0.04), '') AS citations FROM orders")
def run_trace(spark: SparkSession, sf: str) -> DataFrame:
    l = t.lines(spark, sf)  # noqa: E741
    runs = t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (-F.col("o_orderkey")).alias("message_id"))
    results = l.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("chunk_id"))
    citations = l.filter("l_tax > 0.04").select((-F.col("l_orderkey")).alias("message_id"), F.col("l_linenumber").alias("number"), F.col("l_suppkey").alias("chunk_id"))
    told = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[k].cast("string"), x["chunk_id"].cast("string"))), ",")
    return catalogue.run_trace(runs, results, citations).select("run_id", told("results", "rank").alias("results"), told("citations", "number").alias("citations"))


@_add("context_marks", f"WITH {t.CHANNEL_SQL} SELECT k.query_id, k.chunk_id, k.rank, coalesce(v.rank <= 2, false) AS selected_for_context FROM k LEFT JOIN v USING (query_id, chunk_id)")
def context_marks(spark: SparkSession, sf: str) -> DataFrame:
    trace, other = t.channels(spark, sf)
    return catalogue.selected_for_context(trace, other.filter("rank <= 2")).select("query_id", "chunk_id", "rank", "selected_for_context")


@_add("active_counts", f"WITH {t.CHUNK_SQL}, n AS (SELECT document_id, count(*) AS n FROM c WHERE id % 8 <> 5 GROUP BY 1) SELECT o_orderkey AS document_id, coalesce(n, 0) AS chunks FROM orders LEFT JOIN n ON document_id = o_orderkey")
def active_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.active_counts(t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id")), t.chunk_table(spark, sf), F.col("id") % 8 != 5)


@_add("recent_messages", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_messages(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.recent_messages(t.load(spark, sf, "conversations"), 3).select("conv_id", "turn", "role", "text")


@_add("message_page", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100 OFFSET 40")
def message_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.message_page(t.load(spark, sf, "conversations"), 100, 40).select("conv_id", "turn", "role")


@_add("embedding_dimension", "SELECT count(*) AS embedded, CAST(min(len(embedding)) AS INT) AS least, CAST(max(len(embedding)) AS INT) AS most, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings WHERE embedding IS NOT NULL")
def embedding_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.embedding_dimension(t.load(spark, sf, "embeddings"))


_TABLE = "s AS (SELECT external_id, hash, CASE WHEN deleted THEN 'deleted' ELSE 'active' END AS status, CASE WHEN deleted THEN TIMESTAMP '2024-01-04' END AS deleted_at FROM stored)"


def _table(stored: DataFrame) -> DataFrame:
    return stored.select("external_id", "hash", F.when(F.col("deleted"), "deleted").otherwise("active").alias("status"), F.when(F.col("deleted"), F.lit("2024-01-04").cast("timestamp_ntz")).alias("deleted_at"))


@_add("soft_delete", f"WITH {t.SNAPSHOT_SQL}, {_TABLE} SELECT external_id, hash, CASE WHEN deleted_at IS NULL AND external_id NOT IN (SELECT external_id FROM incoming) THEN 'deleted' ELSE status END AS status, CASE WHEN deleted_at IS NULL AND external_id NOT IN (SELECT external_id FROM incoming) THEN TIMESTAMP '2024-02-01' ELSE deleted_at END AS deleted_at FROM s")
def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = t.snapshots(spark, sf)
    return sync.delete_missing(_table(stored), incoming, "2024-02-01")


@_add("reactivate", f"WITH {t.SNAPSHOT_SQL}, {_TABLE} SELECT external_id, CASE WHEN external_id IN (SELECT external_id FROM incoming) THEN 'active' ELSE status END AS status, CASE WHEN external_id NOT IN (SELECT external_id FROM incoming) THEN deleted_at END AS deleted_at FROM s")
def reactivate(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = t.snapshots(spark, sf)
    return sync.set_deleted(_table(stored), incoming, "2024-02-01", deleted=False).select("external_id", "status", "deleted_at")


@_add("upsert_cases", "WITH o AS (SELECT 'd' || (c_custkey % 4) AS dataset_name, c_name AS external_id, c_custkey AS case_id, c_mktsegment AS question FROM customer), n AS (SELECT dataset_name, external_id, case_id + 1000000 AS case_id, 'new ' || question AS question FROM o WHERE case_id % 3 = 0), s AS (SELECT * FROM o WHERE case_id % 2 = 0) SELECT coalesce(s.dataset_name, n.dataset_name) AS dataset_name, coalesce(s.external_id, n.external_id) AS external_id, coalesce(s.case_id, n.case_id) AS case_id, coalesce(n.question, s.question) AS question FROM s FULL JOIN n ON s.dataset_name = n.dataset_name AND s.external_id = n.external_id")
def upsert_cases(spark: SparkSession, sf: str) -> DataFrame:
    c = t.load(spark, sf, "customer").select(F.concat(F.lit("d"), (F.col("c_custkey") % 4).cast("string")).alias("dataset_name"), F.col("c_name").alias("external_id"), F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("question"))
    came = c.filter("case_id % 3 = 0").withColumns({"case_id": F.col("case_id") + 1000000, "question": F.concat(F.lit("new "), "question")})
    return sync.upsert_cases(c.filter("case_id % 2 = 0"), came)[0]


@_add("upsert_sources", "WITH s AS (SELECT n_name AS name, n_nationkey AS source_id, true AS enabled FROM nation WHERE n_nationkey % 2 = 0), i AS (SELECT n_name AS name, n_nationkey + 100 AS source_id, n_nationkey % 5 <> 0 AS enabled FROM nation WHERE n_nationkey % 3 = 0) SELECT coalesce(s.name, i.name) AS name, coalesce(s.source_id, i.source_id) AS source_id, coalesce(i.enabled, s.enabled) AS enabled FROM s FULL JOIN i ON s.name = i.name")
def upsert_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = t.load(spark, sf, "nation")
    stored = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("source_id"), F.lit(True).alias("enabled"))
    came = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("source_id"), (F.col("n_nationkey") % 5 != 0).alias("enabled"))
    return sync.upsert_sources(stored, came)
