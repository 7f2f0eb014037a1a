"""Queries over query analysis, providers, filters, backfills and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import documents, evaluation, fusion, keywords, providers, query_analysis, reports, search, sync, usage
from lectern.plans import tables as t
from lectern.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}
_W = r"[\p{L}\p{N}_.-]"


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_ASKED = [
    (1, "How do I roll back a Deployment in Kubernetes 1.30 with apps/v1?"), (2, "open issues about kind: CronJob in batch/v1beta1, see KEP-1234"),
    (3, "release notes v1.29.3 changelog for kubelet"), (4, "Pod 版本 1.28 的 官方文档 ConfigMap"), (5, "plain words only"), (6, None), (7, "  "),
]


@_add("query_filters")
def query_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_ASKED, "item_id long, text string").unionByName(t.load(spark, sf, "benchmark").select("item_id", "text"))
    return query_analysis.analyse(rows).drop("text")



@_add("rewrite_reasons", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'no_history' WHEN NOT regexp_matches(text, '(?i)\\b(?:it|its|this|that|they|them|those|these|there|then)\\b') THEN 'independent_query' ELSE 'rewrite' END AS reason FROM conversations WHERE role = 'user'")
def rewrite_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", query_analysis.rewrite_reason(F.col("text"), F.col("turn")).alias("reason"))


@_add("hash_embeddings")
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return providers.embed(t.load(spark, sf, "benchmark"), 64).drop("text")


_WORDS = f"list_distinct(regexp_extract_all(replace(lower({{c}}), 'ß', 'ss'), '{_W.replace('{', '{{').replace('}', '}}')}+'))"


@_add("rerank_overlap", f"WITH {t.ANSWER_SQL}, x AS (SELECT conv_id, turn, {_WORDS.format(c='generated')} AS g, {_WORDS.format(c='reference')} AS r FROM a), y AS (SELECT *, len(list_intersect(g, r)) AS n FROM x) SELECT conv_id, turn, round(coalesce(n / nullif(len(g) + len(r) - n, 0), 0), 9) AS score FROM y")
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return t.answers(spark, sf).select("conv_id", "turn", providers.overlap_score("generated", "reference").alias("score"))


@_add("hybrid_search")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    queries = t.load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = t.load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = lambda rows: providers.embed(rows, 64)
    return fusion.hybrid(lambda: keywords.keyword_top_k(queries, chunks), lambda: search.vector_top_k(vectors(queries), vectors(chunks)))


@_add("filtered_parts", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%a%' OR p_type ILIKE '%a%') AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1')")
def filtered_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = t.load(spark, sf, "part")
    brands = p.filter(F.col("p_brand").endswith("1")).select("p_brand").distinct()
    return p.filter(search.text_like(["p_name", "p_type"], "a")).join(brands, "p_brand", "left_semi").select("p_partkey")


@_add("metadata_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3') AND event_type IN ('click', 'view')")
def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = t.load(spark, sf, "events")
    return e.filter(search.any_metadata(["props"], ["k", "key"], ["1", "2", "3"]) & search.in_list("event_type", ["click", "view"]) & search.in_list("user_id", [])).select("event_id")


_RESULTS = """res AS (SELECT o_orderkey AS id, o_orderstatus AS dataset_name, CAST(o_custkey AS VARCHAR) AS external_id, o_orderpriority AS question, o_orderkey % 2 = 0 AS predicted_answerable, o_orderdate AS started_at,
 CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '{"question":"q' || o_orderkey || '","answerable":true}' WHEN 2 THEN '{"question":"","difficulty":"hard","answerable":"no"}' ELSE '{"category":"c","reference_answer":"r"}' END AS case_data FROM orders)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    data = F.when(k % 4 == 0, "[]").when(k % 4 == 1, F.concat(F.lit('{"question":"q'), k.cast("string"), F.lit('","answerable":true}'))).when(k % 4 == 2, '{"question":"","difficulty":"hard","answerable":"no"}').otherwise('{"category":"c","reference_answer":"r"}')
    return t.load(spark, sf, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("dataset_name"), F.col("o_custkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("question"), (k % 2 == 0).alias("predicted_answerable"), F.col("o_orderdate").alias("started_at"), data.alias("case_data"))


@_add("missing_cases", f"""WITH {_RESULTS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, external_id ORDER BY started_at DESC, id DESC) AS n FROM res WHERE json_type(case_data) = 'OBJECT') WHERE n = 1)
SELECT dataset_name, external_id, coalesce(nullif(json_extract_string(case_data, '$.question'), ''), question) AS question, coalesce(json_extract_string(case_data, '$.reference_answer'), '') AS reference_answer, CASE WHEN json_type(case_data, '$.answerable') = 'BOOLEAN' THEN CAST(json_extract_string(case_data, '$.answerable') AS BOOLEAN) ELSE predicted_answerable END AS answerable,
coalesce(nullif(json_extract_string(case_data, '$.difficulty'), ''), 'medium') AS difficulty, coalesce(nullif(json_extract_string(case_data, '$.category'), ''), 'unknown') AS category FROM s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND CAST(c_custkey AS VARCHAR) = external_id AND dataset_name = 'F')""")
def missing_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = t.load(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.lit("F").alias("dataset_name"), F.col("c_custkey").cast("string").alias("external_id"))
    return sync.missing_cases(sync.latest_snapshots(_results(spark, sf)), cases)


@_add("linked_results", "SELECT l.l_orderkey * 10 + l.l_linenumber AS result_id, coalesce(CASE WHEN l.l_linenumber = 1 THEN -1 END, c.c_custkey) AS case_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = l.l_orderkey % 500 AND o.o_orderstatus = 'F'")
def linked_results(spark: SparkSession, sf: str) -> DataFrame:
    results = t.lines(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") % 500).alias("external_id"), F.when(F.col("l_linenumber") == 1, -1).cast("long").alias("case_id"))
    runs = t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("dataset_name"))
    cases = t.load(spark, sf, "customer").select(F.lit("F").alias("dataset_name"), F.col("c_custkey").alias("external_id"), F.col("c_custkey").alias("case_id"))
    return sync.linked_results(results, runs, cases).select("result_id", "case_id")


@_add("evidence_ids", "WITH k AS (SELECT sha256(text) AS h, min(doc_id) AS id FROM documents GROUP BY 1) SELECT doc_id AS chunk_id, id AS resolved_id FROM documents JOIN k ON h = sha256(text)")
def evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    known = d.groupBy(F.sha2("content", 256).alias("content_sha256")).agg(F.min("chunk_id").alias("chunk_id"))
    return sync.evidence_ids(d, known).select("chunk_id", "resolved_id")


@_add("run_summary", f"WITH {t.USAGE_SQL} SELECT count(*) AS cases, count(*) FILTER (operation = 'error') AS failed, round(avg(latency_ms) FILTER (operation <> 'error'), 9) AS latency_ms, CAST(coalesce(sum(prompt_tokens) FILTER (operation <> 'error'), 0) AS BIGINT) AS tokens, CAST(NULL AS DOUBLE) AS cost, false AS complete FROM facts")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.usage_facts(spark, sf).withColumn("error", F.when(F.col("operation") == "error", "failed")).withColumn("tokens", F.col("prompt_tokens"))
    return evaluation.run_summary(rows, ["latency_ms"])


@_add("case_templates")
def case_templates(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("section"), F.col("text").alias("content"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"))
    return evaluation.built_cases(d)


@_add("balanced_cases")
def balanced_cases(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.balanced(case_templates(spark, sf), 52)


@_add("catalog_sample")
def catalog_sample(spark: SparkSession, sf: str) -> DataFrame:
    return readers.catalog_sample(t.load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")), 100)


@_add("usage_by_page", f"WITH {t.USAGE_SQL} SELECT count(*) AS total FROM facts WHERE created_at >= TIMESTAMP '2024-01-05'")
def usage_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return usage.total_count(usage.between(t.usage_facts(spark, sf), "2024-01-05"))


@_add("unlinked_results", "SELECT count(*) FILTER (o_orderstatus = 'F') AS unlinked FROM orders")
def unlinked_results(spark: SparkSession, sf: str) -> DataFrame:
    return usage.unlinked(t.load(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("case_id")))


@_add("queue_counts", "SELECT count(*) FILTER (event_type IN ('click', 'view')) AS outstanding, count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-10') AS live FROM events")
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise("succeeded")
    return sync.queue_counts(t.load(spark, sf, "events").select(status.alias("status"), F.col("ts").alias("heartbeat_at")), "2024-01-10")


@_add("snapshot_plan", f"""WITH {t.SNAPSHOT_SQL}, k AS (SELECT * FROM incoming WHERE external_id % 17 <> 4), p AS (SELECT coalesce(s.external_id, i.external_id) AS external_id, CASE WHEN i.hash IS NULL THEN CASE WHEN s.deleted THEN NULL ELSE 'delete' END WHEN s.hash IS NULL THEN 'create' WHEN s.deleted THEN 'restore' WHEN s.hash <> i.hash THEN 'update' ELSE 'unchanged' END AS action FROM stored s FULL JOIN k i ON s.external_id = i.external_id)
SELECT * FROM p WHERE action IS NOT NULL AND NOT (action = 'delete' AND external_id IN (SELECT external_id FROM incoming WHERE external_id % 17 = 4))""")
def snapshot_plan(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = t.snapshots(spark, sf)
    return sync.snapshot_plan(stored, incoming, incoming.filter("external_id % 17 = 4")).select("external_id", "action")


@_add("backfill_stats", f"WITH {t.CHUNK_SQL} SELECT count(*) AS selected, count(*) FILTER (id % 3 <> 0) AS indexed, count(*) FILTER (id % 3 = 0) AS stale FROM c")
def backfill_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = t.chunk_table(spark, sf)
    return sync.backfill_stats(c, c.filter("id % 3 <> 0"))


_SETTINGS = ", ".join(f"('{e}', '{s}', '{v}')" for e, s, v in reports.settings())


@_add("experiments", f"SELECT item_id AS case_id, experiment, setting, value FROM benchmark, (VALUES {_SETTINGS}) AS x (experiment, setting, value)")
def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """What every experiment sets for every case."""
    return reports.planned_runs(t.load(spark, sf, "benchmark").select(F.col("item_id").alias("case_id")))


_EXPERIMENT = "x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'hybrid' ELSE 'keyword-only' END AS experiment, l_orderkey * 10 + l_linenumber AS case_id, CASE WHEN l_suppkey % 9 = 0 THEN 'timeout' END AS error, l_quantity > 10 AS answerable, l_tax > 0.02 AS predicted_answerable, l_discount * 10 AS recall_20, 1 - l_tax AS citation_precision, l_discount AS token_f1 FROM lines)"


def _experiment(spark: SparkSession, sf: str) -> DataFrame:
    l = t.lines(spark, sf)  # noqa: E741
    return l.select(
        F.when(F.col("l_linenumber") % 2 == 0, "hybrid").otherwise("keyword-only").alias("experiment"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.when(F.col("l_suppkey") % 9 == 0, "timeout").alias("error"),
        (F.col("l_quantity") > 10).alias("answerable"), (F.col("l_tax") > 0.02).alias("predicted_answerable"), (F.col("l_discount") * 10).alias("recall_20"), (1 - F.col("l_tax")).alias("citation_precision"), F.col("l_discount").alias("token_f1"),
    )


@_add("experiment_comparison", f"WITH {t.LINES_SQL}, {_EXPERIMENT} SELECT experiment, count(*) AS cases, count(error) AS failed, round(avg(recall_20) FILTER (error IS NULL), 9) AS recall_20, round(avg(token_f1) FILTER (error IS NULL), 9) AS token_f1 FROM x GROUP BY 1")
def experiment_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return reports.comparison(_experiment(spark, sf), ["recall_20", "token_f1"])


@_add("report_failures", f"WITH {t.LINES_SQL}, {_EXPERIMENT} SELECT 'error' AS list, case_id, CAST(NULL AS DOUBLE) AS value FROM x WHERE error IS NOT NULL UNION ALL SELECT 'missed', case_id, CAST(recall_20 AS DOUBLE) FROM x WHERE answerable AND recall_20 = 0 UNION ALL SELECT 'citation_error', case_id, CAST(citation_precision AS DOUBLE) FROM x WHERE predicted_answerable AND citation_precision < 1 UNION ALL (SELECT 'worst', case_id, CAST(token_f1 AS DOUBLE) FROM x WHERE error IS NULL ORDER BY token_f1, case_id LIMIT 10)")
def report_failures(spark: SparkSession, sf: str) -> DataFrame:
    return reports.failures(_experiment(spark, sf))


@_add("document_types", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'blog' WHEN item_id % 3 = 1 THEN 'github_issue' ELSE 'official_documentation' END AS document_type FROM benchmark")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id") % 3
    return t.load(spark, sf, "benchmark").select("item_id", documents.document_type(F.when(k == 0, "blog").when(k == 1, "nonsense"), F.when(k == 1, "GitHub_Issues").otherwise("web")).alias("document_type"))
