"""Queries over usage, fusion, evaluation and sync, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluation, fusion, sync, usage
from lectern.plans import tables as t

_TOTALS = """count(*) AS records, count(DISTINCT request_id) AS requests, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
 CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens, CAST(CASE WHEN count(cost) = count(*) THEN sum(cost) END AS DOUBLE) AS cost, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms"""
_LATENCY = """count({c}) AS n, round(coalesce(avg({c}), 0), 6) AS mean, round(coalesce(quantile_cont({c}, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont({c}, 0.9), 0), 6) AS p90,
 round(coalesce(quantile_cont({c}, 0.95), 0), 6) AS p95, round(coalesce(quantile_cont({c}, 0.99), 0), 6) AS p99, coalesce(min({c}), 0) AS min, coalesce(max({c}), 0) AS max"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_BY = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS key, {_TOTALS} FROM facts GROUP BY {d}" for d in ("operation", "model", "provider"))


@_add("usage_totals", f"WITH {t.USAGE_SQL} SELECT {_TOTALS} FROM facts")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return usage.totals(t.usage_facts(spark, sf))


@_add("usage_breakdowns", f"WITH {t.USAGE_SQL} {_BY}")
def usage_breakdowns(spark: SparkSession, sf: str) -> DataFrame:
    return usage.breakdowns(t.usage_facts(spark, sf))


@_add("usage_summary", f"WITH {t.USAGE_SQL} SELECT *, cost IS NOT NULL AS cost_complete FROM (SELECT 'total' AS dimension, '' AS key, {_TOTALS} FROM facts UNION ALL {_BY})")
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return usage.summary(t.usage_facts(spark, sf))


@_add("usage_range", f"WITH {t.USAGE_SQL} SELECT {_TOTALS} FROM facts WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12' AND model = 'm1'")
def usage_range(spark: SparkSession, sf: str) -> DataFrame:
    return usage.totals(usage.between(t.usage_facts(spark, sf), "2024-01-05", "2024-01-12", model="m1"))


@_add("usage_performance", f"WITH {t.USAGE_SQL} SELECT count(*) AS messages, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms, CAST(CASE WHEN count(cost) = count(*) THEN sum(cost) END AS DOUBLE) AS cost, count(cost) AS priced, count(*) - count(cost) AS unpriced FROM facts")
def usage_performance(spark: SparkSession, sf: str) -> DataFrame:
    return usage.performance(t.usage_facts(spark, sf))


@_add("cost_by_request", f"WITH {t.USAGE_SQL} SELECT request_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(CASE WHEN count(cost) = count(*) THEN sum(cost) END AS DOUBLE) AS cost FROM facts GROUP BY 1")
def cost_by_request(spark: SparkSession, sf: str) -> DataFrame:
    return usage.by_request(t.usage_facts(spark, sf))


@_add("usage_audit", f"WITH {t.USAGE_SQL} SELECT request_id, operation, model, provider, count(*) AS records, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(CASE WHEN count(cost) = count(*) THEN sum(cost) END AS DOUBLE) AS cost FROM facts GROUP BY 1, 2, 3, 4")
def usage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return usage.audit(t.usage_facts(spark, sf))


@_add("usage_page", f"WITH {t.USAGE_SQL} SELECT id, request_id, operation FROM facts ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def usage_page(spark: SparkSession, sf: str) -> DataFrame:
    return usage.page(t.usage_facts(spark, sf), 50, 100).select("id", "request_id", "operation")


@_add("latency_summary", f"WITH {t.USAGE_SQL}, f AS (SELECT CASE WHEN operation <> 'error' THEN latency_ms END AS ok, operation = 'error' AS failed FROM facts) SELECT {_LATENCY.format(c='ok')}, round(count(*) / 3600.0, 6) AS throughput, round(count(*) FILTER (failed) / count(*), 6) AS error_rate FROM f")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return usage.latency_summary(t.usage_facts(spark, sf).withColumn("failed", F.col("operation") == "error"), 3600)


@_add("stage_latencies", f"WITH {t.USAGE_SQL} SELECT operation AS stage, {_LATENCY.format(c='latency_ms')} FROM facts GROUP BY 1")
def stage_latencies(spark: SparkSession, sf: str) -> DataFrame:
    return usage.stage_latencies(t.usage_facts(spark, sf).select(F.col("operation").alias("stage"), F.col("latency_ms").alias("ms")))


@_add("latency_histogram", f"WITH {t.USAGE_SQL} SELECT le, count(*) AS n FROM facts, (VALUES ('1.0', 1.0), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('+Inf', 1e300)) b(le, hi) WHERE latency_ms <= hi GROUP BY 1")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return usage.histogram(t.usage_facts(spark, sf), [1, 10, 50, 100])


@_add("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return usage.status_counts(t.load(spark, sf, "orders"), "o_orderstatus")


_PRICES = [("p0", "m0", "0.15", "0.60"), ("p1", "m1", "2.50", "10.00"), ("p0", "m2", "0.02", "0.00")]


@_add("price_lookup", f"WITH {t.USAGE_SQL} SELECT id, CAST(round((prompt_tokens * CAST(pp AS DECIMAL(10,4)) + completion_tokens * CAST(cp AS DECIMAL(10,4))) / 1000000, 8) AS DOUBLE) AS estimated_cost FROM facts LEFT JOIN (VALUES {', '.join(map(str, _PRICES))}) x(p, m, pp, cp) ON provider = p AND model = m")
def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "provider string, model string, a string, b string").select("provider", "model", F.col("a").cast("decimal(10,4)").alias("prompt_price"), F.col("b").cast("decimal(10,4)").alias("completion_price"))
    return usage.priced(t.usage_facts(spark, sf), prices).select("id", "estimated_cost")


_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, least(keyword_rank, vector_rank), keyword_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS fused_rank"
_FUSED = ["query_id", "chunk_id", "keyword_rank", "vector_rank", "fused_score", "fused_rank"]


@_add("rrf_fusion", f"WITH {t.CHANNEL_SQL}, f AS (SELECT *, round(coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0), 12) AS fused_score FROM j) SELECT query_id, chunk_id, keyword_rank, vector_rank, fused_score, {_RANKED} FROM f")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rrf(*t.channels(spark, sf)).select(*_FUSED)


_UNIT = "CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@_add("weighted_fusion", f"WITH {t.CHANNEL_SQL}, ku AS (SELECT query_id, chunk_id, {_UNIT} AS u FROM k WINDOW w AS (PARTITION BY query_id)), vu AS (SELECT query_id, chunk_id, {_UNIT} AS u FROM v WINDOW w AS (PARTITION BY query_id)), f AS (SELECT j.*, round(coalesce(ku.u, 0) * 0.75 + coalesce(vu.u, 0) * 0.25, 9) AS fused_score FROM j LEFT JOIN ku USING (query_id, chunk_id) LEFT JOIN vu USING (query_id, chunk_id)) SELECT query_id, chunk_id, keyword_rank, vector_rank, fused_score, {_RANKED} FROM f")
def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.weighted(*t.channels(spark, sf), 3, 1).select(*_FUSED)


@_add("minmax_normalise", f"WITH {t.CHANNEL_SQL} SELECT query_id, chunk_id, round({_UNIT}, 9) AS unit FROM k WINDOW w AS (PARTITION BY query_id)")
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.normalised(t.channels(spark, sf)[0]).select("query_id", "chunk_id", F.round("unit", 9).alias("unit"))


@_add("single_channel", f"WITH {t.CHANNEL_SQL} SELECT query_id, chunk_id, score AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY rank, score DESC, chunk_id) AS fused_rank FROM v")
def single_channel(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(*t.channels(spark, sf), mode="vector").select("query_id", "chunk_id", "fused_score", "fused_rank")


@_add("rerank_top", f"""WITH {t.CHANNEL_SQL}, f AS (SELECT *, round(coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0), 12) AS fused_score FROM j), g AS (SELECT *, {_RANKED} FROM f),
s AS (SELECT *, keyword_score AS x, bool_and(keyword_score IS NOT NULL) OVER (PARTITION BY query_id) AS good FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN good THEN x END DESC NULLS LAST, fused_rank, chunk_id) AS position FROM s)
SELECT query_id, chunk_id, CASE WHEN good THEN x END AS rerank_score, CASE WHEN good THEN position END AS rerank_rank, position FROM p WHERE position <= 3""")
def rerank_top(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.reranked(fusion.rrf(*t.channels(spark, sf)), F.col("keyword_score"), top_n=3).select("query_id", "chunk_id", "rerank_score", "rerank_rank", "position")


_RECALL = ", ".join(f"coalesce(CAST(first <= {k} AS DOUBLE), 0) AS recall_{k}, round(coalesce(h{k} / n, 0), 9) AS coverage_{k}" for k in evaluation.CUTS)
_RETRIEVAL = f"WITH {t.RETRIEVED_SQL}, m AS (SELECT o_orderkey AS case_id, o_orderpriority AS category, {_RECALL}, round(coalesce(1.0 / first, 0), 9) AS reciprocal_rank FROM orders LEFT JOIN n ON n.case_id = o_orderkey LEFT JOIN h ON h.case_id = o_orderkey)"


@_add("retrieval_metrics", f"{_RETRIEVAL} SELECT * EXCLUDE (category) FROM m")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.retrieval(*t.retrieved(spark, sf))


_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("recall_1", "recall_5", "reciprocal_rank"))


@_add("grouped_metrics", f"{_RETRIEVAL} SELECT category, count(*) AS n, {_MEANS} FROM m GROUP BY 1")
def grouped_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.retrieval(*t.retrieved(spark, sf)).join(t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category")), "case_id")
    return evaluation.mean_metrics(rows, ["recall_1", "recall_5", "reciprocal_rank"], by="category")


_W = r"[\p{L}\p{N}_]"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '{_W}+(?:[./:+-]{_W}+)*')"



@_add("answer_metrics", f"""WITH {t.ANSWER_SQL}, x AS (SELECT conv_id, turn, replace(lower(generated), 'ß', 'ss') AS fold, {_tokens('generated')} AS g, {_tokens('reference')} AS r FROM a),
u AS (SELECT *, list_distinct(r) AS req, coalesce(list_sum(list_transform(list_distinct(list_intersect(g, r)), lambda w: least(len(list_filter(g, lambda q: q = w)), len(list_filter(r, lambda q: q = w))))), 0) AS shared FROM x)
SELECT conv_id, turn, CAST(array_to_string(g, ' ') = array_to_string(r, ' ') AS DOUBLE) AS exact_match, round(CASE WHEN len(g) = 0 AND len(r) = 0 THEN 1.0 ELSE 2.0 * shared / (len(g) + len(r)) END, 9) AS token_f1,
 round(CASE WHEN len(req) = 0 THEN 1.0 ELSE len(list_filter(req, lambda w: contains(fold, w))) / len(req) END, 9) AS keyword_coverage FROM u""")
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.answer_metrics(t.answers(spark, sf), "generated", "reference").select("conv_id", "turn", *evaluation.ANSWER[:3])


_RATES = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS false_positive_rate, round(coalesce(fn / nullif(fn + tp, 0), 0), 9) AS false_negative_rate"""


@_add("confusion_metrics", f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels) SELECT tp, fp, tn, fn, {_RATES} FROM c")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(t.load(spark, sf, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("predicted")))


@_add("calibrate_threshold", f"""WITH s AS (SELECT round(l_extendedprice / 100000, 3) AS score, l_returnflag = 'R' AS a FROM lineitem), g AS (SELECT score AS threshold, count(*) FILTER (a) AS pos, count(*) FILTER (NOT a) AS neg FROM s GROUP BY 1),
e AS (SELECT * FROM g UNION ALL SELECT min(threshold) - 1e-9, 0, 0 FROM g UNION ALL SELECT max(threshold) + 1e-9, 0, 0 FROM g),
w AS (SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM e),
c AS (SELECT threshold, tp, fp, n - fp AS tn, p - tp AS fn FROM w), r AS (SELECT threshold, tp, fp, tn, fn, {_RATES} FROM c) SELECT threshold, f1, accuracy, tp, fp, tn, fn FROM r ORDER BY f1 DESC, accuracy DESC, threshold LIMIT 1""")
def calibrate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    l = t.load(spark, sf, "lineitem")  # noqa: E741
    return evaluation.calibrated(l.select(F.round(F.col("l_extendedprice") / 100000, 3).alias("score"), (F.col("l_returnflag") == "R").alias("answerable")))


@_add("citation_metrics", """WITH c AS (SELECT l_orderkey AS case_id, avg(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END) AS p, avg(greatest(0.0, least(1.0, l_discount * 12))) AS s FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey AS case_id, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey AS case_id, round(coalesce(p, 0), 9) AS precision, round(coalesce(r, 1), 9) AS recall, round(coalesce(s, p, 0), 9) AS correctness, round(coalesce(r, 1), 9) AS completeness FROM orders LEFT JOIN c ON c.case_id = o_orderkey LEFT JOIN r ON r.case_id = o_orderkey""")
def citation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    l = t.load(spark, sf, "lineitem")  # noqa: E741
    cited = l.select(F.col("l_orderkey").alias("case_id"), (F.col("l_returnflag") != "N").alias("valid"), (F.col("l_discount") * 12).alias("score"))
    claims = l.select(F.col("l_orderkey").alias("case_id"), (F.col("l_quantity") > 25).alias("required"), (F.col("l_linestatus") == "F").alias("supported"))
    return evaluation.citations(cited, claims, t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id")))


@_add("rewrite_deltas", f"{_RETRIEVAL}, b AS (SELECT case_id, recall_5 AS raw_recall, recall_10 AS rewritten_recall FROM m WHERE case_id % 9 <> 0 AND case_id % 10 <> 0) SELECT *, rewritten_recall - raw_recall AS delta, rewritten_recall = raw_recall AS needless, rewritten_recall < raw_recall AS harmful FROM b")
def rewrite_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.retrieval(*t.retrieved(spark, sf))
    raw = rows.select("case_id", "recall_5", F.when(F.col("case_id") % 9 == 0, "timeout").alias("error"))
    new = rows.select("case_id", F.col("recall_10").alias("recall_5"), F.when(F.col("case_id") % 10 == 0, "timeout").alias("error"))
    return evaluation.rewrite_deltas(raw, new)


_PLAN = f"""WITH {t.SNAPSHOT_SQL}, p AS (SELECT coalesce(s.external_id, i.external_id) AS external_id, CASE WHEN i.hash IS NULL THEN CASE WHEN s.deleted THEN NULL ELSE 'delete' END WHEN s.hash IS NULL THEN 'create' WHEN s.deleted THEN 'restore' WHEN s.hash <> i.hash THEN 'update' ELSE 'unchanged' END AS action, coalesce(i.hash, s.hash) AS hash FROM stored s FULL JOIN incoming i ON s.external_id = i.external_id)"""


@_add("document_plan", f"{_PLAN} SELECT * FROM p WHERE action IS NOT NULL")
def document_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sync.document_plan(*t.snapshots(spark, sf))


@_add("sync_stats", f"{_PLAN} SELECT " + ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in sync.ACTIONS) + " FROM p")
def sync_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sync.plan_stats(sync.document_plan(*t.snapshots(spark, sf)))


@_add("missing_documents", f"WITH {t.SNAPSHOT_SQL} SELECT * FROM stored s WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM incoming i WHERE i.external_id = s.external_id)")
def missing_documents(spark: SparkSession, sf: str) -> DataFrame:
    return sync.missing(*t.snapshots(spark, sf))


_STORED = "full_stored AS (SELECT external_id, hash, CASE WHEN deleted THEN 'deleted' ELSE 'active' END AS status, TIMESTAMP '2024-01-01' AS first_seen_at, TIMESTAMP '2024-01-02' AS last_seen_at, TIMESTAMP '2024-01-03' AS indexed_at, CASE WHEN deleted THEN TIMESTAMP '2024-01-04' END AS deleted_at FROM stored)"


@_add("upsert_documents", f"WITH {t.SNAPSHOT_SQL}, {_STORED} SELECT coalesce(s.external_id, i.external_id) AS external_id, coalesce(i.hash, s.hash) AS hash, CASE WHEN i.hash IS NOT NULL THEN 'active' ELSE status END AS status, coalesce(first_seen_at, TIMESTAMP '2024-02-01') AS first_seen_at, CASE WHEN i.hash IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE last_seen_at END AS last_seen_at, CASE WHEN i.hash IS NULL OR i.hash = s.hash THEN indexed_at END AS indexed_at, CASE WHEN i.hash IS NULL THEN deleted_at END AS deleted_at FROM full_stored s FULL JOIN incoming i ON s.external_id = i.external_id")
def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = t.snapshots(spark, sf)
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp_ntz")
    full = stored.select("external_id", "hash", F.when(F.col("deleted"), "deleted").otherwise("active").alias("status"), at(1).alias("first_seen_at"), at(2).alias("last_seen_at"), at(3).alias("indexed_at"), F.when(F.col("deleted"), at(4)).alias("deleted_at"))
    return sync.upsert_documents(full, incoming, "2024-02-01")


@_add("new_versions", f"WITH {t.SNAPSHOT_SQL} SELECT external_id, hash FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.external_id = i.external_id AND s.hash = i.hash)")
def new_versions(spark: SparkSession, sf: str) -> DataFrame:
    return sync.new_versions(*t.snapshots(spark, sf))


@_add("latest_version", "SELECT o_custkey AS external_id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS hash, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS version_id FROM orders GROUP BY 1")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    o = t.load(spark, sf, "orders")
    return sync.latest_version(o.select(F.col("o_custkey").alias("external_id"), F.col("o_orderstatus").alias("hash"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at")))


@_add("chunk_neighbours", f"WITH {t.CHUNK_SQL} SELECT c.document_id, c.chunk_index, c.id, b.id AS before_id, a.id AS after_id FROM c LEFT JOIN c b ON b.document_id = c.document_id AND b.chunk_index = c.chunk_index - 1 LEFT JOIN c a ON a.document_id = c.document_id AND a.chunk_index = c.chunk_index + 1")
def chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return sync.neighbours(t.chunk_table(spark, sf).filter("true")).select("document_id", "chunk_index", "id", "before_id", "after_id")


@_add("chunk_parents", f"WITH {t.CHUNK_SQL} SELECT c.id, p.id AS parent_id FROM c LEFT JOIN c p ON p.document_id = c.document_id AND p.chunk_index = c.chunk_index // 2")
def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    return sync.parents(t.chunk_table(spark, sf).withColumn("parent_index", F.expr("chunk_index div 2"))).select("id", "parent_id")


@_add("upsert_chunks", f"WITH {t.CHUNK_SQL}, o AS (SELECT document_id, chunk_index, id + 1000000000 AS id, CASE WHEN chunk_index % 2 = 0 THEN hash ELSE 'x' END AS hash, id AS embedding FROM c WHERE chunk_index <> 3) SELECT document_id, chunk_index, coalesce(o.id, n.id) AS id, coalesce(n.hash, o.hash) AS hash, CASE WHEN n.hash IS NULL OR n.hash = o.hash THEN o.embedding END AS embedding FROM (SELECT * FROM c WHERE chunk_index <> 2) n FULL JOIN o USING (document_id, chunk_index)")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = t.chunk_table(spark, sf)
    old = c.filter("chunk_index <> 3").select("document_id", "chunk_index", (F.col("id") + 1000000000).alias("id"), F.when(F.col("chunk_index") % 2 == 0, F.col("hash")).otherwise("x").alias("hash"), F.col("id").alias("embedding"))
    return sync.upsert_chunks(old, c.filter("chunk_index <> 2").withColumn("embedding", F.lit(None).cast("long")))


@_add("chunk_plan")
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = t.chunk_table(spark, sf)
    old = c.filter("id % 9 <> 4").withColumn("deleted", F.col("id") % 8 == 5)
    return sync.chunk_plan(old, c.withColumn("chunk_index", F.col("chunk_index") + (F.col("document_id") % 2)))


@_add("claimable_jobs", "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'running' WHEN event_type = 'view' THEN 'pending' ELSE 'succeeded' END AS status FROM events WHERE event_type = 'view' OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-10')")
def claimable_jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = t.load(spark, sf, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise("succeeded").alias("status"), F.col("ts").alias("heartbeat_at"), F.col("ts").alias("created_at"))
    return sync.claimable(jobs, "2024-01-10").select("id", "status")


@_add("json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(nullif(event_type, 'view'), 'none') || ':' || json_extract_string(props, '$.k') AS label FROM events")
def json_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.load(spark, sf, "events").select("event_id", k.cast("long").alias("k"), F.concat_ws(":", F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")), k).alias("label"))
