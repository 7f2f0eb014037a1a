"""The test tables as the engine's tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records: a user is a request, errors are unpriced."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("request_id"), F.col("event_type").alias("operation"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("provider"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long")).alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"),
        F.when(F.col("event_type") != "error", (F.col("event_id") % 1000).cast("decimal(18,8)")).alias("cost"), F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"),
    )


USAGE_SQL = """facts AS (SELECT event_id AS id, user_id AS request_id, event_type AS operation, 'm' || (user_id % 3) AS model, 'p' || (user_id % 2) AS provider,
 coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS prompt_tokens, event_id % 100 AS completion_tokens,
 CASE WHEN event_type <> 'error' THEN CAST(event_id % 1000 AS DECIMAL(18,8)) END AS cost, value AS latency_ms, ts AS created_at FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one for each (order, line number), which the table repeats."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")])


LINES_SQL = "lines AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)"


def channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as two channels of candidates: an order is a query, a line is a chunk."""
    from pyspark.sql import Window

    l = lines(spark, sf_dir)  # noqa: E741

    def channel(keep, score):
        rows = l.filter(keep).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("chunk_id"), score.alias("score"))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))

    return channel(F.col("l_discount") >= 0.03, F.col("l_extendedprice")), channel(F.col("l_tax") >= 0.02, F.col("l_quantity"))


CHANNEL_SQL = LINES_SQL + """,
k AS (SELECT l_orderkey AS query_id, l_linenumber AS chunk_id, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lines WHERE l_discount >= 0.03),
v AS (SELECT l_orderkey AS query_id, l_linenumber AS chunk_id, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank FROM lines WHERE l_tax >= 0.02),
j AS (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.chunk_id, v.chunk_id) AS chunk_id, k.rank AS keyword_rank, v.rank AS vector_rank, k.score AS keyword_score, v.score AS vector_score FROM k FULL JOIN v ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as a stored table, some deleted, and a later snapshot with changed, new and absent ones."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    stored = d.filter("doc_id % 11 <> 3").select(F.col("doc_id").alias("external_id"), F.col("h").alias("hash"), (F.col("doc_id") % 13 == 0).alias("deleted"))
    incoming = d.filter("doc_id % 7 <> 2").select(F.col("doc_id").alias("external_id"), F.when(F.col("doc_id") % 5 == 1, F.sha2("h", 256)).otherwise(F.col("h")).alias("hash"))
    return stored, incoming


SNAPSHOT_SQL = """d AS (SELECT doc_id, sha256(text) AS h FROM documents),
stored AS (SELECT doc_id AS external_id, h AS hash, doc_id % 13 = 0 AS deleted FROM d WHERE doc_id % 11 <> 3),
incoming AS (SELECT doc_id AS external_id, CASE WHEN doc_id % 5 = 1 THEN sha256(h) ELSE h END AS hash FROM d WHERE doc_id % 7 <> 2)"""


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chunks of documents."""
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.sha2(F.concat_ws("/", "l_partkey", "l_suppkey"), 256).alias("hash"))


CHUNK_SQL = LINES_SQL + ", c AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS chunk_index, l_orderkey * 10 + l_linenumber AS id, sha256(l_partkey || '/' || l_suppkey) AS hash FROM lines)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the turn before it as the reference."""
    c = load(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return c.filter("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("generated"), "reference")


ANSWER_SQL = "a AS (SELECT c.conv_id, c.turn, c.text AS generated, b.text AS reference FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.role = 'assistant')"


def retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order lines as ranked results; returned parts are relevant."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("rank"))
    relevant = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("chunk_id"))
    return rows, relevant, load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))


RETRIEVED_SQL = """r AS (SELECT l_orderkey AS case_id, l_partkey AS chunk_id, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2),
rel AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS chunk_id FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT case_id, count(*) AS n FROM rel GROUP BY 1),
h AS (SELECT r.case_id, min(rank) AS first, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20 FROM r JOIN rel USING (case_id, chunk_id) GROUP BY 1)"""
