"""Evaluation reports: experiments, comparison rows, failure lists and rewrite analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retrieval settings of an engine without configuration: candidates of a channel, of reranking, and fusion's parameters. Fixed values.
DEFAULTS = {"keyword_top_k": 30, "vector_top_k": 30, "rerank_top_n": 8, "rrf_k": 60, "keyword_weight": 0.5, "vector_weight": 0.5}
#: The experiments of a comparison and what each changes. Fixed values.
EXPERIMENTS = {
    "keyword-only": {"retrieval_mode": "keyword", "enable_reranker": False},
    "vector-only": {"retrieval_mode": "vector", "enable_reranker": False},
    "hybrid": {"retrieval_mode": "hybrid", "enable_reranker": False},
    "hybrid-reranked": {"retrieval_mode": "hybrid", "enable_reranker": True},
    "raw-query": {"enable_query_rewrite": False},
    "rewritten-query": {"enable_query_rewrite": True},
    "top-k-5": {"top_k": 5},
    "top-k-10": {"top_k": 10},
    "top-k-20": {"top_k": 20},
}


def settings() -> list[tuple[str, str, str]]:
    """(experiment, setting, value): the matrix as rows."""
    return [(name, key, str(value).lower()) for name, settings in EXPERIMENTS.items() for key, value in settings.items()]


def planned_runs(cases: DataFrame) -> DataFrame:
    """(case_id, experiment, setting, value): what every experiment of the matrix sets for every case."""
    named = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("experiment", "setting", "value"), row, strict=True)]) for row in settings()])
    return cases.select("case_id", F.inline(named))


def comparison(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row an experiment: cases, failures, and metric means over cases that didn't fail."""
    good = F.col("error").isNull()
    return results.groupBy("experiment").agg(F.count(F.lit(1)).alias("cases"), F.sum((~good).cast("long")).alias("failed"), *[F.round(F.avg(F.when(good, F.col(m))), 9).alias(m) for m in metrics])


def failed_cases(cases: DataFrame, errors: DataFrame, metrics: list[str]) -> DataFrame:
    """A record of every case that failed: its question as the query, no answer, no evidence, no metrics, and the error."""
    return cases.select("case_id", "question").join(errors.select("case_id", "error"), "case_id").select("case_id", "question", F.lit("").alias("generated_answer"), F.col("question").alias("rewritten_query"), F.lit(False).alias("predicted_answerable"), *[F.lit(None).cast("double").alias(m) for m in metrics], "error")


def failures(results: DataFrame, worst: int = 10) -> DataFrame:
    """(list, case_id, value) of a report's lists: errors, answerable cases without a relevant chunk among 20, imperfect citations, and the worst by token F1."""
    good = results.filter("error is null")
    said = lambda rows, name, value: rows.select(F.lit(name).alias("list"), "case_id", value.cast("double").alias("value"))
    return (
        said(results.filter("error is not null"), "error", F.lit(None))
        .unionByName(said(results.filter("answerable and recall_20 = 0"), "missed", F.col("recall_20")))
        .unionByName(said(results.filter("predicted_answerable and coalesce(citation_precision, 0) < 1"), "citation_error", F.coalesce("citation_precision", F.lit(0.0))))
        .unionByName(said(good.orderBy(F.coalesce("token_f1", F.lit(0.0)), "case_id").limit(worst), "worst", F.coalesce("token_f1", F.lit(0.0))))
    )


def rewrite_errors(switched: Column, independent: Column, changed: Column) -> dict[str, Column]:
    """Whether a query was rewritten though the topic had switched, and though it needed no rewrite."""
    return {"topic_switch_error": switched & changed, "unnecessary_rewrite": independent & changed}


def rewrite_analysis(raw: DataFrame, rewritten: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """One row over the cases that failed in neither run: mean recalls, their differences, and the rates of both rewrite errors; none without such cases.

    Both have (case_id, error, recall_k); ``rewritten`` has topic_switch, query_independent, topic_switch_error and unnecessary_rewrite, too.
    """
    a = raw.filter("error is null").select("case_id", *[F.col(f"recall_{k}").alias(f"_a{k}") for k in cuts])
    both = a.join(rewritten.filter("error is null"), "case_id")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 9)
    rate = lambda of, hit: F.round(F.coalesce(F.avg(F.when(F.col(of), F.coalesce(F.col(hit).cast("double"), F.lit(0.0)))), F.lit(0.0)), 9)
    columns = [x for k in cuts for x in (mean(F.col(f"_a{k}")).alias(f"raw_recall_{k}"), mean(F.col(f"recall_{k}")).alias(f"rewritten_recall_{k}"))]
    out = both.agg(F.count(F.lit(1)).alias("cases"), *columns, rate("topic_switch", "topic_switch_error").alias("topic_switch_error_rate"), rate("query_independent", "unnecessary_rewrite").alias("unnecessary_rewrite_rate"))
    return out.filter("cases > 0").withColumns({f"recall_delta_{k}": F.round(F.col(f"rewritten_recall_{k}") - F.col(f"raw_recall_{k}"), 9) for k in cuts})
