"""Usage and cost roll-ups over an append-only fact table.

Facts: request_id, operation, model, provider, prompt_tokens, completion_tokens, cost decimal (null: unpriced),
latency_ms, created_at. A sum of costs is null unless every row is priced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranges import percentiles


def all_or_null(cost: str = "cost") -> Column:
    """The sum if every row has a cost, else null; null for no rows."""
    return F.when((F.count(cost) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(cost))


def total_columns() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("request_id").alias("requests"),
        F.coalesce(F.sum("prompt_tokens"), zero).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), zero).alias("completion_tokens"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), zero).alias("total_tokens"),
        all_or_null().cast("double").alias("cost"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
    ]


def between(facts: DataFrame, start: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Equalities and a half-open time range; an empty range is an error."""
    if start and until and until <= start:
        raise ValueError("the range must end after it starts")
    if start:
        facts = facts.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if until:
        facts = facts.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    for column, value in equal.items():
        facts = facts.filter(F.col(column) == value)
    return facts


def totals(facts: DataFrame) -> DataFrame:
    return facts.agg(*total_columns())


def breakdowns(facts: DataFrame) -> DataFrame:
    """Totals by operation, model and provider: dimension, key and totals."""
    out = None
    for dimension in ("operation", "model", "provider"):
        one = facts.groupBy(F.lit(dimension).alias("dimension"), F.col(dimension).alias("key")).agg(*total_columns())
        out = one if out is None else out.unionByName(one)
    return out


def summary(facts: DataFrame) -> DataFrame:
    """The totals as dimension total, and all breakdowns, each with whether its cost is complete."""
    whole = facts.agg(*total_columns()).select(F.lit("total").alias("dimension"), F.lit("").alias("key"), "*")
    return whole.unionByName(breakdowns(facts)).withColumn("cost_complete", F.col("cost").isNotNull())


def performance(facts: DataFrame) -> DataFrame:
    """Requests' count, mean latency, cost, and how many are priced."""
    priced = F.count("cost")
    return facts.agg(F.count(F.lit(1)).alias("messages"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"), all_or_null().cast("double").alias("cost"), priced.alias("priced"), (F.count(F.lit(1)) - priced).alias("unpriced"))


def by_request(facts: DataFrame) -> DataFrame:
    """Tokens and all-or-null cost of each request, over its operations."""
    return facts.groupBy("request_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), all_or_null().cast("double").alias("cost"))


def audit(facts: DataFrame) -> DataFrame:
    """Sums of each request by operation, model and provider."""
    return facts.groupBy("request_id", "operation", "model", "provider").agg(F.count(F.lit(1)).alias("records"), F.sum("prompt_tokens").alias("prompt_tokens"), all_or_null().cast("double").alias("cost"))


def unlinked(results: DataFrame) -> DataFrame:
    """(unlinked): results without a case."""
    return results.agg(F.count_if(F.col("case_id").isNull()).alias("unlinked"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """(status, n): how often each status or error occurs."""
    return rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def total_count(rows: DataFrame) -> DataFrame:
    """(total): what a page's rows are counted out of."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def stage_means(runs: DataFrame, stages: list[str]) -> DataFrame:
    """The mean latency of each stage, 0 for none."""
    return runs.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in stages])


def page(facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, ids breaking ties."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset at least 0")
    return facts.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


SHARES = {f"p{q}": q / 100 for q in (50, 90, 95, 99)}


def latencies(rows: DataFrame, by: list[str], column: str, *more: Column) -> DataFrame:
    """n, mean, exact percentiles, min and max of a column by group, 0 where a group has no values, and further aggregates."""
    none = F.lit(0.0)
    plain = rows.groupBy(*by).agg(F.count(column).alias("n"), F.round(F.coalesce(F.avg(column), none), 6).alias("mean"), F.coalesce(F.min(column), none).alias("min"), F.coalesce(F.max(column), none).alias("max"), *more)
    found = percentiles(rows, by, column, SHARES).withColumnsRenamed({c: f"_{c}" for c in by})
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    out = plain.join(found, met, "left").withColumns({p: F.round(F.coalesce(p, none), 6) for p in SHARES})
    return out.drop(*[f"_{c}" for c in by])


def latency_summary(runs: DataFrame, elapsed_s: float) -> DataFrame:
    """Percentiles of successful rows, throughput and error rate; ``runs`` has latency_ms and failed."""
    good = runs.select(F.lit(0).alias("all"), F.when(~F.col("failed"), F.col("latency_ms")).alias("ok_ms"), F.col("failed").cast("long").alias("failed"))
    one = runs.sparkSession.range(1).select(F.lit(0).alias("_all"))
    out = one.join(latencies(good, ["all"], "ok_ms", F.sum("failed").alias("errors"), F.count(F.lit(1)).alias("every")), F.col("all") == F.col("_all"), "left")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    values = [F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", *SHARES, "min", "max")]]
    return out.select(*values, share(F.col("every"), F.lit(float(elapsed_s))).alias("throughput"), share(F.col("errors"), F.col("every").cast("double")).alias("error_rate"))


def stage_latencies(stages: DataFrame) -> DataFrame:
    """Per-stage percentiles of (stage, ms)."""
    return latencies(stages, ["stage"], "ms")


def histogram(facts: DataFrame, buckets: list[float], column: str = "latency_ms") -> DataFrame:
    """Cumulative counts at upper bounds, the last unbounded."""
    bounds = F.array(*[F.lit(float(b)) for b in buckets], F.lit(float("inf")))
    rows = facts.filter(F.col(column).isNotNull()).select(F.explode(F.filter(bounds, lambda b: F.col(column) <= b)).alias("le"))
    counted = rows.groupBy("le").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_number("le", 1)).alias("le"), "n")


def priced(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """Costs by exact (provider, model), prices per million tokens; an unknown model's is null."""
    rows = facts.join(prices, ["provider", "model"], "left")
    million = F.lit(1_000_000).cast("decimal(10,0)")
    cost = (F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")) / million
    return rows.withColumn("estimated_cost", F.round(cost, 8).cast("double"))
