"""Running sums and exact percentiles over values dealt out by range, so that no task holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import stored_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """A copy in the shared folder: what follows reads one and the same dealing, whatever executors are lost."""
    spark = df.sparkSession
    path = stored_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, or distinct values, up to which one task may hold a whole group; more are dealt out by range, with the same results.
WHOLE = 1_000_000


def running_sums(rows: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, for each (new: old) of ``sums``, the running sum of old within the group ``by`` in order of ``order`` (distinct within a group).

    Rows are dealt out by range of (group, order); each range runs for itself and starts from what the ranges before it add
    up to, a table of one row for each range and group.
    """
    spark = rows.sparkSession
    key = F.col(order).desc() if descending else F.col(order).asc()
    rows = stored(rows, "summed")
    if rows.count() <= WHOLE:
        own = Window.partitionBy(*by).orderBy(key)
        return rows.withColumns({new: F.sum(old).over(own) for new, old in sums.items()})
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = stored(rows.repartitionByRange(n, *by, key).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(old).alias(f"_t{i}") for i, old in enumerate(sums.values())])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0).cast("long")).alias(f"_s{i}") for i in range(len(sums))])
    own = Window.partitionBy(*by, "_part").orderBy(key)
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_p"))
    run = dealt.join(starts, met).withColumns({new: F.sum(old).over(own) + F.col(f"_s{i}") for i, (new, old) in enumerate(sums.items())})
    return run.select(*rows.columns, *sums)


def percentiles(rows: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each of ``shares``): exact percentiles, linear between ranks, of each group's values that aren't null.

    Up to WHOLE distinct values in all, by an estimate, counts of equal values are merged in one aggregate. With more, equal values are
    counted first, and a rank's value is found by running counts.
    """
    value = F.col(column).cast("double")
    found = rows.agg(F.approx_count_distinct(F.when(value.isNotNull(), F.xxhash64(*by, value))).alias("n")).first()
    if found.n <= WHOLE:
        every = F.percentile(value, F.array(*[F.lit(float(q)) for q in shares.values()]))
        known = rows.filter(value.isNotNull()).groupBy(*by).agg(every.alias("_q"))
        return known.select(*by, *[F.element_at("_q", i).alias(name) for i, name in enumerate(shares, 1)])
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sums(counted, by, "_v", {"_hi": "_c"})
    sizes = run.groupBy(*[F.col(c).alias(f"_n{i}") for i, c in enumerate(by)]).agg(F.max("_hi").alias("_n"))
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_n{i}")) for i, c in enumerate(by)])
    ranked = run.join(sizes, met)
    at = lambda rank: F.max(F.when((F.col("_hi") - F.col("_c") <= rank) & (rank < F.col("_hi")), F.col("_v")))
    place = {name: (F.col("_n") - 1) * F.lit(q) for name, q in shares.items()}
    ends = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"_lo_{name}"), at(F.ceil(p)).alias(f"_hi_{name}"))]
    found = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    return found.select(*by, *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - F.floor(p))).alias(name) for name, p in place.items()])
