"""Shared plumbing of the corpus operators: tables, shared storage, keys, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.session import stored_path


#: Bytes of a batch that crosses to or from a Python worker; Spark's own default, 64 MB, is held several times over there.
ARROW_BATCH = "4m"


def configured(spark: SparkSession) -> SparkSession:
    """The session, with batches for Python workers bounded by bytes, so that long texts make small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of a test-data folder; only Spark's readers touch the path."""
    configured(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Unlike a local checkpoint the copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = stored_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_estimate(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, from file sizes; it starts no job. 0 if there is none."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else 0


def parts_for(df: DataFrame, mb_each: float, least: int = 1) -> int:
    """A partition count in proportion to the input."""
    spark = df.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, floor, -(-bytes_estimate(df) // int(mb_each * 1e6)))


def fold(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> tuple[DataFrame, bool]:
    """``docs`` as (key, doc_id, text), and the column ``keep``, and whether keys may repeat: key is unique for each (doc_id, text) and ascends with doc_id.

    Integers that are unique and not null are their own keys, found out by counting ids only.
    Otherwise distinct (doc_id, text hash) pairs are numbered in sorted order (nulls first),
    so repeated rows are one document and rows that share an id but not a text are several.
    Null texts become empty ones.
    """
    extra = [keep] if keep else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    odd = base.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull())
    if isinstance(base.schema["doc_id"].dataType, IntegralType) and odd.limit(1).count() == 0:
        # never null, and known not to be, so joins add no filter that would set their exchanges of the texts apart
        return base.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), "doc_id", "text", *extra), False
    named = base.withColumn("th", F.sha2("text", 256))
    numbers = stored(named.select("doc_id", "th").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "th").withColumn("key", F.monotonically_increasing_id()), "keys")
    n = numbers.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "key")
    return named.join(n, named["doc_id"].eqNullSafe(n["_d"]) & (named["th"] == n["_t"])).select("key", "doc_id", "text", *extra), True
