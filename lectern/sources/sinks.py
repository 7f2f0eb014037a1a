"""Sinks: reports, deterministic data sets and their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(rows: DataFrame) -> DataFrame:
    """(id, line): each row as JSON with its columns in order of name."""
    return rows.select(F.col("id"), F.to_json(F.struct(*sorted(rows.columns))).alias("line"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: a SHA-256 over the sorted SHA-256 values of the canonical lines, and the count.

    Hashes are combined in ranges first, so no task concatenates all lines.
    """
    hashed = canonical(rows).select(F.sha2("line", 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 3).alias("range")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("p"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "p"))), lambda x: x["p"]), "\n"), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in order of id."""
    canonical(rows).orderBy("id").select("line").write.mode("overwrite").text(path)


_FORMATS = {"json": {}, "csv": {"header": "true"}, "parquet": {}}


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report as json, csv (columns in order of name) or parquet, published by one manifest.

    Rows go to a folder of their own below ``path``; then the file ``_current``, which names it, is replaced in one step. So a reader sees the old report
    until the new one is whole, and a write that is killed at any moment changes nothing. The report before stays for those who still read it.
    """
    import uuid

    spark, version = rows.sparkSession, f"{kind}-{uuid.uuid4().hex}"
    rows.select(*sorted(rows.columns)).write.format(kind).options(**_FORMATS[kind]).save(f"{path}/{version}")
    before = current_version(spark, path)
    _publish(spark, path, version)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(hadoop.Path(path)):
        if s.isDirectory() and s.getPath().getName() not in (version, before):
            fs.delete(s.getPath(), True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report that is published at ``path``."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    kind = version.partition("-")[0]
    return spark.read.format(kind).options(**_FORMATS[kind]).load(f"{path}/{version}")


def current_version(spark: SparkSession, path: str) -> str | None:
    """What the manifest at ``path`` names; None without one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path, "_current")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one by a rename over the manifest."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    fresh, at = hadoop.Path(path, f"_{version}"), hadoop.Path(path, "_current")
    fs = at.getFileSystem(conf)
    fresh, at = fs.makeQualified(fresh), fs.makeQualified(at)
    stream = fs.create(fresh)
    stream.writeUTF(version)
    stream.close()
    kinds = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    hadoop.FileContext.getFileContext(at.toUri(), conf).rename(fresh, at, over)


def markdown_table(rows: DataFrame, limit: int = 100) -> str:
    """A bounded report table."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in rows.limit(limit).collect()]
    return "\n".join(lines) + "\n"
