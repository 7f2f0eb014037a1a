"""Cursor-like incremental sync as a Structured Streaming query.

Each run takes the files that came since the last one (availableNow). A batch writes its newest rows as a delta of its own
number, so a batch that is run again changes nothing, and a batch costs what came, not what is stored. After every ``DELTAS``
deltas they are merged into a new base, again in a folder of its own number; readers merge the last base with the deltas after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, cursor: str) -> DataFrame:
    """One row a key: the greatest cursor; of rows that tie, the greatest by the other columns in order of name."""
    w = Window.partitionBy(key).orderBy(F.col(cursor).desc(), *[F.col(c).desc() for c in sorted(rows.columns) if c not in (key, cursor)])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


DELTAS = 16


def sync(spark: SparkSession, source: str, table: str, checkpoint: str, schema: str, key: str, cursor: str, deltas: int = DELTAS) -> DataFrame:
    """Run until the source's present files are in; returns the table. Older rows never replace newer ones."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        newest(batch, key, cursor).write.mode("overwrite").parquet(f"{table}/delta={epoch}")
        if (epoch + 1) % deltas == 0 and epoch not in finished(spark, table, "base"):
            current(spark, table, schema, key, cursor).write.mode("overwrite").parquet(f"{table}/base={epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, table, schema, key, cursor)


def finished(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the table's folders of a kind that were written to the end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str, schema: str, key: str, cursor: str) -> DataFrame:
    """The table's newest row of each key: of the last base and the deltas after it."""
    base = finished(spark, table, "base")[-1:]
    after = [d for d in finished(spark, table, "delta") if not base or d > base[0]]
    paths = [f"{table}/base={n}" for n in base] + [f"{table}/delta={n}" for n in after]
    return newest(spark.read.schema(schema).parquet(*paths), key, cursor) if paths else spark.createDataFrame([], schema)


def windowed_usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by event type, with a watermark; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


#: Settings while a stream with keyed state starts: a store on disk, whose instances share their memory and reserve no disk.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def keyed_sync(spark: SparkSession, source: str, checkpoint: str, schema: str, key: str, cursor: str) -> DataFrame:
    """``sync`` with the newest row of each key as keyed state of the stream, on disk and in ``checkpoint``; returns it as a table.

    A batch reads and writes the state of its own keys only. The state is a maximum, by the rule of ``newest``, so a batch that comes
    again, a restarted run and older rows change nothing.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    others = [cursor, *sorted(c for c in stream.columns if c not in (key, cursor))]
    newest_rows = stream.groupBy(key).agg(F.max(F.struct(*others)).alias("row"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = newest_rows.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    held = spark.read.format("statestore").load(checkpoint)
    row = F.col("value")[held.schema["value"].dataType.fields[0].name]
    return held.select(F.col("key")[key].alias(key), *[row[c].alias(c) for c in others]).select(*stream.columns)
