"""Exact deduplication as a stateful stream, in DataFrame operations only.

Files of documents are read as a stream. For each digest of a text the state, kept on disk by RocksDB without any expiry,
retains how many rows have it, and the identifier and the locator (file and row) of the one that stays: of equal texts, the
row of greatest id. A micro-batch is summed up before its shuffle, so a text that a third of all rows have is one row a task, and
a stream that is started again on its checkpoint reads new files only.

What the state holds is then read back as a table and met by the documents. A digest is not trusted: every row that hits a
digest of several rows is compared, byte by byte, with the content at the locator. Digests under which any comparison
fails are resolved by their whole texts instead.

Cases: a null text is an empty one; ids may be null and are the least; of rows that repeat both id and text, the one of
greatest locator stays; rows that share an id but not a text are documents of their own; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.llm.common import stored
from lectern.session import stored_path

#: Settings while a stream starts: keyed state on disk, with memory of all stores of an executor bounded together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each store, however small, reserves several MB of disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of files that a micro-batch reads.
BATCH = 64 << 30


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(files: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], with_text: bool) -> DataFrame:
    """(doc_id, digest, locator) of every row, and the text if wanted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return files.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), locator.alias("locator"), *([text.alias("text")] if with_text else []))


def ingest(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = digest_of, batch: int = BATCH) -> StreamingQuery:
    """Bring the state at ``checkpoint`` up to date with the Parquet files at ``path``, and return the ended query."""
    schema = spark.read.parquet(path).schema
    # a stream takes a plain path for a folder; as a pattern it may name one file, too
    pattern = re.sub(r"([\[\]{}*?\\])", r"\\\1", path.rstrip("/")[:-1]) + f"[{path.rstrip('/')[-1]}]"
    files = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch)).parquet(pattern)
    # the greatest id, then the greatest locator; null ids are the least
    last = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "locator")
    groups = _rows(files, id_col, text_col, digest, False).groupBy("digest").agg(F.max(last).alias("last"), F.count(F.lit(1)).alias("size"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return query


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_id, keep_at, size): what the state at ``checkpoint`` holds after its last batch."""
    held = spark.read.format("statestore").load(checkpoint)
    last, size = (F.col("value")[f.name] for f in held.schema["value"].dataType.fields)
    return held.select(F.col("key.digest").alias("digest"), last["doc_id"].alias("keep_id"), last["locator"].alias("keep_at"), size.alias("size"))


def members(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row at ``path``, by the state at ``checkpoint`` and whole texts."""
    groups = stored(state(spark, checkpoint), "digests")
    files = spark.read.parquet(path)
    rows = _rows(files, id_col, text_col, digest, True)
    own = F.sha2("text", 256).alias("text_sha256")
    known = groups.withColumnRenamed("digest", "_digest")
    single = known.filter("size = 1")
    several = known.filter("size > 1").select("_digest", "keep_id", "keep_at", "size")
    # rows alone under their digest need no comparison, and their texts stay where they are
    alone = _rows(files, id_col, text_col, digest, True).select("doc_id", "digest", own).join(single.select("_digest"), F.col("digest") == F.col("_digest"))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = stored(rows.join(several, F.col("digest") == F.col("_digest")).select("doc_id", "digest", "locator", "keep_id", "keep_at", "size", "text"), "hits")
    content = hits.filter(F.col("locator") == F.col("keep_at")).select(F.col("digest").alias("_d"), F.col("text").alias("_kept"))
    # a plain join of two shuffled sides, so a large group is split where it is read
    checked = stored(hits.join(content, F.col("digest") == F.col("_d")).select("doc_id", "digest", "locator", "keep_id", "keep_at", "size", own, (F.col("text") == F.col("_kept")).alias("same")), "checked")
    broken = checked.filter(~F.col("same")).select(F.col("digest").alias("_b")).distinct()
    if broken.isEmpty():
        return alone.unionByName(_result(checked))
    broken = stored(broken, "collisions")
    same = checked.join(broken, F.col("digest") == F.col("_b"), "left_anti")
    torn = stored(hits.join(broken, F.col("digest") == F.col("_b"), "left_semi").select("doc_id", "locator", "text"), "torn")
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "locator"))
    by_text = torn.groupBy(F.col("text").alias("_t")).agg(last.alias("last"), F.count(F.lit(1)).alias("size"))
    whole = torn.join(by_text, F.col("text") == F.col("_t")).select("doc_id", "locator", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("keep_at"), "size", own)
    return alone.unionByName(_result(same)).unionByName(_result(whole))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("locator") == F.col("keep_at")).alias("kept"), "text_sha256")


def report(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """``members`` of the files at ``path``, by a stream over all of them with a state of its own."""
    checkpoint = stored_path(spark, "exact-state")
    ingest(spark, path, checkpoint, id_col, text_col, digest)
    return members(spark, path, checkpoint, id_col, text_col, digest)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The table is stored first, as locators name files."""
    path = stored_path(docs.sparkSession, "documents")
    docs.write.parquet(path)
    spark = docs.sparkSession
    checkpoint = stored_path(spark, "exact-state")
    ingest(spark, path, checkpoint, id_col, text_col)
    keepers = state(spark, checkpoint).select(F.col("keep_at.file").alias("_file"), F.col("keep_at.row").alias("_row"))
    placed = spark.read.parquet(path)
    placed = placed.select(F.struct(*[F.col(f"`{c}`") for c in placed.columns]).alias("_doc"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    return placed.join(keepers, (F.col("_f") == F.col("_file")) & (F.col("_r") == F.col("_row")), "left_semi").select("_doc.*")
