"""How repeated windows are found on a cluster, whatever their unit: the frame of substring dedup.

A window is ``width`` consecutive units (words or bytes) of one document. Consecutive windows that
share a minimiser form a super-k-mer (``tokens.super_kmers``), so equal windows always lie in
super-k-mers of one minimiser, and minimisers are dealt out to buckets by hash.

0. Of documents with one text (by its SHA-256) the one of least id stands for all.
1. *Anchors*: a row (minimiser, document, ordinal) for each super-k-mer, about one for each half window.
2. Minimisers that occur once are dropped: their windows occur once. This is a count with partial aggregation and a join
   by minimiser (whose large partitions Spark splits).
3. The ordinals that are left go back to their documents, which send each such super-k-mer to its bucket as one
   packed string.
4. A bucket orders its windows and reports the repeated ones as ranges of units. A minimiser with over ``hot`` super-k-mers
   is no bucket: its windows travel as 128-bit digests and are counted by an aggregate with partial aggregation,
   so that no task ever holds a group of unbounded size.
5. The ranges go back to the documents.

The texts are dealt out by document once; steps 1, 3 and 5 use the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import keyed, parts_for, stored

HOT = 20_000
#: Bytes of packed strings that a bucket task orders at a time, if its groups allow.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    width: int
    gram: int
    #: (bytes, offsets) -> (unit values uint64, row of each unit, pack(first unit, last unit + 1) -> bytes)
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]]
    #: packed strings, documents, starts -> (index of string, first window, last window + 1) of repeated runs of windows
    order: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: packed string -> the 128-bit digest of each of its windows, as two uint64
    digests: Callable[[bytes], tuple[np.ndarray, np.ndarray]]
    #: whether the first occurrence of a window is not counted as a repeat
    spare_first: bool


_GRAM = tokens.Hasher(41)


def _super_kmers(unit: Unit, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """(first row, row, ordinal, first unit of the row, start unit, windows, minimiser) by slices of a column."""
    for lo, hi, data, offs in tokens.slices(column):
        values, rows, pack = unit.split(data, offs)
        grams = _GRAM.grams(values, unit.gram)
        s, n, at = tokens.super_kmers(grams, unit.gram, rows, unit.width)
        row = rows[s]
        first = np.searchsorted(rows, np.arange(hi - lo))
        ordinal = np.arange(len(s)) - np.searchsorted(row, row)
        yield lo, row, ordinal, first[row] if len(s) else s, np.column_stack([s, n]), grams[at] if len(at) else np.zeros(0, np.uint64), pack


def anchors(base: DataFrame, unit: Unit, id_col: str) -> DataFrame:
    """(m, key, ord) of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, row, ordinal, _, _, m, _ in _super_kmers(unit, batch.column(1)):
                for at in range(0, len(m), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(m[part].view(np.int64)), pa.array(keys[lo + row[part]]), pa.array(ordinal[part].astype(np.int32))], ["m", "key", "ord"])

    return base.select("key", "text", id_col).mapInArrow(tokens.trimmed(run), "m long, key long, ord int")


def packed(joined: DataFrame, unit: Unit, id_col: str) -> DataFrame:
    """(m, key, start, packed): the super-k-mers whose ordinals are in ``ords``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, row, ordinal, first, runs, m, pack in _super_kmers(unit, batch.column(1)):
                if not len(m):
                    continue
                top = int(row.max()) + 1
                begins = np.searchsorted(row, np.arange(top + 1))
                live = np.zeros(len(m), np.int8)
                chosen = batch.column(2).slice(lo, top)
                flat = chosen.flatten().to_numpy(zero_copy_only=False)
                sizes = chosen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                live[np.repeat(begins[:-1], sizes) + flat] = 1
                picked = np.flatnonzero(live)
                for at in range(0, len(picked), 20_000):
                    part = picked[at : at + 20_000]
                    texts = [pack(s, s + n + unit.width - 1) for s, n in runs[part].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(m[part].view(np.int64)), pa.array(keys[lo + row[part]]), pa.array(runs[part, 0] - first[part]), pa.array(texts, pa.binary())], ["m", "key", "start", "packed"])

    # the id goes along unused, so that the exchange below has the columns of the last one
    return joined.select("key", "text", "ords", id_col).mapInArrow(tokens.trimmed(run), "m long, key long, start long, packed binary")


def ordered(cold: DataFrame, unit: Unit, parts: int) -> DataFrame:
    """(key, s, e): repeated ranges of units, bucket by bucket; a task streams its buckets in order of minimiser."""

    def ranges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys, starts = table.column("key").to_numpy(), table.column("start").to_numpy()
        at, first, last = unit.order(table.column("packed").to_pylist(), keys, starts)
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(starts[at] + first), pa.array(starts[at] + last + unit.width - 1)], ["key", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            m = batch.column(0).to_numpy(zero_copy_only=False)
            change = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1]) if len(m) else np.zeros(0, int)
            if held and len(m) and held[-1].column(0)[-1].as_py() != m[0] and size >= TOGETHER:
                yield ranges(held)
                held, size = [], 0
            done = 0
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(3)).to_numpy())]) if len(m) else np.zeros(1)
            for begin in change[1:].tolist():
                if size + sizes[begin] - sizes[done] >= TOGETHER:
                    held.append(batch.slice(done, begin - done))
                    yield ranges(held)
                    held, size, done = [], 0, begin
            held.append(batch.slice(done))
            size += int(sizes[-1] - sizes[done])
        if held:
            yield ranges(held)

    return cold.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(tokens.trimmed(run), "key long, s long, e long")


def counted(hot: DataFrame, unit: Unit) -> DataFrame:
    """(key, s, e) for the windows of hot minimisers, counted as 128-bit digests by Spark's aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                pairs = [unit.digests(p) for p in part.column(2).to_pylist()]
                sizes = [len(a) for a, _ in pairs]
                offset = np.concatenate([np.arange(n) for n in sizes])
                keys, starts = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([p[i] for p in pairs]).view(np.int64)) for i in (0, 1)), pa.array(keys), pa.array(starts + offset)], ["a", "b", "key", "s"])

    rows = hot.select("key", "start", "packed").mapInArrow(tokens.trimmed(run), "a long, b long, key long, s long")
    found = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "s")).alias("first")).filter("n > 1")
    both = rows.join(found.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    if unit.spare_first:
        both = both.filter((F.col("key") != F.col("first.key")) | (F.col("s") != F.col("first.s")))
    return both.select("key", "s", (F.col("s") + unit.width).alias("e"))


def repeated(docs: DataFrame, unit: Unit, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, keep: str | None = None) -> DataFrame:
    """(doc_id, text, spans, whole): every document with the ranges of units, array<struct<s,e>>, that repeated windows cover.

    Where ``whole`` holds, every window is repeated.

    With ``keep``, that column takes the place of the id.
    """
    name = keep or "doc_id"
    rows, repeats = keyed(docs, id_col, text_col, keep)
    rows = rows.select("key", name, "text")
    base = stored(rows.dropDuplicates(["key"]), "documents") if repeats else rows
    hashed = base.select("key", F.unhex(F.sha2("text", 256)).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = hashed.join(groups.select(F.col("h").alias("_h"), "first"), F.col("h") == F.col("_h"))
    copies = stored(copies.select(F.col("key").alias("_c"), (F.col("key") != F.col("first")).alias("again")), "copies")
    parts = parts_for(base, 8)
    dealt = base.repartition(parts, "key").join(copies, F.col("key") == F.col("_c"), "left")
    seen = dealt.filter(~F.coalesce(F.col("again"), F.lit(False)))

    # counted where the texts lie, copies and all: that can only let through more
    several = stored(anchors(base, unit, name).groupBy("m").count().filter("count > 1").select(F.col("m").alias("_m"), (F.col("count") > hot).alias("many")), "minimisers")
    found = anchors(seen, unit, name)
    any_hot = several.filter("many").limit(1).count() > 0

    def sent(many: bool) -> DataFrame:
        ords = found.join(several.filter(F.col("many") == many), F.col("m") == F.col("_m")).groupBy(F.col("key").alias("_k")).agg(F.collect_list("ord").alias("ords"))
        return packed(seen.join(ords, F.col("key") == F.col("_k")), unit, name)

    ranges = ordered(sent(False), unit, parts)
    if any_hot:
        ranges = ranges.unionByName(counted(sent(True), unit))
    spans = ranges.groupBy(F.col("key").alias("_r")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    # of copies, the first one's windows are repeats only if first occurrences count
    whole = F.coalesce(F.col("again") if unit.spare_first else F.col("again").isNotNull(), F.lit(False))
    out = dealt.join(spans, F.col("key") == F.col("_r"), "left").select("key", name, "text", "spans", whole.alias("whole"))
    if repeats:
        out = rows.join(out.select(F.col("key").alias("_key"), "spans", "whole"), F.col("key") == F.col("_key"))
    return out.select(name, "text", "spans", "whole")
