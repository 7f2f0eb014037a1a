"""Ranked lexical search, score at a time over postings in the order of their impacts.

Scores. A term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))), its impact in a document with tf occurrences
(1000000000 tf) div (1000 tf + 20 m), where m = 50 + (50 n N) div L; a document scores the sum of w * impact over a query's distinct terms.
N and L count the documents with a term and all their terms, df the documents that hold one.

Documents are dealt out in shards of bounded size, queries in blocks of bounded size, and every block meets every shard in a task
of its own. A task inverts its shard: postings of a term lie in the order of descending impact, those of equal impact together. For each query it
goes down all its terms' postings by w * impact, in layers of ever smaller values, and adds them to the documents' sums. What a document may
still get is bounded by the value that each term's list has come to. Once no document outside the best k so far, nor any that hasn't been met, can pass
the k-th sum, the documents that still can are scored in full, from the shard's rows, and the best k of them leave the task. So what is shuffled
after that is k rows a query and shard.

Cases: null and empty texts have no terms and are never found; queries without terms, or whose terms are nowhere, have no rows; rows that share an
id are documents of their own; null ids come first among equal scores; queries with equal ids are queries of their own and ranked alone;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bytes_estimate, stored

K = 50
#: Distinct terms of all queries that are sent to the tasks that count; with more, the tasks count all terms.
KNOWN_TERMS = 200_000
#: Bytes of counted documents in a shard, and queries in a block.
SHARD, BLOCK = 16 << 20, 2000
#: A layer goes down to this part of the value where it starts.
LAYER = 0.75
#: Candidates that a task would rather score in full than go on.
ENOUGH = 256

# a byte to a space if it is no part of a term; capital letters of ASCII to small ones. The pattern's classes leave letters, digits and all beyond ASCII.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, with repeats, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FORM).split()


def counted(docs: DataFrame, known: frozenset[bytes] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: its number of terms, and the distinct ones, of ``known`` if given, with their counts."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = base.select("doc_id", F.lit(0).cast("long").alias("n"), F.array(F.lit("")).alias("terms"), F.array(F.lit(0)).alias("tfs")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                all_terms = terms(text.as_py())
                tally = Counter(all_terms)
                mine = tally.keys() if known is None else tally.keys() & known
                sizes.append(len(all_terms))
                names.extend(mine)
                tfs.extend(map(tally.__getitem__, mine))
                ends.append(len(names))
            at = pa.array(ends, pa.int32())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return base.mapInArrow(count, out)


class Shard:
    """Documents of a shard, inverted: postings by term, in the order of descending impact."""

    def __init__(self, m: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        """``term`` and ``tf`` are of all documents in turn, ``ends`` where each document's begin and end."""
        doc = np.repeat(np.arange(len(m)), np.diff(ends))
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        self.n_docs, self.ends, self.term, self.impact = len(m), ends, term, impact
        order = np.lexsort((-impact, term))
        self.doc, self.by_impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, query: np.ndarray, weights: np.ndarray, k: int, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the best ``k`` by score, then by ``rank_of``, among those with a score above 0."""
        some = np.flatnonzero((weights > 0) & (self.starts[query + 1] > self.starts[query]))
        query, weights = query[some], weights[some]
        sums = np.zeros(self.n_docs, np.int64)
        if not len(query):
            return np.zeros(0, np.int64), sums[:0]
        at, end = self.starts[query].copy(), self.starts[query + 1]
        falling = [-self.by_impact[a:b] for a, b in zip(at, end, strict=True)]
        start = at.copy()
        # the value that each list has come to
        left = weights * self.by_impact[at]
        while True:
            rest = int(left.sum())
            if rest == 0:
                candidates = np.flatnonzero(sums)
                break
            if self.n_docs > k and (kth := int(np.partition(sums, self.n_docs - k)[self.n_docs - k])) > rest:
                candidates = np.flatnonzero(sums + rest >= kth)
                if len(candidates) <= max(ENOUGH, 4 * k):
                    break
            floor = int(left.max() * LAYER)
            for j in np.flatnonzero(left > floor):
                # all postings of this term with w * impact above the layer's floor: whole groups of equal impact
                to = start[j] + int(np.searchsorted(falling[j], -(floor // weights[j]), side="left"))
                to = max(to, at[j])
                sums[self.doc[at[j] : to]] += weights[j] * self.by_impact[at[j] : to]
                at[j] = to
                left[j] = weights[j] * self.by_impact[to] if to < end[j] else 0
        scores = self.whole(candidates, query, weights)
        order = np.lexsort((rank_of[candidates], -scores))[:k]
        order = order[scores[order] > 0]
        return candidates[order], scores[order]

    def whole(self, docs: np.ndarray, query: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Complete scores of ``docs``, from the documents' own rows."""
        lookup = np.zeros(len(self.starts), np.int64)
        lookup[query] = weights
        low, size = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        rows = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), size), lookup[self.term[rows]] * self.impact[rows])
        return out


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard: int = SHARD, block: int = BLOCK, known_terms: int = KNOWN_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``items``."""
    spark = docs.sparkSession
    asked = stored(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), "queries")
    query_terms = stored(counted(asked, None, "query").select(F.col("doc_id").alias("query"), "terms"), "query-terms")
    vocabulary = query_terms.select(F.explode("terms").alias("term")).distinct()
    some = vocabulary.limit(known_terms + 1).collect()
    known = None if len(some) > known_terms else frozenset(r.term.encode() for r in some)
    documents = stored(counted(docs, known, id_col, text_col), "counted")
    totals = documents.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    if not totals.L:
        return documents.limit(0).join(asked.limit(0)).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    df = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * totals.N + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = query_terms.select("query", F.explode("terms").alias("term")).join(df, "term").select("query", "term", weight.alias("w")).filter("w > 0")
    queries = stored(weighted.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).select("query", F.col("t.term").alias("terms"), F.col("t.w").alias("ws")), "weights")
    n_shards = max(spark.sparkContext.defaultParallelism, -(-bytes_estimate(documents) // shard))
    n_blocks = -(-queries.count() // block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    # m = 50 + (50 n N) div L, in whole numbers
    m = F.expr(f"50L + (50L * n * {totals.N}L) div {totals.L}L")
    dealt = documents.filter("n > 0").select(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(n_shards)).cast("int").alias("shard"), every(n_blocks).alias("block"), "doc_id", m.alias("m"), "terms", "tfs")
    sent = queries.select(every(n_shards).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(max(n_blocks, 1))).cast("int").alias("block"), "query", "terms", "ws")
    out = documents.select(F.lit(0).cast("long").alias("query"), "doc_id", F.lit(0).cast("long").alias("score")).schema

    def score(own: pa.Table, wanted: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(out)
        if not own.num_rows or not wanted.num_rows:
            return form.empty_table()
        asked_terms = wanted["terms"].combine_chunks()
        vocabulary = pc.unique(asked_terms.flatten())
        found = own["terms"].combine_chunks()
        ids = pc.index_in(found.flatten(), vocabulary)
        doc = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        mine = ids.is_valid().to_numpy(zero_copy_only=False)
        tf = own["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)[mine]
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[mine], minlength=len(found)))])
        shard = Shard(own["m"].to_numpy(), ends, ids.filter(ids.is_valid()).to_numpy().astype(np.int64), tf, len(vocabulary))
        order = pc.sort_indices(own["doc_id"], null_placement="at_start").to_numpy()
        rank_of = np.empty(len(order), np.int64)
        rank_of[order] = np.arange(len(order))
        at, wanted_ids = asked_terms.offsets.to_numpy(), pc.index_in(asked_terms.flatten(), vocabulary).to_numpy().astype(np.int64)
        ws = wanted["ws"].combine_chunks().flatten().to_numpy()
        at = at - at[0]
        best = [shard.best(wanted_ids[a:b], ws[a:b], k, rank_of) for a, b in zip(at[:-1], at[1:], strict=True)]
        docs_at = np.concatenate([d for d, _ in best])
        queries_at = np.repeat(np.arange(len(best)), [len(d) for d, _ in best])
        columns = [wanted["query"].take(pa.array(queries_at)), own["doc_id"].take(pa.array(docs_at)), pa.array(np.concatenate([s for _, s in best]))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, form, strict=True)], schema=form)

    key = ["shard", "block"]
    tops = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(score, out)
    placed = tops.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))).filter(F.col("rank") <= k)
    return placed.join(asked.select(F.col("query").alias("_q"), "item_id"), F.col("query") == F.col("_q")).select("item_id", "rank", "doc_id", "score")
