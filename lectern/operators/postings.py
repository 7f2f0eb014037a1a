"""A positional inverted index of chunks, kept as a table, and density-ranked search over it.

A row of the table is a term's postings in a block of chunks: the chunks, how often each has the term, and where, with the weight
class of each place; beside them the greatest count and weight in the block. Rows lie in buckets by term, so a search opens only
its terms' buckets. An appended batch is a generation of its own blocks; a chunk counts as its newest generation has it, and removing is a
generation that lists chunks without postings. Texts are read when chunks are added, never by a search.

A search joins its terms with the blocks' summaries first. Blocks that lack a word of every alternative are out; the others have a
bound from counts and weights. The best-bounded blocks are scored, and of the rest only those whose bound passes the k-th score
found. Inside a block the rarest term's chunks are cut down by the other terms' before any place is looked at.

Scores. The places of a query's terms in a chunk are entries. From each start the earliest end that satisfies the query and the latest
begin that still does are a cover; the next start follows that begin. A cover adds its entries' harmonic mean weight over one more than the places
between that hold no entry, and r / (r + 1) keeps the sum r under one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.english import stem
from lectern.session import spread, stored_copy, stored_path

#: Weights of classes D, C, B and A, by class number. Fixed values.
WEIGHTS = (0.1, 0.2, 0.4, 1.0)
#: Columns that are searched by stem with their classes; the context is searched by word, in class 0.
CLASSES = {"title": 3, "headings": 2, "text": 1}
PLAIN = 0.75
#: English stop words. Fixed values.
STOPS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Chunks of a block, and words of one at most (a block always has a chunk).
BLOCK, BLOCK_WORDS = 2048, 1 << 20
#: Buckets of terms in an index.
BUCKETS = 64
#: Blocks of each query that are scored before the others are held against their k-th score; queries that meet a block in one task.
FIRST, SLICE = 16, 4096
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r'(-?)(?:"([^"]*)"|([^\s"]+))')


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(1 << 18)
def term_of(word: str) -> str | None:
    """The stem that stands for a word of English columns and queries; None for stop words."""
    return None if word in STOPS else stem(word)


# --- queries ---


@dataclass
class Wanted:
    """What a chunk must hold together, and what it must not: phrases, as (distance from the first word, term)."""

    phrases: list[tuple[tuple[int, str], ...]] = field(default_factory=list)
    banned: list[tuple[tuple[int, str], ...]] = field(default_factory=list)

    def terms(self) -> set[str]:
        return {t for p in self.phrases for _, t in p}


def english(query: str) -> list[Wanted]:
    """The alternatives of a web-style query: words and quoted phrases, ``or`` between alternatives, a minus before what is excluded. Stop words only keep their places in phrases."""
    out = [Wanted()]
    for minus, quoted, plain_word in _PART.findall(query):
        if not quoted and not minus and plain_word.lower() == "or":
            out.append(Wanted())
            continue
        found = [(i, t) for i, w in enumerate(words(quoted or plain_word)) if (t := term_of(w)) is not None]
        if found:
            phrase = tuple((i - found[0][0], t) for i, t in found)
            side = out[-1].banned if minus else out[-1].phrases
            if phrase not in side:
                side.append(phrase)
    return [w for w in out if w.phrases]


def plain(query: str) -> list[Wanted]:
    """All words of the query as they are."""
    found = [((0, w),) for w in dict.fromkeys(words(query))]
    return [Wanted(found)] if found else []


@lru_cache(1 << 14)
def arms(query: str, words_only: bool = False) -> tuple[list[Wanted], list[Wanted]]:
    return [] if words_only else english(query), plain(query)


# --- scores ---


def density(at: dict[str, list[int]], alternatives: list[Wanted]) -> float:
    """The sum over covers, where ``at`` has the sorted places of terms, each 4 * position + class."""
    operands = {t for w in alternatives for p in (*w.phrases, *w.banned) for _, t in p}
    places = sorted({x for t in operands for x in at.get(t, ())})
    if not places:
        return 0.0
    found = [([_occurrences(at, p) for p in w.phrases], [_occurrences(at, p) for p in w.banned]) for w in alternatives]
    found = [(need, banned) for need, banned in found if all(first for first, _ in need)]
    positions = [x >> 2 for x in places]
    inverse = np.concatenate([[0.0], np.cumsum([1 / WEIGHTS[x & 3] for x in places])])
    total, start = 0.0, positions[0]
    while True:
        ends = [e for need, banned in found if (e := _end(need, banned, start)) is not None]
        if not ends:
            return total
        end = min(ends)
        begin = max(b for need, banned in found if (b := _begin(need, banned, start, end)) is not None)
        i, j = bisect_left(positions, begin), bisect_right(positions, end)
        between = end - begin - (j - i - 1)
        total += (j - i) / (inverse[j] - inverse[i]) / (1 + between)
        if i + 1 == len(positions):
            return total
        start = positions[i + 1]


def _occurrences(at: dict[str, list[int]], phrase: tuple[tuple[int, str], ...]) -> tuple[list[int], list[int]]:
    """First and last positions of every occurrence of a phrase."""
    first = [x >> 2 for x in at.get(phrase[0][1], ())]
    if len(phrase) > 1:
        rest = [(d, {x >> 2 for x in at.get(t, ())}) for d, t in phrase[1:]]
        first = [p for p in first if all(p + d in r for d, r in rest)]
    span = phrase[-1][0]
    return first, [p + span for p in first]


def _end(need, banned, start: int) -> int | None:
    """The earliest end of a window from ``start`` that has all that is needed and nothing that is banned."""
    end = start
    for first, last in need:
        i = bisect_left(first, start)
        if i == len(first):
            return None
        end = max(end, last[i])
    return None if any((i := bisect_left(first, start)) < len(first) and last[i] <= end for first, last in banned) else end


def _begin(need, banned, start: int, end: int) -> int | None:
    """The latest begin, from ``start``, of such a window up to ``end``."""
    begin = end
    for first, last in need:
        i = bisect_right(last, end) - 1
        if i < 0 or first[i] < start:
            return None
        begin = min(begin, first[i])
    return None if any((i := bisect_left(first, begin)) < len(first) and last[i] <= end for first, last in banned) else begin


def scaled(value: float) -> float:
    return value / (value + 1)


# --- the table ---

_TABLE = "bucket int, term string, block long, ids array<long>, counts array<int>, places array<int>, most int, top int"


def create(chunks: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> str:
    """Index ``chunks``, (chunk_id, text) and title, headings and context if there are such columns, in a new folder; returns the folder."""
    path = path or stored_path(chunks.sparkSession, "postings")
    _write(_built(chunks, 0, buckets), path, buckets, 0, "errorifexists")
    return path


def append(chunks: DataFrame, path: str) -> None:
    """Add ``chunks``; those that are there already count as they are now."""
    generation, buckets = _state(chunks.sparkSession, path)
    _write(_built(chunks, generation + 1, buckets), path, buckets, generation + 1, "append")


def remove(ids: DataFrame, path: str) -> None:
    """Take out the chunks of a column chunk_id."""
    generation, buckets = _state(ids.sparkSession, path)
    listed = ids.select(F.lit(-1).alias("bucket"), F.lit("").alias("term"), F.lit((generation + 1) << 44).alias("block"), F.array("chunk_id").alias("ids"))
    listed = listed.select("*", F.array().cast("array<int>").alias("counts"), F.array().cast("array<int>").alias("places"), F.lit(0).alias("most"), F.lit(0).alias("top"))
    _write(listed, path, buckets, generation + 1, "append")


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """The newest generation, and the number of buckets, from the folders' names alone."""
    row = _rows(spark, path).select("generation", "buckets").agg(F.max("generation").alias("g"), F.max("buckets").alias("b")).first()
    return row.g or 0, row.b or BUCKETS


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_TABLE + ", buckets int, generation int").parquet(path)


def _write(rows: DataFrame, path: str, buckets: int, generation: int, mode: str) -> None:
    placed = rows.withColumns({"buckets": F.lit(buckets), "generation": F.lit(generation)})
    # rows of a bucket are dealt out over tasks by block, so that no bucket is one task's
    dealt = placed.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode(mode).partitionBy("buckets", "generation", "bucket").option("compression", "zstd").parquet(path)


def _built(chunks: DataFrame, generation: int, buckets: int) -> DataFrame:
    named = [c for c in CLASSES if c in chunks.columns]
    picked = chunks.select("chunk_id", *[F.col(c).cast("string") for c in named], F.col("context" if "context" in chunks.columns else "text").alias("_context"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = (generation << 44) + (TaskContext.get().partitionId() << 20), 0
        block = _Block(named)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # texts of few rows at a time are Python strings
                ids, *texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                for i, chunk in enumerate(ids):
                    block.add(chunk, [column[i] for column in texts])
                    if len(block.ids) == BLOCK or block.size >= BLOCK_WORDS:
                        yield block.rows(base + n)
                        block, n = _Block(named), n + 1
        if block.ids:
            yield block.rows(base + n)

    rows = spread(picked, "chunk_id").mapInArrow(build, _TABLE.replace("bucket int, ", ""))
    return rows.withColumn("bucket", F.when(F.col("term") == "", -1).otherwise(F.pmod(F.hash("term"), F.lit(buckets))))


class _Block:
    """Chunks on their way into the table."""

    def __init__(self, named: list[str]):
        self.named, self.ids, self.size = named, [], 0
        self.numbers: dict[str, int] = {}
        self.word: dict[str, int] = {}
        self.stem: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def _number(self, term: str | None) -> int:
        return -1 if term is None else self.numbers.setdefault(term, len(self.numbers))

    def _numbers(self, found: list[str], known: dict[str, int], of) -> np.ndarray:
        for w in set(found):
            if w not in known:
                known[w] = self._number(of(w))
        return np.fromiter(map(known.__getitem__, found), np.int32, len(found))

    def add(self, chunk, texts: list[str | None]) -> None:
        offset, terms, places, own = 0, [], [], None
        for name, text in zip(self.named, texts, strict=False):
            own = words(text)
            found = self._numbers(own, self.stem, term_of)
            at = np.flatnonzero(found >= 0)
            terms.append(found[at])
            places.append(4 * (offset + 1 + at) + CLASSES[name])
            offset += int(at[-1]) + 1 if len(at) else 0
        context = own if self.named and self.named[-1] == "text" and texts[-1] == texts[len(self.named) - 1] else words(texts[-1])
        terms.append(self._numbers(context, self.word, str))
        places.append(4 * (offset + 1 + np.arange(len(context))))
        self.ids.append(chunk)
        self.parts.append((np.concatenate(terms), np.concatenate(places).astype(np.int32)))
        self.size += len(self.parts[-1][0])

    def rows(self, block: int) -> pa.RecordBatch:
        term = np.concatenate([t for t, _ in self.parts])
        place = np.concatenate([p for _, p in self.parts])
        chunk = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t, _ in self.parts])
        order = np.lexsort((place, chunk, term))
        term, place, chunk = term[order], place[order], chunk[order]
        # runs of one term in one chunk, and runs of one term
        runs = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])])) if len(term) else np.zeros(0, np.int64)
        counts = np.diff(np.append(runs, len(term))).astype(np.int32)
        heads = np.searchsorted(term[runs], np.arange(len(self.numbers) + 1))
        ends = np.append(runs, len(term))[heads]
        ids = pa.array(self.ids, pa.int64())
        lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(kind)))
        most = np.maximum.reduceat(counts, heads[:-1]) if len(counts) else np.zeros(0, np.int32)
        top = np.maximum.reduceat(place & 3, ends[:-1]) if len(place) else np.zeros(0, np.int64)
        # the term '' lists the block's chunks
        every = np.array([0, len(self.ids)])
        one = pa.RecordBatch.from_arrays([pa.array([*self.numbers], pa.string()), pa.array(np.full(len(self.numbers), block)), lists(heads, ids.take(pa.array(chunk[runs])), None), lists(heads, counts, np.int32), lists(ends, place, np.int32), pa.array(most.astype(np.int32)), pa.array(top.astype(np.int32))], ["term", "block", "ids", "counts", "places", "most", "top"])
        listed = pa.RecordBatch.from_arrays([pa.array([""]), pa.array([block]), lists(every, ids, None), lists(np.array([0, 0]), np.zeros(0), np.int32), lists(np.array([0, 0]), np.zeros(0), np.int32), pa.array([0], pa.int32()), pa.array([0], pa.int32())], one.schema.names)
        return pa.Table.from_batches([one, listed]).combine_chunks().to_batches()[0]


# --- search ---


def search(queries: DataFrame, path: str, k: int, among: DataFrame | None = None, words_only: bool = False) -> DataFrame:
    """(query_id, chunk_id, score) of at least the best ``k`` chunks of each of (query_id, text), by the better of the English and 0.75 times the plain arm.

    ``among``, if given, is a column chunk_id of the chunks that are looked at; ``words_only`` leaves the plain arm alone. Ties at the k-th score are kept in full by
    id only within a block; rank what comes back by score and id.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "text").filter("text is not null")
    needs = stored_copy(asked.mapInArrow(partial(_needs, words_only=words_only), "query_id long, alternative int, term string, need int, scale double"), "needs")
    buckets, every = _state(spark, path)[1], asked.mapInArrow(_operands, "query_id long, term string")
    wanted = [r.bucket for r in every.select(F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket")).distinct().collect()]  # no more than there are buckets
    table = _rows(spark, path).filter(F.col("bucket").isin(wanted)).drop("bucket", "buckets")
    summary = table.select("term", "block", "most", "top").join(needs, "term")
    met = summary.groupBy("query_id", "alternative", "block").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.first("scale").alias("scale"), F.min("most").alias("most"), F.max("top").alias("top"))
    # a chunk has at most need * (the rarest term's count) covers of an alternative, each of the greatest weight at most
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("top") + 1)
    worth = met.filter("n = need").groupBy("query_id", "block", "scale").agg(F.sum(F.col("need") * F.col("most") * weight).alias("r"))
    bounds = stored_copy(worth.groupBy("query_id", "block").agg(F.max(F.col("scale") * F.col("r") / (F.col("r") + 1)).alias("bound")), "bounds")
    dead = _dead(spark, path, among)
    if (bounds.groupBy("query_id").count().agg(F.max("count").alias("n")).first().n or 0) <= FIRST:
        return _scored(bounds, asked, table, dead, k, words_only)
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    first = stored_copy(bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FIRST).select("query_id", "block"), "first")
    found = stored_copy(_scored(first, asked, table, dead, k, words_only), "found")
    rest = bounds.join(first, ["query_id", "block"], "left_anti")
    if rest.isEmpty():
        return found
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    least = found.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") == k).select("query_id", F.col("score").alias("least"))
    # scores are rounded to six digits, so a bound this close may still reach the k-th
    rest = stored_copy(rest.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("query_id", "block"), "rest")
    return found.unionByName(_scored(rest, asked, table, dead, k, words_only))


def _needs(batches: Iterator[pa.RecordBatch], words_only: bool) -> Iterator[pa.RecordBatch]:
    """The terms that each alternative of each query needs."""
    for batch in batches:
        out = []
        for query, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = 0
            for alternatives, scale in zip(arms(text, words_only), (1.0, PLAIN), strict=True):
                for w in alternatives:
                    out += [(query, n, t, len(w.terms()), scale) for t in w.terms()]
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64()))], ["query_id", "alternative", "term", "need", "scale"])


def _dead(spark: SparkSession, path: str, among: DataFrame | None) -> DataFrame | None:
    """(block, dead): by block, the chunks that a newer generation lists, or that aren't among those asked for; None if there are none."""
    listed = _rows(spark, path).filter("bucket = -1").select("generation", "block", F.explode("ids").alias("chunk_id"))
    gone = None
    if _state(spark, path)[0] > 0:
        newest = listed.groupBy("chunk_id").agg(F.max("generation").alias("newest"))
        gone = listed.join(newest, "chunk_id").filter("generation < newest").select("block", "chunk_id")
    if among is not None:
        out = listed.join(among.select("chunk_id").distinct(), "chunk_id", "left_anti").select("block", "chunk_id")
        gone = out if gone is None else gone.unionByName(out)
    return None if gone is None else gone.groupBy("block").agg(F.collect_set("chunk_id").alias("dead"))


def _scored(pairs: DataFrame, asked: DataFrame, table: DataFrame, dead: DataFrame | None, k: int, words_only: bool) -> DataFrame:
    """The best ``k`` chunks of each (query_id, block) of ``pairs``: a block's postings meet the queries that want it, slice by slice."""
    slices = F.pmod(F.xxhash64("query_id"), F.lit(-(-max(asked.count(), 1) // SLICE))).cast("int")
    sent = pairs.join(asked, "query_id").select("block", slices.alias("slice"), "query_id", "text")
    if dead is None:
        sent = sent.withColumn("dead", F.array().cast("array<long>"))
    else:
        sent = sent.join(dead, "block", "left")
    # banned and other alternatives' words are looked at, too
    every = asked.mapInArrow(_operands, "query_id long, term string")
    used = pairs.join(every, "query_id").select("block", slices.alias("slice"), "term").distinct()
    posts = table.join(used, ["block", "term"]).select("block", "slice", "term", "ids", "counts", "places")

    def score(posts: pa.Table, sent: pa.Table) -> pa.Table:
        out = _of_block(posts, sent, k, words_only)
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "chunk_id", "score"])

    return posts.groupBy("block", "slice").cogroup(sent.groupBy("block", "slice")).applyInArrow(score, "query_id long, chunk_id long, score double")


def _operands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(q, t) for q, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in {t for arm in arms(text) for w in arm for p in (*w.phrases, *w.banned) for _, t in p}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], ["query_id", "term"])


def _of_block(posts: pa.Table, sent: pa.Table, k: int, words_only: bool = False) -> list[tuple[int, int, float]]:
    if not posts.num_rows or not sent.num_rows:
        return []
    ids = posts["ids"].combine_chunks()
    names, number = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    counts, places = posts["counts"].combine_chunks(), posts["places"].combine_chunks()
    count, place = counts.flatten().to_numpy(), places.flatten().to_numpy()
    at, ends = ids.offsets.to_numpy() - ids.offsets[0].as_py(), places.offsets.to_numpy() - places.offsets[0].as_py()
    terms = {t: i for i, t in enumerate(posts["term"].to_pylist())}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for t, i in terms.items():  # chunks in ascending number, with the bounds of their places
        own = number[at[i] : at[i + 1]]
        last = ends[i] + np.cumsum(count[at[i] : at[i + 1]])
        order = np.argsort(own)
        held[t] = own[order], np.stack([last - count[at[i] : at[i + 1]], last], axis=1)[order]
    dead = np.unique(np.array([d for ds in sent["dead"].to_pylist() for d in ds or ()], np.int64))
    alive = ~np.isin(names, dead)
    out = []

    def places_in(t: str, n: int) -> list[int]:
        own, bounds = held.get(t, (np.zeros(0, np.int64), None))
        i = int(np.searchsorted(own, n))
        return place[slice(*bounds[i])].tolist() if i < len(own) and own[i] == n else []

    def matching(w: Wanted) -> np.ndarray:
        needed = sorted(w.terms(), key=lambda t: len(held[t][0]) if t in held else 0)
        if any(t not in held for t in needed):
            return np.zeros(0, np.int64)
        mine = held[needed[0]][0]
        for t in needed[1:]:
            if not len(mine):
                break
            own = held[t][0]
            spot = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            mine = mine[own[spot] == mine]
        hard = [p for p in w.phrases if len(p) > 1] + w.banned
        if not hard:
            return mine
        near = lambda n, p: bool(_occurrences({t: places_in(t, n) for _, t in p}, p)[0])
        return np.array([n for n in mine.tolist() if all(near(n, p) for p in w.phrases if len(p) > 1) and not any(near(n, p) for p in w.banned)], np.int64)

    for query, text in zip(sent["query_id"].to_pylist(), sent["text"].to_pylist(), strict=True):
        both = arms(text, words_only)
        mine = np.unique(np.concatenate([np.zeros(0, np.int64), *(matching(w) for arm in both for w in arm)]).astype(np.int64))
        mine = mine[alive[mine]]
        scored = []
        for n in mine.tolist():
            value = [density({t: places_in(t, n) for w in arm for p in (*w.phrases, *w.banned) for _, t in p}, arm) for arm in both]
            scored.append((-round(max(scaled(value[0]), PLAIN * scaled(value[1])), 6), int(names[n])))
        out += [(query, chunk, -score) for score, chunk in sorted(scored)[:k]]
    return out

