"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

* Shingles are five words; a text of fewer words, but some, is one shingle. A shingle's weight is its count in the text
  times the mean inverse document frequency of its words, 1 + ln((N + 1) / (df + 1)) / ln(N + 1). Document
  frequencies are counted over all documents, in a fixed number of hash buckets (``DF_BUCKETS``), so that table is
  broadcast whatever the input's size.
* Improved consistent weighted sampling (Ioffe 2010) draws ``BANDS * ROWS`` samples of each text; two texts agree in a
  sample with a probability equal to their weighted Jaccard similarity. Each shingle's random variables come
  from tables of ``RANDOMS`` entries by its hash, one place for each sample.
* Exact copies (128-bit digest of the text) collapse to the one of least id first.
* Texts that share a band are candidates. In a bucket of up to ``FEW`` texts all pairs whose sketches look alike are
  verified. A larger one gets a head start: for ``TURNS`` rounds, about ``PIVOTS`` members of random hash are pivots, and with
  them goes the member nearest to the pivots' consensus, as copies are nearest to what they were copied from. Pivots
  lead in order of how central they are, unless they are like a leader already. Every member streams past
  the leaders and is paired with those whose sketch looks like its own; a member that no leader resembles goes on to
  the next round. Large buckets are salted, and pivots go to every salt, so neither memory nor pairs grow with the square of a
  group of copies.
* What leaders link are classes for a start. Then, in each larger bucket that still holds several classes, every two
  members of different classes whose sketches look alike are verified too (``between_classes``), in pairs of blocks: the
  likeliest first, and then all, of those that a finer sketch of ``FINER`` times as many more samples leaves in doubt. Two
  members of one class need no link of their own, so the classes are those of all pairs that share a band, whatever a bucket's size.
* Pairs are verified by the weighted Jaccard similarity of all their shingles (>= ``THRESHOLD``) before they
  link. Shingles are packed by the documents that need them, and pivots of many pairs are salted.
* Classes are the connected components of verified links and copies, by rounds of least labels with
  stored tables in between.

Cases: null and empty texts have no shingles; they are copies of each other and like nothing else; rows that repeat
both id and text are one document; rows that share an id but not a text are documents of their own; an empty table
gives an empty result; further columns are ignored or, in ``deduplicated``, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import keyed, parts_for, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
DF_BUCKETS = 1 << 18
RANDOMS = 1 << 16
#: Sketches this alike are worth verifying: 0.8 less three standard deviations of 48 samples.
WORTH = 0.62
#: The same of sketches and finer ones together, 288 samples.
FINELY = 0.727
FINER = 5
#: Sketches this alike make a member a follower, which need not lead; ``between_classes`` makes up for its other links.
FOLLOWS = 0.7
FEW = 16
PIVOTS = 64
TURNS = 2
SALT_ROWS = 2_000
#: Likeliest partners of a member that ``between_classes`` tries before all others.
BEST = 2
#: Members of a block of ``between_classes``; two blocks are compared at a time.
BLOCK = 256
PAIRS_TOGETHER = 200
_WORD, _GRAM = tokens.Hasher(97), tokens.Hasher(101)


class Randoms:
    """Tables of the random variables of consistent weighted sampling, fixed by a seed."""

    _made: Randoms | None = None

    def __init__(self, samples: int):
        rng = np.random.default_rng(107)
        self.r, self.log_c, self.beta = (np.empty((samples, RANDOMS), np.float32) for _ in range(3))
        gamma = lambda: -np.log(rng.random(RANDOMS) * rng.random(RANDOMS) + 1e-300)
        for j in range(samples):  # row by row, for temporaries of all would stay with the worker
            self.r[j], self.log_c[j], self.beta[j] = gamma(), np.log(gamma()), rng.random(RANDOMS)
        # each sample has places of its own; finer sketches look at other places of the same tables
        self.turn = rng.integers(0, 1 << 62, (1 + FINER, samples), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def of(cls) -> Randoms:
        if cls._made is None:
            cls._made = cls(BANDS * ROWS)
        return cls._made


def shingled(column: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle hashes, weights, shingles of each row): distinct, in order of hash within rows."""
    for lo, hi, data, offs in tokens.slices(column):
        starts, ends, rows = tokens.words(data, offs, tokens.SPACES)
        h = _WORD.words(data, starts, ends)
        n = hi - lo
        count = tokens.counts(rows, n)
        first = np.cumsum(count) - count
        weight = np.concatenate([[0.0], np.cumsum(idf[(h >> np.uint64(46)).astype(np.int64)])])
        size = np.minimum(count, SHINGLE)
        number = np.maximum(count - SHINGLE + 1, (count > 0).astype(int))
        row = np.repeat(np.arange(n), number)
        at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        grams = _GRAM.ranges(_GRAM.sums(h), at, at + size[row])
        mean = (weight[at + size[row]] - weight[at]) / np.maximum(size[row], 1)
        edges = np.concatenate([[0], np.cumsum(number)])
        by = np.concatenate([np.argsort(grams[a:b]) + a for a, b in zip(edges[:-1], edges[1:], strict=True)]) if n else np.zeros(0, int)
        grams, mean = grams[by], mean[by]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        repeats = np.diff(np.append(begin, len(grams)))
        yield lo, n, grams[begin], (mean[begin] * repeats).astype(np.float32), tokens.counts(row[begin], n)


def sketches(grams: np.ndarray, weights: np.ndarray, counts: np.ndarray, turn: int = 0) -> np.ndarray:
    """[rows, samples] of 32-bit samples; rows without shingles are all zero. Another ``turn`` gives other samples."""
    randoms = Randoms.of()
    out = np.zeros((len(counts), BANDS * ROWS), np.uint32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    begins = (np.cumsum(counts) - counts)[some]
    log_w = np.log(weights)
    row = np.repeat(np.arange(len(some)), counts[some])
    for j in range(BANDS * ROWS):
        place = ((grams * randoms.turn[turn, j]) >> np.uint64(48)).astype(np.int64)
        r = randoms.r[j][place]
        t = np.floor(log_w / r + randoms.beta[j][place])
        value = randoms.log_c[j][place] - r * (t - randoms.beta[j][place] + 1)
        best = np.minimum.reduceat(value, begins)
        at = np.flatnonzero(value == best[row])
        at = at[np.concatenate([[True], row[at[1:]] != row[at[:-1]]])]  # ties: the least hash
        code = tokens.Hasher.mixed(grams[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        out[some, j] = np.maximum(code >> np.uint64(32), np.uint64(1))
    return out


def document_frequencies(base: DataFrame) -> tuple[np.ndarray, int]:
    """The inverse document frequency of each bucket, over all documents, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_BUCKETS, np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for lo, hi, data, offs in tokens.slices(batch.column(0)):
                starts, ends, rows = tokens.words(data, offs, tokens.SPACES)
                bucket = (_WORD.words(data, starts, ends) >> np.uint64(46)).astype(np.int64)
                total += np.bincount(np.unique(rows * DF_BUCKETS + bucket) % DF_BUCKETS, minlength=DF_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])

    table = base.select("text").mapInArrow(tokens.trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, count = (table[c].to_numpy() for c in ("bucket", "n"))  # columns, for as rows they would take the driver a hundred MB
    n = int(count[bucket == -1].sum())
    df = np.zeros(DF_BUCKETS)
    df[bucket[bucket >= 0]] = count[bucket >= 0]
    return (1 + np.log((n + 1) / (df + 1)) / np.log(n + 2)).astype(np.float32), n


def sketched(base: DataFrame, idf) -> DataFrame:
    """(key, a, b, bands, sketch): a 128-bit hash of the text, its bands and its sketch, null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, grams, weights, counts in shingled(batch.column(1), idf.value):
                made = sketches(grams, weights, counts)
                wide = made.reshape(n, BANDS, ROWS).astype(np.uint64)
                h = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    h = tokens.Hasher.mixed(h ^ wide[:, :, r])
                bands = pa.array([h[i].view(np.int64) if counts[i] else None for i in range(n)], pa.list_(pa.int64()))
                short = made.astype(np.uint16)
                sketch = pa.array([short[i].tobytes() if counts[i] else None for i in range(n)], pa.binary())
                part = batch.slice(lo, n)
                data, offs = tokens.text_bytes(part.column(1))
                said = np.frombuffer(b"".join(hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said[:, 0]), pa.array(said[:, 1]), bands, sketch], ["key", "a", "b", "bands", "sketch"])

    return base.select("key", "text").mapInArrow(tokens.trimmed(run), "key long, a long, b long, bands array<long>, sketch binary")


def finely(base: DataFrame, idf, keys: DataFrame) -> DataFrame:
    """(_w, fine): further samples of the texts of ``keys`` (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, grams, weights, counts in shingled(batch.column(1), idf.value):
                made = np.concatenate([sketches(grams, weights, counts, 1 + k) for k in range(FINER)], axis=1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array([r.tobytes() for r in made], pa.binary())], ["_w", "fine"])

    wanted = keys.select(F.col("key").alias("_k")).distinct()
    return stored(base.select("key", "text").join(wanted, F.col("key") == F.col("_k"), "left_semi").mapInArrow(tokens.trimmed(run), "_w long, fine binary"), "finer")


def _leaders(keys: list[int], heads: np.ndarray, few: bool) -> tuple[list[int], list[tuple[int, int]]]:
    """(places of leaders, pairs of keys worth verifying) among a group's pivots, the most central first."""
    alike = (heads[:, None, :] == heads[None, :, :]).mean(2) if len(keys) > 1 else np.ones((1, 1))
    if few:
        return [], [(keys[i], keys[j]) for i, j in zip(*np.nonzero(np.triu(alike >= WORTH, 1)), strict=True)]
    lead: list[int] = []
    pairs = []
    for i in np.argsort(-alike.sum(1), kind="stable").tolist():
        near = alike[i, lead] if lead else np.zeros(1)
        pairs += [(keys[lead[k]], keys[i]) for k in np.flatnonzero(near >= WORTH).tolist()]
        if near.max() < FOLLOWS:
            lead.append(i)
    return lead, pairs


def _past_leaders(members: DataFrame, parts: int) -> DataFrame:
    """(x, y, bucket, sketch) of one round over (bucket, salt, pivot, turn, key, sketch, n) in that order.

    With a sketch: member y goes on to the next round; else leader x and member y are worth verifying.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple = ()
        waiting: list[tuple[int, bytes]] = []  # this group's pivots, until all are here
        few = False
        keys: list[int] = []
        heads = np.zeros((0, BANDS * ROWS), np.uint16)
        rows: list[tuple] = []

        def settle() -> None:
            nonlocal waiting, keys, heads
            if waiting:
                names = [k for k, _ in waiting]
                made = np.frombuffer(b"".join(r for _, r in waiting), np.uint16).reshape(len(names), -1)
                lead, pairs = _leaders(names, made, few)
                if here[1] == 0:  # pivots are in every salt; the first one tells
                    rows.extend((x, y, None, None) for x, y in pairs)
                keys, heads, waiting = [names[i] for i in lead], made[lead], []

        def told() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["x", "y", "bucket", "sketch"])

        for batch in batches:
            rows = []
            buckets, salts, pivots, _, ids, raw, n = (batch.column(i).to_pylist() for i in range(7))
            for i, group in enumerate(zip(buckets, salts, strict=True)):
                if group != here:
                    settle()
                    here, keys, few = group, [], n[i] <= FEW
                if pivots[i]:
                    waiting.append((ids[i], raw[i]))
                    continue
                settle()
                alike = (heads == np.frombuffer(raw[i], np.uint16)).mean(1) if keys else np.zeros(1)
                rows += [(keys[k], ids[i], None, None) for k in np.flatnonzero(alike >= WORTH).tolist()]
                if alike.max() < FOLLOWS:
                    rows.append((None, ids[i], group[0], raw[i]))
            yield told()
        rows = []
        settle()
        yield told()

    dealt = members.select("bucket", "salt", "pivot", "turn", "key", "sketch", "n").repartition(parts, "bucket", "salt")
    return dealt.sortWithinPartitions("bucket", "salt", F.col("pivot").desc(), "turn", "key").mapInArrow(tokens.trimmed(run), "x long, y long, bucket long, sketch binary")


def _hubs(large: DataFrame) -> DataFrame:
    """(bucket, hub): of each bucket of ``large`` (bucket, key, sketch, pivot) the member nearest to the pivots' consensus."""

    def consensus(key: tuple, group: pa.Table) -> pa.Table:
        made = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(group.num_rows, -1)
        common = np.array([np.bincount(made[:, j]).argmax() for j in range(made.shape[1])], np.uint16)
        return pa.table({"_b": [key[0].as_py()], "common": [common.tobytes()]})

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, common = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((mine == common).sum(1))], ["bucket", "key", "near"])

    common = large.filter("pivot").select("bucket", "sketch").groupBy("bucket").applyInArrow(consensus, "_b long, common binary")
    near = large.join(common, F.col("bucket") == F.col("_b")).select("bucket", "key", "sketch", "common").mapInArrow(tokens.trimmed(nearness), "bucket long, key long, near long")
    return near.groupBy("bucket").agg(F.max_by("key", F.struct("near", (-F.col("key")).alias("least"))).alias("hub"))


def shared_buckets(texts: DataFrame) -> DataFrame:
    """Stored (bucket, key, n): the texts of every bucket of n > 1, which all that follows uses."""
    rows = texts.select("key", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").count().filter("count > 1").select(F.col("bucket").alias("_b"), F.col("count").alias("n"))
    return stored(rows.join(sizes, F.col("bucket") == F.col("_b")).select("bucket", "key", "n"), "buckets")


def candidates(texts: DataFrame, shared: DataFrame, salt_rows: int = SALT_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Distinct pairs (x, y), x a leader, of texts that share a band and whose sketches look alike.

    ``texts`` has (key, bands, sketch), ``shared`` its buckets.
    """
    parts = parts_for(texts, 16)
    sizes = shared
    members = shared.join(texts.select(F.col("key").alias("_k"), "sketch"), F.col("key") == F.col("_k")).select("bucket", "key", "n", "sketch")
    rounds: list[DataFrame] = []
    while True:
        turn = F.xxhash64("key", F.lit(len(rounds)))
        salts = F.ceil(F.col("n") / salt_rows).cast("int")
        members = members.withColumns({"turn": turn, "pivot": F.pmod(turn, F.col("n")) < pivots})
        large = members.filter(F.col("n") > pivots)
        if sizes.filter(F.col("n") > pivots).limit(1).count():
            hubs = _hubs(large).withColumnRenamed("bucket", "_h")
            led = large.join(hubs, F.col("bucket") == F.col("_h")).withColumn("pivot", F.col("pivot") | (F.col("key") == F.col("hub"))).drop("_h", "hub")
            members = members.filter(F.col("n") <= pivots).unionByName(led)
        own = F.array(F.pmod(F.xxhash64("key", F.lit(-1)), salts).cast("int"))
        salted = members.withColumn("salt", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), salts - 1)).otherwise(own)))
        made = stored(_past_leaders(salted, parts), "round")
        rounds.append(made.filter("sketch is null").select("x", "y"))
        left = made.filter("sketch is not null").select("bucket", F.col("y").alias("key"), "sketch")
        sizes = left.groupBy("bucket").count().filter("count > 1").select(F.col("bucket").alias("_b"), F.col("count").alias("n"))
        if len(rounds) == TURNS or sizes.limit(1).count() == 0:
            break
        members = left.join(sizes, F.col("bucket") == F.col("_b")).select("bucket", "key", "n", "sketch")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found.groupBy(F.least("x", "y").alias("_lo"), F.greatest("x", "y").alias("_hi")).agg(F.min("x").alias("x")).select("x", (F.col("_lo") + (F.col("_hi") - F.col("x"))).alias("y"))


def between_classes(texts: DataFrame, shared: DataFrame, roots: DataFrame, tried: DataFrame, finer: Callable[[DataFrame], DataFrame], best: int | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (x, y), not among ``tried``, of texts that share a band of over ``FEW``, look alike and are in different classes.

    ``roots`` has (key, root) of texts that are linked. A bucket's largest class is held against the others only; these, in
    blocks of about ``block``, against themselves and against blocks of it. With ``best``, only so many likeliest
    partners of a member in each pair of blocks: what they link needs no further pairs, and a call without it finds the rest.
    ``finer`` makes (_w, fine) of the members' keys: pairs must look alike by these further samples, too.
    """
    members = shared.filter(F.col("n") > FEW).select("bucket", "key")
    members = members.join(roots.select(F.col("key").alias("_k"), "root"), F.col("key") == F.col("_k"), "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    held = members.groupBy("bucket", "root").count().groupBy(F.col("bucket").alias("_b")).agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("n")).filter("n > most")
    members = members.join(held, F.col("bucket") == F.col("_b"))
    members = stored(members.select("bucket", "key", "root", (F.col("root") == F.col("main")).alias("of_main"), F.ceil(F.col("most") / block).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("others")), "between")
    if members.limit(1).count() == 0:
        return tried.limit(0)
    whole = members.join(texts.select(F.col("key").alias("_k"), "sketch", "bands"), F.col("key") == F.col("_k"))
    whole = whole.join(finer(members), F.col("key") == F.col("_w"))
    own = F.pmod(F.xxhash64("key", F.lit(-2)), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    others = F.sequence(F.lit(0), F.col("others") - 1)
    place = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), right.alias("right"))
    # blocks i <= j of the other classes, and block i of them with block -1 - j of the largest
    of_main = F.transform(others, lambda i: place(i, -1 - F.col("own"), F.lit(True)))
    of_others = F.concat(F.transform(others, lambda o: place(F.least(o, "own"), F.greatest(o, "own"), o < F.col("own"))), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: place(F.col("own"), -1 - m, F.lit(False))))
    dealt = whole.withColumn("own", own).select("bucket", "key", "root", "sketch", "bands", "fine", F.explode(F.when(F.col("of_main"), of_main).otherwise(of_others)).alias("p")).select("bucket", "p.i", "p.j", "p.right", "key", "root", "sketch", "bands", "fine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple = ()
        sides: tuple[list, list] = ([], [])

        def pairs() -> Iterator[pa.RecordBatch]:
            if not sides[0] or not (sides[1] or here[1] == here[2]):
                return
            rows = lambda side, at: np.frombuffer(b"".join(m[at] for m in side), np.uint16).reshape(len(side), -1)
            (k, r, s, b, f), (k2, r2, s2, b2, f2) = ((np.array([m[0] for m in side]), np.array([m[1] for m in side]), rows(side, 2), np.array([m[3] for m in side]), rows(side, 4)) for side in (sides[0], sides[1] or sides[0]))
            for lo in range(0, len(k), 64):
                part = slice(lo, lo + 64)
                alike = (s[part, None, :] == s2[None, :, :]).mean(2)
                wanted = (alike >= WORTH) & (r[part, None] != r2[None, :])
                if here[1] == here[2]:
                    wanted &= k[part, None] < k2[None, :]
                # the first band that two share tells of them, here or, in a small bucket, among its pairs
                same = b[part, None, :] == b2[None, :, :]
                wanted &= np.take_along_axis(b[part], same.argmax(2), 1) == here[0]
                at, to = np.nonzero(wanted)
                if len(at):
                    agree = alike[at, to] * s.shape[1] + (f[part][at] == f2[to]).sum(1)
                    sure = agree >= FINELY * (s.shape[1] + f.shape[1])
                    at, to, agree = at[sure], to[sure], agree[sure]
                if best is not None and len(at):  # so many likeliest partners of each member
                    by = np.lexsort((to, -agree, at))
                    at, to = at[by], to[by]
                    first = np.arange(len(at)) - np.searchsorted(at, at) < best
                    at, to = at[first], to[first]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(k[part][at]), pa.array(k2[to])], ["x", "y"])

        for batch in batches:
            buckets, i, j, right, keys, classes, raw, bands, fine = (c.to_pylist() for c in batch.columns)
            for n, group in enumerate(zip(buckets, i, j, strict=True)):
                if group != here:
                    yield from pairs()
                    here, sides = group, ([], [])
                sides[right[n]].append((keys[n], classes[n], raw[n], bands[n], fine[n]))
        yield from pairs()

    dealt = dealt.repartition(parts_for(texts, 16), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = dealt.mapInArrow(tokens.trimmed(run), "x long, y long")
    found = found.withColumns({"_lo": F.least("x", "y"), "_hi": F.greatest("x", "y")})
    done = tried.select(F.least("x", "y").alias("_lo"), F.greatest("x", "y").alias("_hi"))
    return found.join(done, ["_lo", "_hi"], "left_anti").select("x", "y")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of (hashes, weights) in order of hash: the sum of least weights over that of greatest."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    total = float(a[1].sum(dtype=float) + b[1].sum(dtype=float))
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    more = float(np.maximum(a[1][i], b[1][j]).sum(dtype=float))
    return shared / (total - shared) if total > shared and len(both) + more else float(total > 0 and total == shared)


def verified(pairs: DataFrame, base: DataFrame, idf, threshold: float) -> DataFrame:
    """(x, y, similarity) of the pairs that reach the threshold.

    A leader's pairs are dealt out in lots of ``PAIRS_TOGETHER``, each with the leader's text once; a lot
    streams by, so a task holds one leader's shingles and one member's.
    """
    parts = parts_for(base, 8)
    dealt = base.select("key", "text").repartition(parts, "key")
    lots = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / PAIRS_TOGETHER).cast("int").alias("lots"))
    heads = dealt.join(lots, F.col("key") == F.col("x")).select("x", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("y"), "text")
    numbered = pairs.join(lots.withColumnRenamed("x", "_x"), F.col("x") == F.col("_x")).select("x", F.pmod(F.xxhash64("y"), F.col("lots")).cast("int").alias("lot"), "y")
    tails = dealt.join(numbered, F.col("key") == F.col("y")).select("x", "lot", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            xs, ys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, n, grams, weights, counts in shingled(batch.column(3), idf.value):
                edge = np.concatenate([[0], np.cumsum(counts)])
                for i in range(n):
                    mine = grams[edge[i] : edge[i + 1]], weights[edge[i] : edge[i + 1]]
                    if ys[lo + i] is None:
                        head = mine
                    elif (like := weighted_jaccard(head, mine)) >= threshold:
                        out.append((xs[lo + i], ys[lo + i], like))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["x", "y", "similarity"])

    both = heads.unionByName(tails).repartition(parts, "x", "lot").sortWithinPartitions("x", "lot", F.col("y").asc_nulls_first())
    return both.mapInArrow(tokens.trimmed(run), "x long, y long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(key, root): the least key that each linked key reaches, by alternating large and small stars.

    Minima are aggregates with partial aggregation and come back by a join, so a star of any size is no group in one task.
    """
    edges = stored(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.col("_u")).alias("m"))
        large = sides.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_u")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = stored(small, "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if tuple(mark) == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = tuple(mark)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: str | None = None) -> DataFrame:
    """(doc_id, class_id, representative) of every row: class_id is the least id of its class."""
    name = keep or "doc_id"
    spark = docs.sparkSession
    base, _ = keyed(docs, id_col, text_col, keep)
    ids = base.select("key", "doc_id")
    idf = spark.sparkContext.broadcast(document_frequencies(base)[0])
    made = stored(sketched(base, idf), "sketches")
    firsts = made.groupBy("a", "b").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = firsts.filter("n > 1")
    same = made.select("key", "a", "b").join(copied.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    same = stored(same.filter("key <> first").select("key", "first"), "copies")
    texts = made.join(same.select(F.col("key").alias("_c")), F.col("key") == F.col("_c"), "left_anti").filter("bands is not null").select("key", "bands", "sketch")
    shared = shared_buckets(texts)
    pairs = stored(candidates(texts, shared), "pairs")
    first = components(verified(pairs, base, idf, threshold).select("x", "y"))
    fine: list[DataFrame] = []

    def finer(keys: DataFrame) -> DataFrame:
        if not fine:  # the first call's members are the later one's, and more
            fine.append(finely(base, idf, keys))
        return fine[0]

    for best in (BEST, None):
        more = stored(between_classes(texts, shared, first, pairs, finer, best), "pairs")
        links = first.select(F.col("key").alias("x"), F.col("root").alias("y")).unionByName(verified(more, base, idf, threshold).select("x", "y"))
        if best is not None:
            first, pairs = components(links), pairs.unionByName(more)
    roots = stored(components(links.unionByName(same.select(F.col("key").alias("x"), F.col("first").alias("y")))), "roots")
    found = base.select("key", name).join(roots.withColumnRenamed("key", "_r"), F.col("key") == F.col("_r"), "left").select("key", name, F.coalesce("root", "key").alias("root"))
    lead = ids.distinct().select(F.col("key").alias("_l"), F.col("doc_id").alias("class_id"))
    return found.join(lead, F.col("root") == F.col("_l")).select(name, "class_id", (F.col("key") == F.col("root")).alias("representative"))


def deduplicated(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The representatives of ``docs``, one for each class, with their columns; of repeated rows one stays."""
    whole = docs.withColumn("_rest", F.struct(*docs.columns))
    kept = classes(whole, "doc_id", text_col, threshold, keep="_rest").filter("representative")
    kept = kept.select("_rest.*")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    return kept.dropDuplicates(["doc_id", text_col]) if repeated else kept
