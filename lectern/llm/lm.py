"""LM scoring: a gated recurrent language model with a class-factored softmax, trained in numpy.

Tokens are words (A-Z in lower case) and one end for each text. The model's ids are the ``TOP`` commonest words,
the end, and ``GROUPS`` groups of all other words by their first bytes. The recurrent network gives P(id | all
before it); a word of a group has P(group) * (c + 1) / (S + V + 1), where c is its count in
all training documents and S and V are the group's tokens and distinct words. Both softmaxes have
all training documents' counts in their first biases.

1. *Encode*: one pass tokenises each text and stores it as numbers local to its chunk (up to ``CHUNK`` tokens of one task's
   documents), with the chunk's vocabulary: hashes of 64 bits and counts, packed by range of hash. 64-bit hashes stand for words;
   among 10^8 distinct words the chance that any two share one is about 3 in 10^4.
2. *Count*: each range adds up its words over all chunks and sends each chunk its words' totals. A word has one entry a
   chunk, so no word is hot; a chunk makes a row for each range that it has words of, so no more rows than words.
3. *Train*: truncated backpropagation through time, as parallel streams whose state is carried across windows and cleared after
   each end. A bounded sample of training documents (``MAX_ROWS`` of least hashed id, up to ``MAX_TOKENS``) gives the weights to start
   from. Then all training documents are dealt by hash into ``ROUNDS`` rounds and into shards of about ``SHARD`` tokens; in a round
   every shard trains from the weights so far, and the results are averaged by tokens.
4. *Score*: a chunk's documents meet its totals and run through the network side by side, window after window, the state
   carried, so the log likelihood is that of the complete document.

Cases: null and empty texts are an end alone; rows that repeat an id are scored each; null ids are
allowed; with no training documents all counts are 0 and the weights stay as they began; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import copy
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bytes_estimate, parts_for, stored

TOP = 512
GROUPS = 128
HIDDEN = 16
CLASSES = 16
CHUNK = 4_000_000
#: Bytes of text for each range of hashes: a range's entries, about a million, are counted in one task.
RANGE = 128_000_000
MAX_ROWS = 4_000
MAX_TOKENS = 800_000
ROUNDS = 3
SHARD = 2_000_000
STREAMS = 256
RATE = 0.01
WEIGHTS = ("enter", "turn", "to_class", "class_bias", "to_word", "word_bias")
_HASH = tokens.Hasher(127)
_END = np.uint64(0x5DEECE66D1234567)
_END_ID, _FIRST_GROUP, IDS = TOP, TOP + 1, TOP + 1 + GROUPS
_NO_GROUP = GROUPS  # of the end


def tokenised(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes, groups, tokens of each row) by slices, each row closed by an end."""
    for lo, hi, data, offs in tokens.slices(column):
        low = tokens.lower(data)
        starts, ends, rows = tokens.words(low, offs, tokens.SPACES)
        h = _HASH.words(low, starts, ends)
        second = np.where(ends - starts > 1, low[np.minimum(starts + 1, max(len(low) - 1, 0))], 0) if len(starts) else starts
        # the first two bytes and whether the word is short say much of its language
        group = (low[starts].astype(np.int64) * 31 + second * 7 + (ends - starts > 5) * 13) % GROUPS if len(starts) else starts
        count = tokens.counts(rows, hi - lo)
        at = np.cumsum(count)
        yield lo, np.insert(h, at, _END), np.insert(group, at, _NO_GROUP), count + 1


def encode(docs: DataFrame, ranges: int) -> DataFrame:
    """Stored rows (chunk, part, n, row, a, b, c, d), ``docs`` being (row, train, text).

    part -1: a document, a its local numbers (two bytes each, then one). Others: the vocabulary words of a range
    of hashes, a their local numbers, b hashes, c counts in training documents, d groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made = 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = (task << 24) + made
            h = np.concatenate([x[2] for x in held])
            group = np.concatenate([x[3] for x in held])
            train = np.concatenate([np.repeat(x[1], x[4]) for x in held])
            known, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(known))
            local = rank[inverse].astype(np.uint32)
            counted = np.bincount(inverse, train, len(known)).astype(np.int64)
            ids = pa.concat_arrays([x[0] for x in held])
            sizes = np.concatenate([x[4] for x in held])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for lo in range(0, len(sizes), 2000):
                hi = min(len(sizes), lo + 2000)
                packed = [(local[i:j] & 0xFFFF).astype(np.uint16).tobytes() + (local[i:j] >> 16).astype(np.uint8).tobytes() for i, j in zip(edge[lo:hi], edge[lo + 1 : hi + 1], strict=True)]
                n = hi - lo
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, -1, np.int64)), pa.array(sizes[lo:hi]), ids.slice(lo, n), pa.array(packed, pa.binary()), none, none, none], names)
            if len(known) >= 1 << 24:
                raise ValueError("a chunk's vocabulary must stay under 2^24 words")
            part = np.minimum(((known >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), ranges - 1)
            cut = np.searchsorted(part, np.arange(ranges + 1))
            some = [p for p in range(ranges) if cut[p] < cut[p + 1]]
            for lo in range(0, len(some), 64):
                few = some[lo : lo + 64]
                blobs = [[x[cut[p] : cut[p + 1]].tobytes() for p in few] for x in (rank.astype(np.int32), known, counted, group[first].astype(np.int16))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), chunk)), pa.array(np.array(few, np.int64)), pa.array(np.array([cut[p + 1] - cut[p] for p in few], np.int64)), pa.nulls(len(few), ids.type), *(pa.array(b, pa.binary()) for b in blobs)], names)

        names = ["chunk", "part", "n", "row", "a", "b", "c", "d"]
        for batch in batches:
            train = np.asarray(batch.column(1).to_pylist(), bool)
            for lo, h, group, count in tokenised(batch.column(2)):
                held.append((batch.column(0).slice(lo, len(count)), train[lo : lo + len(count)], h, group, count))
                size += len(h)
                if size >= CHUNK:
                    yield from flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield from flush()

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType([StructField("chunk", LongType()), StructField("part", LongType()), StructField("n", LongType()), StructField("row", docs.schema["row"].dataType), *[StructField(c, BinaryType()) for c in "abcd"]])
    return stored(docs.select("row", "train", "text").mapInArrow(tokens.trimmed(run), schema), "encoded")


def count(encoded: DataFrame, parts: int) -> DataFrame:
    """Stored rows (chunk, part, a, b, c, tops, groups, all): totals for chunks, and each range's statistics.

    With a chunk: local numbers a, totals b, and codes c: a group, or GROUPS + 1 + place among the range's commonest
    words. Without: tops, the commonest words' struct<h,n>, groups, struct<tokens,words> of its other words, and all, struct<tokens,words>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = lambda x, y: pa.struct([(x, pa.int64()), (y, pa.int64())])
        kinds = [("chunk", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("tops", pa.list_(pair("h", "n"))), ("groups", pa.list_(pair("tokens", "words"))), ("all", pair("tokens", "words"))]

        def flush(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            h = np.concatenate([np.frombuffer(x[2], np.uint64) for x in held])
            c = np.concatenate([np.frombuffer(x[3], np.int64) for x in held])
            group = np.concatenate([np.frombuffer(x[4], np.int16) for x in held])
            known, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            total = np.zeros(len(known), np.int64)
            np.add.at(total, inverse, c)
            code = group[first].astype(np.int32)
            words = np.flatnonzero((code != _NO_GROUP) & (total > 0))
            top = words[np.lexsort((known[words], -total[words]))[:TOP]]
            # words that stay in groups; the ones among the range's commonest are told apart later
            rest = np.setdiff1d(words, top)
            groups = [{"tokens": int(t), "words": int(w)} for t, w in zip(np.bincount(code[rest], total[rest], GROUPS), np.bincount(code[rest], minlength=GROUPS), strict=True)]
            tops = [{"h": int(known[i].astype(np.int64)), "n": int(total[i]) * GROUPS + int(code[i])} for i in top]
            code[top] = GROUPS + 1 + np.arange(len(top))
            rows = []
            at = 0
            for chunk, local, x, _, _ in held:
                some = inverse[at : at + len(x) // 8]
                at += len(some)
                rows.append((chunk, part, local, total[some].tobytes(), code[some].astype(np.int16).tobytes(), None, None, None))
            rows.append((None, part, None, None, None, tops, groups, {"tokens": int(total.sum()), "words": int((total > 0).sum())}))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 256]], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

        part, held = None, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if held and row[0] != part:
                    yield from flush(part, held)
                    held = []
                part = row[0]
                held.append(row[1:])
        if held:
            yield from flush(part, held)

    words = encoded.filter("part >= 0").select("part", "chunk", "a", "b", "c", "d").repartition(parts, "part").sortWithinPartitions("part")
    return stored(words.mapInArrow(tokens.trimmed(run), "chunk long, part long, a binary, b binary, c binary, tops array<struct<h:long,n:long>>, groups array<struct<tokens:long,words:long>>, all struct<tokens:long,words:long>"), "counted")


@dataclass
class Network:
    """P(id | state) by classes, and the state's gates."""

    members: list[np.ndarray]  # ids of each class
    klass: np.ndarray
    place: np.ndarray
    enter: np.ndarray  # [IDS, 3 * HIDDEN]: update, reset, candidate
    turn: np.ndarray  # [HIDDEN, 3 * HIDDEN]
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray  # [IDS, HIDDEN]
    word_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> Network:
        """Classes hold about equal shares of the square roots of counts, and biases are log counts."""
        rng = np.random.default_rng(seed)
        counts = counts + 1.0
        order = np.argsort(-counts, kind="stable")
        root = np.sqrt(counts[order])
        klass = np.empty(IDS, np.int64)
        klass[order] = np.minimum((np.cumsum(root) - root) / root.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        klass = np.unique(klass, return_inverse=True)[1]
        members = [np.flatnonzero(klass == k) for k in range(klass.max() + 1)]
        place = np.empty(IDS, np.int64)
        for ids in members:
            place[ids] = np.arange(len(ids))
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        mass = np.array([counts[ids].sum() for ids in members])
        return cls(members, klass, place, small(IDS, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, len(members)), np.log(mass / mass.sum()).astype(np.float32), small(IDS, HIDDEN), np.log(counts / mass[klass]).astype(np.float32))

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in WEIGHTS])

    def with_weights(self, flat: np.ndarray) -> Network:
        own = copy.deepcopy(self)
        at = 0
        for k in WEIGHTS:
            w = getattr(own, k)
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return own

    def step(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after ``ids``."""
        x = self.enter[ids]
        gates = x[:, : 2 * HIDDEN] + h @ self.turn[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(np.minimum(gates, 30, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = (r * h) @ self.turn[:, 2 * HIDDEN :]
        new += x[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        return h + z * (new - h)

    def log_p(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log P(id | state) of each row; with ``grads``, also adds up the gradients of -sum(log P)."""
        logits = h @ self.to_class + self.class_bias
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], e.dtype)  # quicker than a sum along short rows
        k = self.klass[ids]
        rows = np.arange(len(ids))
        out = logits[rows, k] - np.log(total)
        if grads is not None:
            d = e / total[:, None]
            d[rows, k] -= 1
            grads["to_class"] += h.T @ d
            grads["class_bias"] += d.sum(0)
            grads["h"] = d @ self.to_class.T
        by = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[by], np.arange(len(self.members) + 1))
        for c, members in enumerate(self.members):
            some = by[cut[c] : cut[c + 1]]
            if not len(some) or (len(members) == 1 and grads is None):
                continue
            hs = h[some]
            logits = hs @ self.to_word[members].T
            logits += self.word_bias[members]
            logits -= logits.max(1, keepdims=True)
            at = np.arange(len(some)), self.place[ids[some]]
            own = logits[at]
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            out[some] += own - np.log(total)
            if grads is not None:
                logits /= total[:, None]
                logits[at] -= 1
                grads["to_word"][members] += logits.T @ hs
                grads["word_bias"][members] += logits.sum(0)
                grads["h"][some] += logits @ self.to_word[members]
        return out

    def fit(self, texts: list[np.ndarray], streams: int = 128, window: int = 24, epochs: int = 2, rate: float = RATE) -> None:
        """Truncated backpropagation through ``window`` steps of parallel streams of whole texts, by Adam."""
        if not texts:
            return
        line = np.concatenate(texts)
        streams = min(streams, max(1, len(line) // (2 * window)))
        n = len(line) // streams
        if n < 2:
            return
        table = line[: n * streams].reshape(streams, n).T
        state = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in WEIGHTS}
        t = 0
        steps = epochs * -(-n // window)
        for _ in range(epochs):
            h = np.zeros((streams, HIDDEN), np.float32)
            before = np.full(streams, _END_ID)
            for lo in range(0, n, window):
                part = table[lo : lo + window]
                grads, h = self.gradients(np.vstack([before[None], part[:-1]]), part, h)
                before = part[-1]
                t += 1
                now = rate * max(0.05, 1 - t / steps)
                for k in WEIGHTS:
                    g = grads[k] / part.size
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.002 * (g * g - v)
                    getattr(self, k)[...] -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.998**t)) + 1e-8)

    def gradients(self, before: np.ndarray, part: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """(gradients of -sum(log P) of ``part`` [steps, streams], last state), each step taking in the token before.

        The state ``h`` comes from the window before and is held constant; it is clear at a text's start.
        """
        u, c = slice(0, 2 * HIDDEN), slice(2 * HIDDEN, 3 * HIDDEN)
        gates_turn, new_turn = self.turn[:, u], self.turn[:, c]
        x = self.enter[before]
        keep = (before != _END_ID)[:, :, None].astype(np.float32)
        old, gates, new, states = (np.empty((*part.shape, k), np.float32) for k in (HIDDEN, 2 * HIDDEN, HIDDEN, HIDDEN))
        for i in range(len(part)):
            old[i] = h
            g = gates[i]
            np.add(x[i, :, u], h @ gates_turn, out=g)
            np.exp(np.minimum(-g, 30), out=g)
            np.reciprocal(g + 1, out=g)
            np.tanh(x[i, :, c] + (g[:, HIDDEN:] * h) @ new_turn, out=new[i])
            h = (h + g[:, :HIDDEN] * (new[i] - h)) * keep[i]
            states[i] = h
        grads = {k: np.zeros_like(getattr(self, k)) for k in WEIGHTS}
        self.log_p(states.reshape(-1, HIDDEN), part.reshape(-1), grads)
        from_output = grads.pop("h").reshape(states.shape)
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        by_new, by_z, by_r, by_old = z * (1 - new * new), (new - old) * z * (1 - z), old * r * (1 - r), 1 - z
        change = np.empty((*part.shape, 3 * HIDDEN), np.float32)
        back = np.zeros_like(h)
        for i in range(len(part) - 1, -1, -1):
            d = (from_output[i] + back) * keep[i]
            np.multiply(d, by_new[i], out=change[i, :, c])
            d_rh = change[i, :, c] @ new_turn.T
            np.multiply(d, by_z[i], out=change[i, :, :HIDDEN])
            np.multiply(d_rh, by_r[i], out=change[i, :, HIDDEN : 2 * HIDDEN])
            back = d * by_old[i] + d_rh * r[i] + change[i, :, u] @ gates_turn.T
        flat = change.reshape(-1, 3 * HIDDEN)
        grads["turn"][:, u] = old.reshape(-1, HIDDEN).T @ flat[:, u]
        grads["turn"][:, c] = (r * old).reshape(-1, HIDDEN).T @ flat[:, c]
        ids = before.reshape(-1)
        by = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], ids[by[1:]] != ids[by[:-1]]]))
        grads["enter"][ids[by[first]]] = np.add.reduceat(flat[by], first, axis=0)
        return grads, h

    def likelihoods(self, ids: np.ndarray, sizes: np.ndarray, window: int = 32) -> np.ndarray:
        """Natural log likelihood of each text, the texts side by side and the state carried across windows."""
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        n = sizes[order]
        out = np.zeros(len(sizes))
        h = np.zeros((len(sizes), HIDDEN), np.float32)
        longest = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(longest), "left")  # texts longer than t
        states: list[np.ndarray] = []
        seen: list[np.ndarray] = []
        held = 0
        for t in range(longest):
            a = active[t]
            now = ids[begin[:a] + t]
            if t:
                h = self.step(before[:a], h[:a])  # noqa: F821
            states.append(h[:a])
            seen.append(now)
            before = now
            held += a
            if held >= 32_768 or len(states) >= window * 8 or t == longest - 1:
                rows = np.concatenate([np.arange(len(s)) for s in seen])
                out += np.bincount(rows, self.log_p(np.concatenate(states), np.concatenate(seen)), len(sizes))
                states, seen, held = [], [], 0
        back = np.empty(len(sizes))
        back[order] = out
        return back


@dataclass
class Model:
    network: Network
    names: np.ndarray  # hashes of the commonest words, in order
    ids: np.ndarray  # their ids
    group_mass: np.ndarray  # S + V + 1 of each group
    places: dict[tuple[int, int], int]  # (range, place) -> id
    strays: dict[tuple[int, int], int]  # (range, place) -> group
    tokens: int
    words: int


def statistics(counted: DataFrame) -> tuple[list, np.ndarray, int, int]:
    """The TOP commonest words, all groups' sums, N and V: bounded results of aggregates."""
    tops = counted.filter("chunk is null").select("part", F.posexplode("tops").alias("place", "top")).select("part", "place", F.col("top.h").alias("h"), (F.expr(f"top.n div {GROUPS}")).alias("n"), (F.col("top.n") % GROUPS).alias("group"))
    best = tops.orderBy(F.col("n").desc(), "h").limit(TOP).collect()
    chosen = {(r["part"], r["place"]) for r in best}
    groups = np.zeros((GROUPS, 2), np.int64)
    for r in counted.filter("chunk is null").select(F.posexplode("groups").alias("group", "s")).groupBy("group").agg(F.sum("s.tokens").alias("t"), F.sum("s.words").alias("w")).collect():
        groups[r["group"]] += (r["t"], r["w"])
    for r in tops.groupBy("group").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("w")).collect():
        groups[r["group"]] += (r["t"], r["w"])
    for r in best:
        groups[r["group"]] -= (r["n"], 1)
    both = counted.agg(F.coalesce(F.sum("all.tokens"), F.lit(0)), F.coalesce(F.sum("all.words"), F.lit(0))).first()
    assert len(chosen) == len(best)
    return best, groups, int(both[0]), int(both[1])


def train(docs: DataFrame, best: list, groups: np.ndarray, ends: int, max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS) -> Network:
    """Fit on whole training documents of least hashed id, at most ``max_rows`` and ``max_tokens``, then on all of them.

    ``docs`` has (row, train, text). The driver sees ids of tokens, and no more texts than the bound.
    """
    counts = np.zeros(IDS)
    counts[: len(best)] = [r["n"] for r in best]
    counts[_END_ID] = ends
    counts[_FIRST_GROUP:] = groups[:, 0]
    network = Network.start(counts)
    order = (F.xxhash64("row"), F.length("text"))
    sizes = docs.filter("train").select("row", F.xxhash64("text").alias("h"), F.length("text").alias("n"), *[o.alias(f"o{i}") for i, o in enumerate(order)]).orderBy("o0", "o1", "h").limit(max_rows).toPandas()
    chosen = sizes[_fitting(sizes["n"].to_numpy() / 6 + 1, max_tokens)]
    if len(sizes) and not len(chosen):
        logging.getLogger(__name__).warning("no training document fits into a sample of %d tokens", max_tokens)
    wanted = docs.sparkSession.createDataFrame([(int(h),) for h in chosen["h"].unique()], "h long")
    texts = docs.filter("train").withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), "h", "left_semi").select("h", "text").dropDuplicates(["h"])
    names = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    by = np.argsort(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, h, group, count in tokenised(batch.column(1)):
                ids = to_ids(h, group, names[by], by).astype(np.int16)
                edge = np.concatenate([[0], np.cumsum(count)])
                rows += [ids[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["h", "ids"])

    network.fit([np.frombuffer(r["ids"], np.int16).astype(np.int64) for r in texts.mapInArrow(tokens.trimmed(run), "h long, ids binary").orderBy("h").toLocalIterator()])
    every = docs.filter("train").select(F.xxhash64("row", "text").alias("h"), "text").mapInArrow(tokens.trimmed(run), "h long, ids binary")
    every = stored(every, "ids")
    shards = max(1, -(-int(counts.sum()) // SHARD))
    for k in range(ROUNDS):
        network = trained(every.filter(F.pmod("h", F.lit(ROUNDS)) == k), network, shards, RATE * (1 - k / ROUNDS))
    return network


def trained(every: DataFrame, network: Network, shards: int, rate: float) -> Network:
    """The mean, by tokens, of what each shard of (h, ids) makes of the network."""
    sent = every.sparkSession.sparkContext.broadcast(network)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def told() -> pa.RecordBatch:
            line = np.concatenate(held)
            own = copy.deepcopy(sent.value)
            streams = max(1, min(STREAMS, len(line) // 1536))
            # whole streams, so that no token is left out
            own.fit([np.resize(line, -(-len(line) // streams) * streams)], streams, epochs=1, rate=rate)
            made = own.weights().astype(float) * len(line)
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([len(line)]), pa.array([made.tobytes()], pa.binary())], ["shard", "n", "w"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and shard != here:
                    yield told()
                    held = []
                here = shard
                held.append(np.frombuffer(ids, np.int16))
        if held:
            yield told()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for size, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, total = n + size, total + np.frombuffer(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "w"])

    dealt = every.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).select("shard", "ids", "h").repartition(shards, "shard").sortWithinPartitions("shard", "h", "ids")
    made = dealt.mapInArrow(tokens.trimmed(fitted), "shard int, n long, w binary")
    # added up in groups of about the root of their number, in order, before they come to the driver
    groups = math.isqrt(shards - 1) + 1
    sums = made.repartition(groups, "shard").sortWithinPartitions("shard").mapInArrow(tokens.trimmed(added), "n long, w binary")
    n, total = 0, 0.0
    for r in sums.toLocalIterator():
        n, total = n + r["n"], total + np.frombuffer(r["w"])
    return network.with_weights((total / n).astype(np.float32)) if n else network


def _fitting(sizes: np.ndarray, most: float) -> np.ndarray:
    """Booleans: which are taken, in order, if one that doesn't fit into what is left is passed over."""
    out = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes.tolist()):
        if n <= most:
            out[i], most = True, most - n
    return out


def to_ids(h: np.ndarray, group: np.ndarray, sorted_names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.where(group == _NO_GROUP, _END_ID, _FIRST_GROUP + group)
    if len(sorted_names):
        at = np.minimum(np.searchsorted(sorted_names, h), len(sorted_names) - 1)
        out = np.where((sorted_names[at] == h) & (group != _NO_GROUP), ids[at], out)
    return out


def score(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; log10 scores."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("row"), allowed.alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(16, bytes_estimate(rows) // RANGE)
    encoded = encode(rows, ranges)
    counted = count(encoded, ranges)
    best, groups, n, v = statistics(counted)
    ends = rows.filter("train").count()
    network = train(rows, best, groups, ends)
    mass = (groups.sum(1) + 1).astype(float)
    chosen = {(r["part"], r["place"]): i for i, r in enumerate(best)}
    # words among a range's commonest but not among all's stay in their groups; few of a range's are told by its own list
    sent = spark.sparkContext.broadcast((network, chosen, mass, n, v))

    words = counted.filter("chunk is not null").join(_stray_groups(counted), F.col("part") == F.col("_p")).select("chunk", "part", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(0).cast("long").alias("n"), "a", "b", "c", "strays")
    texts = encoded.filter("part = -1").select("chunk", "part", F.lit(1).alias("kind"), "row", "n", "a", F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"), F.lit(None).cast("array<int>").alias("strays"))
    kind = rows.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, chosen, mass, n_all, v_all = sent.value
        log_base = np.log10(n_all + v_all + 1)
        log_mass = np.log10(mass)

        def flush(words: list[tuple], texts: list[tuple]) -> Iterator[pa.RecordBatch]:
            size = max(int(np.frombuffer(w[1], np.int32).max()) for w in words) + 1
            total, ids = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for part, a, b, c, strays in words:
                local, code = np.frombuffer(a, np.int32), np.frombuffer(c, np.int16).astype(np.int64)
                total[local] = np.frombuffer(b, np.int64)
                # codes up to GROUPS are groups or the end; above, places in the range's list
                table = np.concatenate([_FIRST_GROUP + np.arange(GROUPS), [_END_ID], [chosen.get((part, i), _FIRST_GROUP + g) for i, g in enumerate(strays)]]).astype(np.int64)
                ids[local] = table[code]
            log_c = np.log10(total + 1)
            in_group = ids >= _FIRST_GROUP
            extra = np.where(in_group, log_c - log_mass[np.where(in_group, ids - _FIRST_GROUP, 0)], 0.0)
            sizes = np.array([t[1] for t in texts], np.int64)
            flat = np.concatenate([np.frombuffer(a, np.uint16, n).astype(np.int32) | (np.frombuffer(a, np.uint8, n, 2 * n).astype(np.int32) << 16) for _, n, a in texts])
            first = np.cumsum(sizes) - sizes
            base = np.add.reduceat(log_c[flat], first) - sizes * log_base
            known = np.add.reduceat((total > 0)[flat].astype(np.int64), first)
            likely = network.likelihoods(ids[flat], sizes) / np.log(10) + np.add.reduceat(extra[flat], first)
            for lo in range(0, len(texts), 4096):
                part = slice(lo, lo + 4096)
                k = len(sizes[part])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([t[0] for t in texts[part]]), pa.array(sizes[part]), pa.array(known[part]), pa.array(np.full(k, n_all)), pa.array(base[part]), pa.array(likely[part])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        here, words, texts = None, [], []
        for batch in batches:
            chunk, part, kinds, sizes = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for i in range(batch.num_rows):
                if chunk[i] != here:
                    if texts:
                        yield from flush(words, texts)
                    here, words, texts = chunk[i], [], []
                if kinds[i] == 0:
                    words.append((part[i], batch.column(5)[i].as_py(), batch.column(6)[i].as_py(), batch.column(7)[i].as_py(), batch.column(8)[i].as_py()))
                else:
                    texts.append((batch.column(3).slice(i, 1), sizes[i], batch.column(5)[i].as_py()))
        if texts:
            yield from flush(words, texts)

    both = words.unionByName(texts).repartition(parts_for(rows, 16), "chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(tokens.trimmed(run), f"doc_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _stray_groups(counted: DataFrame) -> DataFrame:
    """(_p, strays): the groups of each range's commonest words."""
    return counted.filter("chunk is null").select(F.col("part").alias("_p"), F.transform("tops", lambda t: (t["n"] % GROUPS).cast("int")).alias("strays"))
