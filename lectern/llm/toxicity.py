"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

* A word's vector is the sum of embeddings of its hash and of its hashed prefixes (``PREFIXES`` bytes), so inflected
  forms share what their stems have learnt. A-Z is lower-cased and edge punctuation left out.
* Filters of several widths slide over the words; each takes its maximum over the whole text, however
  long, and a logistic layer weighs the maxima.
* Training is Adam on a bounded sample of labelled rows (``max_rows`` of least hashed id, at most ``max_words`` words; both
  classes weigh alike). Gradients flow through the positions of the maxima alone. The first
  dimension starts as the smoothed log odds of a hash among the sample's texts.
* Thresholds are calibrated by language: a text's language is guessed from its own function words, and each
  language's threshold, chosen on a part of the sample that the weights haven't seen, becomes the
  score 0.5 by a shift of log odds. Languages with under ``LEAST`` toxic examples take the threshold of all.

Cases: null and empty texts have no words and get the score of maxima at rest; texts are scored whole; rows that repeat
an id are scored each; labels are joined by id, and an id with several counts by their mean, rounded; null ids are
never labelled; without labelled rows of both classes every score is the share of label 1 (0.5 if
none); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens

MAX_ROWS = 10_000
MAX_WORDS = 3_000_000
BUCKETS = 1 << 19
SIZE = 8
FILTERS = {1: 8, 2: 4, 3: 4}
PREFIXES = (4, 5, 7, 8)
#: Toxic texts that a language needs for a threshold of its own.
LEAST = 10
_HASH = tokens.Hasher(83)
_EDGE = tokens.separators("00-2F 3A-40 5B-60 7B-7F")
#: Function words by which a text's language is guessed. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for as with was on are by this be at from or an".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le la les de des et un une du en que qui dans est pour par sur au aux pas".split(),
    "es": "el la los las de y en que un una del por con para es se no su al lo".split(),
}
_LANGUAGES = list(FUNCTION_WORDS)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bucket ids of words [n, 1 + prefixes], words of each row, language of each row) by slices."""
    for lo, hi, data, offs in tokens.slices(column):
        low = tokens.lower(data)
        starts, ends, rows = tokens.words(low, offs, _EDGE)
        whole = _HASH.words(low, starts, ends)
        ids = [whole % np.uint64(BUCKETS)]
        for n in PREFIXES:
            short = _HASH.words(low, starts, np.minimum(starts + n, ends))
            ids.append(tokens.Hasher.mixed(short + np.uint64(n)) % np.uint64(BUCKETS))
        at = np.minimum(np.searchsorted(_KNOWN, whole), len(_KNOWN) - 1)
        is_function = _KNOWN[at] == whole
        votes = np.zeros((hi - lo, len(_LANGUAGES)))
        np.add.at(votes, rows[is_function], _VOTES[at[is_function]])
        language = np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(_LANGUAGES)) if hi > lo else np.zeros(0, int)
        yield lo, np.column_stack(ids).astype(np.int32), tokens.counts(rows, hi - lo), language


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    votes: dict[int, np.ndarray] = {}
    for i, listed in enumerate(FUNCTION_WORDS.values()):
        data = np.frombuffer(" ".join(listed).encode(), np.uint8)
        starts, ends, _ = tokens.words(data, np.array([0, len(data)]), tokens.SPACES)
        for h in _HASH.words(data, starts, ends).tolist():
            votes.setdefault(h, np.zeros(len(FUNCTION_WORDS)))[i] = 1
    known = np.array(sorted(votes), np.uint64)
    # a word of several languages says less
    return known, np.array([votes[int(h)] / votes[int(h)].sum() ** 2 for h in known])


_KNOWN, _VOTES = _function_words()


@dataclass
class Model:
    table: np.ndarray  # [BUCKETS, SIZE], float16 when sent
    filters: dict[int, np.ndarray]  # width -> [width * SIZE, filters]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    shifts: np.ndarray  # log odds of each language's threshold, the last for unknown

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = self.table[ids[:, 0]].astype(np.float32)
        for i in range(1, ids.shape[1]):
            out += self.table[ids[:, i]]
        return out

    def maxima(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """(maxima [rows, filters], position of each by width or -1, word vectors)."""
        x = self.vectors(ids)
        ends = np.cumsum(counts)
        begins = ends - counts
        out, where = [], {}
        for width, w in self.filters.items():
            high = np.zeros((len(counts), w.shape[1]), np.float32)
            at = np.full((len(counts), w.shape[1]), -1)
            n = len(x) - width + 1
            some = np.flatnonzero(counts >= width)
            if n > 0 and len(some):
                act = x[:n] @ w[:SIZE]
                for k in range(1, width):
                    act += x[k : k + n] @ w[k * SIZE : (k + 1) * SIZE]
                # the last windows of a text would run into the next one
                for k in range(1, width):
                    cut = ends[some] - k
                    act[cut[cut < n]] = -np.inf
                best = np.maximum.reduceat(act, begins[some], axis=0)
                high[some] = np.maximum(best + self.biases[width], 0)
                if self.keep_positions:
                    row = np.repeat(np.arange(len(some)), np.diff(np.append(begins[some], n)))
                    for f in range(w.shape[1]):
                        top = np.flatnonzero(act[begins[some[0]] :, f] == best[row, f])
                        first = row[top]
                        keep = np.concatenate([[True], first[1:] != first[:-1]])
                        at[some[first[keep]], f] = top[keep] + begins[some[0]]
            out.append(high)
            where[width] = at
        return np.concatenate(out, axis=1), where, x

    keep_positions = False

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.maxima(ids, counts)[0] @ self.weights + self.bias

    def scores(self, ids: np.ndarray, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, counts) - self.shifts[language], -50, 50)))


def _log_odds(ids: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket's texts, 0 where they could be chance."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in range(ids.shape[1]):
        pair = np.unique(rows * np.int64(BUCKETS) + ids[:, i])
        row, bucket = pair // BUCKETS, pair % BUCKETS
        pos += np.bincount(bucket[y[row] == 1], minlength=BUCKETS)
        neg += np.bincount(bucket[y[row] == 0], minlength=BUCKETS)
    p, n = (y == 1).sum(), (y == 0).sum()
    share = p / (p + n)
    expected = (pos + neg) * share
    # so many buckets are looked at that only large deviations mean something
    sure = np.abs(pos - expected) > 4 * np.sqrt(np.maximum(expected * (1 - share), 0.3))
    shrunk = (pos + neg) / (pos + neg + 1)
    return np.where(sure, shrunk * (np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1))), 0)


def fit(ids: np.ndarray, counts: np.ndarray, language: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, least_steps: int = 200, rate: float = 0.004, seed: int = 5) -> Model:
    """Adam on four fifths of the texts, thresholds on the rest."""
    rng = np.random.default_rng(seed)
    filters = {w: rng.normal(0, 0.2, (w * SIZE, n)).astype(np.float32) for w, n in FILTERS.items()}
    model = Model(np.zeros((BUCKETS, SIZE), np.float32), filters, {w: np.zeros(n, np.float32) for w, n in FILTERS.items()}, rng.normal(0, 0.1, sum(FILTERS.values())).astype(np.float32), 0.0, np.zeros(len(_LANGUAGES) + 1))
    if not len(y) or y.min() == y.max():
        model.weights[:] = 0
        model.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
        return model
    model.table[:, 1:] = rng.normal(0, 0.05, (BUCKETS, SIZE - 1))
    ends = np.cumsum(counts)
    begins = ends - counts
    tune = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~tune)
    words = np.repeat(~tune, counts)
    model.table[:, 0] = _log_odds(ids[words], np.repeat(np.arange(len(y)), counts)[words], y)
    for w in FILTERS:
        # these look for log odds from the start, of more than one of a word's hashes
        filters[w][:, 0] *= 0.1
        filters[w][0, 0], model.biases[w][0] = 1.0, -3.0
    model.weights[0] = 0.7
    model.bias = -2.0
    weight = np.where(y == 1, 0.5 / max((y[train] == 1).mean(), 1e-6), 0.5 / max((y[train] == 0).mean(), 1e-6))
    state = {}
    t = 0

    def adam(name: object, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)

    squares = np.zeros((BUCKETS, 1), np.float32)
    # small samples get more epochs, to as many steps
    for _ in range(max(epochs, min(30, least_steps * batch // len(train) + 1))):
        order = rng.permutation(train)
        for lo in range(0, len(order), batch):
            t += 1
            rows = order[lo : lo + batch]
            picked = np.concatenate([np.arange(begins[r], ends[r]) for r in rows]) if len(rows) else np.zeros(0, int)
            some_ids, some = ids[picked], counts[rows]
            grads, (at, delta) = gradients(model, some_ids, some, y[rows], weight[rows])
            adam("weights", model.weights, grads["weights"] + 1e-4 * model.weights)
            model.bias -= rate * grads["one"]
            for width, w in model.filters.items():
                adam(("bias", width), model.biases[width], grads["bias", width])
                adam(width, w, grads[width])
            if len(at):
                for i in range(ids.shape[1]):
                    bucket = some_ids[at, i]
                    np.add.at(squares, bucket, (delta * delta).mean(1, keepdims=True))
                    np.subtract.at(model.table, bucket, rate * delta / (np.sqrt(squares[bucket]) + 1e-3))
    held = np.flatnonzero(tune)
    z = np.concatenate([model.logits(ids[begins[r] : ends[r]], counts[r : r + 1]) for r in held]) if len(held) else np.zeros(0)
    every = _threshold(z, y[held])
    for i in range(len(_LANGUAGES) + 1):
        own = language[held] == i
        model.shifts[i] = _threshold(z[own], y[held][own]) if (y[held][own] == 1).sum() >= LEAST else every
    return model


def gradients(model: Model, ids: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, tuple[np.ndarray, np.ndarray]]:
    """Of the mean weighted log loss: gradients by parameter, and (places of words, what each adds to its hashes' embeddings)."""
    keep, model.keep_positions = model.keep_positions, True
    top, where, x = model.maxima(ids, counts)
    model.keep_positions = keep
    p = 1 / (1 + np.exp(-np.clip(top @ model.weights + model.bias, -50, 50)))
    error = ((p - y) * weight / len(y)).astype(np.float32)
    back = np.outer(error, model.weights) * (top > 0)
    grads: dict = {"weights": top.T @ error, "one": float(error.sum())}
    col = 0
    hit, change = [np.zeros(0, np.int64)], [np.zeros((0, SIZE), np.float32)]
    for width, w in model.filters.items():
        grad = np.zeros_like(w)
        for f in range(w.shape[1]):
            g, at = back[:, col], where[width][:, f]
            ok = (at >= 0) & (g != 0)
            g, at = g[ok], at[ok]
            for k in range(width):
                grad[k * SIZE : (k + 1) * SIZE, f] += g @ x[at + k]
                hit.append(at + k)
                change.append(np.outer(g, w[k * SIZE : (k + 1) * SIZE, f]))
            col += 1
        grads["bias", width] = back[:, col - w.shape[1] : col].sum(0)
        grads[width] = grad
    return grads, (np.concatenate(hit), np.concatenate(change))


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The log odds halfway into the gap that makes the most of F1."""
    if not len(z) or y.min() == y.max():
        return 0.0
    by = np.argsort(-z)
    hits = np.cumsum(y[by])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    at = int(np.argmax(f1))
    return float((z[by[at]] + (z[by[at + 1]] if at + 1 < len(z) else z[by[at]] - 1)) / 2)


def train(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Fit on at most ``max_rows`` labelled rows for which ``allowed`` holds, and of these, in order of their hash, on those that fit into ``max_words``.

    Their ids, a bounded table, are broadcast to pick the texts; the driver gets bucket ids, not texts.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_l")).agg(F.round(F.avg(label_col)).alias("_y"))
    known = known.withColumnRenamed("_l", id_col).filter(allowed).withColumnRenamed(id_col, "_l")
    sample = known.orderBy(F.xxhash64("_l"), "_l").limit(max_rows).toPandas()
    wanted = docs.sparkSession.createDataFrame(list(zip(sample["_l"].tolist(), sample["_y"].tolist(), strict=True)), known.schema)
    picked = docs.join(F.broadcast(wanted), F.col(id_col) == F.col("_l")).select("_l", "_y", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = 1 + len(PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids, counts, language in features(batch.column(2)):
                part = batch.slice(lo, len(counts))
                cut = np.concatenate([[0], np.cumsum(counts)])
                packed = pa.array([ids[cut[i] : cut[i + 1]].tobytes() for i in range(len(counts))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(language, pa.int64()), packed], ["id", "y", "n", "language", "ids"])

    kind = known.schema["_l"].dataType.simpleString()
    made = picked.mapInArrow(tokens.trimmed(run), f"id {kind}, y double, n long, language long, ids binary").filter(F.col("n") <= max_words).orderBy(F.xxhash64("id"), "id")
    size, rows = 0, []
    for row in made.toLocalIterator():  # a text that doesn't fit into what is left is passed over
        if size + row["n"] <= max_words:
            size += row["n"]
            rows.append(row)
    if len(sample) and not rows:
        logging.getLogger(__name__).warning("no labelled text fits into a sample of %d words", max_words)
    ids = np.empty((size, columns), np.int32)
    counts, language, y = (np.array([r[c] for r in rows], kind) for c, kind in (("n", np.int64), ("language", np.int64), ("y", float)))
    at = 0
    for i, n in enumerate(counts.tolist()):  # each row's bytes go as they are copied
        ids[at : at + n] = np.frombuffer(rows[i]["ids"], np.int32).reshape(-1, columns)
        rows[i], at = None, at + n
    return fit(ids, counts, language, y)


def score(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the model, whose size is fixed, is broadcast."""
    model = train(docs, labels, label_col, allowed, id_col, text_col)
    model.table = model.table.astype(np.float16)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if model.table.dtype == np.float16:
            model.table = model.table.astype(np.float32)
        for batch in batches:
            out = [model.scores(ids, counts, language) for _, ids, counts, language in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tokens.trimmed(run), f"doc_id {kind}, score double")
