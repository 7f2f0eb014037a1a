"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. Statistics of every text are computed in one pass over its bytes and stored: a few doubles a row.
2. A bounded sample of labelled rows (``max_rows``, the ones of least hashed id) goes to the driver.
3. Shallow trees are grown on bootstraps of the sample in numpy; every root-to-node path is a rule,
   a conjunction of comparisons of statistics with thresholds.
4. An L1-penalised logistic regression (proximal gradient) keeps few rules.
5. The rules that are kept are compiled into one Spark Column, and all rows are scored by it.

Cases: null and empty texts have zero statistics and get the score of such; rows that repeat an id are
scored each; labels are joined by id, and an id with several labels counts by their mean, rounded; null ids are never
labelled; without labelled rows of both classes every score is the share of label 1 (0.5 if none);
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import stored

#: Rows that the rules are fitted on at most, and rows that each tree is grown on.
MAX_ROWS = 20_000
BOOTSTRAP = 5_000
FEATURES = ["log_words", "mean_word", "upper", "digit", "symbol", "bar", "bang", "space", "non_ascii", "line_words", "distinct", "top_word", "repeat", "ends_symbol", "sentence", "longest_word"]
_HASH = tokens.Hasher(11)


def _table(ranges: str) -> np.ndarray:
    return tokens.separators(ranges)


_UPPER, _DIGIT, _SPACE, _HIGH = _table("41-5A"), _table("30-39"), _table("20 09-0D"), _table("80-BF")
_SYMBOL = _table("21-2F 3A-40 5B-60 7B-7E") & ~_table("2C 2E")
_STOP = _table("2E 3F 21")
_LETTER = _table("41-5A 61-7A C2-F4")


def statistics_of(column: pa.Array) -> np.ndarray:
    """The FEATURES of each text, as rows of doubles."""
    out = []
    for lo, hi, data, offs in tokens.slices(column):
        n = hi - lo
        size = np.maximum(np.diff(offs), 1)

        def share(table: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
            c = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=c[1:])
            return c[offs[1:]] - c[offs[:-1]] if of is None else (c[offs[1:]] - c[offs[:-1]]) / of

        starts, ends, rows = tokens.words(data, offs, tokens.SPACES)
        count = tokens.counts(rows, n)
        some = np.maximum(count, 1)
        lengths = ends - starts
        h = _HASH.words(data, starts, ends)
        upper = share(_UPPER)
        # É and its like: C3 followed by 80 to 9E
        two = np.zeros(len(data) + 1, np.int64)
        if len(data) > 1:
            two[2:] = np.cumsum((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
        upper = upper + np.maximum(two[offs[1:]] - two[offs[:-1]], 0)
        letters = np.maximum(share(_LETTER), 1)
        chars = np.maximum(size - share(_HIGH), 1)
        same = np.zeros(len(h), bool)
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        distinct, top, longest = np.zeros(n), np.zeros(n), np.zeros(n)
        at = np.concatenate([[0], np.cumsum(count)])
        for i in range(n):
            if count[i]:
                run = np.sort(h[at[i] : at[i + 1]])
                edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
                distinct[i], top[i] = (len(edges) - 1) / count[i], np.diff(edges).max() / count[i]
                longest[i] = lengths[at[i] : at[i + 1]].max()
        last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        lines = share(_table("0A")) + 1
        out.append(np.column_stack([
            np.log1p(count), lengths_mean(lengths, rows, n, some), upper / letters, share(_DIGIT, chars), share(_SYMBOL, chars), share(_table("7C"), chars), share(_table("21"), chars), share(_SPACE, chars),
            share(_table("C2-F4"), chars), count / lines, distinct, top, np.bincount(rows, same, n) / some, np.bincount(rows, _SYMBOL[last], n) / some, np.bincount(rows, _STOP[last], n) / some, np.log1p(longest),
        ]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def lengths_mean(lengths: np.ndarray, rows: np.ndarray, n: int, some: np.ndarray) -> np.ndarray:
    return np.bincount(rows, lengths, n) / some


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, one double for each of FEATURES) of every row; with ``whole``, and _rest, a struct of all its columns."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rest = [F.struct(*[F.col(c) for c in docs.columns]).alias("_rest")] if whole else []
    picked = docs.select(F.col(id_col).alias("doc_id"), *rest, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = [f"_f{i}" for i in range(len(FEATURES))]
    schema = StructType([*picked.schema.fields[:-1], *[StructField(c, DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics_of(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(stats[:, i]) for i in range(stats.shape[1])]], schema.names)

    return picked.mapInArrow(tokens.trimmed(run), schema)


@dataclass
class Rules:
    """Conjunctions of (feature, is_greater, threshold), with logistic weights."""

    bias: float
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, names: list[str] | None = None) -> Column:
        """The score as a Column of JVM-side comparisons."""
        names = names or [f"_f{i}" for i in range(len(FEATURES))]
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for f, greater, at in rule:
                one = F.col(names[f]) > float(at) if greater else F.col(names[f]) <= float(at)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, at in rule:
        out &= (x[:, f] > at) == greater
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rng: np.random.Generator, found: set) -> None:
    """Add the paths of a tree: the best Gini split among a random half of the features at each node."""
    if path:
        found.add(path)
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = None
    for f in rng.permutation(binned.shape[1])[: max(4, binned.shape[1] // 2)]:
        if not len(cuts[f]):
            continue
        n = np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1).cumsum()[:-1].astype(float)
        p = np.bincount(binned[rows, f], y[rows], len(cuts[f]) + 1).cumsum()[:-1]
        all_n, all_p = float(len(rows)), float(y[rows].sum())
        ok = (n >= 5) & (all_n - n >= 5)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gini = p * (n - p) / n + (all_p - p) * (all_n - n - all_p + p) / (all_n - n)
        gini[~ok] = np.inf
        at = int(np.argmin(gini))
        if best is None or gini[at] < best[0]:
            best = gini[at], int(f), at
    if best is None:
        return
    _, f, at = best
    left = binned[rows, f] <= at
    for side, greater in ((rows[left], False), (rows[~left], True)):
        _grow(binned, cuts, y, side, depth - 1, (*path, (f, greater, float(cuts[f][at]))), rng, found)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.0015, steps: int = 400, bootstrap: int = BOOTSTRAP, seed: int = 7) -> Rules:
    """Grow ``trees`` on ``bootstrap`` rows each, drawn with repeats, take all their paths as rules, and fit sparse logistic weights on them and all rows."""
    if not len(y) or y.min() == y.max():
        return Rules(0.0 if not len(y) else float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    found: set = set()
    for _ in range(trees):
        _grow(binned, cuts, y, np.sort(rng.integers(0, len(y), min(len(y), bootstrap))), depth, (), rng, found)
    rules = sorted(found)
    a = np.column_stack([_holds(r, x) for r in rules]).astype(np.float32)
    # proximal gradient with momentum; the step is 1 / (the largest eigenvalue of a'a / 4n)
    v = rng.normal(size=a.shape[1]).astype(np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / (float(np.linalg.norm(a @ v)) ** 2 + len(y))
    w, b = np.zeros(a.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
    w_old, b_old, t = w, b, 1.0
    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb = w + (t - 1) / t_next * (w - w_old), b + (t - 1) / t_next * (b - b_old)
        error = 1 / (1 + np.exp(-(a @ mw + mb))) - y
        w_old, b_old, t = w, b, t_next
        w = mw - step * (a.T @ error) / len(y)
        w = (np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)).astype(np.float32)
        b = mb - step * float(error.mean())
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return Rules(b, [rules[i] for i in kept], [float(w[i]) for i in kept])


def train(stats: DataFrame, labels: DataFrame, label_col: str, allowed: Column, max_rows: int = MAX_ROWS) -> Rules:
    """Fit on at most ``max_rows`` labelled rows for which ``allowed``, of column doc_id, holds: those of least hashed id."""
    names = [f"_f{i}" for i in range(len(FEATURES))]
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_l")).agg(F.round(F.avg(label_col)).alias("_y"))
    rows = stats.filter(allowed).join(known, F.col("doc_id") == F.col("_l")).orderBy(F.xxhash64("doc_id"), *names).select("_y", *names).limit(max_rows).toArrow()
    return fit(np.column_stack([rows[c].to_numpy() for c in names]), rows["_y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; ``allowed`` is of column doc_id."""
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    return stats.select("doc_id", train(stats, labels, label_col, allowed).column().alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, allowed: Column, threshold: float = 0.3, label_col: str = "quality", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose score reaches ``threshold``.

    Statistics are made once for the fit, stored, and once more beside the rows, so that no text is moved.
    """
    rules = train(stored(statistics(docs, "doc_id", text_col), "statistics"), labels, label_col, allowed)
    beside = statistics(docs, "doc_id", text_col, whole=True)
    return beside.filter(rules.column() >= threshold).select("_rest.*")
