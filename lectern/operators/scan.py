"""Density-ranked search over texts without an index: one pass over the texts for a block of queries.

The scores are those of a search over an index of the same chunks (``postings``). A text is cut at blanks, and what its tokens hold of the terms asked for is looked up;
an alternative is looked at where a chunk has the one of its terms that fewest queries need. Only chunks that hold all terms of an alternative have their
places listed, and only those whose bound can reach the k-th score that the task has found are scored. So a task holds a batch, a block of queries, ``k`` rows of each, and
what it knows of a bounded number of tokens; nothing but those rows is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heappushpop

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.english import EXCEPTIONS
from lectern.operators.postings import _WORD, CLASSES, PLAIN, STOPS, WEIGHTS, Wanted, _occurrences, arms, density, scaled, term_of
from lectern.session import spread

#: Queries of a block.
SPLIT = 4096
#: Tokens of which a task remembers what they hold, and the longest one of these.
KNOWN, LONGEST = 1 << 18, 64
#: Letters of the longest words whose stem is one letter: it, the longest ending that goes at once, and a plural's.
SHORT = 7


def search(queries: list[tuple[int, str]], chunks: DataFrame, k: int, words_only: bool = False) -> DataFrame:
    """(query_id, chunk_id, score) of at least the best ``k`` chunks of each (query_id, text), as ``postings.search`` has them.

    ``chunks`` has (chunk_id, text), and title, headings and context if there are such columns. The queries are one block's, SPLIT at most.
    """
    named = [c for c in CLASSES if c in chunks.columns]
    searched = dict.fromkeys([*named, "context" if "context" in chunks.columns else "text"])
    picked = chunks.select("chunk_id", *[F.col(c).cast("string") for c in searched])
    sent = chunks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Asked(sent.value, named, k, words_only, "context" in searched)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # texts of few rows at a time are Python strings
                for chunk, *texts in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    block.add(chunk, [(t or "").lower() for t in texts])
        rows = [(q, -chunk, score) for q, best in block.best.items() for score, chunk in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "chunk_id", "score"])

    return spread(picked, "chunk_id").mapInArrow(run, "query_id long, chunk_id long, score double")


class _Held:
    """Which of the terms asked for the tokens of a text hold: as words, as stems, or as either."""

    def __init__(self, asked: set[str]):
        self.asked = asked
        begun = {t[: _kept(t)] for t in asked}
        self.begun = [(n, {x for x in begun if len(x) == n}) for n in sorted({*map(len, begun)}, reverse=True)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, set[str]] = {kind: set() for kind in ("word", "stem", "both")}
        self.terms: dict[str, dict[str, set[str]]] = {kind: {} for kind in self.known}
        self.stems: dict[str, str] = {}

    def full(self) -> bool:
        return sum(map(len, self.known.values())) > KNOWN

    def by(self, kind: str, tokens: set[str]) -> set[str]:
        known, terms, out = self.known[kind], self.terms[kind], set()
        for token in tokens - known:
            found = set()
            for w in (token,) if token.isalnum() else _WORD.findall(token):
                if kind != "stem" and w in self.asked:
                    found.add(w)
                if kind != "word" and (t := self._stem(w)) in self.asked:
                    found.add(t)
                    self.stems[w] = t
            if len(token) > LONGEST:
                out |= found
                continue
            known.add(token)
            if found:
                terms[token] = found
        return out.union(*map(terms.__getitem__, terms.keys() & tokens))

    def _stem(self, word: str) -> str | None:
        if word in EXCEPTIONS or any(word[:n] in some and (n > 1 or len(word) <= SHORT) for n, some in self.begun):
            return term_of(word)
        return None


def _kept(stem: str) -> int:
    """How many letters a stem has at least from the beginning of its word, if that is no exception: all but the last two, and in short ones more."""
    return min(6, max(len(stem) - 2, min(len(stem) - 1, 3), 2)) if len(stem) > 1 else 1


class _Asked:
    """A block of queries, and the ``k`` best chunks of each so far, as (score, minus the chunk)."""

    def __init__(self, queries: list[tuple[int, str]], named: list[str], k: int, words_only: bool, context: bool = False):
        self.named, self.k = named, k
        # without a column of its own, the text is its context, too
        self.kinds = [*["stem"] * len(named), "word"] if context else [*["stem"] * (len(named) - 1), "both"]
        self.arms = {q: arms(text, words_only) for q, text in queries}
        needs = [(q, frozenset(w.terms())) for q, both in self.arms.items() for arm in both for w in arm]
        uses = Counter(t for _, terms in needs for t in terms)
        self.by_key: dict[str, list[tuple[int, frozenset[str]]]] = {}
        for q, terms in needs:
            self.by_key.setdefault(min(terms, key=lambda t: (uses[t], -len(t), t)), []).append((q, terms))
        self.held = _Held({t for both in self.arms.values() for arm in both for t in _operands(arm)})
        self.best: dict[int, list[tuple[float, int]]] = {}

    def add(self, chunk: int, lowered: list[str]) -> None:
        if self.held.full():
            self.held.clear()
        have = set().union(*(self.held.by(kind, set(low.split())) for kind, low in zip(self.kinds, lowered, strict=True)))
        met = dict.fromkeys(q for t in self.by_key.keys() & have for q, terms in self.by_key[t] if terms <= have)
        if not met:
            return
        at = self._places(lowered, {t for q in met for arm in self.arms[q] for t in _operands(arm)})
        for q in met:
            both, best = self.arms[q], self.best.setdefault(q, [])
            if len(best) == self.k and max(scale * _bound(at, arm) for scale, arm in zip((1.0, PLAIN), both, strict=True)) < best[0][0] - 1e-6:
                continue
            if not any(_matches(at, w) for arm in both for w in arm):
                continue
            value = [density({t: at[t] for t in _operands(arm)}, arm) for arm in both]
            found = round(max(scaled(value[0]), PLAIN * scaled(value[1])), 6), -chunk
            if len(best) < self.k:
                heappush(best, found)
            else:
                heappushpop(best, found)

    def _places(self, lowered: list[str], terms: set[str]) -> dict[str, list[int]]:
        """The places of ``terms`` as an index has them: stems of the searched columns one behind the other, then the context's words."""
        out: dict[str, list[int]] = {t: [] for t in terms}
        offset = 0
        stems = self.held.stems
        for name, low in zip(self.named, lowered, strict=False):
            found = _WORD.findall(low)
            for i, w in enumerate(found, 1):
                if (t := stems.get(w)) in out:
                    out[t].append(4 * (offset + i) + CLASSES[name])
            offset += next((i for i in range(len(found), 0, -1) if found[i - 1] not in STOPS), 0)
        for i, w in enumerate(_WORD.findall(lowered[-1]), 1):
            if w in out:
                out[w].append(4 * (offset + i))
        return out


def _operands(arm: list[Wanted]) -> set[str]:
    return {t for w in arm for p in (*w.phrases, *w.banned) for _, t in p}


def _matches(at: dict[str, list[int]], w: Wanted) -> bool:
    """Whether all phrases of an alternative occur, and none that is excluded."""
    return all(_occurrences(at, p)[0] for p in w.phrases) and not any(_occurrences(at, p)[0] for p in w.banned)


def _bound(at: dict[str, list[int]], arm: list[Wanted]) -> float:
    """What an arm's score can't pass: an alternative has at most its number of terms times the rarest one's count of covers, each of the greatest weight at most."""
    covers = sum(len(terms) * min(len(at[t]) for t in terms) for terms in (w.terms() for w in arm))
    top = max((x & 3 for t in _operands(arm) for x in at[t]), default=0) if covers else 0
    return scaled(covers * WEIGHTS[top])
