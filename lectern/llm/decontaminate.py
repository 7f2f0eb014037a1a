"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words (see ``tokens.NOT_WORD``) become ids, and one automaton recognises every run of
words of every item. A document's words are streamed through it while the longest match is
tracked; a word is hit if a match of ``window`` words, or the whole of a shorter item, covers it.
Before streaming, a vectorised pass leaves only runs of words whose neighbouring pairs all occur, by hash,
in some item: any window lies within such a run. Words' ids come from their bytes, so hits are exact.

The items are taken in blocks of at most ``block_words`` words, so an automaton's size is bounded whatever
the benchmark's; each block is a broadcast of its own and one step of the same pass over the documents, and hits are united by document.

Cases: null and empty texts, of documents or items, have no words; rows that repeat an item id are one
item with several texts; rows that repeat a document id are judged each; null item ids count as an item
named ''; an empty benchmark hits nothing; further columns are ignored or, in ``cleaned``, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lectern.llm import tokens

WINDOW = 10
BLOCK_WORDS = 500_000
_HASH = tokens.Hasher(23)
_PAIR = tokens.Hasher(29)


class Automaton:
    """A generalised suffix automaton over word ids, and what its states mean for windows."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c, apart from longer ones."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, item: list[int]) -> None:
        last = 0
        for c in item:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new = self._state(self.len[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            self.link[new] = self._split(p, c) if p >= 0 else 0
            last = new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The longest suffix of the match and ``c`` that some item contains."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def finish(self, items: list[tuple[int, list[int]]]) -> None:
        """Find, for each state, the items whose windows end there: by window length, up the suffix links."""
        marks: dict[int, set[int]] = {}
        for name, item in items:
            size = min(self.window, len(item))
            state = length = 0
            for c in item:
                state, length = self.step(state, length, c)
                while self.len[self.link[state]] >= size if state else False:
                    state = self.link[state]
                    length = self.len[state]
                length = min(length, size)
                if length == size:
                    marks.setdefault(state * (self.window + 1) + size, set()).add(name)
        # the window strings of a state: (length, items), longest first, from its own and its links' marks
        by_state: dict[int, list[tuple[int, list[int]]]] = {}
        for key, names in marks.items():
            by_state.setdefault(key // (self.window + 1), []).append((key % (self.window + 1), sorted(names)))
        self.ends: list[list[tuple[int, list[int]]]] = [[] for _ in self.len]
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            own = sorted(by_state.get(state, []), reverse=True)
            self.ends[state] = own + self.ends[self.link[state]] if own else self.ends[self.link[state]]


class Block:
    """The automaton of a block of items, with the vocabularies of the vectorised pass."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        column = pa.array([text for _, text in items], pa.string())
        every: list[tuple[int, np.ndarray]] = []
        #: The words themselves: the automaton's ids are exact, hashes only pick what is streamed through it.
        self.index: dict[bytes, int] = {}
        ids: list[tuple[int, list[int]]] = []
        for lo, hi, data, offs in tokens.slices(column):
            data = tokens.lower(data)
            starts, ends, rows = tokens.words(data, offs, tokens.NOT_WORD)
            h = _HASH.words(data, starts, ends)
            cut = np.searchsorted(rows, np.arange(hi - lo + 1))
            every += [(at[items[lo + i][0]], h[cut[i] : cut[i + 1]]) for i in range(hi - lo) if cut[i] < cut[i + 1]]
            raw = data.tobytes()
            said = [self.index.setdefault(raw[s:e], len(self.index)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids += [(at[items[lo + i][0]], said[cut[i] : cut[i + 1]]) for i in range(hi - lo) if cut[i] < cut[i + 1]]
        pairs = [_PAIR.grams(h, 2) for _, h in every if len(h) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        singles = [h for _, h in every if len(h) == 1]
        self.singles = np.unique(np.concatenate(singles)) if singles else np.zeros(0, np.uint64)
        self.least = min((min(window, len(h)) for _, h in every if len(h) > 1), default=1 << 30)
        self.automaton = Automaton(window)
        for _, item in ids:
            self.automaton.add(item)
        self.automaton.finish(ids)

    @staticmethod
    def _in(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
        if not len(sorted_set) or not len(h):
            return np.zeros(len(h), bool)
        return sorted_set[np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)] == h

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, set[int]]]:
        """Covered ranges of words (in the batch's numbering), and the items that occur by row."""
        h = _HASH.words(data, starts, ends)
        spans: list[tuple[int, int]] = []
        found: dict[int, set[int]] = {}
        if not len(h) or not self.index:
            return spans, found
        linked = np.zeros(len(h) + 1, bool)  # word i is joined to word i - 1
        linked[1:-1] = self._in(_PAIR.grams(h, 2), self.pairs) & (rows[1:] == rows[:-1])
        first = np.flatnonzero(~linked[:-1])
        last = np.append(first[1:], len(h))
        wanted = last - first >= self.least
        if len(self.singles):
            one = np.zeros(len(h) + 1, np.int64)
            np.cumsum(self._in(h, self.singles), out=one[1:])
            wanted |= one[last] > one[first]
        step, marks = self.automaton.step, self.automaton.ends
        for lo, hi in zip(first[wanted].tolist(), last[wanted].tolist(), strict=True):
            # a word that no item has is -1, which leads nowhere
            ids = [self.index.get(data[a:b].tobytes(), -1) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            state = length = 0
            for i, c in enumerate(ids, lo + 1):
                state, length = step(state, length, c)
                longest = True
                for size, names in marks[state]:
                    if size <= length:
                        if longest:
                            spans.append((i - size, i))
                            longest = False
                        found.setdefault(int(rows[lo]), set()).update(names)
        return spans, found


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_words`` words (or one item), streamed to the driver in turn."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held: list[tuple[str, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        n = len(row["text"]) // 2 + 1  # words at most
        if held and size + n > block_words:
            yield Block(held, window)
            held, size = [], 0
        held.append((row["item"], row["text"]))
        size += n
    if held:
        yield Block(held, window)


def _scan(column: pa.Array, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], dict[int, set[int]]]]:
    """(first row, offsets, words of each row, (start, end) of each word, covered ranges, items by row) by slices."""
    for lo, hi, data, offs in tokens.slices(column):
        low = tokens.lower(data)
        starts, ends, rows = tokens.words(low, offs, tokens.NOT_WORD)
        yield lo, offs, tokens.counts(rows, hi - lo), np.column_stack([starts, ends]), *block.hits(low, starts, ends, rows)


@dataclass
class Found:
    """What all blocks have found in a batch: ranges of a row's own words, flat, and items; and where the words lie."""

    spans: dict[int, list[int]]
    items: dict[int, list[str]]
    scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]

    def flags(self, row: int, n: int) -> np.ndarray:
        """Which of the row's ``n`` words are hit."""
        s, e = np.array(self.spans[row]).reshape(-1, 2).T
        return tokens.covered(s, e, n)


def _through(docs: DataFrame, at: int, benchmark: DataFrame, window: int, block_words: int, schema: StructType, finish: Callable[[list[pa.Array], Found], list[pa.Array]]) -> DataFrame:
    """``docs`` past every block; ``finish`` makes the columns of ``schema`` of a batch and all that was found in it.

    Each block adds what it finds on the input texts to two further columns, so one block is no special case.
    """
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, window, block_words)] or [spark.sparkContext.broadcast(Block([], window))]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string())]
    found_schema = StructType([*docs.schema.fields, StructField("_spans", ArrayType(LongType())), StructField("_items", ArrayType(StringType()))])

    for k, block in enumerate(sent):
        last = k == len(sent) - 1

        def run(batches: Iterator[pa.RecordBatch], block=block, more=k > 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(batch.columns)
                before = [{i: v for i, v in enumerate(c.to_pylist()) if v} for c in columns[-2:]] if more else [{}, {}]
                columns = columns[:-2] if more else columns
                found = Found(*before, [])
                for lo, offs, count, words, spans, items in _scan(columns[at], block.value):
                    first = np.concatenate([[0], np.cumsum(count)])
                    for s, e in spans:
                        row = int(np.searchsorted(first, s, "right")) - 1
                        found.spans.setdefault(lo + row, []).extend((int(s - first[row]), int(e - first[row])))
                    for row, names in items.items():
                        found.items[lo + row] = sorted({*found.items.get(lo + row, ()), *(block.value.names[i] for i in names)})
                    if last:
                        found.scanned.append((lo, offs, count, words))
                if last:
                    yield pa.RecordBatch.from_arrays(finish(columns, found), schema.names)
                else:
                    told = [pa.array([x.get(i) for i in range(batch.num_rows)], kind) for x, kind in zip((found.spans, found.items), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *told], found_schema.names)

        docs = docs.mapInArrow(tokens.trimmed(run), schema if last else found_schema)
    return docs


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def finish(columns: list[pa.Array], found: Found) -> list[pa.Array]:
        n_words = np.concatenate([count for _, _, count, _ in found.scanned]) if found.scanned else np.zeros(0, np.int64)
        n_hit = np.zeros(len(n_words), np.int64)
        for row in found.spans:
            n_hit[row] = found.flags(row, int(n_words[row])).sum()
        items = [found.items.get(i, []) for i in range(len(n_words))]
        digests = [hashlib.sha256(",".join(names).encode()).hexdigest() for names in items]
        return [columns[0], pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string())]

    schema = StructType([picked.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_words", "n_hit", "n_items")], StructField("items_sha256", StringType())])
    return _through(picked, 1, benchmark, window, block_words, schema, finish).withColumn("contaminated", F.col("n_hit") > 0)


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of hit words cut out of the text.

    A span runs from its first hit word's first byte to its last hit word's last. Of a text
    whose words are hit by more than ``max_coverage``, nothing stays (an empty text). Column ``n_chars``, if there is one,
    follows the text. The spans of all blocks are cut and judged at once.
    """
    at = docs.columns.index(text_col)

    def finish(columns: list[pa.Array], found: Found) -> list[pa.Array]:
        new: dict[int, str] = {}
        for lo, offs, count, words in found.scanned:
            first = np.concatenate([[0], np.cumsum(count)])
            for row in range(len(count)):
                if lo + row not in found.spans:
                    continue
                flags = found.flags(lo + row, int(count[row]))
                if flags.mean() > max_coverage:
                    new[lo + row] = ""
                    continue
                raw = columns[at][lo + row].as_py().encode()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                kept, end = [], 0
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    kept.append(raw[end : int(words[first[row] + s, 0] - offs[row])])
                    end = int(words[first[row] + e - 1, 1] - offs[row])
                new[lo + row] = b"".join([*kept, raw[end:]]).decode()
        texts = pa.array([new.get(i, t) for i, t in enumerate(columns[at].to_pylist())], pa.string()) if new else columns[at]
        return [*columns[:at], texts, *columns[at + 1 :]]

    out = _through(docs, at, benchmark, window, block_words, docs.schema, finish)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
