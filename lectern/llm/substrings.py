"""Substring dedup by super-k-mer partitioning, over words.

A window is ``width`` consecutive words of a document, unchanged. Every word covered by a window that also
starts anywhere else, in the same document or another, is removed; windows are judged on the input, not
on what is left. ``windows`` says how windows meet; in a bucket, windows are sorted by a hash, and neighbours of one
hash are compared byte by byte, so the count is exact.

Cases: null and empty texts have no words; texts of fewer than ``width`` words keep all; rows that
repeat both id and text are one document, so they count once and each get its result; rows that share an id but not a text are
documents of their own; null ids are allowed; an empty table gives an empty result; further columns are
ignored or, in ``cleaned``, kept.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens, windows

WIDTH = 35
GRAM = 6
_WORD, _RUN = tokens.Hasher(53), tokens.Hasher(59)


def _split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
    starts, ends, rows = tokens.words(data, offs, tokens.SPACES)
    # words with one space after each, so that a run of words is a slice
    keep = ~tokens.SPACES[data]
    after = ends[ends < len(data)]
    after = after[tokens.SPACES[data[after]]]
    keep[after] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    plain = data.copy()
    plain[after] = 0x20
    plain = plain[keep].tobytes()
    begin, end = at[starts], at[ends]
    return _WORD.words(data, starts, ends), rows, lambda i, j: plain[begin[i] : end[j - 1]]


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row, offset, hash, first byte, bytes) of every window of packed strings."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, rows = tokens.words(data, offs, tokens.SPACES)
    n = len(rows) - width + 1
    good = np.flatnonzero(rows[:n] == rows[width - 1 :]) if n > 0 else np.zeros(0, int)
    row = rows[good]
    h = _RUN.grams(_WORD.words(data, starts, ends), width)[good]
    return data, row, good - np.searchsorted(rows, row), h, starts[good], ends[good + width - 1] - starts[good]


def _order(texts: list[bytes], keys: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, row, offset, h, begin, size = _windows(texts, width)
    by = np.argsort(h)
    tied = h[by[1:]] == h[by[:-1]]
    p, q = by[:-1][tied], by[1:][tied]
    flag = np.zeros(len(h), bool)
    if tokens.same_bytes(data, begin[p], begin[q], size[p], size[q]).all():
        flag[p] = flag[q] = True
    else:  # windows of one hash that differ: their digests tell
        some = np.unique(np.concatenate([p, q]))
        digests = [_digest(data, begin[i], size[i]) for i in some.tolist()]
        seen = Counter(digests)
        flag[some] = [seen[d] > 1 for d in digests]
    return runs(row, offset, flag)


def _digest(data: np.ndarray, begin: int, size: int) -> bytes:
    return hashlib.blake2b(data[begin : begin + size].tobytes(), digest_size=16).digest()


def _digests(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the windows of a packed string, as two halves."""
    data, _, _, _, begin, size = _windows([text], width)
    made = np.frombuffer(b"".join(_digest(data, b, n) for b, n in zip(begin.tolist(), size.tolist(), strict=True)), np.uint64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def runs(row: np.ndarray, offset: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the maximal runs of flagged windows; windows are in order of row and offset."""
    if not flag.any():
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(row) + 1, bool)
    new[1:-1] = (row[1:] != row[:-1]) | (flag[1:] != flag[:-1])
    first = np.flatnonzero(flag & new[:-1])
    last = np.flatnonzero(flag & new[1:])
    return row[first], offset[first], offset[last] + 1


@cache
def unit(width: int = WIDTH, gram: int = GRAM) -> windows.Unit:
    return windows.Unit(width, min(gram, width), _split, lambda t, k, s: _order(t, k, s, width), lambda t: _digests(t, width), False)


def _kept(column: pa.Array, spans: pa.Array, whole: pa.Array, width: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(words, removed words, the kept words) of each text."""
    for lo, hi, data, offs in tokens.slices(column):
        starts, ends, rows = tokens.words(data, offs, tokens.SPACES)
        first = np.searchsorted(rows, np.arange(hi - lo + 1))
        raw = data.tobytes()
        for i in range(hi - lo):
            n = int(first[i + 1] - first[i])
            s, e = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
            got = spans[lo + i]
            if whole[lo + i].as_py() and n >= width:
                s = e = starts[:0]
            elif got.is_valid and len(got):
                keep = ~tokens.covered(got.values.field("s").to_numpy(), got.values.field("e").to_numpy(), n)
                s, e = s[keep], e[keep]
            yield n, n - len(s), [raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = windows.HOT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; ``kept`` joins the kept words by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, removed, digest, kept = [], [], [], []
                for words, gone, rest in _kept(part.column(1), part.column(2), part.column(3), width):
                    text = b" ".join(rest)
                    n.append(words)
                    removed.append(gone)
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return windows.repeated(docs, unit(width), id_col, text_col, hot).mapInArrow(tokens.trimmed(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def cleaned(docs: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """``docs``, with its columns, and repeated windows' words removed from the texts that have any.

    A text that loses words is joined anew by single spaces; others stay as they are. ``n_chars``, if
    there is one, follows the text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", text_col)]
    whole = docs.withColumn("_rest", F.struct("doc_id", *rest))
    # the document's other columns travel with it in place of its id
    spans = windows.repeated(whole, unit(width), "doc_id", text_col, keep="_rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                out = [b" ".join(kept).decode() if gone else text for text, (_, gone, kept) in zip(texts, _kept(part.column(1), part.column(2), part.column(3), width), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["_rest", "_text"])

    from pyspark.sql.types import StringType, StructType

    out = spans.mapInArrow(tokens.trimmed(run), StructType([whole.schema["_rest"], *StructType().add("_text", StringType()).fields]))
    made = {c: F.col("_text") if c == text_col else F.col(f"_rest.{c}") for c in docs.columns}
    if "n_chars" in made:
        made["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made[c].alias(c) for c in docs.columns])
