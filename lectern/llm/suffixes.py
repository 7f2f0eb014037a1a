"""Suffix-array dedup over bytes: suffixes are ordered only through ``WIDTH`` bytes.

Every text is its UTF-8 bytes. Each byte covered by a string of ``WIDTH`` bytes that also starts earlier
(at a smaller id, or earlier in the same document) is removed; strings are judged on the input, not on what
is left.

Suffixes are ordered by most-significant-digit radix passes, and only as far as it matters: the first digit is the
suffix's minimiser, which deals suffixes out to buckets (``windows``) and drops those whose digit is theirs
alone; in a bucket, equal stretches of super-k-mers collapse, and each further pass orders what is still tied
by the next 8 bytes and drops what is not tied any more. Groups that are left after ``WIDTH`` bytes are exactly
the repeated strings, and all but a group's first member are repeats.

Cases: null and empty texts have no bytes; texts of under ``WIDTH`` bytes keep all; matches never cross
documents; rows that repeat both id and text are one document, so each gets that document's result; rows that share an id but
not a text are documents of their own, ordered by the text's hash; null ids come before all others; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm import tokens, windows
from lectern.llm.substrings import runs

WIDTH = 100
GRAM = 28
DIGIT = 8
_BYTE = tokens.Hasher(71)


def _split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
    raw = data.tobytes()
    return _BYTE.values[data], np.repeat(np.arange(len(offs) - 1), np.diff(offs)), lambda i, j: raw[i:j]


def digits(data: np.ndarray) -> np.ndarray:
    """The DIGIT bytes from each position on as an unsigned integer, most significant first."""
    wide = np.zeros(max(len(data) - DIGIT + 1, 0), np.uint64)
    for i in range(DIGIT):
        wide <<= np.uint64(8)
        wide |= data[i : i + len(wide)]
    return wide


def radix_groups(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group numbers) of those strings of ``width`` bytes at ``at`` that occur more than once.

    One pass for each DIGIT bytes (the last may overlap the one before), each a stable sort by that digit within the groups so
    far, which drops suffixes that are alone in theirs. Groups come in order of their strings; within a group,
    positions keep the order of ``at``.
    """
    wide = digits(data) if width >= DIGIT else None
    group = np.zeros(len(at), np.int64)
    depths = [*range(0, width - DIGIT + 1, DIGIT), width - DIGIT] if width >= DIGIT else range(width)
    for depth in dict.fromkeys(depths):
        if not len(at):
            break
        digit = wide[at + depth] if wide is not None else data[at + depth].astype(np.uint64)
        # groups are in order of what they share, so sorting by (group, digit) keeps the order of suffixes
        by = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        digit, own = digit[by], group[by]
        edge = np.ones(len(by) + 1, bool)
        edge[1:-1] = (digit[1:] != digit[:-1]) | (own[1:] != own[:-1])
        several = ~(edge[:-1] & edge[1:])
        at, group = at[by[several]], np.cumsum(edge[:-1])[several]
    return at, group


def _order(texts: list[bytes], keys: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated runs of windows of packed strings, but for each window's first occurrence."""
    by = np.lexsort((starts, keys))
    first: dict[bytes, int] = {}
    kept, again = [], []
    for i in by.tolist():
        if first.setdefault(texts[i], i) == i:
            kept.append(i)
        else:
            again.append(i)  # all its windows occur in the earlier one
    data = np.frombuffer(b"".join(texts[i] for i in kept), np.uint8)
    sizes = np.array([len(texts[i]) for i in kept])
    begin = np.cumsum(sizes) - sizes
    counts = sizes - width + 1
    row = np.repeat(np.arange(len(kept)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    # in order of document and position, so the first of each group is the earliest
    at, group = radix_groups(data, begin[row] + offset, width)
    flag = np.zeros(len(data) + 1, bool)
    later = np.zeros(len(at), bool)
    later[1:] = group[1:] == group[:-1]
    flag[at[later]] = True
    r, lo, hi = runs(row, offset, flag[begin[row] + offset])
    kept_at, again_at = np.array(kept, np.int64), np.array(again, np.int64)
    whole = np.array([len(texts[i]) - width + 1 for i in again], np.int64)
    return np.concatenate([kept_at[r], again_at]), np.concatenate([lo, np.zeros(len(again), np.int64)]), np.concatenate([hi, whole])


def _digests(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the windows of a packed string, as two halves."""
    made = np.frombuffer(b"".join(hashlib.blake2b(text[i : i + width], digest_size=16).digest() for i in range(len(text) - width + 1)), np.uint64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


@cache
def unit(width: int = WIDTH, gram: int = GRAM) -> windows.Unit:
    return windows.Unit(width, min(gram, width), _split, lambda t, k, s: _order(t, k, s, width), lambda t: _digests(t, width), True)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = windows.HOT, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is what bytes are left, in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                data, offs = tokens.text_bytes(part.column(1))
                out: list[tuple] = []
                whole = part.column(3).to_pylist()
                for i in range(part.num_rows):
                    text, gone, spans = data[offs[i] : offs[i + 1]], 0, 0
                    got = part.column(2)[i]
                    n = len(text)
                    if whole[i] and n >= width:
                        text, gone, spans = text[:0], n, 1
                    elif got.is_valid and len(got):
                        hit = tokens.covered(got.values.field("s").to_numpy(), got.values.field("e").to_numpy(), n)
                        gone, spans = int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                        text = text[~hit]
                    raw = text.tobytes()
                    out.append((n, gone, spans, hashlib.sha256(raw).hexdigest(), raw if with_bytes else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return windows.repeated(docs, unit(width), id_col, text_col, hot).mapInArrow(tokens.trimmed(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
