"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Cases: null and empty texts encode to no tokens and decode to no bytes; rows that repeat
an id are encoded each on their own; any further columns are ignored, so clashing names
are harmless; an empty table gives an empty result. Whatever its length, a whole text is
encoded exactly as one call of the library would: long texts are cut only where the
splitting pattern must begin a new match.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens

#: Unicode White_Space, as the splitting pattern's \s means it. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Texts over this many characters are cut at safe boundaries.
LONG = 1 << 16
#: White space runs of this length overflow the pattern's backtracking and are taken apart by rule.
RUN = 1024
_RUNS = re.compile(f"[{SPACE}]{{{RUN},}}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """An encoder of a rank file and a splitting pattern, loaded once in each Python worker."""

    _loaded: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import tiktoken

        #: Where a text may be cut is known of this pattern only; by others texts are encoded in one piece.
        self.cuts = pattern == public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def encode(self, text: str, long: int = LONG) -> list[int]:
        if len(text) < RUN or not self.cuts:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _RUNS.finditer(text):
            ids += self._pieces(text[at : run.start()], long)
            # followed by a word, the pattern leaves the run's last character to it
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at = end
        return ids + self._pieces(text[at:], long)

    def _pieces(self, text: str, long: int) -> list[int]:
        ids: list[int] = []
        at = 0
        while len(text) - at > long and (cut := _CUT.search(text, at + long)):
            ids += self.encoding.encode_ordinary(text[at : cut.start()])
            at = cut.start()
        return ids + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256, decoded_sha256) of every text; a map-only plan.

    ``path`` must be readable on every executor, as an installed package's data is.
    ``with_ids=False`` leaves the ids out, for callers that only want the digests.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                n, ids_hex, out_hex, every = [], [], [], []
                for text in texts.slice(lo, 512):
                    ids = codec.encode(text.as_py() or "")
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    out_hex.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        every.append(ids)
                columns = [batch.column(0).slice(lo, 512), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(out_hex, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokens.trimmed(run), schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary: the raw bytes, never repaired) to rows that have token ids; null ids give null."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    rest = [c for c in encoded.columns if c != "decoded"]
    schema = StructType([encoded.schema[c] for c in rest] + [StructField("decoded", BinaryType())])
    at = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            out = [None if ids is None else codec.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*rest, "decoded"])

    return encoded.select(*rest).mapInArrow(tokens.trimmed(run), schema)
