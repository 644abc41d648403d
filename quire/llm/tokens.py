"""Sizes in tokens of a public tokenizer.

Byte-pair encoding works inside the pieces that the tokenizer's splitting pattern makes, so a text's size is the sum of its
pieces' sizes, and each worker looks a piece up once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame, functions as F

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
FOLDER = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
#: The vocabulary used where none is named.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Components of the projected document vector, and pieces a worker remembers.
DIMENSIONS, REMEMBERED = 3, 400_000

_loaded: dict[str, "Sizer"] = {}


class Sizer:
    """Token counts and projections of pieces, remembered per worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sizes = np.zeros(4096, np.int64)
        self.vectors = np.zeros((4096, DIMENSIONS))

    def _learn(self, piece: str) -> int:
        k = self.index[piece] = len(self.index)
        if k >= len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.sizes[k] = len(self.encoding.encode_ordinary(piece))
        word = piece.strip().lower()
        if len(word) > 3 and word.isalpha():
            import xxhash

            h = xxhash.xxh64_intdigest(word)
            self.vectors[k] = [((h >> (16 * d)) & 0xFFFF) / 0x8000 - 1 for d in range(DIMENSIONS)]
        return k

    def pieces(self, text: str) -> tuple[list[str], np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.forget()
        found = self.split.findall(text)
        index = self.index
        ids = [index[p] if p in index else self._learn(p) for p in found]
        return found, np.array(ids, np.int64)

    def size(self, text: str) -> int:
        _, ids = self.pieces(text)  # may enlarge the tables
        return int(self.sizes[ids].sum())


def sizer(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Sizer:
    """The worker's sizer of one vocabulary file."""
    path = os.path.join(folder, vocabulary)
    if path not in _loaded:
        _loaded[path] = Sizer(path)
    return _loaded[path]


def with_sizes(df: DataFrame, keys: list[str], text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of each row; a null text has null, an empty one 0."""
    src = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sizer(folder, vocabulary)
        for batch in batches:
            sizes = [None if t is None else count.size(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, pa.array(sizes, pa.int64())], names=[*keys, "n_tokens"])

    from pyspark.sql import types as T

    return src.mapInArrow(run, T.StructType([*src.drop("_text").schema.fields, T.StructField("n_tokens", T.LongType())]))
