"""Filling containers of fixed capacity with texts (problem 7).

Each text's hashed word vector is projected to a few dimensions and given its place on a Hilbert curve. The texts are
range-partitioned and sorted along the curve, and every partition packs neighbours: it takes a stretch of
the curve at a time and puts the stretch's pieces, largest first, into the open container they fill best.
Containers that are still open stay so for the next stretch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from quire.llm import tokens
from quire.session import Scratch

#: Bits per dimension of the curve; pieces packed at a time; containers kept open between stretches.
BITS, STRETCH, OPEN = 10, 4096, 256


def hilbert_key(point: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a point of the grid on the Hilbert curve (transposed axes, then interleaved bits)."""
    x = list(point)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def cut_pieces(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Ranges (first, last + 1, tokens) of pieces of the tokenizer's pattern, each of at most ``capacity`` tokens where no single one is larger."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out, a = [], 0
    while a < len(sizes):
        b = int(np.searchsorted(upto, upto[a] + capacity, side="right")) - 1
        b = max(b, a + 1)
        out.append((a, b, int(upto[b] - upto[a])))
        a = b
    return out


def measure(df: DataFrame, key: str, text: str, capacity: int, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Pieces: ``key``, ``piece_no``, ``start_offset``, ``end_offset`` (code points), ``n_tokens``, ``place`` on the curve.

    A text is one piece unless it alone exceeds the capacity.
    """
    src = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).filter("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.sizer(folder, vocabulary)
        for batch in batches:
            at, no, a, b, size, place = [], [], [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                found, ids = count.pieces(t)
                sizes = count.sizes[ids]
                total = int(sizes.sum())
                vector = count.vectors[ids].sum(0) if len(ids) else np.zeros(tokens.DIMENSIONS)
                # A sum of n independent signs is about normal with deviation sqrt(n / 3).
                z = vector / max(1.0, np.sqrt(len(ids) / 3))
                grid = tuple(int(v) for v in np.clip((1 / (1 + np.exp(-z))) * (1 << BITS), 0, (1 << BITS) - 1))
                where = hilbert_key(grid)
                ranges = [(0, len(found), total)] if total <= capacity else []
                if not ranges:
                    for x, y, n in cut_pieces(sizes, capacity):
                        ranges.append((x, y, n))
                lengths = None
                if len(ranges) > 1 or any(n > capacity for *_, n in ranges):
                    lengths = np.concatenate([[0], np.cumsum([len(p) for p in found])])
                k = 0
                for x, y, n in ranges:
                    if n <= capacity:
                        at.append(i), no.append(k), a.append(0 if lengths is None else int(lengths[x])), b.append(len(t) if lengths is None else int(lengths[y])), size.append(n), place.append(where)
                        k += 1
                        continue
                    # One unbroken run of signs larger than a container: cut hard between its characters.
                    s, e = int(lengths[x]), int(lengths[y])
                    while s < e:
                        lo, hi = s + 1, min(e, s + capacity)
                        while hi < e and len(count.encoding.encode_ordinary(t[s:hi])) <= capacity:
                            lo, hi = hi, min(e, s + 2 * (hi - s))  # a token holds more than one character
                        while lo < hi:
                            mid = (lo + hi + 1) // 2
                            if len(count.encoding.encode_ordinary(t[s:mid])) <= capacity:
                                lo = mid
                            else:
                                hi = mid - 1
                        at.append(i), no.append(k), a.append(s), b.append(lo), size.append(len(count.encoding.encode_ordinary(t[s:lo]))), place.append(where)
                        k += 1
                        s = lo
            keys = batch.column("_key").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int64()), pa.array(place, pa.int64())], names=[key, "piece_no", "start_offset", "end_offset", "n_tokens", "place"])

    from pyspark.sql import types as T

    kind = df.schema[key].dataType
    return src.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("place", T.LongType())]))


class Packer:
    """Best fit into open containers; the emptiest stay open between stretches."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.rooms: list[tuple[int, int]] = []  # (room, container), ascending

    def put(self, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            n = int(sizes[i])
            k = bisect_left(self.rooms, (n, -1))
            if k < len(self.rooms):
                room, c = self.rooms.pop(k)
            else:
                room, c = self.capacity, self.next
                self.next += 1
            out[i] = c
            if room > n:
                insort(self.rooms, (room - n, c))
        # The fullest can hold little; the roomiest are worth keeping.
        if len(self.rooms) > OPEN:
            self.rooms = self.rooms[-OPEN:]
        return out


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY, tokens_per_task: int = 4_000_000) -> DataFrame:
    """Assign all texts to containers of ``capacity`` tokens: ``key``, ``piece_no``, ``start_offset``, ``end_offset``, ``n_tokens``, ``container_id``.

    No text is split unless it alone exceeds the capacity. Null texts are left out; empty texts take no room and lie in some container.
    Repeated rows are packed as often as they come. Other columns are ignored. Each task leaves a few containers part-filled, so
    ``tokens_per_task`` bounds the loss; it does not depend on the number of executors.
    """
    pieces = Scratch(df.sparkSession, "pack").write(measure(df, key, text, capacity, folder, vocabulary), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = max(1, -(-total // tokens_per_task))
    along = pieces.repartitionByRange(parts, "place", key, "piece_no").sortWithinPartitions("place", key, "piece_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= STRETCH:
                stretch = pd.concat(held, ignore_index=True)
                yield stretch.drop(columns="place").assign(container_id=packer.put(stretch["n_tokens"].to_numpy()))
                held, rows = [], 0
        if held:
            stretch = pd.concat(held, ignore_index=True)
            yield stretch.drop(columns="place").assign(container_id=packer.put(stretch["n_tokens"].to_numpy()))

    from pyspark.sql import types as T

    return along.mapInPandas(run, T.StructType([*pieces.drop("place").schema.fields, T.StructField("container_id", T.LongType())]))


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: ``containers``, ``pieces``, ``tokens``, ``fill`` (share of the room used), ``fullest``."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("pieces"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.max("n").alias("fullest"))
