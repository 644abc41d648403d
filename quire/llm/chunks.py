"""Splitting oversized texts at natural boundaries (problem 1).

Per text: the offsets of its tokens (code points here, or any tokenizer's pieces) are summed to sizes, the
possible cuts lie in one sorted array per kind of boundary, and each piece ends at the last boundary of
the best kind under the limit, found by binary search; the next piece starts the overlap earlier, again at a
boundary where there is one. A text without any boundary under the limit is cut hard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame, functions as F

#: Kinds of boundary from the most to the least natural: the position after the match is a possible cut.
_BOUNDARIES = [
    regex.compile(r"\f|\n[ \t]*\n+"),
    regex.compile(r"(?<=[.!?…。！？।]['\"”’»“\)\]]{0,2})\s+|(?<=[。！？])"),
    regex.compile(r"\n"),
    regex.compile(r"\s+"),
]
#: A boundary of a better kind is taken if it leaves the piece at least this full.
_FILL = (0.5, 0.5, 0.7, 0.0)


def token_offsets_by_chars(text: str) -> np.ndarray:
    """Every code point is a token: offsets 0..len."""
    return np.arange(len(text) + 1)


def cut_text(text: str, limit: int, overlap: int, offsets: Callable[[str], np.ndarray] = token_offsets_by_chars) -> list[tuple[int, int]]:
    """Half-open code point ranges of the pieces of ``text``, each of at most ``limit`` tokens.

    ``offsets`` gives the ascending code point offsets of the token borders (0 first, length last); their ranks are the
    prefix sums of size. A piece after the first repeats at most ``overlap`` tokens of the one before. An empty text has no
    piece. A single token longer than one code point is never cut.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than it")
    borders = np.asarray(offsets(text))
    total = len(borders) - 1
    if total <= 0:
        return []
    if total <= limit:
        return [(0, len(text))]
    cuts = []
    for pattern in _BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        rank = np.searchsorted(borders, ends)
        exact = borders[np.minimum(rank, total)] == ends
        cuts.append(np.unique(rank[exact]))
    pieces: list[tuple[int, int]] = []
    start = 0
    while True:
        if total - start <= limit:
            pieces.append((start, total))
            break
        # The end must lie beyond the overlap, or the next piece would not get further.
        end, floor = 0, start + overlap
        for kind, fill in zip(cuts, _FILL):
            k = int(np.searchsorted(kind, start + limit, side="right")) - 1
            if k >= 0 and kind[k] > max(floor, start + int(limit * fill)):
                end = int(kind[k])
                break
        if not end:
            end = start + limit
        pieces.append((start, end))
        start = end - overlap
        if overlap:
            for kind in cuts:  # the first good place to start within the overlap
                k = int(np.searchsorted(kind, start, side="left"))
                if k < len(kind) and kind[k] < end:
                    start = int(kind[k])
                    break
    return [(int(borders[a]), int(borders[b])) for a, b in pieces]


def pages_of(df: DataFrame, text: str = "text", pages: str = "pages") -> DataFrame:
    """One row per page: ``df`` without text and pages, plus ``number`` and ``page_text``.

    Page texts are the form-feed separated parts of the text; the k-th has the k-th smallest number in ``pages``, or k where
    ``pages`` is null, empty or shorter than the text has parts. A null text gives no pages, an empty one one empty page.
    """
    numbers = F.array_sort(F.filter(F.transform(F.col(pages), lambda p: p["number"]), lambda n: n.isNotNull()))
    rest = [c for c in df.columns if c not in (text, pages)]
    out = df.filter(F.col(text).isNotNull()).select(*rest, numbers.alias("_numbers"), F.posexplode(F.split(text, "\f")).alias("_k", "page_text"))
    number = F.coalesce(F.get("_numbers", F.col("_k")), F.col("_k") + 1).cast("long")
    return out.select(*rest, number.alias("number"), "page_text")


def split_oversized(df: DataFrame, text: str, limit: int = 3000, overlap: int = 200, offsets: Callable[[str], np.ndarray] = token_offsets_by_chars) -> DataFrame:
    """Every row of ``df`` as one row per piece of ``text``: the other columns, then ``piece_no`` (from 0), ``pieces``,
    ``start_offset``, ``end_offset`` (code points in the text) and ``piece``.

    Null and empty texts give no piece. Input columns with the names of the result are dropped in favour of these.
    A text is held in one task as a whole; nothing is shuffled.
    """
    made = ["piece_no", "pieces", "start_offset", "end_offset", "piece"]
    rest = [c for c in df.columns if c != text and c not in made]
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("_text"))
    schema = src.drop("_text").schema
    from pyspark.sql import types as T

    schema = T.StructType(schema.fields + [T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, of, start, end, piece = [], [], [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                if not t:
                    continue
                found = cut_text(t, limit, overlap, offsets)
                for k, (a, b) in enumerate(found):
                    at.append(i), no.append(k), of.append(len(found)), start.append(a), end.append(b), piece.append(t[a:b])
            kept = batch.select(rest).take(pa.array(at, pa.int64())) if rest else None
            arrays = [*(kept.columns if kept is not None else []), pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(piece, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *made])

    return src.mapInArrow(run, schema)
