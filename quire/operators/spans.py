"""Texts to pages, lines and character-offset spans.

Offsets are Unicode code points, half open. Tokenizing needs the offsets of every match, which Spark's
regular expression functions do not give; deriving them by a running sum would shuffle every token by document. So
matches are found batch-wise in Arrow, without any shuffle, and everything after is a plain DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quire.session import Scratch

# The patterns of the stock tokenizers; a named or first group, where there is one, is the token.
PATTERNS = {
    "whitespace": r"[^ \n\t\f]+",
    "whitespace_no_punctuation": r"[^ \n\t\f\,\.\;]+",
    "connected_text": r"(?:(?:[^ \t\n]+(?:[ \t][^ \t\n\:\,\.\!\?\-\_]+)*)+)",
    "colon_preceded": r":[ \t]((?:[^ \t\n\:\,\!\?\_]+(?:[ \t][^ \t\n\:\!\?\_]+)*)+)",
    "colon_or_whitespace_preceded": r"[ :][ \t](?P<ColonOrWhitespacePreceded>(?:[^ \t\n\:\,\!\?\_]+(?:[ \t][^ \t\n\:\!\?\_]+)*)+)",
    "capitalized_text": r"(?:[A-ZÄÜÖß][a-zA-Z&äöü]+(?=\s[A-ZÄÜÖß])(?:\s[A-Z&ÄÜÖß][a-zA-Z&äöü]+)+)",
    "non_text": r"(?:(?:[A-Z\d]+[:\/. -]{0,2}\n?)+)",
    "numbers": r"\s((?:[\d+][ ]?)+)\s",
    "line_until_comma": r"\n\s*([^.]*),\n",
}
# The tokenizers whose spans are runs of all but some ASCII characters, with these as a table.
_SEPARATORS = {name: np.isin(np.arange(128), [ord(c) for c in chars]) for name, chars in (("whitespace", " \n\t\f"), ("whitespace_no_punctuation", " \n\t\f,.;"))}
_LINE_END = regex.compile(r"[\n\f]")


def regex_spans(df: DataFrame, key: str, text: str, pattern: str, name: str | None = None) -> DataFrame:
    """One row per match: ``key``, ``start_offset``, ``end_offset``, ``offset_string`` (and ``tokenizer`` if ``name`` is given).

    Groups, where the pattern has any that took part, count instead of the whole match. Matches of no characters, and
    spans over a line or page end, are no spans. Null texts give none. Distinct offsets only.
    """
    src = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        groups = range(1, compiled.groups + 1)
        for batch in batches:
            at, a, b, s = [], [], [], []
            for i, t in enumerate(batch.column("_t").to_pylist()):
                if not t:
                    continue
                seen = set()
                for m in compiled.finditer(t):
                    spans = [m.span(g) for g in groups if m.start(g) >= 0] or [m.span()]
                    for x, y in spans:
                        if y > x and (x, y) not in seen and "\n" not in (piece := t[x:y]) and "\f" not in piece:
                            seen.add((x, y))
                            at.append(i), a.append(x), b.append(y), s.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=[key, "start_offset", "end_offset", "offset_string"])

    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType()), T.StructField("offset_string", T.StringType())]
    out = src.mapInArrow(run, T.StructType(fields))
    return out.withColumn("tokenizer", F.lit(name)) if name else out


def tokenize(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """Spans of a stock tokenizer (see ``PATTERNS``)."""
    return regex_spans(df, key, text, PATTERNS[tokenizer])


def _span_set(compiled, t: str) -> set[tuple[int, int]]:
    groups = range(1, compiled.groups + 1)
    out = set()
    for m in compiled.finditer(t):
        for x, y in [m.span(g) for g in groups if m.start(g) >= 0] or [m.span()]:
            if y > x and "\n" not in (piece := t[x:y]) and "\f" not in piece:
                out.add((x, y))
    return out


def compare_tokenizers(df: DataFrame, keep: Sequence[str], text: str, gold: str, predicted: str) -> DataFrame:
    """``keep`` and the counts ``tp``, ``fp``, ``fn`` of each text: spans both stock tokenizers make, only the second, only the first.

    Both are run on a text in the same task, so comparing them needs neither a join nor a shuffle. Null texts give none.
    """
    src = df.select(*keep, F.col(f"`{text}`").alias("_t")).filter("_t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = regex.compile(PATTERNS[gold]), regex.compile(PATTERNS[predicted])
        for batch in batches:
            tp, fp, fn = [], [], []
            for t in batch.column("_t").to_pylist():
                x, y = _span_set(a, t), _span_set(b, t)
                both = len(x & y)
                tp.append(both), fp.append(len(y) - both), fn.append(len(x) - both)
            yield pa.RecordBatch.from_arrays([*batch.select(list(keep)).columns, *[pa.array(c, pa.int64()) for c in (tp, fp, fn)]], names=[*keep, "tp", "fp", "fn"])

    return src.mapInArrow(run, T.StructType([*src.drop("_t").schema.fields, *[T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn")]]))


def _points(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


def ordered_spans(tokenizer: str, t: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a stock tokenizer's spans of one text, in order; what counts as a span is as in ``regex_spans``."""
    if tokenizer in _SEPARATORS:  # runs of other characters, found without a match object each
        inside = np.zeros(len(t) + 2, np.int8)
        inside[1:-1] = ~_SEPARATORS[tokenizer][np.minimum(_points(t), 127)]
        edges = np.flatnonzero(np.diff(inside))
        return edges[0::2], edges[1::2]
    found = sorted(_span_set(regex.compile(PATTERNS[tokenizer]), t))
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def blanks_before(t: str, a: np.ndarray, b: np.ndarray, most: int = 5) -> np.ndarray:
    """Whether only blanks, at most ``most`` or none, lie between each span of one text and the span before it."""
    blanks = np.concatenate([[0], np.cumsum(_points(t) == 32)])
    gap = a[1:] - b[:-1]
    return np.concatenate([[False], (gap >= 0) & (gap <= most) & (blanks[a[1:]] - blanks[b[:-1]] == gap)])


def starts(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """``key`` and ``start_offset`` of the spans of a stock tokenizer. Null texts give none."""
    src = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).filter("_t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64), *[ordered_spans(tokenizer, t)[0] for t in batch.column("_t").to_pylist()]]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found]) - 1
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at)), pa.array(np.concatenate(found))], names=[key, "start_offset"])

    return src.mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("start_offset", T.LongType())]))


def line_of(t: str, offsets: np.ndarray) -> np.ndarray:
    """The line that holds each offset of one text, counted from 0; line ends and form feeds end a line."""
    ends = np.array([m.start() for m in _LINE_END.finditer(t)], np.int64)
    return np.searchsorted(ends, offsets)


def beside(line: np.ndarray, text: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``i``-th span before and after each, -1 where that is on another line or in another text. The spans are in order."""
    n = len(line)
    at = np.arange(n)
    before, after = at - i, at + i
    left = np.where((before >= 0) & (line[np.maximum(before, 0)] == line) & (text[np.maximum(before, 0)] == text), before, -1)
    last = np.minimum(after, n - 1)
    return left, np.where((after < n) & (line[last] == line) & (text[last] == text), after, -1)


def distance(place: np.ndarray, left: bool, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters between each span and the one at ``place``; 100000 where there is none."""
    return np.where(place < 0, 100000, a - b[place] if left else a[place] - b)


def relative(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Offsets as shares of their text, six decimals, half up: in whole numbers, so that they are those of SQL's round."""
    start, length = start.astype(np.int64), length.astype(np.int64)
    return ((2_000_000 * start + length) // (2 * length)) / 1e6


def in_context(df: DataFrame, key: str, text: str, tokenizer: str, only: str, n: int = 1) -> DataFrame:
    """Some spans of a stock tokenizer with what stands around them: ``offset_string``, ``line_index``, neighbours (see ``neighbours``), ``relative_position`` and
    ``first_word_string``. ``only`` is the column with the starts of the spans asked for. Nothing is shuffled. Null texts give none.
    """
    src = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"), F.col(only).alias("_o")).filter("_t is not null")
    sides = [(f"{side}_dist{i}", f"{side}_text{i}") for i in range(n) for side in ("l", "r")]
    names = [key, "start_offset", "end_offset", "offset_string", "line_index", *chain.from_iterable(sides), "relative_position", "first_word_string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], [[] for _ in names[1:]]
            for k, (t, asked) in enumerate(zip(batch.column("_t").to_pylist(), batch.column("_o").to_pylist())):
                a, b = ordered_spans(tokenizer, t)
                if not len(a):
                    continue
                line, same = line_of(t, a), np.zeros(len(a), np.int64)
                picked = np.flatnonzero(np.isin(a, asked))
                around = []
                for i in range(n):
                    for left, place in zip((True, False), beside(line, same, i + 1)):
                        around += [distance(place, left, a, b)[picked].tolist(), [t[a[j] : b[j]] if j >= 0 else "" for j in place[picked]]]
                first = t[a[0] : b[0]]
                rows = [a[picked].tolist(), b[picked].tolist(), [t[a[j] : b[j]] for j in picked], line[picked].tolist(), *around, relative(a[picked], np.full(len(picked), len(t))).tolist(), [first] * len(picked)]
                at += [k] * len(picked)
                for column, values in zip(out, rows):
                    column += values
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(out, arrow)]], names=names)

    kinds = {"start_offset": T.LongType(), "end_offset": T.LongType(), "line_index": T.IntegerType(), "relative_position": T.DoubleType()} | {d: T.LongType() for d, _ in sides}
    arrow = [{T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}.get(kinds.get(c), pa.string()) for c in names[1:]]
    return src.mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(c, kinds.get(c, T.StringType())) for c in names[1:]]]))


def list_tokenizer(df: DataFrame, key: str, text: str, tokenizers: Sequence[str]) -> DataFrame:
    """Union of several tokenizers' spans; a span made by more than one belongs to the first in the list."""
    parts = [tokenize(df, key, text, t).withColumn("tokenizer", F.lit(t)).withColumn("_rank", F.lit(i)) for i, t in enumerate(tokenizers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "start_offset", "end_offset").agg(F.min_by("tokenizer", "_rank").alias("tokenizer"), F.first("offset_string").alias("offset_string"))


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pages of each text: ``key``, ``page_index``, ``start_offset``, ``end_offset``, ``page_text``; page ends are form feeds.

    Offsets are running sums over the page lengths, taken text by text: nothing is shuffled. Null texts have no pages, an
    empty text has one empty page.
    """
    return _parts(df, key, text, "\f", "page")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text: ``key``, ``line_index``, ``start_offset``, ``end_offset``, ``line_text``; a form feed also ends a line."""
    return _parts(df, key, text, "\n", "line")


def _parts(df: DataFrame, key: str, text: str, end: str, name: str) -> DataFrame:
    src = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, a, b, s = [], [], [], [], []
            for i, t in enumerate(batch.column("_t").to_pylist()):
                start = 0
                for k, part in enumerate((t.replace("\f", "\n") if end == "\n" else t).split(end)):
                    at.append(i), no.append(k), a.append(start), b.append(start + len(part)), s.append(part)
                    start += len(part) + 1
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=[key, f"{name}_index", "start_offset", "end_offset", f"{name}_text"])

    fields = [T.StructField(key, df.schema[key].dataType), T.StructField(f"{name}_index", T.IntegerType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType()), T.StructField(f"{name}_text", T.StringType())]
    return src.mapInArrow(run, T.StructType(fields))


def page_and_line_index(start: Column, text: Column) -> tuple[Column, Column]:
    """Page and line of an offset: form feeds, and line ends of both kinds, before it. For few spans of a text; else join ``lines``."""
    prefix = F.substring(text, F.lit(1), start.cast("int"))

    def count(chars: str) -> Column:
        return F.length(prefix) - F.length(F.translate(prefix, chars, ""))

    return count("\f"), count("\n\f")


#: Characters of a block of positions. Ranges meet within the blocks they reach into, never all with all of a document.
BLOCK = 64


def in_blocks(df: DataFrame, start: str, end: str, block: str = "_block", first: str | None = None) -> DataFrame:
    """``df`` with one row per block that a range reaches into (its end counts); ``first`` names a column for the first of them."""
    out = df.withColumn(block, F.explode(F.sequence(F.floor(F.col(start) / BLOCK), F.floor(F.col(end) / BLOCK))))
    return out.withColumn(first, F.floor(F.col(start) / BLOCK)) if first else out


def locate(spans: DataFrame, key: str, table: DataFrame, index: str) -> DataFrame:
    """``spans`` with the ``index`` of the page or line (a table of ``pages`` or ``lines``) that holds their start.

    Spans and parts meet by document and block of positions: a start lies in one block, so each span meets the few parts of its block, and a
    long document is spread over its blocks.
    """
    t = in_blocks(table.select(F.col(key).alias("_k"), index, F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b")), "_a", "_b", "_tb")
    own = spans.withColumn("_sb", F.floor(F.col("start_offset") / BLOCK))
    return own.join(t, (own[key] == t["_k"]) & (own["_sb"] == t["_tb"]) & (own["start_offset"] >= t["_a"]) & (own["start_offset"] <= t["_b"])).drop("_k", "_a", "_b", "_tb", "_sb")


def merge_horizontal(spans: DataFrame, text: DataFrame, key: str, group: Sequence[str], max_gap: int = 5, threshold: float | None = None) -> DataFrame:
    """Neighbouring spans of one group (document, label, ...) joined where only blanks, at most ``max_gap``, lie between.

    Gaps and islands: a span starts an island if what precedes it is not joinable. Result: the group, ``start_offset``, ``end_offset``,
    ``parts`` and the mean ``confidence`` if there is one. ``text`` has ``key`` and ``text``. Spans begin and end in other characters than
    blanks, so a gap of blanks is a whole run of them: the runs are found map-only and met by their offsets, and no text
    travels with the spans. With ``threshold`` both neighbours need a ``confidence`` of at least that.
    """
    w = Window.partitionBy(*group).orderBy("start_offset", "end_offset")
    runs = regex_spans(text, key, "text", rf"(?<! ) {{1,{max_gap}}}(?! )").select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"))
    prev = spans.withColumn("_prev", F.lag("end_offset").over(w))
    if threshold is not None:
        prev = prev.withColumn("_before", F.lag("confidence").over(w))
    joined = prev.join(runs, (prev[key] == runs["_k"]) & (prev["_prev"] == runs["_a"]) & (prev["start_offset"] == runs["_b"]), "left")
    together = F.col("_a").isNotNull() | (F.col("start_offset") == F.col("_prev"))
    if threshold is not None:
        together = together & (F.col("confidence") >= threshold) & (F.col("_before") >= threshold)
    flagged = joined.withColumn("_new", F.when(F.coalesce(together, F.lit(False)), 0).otherwise(1)).drop("_k", "_a", "_b")
    island = flagged.withColumn("_island", F.sum("_new").over(w))
    aggs = [F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count(F.lit(1)).alias("parts")]
    if "confidence" in spans.columns:
        aggs.append(F.avg("confidence").alias("confidence"))
    return island.groupBy(*group, "_island").agg(*aggs).drop("_island")


def missing_offsets(spans: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """The stretches of each text that no span covers, half open. ``lengths`` has ``key`` and ``length``. Overlapping spans count as their union."""
    ends = spans.select(key, "start_offset", "end_offset").unionByName(lengths.select(key, F.col("length").cast("long").alias("start_offset"), F.col("length").cast("long").alias("end_offset")))
    before = Window.partitionBy(key).orderBy("start_offset", "end_offset").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end_offset").over(before), F.lit(0).cast("long"))
    out = ends.withColumn("_upto", covered).filter(F.col("start_offset") > F.col("_upto"))
    return out.select(key, F.col("_upto").alias("start_offset"), F.col("start_offset").alias("end_offset"))


def neighbours(spans: DataFrame, key: str, line: str, n: int = 1) -> DataFrame:
    """The ``n`` next spans to the left and right on the same line, as ``l_dist{i}``, ``l_text{i}``, ``r_dist{i}``, ``r_text{i}``; distance 100000 and empty text where there is none."""
    w = Window.partitionBy(key, line).orderBy("start_offset")
    out = spans
    for i in range(n):
        out = (
            out.withColumn(f"l_dist{i}", F.coalesce(F.col("start_offset") - F.lag("end_offset", i + 1).over(w), F.lit(100000)))
            .withColumn(f"l_text{i}", F.coalesce(F.lag("offset_string", i + 1).over(w), F.lit("")))
            .withColumn(f"r_dist{i}", F.coalesce(F.lead("start_offset", i + 1).over(w) - F.col("end_offset"), F.lit(100000)))
            .withColumn(f"r_text{i}", F.coalesce(F.lead("offset_string", i + 1).over(w), F.lit("")))
        )
    return out


def contained_in(spans: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """``spans`` with the ``label`` of the first gold span (by offsets) that contains them, null if none does.

    What contains a span reaches into the block of its start, so the two meet by document and block.
    """
    g = in_blocks(gold.select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"), F.col(label).alias(f"_{label}")), "_a", "_b", "_gb")
    own = spans.withColumn("_sb", F.floor(F.col("start_offset") / BLOCK))
    hit = own.join(g, (own[key] == g["_k"]) & (own["_sb"] == g["_gb"]) & (own["start_offset"] >= g["_a"]) & (own["end_offset"] <= g["_b"]), "left")
    first = F.min_by(f"_{label}", F.struct("_a", "_b")).alias(label)
    return hit.groupBy(key, "start_offset", "end_offset").agg(first)


def vocabulary(tokens: DataFrame, token: str, min_freq: int = 1, max_size: int | None = None, specials: Sequence[str] = ("<unk>", "<pad>")) -> DataFrame:
    """``token``, ``idx``, ``freq``: the specials first, then tokens by frequency, ties by token. The size is the feature's own limit."""
    counts = tokens.filter(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_freq)
    counts = counts.filter(~F.col("token").isin(list(specials)))
    if max_size is not None:
        counts = counts.orderBy(F.desc("freq"), "token").limit(max_size)
    # Ranks without gathering the vocabulary in one task: sort by range, then add the sizes of the partitions before. The sorted table is written, so
    # sizes and places are those of one run.
    ordered = counts.orderBy(F.desc("freq"), "token").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ordered = Scratch(tokens.sparkSession, "vocabulary").write(ordered, "ordered")
    sizes = {r["_p"]: r["n"] for r in ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, offsets = len(specials), {}
    for p in sorted(sizes):
        offsets[p] = offset
        offset += sizes[p]
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else None
    head = tokens.sparkSession.createDataFrame([(s, i, None) for i, s in enumerate(specials)], "token string, idx long, freq long")
    if shift is None:
        return head
    body = ordered.select("token", (shift[F.col("_p")] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("idx"), "freq")
    return head.unionByName(body)


def numericalize(tokens: DataFrame, key: str, place: str, token: str, vocab: DataFrame, max_length: int | None = None, unknown: str = "<unk>", pad: str = "<pad>") -> DataFrame:
    """``key`` and ``indices``: each document's tokens in order of ``place`` as numbers of the vocabulary; unknown ones become that of ``unknown``.

    Only the first ``max_length`` tokens count, if it is given (the model's own limit). A document without tokens (a null token) gives the number of
    ``pad``. Tokens meet the vocabulary by a join on the token, its frequent entries as broadcast by the optimizer where it is small.
    """
    special = {r["token"]: r["idx"] for r in vocab.filter(F.col("token").isin(unknown, pad)).collect()}  # two rows
    known = vocab.select(F.col("token").alias("_v"), F.col("idx").alias("_i"))
    at = tokens.join(known, tokens[token] == known["_v"], "left").withColumn("_i", F.coalesce("_i", F.lit(special.get(unknown))))
    listed = at.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col(token).isNotNull(), F.struct(F.col(place).alias("p"), F.col("_i").alias("i"))))).alias("t"))  # the tokens of one document
    numbers = F.transform("t", lambda x: x["i"])
    if max_length is not None:
        numbers = F.slice(numbers, 1, max_length)
    return listed.select(key, F.when(F.size("t") == 0, F.array(F.lit(special.get(pad)))).otherwise(numbers).alias("indices"))


def sentences_of_spans(spans: DataFrame, key: str, punctuation: str = ".!?") -> DataFrame:
    """Spans cut after every mark of ``punctuation``, with ``sentence``, counted from 0 in a document: a mark ends one, and a sentence runs on over
    spans that end without a mark. ``spans`` has ``key``, ``start_offset`` and ``offset_string``."""
    pieces = F.expr(f"regexp_extract_all(offset_string, '[^{punctuation}]*[{punctuation}]|[^{punctuation}]+$', 0)")
    cut = spans.filter("offset_string <> ''").select(key, "start_offset", F.posexplode(F.transform(pieces, lambda x: x)).alias("_n", "_t"), pieces.alias("_all"))
    before = F.aggregate(F.slice("_all", 1, F.col("_n")), F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    cut = cut.select(key, (F.col("start_offset") + before).alias("start_offset"), (F.col("start_offset") + before + F.length("_t")).alias("end_offset"), F.col("_t").alias("offset_string"))
    w = Window.partitionBy(key).orderBy("start_offset").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.col("offset_string").rlike(f"[{punctuation}]$").cast("long")
    return cut.withColumn("sentence", F.coalesce(F.sum(ended).over(w), F.lit(0)))
