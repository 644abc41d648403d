"""Patterns of labels: matching with groups, proposals from annotations, their evaluation over a corpus, and the choice of a covering few.

Patterns are applied in Arrow batches, all of them to a text at once; what they find is narrow and is joined with the annotations by offsets.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import regex

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quire.functions import strings

#: Patterns that are applied together at most; more raises. A search proposes a few per annotation, so pass a bounded set of annotations.
MOST_PATTERNS = 100_000
#: Characters of context tried before and after a span.
SPACERS = (1, 3, 5)

_GROUP = regex.compile(r"\?P<[^>]*>")


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern compiled; group names that may not stand get an underscore before them."""
    try:
        return regex.compile(pattern)
    except regex.error:
        return regex.compile(regex.sub(r"\?P<(?=[^>]*>)(?![A-Za-z_])", "?P<_", pattern))


def matches(compiled: regex.Pattern, text: str, overlapped: bool = False, keep_full_match: bool = True, group: str | None = None, exact: bool = False) -> Iterator[tuple[str, int, int]]:
    """(group, start, end) of all matches: named groups by name, then unnamed by number, then the whole as "0"; none without characters.

    ``group`` keeps groups whose name contains it, or is it if ``exact``. A pattern without groups gives the whole only.
    """
    names = compiled.groupindex
    numbered = [str(i) for i in range(1, compiled.groups + 1) if i not in names.values()]
    for m in compiled.finditer(text, overlapped=overlapped):
        for name in (*names, *numbered):
            a, b = m.span(int(name) if name.isdigit() else name)
            if b > a and (group is None or (name == group if exact else group in name)):
                yield name, a, b
        if (keep_full_match or not compiled.groups) and m.end() > m.start() and (group is None or (group == "0" if exact else group in "0")):
            yield "0", m.start(), m.end()


def find_matches(df: DataFrame, key: str, text: str, pattern: str, **options) -> DataFrame:
    """``key``, ``regex_group``, ``value``, ``start_offset``, ``end_offset`` of all matches (see ``matches`` for the options). Null texts give none."""
    src = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_pattern(pattern)
        for batch in batches:
            rows = [(i, g, t[a:b], a, b) for i, t in enumerate(batch.column("_t").to_pylist()) if t for g, a, b in matches(compiled, t, **options)]
            at, *cols = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=schema.names)

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("regex_group", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType())])
    return src.mapInArrow(run, schema)


def candidates(df: DataFrame, key: str, text: str, pattern: str, overlapped: bool = False, group: str | None = None) -> DataFrame:
    """Each text cut into candidates and what lies between: ``key``, ``piece_no``, ``is_candidate``, ``value``, ``start_offset``, ``end_offset``.

    Candidates are the groups of the matches, or the matches of a pattern without groups; before, between and after them stands the other text, maybe
    empty. After an overlapping candidate the other text is empty.
    """
    src = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).filter("_t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_pattern(pattern)
        for batch in batches:
            at, no, found, value, start, end = [], [], [], [], [], []
            for i, t in enumerate(batch.column("_t").to_pylist()):
                upto, n = 0, 0
                spans = [(a, b) for _, a, b in matches(compiled, t, overlapped, False, group)]
                for a, b in [*spans, (len(t), None)]:
                    for is_candidate, x, y in ((False, upto, max(a, upto)), (True, a, b)):
                        if y is not None:
                            at.append(i), no.append(n), found.append(is_candidate), value.append(t[x:y]), start.append(x), end.append(y)
                            n += 1
                    upto = b
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(found, pa.bool_()), pa.array(value, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=schema.names)

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("is_candidate", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType())])
    return src.mapInArrow(run, schema)


def suggested(text: str, characters: bool = False, numbers: bool = True) -> str:
    """A pattern for texts like ``text``: metacharacters escaped, blanks made lenient, digits and maybe letters made classes; one letter stays one."""
    out = regex.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", text)
    if characters:
        out = regex.sub(r"[A-ZÄÖÜ]+", lambda m: "\x01" + "+" * (len(m.group()) > 1), out)
        out = regex.sub(r"[a-zäöüß]+", lambda m: "\x02" + "+" * (len(m.group()) > 1), out)
    if numbers:
        out = regex.sub(r"\d", lambda m: r"\d", out)
    out = regex.sub(r" +", lambda m: "[ ]{1,2}" if len(m.group()) == 1 else "[ ]{2,}", out)
    out = out.replace("\n", "\\n").replace("\f", "\\f").replace("\t", "\\t")
    return out.replace("\x01", "[A-ZÄÖÜ]").replace("\x02", "[a-zäöüß]")


def plausible(pattern: str, text: str) -> str:
    """``pattern`` if it compiles and finds something in ``text``, else nothing."""
    try:
        return pattern if regex.search(pattern, text) else ""
    except regex.error:
        return ""


def merged(patterns: Sequence[str]) -> str:
    """An alternation of the patterns, the longest first (of equals the first given); nothing of none."""
    return f"(?:{'|'.join(sorted(patterns, key=len, reverse=True))})" if patterns else ""


def proposals(annotations: DataFrame, label: str = "label") -> DataFrame:
    """Three patterns of each span (blanks made lenient; digits too; letters too), once per label: ``label``, ``pattern``, ``quality`` 0, 1, 2, ``annotations`` that propose it.

    ``annotations`` has ``label`` and ``offset_string``. Of equal patterns the lowest quality counts, as the first that was proposed.
    """
    texts = annotations.filter("offset_string <> ''").groupBy(label, "offset_string").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, quality = [], [], []
            for i, t in enumerate(batch.column("offset_string").to_pylist()):
                for q, options in enumerate(({"numbers": False}, {}, {"characters": True})):
                    p = plausible(suggested(t, **options), t)
                    if p:
                        at.append(i), found.append(p), quality.append(q)
            kept = batch.select([label, "n"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found, pa.string()), pa.array(quality, pa.int32())], names=[label, "n", "pattern", "quality"])

    schema = T.StructType([texts.schema[label], T.StructField("n", T.LongType()), T.StructField("pattern", T.StringType()), T.StructField("quality", T.IntegerType())])
    return texts.mapInArrow(run, schema).groupBy(label, "pattern").agg(F.min("quality").alias("quality"), F.sum("n").alias("annotations"))


def group_name(label: Column, kind: str, annotation: Column, start: Column) -> Column:
    """The name of the group that marks a proposal of a span: ``Label_{label}_{kind}_{annotation}_{start}``."""
    return F.concat_ws("_", F.lit("Label"), label, F.lit(kind), annotation, start)


def evaluate(texts: DataFrame, annotations: DataFrame, patterns: DataFrame, key: str = "doc_id", label: str = "label", text: str = "text") -> DataFrame:
    """Each label's patterns judged by its annotations over all ``texts``: one row per label and pattern, with ``findings`` (distinct offsets),
    ``correct`` ones, ``annotations`` of the label, ``documents`` matched rightly, ``document_recall``, ``annotation_precision``, ``annotation_recall``, ``f1``,
    ``runtime`` in seconds, and ``found``, the number of the label's annotations it finds.

    ``patterns`` has ``label``, ``pattern`` and maybe ``quality``. A pattern is applied once, however many labels have it.
    """
    rows = patterns.select("pattern").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    listed = [r["pattern"] for r in rows]
    src = texts.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [compile_pattern(p) for p in listed]
        for batch in batches:
            at, no, a, b, took = [], [], [], [], []
            for i, t in enumerate(batch.column("_t").to_pylist()):
                for n, c in enumerate(compiled) if t else ():
                    begin = time.perf_counter()
                    found = {(x, y) for _, x, y in matches(c, t, keep_full_match=False)}
                    spent = time.perf_counter() - begin
                    for k, (x, y) in enumerate(sorted(found) or [(None, None)]):
                        at.append(i), no.append(listed[n]), a.append(x), b.append(y), took.append(0.0 if k else spent)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), pa.array(no, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(took, pa.float64())], names=schema.names)

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("pattern", T.StringType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType()), T.StructField("seconds", T.DoubleType())])
    found = src.mapInArrow(run, schema).join(F.broadcast(patterns.select("pattern", label)), on="pattern")
    gold = annotations.select(key, "start_offset", "end_offset", label).distinct().withColumn("_y", F.lit(1))
    judged = found.join(gold, on=[key, "start_offset", "end_offset", label], how="left")
    per = judged.groupBy(label, "pattern").agg(
        F.count("start_offset").alias("findings"), F.count("_y").alias("correct"), F.countDistinct(F.when(F.col("_y") == 1, F.col(key))).alias("documents"), F.round(F.sum("seconds"), 3).alias("runtime"),
    )
    sizes = gold.groupBy(label).agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct(key).alias("_docs"))
    out = patterns.drop("annotations").join(per, on=[label, "pattern"], how="left").join(F.broadcast(sizes), on=label, how="left").fillna(0, subset=["findings", "correct", "documents", "annotations", "_docs", "runtime"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = out.withColumn("annotation_precision", ratio(F.col("correct"), F.col("findings"))).withColumn("annotation_recall", ratio(F.col("correct"), F.col("annotations"))).withColumn("document_recall", ratio(F.col("documents"), F.col("_docs")))
    return out.withColumn("f1", ratio(2 * F.col("annotation_precision") * F.col("annotation_recall"), F.col("annotation_precision") + F.col("annotation_recall"))).drop("_docs")


def best_patterns(evaluated: DataFrame, texts: DataFrame, annotations: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """The patterns that each find an annotation no better one has found: ``label``, ``pattern``, ``rank``, ``new``.

    Ranked by correct findings, f1, quality and precision, falling, and runtime, rising (equal ones by pattern); patterns without a correct finding are none. A pattern adds
    something exactly if it is the best of some annotation, so no order is walked.
    """
    good = evaluated.filter("f1 > 0")
    order = [F.desc("correct"), F.desc("f1"), *([F.desc("quality")] if "quality" in evaluated.columns else []), F.desc("annotation_precision"), "runtime", "pattern"]
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order))).select(label, "pattern", "rank")  # the patterns of one label
    rows = ranked.collect()  # at most MOST_PATTERNS
    listed: dict = {}
    for r in rows:
        listed.setdefault(r["pattern"], []).append((r[label], r["rank"]))
    src = texts.select(F.col(f"`{key}`").alias("_k"), F.col("text").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(compile_pattern(p), p) for p in listed]
        for batch in batches:
            out = [(i, p, x, y) for i, t in enumerate(batch.column("_t").to_pylist()) if t for c, p in compiled for x, y in {(x, y) for _, x, y in matches(c, t, keep_full_match=False)}]
            at, p, a, b = map(list, zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(at, pa.int64())), pa.array(p, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("pattern", T.StringType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType())])
    ranks = texts.sparkSession.createDataFrame(rows, ranked.schema)
    gold = annotations.select(key, "start_offset", "end_offset", label).distinct()
    hit = src.mapInArrow(run, schema).join(F.broadcast(ranks), on="pattern").join(gold, on=[key, "start_offset", "end_offset", label])
    first = hit.groupBy(key, "start_offset", "end_offset", label).agg(F.min(F.struct("rank", "pattern")).alias("b"))
    return first.groupBy(label, F.col("b.pattern").alias("pattern"), F.col("b.rank").alias("rank")).agg(F.count(F.lit(1)).alias("new"))


def base_patterns(best: DataFrame, label: str = "label") -> dict:
    """Each label's best patterns made one alternation."""
    out: dict = {}
    for r in best.orderBy(label, "rank").collect():  # at most MOST_PATTERNS
        out.setdefault(r[label], []).append(r["pattern"])
    return {name: merged(patterns) for name, patterns in out.items()}


def with_context(texts: DataFrame, annotations: DataFrame, base: Mapping, key: str = "doc_id", label: str = "label", most_per_page: int = 100) -> DataFrame:
    """Patterns of each label in the context of its spans: ``label``, ``pattern``, ``quality`` (the characters of context).

    For one, three and five characters after a span, and three times as many before it (one for the first), the context is made a pattern: annotated pieces by their
    label's base pattern, the rest by its form. The label's base pattern, a group of its own, stands between; besides both sides, each side is tried with the smallest context on
    the other. A pattern that finds ``most_per_page`` or more a page in the document it comes from is left out.
    """
    one = F.struct(F.col("start_offset").alias("a"), F.col("end_offset").alias("b"), F.col(label).alias("l"))
    listed = annotations.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_set(one)).alias("spans"))  # the annotations of one document
    src = texts.select(key, "text").join(listed, F.col(key) == F.col("_k")).select("text", "spans")
    bare = {name: _GROUP.sub("", p) for name, p in base.items()}

    def context(t: str, spans: list, a: int, b: int) -> str:
        out, at = "", a
        for s in spans:
            if s["b"] <= a or s["a"] >= b or s["l"] not in bare:
                continue
            out += suggested(t[at : max(s["a"], at)], characters=True) + bare[s["l"]]
            at = max(at, s["b"])
        return out + suggested(t[at:b], characters=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                for s in spans if t else ():
                    if s["l"] not in base:
                        continue
                    core = f"({bare[s['l']]})"
                    before = {n: context(t, spans, max(0, s["a"] - (3 * n if n > 1 else n)), s["a"]) for n in SPACERS}
                    after = {n: context(t, spans, s["b"], min(len(t), s["b"] + n)) for n in SPACERS}
                    for n in SPACERS:
                        for p in (before[n] + core + after[n], before[SPACERS[0]] + core + after[n], before[n] + core + after[SPACERS[0]]):
                            if (s["l"], p) not in found:
                                count = sum(1 for _ in compile_pattern(p).finditer(t))
                                if count / (t.count("\f") + 1) < most_per_page:
                                    found[s["l"], p] = n
            kind = batch.column("spans").type.value_type.field("l").type
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], kind), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int32())], names=[label, "pattern", "quality"])

    schema = T.StructType([annotations.schema[label], T.StructField("pattern", T.StringType()), T.StructField("quality", T.IntegerType())])
    return src.mapInArrow(run, schema).groupBy(label, "pattern").agg(F.min("quality").alias("quality"))


def learn_patterns(texts: DataFrame, annotations: DataFrame, key: str = "doc_id", label: str = "label", context: bool = True) -> DataFrame:
    """The covering patterns of each label, learned from its annotations (which have ``offset_string``): ``label``, ``pattern``, ``rank``, ``new``.

    First the base pattern of each label from its spans alone, then, with ``context``, the search with what stands around them; a label for which that finds
    nothing keeps its base pattern.
    """
    plain = proposals(annotations, label)
    best = best_patterns(evaluate(texts, annotations, plain, key, label), texts, annotations, key, label)
    if not context:
        return best
    base = base_patterns(best, label)
    made = with_context(texts, annotations, base, key, label)
    chosen = best_patterns(evaluate(texts, annotations, made, key, label), texts, annotations, key, label)
    rest = texts.sparkSession.createDataFrame([(name, p, 1, 0) for name, p in base.items()], chosen.schema) if base else chosen.limit(0)
    return chosen.unionByName(rest.join(chosen.select(label).distinct(), on=label, how="left_anti"))


def save_patterns(best: DataFrame, path: str, category: str | None = None, label: str = "label") -> None:
    """The patterns as JSON, a folder per category (if ``category`` names a column) and label."""
    best.write.mode("overwrite").partitionBy(*([category] if category else []), label).json(path)


def load_patterns(spark, path: str) -> DataFrame:
    return spark.read.schema("pattern string, rank int, new long").json(path)
