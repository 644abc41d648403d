"""The extraction pipeline over a corpus: features, label classifier, thresholds, merging, sections, annotation sets, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window, functions as F, types as T

from quire.functions import normalize
from quire.operators import evaluate, features, spans
from quire.session import Scratch

#: The class of tokens that belong to no label, and of lines that begin no section.
NO_LABEL, NO_SECTION = "NO_LABEL", "No"


@dataclass(frozen=True)
class LabelSet:
    """A set of labels: the default one, one that occurs once, or one that a document may have several of."""

    name: str
    labels: tuple[str, ...]
    is_default: bool = False
    multiple: bool = False


@dataclass
class Extractor:
    """What was fitted: the label classifier with its features, and maybe the section classifier with its own."""

    labels: object
    features: list[str]
    sections: object | None = None
    section_labels: list[str] = field(default_factory=list)
    n_lines: int = 5


def training_frame(tokens: DataFrame, texts: DataFrame, gold: DataFrame, key: str = "doc_id", n_neighbours: int = 1, first_word: bool = True) -> DataFrame:
    """Tokens with their features and the ``label`` of the first right span that contains them, else ``NO_LABEL``."""
    frame = features.feature_frame(tokens, texts, key, n_neighbours, first_word)
    named = spans.contained_in(tokens.select(key, "start_offset", "end_offset"), gold, key, "label").withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit(NO_LABEL)))
    return frame.join(named, on=[key, "start_offset", "end_offset"])


def numeric_features(frame: DataFrame) -> list[str]:
    """The columns of a frame that a classifier takes: all numbers but keys and offsets."""
    kinds = ("int", "bigint", "double", "float")
    return [n for n, t in frame.dtypes if t in kinds and ("feat_" in n or "accented_char_count" in n or "_dist" in n or "relative" in n or n in ("x0", "x1", "y0", "y1", "area", "area_quadrant_two", "page_index"))]


def section_starts(sets: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``line_index``, ``section``: the label set's name on the line where a set begins, the first by offsets where several do. ``sets`` has ``key``, ``label_set`` and ``start_offset``."""
    at = spans.locate(sets.select(key, "label_set", "start_offset"), key, lines, "line_index")
    return at.groupBy(key, "line_index").agg(F.min_by("label_set", F.struct("start_offset", "label_set")).alias("section"))


def fit(frame: DataFrame, lines: DataFrame | None = None, sections: DataFrame | None = None, key: str = "doc_id", trees: int = 100, depth: int = 20, n_lines: int = 5) -> Extractor:
    """The label classifier fitted to ``frame`` (see ``training_frame``), and with ``lines`` and ``sections`` (see ``section_starts``) the
    section classifier, which takes what the label classifier says of the lines around."""
    names = numeric_features(frame)
    labels = features.fit_label_classifier(frame.select("label", *[F.col(n).cast("double").alias(n) for n in names]), names, "label", trees, depth)
    out = Extractor(labels, names, n_lines=n_lines)
    if sections is not None and lines is not None:
        out.section_labels = [x for x in labels.stages[0].labels if x != NO_LABEL]
        said = predict(out, frame).filter("above").select(key, "line_index", F.col("label").alias("label_predicted"))  # as in extracting
        wide = _section_frame(out, said, lines, key)
        s = sections.select(F.col(key).alias("_k"), F.col("line_index").alias("_l"), "section")
        y = wide.join(s, (wide[key] == s["_k"]) & (wide["line_index"] == s["_l"]), "left").withColumn("section", F.coalesce("section", F.lit(NO_SECTION))).drop("_k", "_l")
        out.sections = features.fit_label_classifier(y, _section_features(out), "section", trees, depth)
    return out


def _section_features(x: Extractor) -> list[str]:
    own = [f"label_{k}" for k in range(len(x.section_labels))]
    return own + [f"{side}_line_{i}_{f}" for side in ("prev", "next") for i in range(1, x.n_lines + 1) for f in own]


def _section_frame(x: Extractor, said: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    number = F.create_map(*[F.lit(v) for k, name in enumerate(x.section_labels) for v in (name, f"label_{k}")])
    own = [f"label_{k}" for k in range(len(x.section_labels))]
    counted = features.line_features(said.select(key, "line_index", number[F.col("label_predicted")].alias("label")), lines, key, own)
    counted = counted.withColumns({f: (F.col(f) > 0).cast("double") for f in own})
    return features.relative_lines(counted, key, own, x.n_lines)


def predict(x: Extractor, frame: DataFrame, thresholds: DataFrame | None = None, default: float = 0.1) -> DataFrame:
    """The most likely label of each token but ``NO_LABEL``: ``label``, ``confidence`` and ``above``, whether it reaches its label's threshold. ``thresholds`` has ``label`` and ``threshold``."""
    said = features.predict_labels(x.labels, frame.drop("label").withColumns({n: F.col(n).cast("double") for n in x.features}), x.features, (NO_LABEL,))
    said = said.withColumnsRenamed({"label_predicted": "label", "confidence_predicted": "confidence"}).filter("label is not null")
    if thresholds is None:
        return said.withColumn("above", F.col("confidence") >= default)
    t = F.broadcast(thresholds.select(F.col("label").alias("_t"), "threshold"))  # one row per label
    return said.join(t, said["label"] == t["_t"], "left").withColumn("above", F.col("confidence") >= F.coalesce("threshold", F.lit(default))).drop("_t", "threshold")


def predict_sections(x: Extractor, said: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``line_index``, ``section`` of the lines on which a section begins."""
    wide = _section_frame(x, said.select(key, "line_index", F.col("label").alias("label_predicted")), lines, key)
    named = features.predict_labels(x.sections, wide, _section_features(x))
    return named.filter(F.col("label_predicted") != NO_SECTION).select(key, "line_index", F.col("label_predicted").alias("section"))


def annotation_sets(rows: DataFrame, sections: DataFrame, label_sets: Sequence[LabelSet], key: str = "doc_id") -> DataFrame:
    """Extractions with ``label_set`` and ``set_id``, numbered from 1 (the default set's) in each document.

    A set that may occur several times takes, for each of its sections, the rows of its labels from the section's first line up to the next one's; one that
    occurs once takes all rows of its labels; what is left goes to the default set, if its label may stand there, and else is no extraction. Sets that come first in
    ``label_sets`` take first. ``rows`` has ``key``, ``label``, ``line_index``, offsets.
    """
    out, rest = None, rows
    for order, s in enumerate(x for x in label_sets if not x.is_default):
        mine = F.col("label").isin(list(s.labels))
        if s.multiple:
            starts = sections.filter(F.col("section") == s.name).select(key, "line_index").withColumn("section", F.row_number().over(Window.partitionBy(key).orderBy("line_index")))
            columns = [c for c in rest.columns]
            marks = starts.select(*[(F.col(c) if c in (key, "line_index") else F.lit(None).cast(rest.schema[c].dataType)).alias(c) for c in columns], F.lit(0).alias("_o"), F.col("section").alias("_section"))
            own = rest.select(*columns, F.lit(1).alias("_o"), F.lit(None).cast("int").alias("_section"))
            w = Window.partitionBy(key).orderBy("line_index", "_o", "start_offset").rowsBetween(Window.unboundedPreceding, 0)
            at = marks.unionByName(own).withColumn("_n", F.last("_section", ignorenulls=True).over(w)).filter("_o = 1").drop("_o", "_section")
            taken, rest = at.filter(mine & F.col("_n").isNotNull()), at.filter(~mine | F.col("_n").isNull()).drop("_n")
        else:
            taken, rest = rest.filter(mine).withColumn("_n", F.lit(1)), rest.filter(~mine)
        taken = taken.withColumn("label_set", F.lit(s.name)).withColumn("_order", F.lit(order + 1))
        out = taken if out is None else out.unionByName(taken)
    for s in (x for x in label_sets if x.is_default):
        taken = rest.filter(F.col("label").isin(list(s.labels))).withColumn("_n", F.lit(0)).withColumn("label_set", F.lit(s.name)).withColumn("_order", F.lit(0))
        out = taken if out is None else out.unionByName(taken)
    numbers = out.select(key, "_order", "_n").distinct()
    numbers = numbers.withColumn("set_id", F.when(F.col("_order") == 0, 1).otherwise(1 + F.sum((F.col("_order") > 0).cast("int")).over(Window.partitionBy(key).orderBy("_order", "_n"))))  # the sets of one document
    return out.join(numbers, on=[key, "_order", "_n"]).drop("_order", "_n")


def without_duplicates(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each document, set, label and offsets: that of the highest confidence."""
    group = [key, *([] if "set_id" not in rows.columns else ["set_id"]), "label", "start_offset", "end_offset"]
    others = [c for c in rows.columns if c not in group]
    best = F.max_by(F.struct(*others), F.struct(F.coalesce("confidence", F.lit(-1.0)), *[F.col(c) for c in others if c == "label_set"])).alias("r")
    return rows.groupBy(*group).agg(best).select(*group, "r.*")


def extract(x: Extractor, tokens: DataFrame, texts: DataFrame, label_sets: Sequence[LabelSet] = (), thresholds: DataFrame | None = None, key: str = "doc_id", n_neighbours: int = 1, first_word: bool = True) -> DataFrame:
    """Annotations of the documents: tokens labelled, those above their threshold joined where only blanks lie between, given their sets, without duplicates."""
    frame = features.feature_frame(tokens, texts, key, n_neighbours, first_word)
    said = predict(x, frame, thresholds).select(key, "line_index", "start_offset", "end_offset", "label", "confidence", "above")
    said = Scratch(tokens.sparkSession, "extract").write(said, "said")
    good = said.filter("above").select(key, "label", "start_offset", "end_offset", "confidence")
    joined = spans.merge_horizontal(good, texts.select(key, "text"), key, [key, "label"])
    lines = spans.lines(texts, key, "text").select(key, "line_index", "start_offset", "end_offset")
    placed = spans.locate(joined, key, lines, "line_index")
    if label_sets and x.sections is not None:
        placed = annotation_sets(placed, predict_sections(x, said.filter("above"), lines, key), label_sets, key)
    return without_duplicates(placed, key)


def sample_tokens(texts: DataFrame, n: int, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``start_offset`` of ``n`` tokens of the texts, those whose hash is smallest: the same ones whenever they are drawn."""
    drawn = spans.starts(texts.filter(F.col(key).isNotNull()), key, "text", tokenizer).orderBy(F.xxhash64(key, "start_offset")).limit(n)
    return Scratch(texts.sparkSession, "sample").write(drawn, "tokens")


def sampled_frame(picked: DataFrame, texts: DataFrame, gold: Callable[[DataFrame], DataFrame], tokenizer: str, key: str = "doc_id", n_neighbours: int = 1, first_word: bool = True) -> DataFrame:
    """``training_frame`` of the ``picked`` tokens alone (see ``sample_tokens``; they are sent to all tasks), in the order of their hash. ``gold`` gives the right spans of texts; it is
    asked about those that have a picked token. The frame is written, as a fit reads it many times."""
    chosen = texts.join(F.broadcast(picked.groupBy(key).agg(F.collect_list("start_offset").alias("_only"))), on=key)
    frame = features.context_frame(spans.in_context(chosen, key, "text", tokenizer, "_only", n_neighbours), n_neighbours, first_word)
    right = gold(texts.join(F.broadcast(picked.select(key).distinct()), on=key, how="left_semi"))
    named = spans.contained_in(frame.select(key, "start_offset", "end_offset"), right, key, "label").withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit(NO_LABEL)))
    named = frame.join(named, on=[key, "start_offset", "end_offset"])
    return Scratch(texts.sparkSession, "sample").write(named.repartition(1).sortWithinPartitions(F.xxhash64(key, "start_offset")), "frame")  # as many rows as were picked


#: Characters of texts whose tokens are looked at together: features are computed once per distinct token of so many. A longer text stands alone.
TOGETHER = 8_000_000


def extract_texts(x: Extractor, texts: DataFrame, tokenizer: str, default: float = 0.1, key: str = "doc_id", n_neighbours: int = 1, first_word: bool = True) -> DataFrame:
    """What ``extract`` gives for the tokens of a stock tokenizer without boxes, label sets and thresholds of labels, with no token leaving the batch of its text.

    Three steps of one stage: texts become distinct tokens and, after them, what stands where; the features of the distinct tokens are the expressions of
    ``text_features``; the forest is asked with tokens as numbers, and neighbours of one label are joined where only blanks lie between (as in
    ``spans.merge_horizontal``; tokens begin and end in other characters). Only annotations leave it.
    """
    forest = features.forest_of(x.labels, texts.sparkSession)
    prefixes = [""] + [f"{side}{i}_" for i in range(n_neighbours) for side in ("l", "r")] + (["first_word_"] if first_word else [])
    exprs = features.text_features(F.col("_s"), iso=F.col("_iso"))
    asked = {}  # feature of the forest to (which token, its feature) or (None, a feature of the place)
    for f in forest.used():
        name = "feat_num_count" if x.features[f] == "feat_num" else x.features[f]  # no number is 0 to a classifier
        own = [(k, name[len(p) :]) for k, p in enumerate(prefixes) if name.startswith(p) and name[len(p) :] in exprs]
        asked[f] = own[-1] if own else (None, name)
        if not own and name != "relative_position" and name not in (f"{side}_dist{i}" for i in range(n_neighbours) for side in ("l", "r")):
            raise ValueError(f"the forest asks for {name}, which texts alone do not have")
    columns = sorted({name for which, name in asked.values() if which is not None})
    kept = [k for k, name in enumerate(forest.labels) if name != NO_LABEL]
    kind = texts.schema[key].dataType
    src = texts.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("_k"), F.col("text").alias("_t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_texts = batch.column("_k"), batch.column("_t")
            sizes, begin = pc.utf8_length(all_texts).to_pylist(), 0
            while begin < len(sizes):
                end, total = begin + 1, sizes[begin]
                while end < len(sizes) and total + sizes[end] <= TOGETHER:
                    total += sizes[end]
                    end += 1
                numbers, places, at = {"": 0}, [], []
                for k, t in enumerate(all_texts.slice(begin, end - begin).to_pylist()):
                    a, b = spans.ordered_spans(tokenizer, t)
                    if not len(a):
                        continue
                    codes = np.fromiter((numbers.setdefault(t[i:j], len(numbers)) for i, j in zip(a.tolist(), b.tolist())), np.int32, len(a))
                    places.append(np.stack([codes, a, b, spans.line_of(t, a), spans.blanks_before(t, a, b), np.full(len(a), len(t))]).astype(np.int32).tobytes())
                    at.append(begin + k)
                if at:
                    none = pa.nulls(len(numbers), ids.type)
                    yield pa.RecordBatch.from_arrays([none, pa.array(list(numbers)), pa.nulls(len(numbers), pa.binary())], names=["_k", "_s", "_places"])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.nulls(len(at), pa.string()), pa.array(places, pa.binary())], names=["_k", "_s", "_places"])
                begin = end

    def judge(ids: pa.Array, places: list[bytes], made: np.ndarray) -> pa.RecordBatch:
        parts = [np.frombuffer(p, np.int32).reshape(6, -1) for p in places]
        code, a, b, line, touches, length = np.concatenate(parts, axis=1).astype(np.int64)
        text = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        first = np.searchsorted(text, np.arange(len(parts)))
        codes, place = [code], {"relative_position": spans.relative(a, length)}
        for i in range(n_neighbours):
            for side, at in zip(("l", "r"), spans.beside(line, text, i + 1)):
                codes.append(np.where(at < 0, 0, code[at]))
                place[f"{side}_dist{i}"] = spans.distance(at, side == "l", a, b).astype(np.float64)
        codes.append(code[first][text])

        def right(feature: int, threshold: float, rows: np.ndarray) -> np.ndarray:
            which, name = asked[feature]
            return place[name][rows] > threshold if which is None else (made[columns.index(name)] > threshold)[codes[which][rows]]

        p = forest.probabilities(len(code), right)[kept]
        best, label = p.max(axis=0), p.argmax(axis=0)
        good = best >= default
        rows = np.flatnonzero(good)
        # An annotation runs on where the token just before has the same label and only blanks lie between.
        runs_on = (touches[rows] == 1) & good[rows - 1] & (label[rows - 1] == label[rows]) & (text[rows - 1] == text[rows])
        heads = np.flatnonzero(~runs_on)
        tails = np.append(heads[1:], len(rows)) - 1 if len(heads) else heads
        n = tails - heads + 1
        confidence = np.add.reduceat(best[rows], heads) / n if len(heads) else np.zeros(0)
        h = rows[heads]
        named = pa.array([forest.labels[k] for k in kept], pa.string()).take(pa.array(label[h]))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(text[h])), named, pa.array(a[h]), pa.array(b[rows[tails]]), pa.array(n.astype(np.int64)), pa.array(confidence), pa.array(line[h].astype(np.int32))], names=[key, "label", "start_offset", "end_offset", "parts", "confidence", "line_index"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, places = [], [], []  # of the texts at hand: their tokens' features come before them

        def judged() -> pa.RecordBatch:
            return judge(pa.concat_arrays(ids), list(chain.from_iterable(places)), np.concatenate(made, axis=1))

        for batch in batches:
            is_text = np.asarray(pc.is_valid(batch.column("_places")))
            cuts = [0, *(np.flatnonzero(is_text[1:] != is_text[:-1]) + 1).tolist(), len(is_text)] if len(is_text) else [0]
            for begin, end in zip(cuts, cuts[1:]):
                part = batch.slice(begin, end - begin)
                if is_text[begin]:
                    ids.append(part.column("_k"))
                    places.append(part.column("_places").to_pylist())
                    continue
                if ids:  # the tokens of the next texts begin
                    yield judged()
                    made, ids, places = [], [], []
                values = [np.nan_to_num(part.column(c).fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf) for c in columns]
                made.append(np.stack(values) if values else np.zeros((0, end - begin)))
        if ids:
            yield judged()

    pieces = src.mapInArrow(split, T.StructType([T.StructField("_k", kind), T.StructField("_s", T.StringType()), T.StructField("_places", T.BinaryType())]))
    readings = pieces.withColumn("_iso", normalize.to_date(F.col("_s")))
    readings = readings.select("_k", "_places", *[exprs[c].cast("double").alias(c) for c in columns])
    fields = [T.StructField(key, kind), T.StructField("label", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start_offset", "end_offset", "parts")], T.StructField("confidence", T.DoubleType()), T.StructField("line_index", T.IntegerType())]
    return without_duplicates(readings.mapInArrow(ask, T.StructType(fields)), key)


def evaluate_full(gold: DataFrame, extracted: DataFrame, by: str | None = "label", threshold: float = 0.0, key: str = "doc_id") -> DataFrame:
    """Counts and measures of the whole pipeline, per label (or other column of both sides), or of all if ``by`` is None."""
    joined = evaluate.compare_strict(gold.select(key, "start_offset", "end_offset", F.col("label").cast("string").alias("label")), extracted.select(key, "start_offset", "end_offset", "label", "confidence"), [key, "start_offset", "end_offset"])
    flagged = evaluate.with_flags(joined, threshold)
    return evaluate.per_slice(flagged, by) if by else evaluate.measures(flagged.agg(*evaluate.counts()))


def evaluate_tokenizer(tokens: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many right spans the tokenizer makes: counts and measures."""
    offsets = [key, "start_offset", "end_offset"]
    joined = gold.select(*offsets).distinct().withColumn("_g", F.lit(1)).join(tokens.select(*offsets).distinct().withColumn("_t", F.lit(1)), on=offsets, how="full_outer")
    both = F.col("_g").isNotNull() & F.col("_t").isNotNull()
    return evaluate.measures(joined.agg(F.sum(both.cast("long")).alias("tp"), F.sum((F.col("_g").isNull()).cast("long")).alias("fp"), F.sum((F.col("_t").isNull()).cast("long")).alias("fn")))


def evaluate_classifier(x: Extractor, frame: DataFrame) -> DataFrame:
    """The label classifier alone, on tokens that have a label: each class against the rest."""
    said = features.predict_labels(x.labels, frame.filter(F.col("label") != NO_LABEL).withColumns({n: F.col(n).cast("double") for n in x.features}), x.features, (NO_LABEL,))
    return evaluate.per_class(said.select(F.col("label").alias("actual"), F.col("label_predicted").alias("predicted")))


def evaluate_sections(x: Extractor, said: DataFrame, lines: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The section classifier alone, on all lines: each class against the rest."""
    named = predict_sections(x, said, lines, key).withColumnRenamed("section", "predicted")
    right = sections.select(key, "line_index", F.col("section").alias("actual"))
    every = lines.select(key, "line_index").join(right, on=[key, "line_index"], how="left").join(named, on=[key, "line_index"], how="left").fillna(NO_SECTION, subset=["actual", "predicted"])
    return evaluate.per_class(every.select("actual", "predicted"))
