"""Order-dependent merging and selection of predicted spans, one document (or document and label) at a time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F, types as T

from quire.operators.spans import BLOCK, in_blocks


def merge_while(spans: DataFrame, text: DataFrame, key: str, accepts: Callable[[str], bool], max_gap: int = 5) -> DataFrame:
    """Neighbouring spans of one document and label joined as long as only blanks lie between and ``accepts`` the text joined so far.

    For labels whose value must stay readable (numbers, dates), where islands alone do not decide. ``spans`` has ``key``, ``label``,
    offsets and ``confidence``; ``text`` has ``key`` and ``text``. Result: ``key``, ``label``, offsets, ``parts``, mean ``confidence``. A document's
    spans meet its text once, as one list.
    """
    kind = spans.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("label", spans.schema["label"].dataType), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("confidence", T.DoubleType())])
    one = F.struct("label", F.col("start_offset").cast("long").alias("a"), F.col("end_offset").cast("long").alias("b"), F.col("confidence").cast("double").alias("c"))
    listed = spans.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(one)).alias("spans"))  # the spans of one document
    joined = text.select(key, "text").join(listed, F.col(key) == F.col("_k")).drop("_k")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (t, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                first = len(out)
                for r in found if t is not None else ():
                    a, b = r["a"], r["b"]
                    last = out[-1] if len(out) > first else None
                    if last and last[0] == r["label"] and a >= last[2] and a - last[2] <= max_gap and not t[last[2] : a].strip(" ") and accepts(t[last[1] : b]):
                        last[2] = b
                        last[3].append(r["c"])
                    else:
                        at.append(i), out.append([r["label"], a, b, [r["c"]]])
            made = [pa.array([o[0] for o in out], batch.column("spans").type.value_type.field("label").type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([len(o[3]) for o in out], pa.int64()), pa.array([None if None in o[3] else sum(o[3]) / len(o[3]) for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *made], names=schema.names)

    return joined.mapInArrow(fold, schema)


def merge_vertical(spans: DataFrame, key: str, multiline: DataFrame | None = None) -> DataFrame:
    """Spans of one document and label that lie directly below each other made one annotation: ``annotation_id`` is the first span's start.

    ``spans`` has ``key``, ``label``, ``line_index``, offsets, ``x0``, ``x1`` and maybe ``set_id``. A span joins the annotation above if it is on the
    next line and overlaps it in x, and is of the same set, or of a set of which it is the only span; the nearest one above counts. With ``multiline``
    (a table of ``label``) only spans of these labels are merged, those that have annotations of several lines.
    """
    schema = T.StructType([*spans.schema.fields, T.StructField("annotation_id", T.LongType())])
    sets = "set_id" in spans.columns

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_index", "start_offset"], ignore_index=True)
        alone = ~pdf["set_id"].duplicated(keep=False) if sets else None
        line, above, current = None, [], []
        ids = []
        for k, r in enumerate(pdf.itertuples(index=False)):
            if r.line_index != line:
                above, current, line = current if line is not None and r.line_index == line + 1 else [], [], r.line_index
            fit = [o for o in above if o[0] <= r.x1 and r.x0 <= o[1] and (not sets or o[3] == r.set_id or alone[k])]
            best = min(fit, key=lambda o: abs(o[0] - r.x0), default=None)
            ids.append(best[2] if best else int(r.start_offset))
            current.append((r.x0, r.x1, ids[-1], r.set_id if sets else None))
        return pdf.assign(annotation_id=ids)

    if multiline is None:
        return spans.groupBy(key, "label").applyInPandas(stack, schema)
    chosen = multiline.select(F.col("label").alias("_m")).distinct()
    merged = spans.join(chosen, spans["label"] == chosen["_m"], "left_semi").groupBy(key, "label").applyInPandas(stack, schema)
    rest = spans.join(chosen, spans["label"] == chosen["_m"], "left_anti").withColumn("annotation_id", F.col("start_offset").cast("long"))
    return merged.unionByName(rest)


def merge_like(annotations: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """Annotations of one span each put together as a copy of their document has them.

    ``annotations`` has ``key``, offsets and ``label``; ``template`` has ``key``, offsets and ``annotation_id`` of the copy's spans. Result: the
    annotations with ``annotation_id``, that of the template's annotation of the same offsets, and the most frequent label of what is put together (the first of
    equals, by offsets); others keep their label and a null id. Repeated spans of the template count once, for the least id.
    """
    t = template.groupBy(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b")).agg(F.min("annotation_id").alias("annotation_id"))
    own = annotations.join(t, (annotations[key] == t["_k"]) & (annotations["start_offset"] == t["_a"]) & (annotations["end_offset"] == t["_b"]), "left").drop("_k", "_a", "_b")
    votes = own.filter("annotation_id is not null").groupBy(key, "annotation_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_offset", "end_offset")).alias("p"))
    best = votes.groupBy(F.col(key).alias("_k"), F.col("annotation_id").alias("_i")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("p"))).alias("_label"))
    out = own.join(best, (own[key] == best["_k"]) & (own["annotation_id"] == best["_i"]), "left").drop("_k", "_i")
    return out.withColumn("label", F.coalesce("_label", "label")).drop("_label")


def multiline_labels(annotations: DataFrame, key: str) -> DataFrame:
    """``label`` and ``multiline``: whether any annotation of the label has more than one span. ``annotations`` has ``key``, ``annotation_id`` and ``label``, a row per span."""
    sizes = annotations.groupBy(key, "annotation_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("label").agg((F.max("n") > 1).alias("multiline"))


def view_annotations(annotations: DataFrame, key: str, multiple: str = "multiple") -> DataFrame:
    """The annotations shown to a reader: greedily without overlap, by (right first, confidence falling, start); below their label's
    ``threshold``, rejected (``revised`` and not ``is_correct``) or unlabelled ones are left out; one per label and set unless ``multiple``.

    ``annotations`` has ``key``, ``label``, ``set_id``, offsets, ``confidence``, ``threshold``, ``is_correct``, ``revised``, ``multiple``.
    """
    usable = annotations.filter(F.col("label").isNotNull() & (F.col("is_correct") | ((F.col("confidence") >= F.col("threshold")) & ~F.col("revised"))))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_correct", "confidence", "start_offset", "end_offset"], ascending=[False, False, True, True], kind="stable")
        starts: list[int] = []  # of what is shown, which does not overlap, with the ends beside
        ends: list[int] = []
        seen: set[tuple] = set()
        keep = []
        for r in pdf.itertuples(index=False):
            name = (r.label, r.set_id)
            k = bisect_left(starts, r.end_offset)
            free = (k == 0 or ends[k - 1] <= r.start_offset) and (r.multiple or name not in seen)
            keep.append(free)
            if free:
                k = bisect_left(starts, r.start_offset)
                starts.insert(k, r.start_offset), ends.insert(k, r.end_offset)
                seen.add(name)
        return pdf[keep]

    return usable.groupBy(key).applyInPandas(choose, usable.schema)


def tag_bio(tokens: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Each token with its tag: ``B-label`` for the first token in an annotation, ``I-label`` for the rest, ``O`` outside."""
    a = in_blocks(annotations.select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"), F.col("label").alias("_l")), "_a", "_b", "_ab")
    own = tokens.withColumn("_tb", F.floor(F.col("start_offset") / BLOCK))
    hit = own.join(a, (own[key] == a["_k"]) & (own["_tb"] == a["_ab"]) & (own["start_offset"] >= a["_a"]) & (own["end_offset"] <= a["_b"]), "left")
    one = hit.groupBy(key, "start_offset", "end_offset").agg(F.min(F.struct("_a", "_b", "_l")).alias("m"))
    firsts = one.filter("m._a is not null").groupBy(key, F.col("m._a").alias("_a"), F.col("m._l").alias("_l")).agg(F.min("start_offset").alias("_first"))
    out = one.select(key, "start_offset", "end_offset", F.col("m._a").alias("_a"), F.col("m._l").alias("_l")).join(firsts, on=[key, "_a", "_l"], how="left")
    tag = F.when(F.col("_l").isNull(), "O").when(F.col("start_offset") == F.col("_first"), F.concat(F.lit("B-"), F.col("_l"))).otherwise(F.concat(F.lit("I-"), F.col("_l")))
    return out.select(key, "start_offset", "end_offset", tag.alias("tag"))
