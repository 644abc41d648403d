"""The feature frame of spans and the classifiers trained on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions import geometry, normalize, strings
from quire.operators import spans
from quire.session import Scratch


def text_features(col: Column, prefix: str = "", iso: Column | None = None) -> dict[str, Column]:
    """All features of a text by name: its characters, and its readings as a number and a date. ``iso``: its date, where it is known."""
    iso = normalize.to_date(col) if iso is None else iso
    year, month, day = normalize.date_parts(col, iso)
    readings = {
        "feat_date_count": normalize.days_since_2010(col, iso), "feat_num_count": F.coalesce(normalize.to_float(col), F.lit(0.0)), "feat_as_float": normalize.to_python_float(col),
        "feat_year_count": year, "feat_month_count": month, "feat_day_count": day,
    }
    return {prefix + n: c for n, c in (strings.feature_columns(col) | readings).items()}


def with_text_features(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the features of the texts in ``columns`` (column to prefix): computed once per distinct text of all of them, written, and joined back,
    as texts of spans repeat a lot and the plan of their features is large."""
    made = rows.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("_s")).filter("_s is not null").distinct()
    made = made.withColumn("_iso", normalize.to_date(F.col("_s")))
    made = Scratch(rows.sparkSession, "features").write(made.select("_s", *[c.alias(n) for n, c in text_features(F.col("_s"), iso=F.col("_iso")).items()]), "texts")
    for column, prefix in columns.items():
        side = made.select(F.col("_s").alias("_t"), *[F.col(n).alias(prefix + n) for n in made.columns if n != "_s"])
        rows = rows.join(side, rows[column] == side["_t"], "left").drop("_t")
    return rows


def position_features(width: Column, height: Column, n_pages: Column) -> dict[str, Column]:
    """Places of a box on its page and of its page in the document, absolute and relative. The row has the box and ``page_index``."""
    x0, x1, y0, y1, page = (F.col(c) for c in ("x0", "x1", "y0", "y1", "page_index"))
    ratio = F.try_divide
    return {
        "area": geometry.area(x0, x1, y0, y1), "area_quadrant_two": x0 * y0, "x0_relative": ratio(x0, width), "x1_relative": ratio(x1, width), "y0_relative": ratio(y0, height), "y1_relative": ratio(y1, height),
        "page_index_relative": ratio(page.cast("double"), n_pages), "relative_position_in_page": ratio(page.cast("double"), n_pages),
    }


def first_words(tokens: DataFrame, key: str) -> DataFrame:
    """Each document's first token: ``key``, ``first_word_string`` and, where ``tokens`` has them, ``first_word_x0`` ... ``first_word_y1``."""
    kept = [c for c in ("offset_string", "x0", "x1", "y0", "y1") if c in tokens.columns]
    first = tokens.groupBy(key).agg(F.min_by(F.struct(*kept), F.struct("start_offset", "end_offset")).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias("first_word_string" if c == "offset_string" else f"first_word_{c}") for c in kept])


def feature_frame(tokens: DataFrame, texts: DataFrame, key: str, n_neighbours: int = 1, first_word: bool = True) -> DataFrame:
    """Tokens with their line and place in the text, the features of their text, of their neighbours' and of the document's first word, and, where they have
    a box and ``page_width`` and ``page_height``, those of their place on the page."""
    lines = spans.lines(texts, key, "text")
    located = spans.locate(tokens, key, lines.select(key, "line_index", "start_offset", "end_offset"), "line_index")
    near = spans.neighbours(located, key, "line_index", n_neighbours)
    sized = texts.filter("text is not null").select(F.col(key).alias("_k"), F.length("text").alias("_n"), (F.length("text") - F.length(F.translate("text", "\f", "")) + 1).alias("_pages"))
    out = near.join(sized, near[key] == sized["_k"]).drop("_k").withColumn("relative_position", F.round(F.col("start_offset") / F.col("_n"), 6))
    if {"x0", "page_index", "page_width"} <= set(tokens.columns):
        out = out.withColumns(position_features(F.col("page_width"), F.col("page_height"), F.col("_pages")))
    out = out.drop("_n", "_pages").withColumns({"feat_num": normalize.to_float(F.col("offset_string")), "feat_date": normalize.to_date(F.col("offset_string"))})
    texts_of = {"offset_string": ""} | {f"{side}_text{i}": f"{side}{i}_" for i in range(n_neighbours) for side in ("l", "r")}
    if first_word:
        first = first_words(tokens, key).withColumnRenamed(key, "_k")
        out = out.join(first, out[key] == first["_k"], "left").drop("_k")
        texts_of["first_word_string"] = "first_word_"
    return with_text_features(out, texts_of)


def context_frame(near: DataFrame, n_neighbours: int = 1, first_word: bool = True) -> DataFrame:
    """The features of ``feature_frame`` (but for boxes) for spans that bring their context along, see ``spans.in_context``. They are written first: their features' plan is large."""
    near = Scratch(near.sparkSession, "features").write(near if first_word else near.drop("first_word_string"), "near")
    texts_of = {"offset_string": ""} | {f"{side}_text{i}": f"{side}{i}_" for i in range(n_neighbours) for side in ("l", "r")} | ({"first_word_string": "first_word_"} if first_word else {})
    out = with_text_features(near, texts_of)
    return out.select(*near.columns, F.col("feat_num_count").alias("feat_num"), *out.columns[len(near.columns) :])  # a classifier takes no number as 0


def fit_label_classifier(frame: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 20, seed: int = 420):
    """A random forest over the features, classes weighted against their frequency; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    sizes = frame.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    weighted = frame.join(F.broadcast(sizes.withColumn("_w", F.lit(float(total["t"])) / (F.col("_n") * float(total["k"]))).drop("_n")), on=label)  # one row per label
    stages = [
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip"),
        VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=min(depth, 30), seed=seed),
    ]
    return Pipeline(stages=stages).fit(weighted.fillna(0.0, subset=features))


def predict_labels(model, frame: DataFrame, features: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """``label_predicted`` and ``confidence_predicted`` for each row; the first of equally probable labels. Labels in ``without`` are not predicted, and
    keep what they take of the probability."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    scored = frame.fillna(0.0, subset=features)
    for stage in model.stages[1:]:  # the first indexes the right labels, which a frame to be predicted need not have
        scored = stage.transform(scored)
    p = vector_to_array("probability")
    kept = [k for k, name in enumerate(labels) if name not in without]
    p = F.array(*[F.get(p, F.lit(k)) for k in kept])
    best = F.array_max(p)
    names = F.array(*[F.lit(labels[k]) for k in kept])
    return scored.withColumn("confidence_predicted", best).withColumn("label_predicted", F.get(names, (F.array_position(p, best) - 1).cast("int"))).drop("_x", "_y", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Forest:
    """A fitted forest as plain arrays, for batches: of each tree the feature (-1 in a leaf), threshold and children of its nodes, and each node's share of every class."""

    labels: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def used(self) -> list[int]:
        """The features that any node asks for."""
        return sorted({int(f) for tree in self.trees for f in tree[0] if f >= 0})

    def probabilities(self, n: int, right: Callable[[int, float, np.ndarray], np.ndarray]) -> np.ndarray:
        """Each of ``n`` rows' probability of every class. ``right`` gives, for a feature, a threshold and some rows, which of them are above it.

        The rows part at each node, so a node is asked only about those that reach it. Sums are taken in the forest's own order.
        """
        votes = np.zeros((len(self.labels), n))
        for feature, threshold, left, other, share in self.trees:
            todo = [(0, np.arange(n))]
            while todo:
                node, rows = todo.pop()
                if feature[node] < 0:
                    votes[:, rows] += share[node][:, None]
                elif len(rows):
                    above = right(int(feature[node]), float(threshold[node]), rows)
                    todo += [(int(left[node]), rows[~above]), (int(other[node]), rows[above])]
        total = votes[0].copy()
        for k in range(1, len(votes)):
            total += votes[k]
        return votes / np.where(total == 0, 1.0, total)


def forest_of(model, spark: SparkSession) -> Forest:
    """The forest of a fitted pipeline (see ``fit_label_classifier``): at most 2 ** (depth + 1) nodes a tree, read from its written form."""
    path = f"{Scratch(spark, 'forest').base}/model"
    model.stages[-1].write().save(path)
    nodes: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():
        nodes.setdefault(r["treeID"], []).append(r["nodeData"])
    trees = []
    for t in sorted(nodes):
        rows = sorted(nodes[t], key=lambda r: r["id"])
        leaf = [r["leftChild"] < 0 for r in rows]
        if any(not end and r["split"]["numCategories"] != -1 for r, end in zip(rows, leaf)):
            raise ValueError("a split by categories: the features are numbers")
        stats = np.array([r["impurityStats"] for r in rows], np.float64)
        total = stats[:, 0].copy()
        for k in range(1, stats.shape[1]):
            total += stats[:, k]
        share = np.where(total[:, None] == 0, 0.0, stats / np.where(total == 0, 1.0, total)[:, None])
        trees.append((
            np.array([-1 if end else r["split"]["featureIndex"] for r, end in zip(rows, leaf)]), np.array([0.0 if end else r["split"]["leftCategoriesOrThreshold"][0] for r, end in zip(rows, leaf)]),
            np.array([r["leftChild"] for r in rows]), np.array([r["rightChild"] for r in rows]), share,
        ))
    return Forest(list(model.stages[0].labels), trees)


def save_model(model, path: str) -> None:
    """A fitted pipeline written to ``path``, over what is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def relative_lines(lines: DataFrame, key: str, features: list[str], n: int = 5, order: str = "line_index") -> DataFrame:
    """``lines`` with the features of the ``n`` lines before and after (``prev_line_1_...``, ``next_line_1_...``), 0 beyond the ends."""
    w = Window.partitionBy(key).orderBy(order)
    return lines.withColumns({f"{side}_line_{i}_{f}": F.coalesce(step(f, i).over(w), F.lit(0)) for side, step in (("prev", F.lag), ("next", F.lead)) for i in range(1, n + 1) for f in features})


def line_features(rows: DataFrame, lines: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Every line with how many spans of each label begin on it (a column per label, 0 for none). ``rows`` has ``key``, ``label`` and ``line_index``."""
    counted = rows.groupBy(F.col(key).alias("_k"), F.col("line_index").alias("_l")).pivot("label", labels).agg(F.count(F.lit(1)))
    return lines.select(key, "line_index").join(counted, (lines[key] == counted["_k"]) & (lines["line_index"] == counted["_l"]), "left").drop("_k", "_l").fillna(0, subset=labels)


def separate_labels(rows: DataFrame, column: str = "label", mark: str = "__") -> DataFrame:
    """``label_set`` and ``label`` from names of the form set__label; names without the mark have no set."""
    parts = F.split(F.col(column), mark, 2)
    return rows.withColumn("label_set", F.when(F.size(parts) == 2, parts[0])).withColumn(column, F.coalesce(F.get(parts, F.lit(1)), parts[0]))


def assign_sections(rows: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Rows with the ``section`` of the last section start at or above their line: an as-of join as one sorted union."""
    from pyspark.sql import Window

    marks = sections.select(key, F.col("line_index"), F.lit(0).alias("_o"), F.col("section"), F.lit(None).cast("long").alias("start_offset"))
    own = rows.select(key, "line_index", F.lit(1).alias("_o"), F.lit(None).cast(sections.schema["section"].dataType).alias("section"), F.col("start_offset").cast("long"))
    w = Window.partitionBy(key).orderBy("line_index", "_o", "start_offset").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(own).withColumn("section", F.last("section", ignorenulls=True).over(w)).filter("_o = 1").drop("_o")
