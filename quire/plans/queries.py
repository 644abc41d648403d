"""Queries of the core operators over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import geometry, normalize, strings
from quire.operators import categorize, evaluate, extraction, features, label_patterns, layout, merge, nested, patterns, spans, split, views
from quire.sources import payloads, project as sources


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _long(*names: str):
    return F.coalesce(*[F.expr(f"try_cast({n} AS BIGINT)") for n in names])


def project_levels(spark: SparkSession, folder: str) -> nested.Level:
    """Projects' categories, label sets and labels as related tables. Deliveries of the same content count once."""
    records = _read(spark, folder, "project_metadata").select("record_id", "payload").distinct()
    lists = {"categories": ("categories",), "label_sets": ("label_sets", "schema", "schema_"), "labels": ("labels",)}
    return nested.flatten_records(records, ["record_id"], "payload", root="categories", lists=lists)


def split_levels(spark: SparkSession, folder: str) -> nested.Level:
    """Split requests' pages and page categories as related tables."""
    records = _read(spark, folder, "split_requests").select("request_id", "pages").distinct()
    return nested.flatten_records(records, ["request_id"], "pages", root="pages", lists={"categories": ("categories",)})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    def ids(level: nested.Level, id_name: str, key: str) -> DataFrame:
        t = level.table
        own = [n for n in ("id", "item_key", "bare_value") if n in t.columns]
        return t.select(key, F.col("node_id").alias(f"{id_name}_node"), F.col("parent_id").alias(f"{id_name}_parent"), _long(*own).alias(id_name))

    def below(parents: DataFrame, parent: str, children: DataFrame, child: str, key: str) -> DataFrame:
        kids = children.withColumnRenamed(key, "_key")
        return parents.join(kids, on=[parents[key] == kids["_key"], parents[f"{parent}_node"] == kids[f"{child}_parent"]], how="left").drop("_key")

    cat = project_levels(spark, folder).children["categories"]
    sets = cat.children["label_sets"]
    joined = below(ids(cat, "c", "record_id"), "c", ids(sets, "s", "record_id"), "s", "record_id")
    joined = below(joined, "s", ids(sets.children["labels"], "l", "record_id"), "l", "record_id")
    project = joined.select(F.lit("project").alias("record_kind"), "record_id", F.col("c").alias("parent_id"), F.coalesce("s", F.lit(-1)).cast("long").alias("child_id"), F.coalesce("l", F.lit(-1)).cast("long").alias("leaf_id"))
    pages = split_levels(spark, folder).children["pages"]
    page = below(ids(pages, "p", "request_id"), "p", ids(pages.children["categories"], "c", "request_id"), "c", "request_id")
    split = page.select(F.lit("split").alias("record_kind"), F.col("request_id").alias("record_id"), F.col("p").alias("parent_id"), F.coalesce("c", F.lit(-1)).cast("long").alias("child_id"), F.lit(-1).cast("long").alias("leaf_id"))
    return project.unionByName(split).distinct()


# ---------------------------------------------------------------- documents, spans, lines, pages


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", "text", "lang", "category_id", "updated_at")


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Whitespace tokens as right annotations; the label is a fixed function of the span."""
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace")
    return t.select("doc_id", "start_offset", "end_offset", (F.length("offset_string") % 5).cast("long").alias("label"))


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens without punctuation as predictions, with a confidence that is a fixed function of the span."""
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace_no_punctuation")
    size = F.length("offset_string")
    return t.select("doc_id", "start_offset", "end_offset", F.when(size % 7 == 0, 0).otherwise(size % 5).cast("long").alias("label"), (((F.col("start_offset") * 37) % 100) / 100).alias("confidence"))


def tokenizer_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two tokenizers compared span by span: counts and measures per language."""
    docs = _documents(spark, folder).select(F.coalesce("lang", F.lit("?")).alias("lang"), "text")
    counted = spans.compare_tokenizers(docs, ["lang"], "text", "whitespace", "whitespace_no_punctuation")
    by_lang = counted.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return evaluate.measures(by_lang)


def _span_sums(tokenizer: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = spans.tokenize(_documents(spark, folder), "doc_id", "text", tokenizer)
        return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"))

    query.__doc__ = f"Spans of the {tokenizer} tokenizer: number and sums of offsets per document."
    return query


def list_tokenizer_spans(spark: SparkSession, folder: str) -> DataFrame:
    t = spans.list_tokenizer(_documents(spark, folder), "doc_id", "text", ["whitespace_no_punctuation", "whitespace"])
    return t.groupBy("tokenizer").agg(F.count(F.lit(1)).alias("spans"))


def page_table(spark: SparkSession, folder: str) -> DataFrame:
    p = spans.pages(_documents(spark, folder), "doc_id", "text")
    return p.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "start_offset", "end_offset", F.length("page_text").cast("long").alias("chars"))


def line_table(spark: SparkSession, folder: str) -> DataFrame:
    p = spans.lines(_documents(spark, folder), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"))


def span_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per line: the line index of each span by an interval join."""
    docs = _documents(spark, folder)
    t = spans.tokenize(docs, "doc_id", "text", "whitespace")
    at = spans.locate(t, "doc_id", spans.lines(docs, "doc_id", "text").select("doc_id", "line_index", "start_offset", "end_offset"), "line_index")
    return at.groupBy("doc_id", F.col("line_index").cast("long").alias("line_index")).agg(F.count(F.lit(1)).alias("tokens"))


def horizontal_merge(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    merged = spans.merge_horizontal(_gold(spark, folder), docs.select("doc_id", "text"), "doc_id", ["doc_id", "label"])
    return merged.select("doc_id", "label", "start_offset", "end_offset", "parts")


def uncovered_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).filter("text is not null")
    return spans.missing_offsets(_predicted(spark, folder), docs.select("doc_id", F.length("text").alias("length")), "doc_id")


def token_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    t = spans.tokenize(docs, "doc_id", "text", "whitespace")
    at = spans.locate(t, "doc_id", spans.lines(docs, "doc_id", "text").select("doc_id", "line_index", "start_offset", "end_offset"), "line_index")
    near = spans.neighbours(at, "doc_id", "line_index")
    return near.groupBy("doc_id").agg(F.sum("l_dist0").alias("left"), F.sum("r_dist0").alias("right"), F.sum(F.length("l_text0")).alias("left_chars"))


def gold_of_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Each prediction's containing right span: how many predictions take which label."""
    hit = spans.contained_in(_predicted(spark, folder), _gold(spark, folder), "doc_id", "label")
    return hit.groupBy("label").agg(F.count(F.lit(1)).alias("tokens"), F.sum("start_offset").alias("sum_start"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").select(F.lower("offset_string").alias("token"))
    return spans.vocabulary(t, "token", min_freq=5)


def string_features(spark: SparkSession, folder: str) -> DataFrame:
    """String features of all tokens, summed per document: each computed once per distinct token."""
    names = ("feat_vowel_len", "feat_digit_len", "feat_upper_len", "feat_len", "feat_unique_char_count", "feat_starts_with_minus", "feat_ends_with_minus", "feat_substring_count_e", "feat_substring_count_sch", "feat_substring_count_period", "feat_substring_count_slash")
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").groupBy("doc_id", "offset_string").agg(F.count(F.lit(1)).alias("n"))
    feats = strings.feature_columns(F.col("_s"))
    made = t.select(F.col("offset_string").alias("_s")).distinct().select("_s", *[feats[n].alias(n) for n in names])
    return t.join(made, t["offset_string"] == made["_s"]).groupBy("doc_id").agg(*[F.sum(F.col(n) * F.col("n")).alias(n) for n in names])


def suggested_patterns(spark: SparkSession, folder: str) -> DataFrame:
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").select(strings.suggest_pattern(F.col("offset_string")).alias("pattern"))
    return t.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def normalized_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts in the documents, read as numbers and summed per document."""
    t = spans.regex_spans(_documents(spark, folder), "doc_id", "text", r"\d{1,3}(?:[.,]\d{3})*[.,]\d{2}(?!\d)")
    return t.withColumn("v", normalize.to_float(F.col("offset_string"))).groupBy("doc_id").agg(F.count("v").alias("numbers"), F.round(F.sum("v"), 2).alias("total"))


def normalized_dates(spark: SparkSession, folder: str) -> DataFrame:
    t = spans.regex_spans(_documents(spark, folder), "doc_id", "text", r"\b\d\d\.\d\d\.\d{4}\b")
    return t.withColumn("iso", normalize.to_date(F.col("offset_string"))).filter("iso is not null").groupBy("iso").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- evaluation


def evaluation_by_label(spark: SparkSession, folder: str) -> DataFrame:
    flagged = evaluate.with_flags(evaluate.compare_strict(_gold(spark, folder), _predicted(spark, folder), ["doc_id", "start_offset", "end_offset"]), 0.5)
    return evaluate.measures(evaluate.per_label(flagged))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    joined = evaluate.compare_strict(_gold(spark, folder), _predicted(spark, folder), ["doc_id", "start_offset", "end_offset"])
    return evaluate.threshold_sweep(joined)


def best_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.best_threshold(threshold_sweep(spark, folder))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    joined = evaluate.compare_strict(_gold(spark, folder), _predicted(spark, folder), ["doc_id", "start_offset", "end_offset"])
    return evaluate.confusion(joined.filter("is_matched"), None, "label", "label_predicted")


def overlapping_errors(spark: SparkSession, folder: str) -> DataFrame:
    joined = evaluate.compare_strict(_gold(spark, folder), _predicted(spark, folder), ["doc_id", "start_offset", "end_offset"])
    wrong = joined.filter("false_positive and not is_matched").select(F.col("doc_id_predicted").alias("doc_id"), F.col("start_offset_predicted").alias("start_offset"), F.col("end_offset_predicted").alias("end_offset"))
    hit = evaluate.overlapping_false_positives(wrong, _gold(spark, folder), "doc_id")
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start_offset").alias("sum_start"))


def overlapping_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison by label and touching spans, over all spans."""
    return evaluate.compare_overlapping(_gold(spark, folder), _predicted(spark, folder), "doc_id").agg(*evaluate.counts())


def missing_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Right spans that the tokenizer did not make."""
    p = _predicted(spark, folder).select("doc_id", "start_offset", "end_offset")
    lost = _gold(spark, folder).join(p, on=["doc_id", "start_offset", "end_offset"], how="left_anti")
    return lost.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_votes(spark: SparkSession, folder: str) -> DataFrame:
    """For each document the label its confident predictions vote for."""
    return evaluate.weighted_vote(_predicted(spark, folder).filter("confidence >= 0.1"), "doc_id", "label", "confidence")


def prioritized_rows(spark: SparkSession, folder: str) -> DataFrame:
    joined = evaluate.compare_strict(_gold(spark, folder), _predicted(spark, folder), ["doc_id", "start_offset", "end_offset"])
    best = evaluate.prioritize(joined, ["doc_id_predicted", "label_predicted"], ["start_offset_predicted", "end_offset_predicted"])
    return best.select(F.col("doc_id_predicted").alias("doc_id"), F.col("label_predicted").alias("label"), F.col("start_offset_predicted").alias("start_offset"), "true_positive")


# ---------------------------------------------------------------- categories and splitting


def name_categories(spark: SparkSession, folder: str) -> DataFrame:
    p = spans.pages(_documents(spark, folder), "doc_id", "text")
    return categorize.by_name(p, _read(spark, folder, "categories"), "doc_id").withColumn("page_index", F.col("page_index").cast("long"))


def category_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The category named on a document's first page against the one on record, one class against the rest."""
    named = name_categories(spark, folder).filter("page_index = 0").select("doc_id", F.col("category_id").alias("predicted"))
    actual = _documents(spark, folder).select("doc_id", F.col("category_id").alias("actual"))
    return evaluate.per_class(actual.join(named, on="doc_id", how="left").filter("actual is not null"))


def category_weighted_measures(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.weighted_measures(category_evaluation(spark, folder))


def best_page_categories(spark: SparkSession, folder: str) -> DataFrame:
    best = categorize.best_per_page(_read(spark, folder, "page_categories"), ["request_id", "number"])
    return best.select("request_id", F.col("number").cast("long").alias("number"), "category_id", "confidence")


def document_categories(spark: SparkSession, folder: str) -> DataFrame:
    return categorize.document_confidence(_read(spark, folder, "page_categories"), "request_id", "number")


def category_consensus(spark: SparkSession, folder: str) -> DataFrame:
    best = categorize.best_per_page(_read(spark, folder, "page_categories"), ["request_id", "number"])
    return categorize.consensus(best, "request_id", "number")


def _requests_as_pages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "split_requests").filter("text is not null").groupBy("request_id").agg(F.min("text").alias("text"))
    return spans.pages(docs, "request_id", "text").withColumn("kind", F.lit("all"))


def split_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the split requests: a page begins one if its first line has a number in it."""
    p = _requests_as_pages(spark, folder).withColumn("is_first_page", F.regexp_extract("page_text", r"^([^\n]*)", 1).rlike("[0-9]"))
    parts = split.group_pages(p, "request_id")
    return parts.select("request_id", F.col("page_index").cast("long").alias("page_index"), "split_id")


def split_documents(spark: SparkSession, folder: str) -> DataFrame:
    p = _requests_as_pages(spark, folder).withColumn("is_first_page", F.regexp_extract("page_text", r"^([^\n]*)", 1).rlike("[0-9]"))
    parts = split.sub_documents(split.group_pages(p, "request_id"), "request_id")
    return parts.select("request_id", "split_id", F.length("text").cast("long").alias("chars"), F.col("first_page").cast("long").alias("first_page"), F.col("n_pages").cast("long").alias("n_pages"))


def first_page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that all first pages of a category's documents share and not all its other pages."""
    docs = _documents(spark, folder)
    p = spans.pages(docs, "doc_id", "text").join(docs.select("doc_id", F.coalesce("category_id", F.lit(0)).alias("category_id")), on="doc_id")
    return split.exclusive_first_page_lines(p, "doc_id", "category_id")


def split_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """First pages told by a number in the first line, against the documents' real first pages, overall and per language."""
    docs = _documents(spark, folder)
    p = spans.pages(docs, "doc_id", "text").join(docs.select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang")), on="doc_id")
    judged = p.select("lang", (F.col("page_index") == 0).alias("actual"), F.regexp_extract("page_text", r"^([^\n]*)", 1).rlike("[0-9]").alias("predicted"))
    return split.evaluate_split(judged, "lang")


# ---------------------------------------------------------------- layout


def _all_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "extract_bboxes").distinct()


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The boxes with a line and a text."""
    return _all_boxes(spark, folder).filter("text is not null and line_index is not null")


def line_heights(spark: SparkSession, folder: str) -> DataFrame:
    t = layout.median_line_height(_all_boxes(spark, folder), ["request_id", "page_number"])
    return t.select("request_id", F.col("page_number").cast("long").alias("page_number"), "threshold")


def line_boxes(spark: SparkSession, folder: str) -> DataFrame:
    b = layout.line_boxes(_boxes(spark, folder), ["request_id", "page_number"], "line_index")
    return b.select("request_id", F.col("page_number").cast("long").alias("page_number"), F.col("line_index").cast("long").alias("line_index"), "x0", "x1", "y0", "y1", F.length("text").cast("long").alias("chars"))


def line_distance_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder)
    page = ["request_id", "page_number"]
    p = layout.paragraphs(layout.line_boxes(b, page, "line_index"), page, "line_index", layout.median_line_height(b, page))
    return p.groupBy("request_id", F.col("page_number").cast("long").alias("page_number")).agg((F.max("paragraph") + 1).alias("paragraphs"), F.count(F.lit(1)).alias("lines"))


def line_distance_sentences(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder)
    page = ["request_id", "page_number"]
    p = layout.sentences(layout.line_boxes(b, page, "line_index"), page, "line_index", layout.median_line_height(b, page))
    return p.groupBy("request_id", F.col("page_number").cast("long").alias("page_number")).agg((F.max("sentence") + 1).alias("sentences"))


def box_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes per request that are not valid on a page of A4 landscape or portrait size, and the sum of their areas."""
    b = _all_boxes(spark, folder)
    ok = geometry.is_valid(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), F.lit(842.0), F.lit(842.0))
    return b.groupBy("request_id").agg(F.sum(F.when(ok, 0).otherwise(1)).alias("invalid"), F.round(F.sum(geometry.area(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))), 1).alias("area"))


# ---------------------------------------------------------------- patterns, outliers, models, sources


def pattern_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    names = {"numbers": r"\d[\d.,]*", "capitals": r"[A-Z]{2,}", "whole": r"[^ \n\t\f]+"}
    return patterns.evaluate_patterns(_documents(spark, folder), _gold(spark, folder), "doc_id", names)


def pattern_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Token shapes as patterns, ranked by frequency; those that are the best of some token's first letter and length."""
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").select(strings.suggest_pattern(F.col("offset_string")).alias("pattern"), F.concat(F.substring("offset_string", 1, 1), F.length("offset_string").cast("string")).alias("annotation_id"))
    sizes = t.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    ranks = sizes.select("pattern", (-F.col("n")).alias("rank"))
    return patterns.greedy_cover(t.distinct(), ranks)


def rare_patterns(spark: SparkSession, folder: str) -> DataFrame:
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").select((F.length("offset_string") % 5).alias("label"), strings.suggest_pattern(F.col("offset_string")).alias("pattern"), F.concat_ws("-", "doc_id", "start_offset").alias("annotation_id"))
    return patterns.rare_pattern_outliers(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def document_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change of each split request between the deliveries before 2024 and all of them."""
    r = _read(spark, folder, "split_requests")
    return sources.changes(r.filter("received_at < '2024-01-01'"), r, "request_id", "received_at").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def response_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Categorization responses encoded, decoded again and counted per request. A large request has several payloads, whose counts are added."""
    sent = payloads.categorize_responses(_read(spark, folder, "page_categories"))
    back = sent.select("request_id", "piece", payloads.decode(F.col("payload"), "categorize_response", "20241227").alias("r"))
    counted = back.select("request_id", F.when(F.col("piece") == 0, F.size("r.pages")).otherwise(0).cast("long").alias("pages"), F.aggregate("r.pages", F.lit(0).cast("long"), lambda acc, p: acc + F.size(p["categories"])).alias("categories"))
    return counted.groupBy("request_id").agg(F.sum("pages").alias("pages"), F.sum("categories").alias("categories"))


def bio_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of the tokens without punctuation over the merged annotations."""
    docs = _documents(spark, folder)
    ann = spans.merge_horizontal(_gold(spark, folder), docs.select("doc_id", "text"), "doc_id", ["doc_id", "label"]).select("doc_id", "start_offset", "end_offset", F.col("label").cast("string").alias("label"))
    tags = merge.tag_bio(_predicted(spark, folder), ann, "doc_id")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def view_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts and tokens competing for the same text: what a reader is shown per document."""
    docs = _documents(spark, folder)
    amounts = spans.regex_spans(docs, "doc_id", "text", r"\d[\d.,]*").select("doc_id", "start_offset", "end_offset", F.lit("amount").alias("label"), F.lit(0.9).alias("confidence"))
    words = spans.regex_spans(docs, "doc_id", "text", r"[^ \n\t\f]*\d[^ \n\t\f]*").select("doc_id", "start_offset", "end_offset", F.lit("word").alias("label"), F.lit(0.5).alias("confidence"))
    both = amounts.unionByName(words).withColumns({"set_id": F.lit(1), "threshold": F.lit(0.1), "is_correct": F.lit(False), "revised": F.lit(False), "multiple": F.lit(True)})
    return merge.view_annotations(both, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shown"), F.sum("start_offset").alias("sum_start"))


def numeric_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Digit groups joined over single blanks as long as they still read as one number."""
    import re

    docs = _documents(spark, folder)
    t = spans.regex_spans(docs, "doc_id", "text", r"\d+").select("doc_id", F.lit("number").alias("label"), "start_offset", "end_offset", F.lit(1.0).alias("confidence"))
    shape = re.compile(r"\d{1,3}(?: \d{3})*|\d+")
    return merge.merge_while(t, docs.select("doc_id", "text").filter("text is not null"), "doc_id", lambda s: shape.fullmatch(s) is not None, 1).select("doc_id", "start_offset", "end_offset", "parts")


def vertical_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that stand below each other made one annotation, per request and page."""
    b = _boxes(spark, folder).select("request_id", F.col("page_number").cast("string").alias("label"), F.col("line_index").cast("long").alias("line_index"), F.col("bbox_key").alias("start_offset"), (F.col("bbox_key") + F.length("text")).cast("long").alias("end_offset"), "x0", "x1")
    return merge.merge_vertical(b.dropDuplicates(["request_id", "start_offset"]), "request_id").groupBy("request_id").agg(F.countDistinct("annotation_id").alias("annotations"), F.count(F.lit(1)).alias("spans"))


def label_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A forest that tells documents' categories from counts in their texts, fitted to all languages but English; the share of English documents told right, per category."""
    docs = _read(spark, folder, "documents").filter("category_id is not null and text <> ''").select("doc_id", "lang", F.col("category_id").cast("string").alias("label"), "text")
    feats = {"a": strings.digit_count(F.col("text")), "b": strings.upper_count(F.col("text")), "c": F.length("text"), "d": strings.count_substring(F.col("text"), "€"), "e": strings.count_substring(F.col("text"), "\n")}
    frame = docs.select("doc_id", "lang", "label", *[c.cast("double").alias(n) for n, c in feats.items()])
    model = features.fit_label_classifier(frame.filter("lang <> 'en' or lang is null"), list(feats), "label", trees=10, depth=6)
    scored = features.predict_labels(model, frame.filter("lang = 'en'"), list(feats))
    return scored.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("label_predicted")).cast("double")), 6).alias("right"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- views, slices, patterns, extraction


def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions as rows of annotations: what is right, what sure, and which set they are in are fixed functions of the span."""
    p = _predicted(spark, folder)
    return p.withColumns({"annotation_id": F.floor(F.col("start_offset") / 40), "is_correct": F.col("start_offset") % 3 == 0, "threshold": 0.1 * F.col("label"), "set_id": F.floor(F.col("start_offset") / 200)})


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.compare_strict(_gold(spark, folder), _predicted(spark, folder), ["doc_id", "start_offset", "end_offset"])


def status_views(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per view; their number of pages stands for the state."""
    docs = _read(spark, folder, "documents").select("doc_id", (F.col("n_pages") - 1).alias("dataset_status"))
    parts = [views.documents_in(docs, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "n") for v in (*views.STATUS, "virtual")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def annotation_view(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations that are right or sure enough and reach into a stretch of each document."""
    a = views.annotations(_annotated(spark, folder), use_correct=False, ignore_below_threshold=True, start=100, end=900)
    return a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("annotations"), F.sum("parts").alias("parts"), F.sum("start_offset").alias("sum_start"), F.sum(F.col("place") * F.col("end_offset")).alias("places"))


def distinct_span_view(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of either side once, with the label of the right one where both have it."""
    both = _gold(spark, folder).withColumn("annotation_id", F.lit(0)).unionByName(_predicted(spark, folder).drop("confidence").withColumn("annotation_id", F.lit(1)))
    return views.distinct_spans(both).groupBy("label", F.col("annotation_id").cast("long").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("start_offset").alias("sum_start"))


def annotation_set_view(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    lines = spans.lines(docs, "doc_id", "text").select("doc_id", "line_index", "start_offset", "end_offset")
    sets = views.annotation_sets(_annotated(spark, folder), lines)
    return sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"), F.sum("annotations").alias("annotations"), F.sum("first_line").alias("lines"))


def filled_text(spark: SparkSession, folder: str) -> DataFrame:
    """What no prediction covers, line by line."""
    docs = _documents(spark, folder).select("doc_id", "text")
    f = views.filled(_predicted(spark, folder), docs).filter("label = 'NO_LABEL'")
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"))


def page_set_view(spark: SparkSession, folder: str) -> DataFrame:
    pages = spans.pages(_documents(spark, folder), "doc_id", "text").select("doc_id", "page_index", "start_offset", "end_offset")
    return views.page_sets(_annotated(spark, folder), pages).groupBy("doc_id", F.col("page_index").cast("long").alias("page_index")).agg(F.count(F.lit(1)).alias("sets"))


def invalid_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans moved by their length, judged against the text and its lines."""
    docs = _documents(spark, folder).filter("text is not null")
    moved = _gold(spark, folder).select("doc_id", F.col("start_offset"), (F.col("end_offset") + F.when(F.col("label") == 0, -20).otherwise(F.col("label") * 3)).alias("end_offset"))
    lines = spans.lines(docs, "doc_id", "text").select("doc_id", "start_offset", "end_offset")
    judged = views.span_violations(moved, docs.select("doc_id", F.length("text").alias("length")), lines)
    return judged.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


def document_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.per_slice(evaluate.with_flags(_compared(spark, folder), 0.3), "doc_id")


def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the whole, of the tokenizer and of the classifier."""
    return evaluate.with_stage_flags(evaluate.with_flags(_compared(spark, folder), 0.3)).agg(*evaluate.all_counts())


def label_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one label, right or predicted, and their outcomes."""
    rows = evaluate.query_rows(evaluate.with_flags(_compared(spark, folder), 0.3), "label", 3)
    return rows.agg(F.count(F.lit(1)).alias("rows"), *evaluate.counts())


def label_frequency(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.with_frequency(_compared(spark, folder))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.max("frequency").alias("frequency"))


def disambiguated_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of right spans that occur more than once in a document, told apart."""
    ids = evaluate.disambiguated_ids(_gold(spark, folder).withColumn("id", F.floor(F.col("start_offset") / 30) * 10 + F.col("label")), "doc_id", "id", ["start_offset", "end_offset"])
    return ids.groupBy("doc_id").agg(F.countDistinct("disambiguated_id").alias("ids"), F.sum(F.col("disambiguated_id").contains("_").cast("long")).alias("told_apart"))


def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    r = evaluate.relations(evaluate.with_flags(_compared(spark, folder), 0.3), "label", "label_predicted")
    return r.groupBy("label", "label_predicted", "relation").agg(F.count(F.lit(1)).alias("n"))


def template_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Right spans put together as a copy has them, which knows a set of spans for every forty characters."""
    template = _predicted(spark, folder).select("doc_id", "start_offset", "end_offset", F.floor(F.col("start_offset") / 40).alias("annotation_id"))
    like = merge.merge_like(_gold(spark, folder), template, "doc_id")
    return like.groupBy("label").agg(F.count(F.lit(1)).alias("spans"), F.count("annotation_id").alias("merged"))


def multiline_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _annotated(spark, folder).withColumn("annotation_id", F.floor(F.col("start_offset") / 7))
    return merge.multiline_labels(rows, "doc_id")


def group_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts with their parts before and after the separator as groups."""
    found = label_patterns.find_matches(_documents(spark, folder), "doc_id", "text", r"(?P<whole>\d+)[.,](\d\d)")
    return found.groupBy("regex_group").agg(F.count(F.lit(1)).alias("n"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"))


def candidate_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut into numbers and what lies between."""
    pieces = label_patterns.candidates(_documents(spark, folder), "doc_id", "text", r"[0-9]+")
    return pieces.groupBy("doc_id").agg(F.sum(F.col("is_candidate").cast("long")).alias("candidates"), F.sum(F.when(~F.col("is_candidate"), F.length("value")).otherwise(0)).cast("long").alias("other_chars"), F.count(F.lit(1)).alias("pieces"))


def learned_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of legal forms, proposed by their spans and chosen for what each adds."""
    docs = _documents(spark, folder)
    gold = spans.regex_spans(docs, "doc_id", "text", r"GmbH|KG|Inc\.|S\.L\.|SARL").withColumn("label", F.lit("form"))
    return label_patterns.learn_patterns(docs, gold, context=False)


def numbered_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as numbers of the vocabulary's tokens, summed."""
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").select("doc_id", "start_offset", F.lower("offset_string").alias("token"))
    n = spans.numericalize(t, "doc_id", "start_offset", "token", vocabulary(spark, folder))
    return n.select("doc_id", F.size("indices").cast("long").alias("tokens"), F.aggregate("indices", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("sum_idx"))


def line_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Lines cut at sentence marks, and the sentences that run on over lines."""
    lines = spans.lines(_documents(spark, folder), "doc_id", "text").withColumnRenamed("line_text", "offset_string")
    s = spans.sentences_of_spans(lines, "doc_id")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), (F.max("sentence") + 1).alias("sentences"), F.sum("end_offset").alias("sum_end"))


def number_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that a programming language reads as numbers, and the parts of dates."""
    t = spans.tokenize(_documents(spark, folder), "doc_id", "text", "whitespace").groupBy("offset_string").agg(F.count(F.lit(1)).alias("n"))
    read = t.withColumn("v", normalize.to_python_float(F.col("offset_string")))
    return read.filter("v <> 0").groupBy(F.length("offset_string").cast("long").alias("chars")).agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.abs("v") < 1e9, F.col("v") * F.col("n"))), 2).alias("total"))


def date_readings(spark: SparkSession, folder: str) -> DataFrame:
    t = spans.regex_spans(_documents(spark, folder), "doc_id", "text", r"\b[0-3][0-9]\.[01][0-9]\.20[0-9][0-9]\b").groupBy("offset_string").agg(F.count(F.lit(1)).alias("n"))
    year, month, day = normalize.date_parts(F.col("offset_string"))
    read = t.withColumns({"days": normalize.days_since_2010(F.col("offset_string")), "y": year, "m": month, "d": day}).filter("y > 0 and days <> 0")
    return read.groupBy(F.col("y").cast("long").alias("year")).agg(F.sum("n").alias("n"), F.sum(F.col("days") * F.col("n")).alias("days"), F.sum(F.col("m") * F.col("n")).alias("months"), F.sum(F.col("d") * F.col("n")).alias("month_days"))


def relative_line_features(spark: SparkSession, folder: str) -> DataFrame:
    """Digits of the two lines before and after each line, summed per document."""
    lines = spans.lines(_documents(spark, folder), "doc_id", "text").select("doc_id", "line_index", strings.digit_count(F.col("line_text")).alias("digits"))
    r = features.relative_lines(lines, "doc_id", ["digits"], 2)
    return r.groupBy("doc_id").agg(*[F.sum(F.col(f"{s}_line_{i}_digits") * F.col("digits")).alias(f"{s}{i}") for s in ("prev", "next") for i in (1, 2)])


def page_line_spans(spark: SparkSession, folder: str) -> DataFrame:
    boxes = _boxes(spark, folder).select("request_id", "page_number", "line_index", F.col("bbox_key").alias("char_index"), "text")
    out = views.page_lines(boxes, ["request_id", "page_number"])
    return out.groupBy("request_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"))


def previous_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    p = views.previous_pages(_requests_as_pages(spark, folder), "request_id")
    return p.select("request_id", F.col("page_index").cast("long").alias("page_index"), "is_blank", F.coalesce(F.length("previous_text"), F.lit(-1)).cast("long").alias("previous_chars"))


def extraction_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline: fitted to documents of all languages but English (a sample of 30,000 of their tokens), judged on the English ones."""
    docs = _documents(spark, folder).filter("text <> ''")

    def gold(texts: DataFrame) -> DataFrame:
        amounts = spans.regex_spans(texts, "doc_id", "text", r"\d{1,3}(?:[.,]\d{3})*[.,]\d{2}(?![\d.,])").withColumn("label", F.lit("amount"))
        dates = spans.regex_spans(texts, "doc_id", "text", r"\b\d\d?[./]\d\d?[./]\d{4}\b").withColumn("label", F.lit("date"))
        return amounts.unionByName(dates).select("doc_id", "start_offset", "end_offset", "label")

    test, train = docs.filter("lang = 'en'"), docs.filter("lang <> 'en' or lang is null")
    picked = extraction.sample_tokens(train, 30_000, "whitespace")
    model = extraction.fit(extraction.sampled_frame(picked, train, gold, "whitespace"), trees=10, depth=8)
    return extraction.evaluate_full(gold(test.filter("doc_id is not null")), extraction.extract_texts(model, test, "whitespace"))


def queries() -> dict:
    named = [
        p6_found, tokenizer_comparison, list_tokenizer_spans, page_table, line_table, span_lines, horizontal_merge, uncovered_text, token_neighbours, gold_of_tokens, vocabulary, string_features, suggested_patterns,
        normalized_numbers, normalized_dates, evaluation_by_label, threshold_sweep, best_thresholds, confusion_matrix, overlapping_errors, overlapping_comparison, missing_spans, label_votes, prioritized_rows, name_categories,
        category_evaluation, category_weighted_measures, best_page_categories, document_categories, category_consensus, split_groups, split_documents, first_page_lines, split_evaluation, line_heights, line_boxes,
        line_distance_paragraphs, line_distance_sentences, box_checks, pattern_evaluation, pattern_cover, rare_patterns, document_changes, response_payloads, bio_tags, view_annotations, numeric_merge, vertical_merge, label_classifier,
        status_views, annotation_view, distinct_span_view, annotation_set_view, filled_text, page_set_view, invalid_spans, document_evaluation, stage_counts, label_slice, label_frequency, disambiguated_labels, relation_counts,
        template_merge, multiline_labels, group_matches, candidate_pieces, learned_patterns, numbered_texts, line_sentences, number_readings, date_readings, relative_line_features, page_line_spans, previous_page_texts, extraction_evaluation,
    ]
    return {f.__name__: f for f in named} | {f"{t}_spans": _span_sums(t) for t in spans.PATTERNS}
