"""SQL equivalents of the core queries, for DuckDB over the same tables."""

from quire.functions.strings import NEEDLES
from quire.operators.spans import PATTERNS


def tokens(pattern: str, group: str = "tok", lead: int = 0, trail: int = 0, where: str = "TRUE") -> str:
    """Matches with offsets: the gaps and the matches of a text alternate, so a running sum of lengths gives the ends. ``group`` is the part
    of the match that is the token, ``lead`` and ``trail`` the characters of the match around it."""
    p = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, tok, s AS start_offset, s + length(tok) AS end_offset FROM (
          SELECT doc_id, {group} AS tok, CAST(e - length(full_match) + {lead} AS BIGINT) AS s FROM (
            SELECT doc_id, full_match, sum(length(gap) + length(full_match)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
              SELECT doc_id, unnest(toks) AS full_match, unnest(gaps[1:len(toks)]) AS gap, unnest(range(len(toks))) AS i FROM (
                SELECT doc_id, regexp_extract_all(text, '{p}') AS toks, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL))))
        WHERE length(tok) > 0 AND NOT contains(tok, chr(10)) AND NOT contains(tok, chr(12)) AND {where}""".replace("{group}", group).replace("SELECT doc_id, tok AS tok", "SELECT doc_id, full_match AS tok")


_T2, _T3 = tokens(PATTERNS["whitespace"]), tokens(PATTERNS["whitespace_no_punctuation"])
_SIDES = f"""
    t2 AS MATERIALIZED ({_T2}), t3 AS MATERIALIZED ({_T3}),
    gold AS (SELECT doc_id, start_offset, end_offset, CAST(length(tok) % 5 AS BIGINT) AS label FROM t2),
    pred AS (SELECT doc_id, start_offset, end_offset, CAST(CASE WHEN length(tok) % 7 = 0 THEN 0 ELSE length(tok) % 5 END AS BIGINT) AS label,
                    CAST((start_offset * 37) % 100 AS DOUBLE) / 100 AS confidence FROM t3),
    joined AS (SELECT g.doc_id, g.start_offset, g.end_offset, g.label, p.doc_id AS pd, p.start_offset AS ps, p.end_offset AS pe, p.label AS pl, p.confidence AS pc
               FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.start_offset = p.start_offset AND g.end_offset = p.end_offset)"""
_LINES = """
    raw_lines AS (SELECT doc_id, unnest(l) AS line_text, unnest(range(len(l))) AS line_index FROM (
        SELECT doc_id, string_split(replace(text, chr(12), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    lines AS (SELECT doc_id, CAST(line_index AS BIGINT) AS line_index, line_text,
                     CAST(coalesce(sum(length(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM raw_lines)"""
_PAGES = """
    raw_pages AS (SELECT doc_id, unnest(l) AS page_text, unnest(range(len(l))) AS page_index FROM (
        SELECT doc_id, string_split(text, chr(12)) AS l FROM documents WHERE text IS NOT NULL)),
    pages AS (SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, page_text,
                     CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM raw_pages)"""
_MEASURES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN tp + 0.5 * (fp + fn) = 0 THEN 0 ELSE tp / (tp + 0.5 * (fp + fn)) END, 6) AS f1"""
_FLAGS = """
    flags AS (SELECT *, coalesce(pc >= {t}, FALSE) AS above, doc_id IS NOT NULL AND pd IS NOT NULL AND coalesce(pc >= {t}, FALSE) AND coalesce(label = pl, FALSE) AS hit FROM joined)"""
_REQUEST_PAGES = """
    docs AS (SELECT request_id, min(text) AS text FROM split_requests WHERE text IS NOT NULL GROUP BY request_id),
    rp AS (SELECT request_id, unnest(l) AS page_text, unnest(range(len(l))) AS page_index FROM (SELECT request_id, string_split(text, chr(12)) AS l FROM docs)),
    parts AS (SELECT request_id, CAST(page_index AS BIGINT) AS page_index, page_text,
        CAST(sum(CASE WHEN page_index = 0 OR regexp_matches(string_split(page_text, chr(10))[1], '[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY page_index) - 1 AS BIGINT) AS split_id FROM rp)"""
_BOXES = """
    boxes AS (SELECT DISTINCT * FROM extract_bboxes WHERE text IS NOT NULL AND line_index IS NOT NULL),
    thr AS (SELECT request_id, page_number, round(median(y1 - y0) * 0.8, 6) AS threshold FROM boxes GROUP BY ALL),
    lb AS (SELECT request_id, page_number, line_index, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, text) AS text FROM boxes GROUP BY request_id, page_number, line_index),
    gaps AS (SELECT lb.*, threshold, lag(lb.y0) OVER w AS above_y0, lag(lb.text) OVER w AS above_text FROM lb JOIN thr USING (request_id, page_number)
             WINDOW w AS (PARTITION BY request_id, page_number ORDER BY lb.y1 DESC, line_index)),
    paras AS (SELECT *, CAST(sum(CASE WHEN coalesce(above_y0 - y1 >= threshold, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY request_id, page_number ORDER BY y1 DESC, line_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM gaps)"""
_BEST = """
    good AS (SELECT * FROM page_categories WHERE confidence IS NOT NULL AND NOT isnan(confidence)),
    best AS (SELECT request_id, CAST(number AS BIGINT) AS number, category_id, confidence FROM good
             QUALIFY row_number() OVER (PARTITION BY request_id, number ORDER BY confidence DESC, category_id) = 1)"""
_SHAPE = """replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok, '([.^$*+?{}\\[\\]\\\\|()])', '\\\\\\1', 'g'), '[A-ZÄÖÜ]+', chr(1), 'g'), '[a-zäöüß]+', chr(2), 'g'), '[0-9]', chr(3), 'g'),
    chr(1), '[A-ZÄÖÜ]+'), chr(2), '[a-zäöüß]+'), chr(3), '\\d')"""
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _feature(name: str) -> str:
    s = f"translate(tok, '{_ACCENTED}', '{_BASE}')"
    if name.startswith("feat_substring_count_"):
        needle = NEEDLES[name.removeprefix("feat_substring_count_")]
        return f"(length(lower({s})) - length(replace(lower({s}), '{needle}', ''))) / {len(needle)}"
    return {
        "feat_vowel_len": f"len(regexp_extract_all(lower({s}), '[aeiou]'))", "feat_digit_len": f"len(regexp_extract_all({s}, '\\p{{Nd}}'))", "feat_upper_len": f"len(regexp_extract_all({s}, '\\p{{Lu}}'))", "feat_len": f"length({s})",
        "feat_unique_char_count": f"len(list_distinct(string_split({s}, '')))", "feat_starts_with_minus": f"CAST(starts_with({s}, '-') AS INT)", "feat_ends_with_minus": f"CAST(ends_with({s}, '-') AS INT)",
    }[name]


def oracle_sql() -> dict[str, str]:
    feats = ("feat_vowel_len", "feat_digit_len", "feat_upper_len", "feat_len", "feat_unique_char_count", "feat_starts_with_minus", "feat_ends_with_minus", "feat_substring_count_e", "feat_substring_count_sch", "feat_substring_count_period", "feat_substring_count_slash")
    sums = "SELECT doc_id, count(*) AS spans, CAST(sum(start_offset) AS BIGINT) AS sum_start, CAST(sum(end_offset) AS BIGINT) AS sum_end FROM ({}) GROUP BY doc_id"
    after_colon = "regexp_extract(full_match, '^.[ \\t]((?s).*)$', 1)"
    out = {
        "tokenizer_comparison": f"""WITH {_SIDES}, c AS (
            SELECT coalesce(d.lang, '?') AS lang, count(*) FILTER (j.doc_id IS NOT NULL AND j.pd IS NOT NULL) AS tp, count(*) FILTER (j.doc_id IS NULL) AS fp, count(*) FILTER (j.pd IS NULL) AS fn
            FROM joined j JOIN documents d ON d.doc_id = coalesce(j.doc_id, j.pd) GROUP BY ALL) SELECT lang, tp, fp, fn, {_MEASURES} FROM c""",
        "whitespace_spans": sums.format(_T2),
        "whitespace_no_punctuation_spans": sums.format(_T3),
        "connected_text_spans": sums.format(tokens(PATTERNS["connected_text"])),
        "colon_preceded_spans": sums.format(tokens(PATTERNS["colon_preceded"], after_colon, 2)),
        "colon_or_whitespace_preceded_spans": sums.format(tokens(r"[ :][ \t](?:(?:[^ \t\n\:\,\!\?\_]+(?:[ \t][^ \t\n\:\!\?\_]+)*)+)", after_colon, 2)),
        "non_text_spans": sums.format(tokens(PATTERNS["non_text"])),
        "list_tokenizer_spans": f"""SELECT tokenizer, count(*) AS spans FROM (SELECT doc_id, start_offset, end_offset, min(r) AS r, CASE min(r) WHEN 0 THEN 'whitespace_no_punctuation' ELSE 'whitespace' END AS tokenizer
            FROM (SELECT *, 0 AS r FROM ({_T3}) UNION ALL SELECT *, 1 AS r FROM ({_T2})) GROUP BY doc_id, start_offset, end_offset) GROUP BY tokenizer""",
        "page_table": f"WITH {_PAGES} SELECT doc_id, page_index, start_offset, start_offset + length(page_text) AS end_offset, CAST(length(page_text) AS BIGINT) AS chars FROM pages",
        "line_table": f"WITH {_LINES} SELECT doc_id, count(*) AS lines, CAST(sum(start_offset) AS BIGINT) AS sum_start, CAST(sum(start_offset + length(line_text)) AS BIGINT) AS sum_end FROM lines GROUP BY doc_id",
        "span_lines": f"""WITH {_LINES}, t AS ({_T2}) SELECT t.doc_id, l.line_index, count(*) AS tokens FROM t ASOF JOIN lines l ON t.doc_id = l.doc_id AND t.start_offset >= l.start_offset GROUP BY ALL""",
        "horizontal_merge": f"""WITH t AS ({_T2}), g AS (SELECT doc_id, start_offset, end_offset, CAST(length(tok) % 5 AS BIGINT) AS label FROM t),
            l AS (SELECT *, lag(end_offset) OVER (PARTITION BY doc_id, label ORDER BY start_offset) AS prev FROM g),
            f AS (SELECT l.*, CASE WHEN prev IS NULL OR start_offset - prev > 5 OR (start_offset > prev AND trim(substr(d.text, CAST(prev + 1 AS BIGINT), start_offset - prev), ' ') <> '') THEN 1 ELSE 0 END AS fresh FROM l JOIN documents d USING (doc_id)),
            i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label ORDER BY start_offset) AS island FROM f)
            SELECT doc_id, label, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS parts FROM i GROUP BY doc_id, label, island""",
        "uncovered_text": f"""WITH t AS ({_T3}), e AS (SELECT doc_id, start_offset, end_offset FROM t UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE text IS NOT NULL),
            u AS (SELECT *, coalesce(max(end_offset) OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM e)
            SELECT doc_id, CAST(upto AS BIGINT) AS start_offset, CAST(start_offset AS BIGINT) AS end_offset FROM u WHERE start_offset > upto""",
        "token_neighbours": f"""WITH {_LINES}, t AS ({_T2}), a AS (SELECT t.*, l.line_index FROM t ASOF JOIN lines l ON t.doc_id = l.doc_id AND t.start_offset >= l.start_offset),
            n AS (SELECT doc_id, coalesce(start_offset - lag(end_offset) OVER w, 100000) AS l, coalesce(lead(start_offset) OVER w - end_offset, 100000) AS r, coalesce(length(lag(tok) OVER w), 0) AS lc FROM a WINDOW w AS (PARTITION BY doc_id, line_index ORDER BY start_offset))
            SELECT doc_id, CAST(sum(l) AS BIGINT) AS "left", CAST(sum(r) AS BIGINT) AS "right", CAST(sum(lc) AS BIGINT) AS left_chars FROM n GROUP BY doc_id""",
        "gold_of_tokens": f"""WITH {_SIDES}, h AS (SELECT p.doc_id, p.start_offset, g.label, g.end_offset AS ge, p.end_offset AS pe FROM pred p ASOF LEFT JOIN gold g ON p.doc_id = g.doc_id AND p.start_offset >= g.start_offset)
            SELECT CASE WHEN ge >= pe THEN label END AS label, count(*) AS tokens, CAST(sum(start_offset) AS BIGINT) AS sum_start FROM h GROUP BY 1""",
        "vocabulary": f"""WITH c AS (SELECT lower(tok) AS token, count(*) AS freq FROM ({_T2}) GROUP BY 1 HAVING count(*) >= 5)
            SELECT token, CAST(1 + row_number() OVER (ORDER BY freq DESC, token) AS BIGINT) AS idx, freq FROM c UNION ALL SELECT '<unk>', 0, NULL UNION ALL SELECT '<pad>', 1, NULL""",
        "string_features": f"SELECT doc_id, {', '.join(f'CAST(sum({_feature(n)}) AS BIGINT) AS {n}' for n in feats)} FROM ({_T2}) GROUP BY doc_id",
        "suggested_patterns": f"SELECT {_SHAPE} AS pattern, count(*) AS n FROM ({_T2}) GROUP BY 1",
        "normalized_dates": """SELECT iso, count(*) AS n FROM (SELECT d[7:10] || '-' || d[4:5] || '-' || d[1:2] AS iso FROM (SELECT unnest(regexp_extract_all(text, '\\b\\d\\d\\.\\d\\d\\.\\d{4}\\b')) AS d FROM documents)
            WHERE CAST(d[1:2] AS INT) < 32 AND CAST(d[4:5] AS INT) < 13 AND CAST(d[7:10] AS INT) BETWEEN 1901 AND 2099) GROUP BY iso""",
        "evaluation_by_label": f"""WITH {_SIDES}, {_FLAGS.format(t=0.5)}, r AS (SELECT unnest(list_distinct([label, pl])) AS l, * FROM flags),
            c AS (SELECT l AS label, count(*) FILTER (hit) AS tp, count(*) FILTER (pl IS NOT NULL AND above AND NOT hit) AS fp, count(*) FILTER (label IS NOT NULL AND NOT hit) AS fn FROM (SELECT l, hit, above, pl, label FROM r WHERE l IS NOT NULL) GROUP BY l)
            SELECT label, tp, fp, fn, {_MEASURES} FROM c""".replace("l AS label, count(*) FILTER (hit)", "l AS label, count(*) FILTER (hit)"),
        "threshold_sweep": _sweep(),
        "best_thresholds": f"WITH s AS ({_sweep()}) SELECT label, threshold, f1 FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) = 1",
        "confusion_matrix": f"WITH {_SIDES} SELECT label AS actual, pl AS predicted, count(*) AS n FROM joined WHERE doc_id IS NOT NULL AND pd IS NOT NULL GROUP BY ALL",
        "overlapping_errors": f"""WITH {_SIDES}, w AS (SELECT pd, ps, pe FROM joined WHERE doc_id IS NULL), h AS (SELECT w.*, g.end_offset AS ge FROM w ASOF JOIN gold g ON w.pd = g.doc_id AND w.pe > g.start_offset)
            SELECT pd AS doc_id, count(*) AS n, CAST(sum(ps) AS BIGINT) AS sum_start FROM h WHERE ps < ge GROUP BY pd""",
        "missing_spans": f"WITH {_SIDES} SELECT label, count(*) AS n FROM joined WHERE pd IS NULL GROUP BY label",
        "label_votes": f"""WITH {_SIDES}, v AS (SELECT doc_id, label, sum(confidence) AS w FROM pred WHERE confidence >= 0.1 GROUP BY ALL)
            SELECT doc_id, label FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, label) = 1""",
        "prioritized_rows": f"""WITH {_SIDES}, {_FLAGS.format(t=0.0)} SELECT pd AS doc_id, pl AS label, ps AS start_offset, hit AS true_positive FROM flags WHERE pd IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY pd, pl ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, ps, pe) = 1""",
        "name_categories": f"""WITH {_NAMED} SELECT doc_id, page_index, category_id FROM named""",
        "category_evaluation": _category_eval(),
        "category_weighted_measures": f"""WITH e AS ({_category_eval()}) SELECT round(sum("precision" * (tp + fn)) / sum(tp + fn), 6) AS "precision", round(sum(recall * (tp + fn)) / sum(tp + fn), 6) AS recall, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1 FROM e""",
        "best_page_categories": f"WITH {_BEST} SELECT * FROM best",
        "document_categories": """WITH g AS (SELECT request_id, number, category_id, coalesce(max(CASE WHEN NOT isnan(confidence) THEN confidence END), 0) AS c FROM page_categories GROUP BY ALL),
            p AS (SELECT request_id, count(DISTINCT number) AS pages FROM g GROUP BY ALL) SELECT request_id, category_id, CAST(sum(CAST(c AS DECIMAL(18,9))) AS DOUBLE) / any_value(pages) AS confidence FROM g JOIN p USING (request_id) GROUP BY request_id, category_id""",
        "category_consensus": f"WITH {_BEST} SELECT request_id, CAST(CASE WHEN count(DISTINCT category_id) = 1 THEN min(category_id) ELSE 0 END AS BIGINT) AS category_id FROM best GROUP BY request_id",
        "split_groups": f"WITH {_REQUEST_PAGES} SELECT request_id, page_index, split_id FROM parts",
        "split_documents": f"WITH {_REQUEST_PAGES} SELECT request_id, split_id, CAST(sum(length(page_text)) + count(*) - 1 AS BIGINT) AS chars, min(page_index) AS first_page, count(*) AS n_pages FROM parts GROUP BY request_id, split_id",
        "first_page_lines": f"""WITH {_PAGES}, p AS (SELECT pages.*, coalesce(d.category_id, 0) AS category_id FROM pages JOIN documents d USING (doc_id)),
            l AS (SELECT DISTINCT doc_id, page_index, category_id, unnest(string_split(page_text, chr(10))) AS line FROM p), n AS (SELECT category_id, count(*) FILTER (page_index = 0) AS firsts, count(*) FILTER (page_index > 0) AS others FROM p GROUP BY ALL),
            s AS (SELECT category_id, line, count(*) FILTER (page_index = 0) AS f, count(*) FILTER (page_index > 0) AS o FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL)
            SELECT category_id, line FROM s JOIN n USING (category_id) WHERE f = firsts AND NOT (others > 0 AND o = others)""",
        "split_evaluation": f"""WITH {_PAGES}, j AS (SELECT coalesce(d.lang, '?') AS lang, page_index = 0 AS a, regexp_matches(string_split(page_text, chr(10))[1], '[0-9]') AS p FROM pages JOIN documents d USING (doc_id)),
            c AS (SELECT lang, CAST(grouping(lang) AS INT) AS overall, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM j GROUP BY ROLLUP (lang))
            SELECT lang, overall, tp, fp, fn, tn, {_MEASURES} FROM c""",
        "line_heights": "SELECT request_id, CAST(page_number AS BIGINT) AS page_number, round(median(y1 - y0) * 0.8, 6) AS threshold FROM (SELECT DISTINCT * FROM extract_bboxes) GROUP BY ALL",
        "line_boxes": f"WITH {_BOXES} SELECT request_id, CAST(page_number AS BIGINT) AS page_number, CAST(line_index AS BIGINT) AS line_index, x0, x1, y0, y1, CAST(length(text) AS BIGINT) AS chars FROM lb",
        "line_distance_paragraphs": f"WITH {_BOXES} SELECT request_id, CAST(page_number AS BIGINT) AS page_number, max(paragraph) + 1 AS paragraphs, count(*) AS lines FROM paras GROUP BY ALL",
        "line_distance_sentences": f"""WITH {_BOXES}, b AS (SELECT *, CASE WHEN coalesce(above_y0 - y1 >= threshold, FALSE) OR coalesce(regexp_matches(above_text, '[.!?]\\s*$'), FALSE) THEN 1 ELSE 0 END AS fresh FROM gaps)
            SELECT request_id, CAST(page_number AS BIGINT) AS page_number, CAST(sum(fresh) + 1 AS BIGINT) AS sentences FROM b GROUP BY ALL""",
        "box_checks": """WITH boxes AS (SELECT DISTINCT * FROM extract_bboxes) SELECT request_id, CAST(count(*) FILTER (NOT (round(x0, 2) < round(x1, 2) AND round(y0, 2) < round(y1, 2) AND round(x0, 2) >= 0 AND round(y0, 2) >= 0 AND round(x1, 2) <= 842 AND round(y1, 2) <= 842)) AS BIGINT) AS invalid,
            round(sum(round(abs(x0 - x1) * abs(y0 - y1), 3)), 1) AS area FROM boxes GROUP BY request_id""",
        "rare_patterns": f"""WITH t AS ({_T2}), f AS (SELECT CAST(length(tok) % 5 AS INT) AS label, {_SHAPE} AS pattern FROM t), s AS (SELECT label, pattern, count(*) AS n FROM f GROUP BY ALL),
            u AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY n, pattern) AS upto, sum(n) OVER (PARTITION BY label) AS total FROM s) SELECT label, CAST(sum(n) AS BIGINT) AS n FROM u WHERE upto <= total * 0.1 GROUP BY label""",
        "pattern_cover": f"""WITH t AS ({_T2}), f AS (SELECT {_SHAPE} AS pattern, substr(tok, 1, 1) || length(tok) AS a FROM t), s AS (SELECT pattern, -count(*) AS r FROM f GROUP BY ALL),
            b AS (SELECT DISTINCT a, pattern, r FROM f JOIN s USING (pattern) QUALIFY row_number() OVER (PARTITION BY a ORDER BY r, pattern) = 1) SELECT pattern, r AS rank, count(*) AS "new" FROM b GROUP BY ALL""",
        "document_changes": """WITH a AS (SELECT request_id, max(received_at) AS s FROM split_requests WHERE received_at < '2024-01-01' GROUP BY ALL), b AS (SELECT request_id, max(received_at) AS s FROM split_requests GROUP BY ALL)
            SELECT CASE WHEN a.request_id IS NULL THEN 'new' WHEN b.request_id IS NULL THEN 'deleted' WHEN b.s > a.s THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM a FULL JOIN b USING (request_id) GROUP BY 1""",
        "response_payloads": """SELECT request_id, count(DISTINCT number) AS pages, count(*) AS categories FROM page_categories GROUP BY request_id""",
    }
    return out | _view_sql() | _pattern_sql()


def _sweep() -> str:
    thresholds = ", ".join(f"{0.05 * i:.2f}" for i in range(1, 20))
    return f"""WITH {_SIDES}, r AS (SELECT unnest(list_distinct([label, pl])) AS l, label, pl, pc, doc_id IS NOT NULL AND pd IS NOT NULL AND coalesce(label = pl, FALSE) AS same FROM joined),
        x AS (SELECT l, CAST(t AS DOUBLE) AS threshold, same AND pc >= t AS hit, pl IS NOT NULL AND pc >= t AS made, label IS NOT NULL AS has FROM r, (SELECT unnest([{thresholds}]::DOUBLE[]) AS t) WHERE l IS NOT NULL),
        c AS (SELECT l AS label, threshold, count(*) FILTER (coalesce(hit, FALSE)) AS tp, count(*) FILTER (made AND NOT hit) AS fp, count(*) FILTER (has AND NOT coalesce(hit, FALSE)) AS fn FROM x GROUP BY ALL)
        SELECT label, threshold, tp, fp, fn, {_MEASURES} FROM c"""


_NAMED = _PAGES + """,
    own AS (SELECT p.doc_id, p.page_index, c.category_id FROM pages p JOIN categories c ON c.fallback_name IS NOT NULL AND c.category_id <> 0 AND contains(lower(p.page_text), c.fallback_name)
            QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page_index ORDER BY length(c.fallback_name) DESC, c.category_id) = 1),
    named AS (SELECT p.doc_id, p.page_index, coalesce(o.category_id, f.category_id) AS category_id FROM pages p LEFT JOIN own o USING (doc_id, page_index)
              LEFT JOIN (SELECT doc_id, arg_min(category_id, page_index) AS category_id FROM own GROUP BY doc_id) f USING (doc_id))"""


def _category_eval() -> str:
    return f"""WITH {_NAMED}, j AS (SELECT d.category_id AS a, n.category_id AS p FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id AND n.page_index = 0 WHERE d.category_id IS NOT NULL),
        k AS (SELECT a AS class FROM j UNION SELECT p FROM j WHERE p IS NOT NULL),
        c AS (SELECT class, count(*) FILTER (a = class AND coalesce(p = class, FALSE)) AS tp, count(*) FILTER (a <> class AND p = class) AS fp, count(*) FILTER (a = class AND NOT coalesce(p = class, FALSE)) AS fn, count(*) AS total FROM k, j GROUP BY class)
        SELECT class, tp, fp, fn, total - tp - fp - fn AS tn, {_MEASURES} FROM c"""


_ANNOTATED = "ann AS (SELECT *, CAST(start_offset // 40 AS BIGINT) AS annotation_id, start_offset % 3 = 0 AS is_correct, CAST(0.1 AS DOUBLE) * label AS threshold, CAST(start_offset // 200 AS BIGINT) AS set_id FROM pred)"
_PAGE_AT = _PAGES + ", placed AS (SELECT a.*, p.page_index FROM ann a ASOF JOIN pages p ON a.doc_id = p.doc_id AND a.start_offset >= p.start_offset)"
_JUDGED = _FLAGS.format(t=0.3) + """,
    judged AS (SELECT *, pl IS NOT NULL AND above AND NOT hit AS wrong, label IS NOT NULL AND NOT hit AS missed, doc_id IS NOT NULL AND pd IS NOT NULL AS matched FROM flags)"""
_COUNTS = "count(*) FILTER (hit) AS tp, count(*) FILTER (wrong) AS fp, count(*) FILTER (missed) AS fn"
_MERGED = f"""t AS ({_T2}), g AS (SELECT doc_id, start_offset, end_offset, CAST(length(tok) % 5 AS BIGINT) AS label FROM t),
    l AS (SELECT *, lag(end_offset) OVER (PARTITION BY doc_id, label ORDER BY start_offset) AS prev FROM g),
    f AS (SELECT l.*, CASE WHEN prev IS NULL OR start_offset - prev > 5 OR (start_offset > prev AND trim(substr(d.text, CAST(prev + 1 AS BIGINT), start_offset - prev), ' ') <> '') THEN 1 ELSE 0 END AS fresh FROM l JOIN documents d USING (doc_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label ORDER BY start_offset) AS island FROM f),
    merged AS (SELECT doc_id, label, min(start_offset) AS start_offset, max(end_offset) AS end_offset FROM i GROUP BY doc_id, label, island)"""


def _view_sql() -> dict[str, str]:
    return {
        "status_views": """WITH s AS (SELECT n_pages - 1 AS k FROM documents), v AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest(['no_status', 'preparation', 'training', 'test', 'excluded']) AS view)
            SELECT view, count(s.k) AS n FROM v LEFT JOIN s USING (k) GROUP BY view UNION ALL SELECT 'virtual', count(*) FROM s WHERE k IS NULL""",
        "annotation_view": f"""WITH {_SIDES}, {_ANNOTATED}, u AS (SELECT * FROM ann WHERE is_correct OR (confidence <> 0 AND confidence >= threshold)),
            w AS (SELECT doc_id, annotation_id, label, min(start_offset) AS s, max(end_offset) AS e, count(*) AS parts, bool_or(greatest(start_offset, 100) < least(end_offset, 900)) AS hit FROM u GROUP BY ALL),
            p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, annotation_id) - 1 AS place FROM w WHERE hit)
            SELECT doc_id, count(*) AS annotations, CAST(sum(parts) AS BIGINT) AS parts, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(place * e) AS BIGINT) AS places FROM p GROUP BY doc_id""",
        "distinct_span_view": f"""WITH {_SIDES}, b AS (SELECT doc_id, start_offset, end_offset, label, 0 AS side FROM gold UNION ALL SELECT doc_id, start_offset, end_offset, label, 1 FROM pred),
            d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, start_offset, end_offset ORDER BY side) = 1)
            SELECT label, CAST(side AS BIGINT) AS side, count(*) AS n, CAST(sum(start_offset) AS BIGINT) AS sum_start FROM d GROUP BY ALL""",
        "annotation_set_view": f"""WITH {_SIDES}, {_ANNOTATED}, {_LINES}, s AS (SELECT doc_id, set_id, min(start_offset) AS s, max(end_offset) AS e, count(DISTINCT annotation_id) AS a FROM ann GROUP BY ALL),
            f AS (SELECT s.*, l.line_index FROM s ASOF JOIN lines l ON s.doc_id = l.doc_id AND s.s >= l.start_offset)
            SELECT doc_id, count(*) AS sets, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end, CAST(sum(a) AS BIGINT) AS annotations, CAST(sum(line_index) AS BIGINT) AS lines FROM f GROUP BY doc_id""",
        "filled_text": f"""WITH t AS ({_T3}), e AS (SELECT doc_id, start_offset, end_offset FROM t UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE text IS NOT NULL),
            u AS (SELECT *, coalesce(max(end_offset) OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM e),
            gaps AS (SELECT u.doc_id, CAST(upto AS BIGINT) AS a, regexp_extract_all(substr(d.text, CAST(upto + 1 AS BIGINT), CAST(start_offset - upto AS BIGINT)), '[\n\f]|[^\n\f]+') AS parts FROM u JOIN documents d USING (doc_id) WHERE start_offset > upto),
            p AS (SELECT doc_id, a, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM gaps),
            q AS (SELECT doc_id, a + sum(length(part)) OVER (PARTITION BY doc_id, a ORDER BY k) AS e, length(part) AS n FROM p)
            SELECT doc_id, count(*) AS n, CAST(sum(e - n) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end FROM q GROUP BY doc_id""",
        "page_set_view": f"WITH {_SIDES}, {_ANNOTATED}, {_PAGE_AT} SELECT doc_id, page_index, count(DISTINCT set_id) AS sets FROM placed GROUP BY ALL",
        "invalid_spans": f"""WITH t AS ({_T2}), {_LINES}, m AS (SELECT doc_id, start_offset AS s, end_offset + CASE length(tok) % 5 WHEN 0 THEN -20 ELSE (length(tok) % 5) * 3 END AS e FROM t),
            a AS (SELECT m.*, l.start_offset + length(l.line_text) AS line_end, length(d.text) AS n FROM m ASOF JOIN lines l ON m.doc_id = l.doc_id AND m.s >= l.start_offset JOIN documents d ON d.doc_id = m.doc_id)
            SELECT CASE WHEN e <= s THEN 'empty' WHEN e > n THEN 'outside' WHEN e > line_end THEN 'lines' ELSE 'none' END AS violation, count(*) AS n FROM a GROUP BY 1""",
        "document_evaluation": f"""WITH {_SIDES}, {_JUDGED}, c AS (SELECT coalesce(doc_id, pd) AS doc_id, {_COUNTS} FROM judged GROUP BY 1) SELECT doc_id, tp, fp, fn, {_MEASURES} FROM c""",
        "stage_counts": f"""WITH {_SIDES}, {_JUDGED} SELECT {_COUNTS}, count(*) FILTER (matched) AS tokenizer_tp, count(*) FILTER (label IS NULL AND pl IS NOT NULL) AS tokenizer_fp, count(*) FILTER (label IS NOT NULL AND NOT matched) AS tokenizer_fn,
            count(*) FILTER (matched AND above AND label = pl) AS clf_tp, count(*) FILTER (matched AND above AND label <> pl) AS clf_fp, count(*) FILTER (matched AND NOT above) AS clf_fn, count(label) AS gt,
            count(*) FILTER (NOT hit AND NOT wrong AND NOT missed) AS tn FROM judged""",
        "label_slice": f"WITH {_SIDES}, {_JUDGED} SELECT count(*) AS rows, {_COUNTS} FROM judged WHERE label = 3 OR pl = 3",
        "label_frequency": f"WITH {_SIDES} SELECT label, count(*) AS rows, CASE WHEN label IS NULL THEN 0 ELSE count(*) END AS frequency FROM joined GROUP BY label",
        "disambiguated_labels": f"""WITH t AS ({_T2}), i AS (SELECT doc_id, (start_offset // 30) * 10 + length(tok) % 5 AS id, start_offset FROM t),
            k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, id) AS n FROM i) SELECT doc_id, count(DISTINCT id) + CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) - count(DISTINCT CASE WHEN n > 1 THEN id END) AS ids, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS told_apart FROM k GROUP BY doc_id""",
        "relation_counts": f"""WITH {_SIDES}, {_JUDGED} SELECT coalesce(CAST(label AS VARCHAR), 'no_match') AS label, coalesce(CAST(pl AS VARCHAR), 'no_match') AS label_predicted,
            CASE WHEN hit THEN 'TP' WHEN wrong THEN 'FP' WHEN missed THEN 'FN' ELSE 'TN' END AS relation, count(*) AS n FROM judged GROUP BY ALL""",
        "template_merge": f"""WITH {_SIDES}, o AS (SELECT g.*, p.start_offset // 40 AS a FROM gold g LEFT JOIN pred p USING (doc_id, start_offset, end_offset)),
            v AS (SELECT doc_id, a, label, count(*) AS n, min(start_offset) AS s FROM o WHERE a IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, a, label AS best FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, a ORDER BY n DESC, s) = 1)
            SELECT coalesce(best, label) AS label, count(*) AS spans, count(a) AS merged FROM o LEFT JOIN b USING (doc_id, a) GROUP BY 1""",
        "multiline_labels": f"WITH {_SIDES}, s AS (SELECT doc_id, start_offset // 7 AS a, label, count(*) AS n FROM pred GROUP BY ALL) SELECT label, max(n) > 1 AS multiline FROM s GROUP BY label",
        "line_sentences": f"""WITH {_LINES}, p AS (SELECT doc_id, start_offset, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM (SELECT doc_id, start_offset, regexp_extract_all(line_text, '[^.!?]*[.!?]|[^.!?]+$') AS parts FROM lines)),
            q AS (SELECT doc_id, start_offset + sum(length(part)) OVER (PARTITION BY doc_id, start_offset ORDER BY k) AS e, regexp_matches(part, '[.!?]$') AS ended FROM p),
            r AS (SELECT doc_id, e, coalesce(sum(CASE WHEN ended THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q)
            SELECT doc_id, count(*) AS pieces, CAST(max(s) + 1 AS BIGINT) AS sentences, CAST(sum(e) AS BIGINT) AS sum_end FROM r GROUP BY doc_id""",
        "numbered_texts": f"""WITH t AS (SELECT doc_id, lower(tok) AS token FROM ({_T2})), c AS (SELECT token, count(*) AS freq FROM t GROUP BY 1 HAVING count(*) >= 5), v AS (SELECT token, 1 + row_number() OVER (ORDER BY freq DESC, token) AS idx FROM c)
            SELECT doc_id, count(*) AS tokens, CAST(sum(coalesce(idx, 0)) AS BIGINT) AS sum_idx FROM t LEFT JOIN v USING (token) GROUP BY doc_id""",
        "number_readings": rf"""WITH t AS (SELECT tok, CAST(replace(tok, '_', '') AS DOUBLE) AS v FROM ({_T2}) WHERE regexp_full_match(lower(tok), '[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:e[+-]?[0-9](?:_?[0-9])*)?'))
            SELECT length(tok) AS chars, count(*) AS n, round(sum(CASE WHEN abs(v) < 1e9 THEN v END), 2) AS total FROM t WHERE v <> 0 AND v < 3.4028235e38 GROUP BY 1""",
        "date_readings": """WITH d AS (SELECT try_strptime(x, '%d.%m.%Y')::DATE AS d FROM (SELECT unnest(regexp_extract_all(text, '\\b[0-3][0-9]\\.[01][0-9]\\.20[0-9][0-9]\\b')) AS x FROM documents)),
            r AS (SELECT d, CASE WHEN d = DATE '2010-01-01' THEN 1 ELSE d - DATE '2010-01-01' END AS days FROM d WHERE d IS NOT NULL)
            SELECT year(d) AS year, count(*) AS n, CAST(sum(days) AS BIGINT) AS days, CAST(sum(month(d)) AS BIGINT) AS months, CAST(sum(day(d)) AS BIGINT) AS month_days FROM r GROUP BY 1""",
        "relative_line_features": f"""WITH {_LINES}, d AS (SELECT doc_id, line_index, len(regexp_extract_all(line_text, '\\p{{Nd}}')) AS n FROM lines),
            w AS (SELECT doc_id, n, coalesce(lag(n) OVER o, 0) AS p1, coalesce(lag(n, 2) OVER o, 0) AS p2, coalesce(lead(n) OVER o, 0) AS n1, coalesce(lead(n, 2) OVER o, 0) AS n2 FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY line_index))
            SELECT doc_id, CAST(sum(p1 * n) AS BIGINT) AS prev1, CAST(sum(p2 * n) AS BIGINT) AS prev2, CAST(sum(n1 * n) AS BIGINT) AS next1, CAST(sum(n2 * n) AS BIGINT) AS next2 FROM w GROUP BY doc_id""",
        "page_line_spans": rf"""WITH {_BOXES}, l AS (SELECT request_id, page_number, line_index, min(bbox_key) AS s, max(bbox_key) + 1 AS e FROM boxes WHERE NOT regexp_full_match(text, '\s*') GROUP BY ALL)
            SELECT request_id, count(*) AS lines, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end FROM l GROUP BY request_id""",
        "previous_page_texts": rf"""WITH {_REQUEST_PAGES}, b AS (SELECT request_id, CAST(page_index AS BIGINT) AS page_index, page_text, regexp_full_match(page_text, '\s*') AS is_blank FROM rp)
            SELECT request_id, page_index, is_blank, CAST(coalesce(length(last_value(CASE WHEN NOT is_blank THEN page_text END IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), -1) AS BIGINT) AS previous_chars FROM b""",
    }


def _pattern_sql() -> dict[str, str]:
    named = {"numbers": r"\d[\d.,]*", "capitals": r"[A-Z]{2,}", "whole": PATTERNS["whitespace"]}
    found = " UNION ALL ".join(f"SELECT '{n}' AS pattern, doc_id, start_offset, end_offset FROM ({tokens(p)})" for n, p in named.items())
    amounts = tokens(r"\d+[.,]\d\d")
    return {
        "pattern_evaluation": f"""WITH t AS ({_T2}), g AS (SELECT DISTINCT doc_id, start_offset, end_offset FROM t), f AS ({found}),
            c AS (SELECT pattern, count(*) AS findings, count(g.doc_id) AS correct, count(DISTINCT f.doc_id) AS documents, (SELECT count(*) FROM g) AS annotations FROM f LEFT JOIN g USING (doc_id, start_offset, end_offset) GROUP BY pattern)
            SELECT pattern, findings, correct, documents, annotations, round(correct / findings, 6) AS "precision", round(correct / annotations, 6) AS recall, round(correct / (correct + 0.5 * (findings - correct + annotations - correct)), 6) AS f1 FROM c""",
        "bio_tags": f"""WITH {_MERGED}, p AS ({_T3}), c AS (SELECT p.doc_id, p.start_offset, p.end_offset, m.start_offset AS a, m.end_offset AS b, CAST(m.label AS VARCHAR) AS l FROM p ASOF LEFT JOIN merged m ON p.doc_id = m.doc_id AND p.start_offset >= m.start_offset),
            h AS (SELECT doc_id, start_offset, end_offset, CASE WHEN b >= end_offset THEN a END AS a, CASE WHEN b >= end_offset THEN l END AS l FROM c),
            n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a, l ORDER BY start_offset) AS k FROM h)
            SELECT CASE WHEN l IS NULL THEN 'O' WHEN k = 1 THEN 'B-' || l ELSE 'I-' || l END AS tag, count(*) AS n FROM n GROUP BY 1""",
        "overlapping_comparison": f"""WITH {_SIDES}, m AS (SELECT g.doc_id, g.label, g.start_offset AS s, g.end_offset AS e, p.start_offset AS ps, p.end_offset AS pe FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.label = p.label AND p.start_offset <= g.end_offset AND p.end_offset >= g.start_offset),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, s, e ORDER BY ps, pe) AS ng, row_number() OVER (PARTITION BY doc_id, label, ps, pe ORDER BY s, e) AS np FROM m),
            missed AS (SELECT count(*) AS n FROM gold g ANTI JOIN m ON g.doc_id = m.doc_id AND g.label = m.label AND g.start_offset = m.s AND g.end_offset = m.e),
            wrong AS (SELECT count(*) AS n FROM pred p ANTI JOIN m ON p.doc_id = m.doc_id AND p.label = m.label AND p.start_offset = m.ps AND p.end_offset = m.pe)
            SELECT (SELECT count(*) FROM r WHERE NOT (ng > 1 AND np > 1)) AS tp, (SELECT n FROM wrong) AS fp, (SELECT n FROM missed) AS fn""",
        "group_matches": f"""WITH t AS ({amounts}), w AS (SELECT start_offset AS s, end_offset AS e FROM t) SELECT 'whole' AS regex_group, count(*) AS n, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(e - 3) AS BIGINT) AS sum_end FROM w
            UNION ALL SELECT '2', count(*), CAST(sum(e - 2) AS BIGINT), CAST(sum(e) AS BIGINT) FROM w UNION ALL SELECT '0', count(*), CAST(sum(s) AS BIGINT), CAST(sum(e) AS BIGINT) FROM w""",
        "candidate_pieces": """SELECT doc_id, len(m) AS candidates, length(regexp_replace(text, '[0-9]+', '', 'g')) AS other_chars, 2 * len(m) + 1 AS pieces FROM (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+') AS m FROM documents WHERE text IS NOT NULL)""",
    }
