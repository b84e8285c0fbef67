"""Queries of similarity, evaluation, submissions, splits and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import char_error_rate, error_class, multiset_f1, token_f1
from ..operators import evaluate as ev
from ..operators import splits, submission
from ..operators.latency import nearest_rank
from .adapters import EVAL_KEY, PARTS, PLAIN, SOLUTION, SUBMISSION, TURNS, part_labels, table, turns
from .adapters import solution as solution_of
from .adapters import submission as submission_of

KEY = "pair_id"
TRIM = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


def _cer(profile):
    return lambda spark, sf: turns(spark, sf).select(KEY, char_error_rate(F.col("truth"), F.col("guess"), profile).alias("cer"))


def _cer_sql(truth, guess, profile):
    a, b = (PLAIN.format(c if profile == "eval" else TRIM.format(c)) for c in (truth, guess))
    rate = f"levenshtein({a}, {b})::DOUBLE / length({a})"
    return f"CASE WHEN {a} = '' THEN ({b} != '')::INT::DOUBLE ELSE {rate if profile == 'eval' else f'least({rate}, 1.0)'} END"


def _set_f1_sql(truth, guess):
    t, g = (rf"list_distinct(regexp_extract_all(lower({TRIM.format(c)}), '\S+'))" for c in (truth, guess))
    common = f"len(list_intersect({t}, {g}))::DOUBLE"
    return f"CASE WHEN {TRIM.format(truth)} = '' AND {TRIM.format(guess)} = '' THEN 1.0 WHEN len({t}) = 0 OR len({g}) = 0 OR {common} = 0 THEN 0.0 ELSE 2 * ({common} / len({g})) * ({common} / len({t})) / ({common} / len({g}) + {common} / len({t})) END"


def _multi_f1_sql(source, truth, guess, key=KEY):
    """CTEs that end in multi(pair_id, f1)."""
    words = lambda c, n: f"{n} AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all({EVAL_KEY.format(c)}, '[a-z0-9]+')) AS w FROM {source}) GROUP BY ALL)"
    sums = lambda n: f"coalesce((SELECT sum(n) FROM {n} x WHERE x.{key} = p.{key}), 0)::DOUBLE"
    return f"""{words(truth, 'tw')}, {words(guess, 'gw')}, common AS (SELECT tw.{key}, sum(least(tw.n, gw.n))::DOUBLE AS c FROM tw JOIN gw ON tw.{key} = gw.{key} AND tw.w = gw.w GROUP BY 1),
sizes AS (SELECT p.{key}, {sums('tw')} AS t, {sums('gw')} AS g, coalesce((SELECT c FROM common x WHERE x.{key} = p.{key}), 0) AS c FROM {source} p),
multi AS (SELECT {key}, CASE WHEN t = 0 AND g = 0 THEN 1.0 WHEN t = 0 OR g = 0 OR c = 0 THEN 0.0 ELSE 2 * (c / g) * (c / t) / (c / g + c / t) END AS f1 FROM sizes)"""


def _class_sql(guess, truth):
    g, t = EVAL_KEY.format(guess), EVAL_KEY.format(truth)
    a, b = f"string_split({g}, ' ')", f"string_split({t}, ' ')"
    return f"CASE WHEN {g} = '' AND {t} = '' THEN 'true_blank' WHEN {g} = '' THEN 'miss' WHEN {t} = '' THEN 'false_fill' WHEN {g} = {t} THEN 'correct' WHEN list_has_all({b}, {a}) THEN 'partial_too_short' WHEN list_has_all({a}, {b}) THEN 'partial_too_long' WHEN list_has_any({a}, {b}) THEN 'wrong_partial_overlap' ELSE 'wrong_no_overlap' END"


def _pairs(spark, sf):
    return ev.matched(solution_of(spark, sf), submission_of(spark, sf), KEY)


_MATCHED = f"{TURNS}, {SOLUTION}, {SUBMISSION}, pairs AS (SELECT pair_id, s.ocr_text AS gt_ocr_text, s.brand_name AS gt_brand_name, s.product_name AS gt_product_name, p.ocr_text AS pred_ocr_text, p.brand_name AS pred_brand_name, p.product_name AS pred_product_name FROM solution s JOIN submission p USING (pair_id))"


def _composite_sql(weights):
    return f"""WITH {_MATCHED}, m AS (SELECT avg({_set_f1_sql('gt_brand_name', 'pred_brand_name')}) AS brand_f1, avg({_set_f1_sql('gt_product_name', 'pred_product_name')}) AS product_f1, avg({_cer_sql('gt_ocr_text', 'pred_ocr_text', 'metric')}) AS cer FROM pairs)
SELECT *, round_even({weights['brand']}::DOUBLE * brand_f1 + {weights['ocr']}::DOUBLE * (1.0 - cer) + {weights['product']}::DOUBLE * product_f1, 4) AS score FROM m"""


def error_cases(spark, sf):
    return ev.error_cases(_pairs(spark, sf), KEY)


def eval_report(spark, sf):
    made, _ = ev.report(solution_of(spark, sf), submission_of(spark, sf), KEY)
    return made.select("rows_pred", "rows_gt", "rows_overlap", F.col("product.exact_match").alias("exact_match"), F.col("ocr.cer_macro").alias("cer_macro"), F.col("error_cases.count").alias("error_cases"))


def score_by_group(spark, sf):
    truth = solution_of(spark, sf).withColumn("usage", F.when(F.col(KEY) % 3 == 0, "Public").otherwise("Private"))
    return ev.score_by(truth, submission_of(spark, sf), KEY, "usage")


def id_set_diff(spark, sf):
    return ev.id_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def _broken(spark, sf):
    """A submission with faults: ids of labels for the catalog of documents, some repeated, null or with line ends."""
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.lit("a\nb")).otherwise(F.lit("x")).alias("ocr_text"))
    return rows.unionByName(rows.where("image_id % 50 = 0"))


def validate_submission(spark, sf):
    found = submission.check(_broken(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("image_id")), ["image_id", "ocr_text", "product_name"])
    return found.select("ok", "rows", F.explode("errors").alias("e")).select("ok", "rows", "e.type", "e.count")


def catalog_completion(spark, sf):
    made = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("brand_name"))
    return submission.completed(made, table(spark, sf, "documents"), "doc_id", ["brand_name"])


def manual_override(spark, sf):
    made = table(spark, sf, "documents").select("doc_id", F.col("source").alias("brand_name"))
    fixed = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit("fixed").alias("brand_name"))
    return submission.overridden(made, fixed, "doc_id", ["brand_name"])


def reindex_template(spark, sf):
    template = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ord"))
    return submission.like_template(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("q")), template, "doc_id", "ord", ["q"])


def fill_rates(spark, sf):
    return submission.fill_rates(submission_of(spark, sf), ["ocr_text", "brand_name", "product_name"])


def cleaned_submission(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.col("text").alias("ocr_text"), F.col("source").alias("brand_name"))
    return submission.cleaned(docs)


def row_numbers(spark, sf):
    return submission.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def page_of_items(spark, sf):
    return submission.paged(table(spark, sf, "documents").select("doc_id", "lang"), 5, 20, "doc_id")


def random_split(spark, sf):
    return splits.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


def group_holdout_split(spark, sf):
    return splits.group_holdout(part_labels(spark, sf), "item_id")[0].select("item_id", "norm_product_name", "split")


def latency_nearest_rank(spark, sf):
    return nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def token_counts(spark, sf):
    return ev.error_histogram(_pairs(spark, sf))


QUERIES = {
    "cer_metric": _cer("metric"), "cer_eval": _cer("eval"), "btc_cer": _cer("target"),
    "token_f1_set": lambda s, d: turns(s, d).select(KEY, token_f1(F.col("truth"), F.col("guess")).alias("f1")),
    "token_f1_multiset": lambda s, d: turns(s, d).select(KEY, multiset_f1(F.col("truth"), F.col("guess")).alias("f1")),
    "classify_field_error": lambda s, d: _pairs(s, d).select(KEY, error_class(F.col("pred_product_name"), F.col("gt_product_name")).alias("error")),
    "error_cases": error_cases, "error_histogram": token_counts, "composite_score": lambda s, d: ev.composite(_pairs(s, d)), "phase1_score": lambda s, d: ev.composite(_pairs(s, d), ev.PHASE_1), "score_by_group": score_by_group,
    "product_metrics": lambda s, d: ev.product_metrics(_pairs(s, d)), "ocr_metrics": lambda s, d: ev.ocr_metrics(_pairs(s, d)), "eval_report": eval_report,
    "id_set_diff": id_set_diff, "validate_submission": validate_submission, "catalog_completion": catalog_completion, "manual_override": manual_override, "reindex_template": reindex_template, "fill_rates": fill_rates, "cleaned_submission": cleaned_submission,
    "row_numbers": row_numbers, "page_of_items": page_of_items, "random_split": random_split, "group_holdout_split": group_holdout_split, "latency_nearest_rank": latency_nearest_rank,
}

_BLANK = f"({EVAL_KEY} = '')"
_G, _T = "pred_product_name", "gt_product_name"
_CLASS = _class_sql(_G, _T)
_LINE = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
_BROKEN = "b AS (SELECT doc_id AS image_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'a' || chr(10) || 'b' ELSE 'x' END AS ocr_text FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'a' || chr(10) || 'b' ELSE 'x' END FROM labels WHERE doc_id % 50 = 0)"
ORACLES = {
    "cer_metric": f"WITH {TURNS} SELECT pair_id, {_cer_sql('truth', 'guess', 'metric')} AS cer FROM turns",
    "cer_eval": f"WITH {TURNS} SELECT pair_id, {_cer_sql('truth', 'guess', 'eval')} AS cer FROM turns",
    "btc_cer": f"WITH {TURNS} SELECT pair_id, {_cer_sql('truth', 'guess', 'metric')} AS cer FROM turns",
    "token_f1_set": f"WITH {TURNS} SELECT pair_id, {_set_f1_sql('truth', 'guess')} AS f1 FROM turns",
    "token_f1_multiset": f"WITH {TURNS}, {_multi_f1_sql('turns', 'truth', 'guess')} SELECT pair_id, f1 FROM multi",
    "classify_field_error": f"WITH {_MATCHED} SELECT pair_id, {_CLASS} AS error FROM pairs",
    "error_histogram": f"WITH {_MATCHED} SELECT {_CLASS} AS error, count(*) AS n FROM pairs GROUP BY 1",
    "error_cases": f"""WITH {_MATCHED}, m AS (SELECT pair_id, {_CLASS} AS product_error, {_cer_sql('gt_ocr_text', 'pred_ocr_text', 'eval')} AS ocr_cer, pred_ocr_text, gt_ocr_text, pred_product_name, gt_product_name FROM pairs)
SELECT * FROM m WHERE NOT (product_error IN ('correct', 'true_blank') AND ocr_cer <= 0.2)""",
    "composite_score": _composite_sql(ev.PHASE_2), "phase1_score": _composite_sql(ev.PHASE_1),
    "score_by_group": f"""WITH {_MATCHED} SELECT CASE WHEN pair_id % 3 = 0 THEN 'Public' ELSE 'Private' END AS usage, round_even(0.4::DOUBLE * avg({_set_f1_sql('gt_brand_name', 'pred_brand_name')}) + 0.35::DOUBLE * (1.0 - avg({_cer_sql('gt_ocr_text', 'pred_ocr_text', 'metric')})) + 0.25::DOUBLE * avg({_set_f1_sql('gt_product_name', 'pred_product_name')}), 4) AS score FROM pairs GROUP BY 1""",
    "product_metrics": f"""WITH {_MATCHED}, {_multi_f1_sql('pairs', _T, _G)}, m AS (SELECT {_CLASS} AS e, {_BLANK.format(_G)} AS gb, {_BLANK.format(_T)} AS tb, {_LINE.format(_G)} = {_LINE.format(_T)} AS x, {EVAL_KEY.format(_G)} = {EVAL_KEY.format(_T)} AS xn, f1 FROM pairs JOIN multi USING (pair_id))
SELECT count(*) AS "rows", avg(gb::INT) AS pred_blank_rate, avg(tb::INT) AS gt_blank_rate, avg((NOT gb)::INT) AS pred_fill_rate, avg((NOT tb)::INT) AS gt_fill_rate, avg(x::INT) AS exact_match, avg(xn::INT) AS exact_match_no_accent, avg(f1) AS token_f1_macro,
count(*) FILTER (e = 'false_fill')::DOUBLE / count(*) AS false_fill_rate_all, count(*) FILTER (e = 'miss')::DOUBLE / count(*) AS miss_rate_all, count(*) FILTER (e LIKE 'partial%' OR e LIKE 'wrong%')::DOUBLE / count(*) AS wrong_rate_all,
count(*) FILTER (e = 'false_fill')::DOUBLE / greatest(1, count(*) FILTER (tb)) AS false_fill_rate_on_blank_gt, count(*) FILTER (e = 'miss')::DOUBLE / greatest(1, count(*) FILTER (NOT tb)) AS miss_rate_on_nonblank_gt FROM m""",
    "ocr_metrics": f"""WITH {_MATCHED}, m AS (SELECT {_cer_sql('gt_ocr_text', 'pred_ocr_text', 'eval')} AS c, {_BLANK.format('pred_ocr_text')} AS gb, {_BLANK.format('gt_ocr_text')} AS tb FROM pairs)
SELECT count(*) AS ocr_rows, avg(gb::INT) AS ocr_pred_blank_rate, avg(tb::INT) AS ocr_gt_blank_rate, avg(c) AS cer_macro, 1.0 - avg(c) AS one_minus_cer_macro FROM m""",
    "eval_report": f"""WITH {_MATCHED}, m AS (SELECT {_CLASS} AS e, {_cer_sql('gt_ocr_text', 'pred_ocr_text', 'eval')} AS c, {_LINE.format(_G)} = {_LINE.format(_T)} AS x FROM pairs)
SELECT count(*) AS rows_pred, count(*) AS rows_gt, count(*) AS rows_overlap, avg(x::INT) AS exact_match, avg(c) AS cer_macro, count(*) FILTER (NOT (e IN ('correct', 'true_blank') AND c <= 0.2)) AS error_cases FROM m""",
    "id_set_diff": "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra, (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS repeated",
    "validate_submission": f"""WITH {_BROKEN}, n AS (SELECT (SELECT count(*) FROM b) AS rows_, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) - count(DISTINCT image_id) FROM b) AS repeated,
(SELECT count(*) FROM b FULL JOIN (SELECT doc_id FROM documents) d ON b.image_id = d.doc_id WHERE b.image_id IS NULL OR d.doc_id IS NULL) AS moved, (SELECT count(*) FROM b WHERE ocr_text IS NULL) AS nulls, (SELECT count(*) FROM b WHERE contains(ocr_text, chr(10))) AS breaks),
f AS (SELECT rows_, unnest([{{'type': 'bad_columns', 'count': 2, 'bad': true}}, {{'type': 'bad_row_count', 'count': rows_, 'bad': rows_ != expected}}, {{'type': 'duplicate_image_id', 'count': repeated, 'bad': repeated > 0}}, {{'type': 'image_id_order_mismatch', 'count': moved, 'bad': moved > 0}}, {{'type': 'null_cells', 'count': nulls, 'bad': nulls > 0}}, {{'type': 'newline_or_tab_cells', 'count': breaks, 'bad': breaks > 0}}]) AS e FROM n)
SELECT false AS ok, rows_ AS "rows", e."type" AS "type", e."count" AS "count" FROM f WHERE e.bad""",
    "catalog_completion": "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce('q' || l.quality, ' ') AS brand_name FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id",
    "manual_override": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'fixed' END AS brand_name FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0",
    "reindex_template": "SELECT d.doc_id, d.doc_id AS ord, coalesce(CAST(l.quality AS VARCHAR), '') AS q FROM documents d LEFT JOIN labels l USING (doc_id)",
    "fill_rates": f"WITH {TURNS}, {SUBMISSION} SELECT " + ", ".join(f"avg((trim(coalesce({c}, '')) != '')::INT) AS {c}_fill_rate" for c in ("ocr_text", "brand_name", "product_name")) + " FROM submission",
    "cleaned_submission": f"SELECT CAST(doc_id AS VARCHAR) AS image_id, {_LINE.format('text')} AS ocr_text, source AS brand_name, '' AS product_name FROM documents",
    "row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders",
    "page_of_items": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 5",
    "random_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= round_even((SELECT count(*) FROM documents) * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM documents",
    "group_holdout_split": f"""WITH {PARTS}, k AS (SELECT item_id, {EVAL_KEY.format('product_name')} AS norm_product_name FROM parts), g AS (SELECT DISTINCT norm_product_name FROM k WHERE norm_product_name != ''),
h AS (SELECT norm_product_name FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || norm_product_name)) AS r FROM g) WHERE r <= (SELECT greatest(1, round_even(count(*) * 0.2, 0)) FROM g))
SELECT item_id, norm_product_name, CASE WHEN norm_product_name IN (SELECT norm_product_name FROM h) THEN 'val' ELSE 'train' END AS split FROM k""",
    "latency_nearest_rank": """WITH r AS (SELECT event_type, list_sort(list(value)) AS a, avg(value) AS avg FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, avg, a[CAST(round_even(0.5::DOUBLE * (len(a) - 1), 0) AS BIGINT) + 1] AS p50, a[CAST(round_even(0.95::DOUBLE * (len(a) - 1), 0) AS BIGINT) + 1] AS p95 FROM r""",
}
