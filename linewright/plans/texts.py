"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fe
from ..functions import text as tx
from ..operators.lines import joined_text, record_text
from .adapters import EVAL_KEY, LINES, PARTS, RULE_KEY, lines, part_labels, table

ACC, LOW = fe.ACCENTS, fe.LOWER_ACCENTS
CLEAN = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
TRIM = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


def n_of(text: str, pattern: str) -> str:
    """How many characters of a class a text has."""
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


def lines_scan_clean(spark, sf):
    return lines(spark, sf).drop("ord")


def norm_key_rule(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.rule_key(F.col("text")).alias("norm"))


def norm_key_eval(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.eval_key(F.col("text")).alias("norm"))


def compact_forms(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.compact(t).alias("packed"), tx.compact_alnum(t).alias("packed_alnum"))


def ordered_line_dedup(spark, sf):
    return joined_text(lines(spark, sf), ["doc_id"])


def record_text_query(spark, sf):
    return record_text(lines(spark, sf), ["doc_id"])


def consecutive_token_dedup(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.without_repeated_tokens(F.col("text")).alias("once"))


def label_splitting(spark, sf):
    p = part_labels(spark, sf)
    return p.select("item_id", F.array_join(tx.split_labels(F.col("product_name")), "|").alias("labels"), tx.join_labels(tx.split_labels(F.concat_ws(";", "product_name", "product_name", "brand_name"))).alias("joined"))


def cleaner_normalize_line(spark, sf):
    return lines(spark, sf).select("doc_id", "line_idx", tx.recognised_line(F.col("line_text")).alias("cleaned"))


def _features(profile):
    def query(spark, sf):
        docs = table(spark, sf, "documents").select("doc_id", "text")
        made = fe.with_text_features(docs, "text", profile)
        return made.select("doc_id", *(F.col(k).cast("double").alias(k) for k in sorted(set(made.columns) - set(docs.columns))))

    return query


def _features_sql(profile):
    s = {"live": CLEAN, "lcf": TRIM, "router": "coalesce({}, '')"}[profile].format("text")
    low, div, by = ("s", "n", "alpha") if profile != "lcf" else ("s", "greatest(n, 1)", "greatest(n, 1)")
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"
    accents = f"[{ACC}]" if profile != "lcf" else "[À-ỹ]"
    junk = {"live": f"CASE WHEN s = '' THEN 1 ELSE 1 - {n_of('s', r'[\p{L}\p{N}\sẠỹ+\-/&%.,:()]')} / n END", "lcf": f"CASE WHEN s = '' THEN 0 ELSE 1 - {n_of('s', r'[\p{L}\p{N}\sÀ-ỹ]')} / n END", "router": ratio(n_of("s", r"[^0-9A-Za-zÀ-ỹ\s.,\-+/:%&()]"), "n")}[profile]
    cols = {"digit_count": "digit", "alpha_count": "alpha", "upper_count": "upper", "accent_count": "accent", "digit_ratio": ratio("digit", div), "alpha_ratio": ratio("alpha", div), "upper_ratio": ratio("upper", by), "accent_ratio": ratio("accent", by), "word_count": "words", "junk_ratio": junk, "text_len": "n"}
    if profile == "router":
        cols |= {"line_count_text": r"len(list_filter(regexp_split_to_array(s, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', '', 'g')) != ''))", "space_count": n_of("s", r"\s"), "junk_count": n_of("s", r"[^0-9A-Za-zÀ-ỹ\s.,\-+/:%&()]"), "avg_word_len": ratio("n", "words"), "is_blank_pred": "(words = 0)::INT"}
    else:
        cols |= {"char_count": "n", "has_digit": "(digit > 0)::INT", "has_accent": "(accent > 0)::INT", "has_dot": "contains(s, '.')::INT", "has_plus": "contains(s, '+')::INT", "is_blank": "(s = '')::INT" if profile == "live" else "(lower(s) IN ('', 'none', 'nan', 'null'))::INT"}
    return rf"""WITH t AS (SELECT doc_id, {s} AS s FROM documents),
f AS (SELECT doc_id, s, length(s)::DOUBLE AS n, {n_of('s', r'\p{L}')}::DOUBLE AS alpha, {n_of('s', r'\p{Nd}')}::DOUBLE AS digit, {n_of('s', r'\p{Lu}')}::DOUBLE AS upper, {n_of('s', accents)}::DOUBLE AS accent, len(regexp_extract_all(s, '\S+'))::DOUBLE AS words FROM t)
SELECT doc_id, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in sorted(cols.items()))} FROM f"""


def junk_line_filter(spark, sf):
    return lines(spark, sf).select("doc_id", "line_idx", fe.is_junk_line(F.col("line_text"), F.col("line_score")).alias("junk"))


QUERIES = {
    "lines_scan_clean": lines_scan_clean, "norm_key_rule": norm_key_rule, "norm_key_eval": norm_key_eval, "compact_forms": compact_forms, "ordered_line_dedup": ordered_line_dedup, "record_text": record_text_query,
    "consecutive_token_dedup": consecutive_token_dedup, "label_splitting": label_splitting, "cleaner_normalize_line": cleaner_normalize_line, "junk_line_filter": junk_line_filter,
} | {f"text_features_{p}": _features(p) for p in fe.PROFILES}

_STATS = """count(*) FILTER (t != '') AS num_lines, coalesce(avg(line_score), 0) AS avg_line_score, coalesce(median(line_score), 0) AS median_line_score, coalesce(avg(area_ratio) FILTER (area_ratio > 0), 0) AS avg_area_ratio"""
ORACLES = {
    "lines_scan_clean": f"WITH {LINES} SELECT * EXCLUDE (ord) FROM lines",
    "norm_key_rule": f"SELECT doc_id, {RULE_KEY.format('text')} AS norm FROM documents",
    "norm_key_eval": f"SELECT doc_id, {EVAL_KEY.format('text')} AS norm FROM documents",
    "compact_forms": rf"SELECT conv_id, turn, regexp_replace({RULE_KEY.format('text')}, '\s+', '', 'g') AS packed, regexp_replace({RULE_KEY.format('text')}, '[^a-z0-9]+', '', 'g') AS packed_alnum FROM conversations",
    "ordered_line_dedup": f"""WITH {LINES}, c AS (SELECT *, {CLEAN.format('line_text')} AS t FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY ord) AS k FROM c)
SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (k = 1 AND t != ''), '') AS ocr_text, {_STATS} FROM r GROUP BY doc_id""",
    "record_text": f"WITH {LINES} SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line_idx) AS text, avg(line_score) AS avg_score FROM lines GROUP BY doc_id",
    "consecutive_token_dedup": f"""WITH t AS (SELECT conv_id, turn, string_split({CLEAN.format('text')}, ' ') AS a FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: i = 1 OR lower(x) != lower(a[i - 1])), ' ') AS once FROM t""",
    "label_splitting": rf"""WITH {PARTS}, s AS (SELECT item_id, brand_name, list_filter(list_transform(regexp_split_to_array(product_name, '\s*\+\s*|;|,'), lambda x: trim(x)), lambda x: x != '') AS labels FROM parts)
SELECT item_id, array_to_string(labels, '|') AS labels, CASE WHEN len(labels) = 2 AND lower(labels[1]) != lower(labels[2]) THEN labels[1] || ' + ' || labels[2] ELSE labels[1] END || CASE WHEN list_contains(list_transform(labels, lambda x: lower(x)), lower(brand_name)) THEN '' ELSE ' + ' || brand_name END AS joined FROM s""",
    "cleaner_normalize_line": rf"""WITH {LINES}, a AS (SELECT doc_id, line_idx, regexp_replace(regexp_replace(line_text, '[\p{{C}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}\x{{1F300}}-\x{{1FAFF}}]', ' ', 'g'), '[^\p{{L}}\p{{N}}\s+\-/%.,:&()\[\]]', ' ', 'g') AS s FROM lines),
b AS (SELECT doc_id, line_idx, regexp_replace(regexp_replace({CLEAN.format('s')}, '\s*/\s*', '/', 'g'), '\s*-\s*', '-', 'g') AS s FROM a),
c AS (SELECT doc_id, line_idx, regexp_replace(regexp_replace(s, '([A-Za-zÀ-ỹ0-9])\s*\+(\s|$)', '\1+\2', 'g'), '([A-Za-zÀ-ỹ0-9])\s*\+\s*([A-Za-zÀ-ỹ0-9])', '\1 + \2', 'g') AS s FROM b)
SELECT doc_id, line_idx, {CLEAN.format('s')} AS cleaned FROM c""",
    "junk_line_filter": rf"""WITH {LINES}, t AS (SELECT doc_id, line_idx, line_score, {TRIM.format('line_text')} AS s FROM lines),
k AS (SELECT *, regexp_extract_all(s, '[a-zA-ZÀ-ỹĐđ0-9]+') AS a, {n_of('s', '[a-zA-ZÀ-ỹĐđ0-9]')} AS good FROM t),
c AS (SELECT *, len(a) AS n, len(list_filter(a, lambda x: length(x) <= 2)) AS short, len(list_filter(a, lambda x: length(x) <= 3 AND x = upper(x) AND x != lower(x))) AS cap, len(list_filter(a, lambda x: length(x) >= 4 OR regexp_matches(x, '[{LOW}]'))) AS meaning FROM k)
SELECT doc_id, line_idx, (s = '' OR line_score < 0.45 OR good < 2 OR (n >= 6 AND short::DOUBLE / n >= 0.45 AND cap::DOUBLE / n >= 0.4) OR (n >= 8 AND meaning <= 2)) AS junk FROM c""",
} | {f"text_features_{p}": _features_sql(p) for p in fe.PROFILES}
