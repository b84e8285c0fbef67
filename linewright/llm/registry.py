"""The corpus operators' queries, and the SQL that must agree with them where SQL can say it."""

from __future__ import annotations

from . import ann, chat_format, decontaminate, html_extract, language_id, line_dedup, packing, quality, simhash, url_filter

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_approximate_nearest_neighbours": ann.op3_approximate_nearest_neighbours,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_language_id": language_id.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op10_url_filters": url_filter.op10_url_filters,
}

ORACLES = {
    "op9_chat_formatting": chat_format.OP9_SQL,
    "op10_url_filters": url_filter.OP10_SQL,
}
