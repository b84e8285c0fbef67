"""Scores of submissions against truths: the official composites, diagnostic metrics, error cases and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import PARTLY_WRONG, char_error_rate, error_class, multiset_f1, token_f1
from ..functions.text import eval_key, null_to_empty, single_line

PHASE_2 = {"brand": 0.4, "ocr": 0.35, "product": 0.25}
PHASE_1 = {"brand": 0.0, "ocr": 0.4, "product": 0.6}


class VisibleError(ValueError):
    """A fault of the submission that its sender may see."""


def id_differences(truth: DataFrame, guess: DataFrame, key: str) -> DataFrame:
    """One row: missing and extra ids, and ids that the submission repeats. One pass over both id columns."""
    both = truth.select(key, F.lit(1).alias("t"), F.lit(0).alias("g")).unionByName(guess.select(key, F.lit(0).alias("t"), F.lit(1).alias("g")))
    ids = both.groupBy(key).agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    return ids.agg(F.count_if(F.col("g") == 0).alias("missing"), F.count_if(F.col("t") == 0).alias("extra"), F.coalesce(F.sum(F.greatest(F.col("g") - 1, F.lit(0))), F.lit(0)).alias("repeated"))


def matched(truth: DataFrame, guess: DataFrame, key: str, fields: tuple[str, ...] = ("ocr_text", "brand_name", "product_name")) -> DataFrame:
    """key, gt_* and pred_*; fields that either side lacks are empty."""
    side = lambda df, p: df.select(key, *((null_to_empty(F.col(c)) if c in df.columns else F.lit("")).alias(f"{p}_{c}") for c in fields))
    return side(truth, "gt").join(side(guess, "pred"), key)


def composite(pairs: DataFrame, weights: dict[str, float] = PHASE_2) -> DataFrame:
    """brand_f1, product_f1, cer and score of matched pairs, in one aggregation."""
    means = pairs.agg(F.avg(token_f1(F.col("gt_brand_name"), F.col("pred_brand_name"))).alias("brand_f1"), F.avg(token_f1(F.col("gt_product_name"), F.col("pred_product_name"))).alias("product_f1"), F.avg(char_error_rate(F.col("gt_ocr_text"), F.col("pred_ocr_text"))).alias("cer"))
    total = weights["brand"] * F.col("brand_f1") + weights["ocr"] * (1.0 - F.col("cer")) + weights["product"] * F.col("product_f1")
    return means.withColumn("score", F.bround(total, 4))


def score(truth: DataFrame, guess: DataFrame, key: str, weights: dict[str, float] = PHASE_2) -> float:
    """The composite of a submission, after all checks of ids and columns."""
    for name, df in (("solution", truth), ("submission", guess)):
        if absent := [c for c in (key, "ocr_text", "brand_name", "product_name") if c not in df.columns]:
            raise VisibleError(f"{name} lacks columns {absent}")
        if wrong := [c for c in ("ocr_text", "brand_name", "product_name") if dict(df.dtypes)[c] != "string"]:
            raise VisibleError(f"{name} columns {wrong} must be text")
    ids = id_differences(truth, guess, key).first()
    if ids["repeated"]:
        raise VisibleError("the submission repeats an id")
    if ids["missing"] or ids["extra"]:
        raise VisibleError(f"ids must match: {ids['missing']} missing, {ids['extra']} extra")
    value = composite(matched(truth, guess, key), weights).first()["score"]
    if value is None or value != value:
        raise VisibleError("no finite score")
    return value


def score_by(truth: DataFrame, guess: DataFrame, key: str, group: str, weights: dict[str, float] = PHASE_2) -> DataFrame:
    """The composite within each group of the truth rows."""
    pairs = matched(truth, guess, key).join(truth.select(key, group), key)
    total = weights["brand"] * F.avg(token_f1(F.col("gt_brand_name"), F.col("pred_brand_name"))) + weights["ocr"] * (1.0 - F.avg(char_error_rate(F.col("gt_ocr_text"), F.col("pred_ocr_text")))) + weights["product"] * F.avg(token_f1(F.col("gt_product_name"), F.col("pred_product_name")))
    return pairs.groupBy(group).agg(F.bround(total, 4).alias("score"))


def product_metrics(pairs: DataFrame) -> DataFrame:
    g, t = F.col("pred_product_name"), F.col("gt_product_name")
    marked = pairs.select(error_class(g, t).alias("e"), (eval_key(g) == "").alias("gb"), (eval_key(t) == "").alias("tb"), (single_line(g) == single_line(t)).alias("x"), (eval_key(g) == eval_key(t)).alias("xn"), multiset_f1(t, g).alias("f"))
    n, share = F.count(F.lit(1)), lambda c: F.avg(c.cast("double"))
    bad = lambda *names: F.count_if(F.col("e").isin(*names))
    return marked.agg(
        n.alias("rows"), share(F.col("gb")).alias("pred_blank_rate"), share(F.col("tb")).alias("gt_blank_rate"), share(~F.col("gb")).alias("pred_fill_rate"), share(~F.col("tb")).alias("gt_fill_rate"),
        share(F.col("x")).alias("exact_match"), share(F.col("xn")).alias("exact_match_no_accent"), F.avg("f").alias("token_f1_macro"), (bad("false_fill") / n).alias("false_fill_rate_all"), (bad("miss") / n).alias("miss_rate_all"), (bad(*PARTLY_WRONG) / n).alias("wrong_rate_all"),
        (bad("false_fill") / F.greatest(F.lit(1), F.count_if("tb"))).alias("false_fill_rate_on_blank_gt"), (bad("miss") / F.greatest(F.lit(1), F.count_if(~F.col("tb")))).alias("miss_rate_on_nonblank_gt"),
    )


def ocr_metrics(pairs: DataFrame) -> DataFrame:
    cer = F.avg(char_error_rate(F.col("gt_ocr_text"), F.col("pred_ocr_text"), "eval"))
    blank = lambda c: F.avg((eval_key(F.col(c)) == "").cast("double"))
    return pairs.agg(F.count(F.lit(1)).alias("ocr_rows"), blank("pred_ocr_text").alias("ocr_pred_blank_rate"), blank("gt_ocr_text").alias("ocr_gt_blank_rate"), cer.alias("cer_macro"), (1.0 - cer).alias("one_minus_cer_macro"))


def error_cases(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs whose product is wrong or whose text is more than a fifth off."""
    marked = pairs.select(key, error_class(F.col("pred_product_name"), F.col("gt_product_name")).alias("product_error"), char_error_rate(F.col("gt_ocr_text"), F.col("pred_ocr_text"), "eval").alias("ocr_cer"), "pred_ocr_text", "gt_ocr_text", "pred_product_name", "gt_product_name")
    return marked.where(~(F.col("product_error").isin("correct", "true_blank") & (F.col("ocr_cer") <= 0.2)))


def report(truth: DataFrame, guess: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A row of counts and nested metrics, and the error cases; both sides must have each id once."""
    for df in (truth, guess):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError("ids must be unique on both sides")
    pairs = matched(truth, guess, key)
    if not pairs.limit(1).count():
        raise ValueError("no id is on both sides")
    product, ocr, cases = product_metrics(pairs), ocr_metrics(pairs), error_cases(pairs, key)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = count(guess, "rows_pred").join(count(truth, "rows_gt")).join(count(pairs, "rows_overlap"))  # one row each
    nested = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    return rows.join(nested(product, "product")).join(nested(ocr, "ocr")).join(nested(count(cases, "count"), "error_cases")), cases


def error_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(error_class(F.col("pred_product_name"), F.col("gt_product_name")).alias("error")).agg(F.count(F.lit(1)).alias("n"))
