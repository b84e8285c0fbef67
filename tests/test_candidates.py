"""Candidates made in columns, against crops and policies made of rows."""

import random

from pyspark.sql import functions as F

from linewright.operators import candidates as cd
from linewright.operators import lines as ln


def some_lines(spark):
    rng = random.Random(5)
    words = ["Sữa", "sữa", "milk tea", "50 .", "a+b", "NONE", "", "  ", "long line of words", "K2"]
    rows = [(k, i, i, rng.choice(words), rng.choice([None, 0.5, 0.71875, 0.84375, 0.875]), rng.choice([None, 0.0, 0.125, 0.25, 0.5])) for k in range(40) for i in range(rng.choice([1, 2, 3, 9, 20]))]
    return spark.createDataFrame(rows, "doc_id long, line_idx long, ord long, line_text string, line_score double, area_ratio double").repartition(3).cache()


def test_columns_agree_with_rows(spark):
    df = some_lines(spark)
    kept = ln.joined_text(ln.policy_lines(ln.crop_lines(df, "doc_id"), ["doc_id", "variant"]), ["doc_id", "variant", "policy"]).where("ocr_text != ''")
    shown = ["ocr_text", "num_lines", "avg_line_score", "median_line_score", "avg_area_ratio"]
    want = {(r["doc_id"], f"line::{r['variant']}::{r['policy']}", *(r[c] for c in shown)) for r in kept.collect()}
    merged = ln.joined_text(ln.merged_lines(ln.crop_lines(df, "doc_id"), "doc_id"), ["doc_id", "merge"])
    want |= {(r["doc_id"], f"merge::{r['merge']}::score_ge_085", *(r[c] for c in shown)) for r in merged.collect()}
    made = cd.candidates(df, "doc_id", merges=True)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()  # one exchange of lines and no sorting of their multiples
    got = {(r["doc_id"], r["candidate_name"], *(r[c] for c in shown)) for r in made.where("candidate_type != 'existing_variant'").collect()}
    assert not sorted(got - want)[:3] and not sorted(want - got)[:3]


def test_sums_over_lines_are_features_of_texts(spark):
    df = some_lines(spark)
    for profile in ("live", "lcf"):
        found = cd.Candidates.of(df, "doc_id", merges=True, profile=profile).rows()
        want = cd.with_features(cd.candidates(df, "doc_id", merges=True), "doc_id", profile)
        names = ["doc_id", "candidate_name", *(c for c in cd.NUMERIC if c in want.columns)]
        assert found.select(*names).exceptAll(want.select(*names)).count() == 0 and found.count() == want.count()
    best = cd.choose(cd.rank_features(cd.candidates(df, "doc_id")), "doc_id", keep=["candidate_name", "ocr_text", "rank_score"])
    assert cd.Candidates.of(df, "doc_id").chosen().select(*best.columns).exceptAll(best).count() == 0
