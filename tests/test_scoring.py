import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linewright.functions.similarity import char_error_rate, error_class, multiset_f1, token_f1
from linewright.operators import evaluate as ev
from linewright.operators import splits, submission
from linewright.operators.latency import nearest_rank

ITEMS = "image_id string, ocr_text string, brand_name string, product_name string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarities_against_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "nan", "a b", "đèn 😀", "tea tea milk"] + [" ".join(rng.choices(["tea", "Tea", "milk", "é", "x"], k=rng.randint(1, 6))) for _ in range(25)]
    pairs = [(a, b) for a in texts[:12] for b in texts[:12]] + [(rng.choice(texts), rng.choice(texts)) for _ in range(60)]
    t, g = F.col("t"), F.col("g")
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, t string, g string").select("k", char_error_rate(t, g), char_error_rate(t, g, "eval"), char_error_rate(t, g, "target"), token_f1(t, g), multiset_f1(t, g)).orderBy("k").collect()

    def rate(a, b, cap):
        if not a:
            return float(bool(b))
        r = distance(a, b) / len(a)
        return min(r, 1.0) if cap else r

    def f1(common, n, m):
        return 0.0 if not common else 2 * (common / n) * (common / m) / (common / n + common / m)

    blank = lambda s: "" if s.strip().lower() in ("nan", "none", "null") else s.strip()
    for (a, b), r in zip(pairs, got):
        a, b = a or "", b or ""
        assert math.isclose(r[1], rate(a.strip(), b.strip(), True)) and math.isclose(r[2], rate(a, b, False)) and math.isclose(r[3], rate(blank(a), blank(b), True))
        x, y = set(a.strip().lower().split()), set(b.strip().lower().split())
        assert math.isclose(r[4], 1.0 if not x and not y else f1(len(x & y), len(x), len(y)))
        fold = lambda s: [w for w in s.lower().replace("đ", "d").replace("è", "e").replace("é", "e").replace("😀", " ").split()]
        x, y = Counter(fold(a)), Counter(fold(b))
        assert math.isclose(r[5], 1.0 if not x and not y else f1(sum((x & y).values()), sum(x.values()), sum(y.values())))


@pytest.mark.parametrize("guess, truth, want", [("", "", "true_blank"), ("", "a", "miss"), ("a", "", "false_fill"), ("Á b", "a B", "correct"), ("a", "a b", "partial_too_short"), ("a b c", "a b", "partial_too_long"), ("a x", "a b", "wrong_partial_overlap"), ("x", "y", "wrong_no_overlap")])
def test_error_classes(spark, guess, truth, want):
    assert spark.range(1).select(error_class(F.lit(guess), F.lit(truth))).first()[0] == want


def test_scores(spark):
    one = spark.createDataFrame([("1", "tea x", "b", "p q")], ITEMS)
    blank = spark.createDataFrame([("1", "", "", "")], ITEMS)
    assert ev.score(one, one, "image_id") == ev.score(blank, blank, "image_id") == 1.0
    assert ev.score(one, blank, "image_id") == 0.0
    half = spark.createDataFrame([("1", "tea x", "b", "")], ITEMS)
    assert ev.score(one, half, "image_id") == 0.75 and ev.score(one, half, "image_id", ev.PHASE_1) == 0.4
    for bad in (one.unionByName(one), blank.withColumn("image_id", F.lit("2")), one.drop("brand_name"), one.withColumn("ocr_text", F.lit(1))):
        with pytest.raises(ev.VisibleError):
            ev.score(one, bad, "image_id")
    report, cases = ev.report(one, half, "image_id")
    assert report.first()["error_cases"]["count"] == cases.count() == 1
    with pytest.raises(ValueError):
        ev.report(one, half.unionByName(half), "image_id")


def test_each_fault_alone(spark):
    columns = ["image_id", "ocr_text", "ord"]
    kind = "image_id string, ocr_text string, ord long"
    good = [("a", "x", 0), ("b", "y", 1), ("c", "z", 2)]
    items = spark.createDataFrame(good, kind)
    faults = lambda rows, cols=columns[:2], df=None: [e["type"] for e in submission.check(df if df is not None else spark.createDataFrame(rows, kind), items, cols, order="ord").first()["errors"]]
    assert faults(good) == []
    assert faults(good, ["image_id", "text"]) == ["bad_columns"]
    assert faults([("b", "x", 0), ("a", "y", 1), ("c", "z", 2)]) == ["image_id_order_mismatch"]
    assert faults([("a", None, 0), *good[1:]]) == ["null_cells"]
    assert faults([("a", "x\ty", 0), *good[1:]]) == ["newline_or_tab_cells"]
    assert faults(good[:2]) == ["bad_row_count", "image_id_order_mismatch"]
    assert faults([*good[:2], ("b", "z", 2)]) == ["duplicate_image_id", "image_id_order_mismatch"]


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_splits(spark, n):
    df = spark.createDataFrame([(k, f"p{k % 7}" if k % 5 else "") for k in range(n)], "k long, product_name string")
    got = splits.random_split(df, "k", 0.5).collect()
    assert len(got) == n and sum(r["split"] == "val" for r in got) == round(n * 0.5)
    rows, held = splits.group_holdout(df, "k")
    held, rows = {r[0] for r in held.collect()}, rows.collect()
    assert len(rows) == n and all((r["norm_product_name"] in held) == (r["split"] == "val") for r in rows if r["product_name"])
    with pytest.raises(ValueError):
        splits.random_split(df, "k", 1.0)


@pytest.mark.parametrize("values", [[5.0], [1.0, 9.0], [1, 2, 3, 4, 5, 6.0], [7.0] * 9 + [1.0]])
def test_nearest_rank(spark, values):
    got = nearest_rank(spark.createDataFrame([("g", float(v)) for v in values], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    ordered = sorted(values)
    assert (got["p50"], got["p95"]) == tuple(ordered[round(p * (len(values) - 1))] for p in (0.5, 0.95))


def test_completion_numbers_and_overrides(spark):
    made, items = spark.createDataFrame([("a", "x"), ("z", "y")], "id string, v string"), spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in submission.completed(made, items, "id", ["v"]).collect()} == {("a", "x"), ("b", " "), ("z", "y")}
    assert {tuple(r) for r in submission.overridden(made, made.where("id = 'z'").withColumn("v", F.lit("new")), "id", ["v"]).collect()} == {("a", "x"), ("z", "new")}
    numbers = submission.numbered(spark.range(1000).withColumn("id", 999 - F.col("id")), "id").collect()
    assert all(r["id"] == r["ord"] for r in numbers)
