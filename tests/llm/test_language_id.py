import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm.language_id import bucket_counts, fit, fold, predict

SCHEMA = "doc_id long, text string, lang string, score string"
PARTS = {"aa": ["tha", "ing", "er", "wh"], "bb": ["ung", "sch", "ß", "ü"], "cc": ["ción", "ñ", "ado", "ll"]}


def text_of(lang, rng):
    return " ".join("".join(rng.choices(PARTS[lang], k=3)).capitalize() for _ in range(rng.randint(2, 40)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(k, text_of(lang, rng), lang, "x") for k in range(600) for lang in [rng.choice(["aa", "aa", "bb", "cc"])]]
    return made + [(None, "tha ing", "aa", ""), (7001, None, "aa", ""), (7002, "", "bb", ""), (7003, "123 !? \n", "cc", ""), (7004, text_of("bb", rng), None, ""), (7005, text_of("bb", rng) * 500, "bb", "")] + made[:3]


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, fold(F.col("doc_id"), 5) != 0)
    got = predict(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(d, lang) for d, t, lang, _ in rows if d is not None and d < 7000]
    assert np.mean([by[d]["lang_pred"] == lang for d, lang in held]) > 0.97
    assert [by[d]["lang_pred"] for d in (7001, 7002, 7003, 7004, 7005)] == ["und", "und", "und", "bb", "bb"]


def test_same_answer_twice(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, predict(docs.repartition(k), fit(docs.repartition(k), F.lit(True))).select("doc_id", "lang_pred", "score").collect()), key=repr) for k in (2, 5))
    assert a == b


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "")], SCHEMA)
    assert [r["lang_pred"] for r in predict(docs, fit(docs, F.lit(True))).collect()] == ["und"]
    assert predict(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_counts_see_letters_alone():
    assert bucket_counts("12 .,") is None and bucket_counts("") is None
    assert (bucket_counts("Ab, c!") == bucket_counts("  ab 9 C")).all()
    assert bucket_counts("ab").sum() == 4 + 3 + 2


def test_predictions_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, F.lit(True))
    for row, text in zip(predict(docs.coalesce(1), model).collect(), [r[1] for r in rows]):
        counts = bucket_counts(text) if text else None
        if counts is None:
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        logits = []
        for k in range(len(model.languages)):
            mean = sum(counts[b] * model.weights[b, k] for b in np.flatnonzero(counts)) / counts.sum()
            logits.append((mean + model.bias[k]) / model.temperature)
        parts = [np.exp(x - max(logits)) for x in logits]
        best = max(range(len(parts)), key=parts.__getitem__)
        assert row["lang_pred"] == model.languages[best] and np.isclose(row["score"], parts[best] / sum(parts))
        assert row["rejected"] == (row["score"] < model.reject_below)


def test_ties_go_to_the_first_language_and_rare_ones_are_bounded(spark):
    rows = [(k, "same words", lang, "") for k, lang in enumerate(["bb", "aa"] * 30 + ["cc"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, F.lit(True), languages=2)
    assert model.languages == ["aa", "bb"]
    model.weights[:], model.bias[:] = 0, 0
    assert {r["lang_pred"] for r in predict(docs, model).collect()} == {"aa"}
