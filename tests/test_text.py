import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from linewright.functions import features as fe
from linewright.functions import text as tx


def column(spark, values, *exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [tuple(r)[1:] for r in df.select("k", *exprs).orderBy("k").collect()]


def plain(s):
    s = " ".join((s or "").split())
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


def test_accents_of_all_latin_letters(spark):
    letters = [chr(c) for c in range(0xC0, 0x1F00) if unicodedata.category(chr(c))[0] == "L" and (c < 0x250 or 0x1E00 <= c)]
    got = [r[0] for r in column(spark, letters, tx.without_accents(F.col("t")))]
    assert got == [plain(c) for c in letters]


def test_keys(spark):
    rng = random.Random(2)
    values = [None, "", "  ", "Cột Đèn", "L'Oréal & Co.", "K2+D3", "a b\tc", "Straße-5", "été"] + ["".join(rng.choices("aB9 éđĐ+-&.!\t'ß", k=12)) for _ in range(60)]
    rule = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s+\-&.]+", " ", plain(s).lower())).strip()
    evaluation = lambda s: re.sub(r"[^a-z0-9]+", " ", plain(s).replace("đ", "d").replace("Đ", "D").lower()).strip()
    got = column(spark, values, tx.rule_key(F.col("t")), tx.eval_key(F.col("t")), tx.compact(F.col("t")), tx.compact_alnum(F.col("t")))
    for s, (r, e, c, a) in zip(values, got):
        assert r == rule(s) and e == evaluation(s) and c == rule(s).replace(" ", "") and a == re.sub("[^a-z0-9]", "", rule(s))


@pytest.mark.parametrize("raw, want", [("K2+D3", "K2 + D3"), ("SPF50 +", "SPF50+"), ("a / b - c", "a/b-c"), ("日本 tea 😀!", "tea"), ("é", "é"), (None, ""), ("  ", ""), ("50% (new) [x]: P/S, 1.5L", "50% (new) [x]: P/S, 1.5L")])
def test_recognised_line(spark, raw, want):
    assert column(spark, [raw], tx.recognised_line(F.col("t"))) == [(want,)]


def test_labels_and_repeats(spark):
    values = ["A + b;c,  A", "", None, "x X x y", "one"]
    got = column(spark, values, tx.split_labels(F.col("t")), tx.join_labels(tx.split_labels(F.col("t"))), tx.without_repeated_tokens(F.col("t")))
    assert [g[0] for g in got] == [["A", "b", "c", "A"], [], [], ["x X x y"], ["one"]]
    assert [g[1] for g in got] == ["A + b + c", "", "", "x X x y", "one"]
    assert got[3][2] == "x y"
    assert column(spark, ["Tea\r\ntea\n\nMilk"], tx.recognised_text(F.col("t"))) == [("Tea Milk",)]


@pytest.mark.parametrize("text, score, junk", [("good line", 0.449, True), ("good line", 0.45, False), ("a!", 0.9, True), ("ab", 0.9, False), ("F FE BA D C HY", 0.9, True), ("a1 bb cc dd ee ff gg word", 0.9, True), ("a1 bb cc dd ee word gooood heree", 0.9, False), ("", 1.0, True), ("ok then", None, False)])
def test_junk_lines(spark, text, score, junk):
    df = spark.createDataFrame([(text, score)], "t string, s double")
    assert df.select(fe.is_junk_line(F.col("t"), F.col("s"))).first()[0] is junk


def test_classes_of_accents_are_runs(spark):
    for letters, made in ((fe.ACCENTS, fe.ACCENT_CLASS), (fe.LOWER_ACCENTS, fe.LOWER_ACCENT_CLASS)):
        assert "&&" in made  # a class that lists its letters tests each of them at every character
        text = "".join(map(chr, range(0x20, 0x2100)))
        assert one_text(spark, text, F.length(F.regexp_replace("t", made, ""))) == len(text) - len(set(letters))
    assert len(fe.ACCENT_CLASS) < len(fe.ACCENTS) / 2
    plan = str(fe.text_features(F.col("t"), "router")["junk_count"]) + str(fe.text_features(F.col("t"))["accent_count"])
    assert "^0-9" not in plan and fe.ACCENTS not in plan


def one_text(spark, text, expr):
    return column(spark, [text], expr)[0][0]


def test_feature_profiles(spark):
    values = ["Trà Sữa 50+.", "", " x ", "nan", None]
    got = {p: [r[0] for r in column(spark, values, F.struct(*(v.cast("double").alias(k) for k, v in fe.text_features(F.col("t"), p).items())))] for p in fe.PROFILES}
    live, lcf, router = (got[p][0] for p in fe.PROFILES)
    assert live["upper_ratio"] == 2 / 6 and lcf["upper_ratio"] == 2 / 12 and router["upper_ratio"] == 2 / 6
    assert live["accent_count"] == lcf["accent_count"] == 2 and live["digit_count"] == 2 and live["has_plus"] == live["has_dot"] == 1
    assert [g["junk_ratio"] for g in got["live"]] == [0, 1, 0, 0, 1] and got["lcf"][1]["junk_ratio"] == 0
    assert [g["is_blank"] for g in got["lcf"]] == [0, 1, 0, 1, 1] and [g["is_blank_pred"] for g in got["router"]] == [0, 1, 0, 0, 1]
    assert got["router"][2]["text_len"] == 3 and got["live"][2]["text_len"] == 1
