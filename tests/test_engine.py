import json

from pyspark.sql import functions as F

from linewright.operators.vocabulary import Rule
from linewright.plans.engine import Engine, feature_lists, text_columns, with_evidence
from linewright.sources.recognise import recognised, recognised_lines


def engine(spark):
    labels = spark.createDataFrame([("Bioderma", "Green Tea Serum"), ("Eucerin", "Rice Cream")], "brand_name string, product_name string")
    return Engine.from_labels(labels, brand_rules=[Rule("Curated", ("handmade",))])


def test_texts(spark):
    df = spark.createDataFrame([("a", "bioderma green tea serum"), ("b", "handmade soap"), ("c", ""), ("d", "nothing")], "image_id string, ocr_text string")
    got = {r["image_id"]: (r["brand_name"], r["product_name"]) for r in engine(spark).predict_text(df, "image_id").collect()}
    assert got == {"a": ("Bioderma", "Green Tea Serum"), "b": ("Curated", ""), "c": ("", ""), "d": ("", "")}


def test_images_to_submission(spark):
    def make():
        def read(data):
            if data == b"bad":
                raise ValueError("unreadable")
            return json.dumps({"rec_texts": data.decode().split("|"), "rec_scores": [0.9, 0.9], "rec_polys": [[[0, 0], [9, 0], [9, 9], [0, 9]], [[0, 20], [9, 20], [9, 29], [0, 29]]]})

        return read

    images = spark.createDataFrame([("a", bytearray(b"Eucerin|Rice Cream")), ("b", bytearray(b"bad"))], "image_id string, content binary")
    found = recognised(images, make)
    assert {r["image_id"]: r["error"] for r in found.collect()} == {"a": None, "b": "ValueError('unreadable')"}
    items = spark.createDataFrame([("a",), ("b",)], "image_id string")
    got = {tuple(r) for r in engine(spark).submission(recognised_lines(found, width=10, height=30), items).collect()}
    assert got == {("a", "Eucerin Rice Cream", "Eucerin", "Rice Cream"), ("b", " ", " ", " ")}


def test_columns_and_bundles(spark):
    df = spark.createDataFrame([("a", "x", None, "n")], "image_id string, ocr_raw string, variant_2 string, other string")
    assert text_columns(df, "image_id") == ["ocr_raw", "variant_2"]
    assert with_evidence(df, "image_id").first()["evidence_text"] == "x || "
    assert feature_lists({"cat_cols": ["a", "a"], "numeric_cols": ["b"]}) == (["a"], ["b"], ["a", "b"])
    assert len(feature_lists({})[1]) == 35
    assert with_evidence(df.withColumn("evidence_text", F.lit("e")), "image_id").first()["evidence_text"] == "e"


def test_submissions_are_written_only_if_sound(spark, tmp_path):
    import pytest

    from linewright.operators import submission as sub

    items = spark.createDataFrame([("a", 0), ("b", 1)], "image_id string, n int")
    good = spark.createDataFrame([("b", "two\nlines", None, "p", 1), ("a", "x", "y", None, 0)], "image_id string, ocr_text string, brand_name string, product_name string, n int")
    assert sub.save(good, items, f"{tmp_path}/good", order="n")["ok"]
    got = spark.read.option("header", True).csv(f"{tmp_path}/good").fillna("").collect()
    assert [tuple(r) for r in got] == [("a", "x", "y", ""), ("b", "two lines", "", "p")]
    with pytest.raises(ValueError, match="duplicate_image_id"):
        sub.save(good.unionByName(good), items, f"{tmp_path}/bad", order="n")
    assert not (tmp_path / "bad").exists()
    assert {tuple(r) for r in sub.broken_cells(good).collect()} == {("ocr_text", 1)}
    assert sub.result_rows(good, "phase1").columns == sub.PHASES["phase1"]


def test_model_bundles_fall_back_to_none(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    from linewright.sources import models

    path = f"file://{tmp_path}/bundle"
    assert models.bundle_bytes(spark, path) == 0
    models.save_bundle(path, {"v": VectorAssembler(inputCols=["n"], outputCol="o")})
    (tmp_path / "bundle" / "broken").mkdir()
    found = models.load_bundle(spark, path, ["v", "broken", "absent"])
    assert found["v"] is models.load_model(spark, path, "v") and found["broken"] is found["absent"] is None
    assert found["v"].transform(spark.range(3).withColumnRenamed("id", "n")).count() == 3 and models.bundle_bytes(spark, path) > 0
