from pyspark.sql import functions as F

from linewright.operators import extract as ex
from linewright.operators import ml
from linewright.plans import extraction

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_one_file_are_dealt_out(spark):
    assert "Repartition " in plan(extraction._evidence(spark, SF))  # a file is one task otherwise, whatever its size
    df = spark.createDataFrame([(1, "milk tea")], "id long, ocr_text string")
    assert "Repartition " in plan(ml.ProductModel().predict(df))


def test_texts_that_are_evidence_too_are_read_once(spark):
    rules = spark.createDataFrame([(0, "Round Lab", 0, "round lab", "roundlab"), (1, "Lab", 0, "lab", "lab")], "canonical_ord long, canonical string, alias_ord long, alias_norm string, alias_compact string").collect()
    df = spark.createDataFrame([(1, "round lab serum", "round lab serum"), (2, "round lab", "serum"), (3, None, None), (4, "roundlab", None)], "id long, ocr_text string, evidence_text string")
    got = {r["id"]: r["brand_v5_top"] for r in ex.alias_brand(df, rules).collect()}
    assert got[3] == "" and all(got[k].startswith("Round Lab:") for k in (1, 2, 4)) and got[1] != got[2]
    held = spark.createDataFrame([("a round lab", "aroundlab"), (None, None), ("x", "x")], "n string, p string").select(ex.held_rules(F.col("n"), F.col("p"), [{"rule_rank": 0, "canonical": "Lab", "alias_norm": "lab", "alias_compact": "lab"}]).alias("h")).collect()
    assert [[e["canonical"] for e in r["h"]] for r in held] == [["Lab"], [], []]
