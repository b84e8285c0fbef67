import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.functions.text import compact, compact_alnum, rule_key
from linewright.operators import candidates as cd
from linewright.operators import extract as ex
from linewright.operators import images, lines, ml, ocr_json
from linewright.operators import vocabulary as vc
from linewright.operators.vocabulary import Rule
from linewright.sources import tables
from linewright.streaming import extract as stream


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def gazetteer(spark, brands=(), products=()):
    df = spark.createDataFrame([(b, "") for b in brands] + [("", p) for p in products] or [("", "")], "brand_name string, product_name string")
    return vc.collected(vc.brand_gazetteer(df)), vc.collected(vc.product_gazetteer(df))


def rulebase(spark, text, brands, products, rules=(), suppressed=None):
    r = ex.rulebase(spark.createDataFrame([(text,)], "evidence_text string"), *gazetteer(spark, brands, products), list(rules), suppressed).first()
    return r["brand_v3"], r["product_v3"]


def test_gazetteers(spark):
    brands, products = gazetteer(spark, ["Fresh Lady + Dove", "sale", "x", "DOVE"], ["Green Tea; Green Tea", "green tea", "60", "a b", "Milk"])
    assert sorted(b["norm"] for b in brands) == ["dove", "fresh lady"]
    assert [(p["product"], p["freq"]) for p in products] == [("Green Tea", 2)]


def test_rulebase(spark):
    assert rulebase(spark, "buy freshlady and dove!", ["Fresh Lady", "Dove"], []) == ("Fresh Lady + Dove", "")
    assert rulebase(spark, "dovetail", ["Dove"], [])[0] == ""
    assert rulebase(spark, "green tea roll extra, milk candy, rice cake, soy sauce", [], ["Green Tea", "Green Tea Roll", "Milk Candy", "Rice Cake", "Soy Sauce"])[1].count("+") == 2
    assert rulebase(spark, "green tea roll", [], ["Green Tea", "Green Tea Roll"]) == ("", "Green Tea Roll")
    rules = [Rule("Tin Box", (r"\btin\b",)), Rule("Old Tin", (r"\bold\s*tin\b",))]
    assert rulebase(spark, "old tin", [], [], rules)[1] == "Old Tin + Tin Box"
    assert rulebase(spark, "old tin", [], [], rules, {"Tin Box": ("Old Tin",)})[1] == "Old Tin"


def test_first_rule_wins(spark):
    rules = [Rule("Milo", ("milo",)), Rule("Nestle", ("nestle milo", "nestle"), lines=("gold",))]
    assert one(spark, "Nestle Milo", lambda c: ex.first_rule(c, rules)) == "Milo"
    assert tuple(one(spark, "NESTLE gold", lambda c: ex.baseline_product(c, rules))) == ("Nestle", "Nestle Gold")
    assert tuple(one(spark, "none", lambda c: ex.baseline_product(c, rules))) == ("", "")


def curated(spark, text, brand="", rules=(Rule("Round Lab", ("round lab",)), Rule("Lab", ("lab",)))):
    df = spark.createDataFrame([(text, text, brand, "")], "ocr_text string, evidence_text string, brand_name string, product_name string")
    return ex.curated_fill(df, ex.rule_rows(list(rules), spark), []).first()["brand_name"]


def test_curated_rules_fill_blanks_alone(spark):
    assert curated(spark, "the round-lab toner") == curated(spark, "the roundlab toner") == "Round Lab"
    assert curated(spark, "lab-made") == "Lab"
    assert curated(spark, "round lab", brand="Mine") == "Mine"
    assert curated(spark, "slab") == ""


def brand_of(spark, text, aliases, margin=0.5):
    rows = [{"canonical_ord": k, "canonical": c, "alias_ord": j, "alias": a} for k, (c, names) in enumerate(aliases) for j, a in enumerate(names)]
    table = vc.collected(vc.alias_table(spark.createDataFrame(rows, "canonical_ord long, canonical string, alias_ord long, alias string")))
    r = ex.alias_brand(spark.createDataFrame([(text, text)], "ocr_text string, evidence_text string"), table, margin=margin).first()
    return r["brand_v5"], r["brand_v5_score"]


@pytest.mark.parametrize("prefix, score", [("", 7.05), ("x" * 39 + " ", 7.05), ("x" * 40 + " ", 6.55), ("x" * 100 + " ", 6.05)])
def test_alias_positions(spark, prefix, score):
    assert brand_of(spark, prefix + "bioderma serum", [("Bioderma", ["bioderma"])]) == ("Bioderma", score)


def test_alias_margin_and_short_aliases(spark):
    both = [("Bioderma", ["bioderma"]), ("Eucerin", ["eucerin"])]
    assert brand_of(spark, "bioderma eucerin", both)[0] == "" and brand_of(spark, "bioderma eucerin", both, margin=0.0)[0] == "Bioderma"
    assert brand_of(spark, "ohu cream", [("Ohu", ["ohu"])]) == ("Ohu", 5.75) and brand_of(spark, "ohu", [("Ohu", ["ohu"])]) == ("", 0.0)
    assert brand_of(spark, "nothing", both) == ("", 0.0)


def phrases(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, ocr_text string")
    return {r["phrase"]: (r["source"], r["rank"], r["score"]) for r in ex.phrase_candidates(df, "id").collect()}


def test_phrases_are_judged_once_for_a_segment_and_dealt_out(spark):
    df = spark.createDataFrame([(k, f"body scrub || fresh serum {'gold' if k % 2 else 'mild'}") for k in range(40)], "id long, ocr_text string").coalesce(1)
    found = ex.phrase_candidates(df, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " in plan and plan.index("Aggregate") > plan.index("Repartition ")  # different segments first, then tasks of their own
    rows = found.collect()
    assert sorted((r["phrase"], r["rank"], r["score"]) for r in rows if r["id"] == 7) == sorted((r["phrase"], r["rank"], r["score"]) for r in rows if r["id"] == 39)
    assert {r["id"] for r in rows} == set(range(40)) and len(rows) == len({(r["id"], r["norm"]) for r in rows})


def test_phrase_scores(spark):
    assert phrases(spark, "body scrub")["body scrub"] == (0, 0, 6.8)
    assert phrases(spark, "dozen toner mask")["toner mask"][2] == 6.3  # a window at the first segment reaches the threshold exactly
    assert phrases(spark, "plain words alone") == {}
    late = "aaa; bbb; ccc; ddd; eee; fff; ggg; body scrub"
    df = spark.createDataFrame([(1, "body scrub"), (7, late), (8, "zzz; " + late)], "id int, ocr_text string")
    assert {r["id"]: r["product_v4"] for r in ex.best_phrase(df, "id").collect()} == {1: "body scrub", 7: "body scrub", 8: ""}


def line_rows(texts, scores=None, areas=None):
    return [(1, k, k, t, (scores or [0.9] * len(texts))[k], (areas or [0.1] * len(texts))[k]) for k, t in enumerate(texts)]


LINE = "item long, line_idx long, ord long, line_text string, line_score double, area_ratio double"


def test_policies_and_choice(spark):
    rows = line_rows(["Big title here", "big title here", "small", "ok"], [0.95, 0.8, 0.6, 0.75], [0.4, 0.3, 0.2, 0.1])
    df = spark.createDataFrame(rows, LINE)
    got = {r["policy"]: r["ocr_text"] for r in lines.joined_text(lines.policy_lines(df, ["item"]), ["item", "policy"]).collect()}
    assert got["all_clean"] == "Big title here small ok" and got["score_ge_085"] == "Big title here" and got["area_ge_q50"] == "Big title here"
    alone = spark.createDataFrame(line_rows(["one line"]), LINE)
    assert {r["policy"] for r in lines.policy_lines(alone, ["item"]).select("policy").distinct().collect()} == {"all_clean", "score_ge_07", "score_ge_085", "long_lines"}
    made = cd.with_features(cd.candidates(df, "item", merges=True), "item")
    assert made.where("candidate_type = 'existing_variant'").count() == 8
    assert cd.choose(made, "item").first()["ocr_text"] != ""
    blank_pick = made.withColumn("predicted", F.when(F.col("ocr_text") == "", -1.0).otherwise(1.0))
    assert cd.choose(blank_pick, "item", "predicted").first()["ocr_text"] != ""
    again = cd.relative_to_raw(made, "item", F.col("candidate_name") == "variant::raw")
    assert sorted(map(str, again.select(sorted(made.columns)).collect())) == sorted(map(str, made.select(sorted(made.columns)).collect()))


def parsed(spark, value):
    df = spark.createDataFrame([(1, json.dumps(value))], "id int, j string")
    return [r.asDict() for r in ocr_json.records(df, "j", ["id"], F.lit(100), F.lit(200)).orderBy("line_idx").collect()]


def test_recogniser_json(spark):
    box = [[0, 0], [10, 0], [10, 5], [0, 5]]
    for value in ({"rec_texts": ["a", " b "], "rec_scores": [0.5], "rec_polys": [box]}, {"res": {"rec_texts": ["a", " b "], "rec_scores": [0.5], "rec_polys": [box]}}, [{"texts": ["a", " b "], "scores": [0.5], "boxes": [[0, 0, 10, 5]]}]):
        a, b = parsed(spark, value)
        assert (a["line_text"], a["line_score"], a["box_area"], a["box_cx_ratio"], a["parser"]) == ("a", 0.5, 50.0, 0.05, "paddle_v3_dict")
        assert (b["line_text"], b["line_score"], b["box_x1"]) == ("b", None, None)
    for value in ([[[box, ["a", 0.5]], [box, ["b", 0.7]]]], [[box, ["a", 0.5]], [box, ["b", 0.7]]]):
        got = parsed(spark, value)
        assert [(r["line_text"], r["line_score"], r["box_ymax"]) for r in got] == [("a", 0.5, 5.0), ("b", 0.7, 5.0)]
    assert parsed(spark, [[]]) == [] and parsed(spark, {}) == []
    (cut,) = parsed(spark, {"rec_texts": ["a"], "rec_polys": [[[0, 0], [1, 0], [1, 1], [0, 1], [99, 99]]]})
    assert cut["box_xmax"] == 1.0


def test_geometry_and_quality(spark):
    df = spark.createDataFrame([(1, 640, 480)], "id int, width int, height int")
    got = {r["variant"]: tuple(r)[2:] for r in images.live_geometry(df, ["id"]).collect()}
    assert got["raw"] == (0, 480, 1280, 960) and got["upper_60_resize_960"] == (0, 288, 960, 432)
    w, h = F.lit(7), F.lit(5)
    assert tuple(spark.range(1).select(*images.side_crop(w, h, "center", 0.6)).first()) == (0, 1, 7, 4)
    assert tuple(spark.range(1).select(*images.rounded_band(h, F.lit(0.9), F.lit(0.1))).first()) == (0, 5)
    flat = np.full((4, 6, 3), 10, np.uint8)
    assert images.quality_of(flat)["blur_laplacian_var"] == 0 and images.quality_of(flat)["dark_pixel_ratio"] == 1
    assert (images.inverted_if_dark(flat) == 245).all() and (images.inverted_if_dark(images.inverted(flat)) == 245).all()


def test_product_model(spark):
    rows = [(f"green tea number {k}", "Tea") for k in range(12)] + [(f"rice cake piece {k}", "Cake") for k in range(12)] + [(f"zzz qqq {k}", "") for k in range(12)] + [("", "")]
    df = spark.createDataFrame(rows, "ocr_text string, product_name string")
    model = ml.ProductModel(rule=lambda t: F.when(t.contains("special"), "Ruled")).fit(df)
    asked = spark.createDataFrame([("green tea",), ("rice cake",), ("qqq zzz",), ("",), ("special",)], "ocr_text string")
    assert [r[1] for r in model.predict(asked).collect()] == ["Tea", "Cake", "", "", "Ruled"]
    assert model.n_classes == 2


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("b", 'say "hi", x', ""), ("a", "two\nlines", "NA")], "image_id string, ocr_text string, brand_name string")
    tables.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"file://{tmp_path}/c").collect())) == sorted(map(tuple, df.collect()))
    tables.write_submission(df, f"file://{tmp_path}/s")
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part*.csv")))
    assert '"b","say ""hi"", x"," "' in text
    assert tables.append_missing(df, f"file://{tmp_path}/p", "image_id") == 2 and tables.append_missing(df, f"file://{tmp_path}/p", "image_id") == 0
    for name in ("x.jpg", "y.png", "x.png"):
        (tmp_path / name).write_bytes(b"1")
    items = spark.createDataFrame([("x",), ("y",), ("z",), ("y.png",)], "image_id string")
    got = {r["image_id"]: (r["path"] or "").split("/")[-1] for r in tables.image_paths(spark, items, f"file://{tmp_path}/*.*").collect()}
    assert got == {"x": "x.jpg", "y": "y.png", "z": "", "y.png": "y.png"}
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, f"file://{tmp_path}/none")
    (tmp_path / "default.json").write_text('{"a": {"x": 1, "y": 2}}')
    (tmp_path / "own.json").write_text('{"a": {"y": 3}}')
    assert tables.load_config(f"{tmp_path}/own.json") == {"a": {"x": 1, "y": 3}}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, [(f"green tea {k}", 0.9), (f"Green Tea {k}", 0.8), ("x", 0.1)]) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, lines array<struct<text:string,score:double>>")
    df.write.parquet(f"file://{tmp_path}/in")
    brands, products = gazetteer(spark, ["Green"], ["Green Tea"])
    plan = lambda d: stream.extract_stream(stream.joined_lines(d), brands, products, [], [], []).select("id", "ocr_text", "brand_name", "product_name")
    for _ in range(2):  # the second run finds nothing new
        stream.run_available(stream.read_folder(spark, f"file://{tmp_path}/in", "id long, lines array<struct<text:string,score:double>>"), plan, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect())) == sorted(map(tuple, plan(df).collect()))
    assert plan(df).first()["product_name"] == "Green Tea"


def test_compact_forms(spark):
    assert one(spark, "A-b c+", compact) == "a-bc+" and one(spark, "A-b c+", compact_alnum) == "abc" and one(spark, "Đèn", rule_key) == "en"
