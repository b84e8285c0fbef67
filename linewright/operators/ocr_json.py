"""Line records from the JSON of text recognisers: parallel arrays, or nested lists of [box, [text, score]]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import is_junk_line
from ..functions.text import clean, without_repeated_tokens
from .lines import first_by

TEXTS, SCORES, POLYGONS = ("rec_texts", "texts", "text"), ("rec_scores", "scores", "rec_score"), ("rec_polys", "dt_polys", "polys", "boxes", "rec_boxes", "dt_boxes")


def numbers(json: Column) -> Column:
    """All numbers of a JSON value, in order: of a box with any nesting."""
    return F.transform(F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), 1), lambda x: x.cast("double"))


def polygon_stats(nums: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners, bounds and shares of a polygon of 8 numbers (more are cut) or a box of 4; else nulls."""
    at = lambda k: F.get(nums, F.lit(k))
    corners = F.when(F.size(nums) >= 8, F.slice(nums, 1, 8)).when(F.size(nums) == 4, F.array(at(0), at(1), at(2), at(1), at(2), at(3), at(0), at(3)))
    out = {f"box_{'xy'[k % 2]}{k // 2 + 1}": F.get(corners, F.lit(k)) for k in range(8)}
    xs, ys = F.filter(corners, lambda v, i: i % 2 == 0), F.filter(corners, lambda v, i: i % 2 == 1)
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    out |= {"box_xmin": x1, "box_ymin": y1, "box_xmax": x2, "box_ymax": y2, "box_width": x2 - x1, "box_height": y2 - y1, "box_area": (x2 - x1) * (y2 - y1)}
    out["box_cx_ratio"] = F.when(width > 0, (x1 + x2) / 2 / width)
    out["box_cy_ratio"] = F.when(height > 0, (y1 + y2) / 2 / height)
    return out | {"box_area_ratio": F.when((width > 0) & (height > 0), out["box_area"] / (width * height))}


def _any(json: Column, names: tuple[str, ...]) -> Column:
    """The first of the keys that holds something, at the top, under ``res``, or in a list of one."""
    return F.coalesce(*(F.when(~v.isin("[]", '""', "null"), v) for n in names for base in ("$.res.", "$[0].res.", "$.", "$[0].") for v in [F.get_json_object(json, base + n)]))


def _array(json: Column) -> Column:
    """Elements of a JSON array as JSON texts."""
    return F.from_json(json, "array<string>")


def array_records(df: DataFrame, json: str, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Records of parallel arrays; scores and boxes may be missing or shorter."""
    found = df.withColumns({"_t": _any(F.col(json), TEXTS), "_s": _array(_any(F.col(json), SCORES)), "_p": _array(_any(F.col(json), POLYGONS))})
    found = found.withColumn("_t", F.when(F.col("_t").startswith("["), _array(F.col("_t"))).otherwise(F.array("_t"))).where(F.col("_t").isNotNull() & F.get("_t", F.lit(0)).isNotNull())
    rows = found.select(*keys, "_s", "_p", width.alias("variant_width"), height.alias("variant_height"), F.posexplode("_t").alias("line_idx", "_text"))
    out = rows.select(*keys, "line_idx", F.trim(F.coalesce("_text", F.lit(""))).alias("line_text"), F.get("_s", "line_idx").try_cast("double").alias("line_score"), "variant_width", "variant_height", F.lit("paddle_v3_dict").alias("parser"), numbers(F.get("_p", "line_idx")).alias("_n"))
    return out.withColumns(polygon_stats(F.col("_n"), F.col("variant_width"), F.col("variant_height"))).drop("_n")


def nested_records(df: DataFrame, json: str, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Records of a list of [box, [text, score]], bare or in a list of one; what does not look like a line is skipped."""
    parsed = df.withColumn("_v", F.try_parse_json(json)).where("_v IS NOT NULL")
    path = lambda v, p, t="string": F.try_variant_get(v, p, t)
    bare = path(F.col("_v"), "$[0][1][0]").isNotNull() & ~F.schema_of_variant(F.coalesce(F.try_variant_get("_v", "$[0][1][0]", "variant"), F.parse_json(F.lit("null")))).startswith("ARRAY")
    items = F.when(bare, F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.coalesce(F.try_variant_get("_v", "$[0]", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>")))
    rows = parsed.select(*keys, width.alias("variant_width"), height.alias("variant_height"), F.posexplode(items).alias("line_idx", "_i"))
    text = F.try_variant_get("_i", "$[1][0]", "variant")
    rows = rows.where(F.schema_of_variant(F.coalesce(text, F.parse_json(F.lit("null")))) == "STRING")
    out = rows.select(*keys, "line_idx", F.trim(path("_i", "$[1][0]")).alias("line_text"), path("_i", "$[1][1]").try_cast("double").alias("line_score"), "variant_width", "variant_height", F.lit("paddle_v2_list").alias("parser"), numbers(F.to_json(F.try_variant_get("_i", "$[0]", "variant"))).alias("_n"))
    return out.withColumns(polygon_stats(F.col("_n"), F.col("variant_width"), F.col("variant_height"))).drop("_n")


def records(df: DataFrame, json: str, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Parallel arrays where the JSON is an object (or a list of one), nested lists otherwise."""
    is_object = F.ltrim(F.col(json)).rlike(r"^\s*(\{|\[\s*\{)")
    return array_records(df.where(is_object), json, keys, width, height).unionByName(nested_records(df.where(~is_object), json, keys, width, height))


def corner_text(df: DataFrame, keys: list[str], x: str = "box_xmin", y: str = "box_ymin", least_score: float = 0.35) -> DataFrame:
    """keys and ocr_text: lines with a score of strictly more than ``least_score``, by their first corner (down, then across), in one
    line, without tokens that repeat the one before. Keys without such a line have an empty text."""
    line = F.when(F.col("line_score") > least_score, F.struct(F.col(y).alias("y"), F.col(x).alias("x"), "line_idx", "line_text"))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_rows"))  # lines of one image
    return rows.select(*keys, without_repeated_tokens(F.array_join(F.transform("_rows", lambda r: r["line_text"]), " ")).alias("ocr_text"))


def clean_records(df: DataFrame, keys: list[str], least_score: float = 0.45) -> DataFrame:
    """Sure lines that are no junk, in reading order, each once whatever its case: adds ``ord``."""
    score = F.coalesce("line_score", F.lit(1.0))
    kept = df.withColumn("line_text", clean(F.col("line_text"))).where((F.col("line_text") != "") & (score >= least_score) & ~is_junk_line(F.col("line_text"), score))
    place = [F.coalesce("box_ymin", F.lit(0.0)), F.coalesce("box_xmin", F.lit(0.0)), F.col("line_idx")]
    once = first_by(kept.withColumn("_low", F.lower("line_text")), [*keys, "_low"], *place).drop("_low")
    from pyspark.sql import Window

    return once.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*place)) - 1)
