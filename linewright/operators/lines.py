"""Line records: distinct joining, statistics, crops as line ranges, and line policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ACCENT_CLASS
from ..functions.text import clean

#: name, top and bottom share of the height, long side in pixels
CROPS = [
    ("raw", 0.0, 1.0, 1280),
    ("center_70_resize_960", 0.15, 0.85, 960),
    ("bottom_60_resize_960", 0.40, 1.0, 960),
    ("bottom_50_resize_960", 0.50, 1.0, 960),
    ("bottom_45_resize_960", 0.55, 1.0, 960),
    ("middle_bottom_70_resize_960", 0.30, 1.0, 960),
    ("center_60_resize_960", 0.20, 0.80, 960),
    ("upper_60_resize_960", 0.0, 0.60, 960),
]
POLICIES = ("all_clean", "score_ge_07", "score_ge_085", "with_accent", "long_lines", "top5_area", "area_ge_q50", "area_ge_q65")
MERGES = [("raw", "bottom_50_resize_960"), ("raw", "bottom_60_resize_960"), ("raw", "center_70_resize_960"), ("raw", "middle_bottom_70_resize_960"), ("center_70_resize_960", "bottom_50_resize_960"), ("upper_60_resize_960", "bottom_50_resize_960")]


def joined_text(lines: DataFrame, keys: list[str], text: str = "line_text", order: str = "ord") -> DataFrame:
    """keys, ocr_text (lines in order, each once whatever its case), and statistics over all lines.

    One exchange on the keys serves the window and the aggregation.
    """
    shown = clean(F.col(text))
    first = F.row_number().over(Window.partitionBy(*keys, F.lower(shown)).orderBy(order))
    once = lines.repartition(*keys).withColumn("_text", shown).withColumn("_first", first)
    area = F.col("area_ratio")
    return once.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_first") == 1) & (F.col("_text") != ""), F.struct(order, "_text")))), lambda x: x["_text"]), " ").alias("ocr_text"),
        F.count_if(F.col("_text") != "").alias("num_lines"), F.coalesce(F.avg("line_score"), F.lit(0.0)).alias("avg_line_score"),
        F.coalesce(F.median("line_score"), F.lit(0.0)).alias("median_line_score"), F.coalesce(F.avg(F.when(area > 0, area)), F.lit(0.0)).alias("avg_area_ratio"),
    )


def marked_lines(lines: DataFrame, key: str, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Lines without their texts, and each item's texts as one array.

    A line keeps its place in the array, the place of the first line with the same text whatever its case (null if
    blank), and whether it has accents or is long: what crops and policies multiply are numbers, not texts.
    """
    by = Window.partitionBy(key)
    shown = lines.repartition(key).withColumn("_text", clean(F.col("line_text"))).withColumn("place", F.row_number().over(by.orderBy(order)) - 1)
    shown = shown.withColumn("same", F.when(F.col("_text") != "", F.min("place").over(Window.partitionBy(key, F.lower("_text")))))
    slim = shown.select(key, "line_idx", order, "place", "same", "line_score", "area_ratio", F.col("line_text").rlike(ACCENT_CLASS).alias("accented"), (F.length("_text") >= 8).alias("long"))
    texts = shown.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_text"))), lambda x: x["_text"]).alias("_texts"))
    return slim, texts


def joined_places(lines: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Like ``joined_text`` over marked lines: the places of the texts instead of the texts."""
    first = F.row_number().over(Window.partitionBy(*keys, "same").orderBy(order))
    once = lines.repartition(*keys).withColumn("_first", first)
    area = F.col("area_ratio")
    return once.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("_first") == 1) & F.col("same").isNotNull(), F.struct(order, "place")))), lambda x: x["place"]).alias("places"),
        F.count("same").alias("num_lines"), F.coalesce(F.avg("line_score"), F.lit(0.0)).alias("avg_line_score"),
        F.coalesce(F.median("line_score"), F.lit(0.0)).alias("median_line_score"), F.coalesce(F.avg(F.when(area > 0, area)), F.lit(0.0)).alias("avg_area_ratio"),
    )


def crop_lines(lines: DataFrame, key: str, crops=CROPS) -> DataFrame:
    """A row for each line and crop that shows it: a crop shows a line whose middle lies within its share of the lines."""
    table = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(k).alias("variant_ord"), F.lit(a).alias("y1"), F.lit(b).alias("y2")) for k, (n, a, b, _) in enumerate(crops)))
    at = (F.col("line_idx") + 0.5) / (F.max("line_idx").over(Window.partitionBy(key)) + 1)
    placed = lines.withColumn("_at", at).withColumn("_crop", F.explode(F.filter(table, lambda c: (c["y1"] <= F.col("_at")) & (F.col("_at") <= c["y2"]))))
    return placed.select(*lines.columns, "_crop.variant", "_crop.variant_ord")


def policy_lines(lines: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """A row for each line and policy that keeps it; ``ord`` is reading order, but order of area under top5_area."""
    by = Window.partitionBy(*keys)
    area = F.coalesce("area_ratio", F.lit(0.0))
    ranked = lines.repartition(*keys).withColumns({
        "_n": F.count(F.lit(1)).over(by), "_any": F.max(area).over(by) > 0,
        "_q": F.percentile(area, F.array(F.lit(0.5), F.lit(0.65))).over(by),
        "_rank": F.row_number().over(by.orderBy(F.desc(area), order)),
    })
    score = F.coalesce("line_score", F.lit(0.0))
    several = F.col("_n") >= 2
    held = {
        "all_clean": F.lit(True), "score_ge_07": score >= 0.70, "score_ge_085": score >= 0.85, "with_accent": F.col("accented") if "accented" in lines.columns else F.col("line_text").rlike(ACCENT_CLASS),
        "long_lines": F.col("long") if "long" in lines.columns else F.length(clean(F.col("line_text"))) >= 8, "top5_area": several & (F.col("_rank") <= 5),
        "area_ge_q50": several & F.col("_any") & (area >= F.col("_q")[0]), "area_ge_q65": several & F.col("_any") & (area >= F.col("_q")[1]),
    }
    names = F.array_compact(F.array(*(F.when(held[p], F.struct(F.lit(p).alias("policy"), F.lit(k).alias("policy_ord"), (F.col("_rank") if p == "top5_area" else F.col(order)).cast("long").alias("ord"))) for k, p in enumerate(POLICIES))))
    return ranked.withColumn("_policy", F.explode(names)).select(*(c for c in lines.columns if c != order), "_policy.policy", "_policy.policy_ord", F.col("_policy.ord").alias(order))


def merged_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines of pairs of crops, one after the other, that score 0.85 or more: ``merge`` and an order over both."""
    table = F.array(*(F.struct(F.lit("+".join(p)).alias("merge"), F.lit(k).alias("seq"), F.lit(v).alias("variant")) for p in MERGES for k, v in enumerate(p)))
    joined = lines.where("line_score >= 0.85").withColumn("_m", F.explode(F.filter(table, lambda m: m["variant"] == F.col("variant"))))
    return joined.select(*(c for c in lines.columns if c != "ord"), F.col("_m.merge").alias("merge"), (F.col("_m.seq") * 1_000_000_000 + F.col("ord")).alias("ord"))


def record_text(lines: DataFrame, keys: list[str], sep: str = "\n") -> DataFrame:
    """Lines that are not blank joined by ``sep``, and the mean of scores that are numbers (0 if none)."""
    t = F.trim(F.coalesce("line_text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.when(t != "", F.struct("line_idx", t.alias("t")))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias("text"), F.coalesce(F.avg(F.col("line_score").try_cast("double")), F.lit(0.0)).alias("avg_score"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to three tasks for each core or more: for much work on rows that lie in few files."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
