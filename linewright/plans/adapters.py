"""The driver's tables in the shapes that the operators read, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with scores and boxes made from their numbers; ``ord`` is reading order.

    Scores and areas are binary fractions, so that sums are exact in any order.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "part"))
    out = docs.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.trim("part").alias("line_text")).where("line_text != ''")
    width, height = F.least(F.length("line_text") * 8, F.lit(960)), 16 + (F.col("line_idx") * 5) % 3 * 8
    return out.withColumns({
        "line_score": (300 + (F.col("doc_id") * 7919 + F.col("line_idx") * 104729) % 700) / F.lit(1024.0), "x": (F.col("doc_id") * 31 + F.col("line_idx") * 17) % 40 * 10,
        "y": F.col("line_idx") * 24, "w": width.cast("long"), "h": height, "area_ratio": width * height / F.lit(1048576.0), "ord": F.col("line_idx"),
    })


LINES = """lines AS (SELECT *, least(length(line_text) * 8, 960) AS w, 16 + (line_idx * 5) % 3 * 8 AS h,
  least(length(line_text) * 8, 960) * (16 + (line_idx * 5) % 3 * 8) / 1048576.0::DOUBLE AS area_ratio,
  (300 + (doc_id * 7919 + line_idx * 104729) % 700) / 1024.0::DOUBLE AS line_score, (doc_id * 31 + line_idx * 17) % 40 * 10 AS x, line_idx * 24 AS y, line_idx AS ord
  FROM (SELECT doc_id, i - 1 AS line_idx, trim(parts[i]) AS line_text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
  WHERE line_text != '')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text as truth and the next turn's as guess."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("guess", F.lead("text").over(by)).where("guess IS NOT NULL")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("truth"), "guess")


TURNS = """turns AS (SELECT conv_id * 1000 + turn AS pair_id, text AS truth, guess FROM
  (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS guess FROM conversations) WHERE guess IS NOT NULL)"""


def solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as truths: text, first word as brand, first three words as product."""
    return turns(spark, sf_dir).select("pair_id", F.col("truth").alias("ocr_text"), F.get(F.split("truth", " "), F.lit(0)).alias("brand_name"), F.array_join(F.slice(F.split("truth", " "), 1, 3), " ").alias("product_name"))


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truths, or blanks, capitals, halves or the other text, by pair."""
    k = F.col("pair_id") % 5
    pairs = turns(spark, sf_dir)

    def bent(c, other):
        return F.when(k == 0, c).when(k == 1, F.lit("")).when(k == 2, F.translate(c, LOWER, UPPER)).when(k == 3, F.substring(c, F.lit(1), (F.length(c) / 2).cast("int"))).otherwise(other)

    first = lambda c: F.get(F.split(c, " "), F.lit(0))
    three = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 3), " ")
    return pairs.select("pair_id", bent(F.col("truth"), F.col("guess")).alias("ocr_text"), bent(first("truth"), first("guess")).alias("brand_name"), bent(three("truth"), three("guess")).alias("product_name"))


_BENT = "CASE pair_id % 5 WHEN 0 THEN {0} WHEN 1 THEN '' WHEN 2 THEN translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 3 THEN substr({0}, 1, CAST(floor(length({0}) / 2.0) AS INT)) ELSE {1} END"
_FIRST, _THREE = "string_split({}, ' ')[1]", "array_to_string(string_split({}, ' ')[1:3], ' ')"
SOLUTION = f"solution AS (SELECT pair_id, truth AS ocr_text, {_FIRST.format('truth')} AS brand_name, {_THREE.format('truth')} AS product_name FROM turns)"
SUBMISSION = "submission AS (SELECT pair_id, " + ", ".join(f"{_BENT.format(p.format('truth'), p.format('guess'))} AS {n}" for n, p in (("ocr_text", "{}"), ("brand_name", _FIRST), ("product_name", _THREE))) + " FROM turns)"


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labelled items: every seventh holds two products."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" + "), "p_type")).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("ocr_text"), F.col("p_brand").alias("brand_name"), name.alias("product_name"))


PARTS = """parts AS (SELECT p_partkey AS item_id, concat_ws(' ', p_brand, p_type, p_name) AS ocr_text, p_brand AS brand_name,
  CASE WHEN p_partkey % 7 = 0 THEN p_name || ' + ' || p_type ELSE p_name END AS product_name FROM part)"""


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each benchmark item: its first three words, lower-cased, stand for the item."""
    b = table(spark, sf_dir, "benchmark")
    phrase = F.lower(F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " "))
    return b.select(F.col("item_id").alias("rule_rank"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("canonical"), phrase.alias("pattern"))


RULES = r"""rules AS (SELECT item_id AS rule_rank, 'item ' || item_id AS canonical, lower(array_to_string(regexp_split_to_array(text, '\s+')[1:3], ' ')) AS pattern FROM benchmark)"""
RULE_KEY = r"trim(regexp_replace(regexp_replace(lower(strip_accents(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))), '[^a-z0-9\s+\-&.]+', ' ', 'g'), '\s+', ' ', 'g'))"
EVAL_KEY = r"trim(regexp_replace(lower(replace(replace(strip_accents(coalesce({}, '')), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g'))"
#: DuckDB's levenshtein counts bytes: the tables' letters beyond ASCII become ASCII ones that no text holds.
PLAIN = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27))"
