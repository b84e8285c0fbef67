"""The extraction plan over streams: per-item stages need no state, so rows flow through without watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.features import is_junk_line
from ..functions.text import clean, first_of_each
from ..operators.extract import alias_brand, curated_fill, rulebase


def joined_lines(df: DataFrame, lines: str = "lines") -> DataFrame:
    """ocr_text from an array of struct(text, score) in reading order: sound lines, each once whatever its case."""
    sound = F.filter(F.col(lines), lambda x: ~is_junk_line(x["text"], x["score"]))
    return df.withColumn("ocr_text", F.array_join(first_of_each(F.transform(sound, lambda x: clean(x["text"])), F.lower), " "))


def extract_stream(df: DataFrame, brands: list, products: list, aliases: list, brand_rules: list, product_rules: list) -> DataFrame:
    """Brand and product of each row, by the stages that look at one row alone."""
    out = rulebase(df.withColumn("evidence_text", F.col("ocr_text")), brands, products)
    out = alias_brand(out, aliases)
    named = F.when(F.col("brand_v3") != "", F.col("brand_v3")).otherwise(F.col("brand_v5"))
    return curated_fill(out.withColumns({"brand_name": named, "product_name": F.col("product_v3")}), brand_rules, product_rules)


def run_available(source: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended as Parquet; a second run continues where the first ended."""
    query = plan(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_folder(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
