"""Sources and sinks: CSV with every cell as text, image catalogs, submissions, JSON reports, resumable writes."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty cells as empty strings, words like NA as they stand."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.options(**options).csv(path).na.fill("")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_submission(df: DataFrame, path: str, key: str = "image_id") -> None:
    """Sorted by id, every cell quoted, blanks as one space."""
    cells = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(" ")).otherwise(F.col(c).cast("string")).alias(c) if c != key else F.col(c).cast("string").alias(c) for c in df.columns]
    df.select(*cells).orderBy(key).write.mode("overwrite").options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def catalog(spark: SparkSession, csv_path: str, image_dir: str) -> DataFrame:
    """Ids of a catalog file, else the names of the folder's images; contents are not read."""
    if exists(spark, csv_path):
        return read_csv(spark, csv_path).select("image_id")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(image_dir).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.jpg$", 1).alias("image_id")).orderBy("image_id")


def image_paths(spark: SparkSession, items: DataFrame, image_dir: str, key: str = "image_id") -> DataFrame:
    """The file of each id: its exact name, else its stem with the first suffix there is; null if none."""
    files = spark.read.format("binaryFile").load(image_dir).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"))
    stem, suffix = F.regexp_replace("_name", r"\.[^.]+$", ""), F.lower(F.regexp_extract("_name", r"(\.[^.]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, IMAGE_SUFFIXES)), suffix)
    named = files.select("path", F.col("_name").alias(key), F.lit(0).cast("long").alias("_rank")).unionByName(files.where(rank > 0).select("path", stem.alias(key), rank.alias("_rank")))
    return items.join(named.groupBy(key).agg(F.min_by("path", "_rank").alias("path")), key, "left")


def labels(spark: SparkSession, paths: list[str], required: bool = True) -> DataFrame | None:
    """The first label table there is, kept in memory for the stages that share it."""
    path = first_existing(spark, paths)
    if path is None:
        if required:
            raise FileNotFoundError(f"none of {paths}")
        return None
    return read_csv(spark, path).cache()


def uploaded(spark: SparkSession, content: bytes, image_id: str = "live_image") -> DataFrame:
    return spark.createDataFrame([(image_id, bytearray(content))], T.StructType([T.StructField("image_id", T.StringType()), T.StructField("content", T.BinaryType())]))


def write_splits(df: DataFrame, path: str) -> None:
    """One write, a folder for each split."""
    df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def write_report(report: DataFrame, cases: DataFrame, folder: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/eval_report")
    write_csv(cases, f"{folder}/error_cases")


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Resumes a batch: appends rows whose ids the table does not hold yet, and says how many."""
    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else df
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def merged_config(base: dict, over: dict) -> dict:
    """A deep merge; values of ``over`` win, mappings merge."""
    return base | {k: merged_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str) -> dict:
    """A JSON mapping (YAML if its library is there) merged over the ``default`` file beside it."""

    def read(name: str) -> dict:
        with open(name, encoding="utf-8") as f:
            if name.endswith(".json"):
                out = json.load(f)
            else:
                import yaml

                out = yaml.safe_load(f) or {}
        if not isinstance(out, dict):
            raise ValueError(f"{name} is no mapping")
        return out

    default = os.path.join(os.path.dirname(path), "default" + os.path.splitext(path)[1])
    own = read(path)
    return merged_config(read(default), own) if os.path.exists(default) and os.path.abspath(default) != os.path.abspath(path) else own
