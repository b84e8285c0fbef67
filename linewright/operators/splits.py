"""Splits for training and validation, by rows and by held-out groups; hashes take the part of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import eval_key


def _place(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def _ranked(df: DataFrame, place: Column, ties: list) -> DataFrame:
    """A number from 1 by ``place``: counted in 4096 leading-hash buckets, so that no task sorts all rows."""
    put = df.withColumn("_place", place).withColumn("_bucket", F.substring("_place", 1, 3))
    sizes = put.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_place", *ties))
    return put.withColumn("_own", own).join(F.broadcast(before), "_bucket").withColumn("_rank", F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before", "_place")


def random_split(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly round(n * ratio) rows are val (half to even), the others train."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    size = df.agg(F.bround(F.count(F.lit(1)) * ratio, 0).cast("long").alias("_size"))
    ranked = _ranked(df, _place(seed, F.col(key)), [key]).join(F.broadcast(size))  # one row
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_size"), "val").otherwise("train")).drop("_rank", "_size")


def with_product_key(df: DataFrame, column: str = "product_name") -> DataFrame:
    norm = eval_key(F.col(column)) if column in df.columns else F.lit("")
    return df.withColumns({"norm_product_name": norm, "is_product_blank": norm == ""})


def group_holdout(df: DataFrame, key: str, column: str = "product_name", ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """df with ``split`` and the held-out products: no product is on both sides, blank ones are split by rows."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    work = with_product_key(df, column)
    groups = work.where(~F.col("is_product_blank")).select("norm_product_name").distinct()
    size = groups.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * ratio, 0).cast("long")).alias("_size"))
    held = _ranked(groups, _place(seed, F.col("norm_product_name")), ["norm_product_name"]).join(F.broadcast(size)).where(F.col("_rank") <= F.col("_size")).select("norm_product_name")
    named = work.where(~F.col("is_product_blank")).join(held.withColumn("_held", F.lit(True)), "norm_product_name", "left")
    named = named.withColumn("split", F.when(F.col("_held"), "val").otherwise("train")).drop("_held")
    blank = random_split(work.where("is_product_blank"), key, ratio, seed)
    return named.unionByName(blank), held
