"""Submissions: columns, cleaning, checks, completion and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import null_to_empty, single_line

PHASES = {"phase1": ["image_id", "ocr_text", "product_name"], "phase2": ["image_id", "ocr_text", "brand_name", "product_name"]}


def columns_of(phase: str) -> list[str]:
    if phase not in PHASES:
        raise ValueError(f"no phase {phase}")
    return PHASES[phase]


def require(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks columns {absent}")
    return df


def reordered(df: DataFrame, columns: list[str]) -> DataFrame:
    return require(df, columns).select(*columns)


def empty_submission(items: DataFrame, phase: str = "phase2") -> DataFrame:
    return require(items, ["image_id"]).select(F.col("image_id").cast("string").alias("image_id"), *(F.lit("").alias(c) for c in columns_of(phase)[1:]))


def cleaned(df: DataFrame, phase: str = "phase2") -> DataFrame:
    return df.select(*((single_line(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in columns_of(phase)))


def check(df: DataFrame, items: DataFrame, columns: list[str], key: str = "image_id", order: str | None = None) -> DataFrame:
    """One row: ok, rows, and the faults in fixed order (bad_columns, bad_row_count, duplicate_image_id,
    image_id_order_mismatch, null_cells, newline_or_tab_cells) with their counts.

    ``order`` names a column that numbers the rows of both tables; without it only the set of ids is compared.
    """
    cells = [c for c in df.columns if c != order]
    text = [c for c, t in df.dtypes if t == "string" and c != order]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cells), F.lit(0))
    breaks = sum((F.count_if(F.col(c).rlike(r"[\n\r\t]")) for c in text), F.lit(0))
    own = df.agg(F.count(F.lit(1)).alias("rows"), (F.count(key) - F.count_distinct(key)).alias("repeated"), nulls.alias("nulls"), breaks.alias("breaks"))
    by = [F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))] + ([F.col(f"a.{order}") == F.col(f"b.{order}")] if order else [])
    a, b = df.select(key, *([order] if order else [])).alias("a"), items.select(key, *([order] if order else [])).alias("b")
    on = by[0] if len(by) == 1 else by[0] & by[1]
    moved = a.join(b, on, "full_outer").agg(F.count_if(F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()).alias("moved"))
    total = own.join(items.agg(F.count(F.lit(1)).alias("expected"))).join(moved)  # one row each
    faults = F.array_compact(F.array(*(
        F.when(bad, F.struct(F.lit(name).alias("type"), n.cast("long").alias("count"))) for name, bad, n in (
            ("bad_columns", F.lit(cells != columns), F.lit(len(cells))), ("bad_row_count", F.col("rows") != F.col("expected"), F.col("rows")), ("duplicate_image_id", F.col("repeated") > 0, F.col("repeated")),
            ("image_id_order_mismatch", F.col("moved") > 0, F.col("moved")), ("null_cells", F.col("nulls") > 0, F.col("nulls")), ("newline_or_tab_cells", F.col("breaks") > 0, F.col("breaks")),
        )
    )))
    return total.select((F.size(faults) == 0).alias("ok"), "rows", faults.alias("errors"))


def completed(df: DataFrame, items: DataFrame, key: str, fields: list[str], blank: str = " ") -> DataFrame:
    """Every item once predicted or blank; ids outside the catalog stay."""
    return df.select(key, *fields).join(items.select(key).distinct(), key, "full_outer").select(key, *(F.coalesce(c, F.lit(blank)).alias(c) for c in fields))


def overridden(df: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Values of ``overrides`` where it has any."""
    o = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return df.join(o, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns))


def like_template(df: DataFrame, template: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """A row for each of the template, in its order; what is missing is empty."""
    return template.select(key, order).join(df.select(key, *fields), key, "left").select(key, order, *(null_to_empty(F.col(c)).alias(c) for c in fields))


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.agg(*(F.avg((F.trim(F.coalesce(c, F.lit(""))) != "").cast("double")).alias(f"{c}_fill_rate") for c in fields))


def numbered(df: DataFrame, *order) -> DataFrame:
    """Row numbers from 0 by a total order: counted within ranges, so that no task holds all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    return ranged.join(F.broadcast(before), "_part").withColumn("ord", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def paged(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def result_rows(df: DataFrame, phase: str = "phase2") -> DataFrame:
    """Predictions in a submission's columns: what is null or absent is empty, and nothing else is touched."""
    return df.select(*((null_to_empty(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in columns_of(phase)))


def broken_cells(df: DataFrame) -> DataFrame:
    """column and count of the cells with a line end or a tab, for the columns that have any."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, count long")
    counts = df.agg(*(F.count_if(F.col(c).rlike(r"[\n\r\t]")).alias(c) for c in text))
    return counts.unpivot([], text, "column", "count").where("count > 0")


def save(df: DataFrame, items: DataFrame, path: str, phase: str = "phase2", order: str | None = None) -> dict:
    """Cleans, checks and writes a submission as CSV with a header; a faulty one raises, and nothing is written. Returns the check.

    ``order`` as in ``check``; where it is given, rows are written in its order.
    """
    own = cleaned(df, phase) if order is None else df.select(*((single_line(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in columns_of(phase)), order)
    report = check(own, items, columns_of(phase), order=order).first().asDict(recursive=True)
    if not report["ok"]:
        raise ValueError(f"invalid submission: {report}")
    rows = own if order is None else own.orderBy(order).drop(order)
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    return report
