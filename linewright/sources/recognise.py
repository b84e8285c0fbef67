"""Text recognition as a plug: any callable from image bytes to recogniser JSON runs beside the images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ocr_json import clean_records, records

Backend = Callable[[bytes], str]


def recognised(images: DataFrame, make: Callable[[], Backend], key: str = "image_id", content: str = "content") -> DataFrame:
    """key, json and error: one backend for each worker, made when its first batch comes; a failing image gives an error, not a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = None
        for batch in batches:
            backend = backend or make()
            made = []
            for name, data in zip(batch["key"], batch["content"]):
                try:
                    made.append((name, backend(bytes(data)), None))
                except Exception as error:  # noqa: BLE001  whatever the plug raises belongs to its image
                    made.append((name, None, repr(error)))
            yield pd.DataFrame(made, columns=["key", "json", "error"])

    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return rows.mapInPandas(run, "key string, json string, error string").withColumnRenamed("key", key)


def recognised_lines(found: DataFrame, key: str = "image_id", width: int = 0, height: int = 0, least_score: float = 0.45) -> DataFrame:
    """Clean line records in reading order, in the shape that the candidate operators read."""
    made = clean_records(records(found.where("json IS NOT NULL"), "json", [key], F.lit(width), F.lit(height)), [key], least_score)
    return made.select(key, F.col("line_idx").cast("long").alias("line_idx"), F.col("ord").cast("long").alias("ord"), "line_text", F.coalesce("line_score", F.lit(1.0)).alias("line_score"), F.coalesce("box_area_ratio", F.lit(0.0)).alias("area_ratio"))
