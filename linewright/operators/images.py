"""Image variants: geometry as expressions over sizes, pixels as an optional numpy stage over decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import CROPS

#: The offline variants: name, (x1, y1, x2, y2) in shares of the size or None, long side to enlarge to, pixel step
OFFLINE = [
    ("raw", None, None, None), ("resize_960", None, 960, None), ("resize_1280", None, 1280, None), ("clahe", None, 960, "clahe"), ("autocontrast", None, 960, "autocontrast"), ("sharpen", None, 960, "sharpen"), ("grayscale", None, 960, "grayscale"), ("invert", None, 960, "invert"), ("auto_invert", None, 960, "auto_invert"),
    ("top_45_resize_960", (0.0, 0.0, 1.0, 0.45), 960, None), ("bottom_45_resize_960", (0.0, 0.55, 1.0, 1.0), 960, None), ("center_60_resize_960", (0.0, 0.2, 1.0, 0.8), 960, None), ("left_55_resize_960", (0.0, 0.0, 0.55, 1.0), 960, None), ("right_55_resize_960", (0.45, 0.0, 1.0, 1.0), 960, None),
]


def fitted(w: Column, h: Column, long_side: Column) -> tuple[Column, Column]:
    """Size after scaling the long side to a target, up or down, cut to whole pixels."""
    scale = long_side / F.greatest(w, h)
    same = F.greatest(w, h) == long_side
    size = lambda x: F.when(same, x).otherwise(F.greatest(F.lit(1), F.floor(x * scale))).cast("int")
    return size(w), size(h)


def enlarged(w: Column, h: Column, long_side: Column, shrink: bool = False) -> tuple[Column, Column]:
    """Size after scaling to a target, rounded half to even; larger images stay unless ``shrink``."""
    scale = long_side / F.greatest(w, h)
    keep = F.lit(False) if shrink else F.greatest(w, h) >= long_side
    size = lambda x: F.when(keep, x).otherwise(F.greatest(F.lit(1), F.bround(x * scale, 0))).cast("int")
    return size(w), size(h)


def band(h: Column, top: Column, bottom: Column) -> tuple[Column, Column]:
    """Rows of a band, cut to whole pixels; an empty band is the whole."""
    clip = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    a, b = F.floor(clip(top) * h).cast("int"), F.floor(clip(bottom) * h).cast("int")
    return F.when(b > a, a).otherwise(F.lit(0)), F.when(b > a, b).otherwise(h)


def rounded_band(h: Column, top: Column, bottom: Column) -> tuple[Column, Column]:
    """Rows of a band, rounded, one at least; an inverted band is the whole."""
    clip = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    bad = clip(bottom) <= clip(top)
    a, b = F.when(bad, 0.0).otherwise(clip(top)), F.when(bad, 1.0).otherwise(clip(bottom))
    y1 = F.greatest(F.lit(0), F.least(h - 1, F.bround(h * a, 0).cast("int")))
    return y1, F.greatest(y1 + 1, F.least(h, F.bround(h * b, 0).cast("int")))


def side_crop(w: Column, h: Column, side: str, ratio: float) -> tuple[Column, Column, Column, Column]:
    """x1, y1, x2, y2 of the top, bottom, center, left or right share of an image; shares below 0.05 or over 1 are clipped."""
    ratio = max(0.05, min(1.0, ratio))
    part = lambda x, r: F.bround(x * F.lit(r), 0).cast("int")
    zero = F.lit(0)
    if side == "top":
        return zero, zero, w, F.greatest(F.lit(1), part(h, ratio))
    if side == "bottom":
        return zero, F.least(h - 1, part(h, 1.0 - ratio)), w, h
    if side == "left":
        return zero, zero, F.greatest(F.lit(1), part(w, ratio)), h
    if side == "right":
        return F.least(w - 1, part(w, 1.0 - ratio)), zero, w, h
    tall = F.greatest(F.lit(1), F.least(h, part(h, ratio)))
    y1 = F.greatest(zero, F.floor((h - tall) / 2).cast("int"))
    return zero, y1, w, F.least(h, y1 + tall)


def live_geometry(df: DataFrame, keys: list[str], crops=CROPS) -> DataFrame:
    """Band and size of every live variant of images with width and height."""
    table = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(a).alias("top"), F.lit(b).alias("bottom"), F.lit(s).alias("side")) for n, a, b, s in crops))
    rows = df.select(*keys, "width", "height", F.explode(table).alias("v"))
    y1, y2 = band(F.col("height"), F.col("v.top"), F.col("v.bottom"))
    rows = rows.select(*keys, F.col("v.variant").alias("variant"), "width", y1.alias("y1"), y2.alias("y2"), "v.side")
    w, h = fitted(F.col("width"), F.col("y2") - F.col("y1"), F.col("side"))
    return rows.select(*keys, "variant", "y1", "y2", w.alias("out_width"), h.alias("out_height"))


QUALITY = "width int, height int, long_side int, short_side int, mean_brightness double, contrast_std double, blur_laplacian_var double, dark_pixel_ratio double"


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114)


def quality_of(rgb: np.ndarray) -> dict:
    """Brightness, contrast, sharpness (variance of the Laplacian, edges mirrored) and share of dark pixels."""
    g = gray(rgb.astype(np.float64))
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    h, w = g.shape
    return {"width": w, "height": h, "long_side": max(w, h), "short_side": min(w, h), "mean_brightness": float(g.mean()), "contrast_std": float(g.std()), "blur_laplacian_var": float(laplace.var()), "dark_pixel_ratio": float((g < 70).mean())}


def inverted(rgb: np.ndarray) -> np.ndarray:
    return 255 - rgb


def inverted_if_dark(rgb: np.ndarray, dark: float = 0.55, mean: float = 105.0) -> np.ndarray:
    q = quality_of(rgb)
    return inverted(rgb) if q["dark_pixel_ratio"] >= dark and q["mean_brightness"] <= mean else rgb


def grayscale(rgb: np.ndarray) -> np.ndarray:
    return np.repeat(gray(rgb.astype(np.float64)).astype(np.uint8)[..., None], 3, axis=2)


def autocontrast(rgb: np.ndarray, cutoff: float = 1.0) -> np.ndarray:
    """Each channel stretched between its lowest and highest values after leaving out ``cutoff`` percent at both ends."""
    out = rgb.copy()
    for c in range(3):
        low, high = np.percentile(rgb[..., c], [cutoff, 100 - cutoff])
        if high > low:
            out[..., c] = np.clip((rgb[..., c].astype(np.float64) - low) * 255 / (high - low), 0, 255).astype(np.uint8)
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id and image of a folder, decoded in the JVM."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.regexp_extract("image.origin", r"([^/]+)\.[A-Za-z]+$", 1).alias("image_id"), "image")


def image_quality(images: DataFrame) -> DataFrame:
    """The quality record of each image (image_id, image)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.itertuples():
                bgr = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                made.append({"image_id": r.image_id, **quality_of(bgr[..., 2::-1] if r.channels >= 3 else np.repeat(bgr, 3, axis=2))})
            if made:
                yield pd.DataFrame(made)

    flat = images.select("image_id", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return flat.mapInPandas(measure, "image_id string, " + QUALITY)
