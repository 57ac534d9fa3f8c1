"""Grey-level operators of image preparation.

Histograms are tables (image_id, level, n) and their statistics plain aggregates over at most 256 levels an image; only the
change of pixels itself runs in Python, over whole images as bytes (RGBA). Empty images: mean 255, percentile 255, threshold 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Most pixels of a prepared image, width below which it is doubled, mean grey of a dark page, least range to stretch.
MOST_PIXELS, SMALL_WIDTH, DARK_MEAN, LEAST_RANGE = 12_000_000, 1000, 110, 10
PREPARED = "pixels binary, inverted boolean, threshold int"


def choose_scale(width: Column, height: Column, wanted: Column | None = None) -> Column:
    """2 for narrow images, else 1 (or what is wanted), shrunk to two decimals where the result would be too large."""
    scale = F.when(width < SMALL_WIDTH, 2.0).otherwise(1.0) if wanted is None else wanted
    area = width.cast("double") * height
    return F.when(area * scale * scale <= MOST_PIXELS, scale).otherwise(F.floor(F.sqrt(F.lit(float(MOST_PIXELS)) / area) * 100) / 100)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return F.floor((red * 299 + green * 587 + blue * 114) / 1000).cast("int")


def histogram(levels: DataFrame, key: str = "image_id", level: str = "level") -> DataFrame:
    return levels.groupBy(key, level).agg(F.count("*").alias("n"))


def mean_level(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, mean, is_dark)."""
    mean = F.coalesce(F.sum(F.col("level") * F.col("n")) / F.sum("n"), F.lit(255.0))
    return hist.groupBy(key).agg(mean.alias("mean"), (mean < DARK_MEAN).alias("is_dark"))


def inverted(hist: DataFrame) -> DataFrame:
    return hist.withColumn("level", 255 - F.col("level"))


def percentile_level(hist: DataFrame, fraction: float, key: str = "image_id") -> DataFrame:
    """(key, level): the first level by which that share of the pixels is seen."""
    by = Window.partitionBy(key)
    seen = hist.withColumn("_seen", F.sum("n").over(by.orderBy("level"))).withColumn("_all", F.sum("n").over(by))
    return seen.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_seen") >= F.col("_all") * F.lit(fraction), F.col("level"))), F.lit(255)).alias("level"))


def otsu(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, threshold): the first level that best separates two classes of grey."""
    by = Window.partitionBy(key)
    upto = by.orderBy("level")
    mass = F.col("level") * F.col("n")
    sums = hist.select(
        key, "level", F.sum("n").over(upto).cast("double").alias("below"), F.sum("n").over(by).cast("double").alias("all"), F.sum(mass).over(upto).cast("double").alias("mass"), F.sum(mass).over(by).cast("double").alias("total")
    )
    above = F.col("all") - F.col("below")
    apart = F.col("mass") / F.col("below") - (F.col("total") - F.col("mass")) / above
    between = F.when((F.col("below") > 0) & (above > 0), F.col("below") * above * (apart * apart))
    best = F.max(F.struct(between.alias("v"), (-F.col("level")).alias("l")))
    return sums.groupBy(key).agg(best.alias("b")).select(key, F.when(F.col("b.v").isNull(), 0).otherwise(-F.col("b.l")).cast("int").alias("threshold"))


def _along(values: np.ndarray, size: int) -> np.ndarray:
    """Area sums along the first axis, in `size` equal parts: each counts its share of a value times `size`, so weights add up to the old length."""
    n = len(values)
    upto = np.zeros((n + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=upto[1:])
    whole, part = np.divmod(np.arange(size + 1, dtype=np.int64) * n, size)
    edge = upto[whole] * size
    inner = part > 0
    edge[inner] += values[whole[inner]] * part[inner].reshape(-1, *[1] * (values.ndim - 1))
    return np.diff(edge, axis=0)


def resized(data: bytes, width: int, height: int, new_width: int, new_height: int) -> bytes:
    """RGBA bytes in another size: each pixel is the mean of the area it covers, rounded half up, in integers throughout.

    One axis after the other, by running sums, so the work is linear in the pixels of both sizes. The canvas of a browser
    smooths in its own way, which no two browsers share; means of areas are what its high quality setting comes near to.
    """
    before, out = np.frombuffer(data, np.uint8).reshape(height, width, 4), np.empty((new_height, new_width, 4), np.uint8)
    area = width * height
    for channel in range(4):
        sums = _along(_along(before[:, :, channel], new_height).T, new_width).T
        out[:, :, channel] = (2 * sums + area) // (2 * area)
    return out.tobytes()


def _scaled(data: bytes, width: int, height: int, wanted: float | None) -> tuple[bytes, int, int, float]:
    """An image in the size that choose_scale gives, at least one pixel each way, with that size and the scale."""
    scale = wanted if wanted is not None else 2.0 if width < SMALL_WIDTH else 1.0
    if width * height * scale * scale > MOST_PIXELS:
        scale = math.floor(math.sqrt(MOST_PIXELS / (width * height)) * 100) / 100
    wide, high = (max(1, math.floor(n * scale + 0.5)) for n in (width, height))
    return (data if (wide, high) == (width, height) else resized(data, width, height, wide, high)), wide, high, scale


def _prepare(data: bytes, invert: str, stretch: bool, binarize: bool) -> tuple[bytes, bool, int | None]:
    rgba = np.frombuffer(data, np.uint8).reshape(-1, 4).copy()
    grey = (rgba[:, :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)
    dark = invert == "on" or (invert == "auto" and len(grey) > 0 and grey.mean() < DARK_MEAN)
    grey = 255 - grey if dark else grey
    if stretch and len(grey):
        seen = np.bincount(grey, minlength=256).cumsum()
        low, high = (int(np.argmax(seen >= len(grey) * f)) for f in (0.01, 0.99))
        if high - low >= LEAST_RANGE:
            grey = np.clip((grey.astype(float) - low) * (255 / (high - low)), 0, 255).astype(np.uint8)
    cut = None
    if binarize:
        n, level = np.bincount(grey, minlength=256).astype(float), np.arange(256)
        below, mass = n.cumsum(), (n * level).cumsum()
        with np.errstate(divide="ignore", invalid="ignore"):
            above = below[-1] - below
            spread = np.where((below > 0) & (above > 0), below * above * (mass / below - (mass[-1] - mass) / above) ** 2, -1)
        cut = int(spread.argmax()) if spread.max() >= 0 else 0
        grey = np.where(grey > cut, 255, 0).astype(np.uint8)
    rgba[:, :3] = grey[:, None]
    return rgba.tobytes(), bool(dark), cut


def prepare(images: DataFrame, pixels: str = "pixels", invert: str = "auto", stretch: bool = True, binarize: bool = False) -> DataFrame:
    """images with `prepared` (PREPARED): grey, dark text on a light ground, optionally stretched and black and white. Null stays null."""

    @F.pandas_udf(PREPARED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(None, None, None) if x is None else _prepare(x, invert, stretch, binarize) for x in batch]
            yield pd.DataFrame(rows, columns=["pixels", "inverted", "threshold"]).astype({"threshold": "Int32", "inverted": "boolean"})

    return images.withColumn("prepared", run(F.col(pixels)))
