"""Operators on pixel arrays: tone and histograms as column expressions; blurs and homographies with numpy, an Arrow batch
of images at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tone(pixels: Column, exposure: float, contrast: float) -> Column:
    """Gray levels times 2^exposure, spread about 128, rounded and kept within 0..255."""
    gain = 2.0**exposure
    return F.transform(pixels, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((v * gain - 128.0) * contrast + 128.0 + 0.5).cast("double"))))


def histogram(images: DataFrame, key: str = "image_id", pixels: str = "pixels") -> DataFrame:
    """image_id, level, n."""
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor("v"))).cast("int")
    return images.select(key, F.explode(pixels).alias("v")).groupBy(key, level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def auto_levels(images: DataFrame, clip: float = 0.01, key: str = "image_id", pixels: str = "pixels") -> DataFrame:
    """Each image stretched so that all but a share `clip` at either end fills 0..255."""
    n = F.size(pixels)
    ordered = F.array_sort(pixels)
    low, high = F.get(ordered, F.floor(n * clip).cast("int")), F.get(ordered, F.ceil(n * (1 - clip)).cast("int") - 1)
    stretched = F.when(high > low, F.transform(pixels, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - low) * 255.0 / (high - low))))).otherwise(F.col(pixels))
    return images.withColumn(pixels, stretched)


def box_blur(images: DataFrame, radius: int, key: str = "image_id") -> DataFrame:
    """images(image_id, width, pixels): the mean over a square of 2 radius + 1, cut at the borders; running sums, so the
    work doesn't grow with the radius."""

    def blurred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["pixels"] = [_blur(np.asarray(p, float).reshape(-1, w), radius).ravel() for p, w in zip(batch["pixels"], batch["width"])]
            yield batch

    return images.select(key, "width", "pixels").mapInPandas(blurred, f"{key} long, width int, pixels array<double>")


def _blur(image: np.ndarray, radius: int) -> np.ndarray:
    for axis in (0, 1):
        n = image.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis)], axis)
        low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
        counts = (high - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
        image = (np.take(sums, high, axis) - np.take(sums, low, axis)) / counts
    return image


def homographies(quads: DataFrame) -> DataFrame:
    """quads(quad_id, src, dst), each four points as eight numbers x1, y1, ...: the nine numbers of the projective map, and
    null where there is none. All systems of a batch are solved together."""

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for src, dst in zip(batch["src"], batch["dst"]):
                s, d = np.asarray(src, float).reshape(4, 2), np.asarray(dst, float).reshape(4, 2)
                zero, one = np.zeros((4, 3)), np.column_stack((s, np.ones(4)))
                a = np.concatenate([np.column_stack((one, zero, -s * d[:, :1])), np.column_stack((zero, one, -s * d[:, 1:]))])
                try:
                    out.append([*np.linalg.solve(a, np.concatenate((d[:, 0], d[:, 1]))).tolist(), 1.0])
                except np.linalg.LinAlgError:
                    out.append(None)
            yield pd.DataFrame({"quad_id": batch["quad_id"], "h": out})

    return quads.mapInPandas(solved, "quad_id long, h array<double>")


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    point = lambda k: F.when(w == 0, 0.0).otherwise(F.try_divide(h[k] * x + h[k + 1] * y + h[k + 2], w))
    return point(0), point(3)
