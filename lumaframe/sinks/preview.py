"""Previews: the middle plane of each image, few rows read, blended, stretched and written as PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.scalar import COLOURS
from lumaframe.sources import pixels


def encode_png(rgb: np.ndarray) -> bytes:
    """An (h, w, 3) array of bytes as PNG."""
    h, w = rgb.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 6)) + part(b"IEND", b"")


def area_means(a: np.ndarray, m: int) -> np.ndarray:
    """m means over equal stretches of the first axis, whatever pixels their edges cut: differences of running sums."""
    n = len(a)
    edge = np.linspace(0, n, m + 1)
    at = np.minimum(edge.astype(np.int64), n - 1)
    sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0, dtype=np.float64)])
    upto = sums[at] + (edge - at).reshape(-1, *[1] * (a.ndim - 1)) * a[at]
    return np.diff(upto, axis=0) * (m / n)


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the areas that new pixels cover."""
    return area_means(area_means(a, h).T, w).T


def render(planes: list[np.ndarray], colours: list[int], height: int) -> np.ndarray:
    """Channels in their colours, added, cut at the type's top and stretched between two percentiles, as (h, w, 3) bytes."""
    top = float(np.iinfo(planes[0].dtype).max)
    h = min(height, planes[0].shape[0])
    w = max(1, round(planes[0].shape[1] * h / planes[0].shape[0]))
    total = np.zeros((h, w, 3))
    for plane, colour in zip(planes, colours, strict=True):
        small = area_resize(plane, h, w)
        total += small[:, :, None] * (np.array([colour >> 16 & 255, colour >> 8 & 255, colour & 255]) / 255)
    total = np.minimum(total, top)
    low, high = np.percentile(total, [0.01, 99.9])
    share = np.clip((total - low) / (high - low), 0, 1) if high > low else np.zeros_like(total)
    return (share * 255).astype(np.uint8)


def previews(wide: DataFrame, height: int = 256, plane: dict[str, int] | None = None, channels: list[int] | None = None, store: str | None = None) -> DataFrame:
    """(uuid, height, png) of each image: the middle plane, or the one that ``plane`` names by t, z and s; of all channels or those given.

    So many rows are skipped that a plane stays within about twice the height and the group of an
    image is as small as its preview, whatever the image's size. An image that can't be drawn at this
    height is drawn at its own.
    """
    steps = F.greatest(F.lit(1), F.floor(F.col("ys") / (2 * height))).cast("int")
    wanted = pixels.planes(wide.withColumn("step", steps), plane is None)
    for axis, at in (plane or {}).items():
        wanted = wanted.where(F.col(axis) == at)
    if channels is not None:
        wanted = wanted.where(F.col("c").isin(channels) | (F.col("samples") == 3))
    parts = pixels.chunks(wanted, store=store)
    luts = wide.select(F.col("uuid").alias("_u"), F.col("lutname"), F.col("ys").alias("full"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        names = list(first["lutname"]) if first["lutname"] is not None else []
        planes, colours = [], []
        for c, own in rows.sort_values(["c", "y0"]).groupby("c"):
            a = np.concatenate([pixels.array_of(r) for _, r in own.iterrows()])
            planes += [a] if a.ndim == 2 else list(np.moveaxis(a, 2, 0))
            colours += [COLOURS.get(names[c] if c < len(names) else "", 0xFFFFFF)] if a.ndim == 2 else [0xFF0000, 0x00FF00, 0x0000FF]
        return pd.DataFrame({"uuid": [first["uuid"]], "height": [height], "png": [encode_png(render(planes, colours, height))]})

    joined = parts.join(luts, parts["uuid"] == luts["_u"]).drop("_u")
    return joined.groupBy("uuid").applyInPandas(draw, "uuid string, height int, png binary")


#: Heights of previews that are shown one after the other, and the side up to which an image has the greatest only.
HEIGHTS, SMALL = (24, 100, 200), 2048


def heights(width: Column, height: Column) -> Column:
    """The heights at which an image is drawn, ascending: small images at once, large ones finer and finer."""
    return F.when((width <= SMALL) & (height <= SMALL), F.array(F.lit(HEIGHTS[-1]))).otherwise(F.array(*map(F.lit, HEIGHTS)))


def progressive(wide: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(height, previews) from coarse to fine, each for the images that are drawn at that height; whoever has seen enough takes no more."""
    for height in HEIGHTS:
        yield height, previews(wide.where(F.array_contains(heights(F.col("xs"), F.col("ys")), height)), height)


def latest_jobs(requests: DataFrame) -> DataFrame:
    """Of requests (uuid, job_id, ...) those of each image's newest job: what a viewer has moved on from is not drawn."""
    newest = requests.groupBy(F.col("uuid").alias("_u")).agg(F.max("job_id").alias("_job"))
    return requests.join(newest, (requests["uuid"] == newest["_u"]) & (requests["job_id"] == newest["_job"])).drop("_u", "_job")


def as_base64(drawn: DataFrame) -> DataFrame:
    """(uuid, height, url): previews as data URLs."""
    return drawn.select("uuid", "height", F.concat(F.lit("data:image/png;base64,"), F.base64("png")).alias("url"))
