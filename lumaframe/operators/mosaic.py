"""Mosaics and orientation: tiles and flipped planes as bands of one canvas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.sources.pixels import BAND, CHUNK_KINDS, CHUNKS, array_of

PIECES = "uuid string, t int, c int, z int, band int, place int, y int, x int, h int, w int, height int, width int, samples int, dtype string, data binary"
_KINDS = {"uuid": pa.string(), "dtype": pa.string(), "data": pa.binary()}


def grid_size(field: str) -> Column:
    """Columns or rows of a mosaic: the greatest field number and one."""
    return F.array_max(F.transform("tile_positions", lambda p: F.coalesce(p[field], F.lit(0)))) + 1


def canvas_side(fields: Column, size: Column, overlap: Column, whole_steps: bool = False) -> Column:
    """Length of a canvas. ``whole_steps``: fields side by side, whatever their overlap (a margin stays empty then)."""
    if whole_steps:
        return (fields * size).cast("int")
    return F.when(fields <= 1, size).otherwise(F.floor((fields - 1) * (size * (1 - overlap)) + size)).cast("int")


def layout(wide: DataFrame, whole_steps: bool = False) -> DataFrame:
    """(uuid, slot and canvas sizes, flips, overlaps, fields by tile): one row for each image.

    Tiles have flips of their own; single images those of the instrument. Slots have the sizes that
    the description gives.
    """
    tiled = (F.coalesce("tiles", F.lit(1)) > 1) & (F.coalesce(F.size("tile_positions"), F.lit(0)) > 0)
    flag = lambda own, tile: F.coalesce(F.when(tiled, F.col(tile)).otherwise(F.col(own)), F.lit(0)) != 0
    have = wide.columns
    for c in ("flipx", "flipy", "swapxy", "tilescan_flipx", "tilescan_flipy", "tilescan_swapxy", "OverlapPercentageX", "OverlapPercentageY"):
        if c not in have:
            wide = wide.withColumn(c, F.lit(None).cast("double"))
    over = {a: F.when(tiled, F.coalesce(F.col(f"OverlapPercentage{a}"), F.lit(0.0))).otherwise(F.lit(0.0)) for a in "XY"}
    side = lambda a, n: F.when(tiled, canvas_side(grid_size(f"Field{a}"), F.col(n), over[a], whole_steps)).otherwise(F.col(n)).cast("int")
    fields = F.when(tiled, F.transform(F.array_sort("tile_positions"), lambda p: F.struct(F.coalesce(p["FieldX"], F.lit(0)).alias("x"), F.coalesce(p["FieldY"], F.lit(0)).alias("y"))))
    return wide.select(
        F.col("uuid").alias("_uuid"), F.col("xs").alias("slot_w"), F.col("ys").alias("slot_h"), side("X", "xs").alias("width"), side("Y", "ys").alias("height"),
        flag("flipx", "tilescan_flipx").alias("flipx"), flag("flipy", "tilescan_flipy").alias("flipy"), flag("swapxy", "tilescan_swapxy").alias("swap"),
        over["X"].alias("over_x"), over["Y"].alias("over_y"), fields.alias("fields"),
    ).withColumns({"tile_w": scalar.tile_side(F.lit(BAND), F.col("width")), "tile_h": scalar.tile_side(F.lit(BAND), F.col("height"))})


def turned(a: np.ndarray, y0: int, rows: int, flipx: bool, flipy: bool, swap: bool) -> tuple[np.ndarray, int, int]:
    """A band that begins at row ``y0`` of ``rows``, flipped and then transposed, with the place (y, x) where it begins in the slot."""
    y = rows - y0 - len(a) if flipy else y0
    a = a[::-1] if flipy else a
    a = a[:, ::-1] if flipx else a
    return (a.swapaxes(0, 1), 0, y) if swap else (a, y, 0)


def assemble(bands: DataFrame, wide: DataFrame, whole_steps: bool = False) -> DataFrame:
    """Bands of whole canvases from bands of tiles as the file has them: flipped, placed by their fields, later tiles above earlier ones.

    Where settings say that axes are swapped, planes are read with their extents exchanged
    (``planes(..., stored=True)``); a tile that doesn't fit its slot then is an error. What no tile
    covers is zero. A group holds the pieces of one band of one plane.
    """
    plans = layout(wide, whole_steps)
    joined = bands.join(plans, bands["uuid"] == plans["_uuid"]).drop("_uuid")
    names = [f.split()[0] for f in PIECES.split(", ")]
    schema = pa.schema([(n, _KINDS.get(n, pa.int32())) for n in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                same = {k: r[k] for k in ("uuid", "t", "c", "z", "samples", "dtype", "width", "height")}
                rows = []
                if r["s"] == 0 and r["y0"] == 0:  # so that a band without a tile is there too
                    rows += [same | {"band": k, "place": -1, "y": 0, "x": 0, "h": 0, "w": 0, "data": b""} for k in range(-(-r["height"] // BAND))]
                stored = r["slot_w"] if r["swap"] else r["slot_h"]
                a, y, x = turned(array_of(r), r["y0"], stored, r["flipx"], r["flipy"], r["swap"])
                if (a.shape[0] if r["swap"] else a.shape[1]) != (r["slot_h"] if r["swap"] else r["slot_w"]):
                    raise ValueError(f"tile {r['s']} of {r['uuid']} doesn't fit its slot")
                if r["fields"]:
                    if r["s"] >= len(r["fields"]):
                        continue  # a tile without a place
                    field = r["fields"][r["s"]]
                    y += int(field["y"] * (r["slot_h"] * (1 - r["over_y"])))
                    x += int(field["x"] * (r["slot_w"] * (1 - r["over_x"])))
                a = a[: max(0, r["height"] - y), : max(0, r["width"] - x)]
                at = 0
                while at < len(a) and a.shape[1]:
                    band = (y + at) // BAND
                    part = np.ascontiguousarray(a[at : (band + 1) * BAND - y])
                    rows.append(same | {"band": band, "place": r["s"], "y": y + at, "x": x, "h": part.shape[0], "w": part.shape[1], "data": part.tobytes()})
                    at += len(part)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def paste(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        y0 = int(first["band"]) * BAND
        out = np.zeros((min(BAND, int(first["height"]) - y0), int(first["width"]), int(first["samples"])), first["dtype"])
        for _, r in rows[rows["place"] >= 0].sort_values(["place", "y", "x"]).iterrows():
            part = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["samples"])
            out[r["y"] - y0 : r["y"] - y0 + r["h"], r["x"] : r["x"] + r["w"]] = part
        row = {k: [first[k]] for k in ("uuid", "t", "c", "z", "samples", "dtype")} | {"s": [0], "y0": [y0], "h": [out.shape[0]], "w": [out.shape[1]], "step": [1], "data": [out.tobytes()]}
        return pd.DataFrame(row)[[f.name for f in CHUNK_KINDS]]

    return joined.mapInArrow(cut, PIECES).groupBy("uuid", "t", "c", "z", "band").applyInPandas(paste, CHUNKS)
