"""Entry points: browse containers, describe images, measure, preview and convert them."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import images, linked, metadata, mosaic, tree
from lumaframe.sinks import copies, lif, preview, tiff, zarr
from lumaframe.sinks.preview_cache import PreviewCache
from lumaframe.sources import containers, pixels, plane_source, schema

FORMATS = {"ome-tiff": "tiff", "ometiff": "tiff", "ome.tiff": "tiff", "tiff": "tiff", "ome-zarr": "zarr", "omezarr": "zarr", "ome.zarr": "zarr", "zarr": "zarr", "lif": "lif"}


class Library:
    """The containers below a path. Tables are built once and kept until the library is closed."""

    def __init__(self, spark: SparkSession, path: str, seek: bool | None = None, store: str | None = None, ome_schema: str | None = None) -> None:
        self.spark, self.store, self.ome_schema = spark, store, ome_schema
        self._rules: dict | None = None
        self.found = containers.containers(spark, path, seek, store).cache()
        self.nodes = containers.xml_nodes(self.found).cache()
        self.blocks = containers.memory_blocks(self.found)
        self._described: DataFrame | None = None

    def rules(self) -> dict:
        """What the schema given for descriptions, with all it includes, lists for attributes; nothing without one."""
        if self._rules is None:
            self._rules = schema.rules(schema.allowed(schema.closure(self.spark, self.ome_schema))) if self.ome_schema else {}
        return self._rules

    def close(self) -> None:
        """Let go of the tables that are kept."""
        for table in (self.found, self.nodes, self._described):
            if table is not None:
                table.unpersist()

    def __enter__(self) -> Library:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def children(self, uuid: str | None = None) -> DataFrame:
        return images.children(self.nodes, uuid)

    def list_images(self) -> DataFrame:
        return images.list_images(self.nodes)

    def every_image(self) -> DataFrame:
        """All images of all files, through links, in the order of a walk through each project."""
        return linked.every_image(self.nodes, containers.links(self.nodes)).orderBy("root", "order")

    def images(self) -> DataFrame:
        """The whole description of all images, described once."""
        if self._described is None:
            wide = metadata.shown(metadata.summary_text(metadata.describe(self.nodes, self.found, self.blocks)))
            self._described = tree.settled(images.route(images.key_values(wide)))
        return self._described

    def image(self, uuid: str) -> DataFrame:
        return self.images().where(F.col("uuid") == uuid)

    def save_planes(self, folder: str) -> None:
        """Write the index of all planes that ``planes`` reads."""
        plane_source.save_index(pixels.planes(self.images()), folder)

    def planes(self, folder: str, **options) -> DataFrame:
        """Bands of planes by an index, as a data source that conditions on uuid, t, c, z, s and y0 are pushed into."""
        plane_source.register(self.spark)
        own = {"store": self.store} if self.store else {}
        return self.spark.read.format(plane_source.NAME).options(**own, **options).load(folder)

    def stats(self, share: float = 0.1) -> DataFrame:
        return pixels.channel_stats(self.images(), share, self.store)

    def previews(self, height: int = 256, cache: PreviewCache | None = None, **options) -> DataFrame:
        """A PNG of each image; with a cache, from its files where it has them."""
        if cache is not None:
            return cache.get(self.images(), height, store=self.store, **options)
        return preview.previews(self.images(), height, store=self.store, **options)

    def convert(self, uuid: str, folder: str, output: str = "ome-tiff", threshold: int = 3192, always: bool = False, other_folder: str | None = None, with_metadata: bool = False, with_xml: bool = False, compression: str | None = None) -> str:
        """Write one image to a folder that every executor mounts; the result envelope as JSON, "[]" if there is no such image
        or none that can be written.

        Planes are turned as the settings say and mosaics put together. Small images of linked
        containers stay as they are, and mosaics with gaps become containers of their own, unless
        ``always`` is set. ``other_folder``: the result is copied there too, by ranges that are compared, over what is there.
        ``with_metadata``, ``with_xml``: the description as JSON and the container's XML go along. ``compression``: for tiled files "deflate"
        (if nothing is said), "lzw" or "none", for arrays "blosc" (if nothing is said) or "zlib".
        """
        kind = FORMATS[output.lower()]
        wide = metadata.reject_reason(images.route(self.image(uuid), threshold)).cache()
        row = wide.first()
        if row is None:
            return "[]"
        image = row.asDict(True) | {"schema_rules": self.rules()}
        route = "planar" if always and kind != "lif" else "single lif" if kind == "lif" else image["route"]
        if image["reject_reason"] and not (image["reject_reason"] == "gaps between tiles" and (always or route in ("single lif", "as it is"))):
            return "[]"
        base = f"{folder}/{image['save_child_name'].replace('/', '_')}"
        os.makedirs(folder, exist_ok=True)
        source = self.found.where(F.col("path") == image["path"]).select("xml").first()
        if route == "as it is":
            target = containers.local(image["path"])
        elif route == "single lif":
            target = lif.write_single(wide, self.found, folder, self.store).first().file
        else:
            target = self._write(wide, image, base, kind, source.xml if source else None, compression)
        if other_folder and route != "as it is":
            os.makedirs(other_folder, exist_ok=True)
            copy = f"{other_folder}/{os.path.basename(target)}"
            copies.copy(self.spark, target, copy)
        measured = metadata.intensities(wide, pixels.channel_stats(wide, store=self.store))
        values = [F.col("channel_mins"), F.col("channel_maxs"), F.col("display_black").alias("channel_display_black_values"), F.col("display_white").alias("channel_display_white_values"), F.col("keyvalues").alias("metadata")]
        if with_metadata:
            values.append(F.to_json(F.struct(*[c for c in wide.columns if c not in ("keyvalues", "reject_reason")])).alias("image_metadata_json"))
        if with_xml:
            values.append(F.lit(source.xml if source else None).alias("image_xml"))
        envelope = F.struct(F.col("save_child_name").alias("name"), F.lit(target).alias("full_path"), *([F.lit(copy).alias("alt_path")] if other_folder and route != "as it is" else []), F.array(F.struct(*values)).alias("keyvalues"))
        result = measured.select(F.to_json(F.array(envelope)).alias("j")).first().j
        wide.unpersist()
        return result

    def _write(self, wide: DataFrame, image: dict, base: str, kind: str, xml: str | None, compression: str | None) -> str:
        bands = pixels.chunks(pixels.planes(wide, stored=True), store=self.store)
        plan = mosaic.layout(wide).first()
        if plan.fields or plan.flipx or plan.flipy or plan.swap:
            bands = mosaic.assemble(bands, wide)
            image |= {"xs": plan.width, "ys": plan.height}
        if kind == "zarr":
            measured = metadata.windows(wide, pixels.channel_stats(wide, 0.05, self.store))
            image["windows"] = {r.c: (r.low, r.high) for r in measured.collect()}  # a row for each channel
            zarr.write_zarr(bands, image, f"{base}.ome.zarr", xml, compression or "blosc")
            return f"{base}.ome.zarr"
        levels = tiff.pyramid(bands, image["xs"], image["ys"])
        tiff.write_or_store(levels, image | {"tile_w": plan.tile_w, "tile_h": plan.tile_h}, f"{base}.ome.tiff", xml, compression or "deflate")
        for level in levels:
            level.unpersist()
        return f"{base}.ome.tiff"

    def write(self, uuid: str, folder: str, output: str, colour: bool | None = None, compression: str | None = None) -> str | None:
        """Write one image as it is told, whatever its container or size; the path, or nothing for an image that can't be written.

        ``colour``: only a colour image (True), or only another (False).
        """
        row = metadata.reject_reason(self.image(uuid), colour).select("reject_reason").first()
        if row is None or row.reject_reason:
            return None
        said = json.loads(self.convert(uuid, folder, output, always=True, compression=compression))
        return said[0]["full_path"] if said else None

    def search(self, top: str, uuid: str) -> DataFrame:
        """(path, depth, name): the nearest file that a project file reaches whose first element has an id."""
        return linked.search(self.nodes, containers.links(self.nodes), top, uuid)

    def convert_all(self, uuids: list[str], folder: str, output: str = "ome-tiff", together: int = 4, **options) -> dict[str, str]:
        """Results by id. So many images are written at the same time, so that a small one doesn't leave executors without work."""
        self.images()  # described once, for all
        with ThreadPoolExecutor(together) as pool:
            return dict(zip(uuids, pool.map(lambda uuid: self.convert(uuid, folder, output, **options), uuids), strict=True))
