"""Linked containers: which files a file reaches, in what order, and where an image's pixels lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import images, relational, tree
from lumaframe.sources import containers


def reach(links: DataFrame, top: str) -> DataFrame:
    """(path, depth): the files that ``top`` reaches, breadth first; the visited ones are joined away, so cycles end."""
    seen = frontier = links.sparkSession.createDataFrame([(top, 0)], "path string, depth int")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = links.where("target IS NOT NULL").join(frontier, "path", "left_semi").select(F.col("target").alias("path"), F.lit(depth).alias("depth")).distinct()
        frontier = tree.settled(step.join(seen, "path", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def search(nodes: DataFrame, links: DataFrame, top: str, uuid: str) -> DataFrame:
    """The nearest file below ``top`` whose first element has an id: (path, depth, name), one row or none."""
    roots = images.elements(nodes).where("parent_element IS NULL").select("path", "name", "uuid")
    return reach(links, top).join(roots.where(F.col("uuid") == uuid), "path").orderBy("depth", "path").limit(1).select("path", "depth", "name")


def list_links(nodes: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """The references of one file with a summary of what they name; a missing file has a row of defaults."""
    roots = images.elements(nodes).where("parent_element IS NULL").select(F.col("path").alias("_p"), "name", "is_image")
    dims = images.dimensions(nodes).select(F.col("path").alias("_d"), "xs", "ys", "zs", "ts", "tiles")
    kinds = images.channels(nodes).select(F.col("path").alias("_c"), "channels", "isrgb")
    pixels = pixel_files(nodes).select(F.col("path").alias("_f"), F.col("pixel_path").alias("lof"))
    own = links.where(F.col("path") == path)
    for part, key in ((roots, "_p"), (dims, "_d"), (kinds, "_c"), (pixels, "_f")):
        own = own.join(part, own["target"] == part[key], "left")
    filled = [F.coalesce(c, F.lit(1)).alias(c) for c in ("zs", "ts", "tiles", "channels")]
    return own.where(~F.lower(F.coalesce("name", F.lit(""))).startswith("iomanager")).select("ordinal", "target", "uuid", "name", "is_image", "xs", "ys", *filled, F.coalesce("isrgb", F.lit(False)).alias("isrgb"), "lof").orderBy("ordinal")


def pixel_files(nodes: DataFrame) -> DataFrame:
    """(path, pixel_path): the first file that a linked image's memory block names."""
    block = nodes.where("tag = 'Block'").select("path", images.attr("File").alias("File"), "ordinal")
    held = containers.links(block.select("path", F.lit("Reference").alias("tag"), F.create_map(F.lit("File"), F.col("File")).alias("attrs"), "ordinal"))
    return held.where(F.lower("target").endswith(".lof")).groupBy("path").agg(F.min_by("target", "ordinal").alias("pixel_path"))


def resolve_pixels(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(path, uuid, pixel_path, Position, MemorySize): linked images with the file that holds their pixels.

    A linked image names it in its memory block; what that file says of its block wins.
    """
    own = images.elements(nodes).where("parent_element IS NULL").select("path", "uuid")
    blocks = containers.memory_blocks(found).select(F.col("path").alias("_p"), F.col("position").alias("Position"), F.col("size").alias("MemorySize"))
    return own.join(pixel_files(nodes), "path").join(blocks, F.col("pixel_path") == F.col("_p"), "left").drop("_p")


def with_pixels(wide: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``wide`` with pixel_path, and for linked images whatever the file of their pixels says, but for identity and names."""
    held = resolve_pixels(nodes, found).select(F.col("path").alias("_path"), "pixel_path", F.col("Position").alias("_at"), F.col("MemorySize").alias("_size"))
    out = wide.join(held, wide["path"] == held["_path"], "left").drop("_path")
    own = ("path", "element", "parent_element", "uuid", "name", "block_id", "save_child_name", "trail", "depth", "Position", "MemorySize", "pixel_path", "memory_size")
    said = wide.where(F.lower("path").endswith(".lof"))
    out = relational.overlay(out, said, ("pixel_path", "path"), {c: c for c in wide.columns if c not in own})
    return out.withColumns({"Position": F.coalesce("_at", "Position"), "MemorySize": F.coalesce("_size", "MemorySize"), "pixel_path": F.coalesce("pixel_path", "path")}).drop("_at", "_size")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/", -1), "[.][^.]*$", "")


def graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, parent, name, ordinal) of all elements of all files as one graph: a linked file's first element stands below the elements of the files that name it.

    Folders of linked projects are named by their files. Project files, and files that none names, are roots.
    """
    found = images.elements(nodes).select("path", "element", "parent_element", "name")
    key = lambda p, e: F.concat_ws("#", p, F.col(e).cast("string"))
    ext = F.lower(F.regexp_extract("path", "([.][^.]*)$", 1))
    inside = found.where("parent_element IS NOT NULL").select(key("path", "element").alias("id"), key("path", "parent_element").alias("parent"), "name", F.col("element").alias("ordinal"))
    tops = found.where("parent_element IS NULL").select("path", key("path", "element").alias("id"), F.when(ext.isin(".xlef", ".xlcf"), file_stem(F.col("path"))).otherwise(scalar.fill(F.col("name"), file_stem(F.col("path")))).alias("name"), ext.alias("ext"))
    up = tops.select(F.col("path").alias("_from"), F.col("id").alias("parent"))
    named = links.where("target IS NOT NULL").select(F.col("path").alias("_from"), F.col("target").alias("_to"), "ordinal")
    below = tops.join(named, tops["path"] == named["_to"]).join(up, "_from").select("id", "parent", "name", "ordinal")
    pixels = pixel_files(nodes).select(F.col("pixel_path").alias("_held"))
    free = tops.join(named.select("_to").distinct(), tops["path"] == F.col("_to"), "left_anti").unionByName(tops.where("ext = '.xlef'")).distinct()
    free = free.join(pixels.distinct(), free["path"] == F.col("_held"), "left_anti")
    roots = free.select("id", F.lit(None).cast("string").alias("parent"), "name", F.lit(0).alias("ordinal"))
    return inside.unionByName(below).unionByName(roots)


def without_repeats(names: Column) -> Column:
    """Names without empty ones and without those that equal the one before."""
    return F.filter(names, lambda n, i: (n != "") & ((i == 0) | (n != F.coalesce(F.get(names, i - 1), F.lit("")))))


def every_image(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, uuid, name, root, order): all images that project files, folders and links reach, each once, to be sorted by (root, order).

    The name has the folders' names from the root on, consecutive equal ones once, joined by "_".
    """
    found = images.elements(nodes).where("is_image").select("path", F.concat_ws("#", "path", F.col("element").cast("string")).alias("_id"), "uuid")
    trails = tree.paths(graph(nodes, links)).select("id", "ids", "names", "order")
    parts = without_repeats(F.col("names"))
    rows = found.join(trails, found["_id"] == trails["id"]).select("path", "uuid", F.array_join(parts, "_").alias("name"), F.get("ids", F.lit(0)).alias("root"), "order")
    best = rows.groupBy("path", "uuid").agg(F.min(F.struct("root", "order", "name")).alias("b"))
    return best.select("path", "uuid", "b.name", "b.root", "b.order")
