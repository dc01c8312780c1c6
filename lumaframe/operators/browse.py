"""Listings: files of folders, nodes of a tree, names to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import scalar

NODE = "struct<type:string,name:string,uuid:string,children:array<struct<type:string,name:string,uuid:string>>>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(dir, name, ext, modified, length) of all files below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    name = F.substring_index("path", "/", -1)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), name.alias("name"), F.lower(F.regexp_extract(name, "([.][^.]*)$", 1)).alias("ext"), F.col("modificationTime").alias("modified"), "length")


def listing(found: DataFrame) -> DataFrame:
    """What a browser shows: in a folder with project files only those; no bookkeeping; by name. Containers open like folders."""
    some = found.groupBy(F.col("dir").alias("_d")).agg(F.bool_or(F.col("ext") == ".xlef").alias("projects"))
    shown = found.join(some, found["dir"] == some["_d"]).where((~F.col("projects") | (F.col("ext") == ".xlef")) & ~scalar.noise_name(F.col("name")))
    kind = F.when(F.col("ext").isin(".lif", ".xlef"), "Folder").otherwise("File")
    return shown.select("dir", "name", kind.alias("type"), "modified", "length").orderBy("dir", "name")


def single_image(children: DataFrame) -> DataFrame:
    """(path, single) for rows (path, name, type): whether a file shows one entry, which is neither a folder nor a file."""
    shown = children.where(~scalar.noise_name(F.coalesce("name", F.lit(""))))
    image = ~F.lower(F.coalesce("type", F.lit(""))).isin("folder", "file")
    return shown.groupBy("path").agg(((F.count(F.lit(1)) == 1) & F.bool_and(image)).alias("single"))


def child(tree: Column, uuid: Column) -> Column:
    """The first child with an id, in a tree held as JSON; null if there is none."""
    node = F.from_json(tree, NODE)
    return F.to_json(F.get(F.filter(node["children"], lambda c: c["uuid"] == uuid), F.lit(0)))


def output_name(name: Column, file: Column) -> Column:
    """The image's name with the container's extension after the container's base name, where it begins with that."""
    base = F.regexp_replace(F.substring_index(file, "/", -1), "[.][^.]*$", "")
    ext = F.lower(F.regexp_extract(file, "[.]([^.]*)$", 1))
    return F.when(name.startswith(base), F.concat(base, F.lit("-"), ext, F.call_function("substring", name, F.length(base) + 1))).otherwise(name)


def shown_name(file: Column, trail: Column) -> Column:
    return F.when(~scalar.missing(trail), F.concat(F.substring_index(file, "/", -1), F.lit(" ["), trail, F.lit("]"))).otherwise(F.substring_index(file, "/", -1))


def enumerations(nodes: DataFrame) -> DataFrame:
    """(field, ordinal, value) of the enumerations in an XML schema held as nodes."""
    tag = F.regexp_replace("tag", "^[{].*[}]", "")
    kinds = nodes.where((tag == "simpleType") & F.map_contains_key("attrs", "name")).select("path", F.col("node").alias("_kind"), F.try_element_at("attrs", F.lit("name")).alias("field"))
    limits = nodes.where(tag == "restriction").select("path", F.col("parent").alias("_kind"), F.col("node").alias("_limit"))
    values = nodes.where(tag == "enumeration").select("path", F.col("parent").alias("_limit"), "ordinal", F.try_element_at("attrs", F.lit("value")).alias("value"))
    return values.join(limits, ["path", "_limit"]).join(kinds, ["path", "_kind"]).select("field", "ordinal", "value")


def evicted(cache: DataFrame, k: int) -> DataFrame:
    """Files beyond the k newest of a cache folder."""
    from lumaframe.operators.relational import keep_latest

    return keep_latest(cache, ["dir"], [F.desc("modified"), F.desc("name")], k)
