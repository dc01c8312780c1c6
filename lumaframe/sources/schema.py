"""XML schemas as tables: all files that a schema includes, and which values its attributes may have."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import tree
from lumaframe.sources import containers, stores

READ = "path string, xml string, problem string"


def documents(paths: DataFrame, store: str | None = None) -> DataFrame:
    """(path, xml, problem) of files; one that isn't there has a problem."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xml, problems = [], []
            for path in b.column(0).to_pylist():
                try:
                    with stores.opened(path, store) as file:
                        xml.append(containers.plain_xml(file.read()))
                    problems.append(None)
                except (OSError, ValueError) as e:
                    xml.append(None)
                    problems.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xml, pa.string()), pa.array(problems, pa.string())], ["path", "xml", "problem"])

    return paths.select("path").mapInArrow(read, READ)


def plain(tag: str) -> F.Column:
    return F.regexp_replace(tag, "^[{].*[}]", "")


def included(nodes: DataFrame) -> DataFrame:
    """(path): what includes, imports and redefinitions name, relative to the file that names it; other hosts' schemas aren't fetched."""
    named = nodes.where(plain("tag").isin("include", "import", "redefine")).select("path", F.try_element_at("attrs", F.lit("schemaLocation")).alias("place")).where("place IS NOT NULL AND NOT contains(place, '://')")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, mark, rest = path.rpartition("://")
                out.append(head + mark + posixpath.normpath(posixpath.join(posixpath.dirname(rest), place)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["path"])

    return named.mapInArrow(resolve, "path string").distinct()


def closure(spark: SparkSession, top: str, store: str | None = None) -> DataFrame:
    """The nodes (see ``containers.xml_nodes``) of a schema and of everything it includes, to a fixed point; files met twice are read once, so circles end."""
    frontier = seen = spark.createDataFrame([(stores.local(top),)], "path string")
    out = None
    while not frontier.isEmpty():
        nodes = tree.settled(containers.xml_nodes(documents(frontier, store)))
        out = nodes if out is None else out.unionByName(nodes)
        frontier = tree.settled(included(nodes).join(seen, "path", "left_anti"))
        seen = seen.unionByName(frontier)
    return out


def allowed(nodes: DataFrame) -> DataFrame:
    """(element, attribute, ordinal, value): the values that a schema lists for an attribute, in its own type or one that it names.

    ``element`` is the nearest named element, type or group around the attribute. A named type may stand in another file.
    """
    of = lambda n: F.try_element_at("attrs", F.lit(n))
    base = nodes.select("path", "node", "parent", "ordinal", plain("tag").alias("kind"), of("name").alias("name"), of("type").alias("type"), of("value").alias("value"))
    base = tree.settled(base)
    # the nearest ancestor of some kind, climbed one level a round as deep as the schema is
    attributes = base.where("kind = 'attribute' AND name IS NOT NULL").select("path", F.col("node").alias("at"), F.col("name").alias("attribute"), F.regexp_replace("type", "^.*:", "").alias("type"), F.col("parent").alias("up"))
    owners = climb(attributes, base, ("element", "complexType", "attributeGroup"), named=True).select("path", "at", "attribute", "type", F.col("name").alias("element"))
    values = base.where("kind = 'enumeration' AND value IS NOT NULL").select("path", F.col("node").alias("at"), "ordinal", "value", F.col("parent").alias("up"))
    inline = climb(values, base, ("attribute",), named=False).select("path", F.col("owner").alias("_owner"), "ordinal", "value")
    shared = climb(values, base, ("simpleType",), named=True).select(F.col("name").alias("_type"), "ordinal", "value")
    own = owners.join(inline, (owners["path"] == inline["path"]) & (owners["at"] == inline["_owner"])).select("element", "attribute", "ordinal", "value")
    by_type = owners.join(shared, owners["type"] == shared["_type"]).select("element", "attribute", "ordinal", "value")
    return own.unionByName(by_type).distinct()


def climb(rows: DataFrame, base: DataFrame, kinds: tuple[str, ...], named: bool) -> DataFrame:
    """``rows`` (with path and up) joined with the nearest node above of one of the kinds: its number as owner, and its name."""
    steps = base.select(F.col("path").alias("_path"), F.col("node").alias("_node"), F.col("parent").alias("_parent"), "kind", "name")
    out, level = None, rows
    while not level.isEmpty():
        met = tree.settled(level.join(steps, (level["path"] == steps["_path"]) & (level["up"] == steps["_node"])).drop("_path"))
        fits = F.col("kind").isin(*kinds) & (F.col("name").isNotNull() if named else F.lit(True))
        found = met.where(fits).withColumn("owner", F.col("_node")).drop("_parent", "_node", "kind", "up")
        out = found if out is None else out.unionByName(found)
        level = met.where(~fits & F.col("_parent").isNotNull()).withColumn("up", F.col("_parent")).select(*rows.columns)
    return out if out is not None else rows.join(steps, F.lit(False)).withColumn("owner", F.col("_node")).drop("_path", "_parent", "_node", "kind", "up")


def rules(table: DataFrame) -> dict[tuple[str, str], list[str]]:
    """(element, attribute): values, for a sink that checks what it writes. A schema's lists are a few hundred values."""
    out: dict[tuple[str, str], list[str]] = {}
    for r in table.orderBy("element", "attribute", "ordinal").collect():
        out.setdefault((r.element, r.attribute), []).append(r.value)
    return out
