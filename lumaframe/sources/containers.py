"""Microscopy containers as tables: framing, memory blocks, XML trees and links.

Three families are read. A ``.lif`` file is a framed UTF-16 XML document followed by framed memory
blocks; a ``.lof`` file is a framed type record, one memory block and a framed XML document; ``.xlef``,
``.xlcf`` and ``.xlif`` files are XML documents that point to one another and to ``.lof`` files.
"""

from __future__ import annotations

import io
import os
import struct
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.sources import stores
from lumaframe.sources.stores import local

# Fixed values of the file formats.
MAGIC, MARK = 0x70, 0x2A
FRAMED, LINKED = (".lif", ".lof"), (".xlef", ".xlcf", ".xlif")

CONTAINERS = "path string, kind string, modified timestamp, xml string, type_name string, blocks array<struct<id:string,position:bigint,size:bigint>>, problem string"
NODES = "path string, node bigint, parent bigint, element bigint, depth int, ordinal int, tag string, trail string, attrs map<string,string>, text string"


class Truncated(ValueError):
    pass


def take(file, form: str):
    size = struct.calcsize("<" + form)
    raw = file.read(size)
    if len(raw) < size:
        raise Truncated(f"file ends at {file.tell()}")
    return struct.unpack("<" + form, raw)


def text(file) -> str:
    """A framed UTF-16 string: a mark, the number of characters, the characters."""
    mark, n = take(file, "Bi")
    if mark != MARK:
        raise ValueError(f"no text mark before {file.tell()}")
    return take(file, f"{2 * n}s")[0].decode("utf-16-le").lstrip("﻿")


def frame(file) -> None:
    magic, _ = take(file, "ii")
    if magic != MAGIC:
        raise ValueError(f"no frame before {file.tell()}")


def read_lif(file) -> tuple[str, list[dict]]:
    """(XML, memory blocks): the blocks are hopped over, their bytes are not read. A broken tail ends the list."""
    frame(file)
    xml, blocks = text(file), []
    start = file.tell()
    end = file.seek(0, os.SEEK_END)
    file.seek(start)
    while file.tell() < end:
        try:
            frame(file)
            mark, size = take(file, "Bq")
            name = text(file)
        except ValueError:
            break
        if mark != MARK:
            break
        blocks.append({"id": name, "position": file.tell(), "size": size})
        file.seek(size, os.SEEK_CUR)
    return xml, blocks


def read_lof(file) -> tuple[str, str, list[dict]]:
    """(type name, XML, the memory block)."""
    frame(file)
    name = text(file)
    for what in ("major version", "minor version"):
        mark, _ = take(file, "Bi")
        if mark != MARK:
            raise ValueError(f"no mark before the {what}")
    mark, size = take(file, "BQ")
    if mark != MARK:
        raise ValueError("no mark before the size of the pixels")
    position = file.tell()
    file.seek(size, os.SEEK_CUR)
    frame(file)
    return name, text(file), [{"id": "", "position": position, "size": size}]


def plain_xml(raw: bytes) -> str:
    for mark, code in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(code)
    return raw.decode("utf-8")


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path is one of the file system, which executors open as Spark itself does."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def containers(spark: SparkSession, path: str, seek: bool | None = None, store: str | None = None) -> DataFrame:
    """One row for each container file below ``path``; what can't be read has a problem instead of XML.

    With ``seek``, files are opened where they lie, and only headers are read, whatever their size;
    this is how files are read, if nothing is said, that a ``store`` opens, or that lie in a mounted file system or another one
    that pyarrow reaches (see ``stores``). Files that Spark alone reaches are read whole, up to its 2 GiB limit for one file.
    """
    if store:
        names = stores.listed(path, (*FRAMED, *LINKED), store)
        files = spark.createDataFrame(names, "path string, modificationTime timestamp").repartition(max(1, len(names) // 16))
        return parse(files.withColumn("content", F.lit(None).cast("binary")), store)
    seek = stores.scheme(path) in stores.KNOWN[1:] or mounted(spark, path) if seek is None else seek
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{lif,lof,xlef,xlcf,xlif,LIF,LOF,XLEF,XLCF,XLIF}").load(path)
    return parse(files.select("path", "modificationTime", F.lit(None).cast("binary").alias("content") if seek else F.col("content")))


def parse(files: DataFrame, store: str | None = None) -> DataFrame:
    """The container rows of files (path, modificationTime, content), batch or stream; of a null content the header is read from the path."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, modified, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                kind = os.path.splitext(name)[1].lower()
                row = {"path": name, "kind": kind, "modified": modified, "xml": None, "type_name": None, "blocks": [], "problem": None}
                try:
                    with io.BytesIO(raw) if raw is not None else stores.opened(name, store) as file:
                        if kind == ".lif":
                            row["xml"], row["blocks"] = read_lif(file)
                        elif kind == ".lof":
                            row["type_name"], row["xml"], row["blocks"] = read_lof(file)
                        else:
                            row["xml"] = plain_xml(file.read())
                except (ValueError, OSError, struct.error) as e:
                    row["problem"] = str(e)
                rows.append(row)
            kinds = [("path", pa.string()), ("kind", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("xml", pa.string()), ("type_name", pa.string())]
            kinds += [("blocks", pa.list_(pa.struct([("id", pa.string()), ("position", pa.int64()), ("size", pa.int64())]))), ("problem", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return files.select("path", "modificationTime", "content").mapInArrow(rows_of, CONTAINERS)


def memory_blocks(found: DataFrame) -> DataFrame:
    return found.select("path", F.explode("blocks").alias("b")).select("path", F.col("b.id").alias("block_id"), F.col("b.position").alias("position"), F.col("b.size").alias("size"))


def xml_nodes(found: DataFrame, path: str = "path", xml: str = "xml") -> DataFrame:
    """One row for each XML element, in document order: its parent, and the nearest ``Element`` at or above it.

    ``trail`` has the tags from the root on. A document that isn't well formed has no rows.
    """

    def walk(name: str, document: str) -> list[dict]:
        try:
            root = ET.fromstring(document)
        except ET.ParseError:
            return []
        rows: list[dict] = []
        held = [(root, None, None, 0, 0, "")]
        while held:
            node, parent, element, depth, ordinal, trail = held.pop()
            number, trail = len(rows), f"{trail}/{node.tag}"
            element = number if node.tag == "Element" else element
            rows.append({"path": name, "node": number, "parent": parent, "element": element, "depth": depth, "ordinal": ordinal, "tag": node.tag, "trail": trail, "attrs": list(node.attrib.items()), "text": (node.text or "").strip()})
            held += [(child, number, element, depth + 1, i, trail) for i, child in reversed(list(enumerate(node)))]
        return rows

    kinds = pa.schema(
        [("path", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("element", pa.int64()), ("depth", pa.int32()), ("ordinal", pa.int32()), ("tag", pa.string()), ("trail", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
    )

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, document in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if document and (rows := walk(name, document)):
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return found.select(F.col(path), F.col(xml)).mapInArrow(flatten, NODES)


def links(nodes: DataFrame) -> DataFrame:
    """(path, ordinal, target, uuid): files that a linked container's ``Reference`` elements name, as paths beside it."""
    refs = nodes.where("tag = 'Reference'").select("path", "ordinal", F.try_element_at("attrs", F.lit("File")).alias("file"), F.try_element_at("attrs", F.lit("UUID")).alias("uuid"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            target = []
            for name, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = urllib.parse.unquote(file or "").replace("\\", "/")
                scheme, _, rest = name.partition(":")
                base = os.path.dirname(rest if rest else name)
                full = os.path.normpath(os.path.join(base, file))
                target.append((f"{scheme}:{full}" if rest else full) if file else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(target, pa.string()), b.column(3)], ["path", "ordinal", "target", "uuid"])

    return refs.select("path", "file", "ordinal", "uuid").mapInArrow(resolve, "path string, ordinal int, target string, uuid string")
