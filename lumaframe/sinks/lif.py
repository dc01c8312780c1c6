"""A container with a single image: its description is rebuilt, its memory block is copied in pieces."""

from __future__ import annotations

import os
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.sources import stores
from lumaframe.sources.containers import MAGIC, MARK

#: Bytes copied at once.
PIECE = 25_600_000


def framed(payload: bytes) -> bytes:
    return struct.pack("<ii", MAGIC, len(payload)) + payload


def string(value: str) -> bytes:
    return struct.pack("<Bi", MARK, len(value.encode("utf-16-le")) // 2) + value.encode("utf-16-le")


def header(document: str, uuid: str, name: str) -> tuple[str, str]:
    """(XML, block id): the image's element alone below a root, under a new name. Names are escaped; others keep theirs."""
    for element in ET.fromstring(document).iter("Element"):
        memory = element.find("Memory")
        block = memory.get("MemoryBlockID") if memory is not None else None
        if (element.get("UniqueID") or block) == uuid:
            element.set("Name", name)
            top = ET.Element("LMSDataContainerHeader", Version="2")
            root = ET.SubElement(top, "Element", Name=name, UniqueID="root")
            ET.SubElement(root, "Memory", Size="0", MemoryBlockID="MemBlock_root")
            ET.SubElement(root, "Children").append(element)
            return ET.tostring(top, encoding="unicode"), block or ""
    raise ValueError(f"no image {uuid}")


def write_single(wide: DataFrame, found: DataFrame, folder: str, store: str | None = None) -> DataFrame:
    """(uuid, file, bytes): one file for each image row, each written by one task on a folder that every executor mounts."""
    xml = found.select(F.col("path").alias("_path"), "xml")
    rows = wide.join(xml, wide["path"] == xml["_path"]).select("path", "uuid", "save_child_name", "Position", "MemorySize", "xml")
    rows = rows.repartition("uuid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                document, block = header(r["xml"], r["uuid"], r["save_child_name"])
                file = f"{folder}/{r['save_child_name'].replace('/', '_')}.lif"
                with stores.opened(r["path"], store) as source, open(f"{file}.part", "wb") as target:
                    target.write(framed(string(document)))
                    target.write(framed(struct.pack("<Bq", MARK, 0) + string("MemBlock_root")))
                    target.write(framed(struct.pack("<Bq", MARK, r["MemorySize"]) + string(block)))
                    source.seek(r["Position"])
                    left = r["MemorySize"]
                    while left > 0 and (piece := source.read(min(PIECE, left))):
                        target.write(piece)
                        left -= len(piece)
                os.replace(f"{file}.part", file)
                out.append({"uuid": r["uuid"], "file": file, "bytes": os.path.getsize(file)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("uuid", pa.string()), ("file", pa.string()), ("bytes", pa.int64())]))

    return rows.mapInArrow(write, "uuid string, file string, bytes bigint")
