"""Planes of images as a data source: ``spark.read.format("lumaframe.planes")``.

An index of planes (one row for each, with its file and offset) is written once by Spark and sorted. Reading takes its
row groups as partitions: the driver looks at footers only. Conditions on uuid, t, c, z, s and, without a
stride, y0 are pushed down: row groups that can't hold such planes are left out, planes that don't match aren't read, and of a plane only the
bands asked for are, each with one ranged read from whatever store the container lies in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from lumaframe.sources import pixels, stores

NAME = "lumaframe.planes"
#: Planes that one task looks at.
PLANES = 4096
PUSHED = ("uuid", "t", "c", "z", "s")
_COMPARE = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def save_index(planes: DataFrame, folder: str) -> None:
    """Write planes (see ``pixels.planes``) as an index, in the order in which they are looked up."""
    planes.repartitionByRange("uuid", "t", "c", "z", "s").sortWithinPartitions("uuid", "t", "c", "z", "s").write.parquet(folder)


def matches(rows: pa.RecordBatch | pa.Table, filters: list[ds.Filter]) -> pa.Array:
    """Which rows meet all filters; null meets none."""
    kept = pa.array([True] * rows.num_rows)
    for f in filters:
        column = rows.column(f.attribute[0])
        met = pc.is_in(column, pa.array(list(f.value), column.type)) if isinstance(f, ds.In) else _COMPARE[type(f)](column, pa.scalar(f.value, column.type))
        kept = pc.and_(kept, pc.fill_null(met, False))
    return kept


def possible(low, high, f: ds.Filter) -> bool:
    """Whether values between two bounds can meet a filter."""
    if isinstance(f, ds.In):
        return any(low <= v <= high for v in f.value if v is not None)
    return {ds.EqualTo: low <= f.value <= high, ds.GreaterThan: high > f.value, ds.GreaterThanOrEqual: high >= f.value, ds.LessThan: low < f.value, ds.LessThanOrEqual: low <= f.value}[type(f)]


@dataclass
class Slice(ds.InputPartition):
    """Some rows of a row group of the index."""

    file: str
    group: int
    first: int
    rows: int


class PlaneReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.store = options["path"], options.get("store")
        self.index_store = options.get("index_store")
        self.band, self.step = int(options.get("band", pixels.BAND)), int(options.get("step", 1))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        known = (*PUSHED, "y0") if self.step == 1 else PUSHED
        for f in filters:
            able = isinstance(f, (*_COMPARE, ds.In)) and len(f.attribute) == 1 and f.attribute[0] in known
            if able and (isinstance(f, ds.In) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        system, folder = stores.find(self.folder, self.index_store)
        out = []
        for file in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            if file.type != fs.FileType.File or not file.path.endswith(".parquet"):
                continue
            meta = pq.read_metadata(file.path, filesystem=system)
            place = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)} if meta.num_row_groups else {}
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                known = ((f, group.column(place[f.attribute[0]]).statistics) for f in self.filters if f.attribute[0] in PUSHED)
                if all(s is None or not s.has_min_max or possible(s.min, s.max, f) for f, s in known):
                    out += [Slice(file.path, g, first, min(PLANES, group.num_rows - first)) for first in range(0, group.num_rows, PLANES)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no planes at all
            return
        system, _ = stores.find(self.folder, self.index_store)
        with system.open_input_file(partition.file) as file:
            rows = pq.ParquetFile(file).read_row_group(partition.group).slice(partition.first, partition.rows)
        rows = rows.filter(matches(rows, [f for f in self.filters if f.attribute[0] in PUSHED]))
        bands = [f for f in self.filters if f.attribute[0] == "y0"]
        with stores.Ranges(self.store) as ranges:
            for r in rows.to_pylist():
                starts = pa.table({"y0": pa.array(range(0, r["rows"], self.band), pa.int32())})
                for y0 in starts.filter(matches(starts, bands))["y0"].to_pylist():
                    if (chunk := pixels.read_band(ranges, r | {"y0": y0}, self.step, self.band)) is not None:
                        yield pa.RecordBatch.from_pylist([chunk], schema=pixels.CHUNK_KINDS)


class PlaneSource(ds.DataSource):
    """Options: ``path`` of the index, ``band`` and ``step`` as in ``pixels.chunks``, ``store`` of the containers and ``index_store`` of the index (see ``stores``)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return pixels.CHUNKS

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaneSource)
