"""Containers and planes in a store that only ranged reads reach, and planes as a data source."""

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F

from lumaframe.api import Library
from lumaframe.sources import pixels
from tests import counted_store

STORE = "tests.counted_store:find"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    data = synthetic.pixels((2, 2, 3, 600, 300))
    xml = synthetic.image_xml("far", "f-1", "m1", data.shape, data.nbytes)
    stack = np.ascontiguousarray(data.transpose(0, 2, 1, 3, 4))
    (folder / "far.lif").write_bytes(synthetic.lif(xml, [("m0", b""), ("m1", stack.tobytes()), ("m2", bytes(5_000_000))]))
    library = Library(spark, f"counted://{folder}", store=STORE)
    yield folder, data, library
    library.close()


def image_of(rows, shape):
    out = np.zeros(shape, np.uint16)
    for r in rows:
        out[r.t, r.c, r.z, r.y0 : r.y0 + r.h] = pixels.array_of(r)
    return out


def test_headers_and_pixels(stored):
    folder, data, library = stored
    counted_store.reads(folder)
    row = library.image("f-1").first()
    assert row.path == f"counted://{folder}/far.lif" and (row.xs, row.ys, row.zs) == (300, 600, 3)
    assert sum(n for _, _, n in counted_store.reads(folder)) < 200_000  # of 7 MB: no pixels are read for a description
    assert (image_of(pixels.chunks(pixels.planes(library.images()), store=STORE).collect(), data.shape) == data).all()
    assert library.stats(0.1).count() == 2


def test_source_reads_what_is_asked_for(stored, tmp_path):
    folder, data, library = stored
    library.save_planes(str(tmp_path / "index"))
    bands = library.planes(str(tmp_path / "index"))
    assert (image_of(bands.collect(), data.shape) == data).all()
    counted_store.reads(folder)
    plane = 600 * 300 * 2
    one = bands.where((F.col("z") == 1) & (F.col("t") == 0) & F.col("c").isin(0, 1))
    assert (image_of(one.collect(), data.shape)[0, :, 1] == data[0, :, 1]).all()
    got = counted_store.reads(folder)
    assert sum(n for _, _, n in got) == 2 * plane
    assert len(bands.where("z >= 1 AND y0 = 512 AND uuid = 'f-1'").collect()) == 2 * 2 * 2
    assert sum(n for _, _, n in counted_store.reads(folder)) == 8 * 88 * 300 * 2
    assert bands.where("uuid = 'none'").count() == 0 and bands.where("z > 7").count() == 0 and counted_store.reads(folder) == []
    assert "ArrowEvalPython" not in one._jdf.queryExecution().toString()


def test_conditions_that_are_not_pushed(stored, tmp_path):
    _, data, library = stored
    library.save_planes(str(tmp_path / "index"))
    bands = library.planes(str(tmp_path / "index"), step=7, band=100)
    rows = bands.where("z % 2 = 0 AND y0 < 20 AND t = 1").collect()
    got = {(r.c, r.z, r.y0 + k): tuple(pixels.array_of(r)[k]) for r in rows for k in range(r.h)}
    assert all(v == tuple(data[1, c, z, y * 7]) for (c, z, y), v in got.items())
    assert {k[1] for k in got} == {0, 2} and {r.y0 for r in rows} == {0, 15}


def test_conversion_from_a_store(stored, tmp_path):
    import json

    from lumaframe.sinks import zarr

    _, data, library = stored
    out = json.loads(library.convert("f-1", str(tmp_path), "ome-zarr"))
    assert (zarr.read_zarr(out[0]["full_path"]) == data).all()
    single = json.loads(library.convert("f-1", str(tmp_path), "lif"))[0]["full_path"]
    with Library(library.spark, single) as again:
        assert again.image("f-1").first().MemorySize == data.nbytes
