"""Container files as tables, against what their writer put in."""

import json

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F

from lumaframe.operators import images
from lumaframe.sources import containers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("containers")


@pytest.fixture(scope="module")
def data(folder):
    return synthetic.example(folder)


@pytest.fixture(scope="module")
def found(spark, folder, data):
    return containers.containers(spark, str(folder)).cache()


@pytest.fixture(scope="module")
def nodes(found):
    return containers.xml_nodes(found).cache()


def name(path):
    return path.rsplit("/", 1)[1].replace("%20", " ")


@pytest.mark.parametrize("seek", [False, True])
def test_framing(spark, folder, data, seek):
    rows = {name(r.path): r for r in containers.containers(spark, str(folder), seek).collect()}
    assert set(rows) == {"nested.lif", "broken.lif", "single.lof", "top.xlef", "sub one.xlcf"}
    assert rows["broken.lif"].problem and not rows["nested.lif"].problem
    assert [b.size for b in rows["nested.lif"].blocks] == [0, data.nbytes, 160]
    assert rows["single.lof"].blocks[0].position == 62 and rows["single.lof"].type_name == "LMS_Object_File"
    raw = (folder / "nested.lif").read_bytes()
    at = rows["nested.lif"].blocks[1].position
    assert raw[at : at + 4] == np.array([0, 1], "<u2").tobytes()


def test_tree(nodes):
    found = images.elements(nodes).where("path LIKE '%nested.lif'").orderBy("element").collect()
    assert [(r.name, r.uuid, r.is_image) for r in found] == [("Project", "root", False), ("folder", "f-1", False), ("cells", "u-1", True), ("cells", "MemBlock_2", True)]
    kids = images.children(nodes.where("path LIKE '%nested.lif'"), "f-1").collect()
    assert [r.uuid for r in kids] == ["u-1"]
    listed = images.list_images(nodes).collect()
    assert sorted((name(r.path), r.uuid, r.xs, r.channels) for r in listed) == [("nested.lif", "MemBlock_2", 10, 1), ("nested.lif", "u-1", 9, 3), ("single.lof", "u-9", 5, 1)]


def test_image_metadata(nodes, found):
    wide = images.route(images.key_values(images.images(nodes, containers.memory_blocks(found))))
    rows = {r.uuid: r for r in wide.collect()}
    r = rows["u-1"]
    assert (r.xs, r.ys, r.zs, r.ts, r.channels, r.isrgb) == (9, 7, 2, 2, 3, False)
    assert r.xres2 == pytest.approx(9 / 8) and r.zres2 == pytest.approx(2.0) and r.tres == pytest.approx(1.5)
    assert r.channel_names == ["dye 0", "dye 1", "dye 2"] and r.lutname == ["red", "green", "blue"]
    assert r.blackvalue == [0.1] and r.save_child_name == "nested_Project_folder_cells"
    assert (r.na, r.magnification, r.zoom, r.scan_speed, r.is_resonant_scanner, r.flipy) == (1.4, 63.0, None, 400, True, 1)
    assert r.pinholesize_um == pytest.approx(95)
    assert r.laser_lines == [488, 561] and r.detector_types == ["HyD 1"]
    assert r.emission == [526.0, 610.0, 500.0] and r.excitation == [488.0, 561.0, 480.0] and r.filterblock == ["A", "B", ""]
    pairs = json.loads(r.keyvalues)
    assert pairs["numerical_aperture"] == 1.4 and "zoom" not in pairs and pairs["excitation_wavelengths"] == [488, 561, 480]
    assert (r.route, rows["u-9"].route) == ("planar", "as it is")
    tiled = rows["MemBlock_2"]
    assert len(tiled.tile_positions) == 6
    size = 10 * tiled.xres2 / 1e6
    assert tiled.OverlapPercentageX == pytest.approx(1 - 9e-6 / size)


def test_links(nodes):
    rows = sorted((name(r.path), r.ordinal, name(r.target), r.uuid) for r in containers.links(nodes).collect())
    assert rows == [("sub one.xlcf", 0, "top.xlef", "t"), ("top.xlef", 0, "sub one.xlcf", "s"), ("top.xlef", 1, "gone.xlif", "g")]


def test_units(spark):
    from lumaframe.functions import scalar

    df = spark.createDataFrame([("meters",), ("μm",), (" MM",), ("inch",), (None,), ("s",)], "u string")
    assert [r[0] for r in df.select(scalar.unit_factor(F.col("u"))).collect()] == [1e6, 1.0, 1e3, 25400.0, 1.0, 1.0]
