"""Legacy records, camera channels and listings, against hand-made documents."""

import pytest
from pyspark.sql import functions as F

from lumaframe.operators import browse, images, legacy, widefield
from lumaframe.sources import containers

SCANNER = {"SystemType": "TCS SP5", "csScanMode": "xyzt", "dblZoom": "2.5", "eDirectional": "1", "nLineAccumulation": "3", "dblPinhole": "0.000156", "nSections": "32"}
RECORDS = [
    ("Tree", "CFolderHardwareTree", "System_Number", "51", ""), ("DM6000", "CMicroscopeStand", "TLD", "1", ""), ("Turret", "CTurret", "Objective", "HCX 63.0x0.90 WATER UV", ""),
    ("Turret", "CTurret", "NumericalAperture", "0.9", ""), ("AOTF", "CAotf", "Intensity", "14.997253", "AOTF (514)"), ("AOTF", "CAotf", "Intensity", "0", "AOTF (633)"),
    ("Argon", "CLaser", "Wavelength", "458", ""), ("Argon", "CLaser", "Power State", "On", ""), ("HyD 1", "CDetectionUnit", "State", "Active", ""), ("HyD 1", "CDetectionUnit", "HighVoltage", "10", ""),
    ("HyD 1", "CDetectionUnit", "AcquisitionMode", "PhotonCounting", ""), ("PMT 2", "CDetectionUnit", "State", "Inactive", ""), ("Scan Head", "CScanCtrlUnit", "Speed", "8000", ""), ("Reson. Pan", "CFilterWheel", "Filter", "x", ""),
    ("Stage", "CXYZStage", "XPos", "0.0068", ""), ("SP Mirror Channel 1", "CSpectrophotometerUnit", "Wavelength", "524", ""), ("SP Mirror Channel 1", "CSpectrophotometerUnit", "Wavelength", "649.441552", ""),
]


def nodes_of(spark, xml):
    return containers.xml_nodes(spark.createDataFrame([("p", xml)], "path string, xml string")).cache()


@pytest.fixture(scope="module")
def old(spark):
    scan = "".join(f'<ScannerSettingRecord Identifier="{k}" Variant="{v}" Unit="" Description=""/>' for k, v in SCANNER.items())
    hard = "".join(f'<FilterSettingRecord ObjectName="{o}" ClassName="{c}" Attribute="{a}" Variant="{v}" Description="{d}"/>' for o, c, a, v, d in RECORDS)
    return nodes_of(spark, f'<Element Name="Job"><Dim><DimensionDescription DimID="3" NumberOfElements="32" Origin="0.01222694" Length="-0.0000091884" Unit="m"/></Dim><A>{scan}{hard}</A><Memory Size="4" MemoryBlockID="b"/></Element>')


def test_legacy(old):
    wide = old.where("tag = 'Element'").select("path", F.col("node").alias("element"), F.lit("").alias("SystemTypeName"), F.lit(7.0).alias("zoom"))
    r = legacy.fill(wide, old).first()
    assert (r.SystemTypeName, r.zoom, r.scan_mode, r.line_accumulation, r.zstack_sections) == ("TCS SP5", 7.0, "xyzt", 3, 32)
    assert r.pinholesize_um == pytest.approx(156) and r.zstack_end_m == pytest.approx(0.0122177516)
    assert (r.na, r.magnification, r.immersion, r.scan_speed, r.is_resonant_scanner, r.stage_pos_x_m, r.MicroscopeModel) == (0.9, 63.0, "Water", 8000, True, 0.0068, "DM6000")
    assert [(x.wavelength_nm, x.intensity_percent) for x in legacy.lines(old).collect()] == [(514.0, 15.0)]
    assert [(x.detector, x.gain, x.mode) for x in legacy.detectors(old).collect()] == [("HyD", 10.0, "PhotonCounting")]
    s = legacy.spectra(old).first()
    assert (s.emission, s.excitation, s.right_nm) == (587.0, 514.0, 649.441552)
    assert [(x.name, x.wavelength_nm, x.power_state) for x in legacy.lasers(old).collect()] == [("Argon", 458.0, "On")]


def test_camera(spark):
    info = '<WideFieldChannelInfo FluoCubeName="{}" LUT="Red" FFW_Excitation1FilterName="642" ContrastingMethodName="FLUO" EmissionWavelength="700" ILLEDActiveState1="1" ILLEDWavelength1="390" ILLEDIntensity1="0.125" ILLEDActiveState3="1" ILLEDWavelength3="475" ILLEDIntensity3="40"/>'
    body = "".join(info.format(c) for c in ("L5", "QUAD-S", "DA/FI/TX", "none"))
    nodes = nodes_of(spark, f'<Element><WideFieldChannelConfigurator CameraName="cam">{body}<CameraFormat Binning="2"/><IndividualCameraInfo ExposureTime="0.1" GainValue="3"/></WideFieldChannelConfigurator><WideFieldChannelConfigurator ThisIsHSAutofocusInstance="1">{info.format("A")}</WideFieldChannelConfigurator></Element>')
    r = widefield.by_image(widefield.channels(nodes)).first()
    assert r.excitation == [480.0, 642.0, 545.0, 0.0] and r.emission == [527.0, 670.0, 605.0, 0.0]
    assert r.filterblock == ["L5", "QUAD-S: 642", "DA/FI/TX: Red", "none"]
    led = widefield.led_channels(nodes).orderBy("node").first()
    assert (led.excitation, led.emission, led.filterblock) == (475.0, 700.0, "L5 700")
    assert [tuple(x) for x in led.led_intensities] == [(390, 12.5), (475, 40.0)]
    c = widefield.cameras(nodes).first()
    assert (c.camera_name, c.binning, c.exposure_times_s, c.camera_gains) == ("cam", 2, [0.1], [3.0])


def test_defaults(spark):
    df = spark.createDataFrame([(3, False, None, [1.0], ["x"]), (3, True, None, None, None)], "channels int, isrgb boolean, emission array<double>, excitation array<double>, filterblock array<string>")
    a, b = widefield.defaults(df).collect()
    assert a.emission == [500.0] * 3 and a.excitation == [1.0] and a.filterblock == ["x", "Unknown", "Unknown"]
    assert b.emission is None and b.filterblock is None


def test_browse(spark, tmp_path):
    for name in ("a/x.xlef", "a/y.lif", "b/z.lif", "b/q_pmd_.txt", "b/n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = browse.listing(browse.files(spark, str(tmp_path))).collect()
    assert [(r.dir[-1], r.name, r.type) for r in rows] == [("a", "x.xlef", "Folder"), ("b", "n.txt", "File"), ("b", "z.lif", "Folder")]
    df = spark.createDataFrame([('{"children":[{"uuid":"1","name":"a"},{"uuid":"2","name":"b"}]}', "2", "run_folder_img", "/x/run.lif")], "t string, u string, n string, f string")
    r = df.select(browse.child(F.col("t"), F.col("u")).alias("c"), browse.output_name(F.col("n"), F.col("f")).alias("o"), browse.shown_name(F.col("f"), F.lit("a/b")).alias("s")).first()
    assert ('"name":"b"' in r.c, r.o, r.s) == (True, "run-lif_folder_img", "run.lif [a/b]")


def test_schema(spark):
    xsd = '<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema"><xsd:simpleType name="Medium"><xsd:restriction base="s"><xsd:enumeration value="Oil"/><xsd:enumeration value="Water"/></xsd:restriction></xsd:simpleType></xsd:schema>'
    rows = browse.enumerations(nodes_of(spark, xsd)).orderBy("ordinal").collect()
    assert [(r.field, r.value) for r in rows] == [("Medium", "Oil"), ("Medium", "Water")]


def test_elements_without_ids(spark):
    nodes = nodes_of(spark, '<R><Element Name="E"><Memory Size="0" MemoryBlockID="MemBlock_17"/><Children><Element Name="S"><Memory Size="0" MemoryBlockID="MemBlock_30"/><Children><Element Name="J2"><Memory Size="4" MemoryBlockID="MemBlock_31"/></Element><Element Name="J3"><Memory Size="4" MemoryBlockID="MemBlock_32"/></Element></Children></Element></Children></Element></R>')
    assert [(r.uuid, r.is_image) for r in images.children(nodes, "MemBlock_30").collect()] == [("MemBlock_31", True), ("MemBlock_32", True)]
