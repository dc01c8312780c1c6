"""Schemas with includes, and descriptions that conform to them."""

import xml.etree.ElementTree as ET

from lumaframe.sinks import ome
from lumaframe.sources import schema

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def listed(*values):
    return '<xs:restriction base="xs:string">' + "".join(f'<xs:enumeration value="{v}"/>' for v in values) + "</xs:restriction>"


def write(folder):
    (folder / "parts").mkdir()
    top = f'''<xs:schema {XS}><xs:include schemaLocation="parts/types.xsd"/><xs:import schemaLocation="http://elsewhere.org/xml.xsd"/><xs:include schemaLocation="gone.xsd"/>
    <xs:element name="Detector"><xs:complexType><xs:complexContent><xs:extension base="Maker"><xs:attribute name="Type"><xs:simpleType>{listed("PMT", "CCD", "Other")}</xs:simpleType></xs:attribute>
    <xs:attribute name="Gain" type="xs:float"/></xs:extension></xs:complexContent></xs:complexType></xs:element>
    <xs:element name="Objective"><xs:complexType><xs:attribute name="Immersion" type="Medium"/></xs:complexType></xs:element></xs:schema>'''
    (folder / "top.xsd").write_text(top)
    (folder / "parts" / "types.xsd").write_text(f'<xs:schema {XS}><xs:include schemaLocation="../top.xsd"/><xs:include schemaLocation="units.xsd"/><xs:simpleType name="Medium">{listed("Oil", "Water", "Other")}</xs:simpleType></xs:schema>')
    (folder / "parts" / "units.xsd").write_text(f'<xs:schema {XS}><xs:simpleType name="Length">{listed("µm", "nm")}</xs:simpleType><xs:element name="Pixels"><xs:complexType><xs:attribute name="PhysicalSizeXUnit" type="Length"/></xs:complexType></xs:element></xs:schema>', encoding="utf-8")


def test_closure_and_rules(spark, tmp_path):
    write(tmp_path)
    nodes = schema.closure(spark, str(tmp_path / "top.xsd"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in nodes.select("path").distinct().collect()) == ["top.xsd", "types.xsd", "units.xsd"]
    rules = schema.rules(schema.allowed(nodes))
    assert rules == {("Detector", "Type"): ["PMT", "CCD", "Other"], ("Objective", "Immersion"): ["Oil", "Water", "Other"], ("Pixels", "PhysicalSizeXUnit"): ["µm", "nm"]}
    image = {"xs": 4, "ys": 4, "detector_types": ["HyD 1", "PMT 2"], "detector_kinds": ["Hybrid", "pmt"], "immersion": "OIL", "xres2": 0.5, "schema_rules": rules}
    top = ET.fromstring(ome.ome_xml(image))
    assert [d.get("Type") for d in top.iter("{*}Detector")] == ["Other", "PMT"] or [d.get("Type") for d in top.findall(".//{*}Detector")] == ["Other", "PMT"]
    assert top.find(".//{*}Objective").get("Immersion") == "Oil" and top.find(".//{*}Pixels").get("PhysicalSizeXUnit") == "µm"
    none = ET.fromstring(ome.ome_xml(image | {"schema_rules": {("Detector", "Type"): ["CCD"]}}))
    assert all("Type" not in d.attrib for d in none.findall(".//{*}Detector"))


def test_schema_without_lists(spark, tmp_path):
    (tmp_path / "a.xsd").write_text(f'<xs:schema {XS}><xs:element name="A"/></xs:schema>')
    assert schema.rules(schema.allowed(schema.closure(spark, str(tmp_path / "a.xsd")))) == {}
    assert schema.documents(spark.createDataFrame([(str(tmp_path / "none.xsd"),)], "path string")).first().problem
