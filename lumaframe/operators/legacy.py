"""Settings of older scanners, kept as flat records; they only fill what the newer settings leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import images, relational
from lumaframe.operators.images import KEY, attr, in_order

# Scanner record, field, type and factor.
SCANNER = [
    ("SystemType", "SystemTypeName", "string", None),
    ("csScanMode", "scan_mode", "string", None),
    ("dblZoom", "zoom", "double", None),
    ("eDirectional", "scan_direction", "string", None),
    ("nAccumulation", "frame_accumulation", "int", None),
    ("nAverageFrame", "frame_average", "int", None),
    ("nAverageLine", "line_average", "int", None),
    ("nLineAccumulation", "line_accumulation", "int", None),
    ("dblPinhole", "pinholesize_um", "double", 1e6),
    ("dblPinholeAiry", "pinhole_airy", "double", None),
    ("nSections", "zstack_sections", "int", None),
]
#: Class, attribute, field and type of hardware records.
HARDWARE = [
    ("CFolderHardwareTree", "system_number", "system_serial_number", "string"),
    ("CTurret", "objective", "objective", "string"),
    ("CTurret", "ordernumber", "objective_order_number", "string"),
    ("CTurret", "numericalaperture", "na", "double"),
    ("CTurret", "refractionindex", "refractiveindex", "double"),
    ("CScanCtrlUnit", "speed", "scan_speed", "int"),
    ("CScanCtrlUnit", "phase", "phase_x", "double"),
    ("CRotator", "scan rotation", "rotator_angle", "double"),
    ("CXYZStage", "xpos", "stage_pos_x_m", "double"),
    ("CXYZStage", "ypos", "stage_pos_y_m", "double"),
    ("CXYZStage", "zpos", "stage_pos_z_m", "double"),
]


def typed(value: Column, kind: str) -> Column:
    return value if kind == "string" else value.try_cast("double").cast(kind)


def scanner_records(nodes: DataFrame) -> DataFrame:
    own = nodes.where("tag = 'ScannerSettingRecord'")
    return own.select(*KEY, "node", attr("Identifier").alias("key"), attr("Variant").alias("value"), attr("Unit").alias("unit"), attr("Description").alias("description"))


def hardware_records(nodes: DataFrame) -> DataFrame:
    own = nodes.where("tag = 'FilterSettingRecord'")
    return own.select(*KEY, "node", attr("ObjectName").alias("object"), attr("ClassName").alias("class"), attr("Attribute").alias("attribute"), attr("Variant").alias("value"), attr("Description").alias("description"))


def scanner(nodes: DataFrame) -> DataFrame:
    fields = [F.max_by(typed(F.col("value"), kind) * factor if factor else typed(F.col("value"), kind), F.when(F.col("key") == key, F.col("node"))).alias(field) for key, field, kind, factor in SCANNER]
    return scanner_records(nodes).groupBy(*KEY).agg(*fields)


def hardware(nodes: DataFrame) -> DataFrame:
    """Single values by class and attribute, and what follows from the objective's name."""
    rows = hardware_records(nodes)
    one = lambda c, a, k: F.min_by(typed(F.col("value"), k), F.when((F.col("class") == c) & (F.lower("attribute") == a), F.col("node")))
    out = rows.groupBy(*KEY).agg(*[one(c, a, k).alias(f) for c, a, f, k in HARDWARE], F.bool_or(F.lower("object").contains("reson")).alias("is_resonant_scanner"), F.min_by("object", F.when((F.col("class") == "CMicroscopeStand") & (F.lower("object") != "microscope"), F.col("node"))).alias("MicroscopeModel"))
    return out.withColumns({"magnification": scalar.magnification(F.col("objective")), "immersion": scalar.immersion(F.col("objective"))})


def lines(nodes: DataFrame) -> DataFrame:
    """(path, element, wavelength_nm, intensity_percent) of the lines in use: the line's wavelength stands in its description."""
    rows = hardware_records(nodes).where("class = 'CAotf' AND NOT lower(attribute) LIKE '%low'")
    nm = F.regexp_extract("description", "AOTF *[(]([0-9]+[.]?[0-9]*)[)]", 1).try_cast("double")
    return rows.select(*KEY, "node", nm.alias("wavelength_nm"), F.bround(F.col("value").try_cast("double"), 2).alias("intensity_percent")).where("intensity_percent > 0 AND wavelength_nm IS NOT NULL")


def lasers(nodes: DataFrame) -> DataFrame:
    """(path, element, name, wavelength_nm, power_state, output_power_percent), one row per laser."""
    rows = hardware_records(nodes).where("class = 'CLaser'")
    one = lambda a: F.max_by("value", F.when(F.lower("attribute") == a, F.col("node")))
    return rows.groupBy(*KEY, F.col("object").alias("name")).agg(F.min("node").alias("node"), one("wavelength").try_cast("double").alias("wavelength_nm"), one("power state").alias("power_state"), one("output power").try_cast("double").alias("output_power_percent"))


def detectors(nodes: DataFrame) -> DataFrame:
    """Active detection units in order: type, gain (else high voltage), mode, and the number their name ends with."""
    rows = hardware_records(nodes).where("class = 'CDetectionUnit'")
    one = lambda a: F.max_by("value", F.when(F.lower("attribute") == a, F.col("node")))
    units = rows.groupBy(*KEY, "object").agg(F.min("node").alias("node"), one("state").alias("state"), F.coalesce(one("gain"), one("highvoltage")).try_cast("double").alias("gain"), one("acquisitionmode").alias("mode"))
    kind = F.when(F.lower("object").contains("hyd"), "HyD").when(F.lower("object").contains("pmt"), "PMT").otherwise(F.col("object"))
    return units.where("lower(state) = 'active'").select(*KEY, "object", "node", kind.alias("detector"), "gain", "mode", F.regexp_extract("object", "([0-9]+) *$", 1).alias("number"))


def spectra(nodes: DataFrame) -> DataFrame:
    """(path, element, detector, left_nm, right_nm, emission, excitation): the mirror channel of each detector's number."""
    rows = hardware_records(nodes).where("class = 'CSpectrophotometerUnit' AND lower(attribute) = 'wavelength'")
    mirror = rows.groupBy(*KEY, F.regexp_extract("object", "SP Mirror Channel ([0-9]+)", 1).alias("number")).agg(F.slice(in_order(F.col("value").try_cast("double")), 1, 2).alias("edges")).where("size(edges) >= 2")
    found = detectors(nodes).where("number <> ''").join(mirror, [*KEY, "number"])
    left, right = F.get("edges", F.lit(0)), F.get("edges", F.lit(1))
    found = found.select(*KEY, "node", "detector", left.alias("left_nm"), right.alias("right_nm"), F.bround(left + (right - left) / 2).alias("emission"))
    used = lines(nodes).select(*KEY, F.col("wavelength_nm").alias("emission"), F.col("wavelength_nm").alias("line"))
    return relational.nearest_lower(found, used, KEY, "emission", "line", "excitation").fillna({"excitation": 0.0})


def depth(nodes: DataFrame) -> DataFrame:
    """Begin and end of the stack, from the third dimension's origin and length."""
    own = nodes.where((F.col("tag") == "DimensionDescription") & (attr("DimID") == "3"))
    begin = attr("Origin").try_cast("double")
    return own.groupBy(*KEY).agg(F.min_by(begin, "node").alias("zstack_begin_m"), F.min_by(begin + attr("Length").try_cast("double"), "node").alias("zstack_end_m"))


def parts(nodes: DataFrame) -> list[DataFrame]:
    """What the records say, as tables with one row for each image and columns that begin with "old_"."""
    found = [scanner(nodes), hardware(nodes), depth(nodes)]
    return [t.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in t.columns if c not in KEY], *([F.lit(True).alias(f"old{k}")] if k < 2 else [])) for k, t in enumerate(found)]


def filled(wide: DataFrame) -> DataFrame:
    """``wide`` (with the columns of ``parts``) with open fields filled, for images that have such records."""
    names = [c[4:] for c in wide.columns if c.startswith("old_")]
    has = F.coalesce(F.col("old0"), F.col("old1"), F.lit(False))
    value = lambda c: F.when(has, F.col(f"old_{c}"))
    own = {c: F.coalesce(F.when(~scalar.missing(F.col(c)), F.col(c)), value(c)) if c in wide.columns else value(c) for c in names}
    return wide.withColumns(own).drop("old0", "old1", *[f"old_{c}" for c in names])


def fill(wide: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wide`` with open fields filled from the records of images that have some."""
    return filled(wide.join(images.stacked(parts(nodes)), KEY, "left"))
