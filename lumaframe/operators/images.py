"""Elements, images and their metadata, as expressions over the XML node table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import relational

KEY = ["path", "element"]

# Which dimension number stands for which axis, and which attribute of the confocal
# settings gives which field, as what, times what.
AXES = {1: "x", 2: "y", 3: "z", 4: "t", 10: "tile"}
CONFOCAL = [
    ("SystemTypeName", "SystemTypeName", "string", None),
    ("MicroscopeModel", "MicroscopeModel", "string", None),
    ("objective", "ObjectiveName", "string", None),
    ("na", "NumericalAperture", "double", None),
    ("refractiveindex", "RefractionIndex", "double", None),
    ("immersion", "Immersion", "string", None),
    ("magnification", "Magnification", "double", None),
    ("pinholesize_um", "Pinhole", "double", 1e6),
    ("pinhole_airy", "PinholeAiry", "double", None),
    ("zstack_begin_m", "Begin", "double", None),
    ("zstack_end_m", "End", "double", None),
    ("zstack_sections", "Sections", "int", None),
    ("zoom", "Zoom", "double", None),
    ("scan_speed", "ScanSpeed", "int", None),
    ("scan_direction", "ScanDirectionXName", "string", None),
    ("phase_x", "PhaseX", "double", None),
    ("rotator_angle", "RotatorAngle", "double", None),
    ("system_serial_number", "SystemSerialNumber", "string", None),
    ("scan_mode", "ScanMode", "string", None),
    ("pixel_dwell_time_us", "PixelDwellTime", "double", 1e6),
    ("line_time_us", "LineTime", "double", 1e6),
    ("frame_time_ms", "FrameTime", "double", 1e3),
    ("frame_average", "FrameAverage", "int", None),
    ("line_average", "LineAverage", "int", None),
    ("frame_accumulation", "FrameAccumulation", "int", None),
    ("line_accumulation", "Line_Accumulation", "int", None),
    ("stage_pos_x_m", "StagePosX", "double", None),
    ("stage_pos_y_m", "StagePosY", "double", None),
    ("temperature_c", "IncubatorTemperature", "double", None),
    ("co2_percent", "IncubatorCO2Percentage", "double", None),
    ("objective_heater_c", "ObjectiveHeaterTemperature", "double", None),
    ("coverslip_thickness_um", "CoverGlassThickness", "double", 1e6),
    ("flipx", "FlipX", "int", None),
    ("flipy", "FlipY", "int", None),
    ("swapxy", "SwapXY", "int", None),
]


#: Columns of the key-value record with their types: those that a table lacks count as null.
LATER = {
    **{c: "array<string>" for c in ("lutname", "channel_names", "filterblock", "contrastmethod", "detector_types")},
    **{c: "array<double>" for c in ("excitation", "emission", "gammavalue", "detector_gains", "detector_offsets", "exposure_times_s", "camera_gains")},
    **{c: "string" for c in ("mic_type", "mic_type2", "objective", "immersion", "SystemTypeName", "MicroscopeModel", "system_serial_number", "experiment_name", "scan_direction", "scan_mode", "camera_name")},
    **{c: "double" for c in ("na", "magnification", "refractiveindex", "coverslip_thickness_um", "pinholesize_um", "pinhole_airy", "zoom", "pixel_dwell_time_us", "line_time_us", "frame_time_ms", "phase_x", "rotator_angle")},
    **{c: "double" for c in ("zstack_begin_m", "zstack_end_m", "stage_pos_x_m", "stage_pos_y_m", "temperature_c", "co2_percent", "objective_heater_c")},
    **{c: "int" for c in ("scan_speed", "frame_average", "line_average", "frame_accumulation", "line_accumulation", "zstack_sections", "binning")},
    "isrgb": "boolean", "is_resonant_scanner": "boolean", "experiment_time": "timestamp",
    "laser_intensities": "array<struct<wavelength_nm:double,intensity_percent:double>>", "led_intensities": "array<struct<wavelength_nm:int,intensity_percent:double>>",
}


def with_all(wide: DataFrame) -> DataFrame:
    return wide.withColumns({c: F.lit(None).cast(kind) for c, kind in LATER.items() if c not in wide.columns})


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def number(name: str, kind: str = "double") -> Column:
    """An attribute as a number; null where it isn't one."""
    value = attr(name).try_cast("double")
    return value.cast("int") if kind == "int" else value.cast("long") if kind == "long" else value


def elements(nodes: DataFrame) -> DataFrame:
    """(path, element, parent_element, ordinal, name, uuid, block_id, memory_size, is_image).

    An element without a unique id is known by its memory block's; it is an image if it has a
    memory block of some size.
    """
    own = nodes.where("tag = 'Element'").select("path", F.col("node").alias("element"), F.col("parent").alias("_up"), attr("Name").alias("name"), attr("UniqueID").alias("_id"))
    memory = nodes.where("tag = 'Memory'").groupBy("path", F.col("parent").alias("element")).agg(F.min_by(number("Size", "long"), "node").alias("memory_size"), F.min_by(attr("MemoryBlockID"), "node").alias("block_id"))
    above = nodes.select("path", F.col("node").alias("_up"), F.col("element").alias("parent_element"))
    out = own.join(memory, ["path", "element"], "left").join(above, ["path", "_up"], "left")
    is_image = (F.coalesce("memory_size", F.lit(0)) > 0) & ~scalar.missing(F.col("block_id"))
    return out.select("path", "element", "parent_element", "name", scalar.fill(F.col("_id"), F.col("block_id")).alias("uuid"), "block_id", F.coalesce("memory_size", F.lit(0)).alias("memory_size"), F.coalesce(is_image, F.lit(False)).alias("is_image"))


def dimensions(nodes: DataFrame) -> DataFrame:
    """Extent, spacing (in micrometres for lengths) and byte increment of every axis, one row per image."""
    dim = nodes.where("tag = 'DimensionDescription'").select(*KEY, "node", number("DimID", "int").alias("id"), number("NumberOfElements", "int").alias("n"), number("Length").alias("length"), attr("Unit").alias("unit"), number("BytesInc", "long").alias("inc"))
    raw = scalar.spacing(F.col("length"), F.col("n"), False)
    dim = dim.withColumn("raw", F.when(F.col("id") == 4, scalar.spacing(F.col("length"), F.col("n"), True)).otherwise(raw)).withColumn("um", F.col("raw") * scalar.unit_factor(F.col("unit")))
    columns = []
    for i, axis in AXES.items():
        pick = lambda c, i=i: F.max(F.when(F.col("id") == i, F.col(c)))
        columns += [F.coalesce(pick("n"), F.lit(1)).alias("tiles" if axis == "tile" else f"{axis}s"), F.coalesce(pick("inc"), F.lit(0)).alias(f"{axis}bytesinc")]
        if axis != "tile":
            columns.append(F.coalesce(pick("raw"), F.lit(0.0)).alias(f"{axis}res"))
        if axis in "xyz":
            columns.append(F.coalesce(pick("um"), F.lit(0.0)).alias(f"{axis}res2"))
    columns.append(F.max_by("unit", F.when(F.col("id").isin(1, 2, 3) & ~scalar.missing(F.col("unit")), F.col("node"))).alias("resunit"))
    return dim.groupBy(*KEY).agg(*columns)


def in_order(value: Column) -> Column:
    """The values of a group in document order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), value.alias("v")))), lambda s: s["v"])


def channels(nodes: DataFrame) -> DataFrame:
    """Channels in order: increments, bit depths, colours and dyes, and whether they are the samples of one colour image."""
    own = nodes.where("tag = 'ChannelDescription'")
    prop = nodes.where("tag = 'ChannelProperty'").select("path", F.col("node").alias("_p"), F.col("parent").alias("_channel"))
    part = lambda tag: nodes.where(F.col("tag") == tag).select("path", F.col("parent").alias("_p"), F.col("text").alias(tag))
    dyes = prop.join(part("Key"), ["path", "_p"]).join(part("Value"), ["path", "_p"]).where("Key = 'DyeName'").groupBy("path", "_channel").agg(F.min_by("Value", "_p").alias("dye"))
    own = own.join(dyes, (own["path"] == dyes["path"]) & (own["node"] == dyes["_channel"]), "left").drop(dyes["path"])
    return own.groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("int").alias("channels"),
        ((F.count(F.lit(1)) > 1) & (F.coalesce(F.min_by(number("ChannelTag", "int"), "node"), F.lit(0)) != 0)).alias("isrgb"),
        in_order(number("BytesInc", "long")).alias("channelbytesinc"),
        in_order(number("Resolution", "int")).alias("channelResolution"),
        in_order(F.lower(F.coalesce(attr("LUTName"), F.lit("")))).alias("lutname"),
        in_order(F.coalesce(F.trim("dye"), F.lit(""))).alias("channel_names"),
    )


def attachments(nodes: DataFrame, name: str) -> DataFrame:
    """The first attachment of a name in each image."""
    own = nodes.where((F.col("tag") == "Attachment") & (attr("Name") == name))
    return own.withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy("node"))).where("_k = 1").drop("_k")


def display(nodes: DataFrame) -> DataFrame:
    """Black, white and gamma values by channel, of the first viewer scaling."""
    first = attachments(nodes, "ViewerScaling").select("path", F.col("node").alias("_a"))
    info = nodes.where("tag = 'ChannelScalingInfo'")
    info = info.join(first, (info["path"] == first["path"]) & (info["parent"] == first["_a"]), "left_semi")
    value = lambda n, d: in_order(F.coalesce(number(n), F.lit(d)))
    return info.groupBy(*KEY).agg(value("BlackValue", 0.0).alias("blackvalue"), value("WhiteValue", 1.0).alias("whitevalue"), value("GammaValue", 1.0).alias("gammavalue"))


def confocal(nodes: DataFrame) -> DataFrame:
    """The fields of the first confocal (else camera) settings; a value that isn't a number is null."""
    own = nodes.where(F.col("tag").isin("ATLConfocalSettingDefinition", "ATLCameraSettingDefinition"))
    own = own.withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy(F.when(F.col("tag").contains("Confocal"), 0).otherwise(1), "node"))).where("_k = 1")
    fields = []
    for field, name, kind, factor in CONFOCAL:
        value = attr(name) if kind == "string" else number(name, kind)
        fields.append((value * factor if factor else value).alias(field))
    resonant = F.when(~scalar.missing(attr("IsResonantConfocalScanner")), attr("IsResonantConfocalScanner") == "1")
    is_confocal = F.col("tag").contains("Confocal")
    kind, kind2 = F.when(is_confocal, "IncohConfMicr").otherwise("IncohWFMicr"), F.when(is_confocal, "confocal").otherwise("camera")
    return own.select(*KEY, kind.alias("mic_type"), kind2.alias("mic_type2"), resonant.alias("is_resonant_scanner"), *fields)


def tile_positions(nodes: DataFrame) -> DataFrame:
    """(path, element, num, FieldX, FieldY, PosX, PosY) of mosaic tiles, numbered in order."""
    tile = nodes.where("tag = 'Tile'")
    return tile.select(
        *KEY, F.row_number().over(W.partitionBy(*KEY).orderBy("node")).alias("num"), number("FieldX", "int").alias("FieldX"), number("FieldY", "int").alias("FieldY"), number("PosX").alias("PosX"), number("PosY").alias("PosY")
    )


def overlaps(tiles: DataFrame, dims: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Overlap of neighbouring tiles by axis, from the least distance in a row or column; negative where there are gaps.

    Tiles are in one row where sorted positions follow each other within ``eps``.
    """
    out = []
    for axis, band in (("X", "Y"), ("Y", "X")):
        across = W.partitionBy(*KEY).orderBy(f"Pos{band}")
        opens = F.coalesce((F.col(f"Pos{band}") - F.lag(f"Pos{band}").over(across) > eps).cast("int"), F.lit(1))
        rows = tiles.withColumn("_opens", opens).withColumn("_band", F.sum("_opens").over(across.rowsBetween(W.unboundedPreceding, 0)))
        gap = relational.least_gap(rows, [*KEY, "_band"], f"Pos{axis}", "_gap", eps).groupBy(*KEY).agg(F.min("_gap").alias("_gap"))
        n, res = F.col(f"{axis.lower()}s"), F.col(f"{axis.lower()}res2")
        size = n * res / 1e6
        # rounded, so that tiles side by side have neither a gap nor an overlap by the last digit
        out.append(gap.join(dims, KEY).select(*KEY, F.when(size > 0, F.round(1 - F.col("_gap") / size, 9)).alias(f"OverlapPercentage{axis}")))
    both = out[0].join(out[1], KEY, "full")
    return both.withColumn("OverlapIsNegative", (F.coalesce("OverlapPercentageX", F.lit(0.0)) < 0) | (F.coalesce("OverlapPercentageY", F.lit(0.0)) < 0))


def lasers(nodes: DataFrame) -> DataFrame:
    """Distinct laser lines, ascending."""
    return nodes.where("tag = 'Laser'").groupBy(*KEY).agg(F.array_sort(F.collect_set(number("Wavelength"))).alias("laser_lines"))


def detectors(nodes: DataFrame) -> DataFrame:
    """Active detectors in order, with gains and offsets."""
    own = nodes.where((F.col("tag") == "Detector") & (attr("IsActive") == "1"))
    return own.groupBy(*KEY).agg(in_order(F.coalesce(attr("Name"), F.lit(""))).alias("detector_types"), in_order(number("Gain")).alias("detector_gains"), in_order(number("Offset")).alias("detector_offsets"))


def spectra(nodes: DataFrame) -> DataFrame:
    """Emission by band (its middle, half to even), the excitation as the nearest laser line below it, and dyes."""
    bands = nodes.where("tag = 'MultiBand'").select(*KEY, "node", number("LeftWorld").alias("left"), number("RightWorld").alias("right"), F.coalesce(attr("DyeName"), F.lit("")).alias("dye"))
    bands = bands.withColumn("em", F.coalesce(F.bround(F.col("left") + (F.col("right") - F.col("left")) / 2), F.lit(500.0)))
    lines = nodes.where("tag = 'Laser'").select(*KEY, number("Wavelength").alias("em"), number("Wavelength").alias("ex")).where("em IS NOT NULL")
    found = relational.nearest_lower(bands, lines, KEY, "em", "ex", "excitation_line")
    ex = F.when(F.col("left").isNull() | F.col("right").isNull(), 480.0).otherwise(F.coalesce("excitation_line", F.lit(0.0)))
    return found.groupBy(*KEY).agg(in_order(F.col("em")).alias("emission"), in_order(ex).alias("excitation"), in_order(F.col("dye")).alias("filterblock"))


def hierarchy(found: DataFrame) -> DataFrame:
    """(path, element, trail): names from the root down, joined by "_"."""
    from lumaframe.operators import tree

    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("#", "path", F.col(c).cast("string")))
    nodes = found.select(key("element").alias("id"), key("parent_element").alias("parent"), F.coalesce("name", F.lit("")).alias("name"))
    names = tree.paths(nodes, "_").select(F.col("id").alias("_id"), F.col("path").alias("trail"), "depth")
    return found.join(names, key("element") == F.col("_id")).select(*KEY, "trail", "depth")


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Tables with at most one row for each image, and columns of their own, as one table: put below each other and folded by image.

    One aggregation stands for a join with each of them, however many there are.
    """
    columns = [c for p in parts for c in p.columns if c not in KEY]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(*KEY).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def images(nodes: DataFrame, blocks: DataFrame, more: list[DataFrame] | None = None) -> DataFrame:
    """One wide row for each image: identity, place of its pixels, extent, spacing, channels, display and settings; ``more`` tables go along."""
    found = elements(nodes)
    base = F.regexp_replace(F.substring_index("path", "/", -1), "[.][^.]*$", "")
    dims = dimensions(nodes)
    parts = [hierarchy(found), dims, channels(nodes), display(nodes), confocal(nodes), lasers(nodes), detectors(nodes), spectra(nodes), overlaps(tile_positions(nodes), dims)]
    tiles = tile_positions(nodes).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("num", "FieldX", "FieldY", "PosX", "PosY"))).alias("tile_positions"))
    wide = stacked([found.where("is_image").drop("is_image"), *parts, tiles, *(more or [])]).where("uuid IS NOT NULL")
    # a .lof file has one block without a name
    wide = wide.withColumn("_block", F.when(F.lower("path").endswith(".lof"), F.lit("")).otherwise(F.col("block_id")))
    block = blocks.select("path", F.col("block_id").alias("_block"), F.col("position").alias("Position"), F.col("size").alias("_size"))
    wide = wide.join(block, ["path", "_block"], "left").drop("_block")
    n = F.coalesce("channels", F.lit(1))
    fill = lambda c, d: F.coalesce(c, F.array_repeat(F.lit(d), n)).alias(c)
    defaults = {c: fill(c, d) for c, d in (("blackvalue", 0.0), ("whitevalue", 1.0), ("gammavalue", 1.0))}
    wide = wide.withColumns(defaults).withColumn("channels", n)
    name = F.concat_ws("_", base, F.col("trail"))
    return wide.withColumn("save_child_name", name).withColumn("MemorySize", F.coalesce("_size", "memory_size")).drop("_size")


def list_images(nodes: DataFrame) -> DataFrame:
    """The pruned listing: what a browser shows of each image, in document order."""
    found = elements(nodes)
    dims = dimensions(nodes).select(*KEY, "xs", "ys", "zs", "ts", "tiles")
    return found.where("is_image").join(dims, KEY, "left").join(channels(nodes).select(*KEY, "channels", "isrgb"), KEY, "left").orderBy("path", "element")


def children(nodes: DataFrame, uuid: str | None = None) -> DataFrame:
    """The direct children of the element with this id, or of the root."""
    found = elements(nodes)
    top = found.where(F.col("uuid") == uuid) if uuid else found.where("parent_element IS NULL")
    up = top.select("path", F.col("element").alias("parent_element"))
    return found.join(up, ["path", "parent_element"]).where(~scalar.noise_name(F.coalesce("name", F.lit("")))).orderBy("path", "element")


def node(nodes: DataFrame, uuid: str) -> DataFrame:
    """The element with an id and its direct children: (path, element, uuid, name, is_image, is_self)."""
    found = elements(nodes)
    own = found.where(F.col("uuid") == uuid).withColumn("is_self", F.lit(True))
    return own.unionByName(children(nodes, uuid).withColumn("is_self", F.lit(False))).orderBy("path", "element")


def key_values(wide: DataFrame) -> DataFrame:
    """The conditional key-value record as JSON: a key stands only where its value says something."""
    wide = with_all(wide)
    wide = wide.withColumn("_time", F.date_format(F.col("experiment_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    rgb, confocal_, camera = F.coalesce("isrgb", F.lit(False)), F.col("mic_type") == "IncohConfMicr", F.col("mic_type") == "IncohWFMicr"
    known = lambda c: F.when(F.exists(c, lambda v: v.isNotNull()), F.col(c))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    said = lambda c: F.when(~scalar.missing(F.col(c)), F.col(c))
    above = lambda c, least=0: F.when(F.col(c) > least, F.col(c))
    any_said = lambda c: F.when(F.exists(c, lambda v: F.coalesce(v != "", F.lit(False))), F.col(c))
    any_above = lambda c: F.when(F.exists(c, lambda v: F.coalesce(v > 0, F.lit(False))), F.transform(c, lambda v: F.coalesce(v, F.lit(0)).cast("int")))
    pairs = {
        "lut_names": any_said("lutname"),
        "channel_names": any_said("channel_names"),
        "excitation_wavelengths": F.when(~rgb, any_above("excitation")),
        "emission_wavelengths": F.when(~rgb, any_above("emission")),
        "filter_blocks": F.when(~rgb & F.exists("filterblock", lambda v: F.coalesce((v != "") & (v != "Unknown"), F.lit(False))), F.col("filterblock")),
        "contrast_methods": F.when(~rgb, any_said("contrastmethod")),
        "experiment_name": said("experiment_name"),
        "experiment_datetime": said("_time"),
        "microscope_type": F.when(F.col("mic_type") != "unknown", said("mic_type")),
        "gamma_values": F.when(F.exists("gammavalue", lambda v: v != 1), F.col("gammavalue")),
        **{k: said(c) for k, c in (("objective", "objective"), ("immersion", "immersion"), ("system_type_name", "SystemTypeName"), ("microscope_model", "MicroscopeModel"), ("system_serial_number", "system_serial_number"))},
        **{k: above(c) for k, c in (("numerical_aperture", "na"), ("magnification", "magnification"), ("refractive_index", "refractiveindex"), ("coverslip_thickness_um", "coverslip_thickness_um"))},
        "pinhole_size_um": F.when(confocal_, above("pinholesize_um")),
        "detector_types": F.when(confocal_, any_said("detector_types")),
        **{c: F.when(confocal_, known(c)) for c in ("detector_gains", "detector_offsets")},
        "exposure_times_s": F.when(camera & F.exists("exposure_times_s", lambda v: F.coalesce(v > 0, F.lit(False))), F.col("exposure_times_s")),
        "camera_gains": F.when(camera, known("camera_gains")),
        "camera_name": F.when(camera, said("camera_name")),
        "binning": F.when(camera, above("binning")),
        "laser_intensities": F.when(~rgb & confocal_, some("laser_intensities")),
        "led_intensities": F.when(~rgb & camera, some("led_intensities")),
        **{c: F.when(confocal_, above(c)) for c in ("pinhole_airy", "zoom", "scan_speed", "pixel_dwell_time_us", "line_time_us", "frame_time_ms")},
        **{c: F.when(confocal_, above(c, 1)) for c in ("frame_average", "line_average", "frame_accumulation", "line_accumulation", "zstack_sections")},
        **{c: F.when(confocal_, said(c)) for c in ("scan_direction", "scan_mode")},
        **{c: F.when(confocal_, F.col(c)) for c in ("phase_x", "rotator_angle", "is_resonant_scanner", "zstack_begin_m", "zstack_end_m")},
        **{c: F.col(c) for c in ("stage_pos_x_m", "stage_pos_y_m", "temperature_c", "co2_percent", "objective_heater_c")},
    }
    return wide.withColumn("keyvalues", F.to_json(F.struct(*[v.alias(k) for k, v in pairs.items()]))).drop("_time")


def route(wide: DataFrame, threshold: int = 3192) -> DataFrame:
    """Which writer an image goes to."""
    ext = F.lower(F.regexp_extract("path", "([.][^.]*)$", 1))
    gaps = (F.coalesce("tiles", F.lit(1)) > 1) & F.coalesce("OverlapIsNegative", F.lit(False))
    small = (F.col("xs") <= threshold) & (F.col("ys") <= threshold)
    return wide.withColumn("route", F.when((ext == ".lif") & gaps, "single lif").when((ext != ".lif") & (small | gaps), "as it is").when(F.coalesce("isrgb", F.lit(False)), "rgb").otherwise("planar"))
