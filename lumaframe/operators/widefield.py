"""Channels of camera images: filter cubes, light sources, cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators.images import KEY, attr, in_order, number

# Excitation and emission wavelengths by the name of a filter cube.
CUBES = {
    "DAPI": (355, 460), "DAP": (355, 460), "A": (355, 460), "Blue": (355, 460), "L5": (480, 527), "I5": (480, 527), "Green": (480, 527), "FITC": (480, 527), "N3": (545, 605),
    "N2.1": (545, 605), "TRITC": (545, 605), "488": (488, 525), "532": (532, 550), "642": (642, 670), "Red": (545, 605), "Y3": (545, 605), "I3": (545, 605), "Y5": (590, 700),
}
LEDS = range(8)


def percent(value):
    """Shares up to one become per cent; two digits."""
    return F.bround(F.when(value <= 1, value * 100).otherwise(value), 2)


def channels(nodes: DataFrame) -> DataFrame:
    """(path, element, node, cube, contrast, name, excitation, emission) of each wide-field channel.

    Cubes for several dyes name their filter elsewhere; channels of a focus finder are left out.
    """
    skip = nodes.where((F.col("tag") == "WideFieldChannelConfigurator") & (attr("ThisIsHSAutofocusInstance") == "1")).select("path", F.col("node").alias("parent"))
    own = nodes.where("tag = 'WideFieldChannelInfo'").join(skip, ["path", "parent"], "left_anti")
    cube = F.coalesce(attr("FluoCubeName"), F.lit(""))
    single = F.when(cube == "QUAD-S", attr("FFW_Excitation1FilterName")).when(cube == "DA/FI/TX", attr("LUT")).otherwise(cube)
    table = lambda k: scalar.literal_map({n: float(v[k]) for n, v in CUBES.items()})
    own = own.withColumns({"cube": cube, "filter": F.coalesce(single, F.lit(""))})
    found = own.withColumns({"excitation": F.coalesce(F.try_element_at(table(0), F.col("filter")), F.lit(0.0)), "emission": F.coalesce(F.try_element_at(table(1), F.col("filter")), F.lit(0.0))})
    block = F.when((F.col("cube") != F.col("filter")) | (F.col("cube") == ""), F.concat_ws(": ", "cube", "filter")).otherwise(F.col("cube"))
    return found.select(*KEY, "node", block.alias("filterblock"), attr("ContrastingMethodName").alias("contrast"), attr("UserDefName").alias("name"), "excitation", "emission", attr("EmissionWavelength").alias("own_emission"), "attrs")


def led_channels(nodes: DataFrame) -> DataFrame:
    """The same for microscopes with light-emitting diodes: the last active diode excites, the channel has its own emission."""
    found = channels(nodes)
    active = [F.when(attr(f"ILLEDActiveState{i}") == "1", F.struct(F.coalesce(number(f"ILLEDWavelength{i}"), F.lit(0.0)).alias("wavelength_nm"), number(f"ILLEDIntensity{i}").alias("intensity"))) for i in LEDS]
    lit = F.filter(F.array(*active), lambda d: d.isNotNull())
    emission = F.coalesce(F.col("own_emission").try_cast("double"), F.lit(0.0))
    found = found.withColumns({"leds": lit, "emission": emission})
    found = found.withColumn("excitation", F.coalesce(F.try_element_at("leds", F.lit(-1))["wavelength_nm"], F.lit(0.0)))
    shown = F.transform(F.filter("leds", lambda d: (d["wavelength_nm"] > 0) & d["intensity"].isNotNull()), lambda d: F.struct(d["wavelength_nm"].cast("int").alias("wavelength_nm"), percent(d["intensity"]).alias("intensity_percent")))
    label = F.concat_ws(" ", F.coalesce(attr("FluoCubeName"), F.lit("")), F.col("emission").cast("int").cast("string"))
    return found.withColumns({"led_intensities": shown, "filterblock": label})


def by_image(found: DataFrame) -> DataFrame:
    """One row per image with its channels as arrays."""
    columns = [in_order(F.coalesce(c, F.lit(d))).alias(n) for c, d, n in (("filterblock", "", "filterblock"), ("contrast", "", "contrastmethod"), ("excitation", 0.0, "excitation"), ("emission", 0.0, "emission"))]
    return found.groupBy(*KEY).agg(*columns)


def cameras(nodes: DataFrame) -> DataFrame:
    """Name, binning, exposures and gains of an image's cameras."""
    name = nodes.where("tag = 'WideFieldChannelConfigurator'").groupBy(*KEY).agg(F.min_by(attr("CameraName"), "node").alias("camera_name"))
    size = nodes.where("tag = 'CameraFormat'").groupBy(*KEY).agg(F.min_by(number("Binning", "int"), "node").alias("binning"))
    each = nodes.where("tag = 'IndividualCameraInfo'").groupBy(*KEY).agg(in_order(number("ExposureTime")).alias("exposure_times_s"), in_order(number("GainValue")).alias("camera_gains"))
    return name.join(size, KEY, "full").join(each, KEY, "full")


def defaults(wide: DataFrame) -> DataFrame:
    """What fluorescence images have where nothing is said, padded to the number of channels; colour images are left alone."""
    n = F.coalesce("channels", F.lit(1))
    grey = ~F.coalesce("isrgb", F.lit(False))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    pad = lambda c, d: F.when(grey & empty(c), F.array_repeat(F.lit(d), n)).otherwise(F.col(c))
    blocks = F.when(grey, F.concat(F.coalesce("filterblock", F.array().cast("array<string>")), F.array_repeat(F.lit("Unknown"), F.greatest(n - F.coalesce(F.size("filterblock"), F.lit(0)), F.lit(0))))).otherwise(F.col("filterblock"))
    return wide.withColumns({"emission": pad("emission", 500.0), "excitation": pad("excitation", 480.0), "filterblock": blocks})
