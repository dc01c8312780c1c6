"""The whole description of images: what confocal, camera and older records say, put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import scalar
from lumaframe.operators import images, legacy, linked, widefield
from lumaframe.operators.images import KEY, attr, in_order, number
from lumaframe.sources import containers


def times(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(path, element, experiment_time): the first time stamp of each image, as a hexadecimal word or in two words; else when its file was changed."""
    word = F.when((F.col("tag") == "TimeStampList") & (F.col("text") != ""), F.regexp_extract("text", "^([^ \n\t]+)", 1))
    pair = F.when(F.col("tag") == "TimeStamp", scalar.from_filetime(number("HighInteger", "long"), number("LowInteger", "long")))
    at = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("node")))
    own = nodes.where("tag IN ('TimeStampList', 'TimeStamp', 'Memory')").groupBy(*KEY).agg(at(word).alias("_word"), at(pair).alias("_pair"))
    micros = F.coalesce(scalar.filetime_micros(scalar.hex_number(F.col("_word"))), F.col("_pair"))
    changed = found.select("path", F.col("modified").alias("_changed"))
    return own.join(changed, "path", "left").select(*KEY, F.coalesce(F.timestamp_micros(micros), F.col("_changed").cast("timestamp")).alias("experiment_time"))


def tile_scan(nodes: DataFrame) -> DataFrame:
    """Flips of a mosaic's tiles."""
    own = images.attachments(nodes, "TileScanInfo")
    return own.select(*KEY, *[number(a, "int").alias(f"tilescan_{a.lower()}") for a in ("FlipX", "FlipY", "SwapXY")])


def stated_overlap(nodes: DataFrame) -> DataFrame:
    """Overlaps that the settings state, where tile positions give none."""
    own = nodes.where("tag = 'StitchingSettings'")
    return own.groupBy(*KEY).agg(*[F.min_by(number(f"OverlapPercentage{a}"), "node").alias(f"_over{a}") for a in "XY"])


def laser_intensities(nodes: DataFrame) -> DataFrame:
    """Lines in use with their intensities in per cent."""
    own = nodes.where("tag = 'Laser'").withColumn("_i", widefield.percent(F.coalesce(number("IntensityDev"), number("Intensity"))))
    rows = own.where("_i > 0").groupBy(*KEY).agg(in_order(F.struct(number("Wavelength").alias("wavelength_nm"), F.col("_i").alias("intensity_percent"))).alias("laser_intensities"))
    old = legacy.lines(nodes).groupBy(*KEY).agg(in_order(F.struct("wavelength_nm", "intensity_percent")).alias("_old"))
    return rows.join(old, KEY, "full").select(*KEY, F.coalesce("laser_intensities", "_old").alias("laser_intensities"))


def first_said(wide: DataFrame, own: str, others: list[str]) -> Column:
    """The first of the columns that isn't empty."""
    kind = dict(wide.dtypes)
    columns = [c for c in (own, *others) if c in kind]
    said = lambda c: F.when((F.size(c) > 0) if kind[c].startswith("array") else ~scalar.missing(F.col(c)), F.col(c))
    return F.coalesce(*map(said, columns))


def named(table: DataFrame, prefix: str) -> DataFrame:
    return table.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in table.columns if c not in KEY])


def describe(nodes: DataFrame, found: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One wide row for each image. Newer settings come first, diodes and camera channels next, older records fill what is
    open, then come the defaults of fluorescence; pixels of linked images are resolved last."""
    blocks = containers.memory_blocks(found) if blocks is None else blocks
    diodes = widefield.led_channels(nodes).where(F.size("leds") > 0)
    band = F.concat(F.col("detector"), F.lit(" "), F.col("left_nm").cast("string"), F.lit("-"), F.col("right_nm").cast("string"))
    old = legacy.detectors(nodes).groupBy(*KEY).agg(in_order(F.col("detector")).alias("detector_types"), in_order(F.col("gain")).alias("detector_gains"))
    old_spectra = legacy.spectra(nodes).groupBy(*KEY).agg(in_order(F.col("emission")).alias("emission"), in_order(F.col("excitation")).alias("excitation"), in_order(band).alias("filterblock"))
    more = [
        named(widefield.by_image(diodes), "a_"),
        diodes.groupBy(*KEY).agg(F.flatten(in_order(F.col("led_intensities"))).alias("led_intensities")),
        named(widefield.by_image(widefield.channels(nodes)), "b_"),
        widefield.cameras(nodes),
        named(old, "c_"),
        named(old_spectra, "c_"),
        laser_intensities(nodes),
        tile_scan(nodes),
        stated_overlap(nodes),
        times(nodes, found),
        *legacy.parts(nodes),
    ]
    wide = legacy.filled(images.images(nodes, blocks, more))
    own = {c: first_said(wide, c, [f"{k}_{c}" for k in "abc"]) for c in ("emission", "excitation", "filterblock", "contrastmethod", "detector_types", "detector_gains")}
    over = {f"OverlapPercentage{a}": first_said(wide, f"OverlapPercentage{a}", [f"_over{a}"]) for a in "XY"}
    unknown = F.col("mic_type2").isNull()
    old_confocal = scalar.legacy_confocal(F.when(unknown, F.col("SystemTypeName")), F.when(unknown, F.col("scan_mode")), F.lit(None)) & unknown
    kinds = {"mic_type": F.when(old_confocal, "IncohConfMicr").otherwise(F.col("mic_type")), "mic_type2": F.when(old_confocal, "confocal").otherwise(F.col("mic_type2"))}
    wide = wide.withColumns(own | over | kinds)
    wide = widefield.defaults(wide.drop("_overX", "_overY", *[c for c in wide.columns if c[:2] in ("a_", "b_", "c_")]))
    linked_there = not nodes.where("tag = 'Block'").isEmpty()
    wide = linked.with_pixels(wide, nodes, found) if linked_there else wide.withColumn("pixel_path", F.col("path"))
    wide = identified(wide, found)
    factor = scalar.unit_factor(F.col("resunit"))
    wide = wide.withColumns({f"{a}res2": scalar.reconciled(F.col(f"{a}res"), F.col(f"{a}res2"), factor) for a in "xyz"})
    shape = F.struct(*[F.col(c).alias(n) for n, c in (("x", "xs"), ("y", "ys"), ("z", "zs"), ("c", "channels"), ("t", "ts"), ("s", "tiles"))], F.coalesce("isrgb", F.lit(False)).alias("isrgb"))
    return wide.withColumn("dimensions", shape)


def identified(wide: DataFrame, found: DataFrame) -> DataFrame:
    """``wide`` with an id for single-image files that name none: one made of the path and of the sizes of what the file holds."""
    lengths = found.select(F.col("path").alias("_file"), F.length("xml").alias("_chars"))
    out = wide.join(lengths, wide["path"] == lengths["_file"], "left")
    unnamed = F.lower("path").endswith(".lof") & (scalar.missing(F.col("uuid")) | F.col("uuid").eqNullSafe(F.col("block_id")))
    own = scalar.file_uuid(F.col("path"), F.col("_chars"), F.coalesce("MemorySize", F.lit(0)))
    return out.withColumn("uuid", F.when(unnamed, own).otherwise(F.col("uuid"))).drop("_file", "_chars")


def reject_reason(wide: DataFrame, colour: bool | None = None) -> DataFrame:
    """``wide`` with reject_reason: why a writer can't take the image (``colour``: one for colour images or for others), null if it can."""
    gone = [F.when(F.col(c).isNull(), c) for c in ("xs", "ys", "channels", "Position")]
    tiled = F.coalesce("tiles", F.lit(1)) > 1
    gone.append(F.when(tiled & (F.coalesce(F.size("tile_positions"), F.lit(0)) <= 0), "tile_positions"))
    missing = F.array_compact(F.array(*gone))
    sizes = [F.coalesce(c, F.lit(1)) <= 0 for c in ("xs", "ys", "zs", "ts", "channels")]
    rgb = F.coalesce("isrgb", F.lit(False))
    reason = F.when(F.lit(colour is not None) & (rgb != F.lit(bool(colour))), "colour").when(F.coalesce("OverlapIsNegative", F.lit(False)), "gaps between tiles")
    reason = reason.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(sizes[0] | sizes[1] | sizes[2] | sizes[3] | sizes[4], "no extent")
    return wide.withColumn("reject_reason", reason)


def summary_text(wide: DataFrame) -> DataFrame:
    """``wide`` with a text of what a viewer shows of an image, line by line; what isn't known has no line."""
    list_of = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda v: F.concat(F.regexp_replace(v.cast("double").cast("string"), "[.]0$", ""), F.lit(" nm"))), ", "))
    has = set(wide.columns)
    col = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    details = F.concat_ws(", ", F.when(col("magnification") > 0, F.concat(F.regexp_replace(col("magnification").cast("string"), "[.]0$", ""), F.lit("×"))), F.when(col("na") > 0, F.concat(F.lit("NA "), col("na").cast("string"))), scalar.fill(col("immersion")))
    objective = F.when(~scalar.missing(col("objective")), F.concat(col("objective"), F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise("")))
    size = F.concat(F.concat_ws(" x ", col("xs").cast("string"), col("ys").cast("string"), F.when(col("zs") > 1, col("zs").cast("string"))), F.lit(" pixels"))
    spacing = F.when(col("xres2") > 0, F.format_string("%.2f µm", F.bround(col("xres2").cast("double"), 2)))
    lines = [
        scalar.line("Name", col("name")), scalar.line("Size", F.when(col("xs").isNotNull() & col("ys").isNotNull(), size)), scalar.line("Channels", F.when(col("channels") > 1, col("channels"))), scalar.line("Times", F.when(col("ts") > 1, col("ts"))),
        scalar.line("Pixel", spacing), scalar.line("Experiment", col("experiment_name")), scalar.line("Date", F.date_format(col("experiment_time", "timestamp"), "yyyy-MM-dd HH:mm:ss")), scalar.line("Microscope", F.concat_ws(" ", scalar.fill(col("SystemTypeName")), scalar.fill(col("MicroscopeModel")))),
        scalar.line("Objective", objective), scalar.line("Excitation", list_of(col("excitation", "array<double>"))), scalar.line("Emission", list_of(col("emission", "array<double>"))),
    ]
    return wide.withColumn("summary", scalar.summary(*lines))


def shown(wide: DataFrame) -> DataFrame:
    """``wide`` with what the description of an image shows of its channels: labels, colours, contrasts, light and detectors."""
    wide = images.with_all(wide)
    rgb, n = F.coalesce("isrgb", F.lit(False)), F.coalesce("channels", F.lit(1))
    each = F.sequence(F.lit(0), n - 1)
    contrast = lambda i: scalar.contrast_name(F.coalesce(F.get("contrastmethod", i), F.lit("")))
    colour = lambda h: F.conv(h, 16, 10).cast("long")
    packed = lambda v: scalar.pack_colour(F.shiftright(v, 16).bitwiseAND(F.lit(255)), F.shiftright(v, 8).bitwiseAND(F.lit(255)), v.bitwiseAND(F.lit(255)))
    wide = wide.withColumn("colours", scalar.channel_colours(F.col("lutname"), n, rgb))
    return wide.withColumns(
        {
            "labels": scalar.channel_labels(F.col("channel_names"), F.col("filterblock"), n, rgb),
            "ome_colours": F.transform("colours", lambda h: packed(colour(h))),
            "contrasts": F.transform(each, contrast),
            "illuminations": F.transform(each, lambda i: scalar.illumination(F.col("mic_type2"), contrast(i))),
            "acquisition_mode": scalar.acquisition(F.col("mic_type2")),
            "detector_kinds": F.transform("detector_types", scalar.detector_type),
            "bits": scalar.bit_depths(F.col("channelResolution"), n, rgb),
            "scale_x": scalar.axis_scale(F.col("xres2"), F.col("xres"), F.lit(1.0)),
            "scale_y": scalar.axis_scale(F.col("yres2"), F.col("yres"), scalar.axis_scale(F.col("xres2"), F.col("xres"), F.lit(1.0))),
            "display_black": scalar.display_levels(F.col("blackvalue"), F.col("channelResolution"), n),
            "display_white": scalar.display_levels(F.col("whitevalue"), F.col("channelResolution"), n, 1.0),
        }
    )


def windows(wide: DataFrame, stats: DataFrame) -> DataFrame:
    """(c, low, high) of one image's channels for a viewer: what was measured, within the type's range."""
    top = F.when(F.coalesce(F.array_max("channelResolution"), F.lit(8)) > 8, 65535).otherwise(255)
    shown = stats.join(wide.select(F.col("uuid").alias("_u"), top.alias("_top")), F.col("uuid") == F.col("_u"))
    return shown.select("c", scalar.window(F.col("vmin"), F.col("vmax"), F.col("_top")).alias("w")).select("c", F.col("w.min").alias("low"), F.col("w.max").alias("high"))


def intensities(wide: DataFrame, stats: DataFrame) -> DataFrame:
    """``wide`` with channel_mins and channel_maxs by channel: those measured, else the whole range of the type."""
    rows = stats.groupBy(F.col("uuid").alias("_u")).agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("vmin", "vmax")))).alias("_m"))
    out = wide.join(rows, wide["uuid"] == rows["_u"], "left").drop("_u")
    n = F.when(F.coalesce("isrgb", F.lit(False)), 3).otherwise(F.coalesce("channels", F.lit(1)))
    top = F.when(F.coalesce(F.array_max("channelResolution"), F.lit(8)) > 8, 65535).otherwise(255)
    at = lambda part, default: F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.coalesce(F.try_element_at("_m", c)[part], default).cast("int"))
    return out.withColumns({"channel_mins": at("vmin", F.lit(0)), "channel_maxs": at("vmax", top)}).drop("_m")
