"""Scalar rules of the imaging metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Micrometres in one unit, by its singular name; time stamps count 100 ns from 1601-01-01.
# Nanometres and picometres count as what they are (a deviation: where they are unknown they would count as micrometres).
UNIT_MICROMETRES = {
    "meter": 1e6, "metre": 1e6, "m": 1e6, "centimeter": 1e4, "centimetre": 1e4, "cm": 1e4, "millimeter": 1e3, "millimetre": 1e3, "mm": 1e3,
    "micrometer": 1.0, "micrometre": 1.0, "micron": 1.0, "um": 1.0, "µm": 1.0, "nanometer": 1e-3, "nanometre": 1e-3, "nm": 1e-3, "pm": 1e-6, "inch": 25400.0, "in": 25400.0,
}
FILETIME_EPOCH = 116444736000000000
#: Colours by their CSS names, as 0xRRGGBB (fixed values).
CSS_COLOURS = {
    "aqua": 0x00FFFF, "azure": 0xF0FFFF, "beige": 0xF5F5DC, "black": 0x000000, "blue": 0x0000FF, "blueviolet": 0x8A2BE2, "brown": 0xA52A2A, "cyan": 0x00FFFF,
    "darkblue": 0x00008B, "darkcyan": 0x008B8B, "darkgray": 0xA9A9A9, "darkgreen": 0x006400, "darkgrey": 0xA9A9A9, "darkmagenta": 0x8B008B, "darkorange": 0xFF8C00, "darkred": 0x8B0000,
    "dimgray": 0x696969, "dimgrey": 0x696969, "gray": 0x808080, "green": 0x008000, "greenyellow": 0xADFF2F, "grey": 0x808080, "indigo": 0x4B0082,
    "lightblue": 0xADD8E6, "lightcyan": 0xE0FFFF, "lightgray": 0xD3D3D3, "lightgreen": 0x90EE90, "lightgrey": 0xD3D3D3, "lightyellow": 0xFFFFE0, "lime": 0x00FF00, "limegreen": 0x32CD32,
    "magenta": 0xFF00FF, "mediumblue": 0x0000CD, "mediumpurple": 0x9370DB, "orange": 0xFFA500, "orangered": 0xFF4500, "pink": 0xFFC0CB, "purple": 0x800080, "red": 0xFF0000,
    "silver": 0xC0C0C0, "tomato": 0xFF6347, "turquoise": 0x40E0D0, "violet": 0xEE82EE, "white": 0xFFFFFF, "yellow": 0xFFFF00, "yellowgreen": 0x9ACD32,
}
#: Colours that previews draw look-up tables in (fixed values).
COLOURS = {"red": 0xFF0000, "green": 0x00FF00, "blue": 0x0000FF, "cyan": 0x00FFFF, "magenta": 0xFF00FF, "yellow": 0xFFFF00, "gray": 0xFFFFFF, "grey": 0xFFFFFF, "white": 0xFFFFFF}
#: Colours of channels without a look-up table, in turn; the samples of a colour image (fixed values).
PALETTE = ["ffffff", "00ff00", "ff00ff", "00ffff", "ffff00", "ff0000", "0000ff"]
SAMPLES = ["ff0000", "00ff00", "0000ff"]
IMMERSIONS = ("oil", "water", "glycerol", "multi", "dry", "air")
#: Bit depths that are kept as they are.
DEPTHS = (8, 12, 14, 15, 16, 32)
#: Names of bookkeeping nodes (fixed values).
MANAGERS = ("iomanagerconfiguation", "iomanagerconfiguration")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def missing(value: Column) -> Column:
    """Null, or an empty string."""
    return value.isNull() | (value.cast("string") == "")


def fill(value: Column, *others: Column) -> Column:
    """The first value that is not missing."""
    return F.coalesce(*[F.when(~missing(v), v) for v in (value, *others)])


def unit_factor(unit: Column) -> Column:
    """Micrometres in a unit: case, space, a plural "s" and the two mu signs don't matter; unknown units count as 1."""
    name = F.replace(F.lower(F.trim(unit)), F.lit("μ"), F.lit("µ"))
    short = F.regexp_replace(name, "s$", "")
    known = literal_map(UNIT_MICROMETRES)
    return F.coalesce(F.try_element_at(known, short), F.lit(1.0))


def spacing(length: Column, n: Column, signed: bool = False) -> Column:
    """Distance of neighbouring samples: the length over n - 1; 0 for a single sample."""
    size = length if signed else F.abs(length)
    return F.when(n > 1, size / (n - 1)).otherwise(F.lit(0.0))


def filetime(micros: Column) -> Column:
    return micros * 10 + FILETIME_EPOCH


def filetime_words(value: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))


def from_filetime(high: Column, low: Column) -> Column:
    """Microseconds since 1970 of a time stamp in two words; null before 1601."""
    value = F.shiftleft(high.cast("long"), 32) + low.cast("long")
    return F.when(value >= 0, F.floor((value - FILETIME_EPOCH) / 10).cast("long"))


def filetime_micros(value: Column) -> Column:
    """Exact microseconds since 1970: whole division, so no float is met."""
    return F.when(value >= 0, F.call_function("div", value - FILETIME_EPOCH, F.lit(10)))


def magnification(name: Column) -> Column:
    """The number before an "x"."""
    return F.regexp_extract(name, "([0-9]+([.][0-9]+)?)[xX]", 1).try_cast("double")


def immersion(name: Column, aperture: Column | None = None) -> Column:
    """The first immersion that an objective's name holds; else oil above an aperture of 0.75; else none."""
    text = F.lower(name)
    out = F
    for word in IMMERSIONS:
        out = out.when(text.contains(word), word.capitalize())
    return out.when(aperture > 0.75, "Oil") if aperture is not None else out


def pack_colour(red: Column, green: Column, blue: Column, alpha: Column | int = 255) -> Column:
    """A signed 32-bit number 0xRRGGBBAA."""
    alpha = F.lit(alpha) if isinstance(alpha, int) else alpha
    value = F.shiftleft(red.cast("long"), 24) + F.shiftleft(green.cast("long"), 16) + F.shiftleft(blue.cast("long"), 8) + alpha.cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in (red, green, blue)])


def display_level(value: Column, bits: int) -> Column:
    """A black or white value on the scale of a bit depth: fractions are scaled, half to even; larger values are clamped."""
    top = (1 << bits) - 1
    level = F.when(value > 1, F.bround(value)).otherwise(F.bround(value * top))
    return F.least(F.greatest(level, F.lit(0)), F.lit(top)).cast("long")


def pad(values: Column, n: int, default) -> Column:
    """An array cut or filled up to n values."""
    return F.slice(F.concat(F.coalesce(values, F.array()), F.array_repeat(F.lit(default), n)), 1, n)


def levels(width: Column, height: Column, tile: int = 512, most: int | None = None) -> Column:
    """Pyramid levels until the longer side fits a tile: halving with rounding up, k times, is one division by 2**k."""
    side = F.greatest(width, height)
    n = F.lit(1)
    for k in range(1, 32):
        n = n + ((side + (1 << (k - 1)) - 1) / (1 << (k - 1)) >= tile + 1).cast("int")
    n = n.cast("long")
    return n if most is None else F.least(n, F.lit(most).cast("long"))


def size_text(n: Column) -> Column:
    """Bytes as KB, MB or GB with two digits."""
    return F.when(n >= 1 << 30, F.format_string("%.2f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.2f MB", n / (1 << 20))).otherwise(F.format_string("%.2f KB", n / (1 << 10)))


def noise_name(name: Column) -> Column:
    """Whether a node or file is bookkeeping rather than an image."""
    text = F.lower(name)
    return text.contains("metadata") | text.contains("_pmd_") | text.contains("_histo") | text.contains("_environmetalgraph") | text.endswith(".lifext") | text.isin(*MANAGERS)


def stem(name: Column) -> Column:
    """A result's name without its image extension, or else without its last extension."""
    return F.when(F.lower(name).rlike("[.]ome[.](zarr|tiff?)$"), F.regexp_replace(name, "(?i)[.]ome[.](zarr|tiff?)$", "")).otherwise(F.regexp_replace(name, "[.][^./]*$", ""))


def reconciled(native: Column, converted: Column, factor: Column) -> Column:
    """Spacing in micrometres: the converted value, unless it is missing or is the native one under another unit."""
    again = native * factor
    same = (factor != 1.0) & (F.abs(converted - native) <= F.greatest(F.abs(native), F.lit(1.0)) * 1e-12)
    return F.when(native <= 0, 0.0).when(converted.isNull() | (converted <= 0) | same, again).otherwise(converted)


def hex_number(text: Column) -> Column:
    """The number of a hexadecimal word; null where it isn't one."""
    word = F.regexp_replace(F.trim(text), "^0[xX]", "")
    return F.when(word.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(word, 16, 10).cast("long"))


def code_points(text: Column) -> Column:
    """Sum of the code points of a string."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, c: total + c)


def number_uuid(n: Column) -> Column:
    """A number in the form of a UUID."""
    digits = F.lower(F.lpad(F.hex(n), 32, "0"))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def file_uuid(path: Column, n_text: Column, size: Column) -> Column:
    """The id of a single-image file, made of its path, the length of its description and the size of its pixels."""
    return number_uuid(F.length(path) + n_text + size + code_points(path))


def bit_depths(resolution: Column, channels: Column, isrgb: Column) -> Column:
    """Bits of each channel: known depths stay, others become 8 or 16; nothing said means 16, for colour images 8."""
    at = F.transform(F.sequence(F.lit(0), channels - 1), lambda i: F.coalesce(F.get(resolution, i).cast("int"), F.lit(16)))
    depth = F.transform(at, lambda b: F.when(b.isin(*DEPTHS), b).when((b != 0) & (b <= 8), 8).otherwise(16))
    said = F.coalesce(F.size(resolution), F.lit(0)) > 0
    return F.when(said, depth).when(isrgb, F.array_repeat(F.lit(8), 3)).otherwise(F.array_repeat(F.lit(16), channels.cast("int")))


def display_levels(values: Column, depths: Column, channels: Column, default: float = 0.0) -> Column:
    """Black or white values of all channels on the scales of their depths; both lists go on with their last value."""
    at = lambda a, i, d: F.coalesce(F.get(a, F.least(i, F.size(a) - 1)), F.lit(d))

    def level(i: Column) -> Column:
        top = F.call_function("shiftleft", F.lit(1).cast("long"), at(depths, i, 16).cast("int")) - 1
        v = at(values, i, default).cast("double")
        return F.least(F.greatest(F.when(v > 1, F.rint(v)).otherwise(F.rint(v * top)), F.lit(0.0)), top.cast("double")).cast("long")

    return F.transform(F.sequence(F.lit(0), channels.cast("int") - 1), level)


def channel_labels(names: Column, blocks: Column, channels: Column, isrgb: Column) -> Column:
    """Names of channels: dyes, else filter blocks, else numbers from 1."""
    some = lambda a: F.coalesce(F.exists(a, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(False))
    said = F.when(some(names), names).when(some(blocks), blocks)
    label = lambda i: F.coalesce(F.nullif(F.get(said, i), F.lit("")), F.concat(F.lit("Channel "), (i + 1).cast("string")))
    return F.when(isrgb, F.array(*map(F.lit, ("Red", "Green", "Blue")))).otherwise(F.transform(F.sequence(F.lit(0), channels.cast("int") - 1), label))


def css_colour(name: Column) -> Column:
    """0xRRGGBB of a CSS colour name in any case; null for others."""
    return F.try_element_at(literal_map(CSS_COLOURS), F.lower(name))


def channel_colours(luts: Column, channels: Column, isrgb: Column) -> Column:
    """Colours of channels as hexadecimal words: those of their look-up tables, white where these are unknown, or a palette in turn."""
    hex_of = lambda i: F.lower(F.lpad(F.hex(F.coalesce(css_colour(F.get(luts, i)), F.lit(0xFFFFFF))), 6, "0"))
    palette = F.array(*map(F.lit, PALETTE))
    numbers = F.sequence(F.lit(0), channels.cast("int") - 1)
    own = F.when(F.coalesce(F.size(luts), F.lit(0)) > 0, F.transform(numbers, hex_of)).otherwise(F.transform(numbers, lambda i: F.get(palette, i % len(PALETTE))))
    return F.when(isrgb, F.array(*map(F.lit, SAMPLES))).otherwise(own)


def window(low: Column, high: Column, top: int | Column) -> Column:
    """(min, max) that a viewer shows: what was measured, inside the type's range; the whole range where that is empty."""
    top = top if isinstance(top, Column) else F.lit(top)
    start, end = F.coalesce(low, F.lit(0)), F.coalesce(high, top)
    end = F.when(end <= start, top).otherwise(end)
    return F.struct(F.greatest(start, F.lit(0)).cast("long").alias("min"), F.least(end, top).cast("long").alias("max"))


def axis_scale(micrometres: Column, metres: Column, fallback: Column) -> Column:
    """Spacing in micrometres: as normalised, else from metres, else the fallback."""
    return F.when(micrometres > 0, micrometres).when(metres > 0, metres * 1e6).otherwise(fallback)


def tile_side(requested: Column, extent: Column) -> Column:
    """Side of a tile: at least 16, no longer than the extent rounded up to a multiple of 16."""
    return F.least(F.greatest(F.lit(16), requested), F.greatest(F.lit(16), F.ceil(F.greatest(F.lit(1), extent) / 16.0) * 16)).cast("long")


def elapsed_text(seconds: Column) -> Column:
    """Seconds as "4.2s", "3m 4.2s" or "1h 2m 3s"."""
    minutes, hours = F.floor(seconds % 3600 / 60), F.floor(seconds / 3600)
    rest = seconds % 60
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%dm %.1fs", minutes, rest)).otherwise(F.format_string("%dh %dm %ds", hours, minutes, F.rint(rest).cast("long")))


def pretty_time(text: Column) -> Column:
    """An ISO time stamp as date and time of day, as it is written: fractions and the zone go."""
    plain = F.regexp_replace(F.trim(text), "T", " ")
    return F.regexp_replace(F.regexp_replace(plain, "[.].*$", ""), "(?<=^.{10,40})(Z|[+-][0-9:]*)$", "")


def numeric_order(name: Column) -> Column:
    """A sort key that puts whole numbers first, by value, and other names after them."""
    n = F.when(name.rlike("^[0-9]{1,18}$"), name.cast("long"))
    return F.struct(n.isNull().alias("word"), n.alias("number"), name.alias("name"))


def legacy_confocal(system: Column, scan_mode: Column, pinhole: Column) -> Column:
    """Whether flat records are those of a confocal scanner."""
    name = F.lower(F.coalesce(system, F.lit("")))
    return name.contains("tcs") | name.contains("sp") | scan_mode.isNotNull() | pinhole.isNotNull()


# Names of contrast methods, and detector kinds by what their names hold, in this order.
CONTRASTS = {"FLUO": "Fluorescence", "BF": "Brightfield", "DIC": "DIC", "PH": "Phase", "TL-BF": "Brightfield"}
DETECTORS = [("pmt", "PMT"), ("hyd", "Other"), ("hybrid", "Other"), ("ccd", "CCD"), ("cmos", "CMOS"), ("apd", "APD")]


def contrast_name(method: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CONTRASTS), F.upper(method)), F.nullif(method, F.lit("")), F.lit("Other"))


def illumination(kind: Column, contrast: Column) -> Column:
    """How light reaches the sample, by the kind of microscope (confocal or camera) and the contrast's name."""
    camera = F.when(contrast == "Fluorescence", "Epifluorescence").when(contrast.isin("Brightfield", "DIC", "Phase"), "Transmitted").otherwise("Other")
    return F.when(kind == "confocal", "Epifluorescence").when(kind == "camera", camera).otherwise("Other")


def acquisition(kind: Column) -> Column:
    return F.when(kind == "confocal", "LaserScanningConfocalMicroscopy").when(kind == "camera", "WideField").otherwise("Other")


def detector_type(name: Column) -> Column:
    out = F
    for word, kind in DETECTORS:
        out = out.when(F.lower(name).contains(word), kind)
    return out


def summary(*lines: Column) -> Column:
    """Lines of text, those that have nothing to say left out."""
    return F.concat_ws("\n", *lines)


def line(label: str, value: Column) -> Column:
    """"label: value", or null where the value is missing."""
    return F.when(~missing(value), F.concat(F.lit(f"{label}: "), value.cast("string")))
