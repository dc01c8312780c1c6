"""The OME description of an image, for tiled files and for chunked arrays."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
#: The values that the schema has for immersions; others become "Other".
MEDIA = ("Oil", "Water", "WaterDipping", "Air", "Multi", "Glycerol", "Other")


def number(value: float) -> str:
    return f"{value:g}"


def some(values: list | None, k: int):
    return values[k] if values and k < len(values) else None


def attributes(**values) -> dict[str, str]:
    """Those that say something, as text."""
    return {k: number(v) if isinstance(v, float) else str(v) for k, v in values.items() if v is not None and v != ""}


def shape_of(image: dict) -> dict[str, int]:
    return {"X": image["xs"], "Y": image["ys"], "Z": image.get("zs") or 1, "C": image.get("channels") or 1, "T": image.get("ts") or 1}


def instrument(top: ET.Element, image: dict) -> None:
    """Microscope, lasers, detectors and objective."""
    node = ET.SubElement(top, "Instrument", ID="Instrument:0")
    ET.SubElement(node, "Microscope", **attributes(Model=image.get("MicroscopeModel") or image.get("SystemTypeName"), SerialNumber=image.get("system_serial_number")))
    for k, line in enumerate(image.get("laser_lines") or []):
        ET.SubElement(node, "Laser", **attributes(ID=f"LightSource:{k}", Wavelength=float(line) if line else None))
    for k, name in enumerate(image.get("detector_types") or []):
        if name:
            kind, gain = some(image.get("detector_kinds"), k), some(image.get("detector_gains"), k)
            level = {"Voltage" if kind == "PMT" else "Gain": gain, "Offset": some(image.get("detector_offsets"), k), "Zoom": image.get("zoom")}
            ET.SubElement(node, "Detector", **attributes(ID=f"Detector:{k}", Model=name, Type=kind, **level))
    for k, band in enumerate(image.get("filterblock") or []):
        if band:
            edges = re.search(r"(\d+)-(\d+)", band)
            part = ET.SubElement(node, "Filter", **attributes(ID=f"Filter:{k}", Model=band, Type="BandPass" if edges else None))
            if edges:
                ET.SubElement(part, "TransmittanceRange", CutIn=edges[1], CutInUnit="nm", CutOut=edges[2], CutOutUnit="nm")
    immersion = (image.get("immersion") or "").capitalize().replace("Dry", "Air")
    power = image.get("magnification")
    ET.SubElement(node, "Objective", **attributes(ID="Objective:0", Model=image.get("objective"), NominalMagnification=power if power and power > 0 else None, LensNA=image.get("na") or None, Immersion=immersion if immersion in MEDIA else "Other"))


def channel(pixels: ET.Element, image: dict, k: int, samples: int) -> None:
    line, found = some(image.get("excitation"), k), {}
    if samples == 1:
        found = {
            "Name": some(image.get("labels"), k), "Color": some(image.get("ome_colours"), k), "Fluor": some(image.get("channel_names"), k), "ExcitationWavelength": line or None, "EmissionWavelength": some(image.get("emission"), k) or None,
            "ContrastMethod": some(image.get("contrasts"), k), "IlluminationType": some(image.get("illuminations"), k), "AcquisitionMode": image.get("acquisition_mode"), "PinholeSize": image.get("pinholesize_um") or None,
        }
    node = ET.SubElement(pixels, "Channel", **attributes(ID=f"Channel:0:{k}", SamplesPerPixel=samples, **found))
    lasers = image.get("laser_lines") or []
    if samples == 1 and line and line in lasers:
        ET.SubElement(node, "LightSourceSettings", ID=f"LightSource:{lasers.index(line)}", Wavelength=number(line))
    if samples == 1 and some(image.get("detector_types"), k):
        ET.SubElement(node, "DetectorSettings", **attributes(ID=f"Detector:{k}", Gain=some(image.get("detector_gains"), k), Offset=some(image.get("detector_offsets"), k), Zoom=image.get("zoom")))
    if samples == 1 and some(image.get("filterblock"), k):
        ET.SubElement(ET.SubElement(node, "LightPath"), "EmissionFilterRef", ID=f"Filter:{k}")


def planes(pixels: ET.Element, image: dict, count: int, tiff: bool) -> None:
    """Where each plane stands in the file, and when and where it was taken."""
    shape = shape_of(image)
    order = [(t, c, z) for t in range(shape["T"]) for c in range(count) for z in range(shape["Z"])]
    if tiff:
        for k, (t, c, z) in enumerate(order):
            ET.SubElement(pixels, "TiffData", FirstT=str(t), FirstC=str(c), FirstZ=str(z), IFD=str(k), PlaneCount="1")
    else:
        ET.SubElement(pixels, "MetadataOnly")
    x, y, begin = (image.get(k) for k in ("stage_pos_x_m", "stage_pos_y_m", "zstack_begin_m"))
    step = (image.get("zres2") or 0.0) * (-1 if begin is not None and (image.get("zstack_end_m") or 0) < begin else 1)
    if x is None and y is None and begin is None and not image.get("tres"):
        return
    exposures = image.get("exposure_times_s")
    for t, c, z in order:
        exposure = some(exposures, c if exposures and len(exposures) >= count else 0)
        at = {"PositionX": None if x is None else x * 1e6, "PositionY": None if y is None else y * 1e6, "PositionZ": None if begin is None else begin * 1e6 + z * step}
        units = {f"{k}Unit": "µm" for k, v in at.items() if v is not None}
        ET.SubElement(pixels, "Plane", **attributes(TheT=t, TheC=c, TheZ=z, DeltaT=(image.get("tres") or 0.0) * t if image.get("tres") else None, ExposureTime=exposure, **at, **units))


def annotate(top: ET.Element, node: ET.Element, image: dict, original: str | None) -> None:
    """All annotations of an image in one list: those it comes with (``annotations``: a map each), and its container's description."""
    maps = [a for a in image.get("annotations") or [] if a]
    if not maps and not original:
        return
    notes, number = ET.SubElement(top, "StructuredAnnotations"), 0
    if original:
        value = ET.SubElement(ET.SubElement(notes, "XMLAnnotation", ID=f"Annotation:{number}", Namespace="original-metadata"), "Value")
        ET.SubElement(value, "OriginalMetadata").text = original
        number += 1
    for pairs in maps:
        value = ET.SubElement(ET.SubElement(notes, "MapAnnotation", ID=f"Annotation:{number}", Namespace="key-values"), "Value")
        for k, v in pairs.items():
            ET.SubElement(value, "M", K=str(k)).text = str(v)
        number += 1
    for n in range(number):
        ET.SubElement(node, "AnnotationRef", ID=f"Annotation:{n}")


def conform(top: ET.Element, rules: dict[tuple[str, str], list[str]]) -> None:
    """Bring attributes to the values that a schema lists: another case becomes the listed one, other values "Other", or none where that isn't listed."""
    for node in top.iter():
        for attribute, value in list(node.attrib.items()):
            listed = rules.get((node.tag, attribute))
            if listed is None or value in listed:
                continue
            known = {v.casefold(): v for v in listed}
            best = known.get(value.casefold(), known.get("other"))
            if best is None:
                del node.attrib[attribute]
            else:
                node.set(attribute, best)


def ome_xml(image: dict, tiff: bool = True, original: str | None = None) -> str:
    """The description of one image row (see ``metadata.describe`` and ``shown``); ``original`` goes along as an annotation.

    Characters outside ASCII become references, so any reader can take it. Where the row has ``schema_rules``
    (see ``sources.schema``), attributes conform to them.
    """
    shape = shape_of(image)
    rgb = bool(image.get("isrgb"))
    count, bits = (1 if rgb else shape["C"]), max([b for b in image.get("channelResolution") or [] if b] or [8])
    top = ET.Element("OME", xmlns=NAMESPACE)
    instrument(top, image)
    node = ET.SubElement(top, "Image", ID="Image:0", Name=image.get("save_child_name") or "image")
    if image.get("experiment_time"):
        ET.SubElement(node, "AcquisitionDate").text = image["experiment_time"].strftime("%Y-%m-%dT%H:%M:%S")
    ET.SubElement(node, "Description").text = image.get("summary") or image.get("objective") or ""
    ET.SubElement(node, "InstrumentRef", ID="Instrument:0")
    ET.SubElement(node, "ObjectiveSettings", **attributes(ID="Objective:0", RefractiveIndex=image.get("refractiveindex") or None))
    around = attributes(Temperature=image.get("temperature_c"), TemperatureUnit="°C" if image.get("temperature_c") is not None else None, CO2Percent=None if image.get("co2_percent") is None else image["co2_percent"] / 100)
    if around:
        ET.SubElement(node, "ImagingEnvironment", **around)
    stage = {a: image.get(f"stage_pos_{a.lower()}_m") for a in "XY"}
    if any(v is not None for v in stage.values()):
        ET.SubElement(node, "StageLabel", **attributes(Name="Position", **{k: v * 1e6 for k, v in stage.items() if v is not None}, **{f"{k}Unit": "µm" for k, v in stage.items() if v is not None}))
    size = {f"Size{a}": n for a, n in shape.items()} | {"SizeC": 3 if rgb else shape["C"]}
    for a in "XYZ":
        if value := image.get(f"{a.lower()}res2"):
            size |= {f"PhysicalSize{a}": float(value), f"PhysicalSize{a}Unit": "µm"}
    if image.get("tres") and shape["T"] > 1:
        size |= {"TimeIncrement": float(abs(image["tres"])), "TimeIncrementUnit": "s"}
    pixels = ET.SubElement(node, "Pixels", **attributes(ID="Pixels:0", DimensionOrder="XYCZT" if rgb else "XYZCT", Type="uint16" if bits > 8 else "uint8", SignificantBits=bits, BigEndian="false", Interleaved="true" if rgb else "false", **size))
    for k in range(count):
        channel(pixels, image, k, 3 if rgb else 1)
    planes(pixels, image, count, tiff)
    if image.get("schema_rules"):
        conform(top, image["schema_rules"])
    annotate(top, node, image, original)
    text = ET.tostring(top, encoding="unicode")
    return '<?xml version="1.0" encoding="UTF-8"?>' + "".join(c if ord(c) < 128 else f"&#{ord(c)};" for c in text)
