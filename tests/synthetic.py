"""Small container files, made byte by byte."""

from __future__ import annotations

import struct

import numpy as np


def framed(payload: bytes) -> bytes:
    return struct.pack("<ii", 0x70, len(payload)) + payload


def string(value: str, bom: bool = False) -> bytes:
    raw = (b"\xff\xfe" if bom else b"") + value.encode("utf-16-le")
    return struct.pack("<Bi", 0x2A, len(raw) // 2) + raw


def lif(xml: str, blocks: list[tuple[str, bytes]], bom: bool = False) -> bytes:
    out = framed(string(xml, bom))
    for name, data in blocks:
        out += framed(struct.pack("<Bq", 0x2A, len(data)) + string(name)) + data
    return out


def lof(xml: str, data: bytes, kind: str = "LMS_Object_File") -> bytes:
    head = string(kind) + struct.pack("<Bi", 0x2A, 2) + struct.pack("<Bi", 0x2A, 0) + struct.pack("<BQ", 0x2A, len(data))
    return framed(head) + data + framed(string(xml))


def image_xml(name: str, uid: str, block: str, shape: tuple[int, int, int, int, int], size: int, settings: str = "", tiles: str = "", bits: int = 16) -> str:
    t, c, z, y, x = shape
    b = bits // 8
    plane = x * y * b
    dims = [(1, x, x * 1e-6, "m", b), (2, y, y * 1e-6, "m", b * x), (3, z, -2e-6 * (z - 1), "m", plane * c), (4, t, 1.5 * (t - 1), "s", plane * c * z)]
    channels = "".join(f'<ChannelDescription ChannelTag="0" Resolution="{bits}" LUTName="{lut}" BytesInc="{k * plane}"><ChannelProperty><Key>DyeName</Key><Value>dye {k}</Value></ChannelProperty></ChannelDescription>' for k, lut in enumerate(["Red", "Green", "Blue", "Gray"][:c]))
    rows = "".join(f'<DimensionDescription DimID="{d}" NumberOfElements="{n}" Length="{length}" Unit="{u}" BytesInc="{inc}"/>' for d, n, length, u, inc in dims if n > 1 or d < 3)
    return (
        f'<Element Name="{name}" UniqueID="{uid}"><Data><Image><ImageDescription><Channels>{channels}</Channels><Dimensions>{rows}</Dimensions></ImageDescription>'
        f'<Attachment Name="ViewerScaling"><ChannelScalingInfo BlackValue="0.1" WhiteValue="0.9" GammaValue="1"/></Attachment>{settings}{tiles}</Image></Data>'
        f'<Memory Size="{size}" MemoryBlockID="{block}"/><Children/></Element>'
    )


CONFOCAL = (
    '<Attachment Name="HardwareSetting" DataSourceTypeName="Confocal"><ATLConfocalSettingDefinition ObjectiveName="HC PL APO 63x/1.40 OIL" NumericalAperture="1.4" RefractionIndex="1.518" '
    'Immersion="OIL" Magnification="63" Pinhole="9.5e-5" Zoom="bad" ScanSpeed="400" IsResonantConfocalScanner="1" FlipX="0" FlipY="1" SwapXY="0"><LaserArray><Laser Wavelength="488"/><Laser Wavelength="561"/><Laser Wavelength="488"/></LaserArray>'
    '<DetectorList><Detector Name="HyD 1" IsActive="1" Gain="10" Offset="0"/><Detector Name="PMT 2" IsActive="0" Gain="1"/></DetectorList>'
    '<Spectro><MultiBand LeftWorld="500" RightWorld="551" DyeName="A"/><MultiBand LeftWorld="570" RightWorld="650" DyeName="B"/><MultiBand LeftWorld="x" RightWorld="1"/></Spectro></ATLConfocalSettingDefinition></Attachment>'
)
TILES = '<Attachment Name="TileScanInfo">' + "".join(f'<Tile FieldX="{i % 3}" FieldY="{i // 3}" PosX="{(i % 3) * 9e-6}" PosY="{(i // 3) * 7.2e-6}"/>' for i in range(6)) + "</Attachment>"


def pixels(shape: tuple[int, ...], dtype: str = "<u2") -> np.ndarray:
    t, c, z, y, x = np.indices(shape)
    return (t * 10000 + c * 3000 + z * 500 + 2 * y + x).astype(dtype)


def example(folder) -> np.ndarray:
    """nested.lif with two images, single.lof, and a linked graph with a cycle and a missing file."""
    data = pixels((2, 3, 2, 7, 9))
    body = image_xml("cells", "u-1", "MemBlock_1", data.shape, data.nbytes, CONFOCAL)
    stack = np.ascontiguousarray(data.transpose(0, 2, 1, 3, 4)).tobytes()
    other = image_xml("cells", "", "MemBlock_2", (1, 1, 1, 8, 10), 160, "", TILES)
    xml = f'<LMSDataContainerHeader><Element Name="Project" UniqueID="root"><Memory Size="0" MemoryBlockID="MemBlock_0"/><Children><Element Name="folder" UniqueID="f-1"><Memory Size="0" MemoryBlockID=""/><Children>{body}</Children></Element>{other}</Children></Element></LMSDataContainerHeader>'
    (folder / "nested.lif").write_bytes(lif(xml, [("MemBlock_0", b""), ("MemBlock_1", stack), ("MemBlock_2", pixels((1, 1, 1, 8, 10)).tobytes())], bom=True))
    (folder / "broken.lif").write_bytes(b"\x70\0\0\0\x01\0\0\0\x2b")
    single = pixels((1, 1, 1, 6, 5))
    (folder / "single.lof").write_bytes(lof(image_xml("alone", "u-9", "", single.shape, single.nbytes).replace('MemoryBlockID=""', 'MemoryBlockID="m"'), single.tobytes()))
    (folder / "top.xlef").write_text('<Element Name="top" UniqueID="t"><Children><Reference File="sub%20one.xlcf" UUID="s"/><Reference File=".\\gone.xlif" UUID="g"/></Children></Element>')
    (folder / "sub one.xlcf").write_text('<Element Name="sub" UniqueID="s"><Children><Reference File="top.xlef" UUID="t"/></Children></Element>', encoding="utf-8-sig")
    return data
