"""ESRI shapefiles as a Spark data source: polygons of .shp with the attributes of .dbf."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: records a partition reads
CHUNK = 2_000


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(records, header size, record size, [(name, type, length)])."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, header, size = struct.unpack("<IHH", head[4:12])
        fields = []
        while (b := f.read(32)) and b[0] != 0x0D:
            fields.append((b[:11].split(b"\0")[0].decode("latin-1"), chr(b[11]), b[16]))
    return n, header, size, fields


def shp_offsets(path: str) -> list[int]:
    """Byte offsets of the records, by walking their headers."""
    out = []
    with open(path, "rb") as f:
        f.seek(0, 2)
        end, at = f.tell(), 100
        while at + 8 <= end:
            out.append(at)
            f.seek(at + 4)
            at += 8 + 2 * struct.unpack(">i", f.read(4))[0]
    return out


def shape_rings(content: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon record (plain, with M, or with Z); none for null shapes."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind not in (5, 15, 25):
        return []
    parts, points = struct.unpack("<ii", content[36:44])
    starts = [*struct.unpack(f"<{parts}i", content[44 : 44 + 4 * parts]), points]
    xy = struct.unpack(f"<{2 * points}d", content[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    return [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str):
        self.shp = path
        self.dbf = path[:-4] + ".dbf"

    def partitions(self) -> list[InputPartition]:
        at = shp_offsets(self.shp)
        return [InputPartition((i, at[i : i + CHUNK])) for i in range(0, len(at), CHUNK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, offsets = partition.value
        _, header, size, fields = dbf_fields(self.dbf)
        with open(self.shp, "rb") as shp, open(self.dbf, "rb") as dbf:
            for i, at in enumerate(offsets, first):
                shp.seek(at + 4)
                words = struct.unpack(">i", shp.read(4))[0]
                rings = [[{"x": x, "y": y} for x, y in r] for r in shape_rings(shp.read(2 * words))]
                dbf.seek(header + i * size + 1)
                row = dbf.read(size - 1)
                values, pos = [], 0
                for _, kind, length in fields:
                    text = row[pos : pos + length].decode("latin-1").strip(" \0")
                    pos += length
                    values.append(text or None)
                    if kind in "NF" and text:
                        values[-1] = text if not set(text) <= {"*"} else None
                yield (i, rings, *values)


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load("x.shp"): src_row, rings, and the attributes as strings."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = dbf_fields(self.options["path"][:-4] + ".dbf")[3]
        return "src_row long, rings array<array<struct<x:double,y:double>>>" + "".join(f", `{n}` string" for n, _, _ in fields)

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options["path"])
