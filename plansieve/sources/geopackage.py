"""GeoPackage layers (SQLite files) as a Spark data source, and well-known binary polygons."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plansieve.schema import RINGS
from plansieve.storage import ship

CHUNK = 2_000


def wkb_rings(data: bytes | None) -> list[list[dict[str, float]]]:
    """Rings of a polygon or multipolygon, with or without Z and M; none for other shapes."""
    if not data:
        return []

    def parse(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:  # a reference system id stands in between
            at += 4
        # thousands (or the top bits) of the kind say which of Z and M each point has
        base, extra = (kind & 0xFFFF) % 1000, (kind & 0xFFFF) // 1000
        dims = 2 + (0, 1, 1, 2)[extra] + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        rings: list = []
        if base == 6:
            for _ in range(n):
                part, at = parse(at)
                rings += part
        elif base == 3:
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", data, at)
                xs = struct.unpack_from(f"{order}{m * dims}d", data, at + 4)
                at += 4 + 8 * m * dims
                rings.append([{"x": xs[i * dims], "y": xs[i * dims + 1]} for i in range(m)])
        return rings, at

    return parse(0)[0]


def gpkg_rings(blob: bytes | None) -> list[list[dict[str, float]]]:
    """Rings behind a GeoPackage geometry header."""
    if not blob or blob[:2] != b"GP":
        return []
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return wkb_rings(blob[8 + envelope :])


def rings_of_wkb(column: Column) -> Column:
    """Rings of a binary column, as geoparquet files hold geometry."""
    ship()

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([wkb_rings(bytes(v)) if v is not None else [] for v in values], dtype=object)

    return F.pandas_udf(run, RINGS)(column)


def rings_wkb(rings) -> bytes:
    """Well-known binary, little-endian, of a polygon: the first ring is its border, others are holes."""
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for r in rings:
        out.append(struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in (p["x"], p["y"]))))
    return b"".join(out)


def wkb_of_rings(column: Column) -> Column:
    """A binary column of polygons, for geoparquet files; null stays null."""
    ship()

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else rings_wkb(v) for v in values], dtype=object)

    return F.pandas_udf(run, "binary")(column)


def layer(path: str, name: str | None) -> tuple[str, str, list[str]]:
    """(table, geometry column, attribute columns) of a layer, the first unless named."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        table, geometry = next((r for r in rows if name in (None, r[0])), (None, None))
        if table is None:
            raise ValueError(f"no layer {name or ''} in {path}")
        names = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
    return table, geometry, [n for n in names if n != geometry]


def layer_crs(path: str, name: str | None = None) -> str | None:
    """Well-known text of a layer's reference system; None where the file names none."""
    table = layer(path, name)[0]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        try:
            row = db.execute(
                "SELECT s.definition FROM gpkg_geometry_columns g JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id WHERE g.table_name = ?", (table,)
            ).fetchone()
        except sqlite3.OperationalError:  # files without these tables or columns
            return None
    return row[0] if row and row[0] and row[0].lower() != "undefined" else None


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, name: str | None):
        self.path, self.layer = path, layer(path, name)

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer[0]}"').fetchone()
        return [InputPartition((a, a + CHUNK)) for a in range(lo, hi + 1, CHUNK)] if lo is not None else [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        table, geometry, names = self.layer
        listed = ", ".join(f'"{n}"' for n in names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT rowid, "{geometry}", {listed} FROM "{table}" WHERE rowid >= ? AND rowid < ?', partition.value):
                yield (row[0], gpkg_rings(row[1]), *(None if v is None else str(v) for v in row[2:]))


class GeoPackageSource(DataSource):
    """spark.read.format("geopackage").option("layer", ...).load("x.gpkg"): src_row, rings, attributes as strings."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return f"src_row long, rings {RINGS}" + "".join(f", `{n}` string" for n in layer(self.options["path"], self.options.get("layer"))[2])

    def reader(self, schema) -> DataSourceReader:
        return GeoPackageReader(self.options["path"], self.options.get("layer"))
