"""Precinct tables of public election data sets, brought to one schema."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.functions.geometry import project
from plansieve.functions.projections import parse, to_degrees
from plansieve.operators.graph import districts_by_centroid
from plansieve.sources.geopackage import layer_crs
from plansieve.storage import row_numbers

log = logging.getLogger(__name__)
CANONICAL = ("pop", "votes_d", "votes_r", "district")

# fixed values: source columns by target, the first that exists counts
VEST_PA = {
    "pop": ["TOTPOP", "TOTPOP_2020", "P0010001", "POPULATION", "TAPERSONS"],
    "votes_d": ["G20PREDBID", "PRES_DEM"],
    "votes_r": ["G20PRERTRU", "PRES_REP"],
    "district": ["DISTRICT", "CD", "CD117", "CD118"],
}
MGGG = {
    "pa_2016": {"pop": ["TOTPOP"], "votes_d": ["T16PRESD"], "votes_r": ["T16PRESR"], "district": ["REMEDIAL"]},
    "pa_2012": {"pop": ["TOTPOP"], "votes_d": ["PRES12D"], "votes_r": ["PRES12R"], "district": ["CD_2011"]},
    "nc": {"pop": ["TOTPOP"], "votes_d": ["EL16G_PR_D"], "votes_r": ["EL16G_PR_R"], "district": ["CD"]},
    "md": {"pop": ["TOTPOP"], "votes_d": ["PRES16D"], "votes_r": ["PRES16R"], "district": ["CD"]},
    "wi": {"pop": ["TOTPOP", "PERSONS"], "votes_d": ["PREDEM16"], "votes_r": ["PREREP16"], "district": ["CON"]},
}

# fixed values: file names that are looked for, the first that exists counts
PA_PRECINCTS = ["pa_vest_2020.gpkg", "pa_vest_2020.shp", "pa_vest20.shp"]
PA_DISTRICTS = ["pa_cd_2022.gpkg", "pa_cd_2022.shp", "pa_cong.shp"]


def first_existing(paths: list[str]) -> str | None:
    return next((p for p in paths if os.path.exists(p)), None)


def find_shapefile(folder: str) -> str:
    """First .shp of a folder by name."""
    names = sorted(n for n in os.listdir(folder) if n.lower().endswith(".shp"))
    if not names:
        raise FileNotFoundError(f"no .shp in {folder}")
    return os.path.join(folder, names[0])


def rename_first_hit(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Each target takes the name of its first source column that exists; all others stay."""
    names = {}
    for target, sources in columns.items():
        hit = next((s for s in sources if s in df.columns), None)
        if hit and hit != target:
            names[hit] = target
    return df.withColumnsRenamed(names)


def missing_columns(df: DataFrame) -> list[str]:
    gone = sorted(set(CANONICAL) - set(df.columns))
    if gone:
        log.warning("columns missing: %s", ", ".join(gone))
    return gone


def coerce_numeric(df: DataFrame, columns=CANONICAL) -> DataFrame:
    """Numbers where a value reads as one, else 0; NaN counts as no number."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.expr(f"try_cast({c} as double)"), F.lit(None)), F.lit(0.0)) for c in columns if c in df.columns})


def to_albers(df: DataFrame, crs: str | None) -> DataFrame:
    """Rings in EPSG:5070 metres, from a CRS given as EPSG code or well-known text; a missing one is taken for degrees, an unknown one raises."""
    if "rings" not in df.columns:
        return df
    if not crs:
        log.warning("no CRS: taken for degrees")
    known = parse(crs)
    if known.is_target():
        return df

    def degrees(p: Column) -> Column:
        lon, lat = to_degrees(known, p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    rings = F.col("rings") if known.kind == "degrees" else F.transform("rings", lambda r: F.transform(r, degrees))
    return df.withColumn("rings", project(rings))


def crs_of(path: str) -> str | None:
    """Well-known text of a shapefile's .prj or of a GeoPackage's first layer, if there is any."""
    if path.lower().endswith(".gpkg"):
        return layer_crs(path)
    prj = first_existing([path[:-4] + ".prj", path[:-4] + ".PRJ"])
    if prj is None:
        return None
    with open(prj, encoding="utf-8", errors="replace") as f:
        return f.read().strip() or None


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a shapefile or of a GeoPackage's first layer."""
    return read_geopackage(spark, path) if path.lower().endswith(".gpkg") else read_shapefile(spark, path)


def numbered(df: DataFrame, order: str = "src_row") -> DataFrame:
    """node_id 0..n-1 in the order of the source's rows."""
    return row_numbers(df, order, "node_id")


def load_mggg(raw: DataFrame, columns: dict[str, list[str]], crs: str | None = None) -> DataFrame:
    """Rename, coerce, project, drop unpopulated precincts, number the rest."""
    df = rename_first_hit(raw, columns)
    missing_columns(df)
    df = to_albers(coerce_numeric(df), crs)
    if "pop" in df.columns:
        df = df.where("pop > 0")
    if "district" in df.columns:
        df = df.withColumn("district", F.col("district").cast("int"))
    return numbered(df)


def load_vest(raw: DataFrame, columns: dict[str, list[str]] = VEST_PA, overlay: DataFrame | Callable[[], DataFrame] | None = None, crs: str | None = None) -> DataFrame:
    """As load_mggg, but keeps unpopulated precincts, and takes districts from an overlay of polygons (or what
    makes one when it is needed) where the source has none, or only zeros; precincts in no polygon are dropped then."""
    df = to_albers(coerce_numeric(rename_first_hit(raw, columns)), crs)
    empty = "district" not in df.columns or not (df.agg(F.sum("district")).first()[0] or 0)
    if empty and overlay is None:
        raise ValueError("the source has no districts and no overlay is given")
    if empty:
        overlay = overlay() if callable(overlay) else overlay
        own = df.drop("district").withColumnRenamed("src_row", "node_id")
        got = districts_by_centroid(own.select("node_id", "rings"), overlay)
        df = own.join(got, "node_id").withColumnRenamed("node_id", "src_row")
    return numbered(df.dropna(subset=["district"]).withColumn("district", F.col("district").cast("int")))


def load_mggg_pa(spark: SparkSession, folder: str, election: str = "2016") -> DataFrame:
    return _mggg(spark, folder, "pa_2016" if election == "2016" else "pa_2012")


def _mggg(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = find_shapefile(folder)
    return load_mggg(read_shapefile(spark, path), MGGG[name], crs_of(path))


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    from plansieve.sources.shapefile import ShapefileSource

    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    from plansieve.sources.geopackage import GeoPackageSource

    spark.dataSource.register(GeoPackageSource)
    return spark.read.format("geopackage").load(path)


def district_overlay(spark: SparkSession, path: str, columns: dict[str, list[str]] = VEST_PA) -> DataFrame:
    """district_row, district, rings (EPSG:5070) of a file of district polygons."""
    df = to_albers(coerce_numeric(rename_first_hit(read_any(spark, path), columns)), crs_of(path))
    if "district" not in df.columns:
        raise ValueError(f"no district column in {path}")
    return df.select(F.col("src_row").alias("district_row"), F.col("district").cast("int").alias("district"), "rings")


def load_vest_pa(spark: SparkSession, folder: str) -> DataFrame:
    """Precincts and, where they have no district, the enacted districts' file of the same folder."""
    path = first_existing([os.path.join(folder, n) for n in PA_PRECINCTS]) or find_shapefile(folder)

    def overlay() -> DataFrame:
        at = first_existing([os.path.join(folder, n) for n in PA_DISTRICTS])
        if at is None:
            raise FileNotFoundError(f"no districts in {path}, and none of {', '.join(PA_DISTRICTS)} in {folder}")
        return district_overlay(spark, at)

    return load_vest(read_any(spark, path), overlay=overlay, crs=crs_of(path))


STATE_LOADERS = {"pa": load_vest_pa}
MGGG_LOADERS = {
    "pa": load_mggg_pa,
    "nc": lambda spark, folder: _mggg(spark, folder, "nc"),
    "md": lambda spark, folder: _mggg(spark, folder, "md"),
    "wi": lambda spark, folder: _mggg(spark, folder, "wi"),
}


def load_state(spark: SparkSession, state: str, folder: str) -> DataFrame:
    if state.lower() not in STATE_LOADERS:
        raise ValueError(f"no loader for {state}")
    return STATE_LOADERS[state.lower()](spark, folder)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file with Polygon or MultiPolygon geometry: properties, rings, src_row."""
    doc = spark.read.option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("src_row", "f"))
    geo = f.select("src_row", "f.properties.*", F.to_json("f.geometry.coordinates").alias("c"), F.col("f.geometry.type").alias("t"))
    ring = "array<array<array<double>>>"
    rings = F.when(F.col("t") == "Polygon", F.from_json("c", ring)).otherwise(F.flatten(F.from_json("c", f"array<{ring}>")))
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return geo.withColumn("rings", points).drop("c", "t").withColumn("src_row", F.col("src_row").cast("long"))
