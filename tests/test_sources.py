import json
import struct

import pytest

from plansieve.sources import loaders, sinks


def write_shapefile(base, shapes, fields, rows):
    body, pos = b"", 50
    for i, rings in enumerate(shapes, 1):
        pts = [p for r in rings for p in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        rec = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", i, len(rec) // 2) + rec
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, pos + len(body) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    base.with_suffix(".shp").write_bytes(head + body)
    size = 1 + sum(n for _, _, n in fields)
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 33 + 32 * len(fields), size)
    for name, kind, n in fields:
        dbf += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([n, 0]) + b"\0" * 14
    dbf += b"\r" + b"".join(b" " + b"".join(str(v).rjust(n).encode() for v, (_, _, n) in zip(r, fields, strict=True)) for r in rows)
    base.with_suffix(".dbf").write_bytes(dbf)


def square(x, y=0.0):
    return [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]


def test_shapefile_loader(spark, tmp_path):
    write_shapefile(tmp_path / "nc", [square(0.0), square(1.0), square(2.0)], [("TOTPOP", "N", 8), ("EL16G_PR_D", "N", 8), ("EL16G_PR_R", "N", 8), ("CD", "C", 4)], [(100, 60, 40, "3"), (0, 1, 1, "3"), (50, "x", 9, "4")])
    raw = loaders.read_shapefile(spark, loaders.find_shapefile(str(tmp_path)))
    assert raw.count() == 3 and len(raw.orderBy("src_row").first()["rings"][0]) == 5
    df = loaders.load_mggg(raw, loaders.MGGG["nc"], crs="EPSG:5070").orderBy("node_id").collect()
    assert [(r["node_id"], r["pop"], r["votes_d"], r["district"]) for r in df] == [(0, 100.0, 60.0, 3), (1, 50.0, 0.0, 4)]
    assert loaders.MGGG_LOADERS["nc"](spark, str(tmp_path)).count() == 2
    with pytest.raises(FileNotFoundError):
        loaders.find_shapefile(str(tmp_path.parent / tmp_path.name / ".."))
    with pytest.raises(ValueError):
        loaders.load_state(spark, "zz", str(tmp_path))


CLARKE = 'GEOGCS["x",DATUM["D",SPHEROID["Clarke_1866",6378206.4,294.978698213898]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
PLACES = [
    # published worked examples: a plane point and its longitude and latitude
    (f'PROJCS["l",{CLARKE},PROJECTION["Lambert_Conformal_Conic"],PARAMETER["Standard_Parallel_1",33.0],PARAMETER["Standard_Parallel_2",45.0],PARAMETER["Latitude_Of_Origin",23.0],PARAMETER["Central_Meridian",-96.0],UNIT["Meter",1.0]]', 1894410.9, 1564649.5, -75.0, 35.0),
    (f'PROJCS["a",{CLARKE},PROJECTION["Albers"],PARAMETER["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",45.5],PARAMETER["Latitude_Of_Origin",23.0],PARAMETER["Central_Meridian",-96.0],UNIT["Meter",1.0]]', 1885472.7, 1535925.0, -75.0, 35.0),
    (f'PROJCS["t",{CLARKE},PROJECTION["Transverse_Mercator"],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],PARAMETER["Central_Meridian",-75.0],UNIT["Meter",1.0]]', 127106.5, 4484124.4, -73.5, 40.5),
    ("EPSG:32617", 630084.3, 4833438.5, -79.387139, 43.642567),
    ("EPSG:3857", -11131949.079, 4865942.280, -100.0, 40.0),
]


@pytest.mark.parametrize("crs, x, y, lon, lat", PLACES)
def test_planes_go_back_to_degrees(spark, crs, x, y, lon, lat):
    from pyspark.sql import functions as F

    from plansieve.functions import projections

    for scale, text in ((1.0, crs), (3.0, crs.replace('UNIT["Meter",1.0]', 'UNIT["third",0.333333333333333]'))):
        if scale != 1.0 and text == crs:
            continue
        got = spark.range(1).select(*projections.to_degrees(projections.parse(text), F.lit(x * scale), F.lit(y * scale))).first()
        assert tuple(got) == pytest.approx((lon, lat), abs=2e-6)


def test_own_plane_round_trip(spark):
    """Degrees to the common plane and back."""
    from pyspark.sql import functions as F

    from plansieve.functions import geometry, projections

    df = spark.createDataFrame([(-120.0, 25.0), (-96.0, 39.9), (-70.5, 48.25)], "lon double, lat double")
    x, y = geometry.albers(F.col("lon"), F.col("lat"))
    for r in df.select("lon", "lat", *projections.to_degrees(projections.parse("EPSG:5070"), x, y)).collect():
        assert (r[2], r[3]) == pytest.approx((r[0], r[1]), abs=1e-7)


ALBERS_PRJ = 'PROJCS["NAD83 / Conus Albers",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Albers_Conic_Equal_Area"],PARAMETER["latitude_of_center",23],PARAMETER["longitude_of_center",-96],PARAMETER["standard_parallel_1",29.5],PARAMETER["standard_parallel_2",45.5],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]'


def test_loaders_read_the_reference_system(spark, tmp_path):
    fields = [("TOTPOP", "N", 8), ("EL16G_PR_D", "N", 8), ("EL16G_PR_R", "N", 8), ("CD", "C", 4)]
    corner = lambda: loaders.MGGG_LOADERS["nc"](spark, str(tmp_path)).first()["rings"][0][1]
    write_shapefile(tmp_path / "nc", [square(3.0)], fields, [(100, 60, 40, "3")])
    assert corner()["x"] > 1e5  # no .prj: degrees, far east of the central meridian
    (tmp_path / "nc.prj").write_text(ALBERS_PRJ)
    assert corner().asDict() == {"x": 4.0, "y": 0.0}
    (tmp_path / "nc.prj").write_text(PLACES[0][0])
    write_shapefile(tmp_path / "nc", [square(1894409.9, 1564649.5)], fields, [(100, 60, 40, "3")])
    got, (x, y) = corner(), spark.range(1).select(*loaders.project.__globals__["albers"](loaders.F.lit(-75.0), loaders.F.lit(35.0))).first()
    assert (got["x"], got["y"]) == pytest.approx((x, y), abs=0.5)
    (tmp_path / "nc.prj").write_text('PROJCS["x",PROJECTION["Bonne"]]')
    with pytest.raises(ValueError, match="Bonne"):
        corner()


def test_districts_come_from_the_file_beside(spark, tmp_path):
    fields = [("TOTPOP", "N", 8), ("G20PREDBID", "N", 8), ("G20PRERTRU", "N", 8)]
    write_shapefile(tmp_path / "pa_vest_2020", [square(0.0), square(1.0), square(9.0)], fields, [(5, 1, 2), (0, 3, 4), (6, 3, 4)])
    (tmp_path / "pa_vest_2020.prj").write_text(ALBERS_PRJ)
    with pytest.raises(FileNotFoundError, match="pa_cong"):
        loaders.load_state(spark, "PA", str(tmp_path))
    wide = [[(-1.0, -1.0), (4.0, -1.0), (4.0, 4.0), (-1.0, 4.0), (-1.0, -1.0)]]
    write_shapefile(tmp_path / "pa_cong", [wide], [("CD", "C", 4)], [("12",)])
    (tmp_path / "pa_cong.prj").write_text(ALBERS_PRJ)
    assert [(r["pop"], r["district"]) for r in loaders.load_state(spark, "pa", str(tmp_path)).orderBy("node_id").collect()] == [(5.0, 12), (0.0, 12)]


def test_rename_takes_the_first_hit(spark):
    df = spark.createDataFrame([(1, 2, "12a", " 12 ")], "TOTPOP_2020 int, POPULATION int, PRES_DEM string, PRES_REP string")
    out = loaders.coerce_numeric(loaders.rename_first_hit(df, loaders.VEST_PA)).first()
    assert out["pop"] == 1.0 and out["POPULATION"] == 2 and out["votes_d"] == 0.0 and out["votes_r"] == 12.0
    assert loaders.missing_columns(loaders.rename_first_hit(df, loaders.VEST_PA)) == ["district"]


def test_vest_overlay(spark, tmp_path):
    f = lambda x, props: {"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in square(x)[0]]]}}
    path = tmp_path / "pa.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [f(0, {"TOTPOP": 5, "G20PREDBID": 1, "G20PRERTRU": 2}), f(1, {"TOTPOP": 0, "G20PREDBID": 3, "G20PRERTRU": 4}), f(9, {"TOTPOP": 6, "G20PREDBID": 3, "G20PRERTRU": 4})]}))
    raw = loaders.read_geojson(spark, str(path))
    big = [[{"x": x, "y": y} for x, y in ((-1.0, -1.0), (4.0, -1.0), (4.0, 4.0), (-1.0, 4.0), (-1.0, -1.0))]]
    overlay = spark.createDataFrame([(0, 12, big)], "district_row int, district int, rings array<array<struct<x:double,y:double>>>")
    got = loaders.load_vest(raw, overlay=overlay, crs="EPSG:5070").orderBy("node_id").collect()
    assert [(r["node_id"], r["pop"], r["district"]) for r in got] == [(0, 5.0, 12), (1, 0.0, 12)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("enacted", 0.5), ("spectral", 0.25)], "plan string, cut_edge_ratio double")
    sinks.write_parquet(df, str(tmp_path / "b"))
    assert sinks.baseline_metrics(spark, str(tmp_path / "b")) == {"cut_edge_ratio": 0.5}
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_run_config(str(tmp_path / "run.json"), states={"PA": 1})
    assert json.loads((tmp_path / "run.json").read_text())["states"] == {"PA": 1}


def test_stream_of_trajectories(spark, tmp_path):
    from plansieve.streaming import running

    rows = spark.sql("select 'm' as metric, cast(id % 2 as int) as chain_id, id as sample_idx, cast(id as double) as value, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts from range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    q = running.running_stats(running.read_trajectory_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    got = {r["chain_id"]: (r["n"], r["mean"]) for r in spark.table("stats").collect()}
    assert got == {0: (10, 9.0), 1: (10, 10.0)}


def test_pipeline_small(spark, tmp_path):
    from plansieve import pipeline

    cfg = pipeline.RunConfig(n_chains=2, n_samples=15, lag=3, burn_in=30, pop_tol=0.2, n_boot=20)
    pipeline.run_all(spark, str(tmp_path), {"AA": (60, 3, "r", 1)}, cfg)
    rows = spark.read.option("header", True).csv(str(tmp_path / "AA_summary"))
    assert rows.count() == 5 and {"rhat", "ess", "p_lo_95", "spectral"} <= set(rows.columns)
    assert spark.read.option("header", True).csv(str(tmp_path / "cross_state")).count() == 1


def test_states_read_from_files(spark, tmp_path):
    """A lattice of precincts in a shapefile, from the file to the cross-state table; polygons add two metrics."""
    from plansieve import cli, pipeline

    (tmp_path / "nc").mkdir()
    rows = [(100 + (i * 7) % 13, 40 + (i * 5) % 31, 50 + (i * 3) % 23, 1 + i // 24) for i in range(48)]
    write_shapefile(tmp_path / "nc" / "nc", [square(i % 6 * 1.0, i // 6 * 1.0) for i in range(48)], [("TOTPOP", "N", 8), ("EL16G_PR_D", "N", 8), ("EL16G_PR_R", "N", 8), ("CD", "N", 4)], rows)
    (tmp_path / "nc" / "nc.prj").write_text(ALBERS_PRJ)
    cfg = pipeline.RunConfig(n_chains=2, n_samples=10, lag=3, burn_in=20, pop_tol=0.3, n_boot=20)
    pipeline.run_all_real(spark, str(tmp_path / "out"), {"nc": str(tmp_path / "nc"), "zz": str(tmp_path)}, cfg)
    got = spark.read.option("header", True).csv(str(tmp_path / "out" / "nc_summary"))
    assert {r["metric"] for r in got.collect()} >= {"polsby_popper", "reock", "mst_diameter"}
    assert [r["state"] for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "cross_state")).collect()] == ["nc"]
    with pytest.raises(SystemExit):
        cli.main(["all"])


def test_scratch_tables_go_away(spark, tmp_path):
    import os

    from plansieve import storage

    with storage.scratch(spark) as folder:
        assert storage.cut(spark.range(3)).count() == 3
        path = folder.removeprefix("file://")
        assert os.listdir(path)
    assert not os.path.exists(path)


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_geopackage_and_wkb(spark, tmp_path):
    import sqlite3

    from pyspark.sql import functions as F

    from plansieve.sources import geopackage as gp

    ring = square(2.0)[0]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in ring)
    multi = struct.pack("<BII", 1, 6, 2) + wkb + wkb
    high = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<3d", *p, 9.0) for p in ring)
    want = [{"x": x, "y": y} for x, y in ring]
    assert gp.wkb_rings(wkb) == gp.wkb_rings(high) == [want] and gp.wkb_rings(multi) == [want, want] and gp.wkb_rings(None) == []
    path = str(tmp_path / "x.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('p', 'geom')")
    db.execute("CREATE TABLE p (fid INTEGER PRIMARY KEY, geom BLOB, TOTPOP INTEGER)")
    db.execute("INSERT INTO p VALUES (1, ?, 7), (2, NULL, NULL)", (b"GP\0\x02" + b"\0" * 4 + b"\0" * 32 + wkb,))
    db.commit()
    db.close()
    spark.dataSource.register(gp.GeoPackageSource)
    rows = spark.read.format("geopackage").load(path).orderBy("src_row").collect()
    assert [(r["src_row"], len(r["rings"]), r["TOTPOP"]) for r in rows] == [(1, 1, "7"), (2, 0, None)]
    got = spark.createDataFrame([(bytearray(wkb),), (None,)], "g binary").select(gp.rings_of_wkb(F.col("g")).alias("r")).collect()
    assert [len(r["r"]) for r in got] == [1, 0]


def test_figure_tables(spark, maps):
    from plansieve import pipeline
    from plansieve.operators import diagnostics
    from plansieve.plans import chain, spectral
    from pyspark.sql import functions as F

    n, e = maps.grid(6)
    n = n.withColumns({"x": (F.col("node_id") % 6).cast("double"), "y": F.floor(F.col("node_id") / 6).cast("double")})
    base = spectral.recursive_bisect(n, e, 3).cache()
    samples, _ = chain.run(n, e, base, 9, 0.3, 2, 5, 1)
    got = pipeline.ensemble_figures(n, e, base, samples.cache(), every=4)
    assert {r["sample_idx"] for r in got["maps"].select("sample_idx").distinct().collect()} == {-1, 0, 4, 8}
    assert {r["plan_id"]: r["count"] for r in got["seats_votes"].groupBy("plan_id").count().collect()} == dict.fromkeys((-1, 0, 4, 8), 41)
    assert got["seats_votes"].where("ideal_seats is not null").select("plan_id").distinct().count() == 1
    hist = got["histogram"].groupBy("metric").agg(F.sum("n").alias("n"), F.max("baseline").alias("b")).collect()
    assert {r["n"] for r in hist} == {9} and all(r["b"] is not None for r in hist) and len(hist) == 5
    walk = chain.trajectories(samples, n, e, ["cut_edge_ratio"])
    more = pipeline.figure_data(n, e, base, walk.select("metric", "value"), trajectory=walk, max_lag=3)
    assert more["borders"].count() > 0 and more["shares"].agg(F.max("rank")).first()[0] == 3 and more["autocorrelation"].count() == 4
    assert diagnostics.common_length(more["trace"]).count() == 9
    assert chain.sample_counts(samples).first().asDict() == {"n_chains": 1, "n_samples_per_chain": 9}


def test_archives_are_fetched_once(tmp_path):
    import zipfile

    from plansieve.sources import download

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/../../nc.shp", b"shape")
        z.writestr("deep/nc.dbf", b"table")
    url = (tmp_path / "a.zip").as_uri()
    got = download.fetch_all({"nc": url, "md": None, "wi": (tmp_path / "none.zip").as_uri()}, str(tmp_path / "raw"))
    assert got == {"nc": True, "md": False, "wi": False}
    assert sorted(p.name for p in (tmp_path / "raw" / "nc").iterdir()) == ["nc.dbf", "nc.shp"]
    (tmp_path / "a.zip").unlink()
    assert download.fetch(url, str(tmp_path / "raw" / "nc"))
