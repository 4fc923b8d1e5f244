from pyspark.sql import functions as F

from plansieve.functions import geometry, projections


def test_pole_comes_back(spark):
    at = spark.range(25).select((F.col("id") / 10.0 - 100).alias("lon"), F.lit(90.0).alias("lat"))
    x, y = geometry.albers(F.col("lon"), F.col("lat"))
    lon, lat = projections.to_degrees(projections.parse("EPSG:5070"), F.col("x"), F.col("y"))
    for r in at.select("lon", x.alias("x"), y.alias("y")).select("lon", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lat2 - 90) < 1e-5 and abs(r.lon2 - r.lon) < 1e-7


def test_off_the_plane_is_nan(spark):
    lat = projections.to_degrees(projections.parse("EPSG:5070"), F.lit(0.0), F.lit(9.9e6))[1]
    assert spark.range(1).select(F.isnan(lat).alias("off")).first().off
