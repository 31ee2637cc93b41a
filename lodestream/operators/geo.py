"""Points in regions and points near points, by crossing parity.

A point lies in a polygon if a ray from it to the east crosses the polygon's edges an odd number of times. Edges
are binned into latitude strips, and within a strip into the longitude cells which their region covers; points
find the edges of the regions around them by an equi-join on (strip, cell), and the crossings are counted by point
and region. Cells crowded with points are salted by their measured counts: the points of a cell are spread over
as many salts as it has blocks of points, and its edges, few, are repeated for each salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float = EARTH_M) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius_m) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def region_edges(regions: DataFrame, region: str, ring: str) -> DataFrame:
    """_region, lat1, lon1, lat2, lon2, west, east of each edge of each region's ring.

    ring: array<struct<lat double, lon double>>, closed or not. Several rows of one region are rings of one
    region (holes and islands by parity); equal rows count once. Null regions, rings and vertices, and rings of
    fewer than three vertices, take no part.
    """
    rings = (
        regions.select(F.col(f"`{region}`").alias("_region"), F.col(f"`{ring}`").alias("_ring"))
        .where("_region IS NOT NULL AND size(_ring) >= 3 AND NOT exists(_ring, v -> v IS NULL OR v.lat IS NULL OR v.lon IS NULL)")
        .distinct()
    )
    ends = F.concat(F.slice("_ring", 2, F.size("_ring") - 1), F.slice("_ring", 1, 1))
    return (
        rings.select(
            "_region",
            F.array_min(F.transform("_ring", lambda v: v["lon"])).alias("west"),
            F.array_max(F.transform("_ring", lambda v: v["lon"])).alias("east"),
            F.inline(F.arrays_zip(F.col("_ring").alias("a"), ends.alias("b"))),
        )
        .select("_region", "west", "east", F.col("a.lat").alias("lat1"), F.col("a.lon").alias("lon1"), F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2"))
        .where("lat1 != lat2 OR lon1 != lon2")
    )


def points_in_regions(
    points: DataFrame,
    point: str,
    lat: str,
    lon: str,
    edges: DataFrame,
    strip_deg: float = 0.02,
    cell_deg: float = 0.02,
    boundary: str = "half_open",
    points_per_salt: int = 20_000,
) -> DataFrame:
    """Pairs (_point, _lat, _lon, _region) of each point and each region that contains it.

    boundary: "half_open": southern and western borders belong to a region, northern and eastern ones don't, so
    regions that share a border never share a point of it; "closed": a point on any edge or vertex is contained.
    The ray of a point leaves eastwards; an edge counts from its lower end up to, not including, its upper end, so
    a ray through a vertex counts once and horizontal edges never count. Points with null id or coordinates or
    NaN take no part; repeated points give a pair once; several positions of one id are tested apart.
    """
    if boundary not in ("half_open", "closed"):
        raise ValueError("boundary must be half_open or closed")
    bin_of = lambda x, width: F.floor(x / F.lit(width)).cast("long")
    spots = (
        points.select(F.col(f"`{point}`").alias("_point"), F.col(f"`{lat}`").cast("double").alias("_lat"), F.col(f"`{lon}`").cast("double").alias("_lon"))
        .where("_point IS NOT NULL AND _lat BETWEEN -90 AND 90 AND _lon BETWEEN -540 AND 540")
        .withColumn("_strip", bin_of(F.col("_lat"), strip_deg))
        .withColumn("_cell", bin_of(F.col("_lon"), cell_deg))
    )
    counts = spots.groupBy("_strip", "_cell").agg(F.ceil(F.count(F.lit(1)) / points_per_salt).cast("int").alias("_salts"))
    south, north = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    binned = (
        edges.withColumn("_strip", F.explode(F.sequence(bin_of(south, strip_deg), bin_of(north, strip_deg))))
        .withColumn("_cell", F.explode(F.sequence(bin_of(F.col("west"), cell_deg), bin_of(F.col("east"), cell_deg))))
        .join(counts, ["_strip", "_cell"])
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .drop("_salts", "west", "east")
    )
    # crowded cells are at most points / points_per_salt; the rest need no salt
    crowded = counts.where("_salts > 1")
    salted = spots.join(crowded, ["_strip", "_cell"], "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("_point", "_lat", "_lon"), F.col("_salts")).cast("int"), F.lit(0))
    ).drop("_salts")
    across = F.col("lon1") + (F.col("_lat") - F.col("lat1")) / F.nullif(F.col("lat2") - F.col("lat1"), F.lit(0.0)) * (F.col("lon2") - F.col("lon1"))
    crosses = ((F.col("lat1") <= F.col("_lat")) != (F.col("lat2") <= F.col("_lat"))) & (F.col("_lon") < across)
    on_edge = (
        F.col("_lat").between(south, north)
        & F.col("_lon").between(F.least("lon1", "lon2"), F.greatest("lon1", "lon2"))
        & ((F.col("lat1") == F.col("lat2")) | (F.col("_lon") == across))
    )
    met = salted.join(binned, ["_strip", "_cell", "_salt"])
    counted = met.select("_point", "_lat", "_lon", "_region", "_strip", "_cell", "_salt", crosses.cast("int").alias("_crosses"), on_edge.alias("_on"), "lat1", "lon1", "lat2", "lon2")
    if boundary == "half_open":
        counted = counted.where("_crosses = 1")
    else:
        counted = counted.where("_crosses = 1 OR _on")
    # an edge met by a repeated point counts once
    return (
        counted.groupBy("_strip", "_cell", "_salt", "_point", "_lat", "_lon", "_region", "lat1", "lon1", "lat2", "lon2")
        .agg(F.max("_crosses").alias("_crosses"), F.max("_on").alias("_on"))
        .groupBy("_strip", "_cell", "_salt", "_point", "_lat", "_lon", "_region")
        .agg((F.sum("_crosses") % 2).alias("_odd"), F.max("_on").alias("_on"))
        .where("_odd = 1" if boundary == "half_open" else "_odd = 1 OR _on")
        .select("_point", "_lat", "_lon", "_region")
    )


def rectangle(lat: Column, lon: Column, half_lat: Column, half_lon: Column, digits: int = 7) -> Column:
    """Ring of the cell around a centre; its borders are rounded so that neighbours share them exactly."""
    s, n = F.round(lat - half_lat, digits), F.round(lat + half_lat, digits)
    w, e = F.round(lon - half_lon, digits), F.round(lon + half_lon, digits)
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.array(corner(s, w), corner(s, e), corner(n, e), corner(n, w))


def disc_ring(lat: Column, lon: Column, metres: float, corners: int = 8, radius_m: float = EARTH_M) -> Column:
    """A ring that contains the disc of that radius around a point.

    Up to 80 degrees of latitude it is a polygon around the disc, a hundredth wider for the bend of its sides on
    the map; beyond, it is the disc's bounding box, and the whole polar cap where the disc holds a pole.
    """
    r = metres * 1.01 / math.cos(math.pi / corners) / radius_m
    sin_lat, cos_lat = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    vertices = []
    for k in range(corners):
        bearing = 2 * math.pi * k / corners
        v = F.asin(sin_lat * math.cos(r) + cos_lat * math.sin(r) * math.cos(bearing))
        d = F.atan2(F.lit(math.sin(bearing) * math.sin(r)) * cos_lat, F.lit(math.cos(r)) - sin_lat * F.sin(v))
        vertices.append(F.struct(F.degrees(v).alias("lat"), (lon + F.degrees(d)).alias("lon")))
    flat = metres * 1.01 / radius_m
    half_lat = F.lit(math.degrees(flat))
    near_pole = F.abs(lat) + half_lat >= 90
    # try_divide-free: the sine ratio is only used where it is below one
    half_lon = F.when(near_pole, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(flat)) / F.greatest(cos_lat, F.lit(1e-12))))))
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    s, n = F.greatest(lat - half_lat, F.lit(-90.0)), F.when(near_pole & (lat > 0), F.lit(90.1)).otherwise(lat + half_lat)
    box = F.array(corner(s, lon - half_lon), corner(s, lon + half_lon), corner(n, lon + half_lon), corner(n, lon - half_lon))
    return F.when(F.abs(lat) < 80, F.array(*vertices)).otherwise(box)


def points_near(
    points: DataFrame,
    point: str,
    lat: str,
    lon: str,
    places: DataFrame,
    place: str,
    place_lat: str,
    place_lon: str,
    metres: float,
    **how,
) -> DataFrame:
    """Pairs (_point, _place, metres) at most metres apart on the sphere.

    The disc around each place is enclosed in a region; points_in_regions finds the points in it and the exact
    distance decides. Places near the 180th meridian get copies of their region on the other side of it. Null
    or NaN coordinates, latitudes beyond 90 and longitudes beyond 180 take no part; repeated places and points give
    a pair once. Note that a place that covers a pole covers all longitudes.
    """
    valid = places.select(F.col(f"`{place}`").alias("_place"), F.col(f"`{place_lat}`").cast("double").alias("_plat"), F.col(f"`{place_lon}`").cast("double").alias("_plon")).where(
        "_place IS NOT NULL AND _plat BETWEEN -90 AND 90 AND _plon BETWEEN -180 AND 180"
    ).distinct()
    half = math.degrees(metres * 1.2 / EARTH_M)
    reach = F.when(F.abs("_plat") + half >= 90, F.lit(180.0)).otherwise(F.lit(half) / F.greatest(F.cos(F.radians("_plat")), F.lit(1e-12)) * 1.1)
    copies = valid.withColumn(
        "_turn",
        F.explode(
            F.filter(
                F.array(F.lit(0.0), F.when(F.col("_plon") - reach < -180, F.lit(360.0)), F.when(F.col("_plon") + reach > 180, F.lit(-360.0))),
                lambda x: x.isNotNull(),
            )
        ),
    )
    # near a pole the box covers all longitudes already
    copies = copies.where(f"_turn = 0 OR abs(_plat) + {half} < 90")
    regions = copies.select(
        F.struct("_place", "_plat", "_plon", "_turn").alias("_region"),
        disc_ring(F.col("_plat"), F.col("_plon") + F.col("_turn"), metres).alias("_ring"),
    )
    return (
        points_in_regions(points.where(F.col(f"`{lon}`").between(-180, 180)), point, lat, lon, region_edges(regions, "_region", "_ring"), **how)
        .withColumn("metres", great_circle_m(F.col("_lat"), F.col("_lon"), F.col("_region._plat"), F.col("_region._plon")))
        .where(F.col("metres") <= metres)
        .select("_point", F.col("_region._place").alias("_place"), "metres")
        .groupBy("_point", "_place")
        .agg(F.min("metres").alias("metres"))
    )


def last_positions(rows: DataFrame, entity: str, lat: str, lon: str, time: str) -> DataFrame:
    """entity, lat, lon, time of each entity's latest row with a latitude within 90 and a longitude within 180.

    Rows with null entity, time or coordinates or NaN take no part; of rows at the same time, that with the
    greatest (lat, lon) counts.
    """
    ok = F.col(f"`{lat}`").between(-90, 90) & F.col(f"`{lon}`").between(-180, 180) & F.col(f"`{time}`").isNotNull() & F.col(f"`{entity}`").isNotNull()
    return (
        rows.where(ok)
        .groupBy(F.col(f"`{entity}`").alias("entity"))
        .agg(F.max(F.struct(F.col(f"`{time}`").alias("time"), F.col(f"`{lat}`").alias("lat"), F.col(f"`{lon}`").alias("lon"))).alias("_p"))
        .select("entity", "_p.lat", "_p.lon", "_p.time")
    )
