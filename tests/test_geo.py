import math

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators.geo import EARTH_M, last_positions, points_in_regions, points_near, rectangle, region_edges


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def near(spark, points, places, m=500.0, **how):
    p = spark.createDataFrame(points, "id bigint, lat double, lon double").withColumn("_strip", F.lit(1)).withColumn("metres", F.lit(1))
    q = spark.createDataFrame(places, "id bigint, lat double, lon double").withColumn("_place", F.lit("x"))
    rows = points_near(p, "id", "lat", "lon", q, "id", "lat", "lon", m, **how).collect()
    assert len(rows) == len({(r._point, r._place) for r in rows})
    return {(r._point, r._place) for r in rows}


def test_distance_everywhere_against_brute_force(spark):
    rng = np.random.default_rng(2)
    places = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))]
    places += [(100, 0.0, 180.0), (101, 10.0, -179.9999), (102, 89.9999, 30.0), (103, -90.0, 0.0), (104, 79.999, 5.0), (105, 80.001, 5.0), (106, 0.0, 0.0), (107, 85.0, 179.999)]
    points, n = [], 0
    for _, la, lo in places:
        for _ in range(12):
            d, b = rng.uniform(0, 1000) / EARTH_M, rng.uniform(0, 2 * math.pi)
            p = math.asin(math.sin(math.radians(la)) * math.cos(d) + math.cos(math.radians(la)) * math.sin(d) * math.cos(b))
            x = math.radians(lo) + math.atan2(math.sin(b) * math.sin(d) * math.cos(math.radians(la)), math.cos(d) - math.sin(math.radians(la)) * math.sin(p))
            points.append((n, math.degrees(p), (math.degrees(x) + 540) % 360 - 180))
            n += 1
    want = {(i, j) for i, *a in points for j, *b in places if metres(a, b) <= 500}
    assert near(spark, points + points[:20], places + places[:5]) == want
    assert near(spark, points, places, points_per_salt=3) == want
    assert len(want) > 300


def test_missing_coordinates_and_empty(spark):
    nan = float("nan")
    points = [(1, None, 0.0), (2, 0.0, None), (3, nan, 0.0), (4, 91.0, 0.0), (5, 0.0, 181.0), (None, 0.0, 0.0), (6, 0.0, 0.0)]
    places = [(1, 0.0, 0.0), (2, None, 0.0), (None, 0.0, 0.0), (3, nan, nan), (4, 0.0, 200.0)]
    assert near(spark, points, places) == {(6, 1)}
    assert near(spark, [], places) == set() == near(spark, points, [])


def contained(spark, points, rings, **how):
    p = spark.createDataFrame(points, "id bigint, lat double, lon double")
    r = spark.createDataFrame([(i, [(float(a), float(b)) for a, b in ring]) for i, ring in rings], "region string, ring array<struct<lat: double, lon: double>>")
    return sorted((x._point, x._region) for x in points_in_regions(p, "id", "lat", "lon", region_edges(r, "region", "ring"), 0.5, 0.5, **how).collect())


SQUARE = [(0, 0), (0, 2), (2, 2), (2, 0)]
NEXT = [(0, 2), (0, 4), (2, 4), (2, 2)]
BENT = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)]


def test_borders(spark):
    corners = [(1, 0.0, 0.0), (2, 0.0, 2.0), (3, 2.0, 0.0), (4, 2.0, 2.0), (5, 0.0, 1.0), (6, 1.0, 2.0), (7, 1.0, 1.0), (8, 3.0, 3.0), (9, 1.0, 4.0)]
    got = contained(spark, corners, [("a", SQUARE), ("b", NEXT)])
    assert got == [(1, "a"), (2, "b"), (5, "a"), (6, "b"), (7, "a")]  # shared borders belong to one
    closed = contained(spark, corners, [("a", SQUARE), ("b", NEXT)], boundary="closed")
    assert closed == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "b"), (5, "a"), (6, "a"), (6, "b"), (7, "a"), (9, "b")]


def test_bent_regions_holes_and_repeats(spark):
    points = [(1, 2.0, 1.0), (2, 2.0, 3.0), (3, 3.5, 3.4), (4, 0.5, 3.0), (5, 1.0, 1.0), (1, 2.0, 1.0)]
    assert contained(spark, points, [("v", BENT), ("v", BENT)]) == [(1, "v"), (3, "v"), (4, "v"), (5, "v")]
    hole = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5)]
    assert contained(spark, [(1, 1.0, 1.0), (2, 0.2, 0.2)], [("h", SQUARE), ("h", hole)]) == [(2, "h")]
    assert contained(spark, points, []) == [] == contained(spark, [], [("v", BENT)])


def test_each_point_of_a_grid_lies_in_one_cell(spark):
    cells = spark.createDataFrame([(i, 10 + i // 4 * 0.01, 20 + i % 4 * 0.01) for i in range(16)], "cell int, lat double, lon double")
    rings = cells.select("cell", rectangle(F.col("lat"), F.col("lon"), F.lit(0.005), F.lit(0.005)).alias("ring"))
    points = spark.range(41 * 41).select("id", F.round(9.995 + F.floor(F.col("id") / 41) * 0.001, 3).alias("lat"), F.round(19.995 + F.col("id") % 41 * 0.001, 3).alias("lon"))
    got = points_in_regions(points, "id", "lat", "lon", region_edges(rings, "cell", "ring")).groupBy("_point").count().collect()
    assert len(got) == 40 * 40 and all(r["count"] == 1 for r in got)


def test_last_positions(spark):
    rows = spark.createDataFrame([(1, 5.0, 5.0, 10), (1, 95.0, 5.0, 20), (1, None, 5.0, 30), (1, 6.0, 5.0, 10), (2, 1.0, 200.0, 1), (None, 1.0, 1.0, 1), (3, 1.0, 1.0, None)], "v int, lat double, lon double, t int")
    assert [tuple(r) for r in last_positions(rows, "v", "lat", "lon", "t").collect()] == [(1, 6.0, 5.0, 10)]
