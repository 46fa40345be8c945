"""Places within a radius."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.functions import geo
from fernglass.operators.search import best_of


def within_radius(places: DataFrame, centres: DataFrame, *, radius_m: int, limit: int = 10, categories: list[str] = ()) -> DataFrame:
    """cid, ord, distance_m: the nearest places (ord, lat, lng) of each centre (cid, clat, clng) at most the radius away, by whole
    metres, then ord; of some categories only, if asked. Places and centres without coordinates, or with a latitude that no place on the globe has, are
    left out.

    Both sides are dealt to a grid whose cells are as high and wide as the radius in degrees; a centre looks at the cells that
    its circle may touch, around the globe at 180 degrees and over the poles, so the join is an equi-join on cells with
    the exact distance after it. Centres of one place are one centre there, and of places at one point only the first `limit`
    ones by ord are dealt out, so neither many centres nor many places at a point multiply what meets.
    """
    real = lambda lat, lng: F.col(lat).between(-90, 90) & F.col(lng).isNotNull() & ~F.isnan(F.col(lng).cast("double"))
    centres = centres.where(real("clat", "clng"))
    if categories:
        places = places.where(F.trim("category").isin(*categories))
    step = radius_m / 111_000.0
    around = max(1, int(360 / step))  # cells of a whole circle of latitude
    angle = radius_m / (1000 * geo.EARTH_KM)
    x = lambda lng: F.floor((lng + 180) * around / 360)
    polar = F.abs(F.radians("clat")) + angle >= math.pi / 2
    reach = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(angle) / F.cos(F.radians("clat"))))) + 1e-6)
    rows = F.sequence(F.floor(F.col("clat") / step) - 1, F.floor(F.col("clat") / step) + 1)
    cells = F.array_distinct(F.transform(F.sequence(x(F.col("clng") - reach), x(F.col("clng") + reach)), lambda c: F.pmod(c, F.lit(around))))
    limit = max(1, limit)
    points = centres.select("clat", "clng").distinct()
    c = points.select("clat", "clng", F.explode(rows).alias("_y"), cells.alias("_c")).select("clat", "clng", "_y", F.explode("_c").alias("_x"))
    # more than `limit` places at one point can't all be among a centre's nearest; which can is said by ord alone
    few = best_of(places.where(real("lat", "lng")).select("ord", "lat", "lng"), F.col("ord"), limit=limit, per=["lat", "lng"])
    p = few.select("ord", "lat", "lng", F.floor(F.col("lat") / step).alias("_y"), F.pmod(x(F.col("lng")), F.lit(around)).alias("_x")).hint("merge")
    near = p.join(c, ["_y", "_x"]).withColumn("_km", geo.haversine_km(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng"))).where(F.col("_km") * 1000 <= radius_m)
    ranked = best_of(near.select("clat", "clng", "ord", geo.metres(F.col("_km")).alias("distance_m")), F.col("distance_m"), F.col("ord"), limit=limit, per=["clat", "clng"])
    each = centres.select("cid", "clat", "clng").hint("merge").join(ranked.drop("_r"), ["clat", "clng"])
    return best_of(each, F.col("distance_m"), F.col("ord"), limit=limit, per="cid").select("cid", "ord", "distance_m")
