"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def metres(km: Column) -> Column:
    """Whole metres, half to even."""
    return F.bround(km * 1000, 0).cast("long")


def coordinates(c: Column) -> Column:
    """(lat, lng) of a map URL (/@lat,lng or ll, center, q, query), of degrees, minutes and seconds, or of a bare pair; digits of
    either width. A latitude beyond 90 is swapped; what is out of range is null. Six decimals."""
    text = F.translate(c, "０１２３４５６７８９．，－", "0123456789.,-")
    num = r"(-?\d{1,3}(?:\.\d+)?)"
    patterns = [rf"/@{num},{num}", rf"[?&](?:ll|center|q|query)={num}(?:,|%2[Cc]){num}", rf"^\s*{num}\s*[,\s]\s*{num}\s*$"]
    pair = lambda g: F.coalesce(*[F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p in patterns]).try_cast("double")
    dms = r"(\d{1,3})[°度](\d{1,2})['′分](\d{1,2}(?:\.\d+)?)[\"″秒]"
    part = lambda which, g: F.get(F.regexp_extract_all(text, F.lit(dms), F.lit(g)), F.lit(which)).try_cast("double")
    degrees = lambda which: part(which, 1) + part(which, 2) / 60 + part(which, 3) / 3600
    lat, lng = F.coalesce(pair(1), degrees(0)), F.coalesce(pair(2), degrees(1))
    swap = (F.abs(lat) > 90) & (F.abs(lng) <= 90)
    a, b = F.when(swap, lng).otherwise(lat), F.when(swap, lat).otherwise(lng)
    return F.when((F.abs(a) <= 90) & (F.abs(b) <= 180), F.struct(F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng")))


def map_url(name: Column, lat: Column, lng: Column) -> Column:
    """A map link: by coordinates if there are any, else by name."""
    at = F.concat(F.round(lat, 6).cast("string"), F.lit(","), F.round(lng, 6).cast("string"))
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.coalesce(F.url_encode(at), F.url_encode(name)))
