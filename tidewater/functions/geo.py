"""Positions on a sphere, in the flat approximation that tracks use (no cosine of the latitude)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres (fixed value).
EARTH_RADIUS = 6_371_000.0


def delta(degrees: Column) -> Column:
    """Chord of an angle on the unit circle: sqrt(2 (1 - cos x)) = 2 |sin(x / 2)|, without its cancellation."""
    return 2 * F.abs(F.sin(F.radians(degrees) / 2))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres."""
    dlat, dlon = delta(lat2 - lat1), delta(lon2 - lon1)
    return EARTH_RADIUS * F.sqrt(dlat * dlat + dlon * dlon)


def move(lat: Column, lon: Column, dlat: Column, dlon: Column, speed: Column, millis: Column) -> tuple[Column, Column]:
    """Where one gets from (lat, lon) in the direction (dlat, dlon), which can't be (0, 0), at ``speed`` m/s."""
    size = F.sqrt(dlat * dlat + dlon * dlon)
    size = F.when(size == 0, F.raise_error(F.lit("a direction is needed"))).otherwise(size)
    step = speed * millis / 1000 * 180 / (EARTH_RADIUS * F.pi())
    return lat + dlat / size * step, lon + dlon / size * step


def parse_position(tsv: Column) -> Column:
    """struct<lat, lon, ts> of the last three fields; null with fewer. Numbers that can't be parsed raise in ANSI mode."""
    parts = F.split(tsv, "\t")
    n = F.size(parts)
    at = lambda k: F.element_at(parts, -k)
    return F.when(n >= 3, F.struct(at(3).cast("double").alias("lat"), at(2).cast("double").alias("lon"), at(1).cast("long").alias("ts")))


def try_parse_position(tsv: Column) -> Column:
    """The same, null where a number can't be parsed."""
    parts = F.split(tsv, "\t")
    at = lambda k, kind: F.try_element_at(parts, F.lit(-k)).try_cast(kind)
    lat, lon, ts = at(3, "double"), at(2, "double"), at(1, "long")
    return F.when((F.size(parts) >= 3) & lat.isNotNull() & lon.isNotNull() & ts.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), ts.alias("ts")))
