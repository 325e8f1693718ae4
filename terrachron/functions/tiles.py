"""Web-mercator tile arithmetic as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HALF_WORLD = 20037508.342789244
# Guards that keep points on a tile edge in the right tile.
EDGE = 1e-14
CORNER = 1e-11
MAX_LAT = 85.051129


def _clamped(fraction: Column, zoom: Column) -> Column:
    count = F.pow(F.lit(2.0), zoom)
    cell = F.floor((fraction + EDGE) * count)
    return F.when(fraction <= 0, 0).when(fraction >= 1, count - 1).otherwise(cell).cast("int")


def tile_x(lon: Column, zoom: Column) -> Column:
    return _clamped(lon / 360.0 + 0.5, zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    sine = F.sin(F.radians(lat))
    fraction = F.lit(0.5) - F.ln((1 + sine) / (1 - sine)) * 0.25 / F.lit(3.141592653589793)
    return _clamped(fraction, zoom)


def metre_tile_x(x: Column, zoom: Column) -> Column:
    return _clamped((x + HALF_WORLD) / (2 * HALF_WORLD), zoom)


def metre_tile_y(y: Column, zoom: Column) -> Column:
    return _clamped((F.lit(HALF_WORLD) - y) / (2 * HALF_WORLD), zoom)


def tile_size(zoom: Column) -> Column:
    """Edge of a tile in metres."""
    return F.lit(2 * HALF_WORLD) / F.pow(F.lit(2.0), zoom)


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """EPSG:3857 envelope of a tile."""
    size = tile_size(z)
    left = x * size - HALF_WORLD
    top = F.lit(HALF_WORLD) - y * size
    return {"xmin": left, "ymin": top - size, "xmax": left + size, "ymax": top}


def extent(max_zoom: Column) -> Column:
    """Grid cells per tile edge; fewer for bands that end at a low zoom."""
    return F.when(max_zoom <= 5, 1024).when(max_zoom <= 9, 2048).otherwise(4096)


def buffer(max_zoom: Column) -> Column:
    return F.when(max_zoom <= 5, 64).when(max_zoom <= 9, 128).otherwise(256)


def short_x(x: Column) -> Column:
    """Decimal digits of x without the last one (3 digits) or two (4 and more)."""
    digits = x.cast("string")
    size = F.length(digits)
    kept = F.when(size <= 2, size).when(size == 3, size - 1).otherwise(size - 2)
    return F.substring(digits, F.lit(1), kept)


def tile_prefix(z: Column, x: Column) -> Column:
    return F.concat(z.cast("string"), F.lit("/"), short_x(x))
