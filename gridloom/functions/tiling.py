"""UTM tiles: codes of zone, band, column and row, their corners, and points by tile.

Tiles are squares of 109,830 m whose north-west corner lies 15 m off the
100 km grid. Coordinates go between the ellipsoid and the plane by Krueger's
series to the third order, written as column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid, scale on the central meridian, false easting and northing.
A, FLAT, SCALE, EAST0, NORTH0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
# Side of a tile and its offset, in metres; latitude bands from 80 S.
SIDE, OFFSET = 109_830.0, 15.0
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
ROWS = "ABCDEFGHJKLMNPQRSTUV"

_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def band(lat: Column) -> Column:
    at = F.least(F.floor((lat + 80) / 8), F.lit(19)).cast("int")
    return F.when(lat.between(-80, 84), F.substring(F.lit(BANDS), at + 1, F.lit(1)))


def to_plane(lat: Column, lon: Column, utm_zone: Column) -> tuple[Column, Column]:
    """Easting and northing."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (utm_zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + SCALE * _RADIUS * x, F.when(lat < 0, F.lit(NORTH0)).otherwise(0.0) + SCALE * _RADIUS * y


def to_globe(easting: Column, northing: Column, utm_zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude."""
    xi = (northing - F.when(south, F.lit(NORTH0)).otherwise(0.0)) / (SCALE * _RADIUS)
    eta = (easting - EAST0) / (SCALE * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), (utm_zone * 6 - 183) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def tile_code(lat: Column, lon: Column) -> Column:
    """The code of the 100 km square that holds a point, or null outside the bands."""
    z = zone(lon)
    easting, northing = to_plane(lat, lon, z)
    letters = F.element_at(F.array(*[F.lit(c) for c in COLUMNS]), ((z - 1) % 3 + 1).cast("int"))
    column = F.substring(letters, F.floor(easting / 100_000).cast("int"), F.lit(1))
    row = (F.floor(northing / 100_000) + F.when(z % 2 == 0, 5).otherwise(0)) % 20
    return F.when(band(lat).isNotNull(), F.concat(F.lpad(z.cast("string"), 2, "0"), band(lat), column, F.substring(F.lit(ROWS), row.cast("int") + 1, F.lit(1))))


def tile_box(easting: Column, northing: Column, utm_zone: Column, south: Column) -> Column:
    """West, south, east, north of the tile whose square's south-west corner is given, over its four corners."""
    west, north = easting - OFFSET, northing + 100_000 + OFFSET
    corners = [to_globe(x, y, utm_zone, south) for x in (west, west + SIDE) for y in (north, north - SIDE)]
    lats, lons = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*lons).alias("west"), F.least(*lats).alias("south"), F.greatest(*lons).alias("east"), F.greatest(*lats).alias("north"))


def polygon_meets_box(polygon: str, west: str, south: str, east: str, north: str) -> Column:
    """Whether a polygon, an array of (x, y) without its first point again, and a box share a point.

    They do if a corner of one is inside the other or two of their sides cross
    or touch; arguments are SQL expressions.
    """
    after = f"concat(slice({polygon}, 2, size({polygon})), slice({polygon}, 1, 1))"
    sides = f"zip_with({polygon}, {after}, (p, q) -> named_struct('a', p, 'b', q))"
    corner = lambda x, y: f"named_struct('x', cast({x} as double), 'y', cast({y} as double))"
    box = f"array({corner(west, south)}, {corner(east, south)}, {corner(east, north)}, {corner(west, north)})"
    box_sides = f"zip_with({box}, concat(slice({box}, 2, 4), slice({box}, 1, 1)), (p, q) -> named_struct('a', p, 'b', q))"
    inside = f"exists({polygon}, p -> p.x between {west} and {east} and p.y between {south} and {north})"
    # a ray to the right crosses the polygon's sides an odd number of times
    ray = "(s.a.y > c.y) <> (s.b.y > c.y) and c.x < (s.b.x - s.a.x) * (c.y - s.a.y) / (s.b.y - s.a.y) + s.a.x"
    around = f"exists({box}, c -> size(filter({sides}, s -> {ray})) % 2 = 1)"
    turn = lambda p, q, r: f"sign(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
    between = lambda p, q, r: f"({r}.x between least({p}.x, {q}.x) and greatest({p}.x, {q}.x) and {r}.y between least({p}.y, {q}.y) and greatest({p}.y, {q}.y))"
    t = [turn("s.a", "s.b", "d.a"), turn("s.a", "s.b", "d.b"), turn("d.a", "d.b", "s.a"), turn("d.a", "d.b", "s.b")]
    touch = [f"({t[0]} = 0 and {between('s.a', 's.b', 'd.a')})", f"({t[1]} = 0 and {between('s.a', 's.b', 'd.b')})", f"({t[2]} = 0 and {between('d.a', 'd.b', 's.a')})", f"({t[3]} = 0 and {between('d.a', 'd.b', 's.b')})"]
    crossing = f"exists({sides}, s -> exists({box_sides}, d -> ({t[0]} <> {t[1]} and {t[2]} <> {t[3]}) or {' or '.join(touch)}))"
    return F.expr(f"{inside} or {around} or {crossing}")
