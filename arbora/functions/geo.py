"""Affine transforms, boxes, rings and coordinate systems as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]  #: a, b, c, d, e, f: x = a col + b row + c, y = d col + e row + f


def pixel_to_map(t: Affine, col: Column, row: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    return a * col + b * row + c, d * col + e * row + f


def map_to_pixel(t: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional (col, row); take ``floor`` for indexes."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def box_to_map(t: Affine, x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Map box of pixel box (x1, y1)-(x2, y2); the lower right corner is the far edge of its pixel."""
    left, top = pixel_to_map(t, x1, y1)
    right, bottom = pixel_to_map(t, x2 + 1, y2 + 1)
    return {"xmin": F.least(left, right), "ymin": F.least(top, bottom), "xmax": F.greatest(left, right), "ymax": F.greatest(top, bottom)}


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, dx: Column, dy: Column, width: int, height: int) -> dict[str, Column]:
    """Chip box to whole pixels of the tile, grown outward and clipped to the raster."""
    low = lambda v: F.greatest(F.lit(0).cast("bigint"), F.floor(v))
    high = lambda v, most: F.least(F.lit(most).cast("bigint"), F.ceil(v))
    return {"px1": low(x1 + dx), "py1": low(y1 + dy), "px2": high(x2 + dx, width), "py2": high(y2 + dy, height)}


def crown_attributes() -> dict[str, Column]:
    """Diameter (the box's diagonal) and centre of ``xmin, ymin, xmax, ymax``."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return {"diameter": F.sqrt(w * w + h * h), "centroid_x": (F.col("xmin") + F.col("xmax")) / 2, "centroid_y": (F.col("ymin") + F.col("ymax")) / 2}


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}xmax") - F.col(f"{p}xmin")) * (F.col(f"{p}ymax") - F.col(f"{p}ymin"))


def ring_area(ring: str) -> Column:
    """Shoelace area of an array of structs (x, y), open or closed."""
    return F.expr(f"""abs(aggregate(sequence(0, size({ring}) - 1), 0D, (s, i) -> s + {ring}[i].x * {ring}[(i + 1) % size({ring})].y
                      - {ring}[(i + 1) % size({ring})].x * {ring}[i].y)) / 2""")


def ring_bounds(ring: str) -> dict[str, Column]:
    part = lambda f, k: F.expr(f"array_{f}(transform({ring}, p -> p.{k}))")
    return {"xmin": part("min", "x"), "ymin": part("min", "y"), "xmax": part("max", "x"), "ymax": part("max", "y")}


def box_ring() -> Column:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))


def iou(a: str = "", b: str = "", names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Column:
    """Intersection over union of two boxes whose columns have the prefixes ``a`` and ``b``."""
    x1, y1, x2, y2 = names
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, x2), c(b, x2)) - F.greatest(c(a, x1), c(b, x1)))
    h = F.greatest(F.lit(0.0), F.least(c(a, y2), c(b, y2)) - F.greatest(c(a, y1), c(b, y1)))
    area = lambda p: (c(p, x2) - c(p, x1)) * (c(p, y2) - c(p, y1))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


# GRS80 ellipsoid and UTM zone 32.
_A, _FLATTENING, _K0, _EAST, _LON0 = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 9.0
_N = _FLATTENING / (2 - _FLATTENING)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth power of the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def lonlat_to_utm32(lon, lat, m=F):
    """EPSG:4326 degrees to EPSG:25832 metres, of columns, or of arrays with ``m=numpy``."""
    s = 2 * math.sqrt(_N) / (1 + _N)
    sin = m.sin(m.radians(lat))
    t = m.sinh(m.atanh(sin) - s * m.atanh(s * sin))
    d = m.radians(lon - _LON0)
    xi, eta = m.atan2(t, m.cos(d)), m.atanh(m.sin(d) / m.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        x = x + a * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        y = y + a * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return _EAST + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def utm32_to_lonlat(x, y, m=F):
    """EPSG:25832 metres to EPSG:4326 degrees, of columns, or of arrays with ``m=numpy``."""
    xi0, eta0 = y / (_K0 * _RADIUS), (x - _EAST) / (_K0 * _RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(_BETA, 1):
        xi = xi - b * m.sin(2 * k * xi0) * m.cosh(2 * k * eta0)
        eta = eta - b * m.cos(2 * k * xi0) * m.sinh(2 * k * eta0)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + d * m.sin(2 * k * chi)
    return _LON0 + m.degrees(m.atan2(m.sinh(eta), m.cos(xi))), m.degrees(lat)


def converted(srid: int | None, to: int | None, x, y, m=F):
    """The coordinates in the system ``to``; both systems must be known, and only 4326 and 25832 convert."""
    if srid is None or to is None:
        raise ValueError("both sides need a coordinate system")
    pairs = {(4326, 25832): lonlat_to_utm32, (25832, 4326): utm32_to_lonlat}
    if srid != to and (srid, to) not in pairs:
        raise ValueError(f"no conversion from {srid} to {to}")
    return (x, y) if srid == to else pairs[srid, to](x, y, m)


def align_crs(df: DataFrame, srid: int | None, to: int | None, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The points of ``df`` in the coordinate system ``to`` (see ``converted``)."""
    x, y = converted(srid, to, F.col(columns[0]), F.col(columns[1]))
    return df if srid == to else df.withColumns({columns[0]: x, columns[1]: y})
