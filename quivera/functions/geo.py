"""Geoshapes as structs, and spatial relations as column expressions.

A shape column is ``struct<type:string, coords:array<struct<lat:double, lon:double>>, radius_km:double>``. Points,
circles, boxes (south-west and north-east corner), lines, polygons and the multi types are built; relations
are exact for points, circles and boxes, and by vertices and edges in the plane for lines and polygons.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_KM = 6371.0087714
SHAPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("coords", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))),
        T.StructField("radius_km", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Geoshape:
    """A constant shape. ``coords``: (lat, lon) pairs; ``parts``: the shapes of a multi type."""

    type: str
    coords: tuple[tuple[float, float], ...]
    radius_km: float = 0.0
    parts: tuple["Geoshape", ...] = ()

    @staticmethod
    def point(lat: float, lon: float) -> "Geoshape":
        return Geoshape("Point", ((lat, lon),))

    @staticmethod
    def circle(lat: float, lon: float, radius_km: float) -> "Geoshape":
        if radius_km <= 0:
            raise ValueError("a circle needs a positive radius")
        return Geoshape("Circle", ((lat, lon),), radius_km)

    @staticmethod
    def box(sw_lat: float, sw_lon: float, ne_lat: float, ne_lon: float) -> "Geoshape":
        return Geoshape("Box", ((sw_lat, sw_lon), (ne_lat, ne_lon)))

    @staticmethod
    def line(*coords: tuple[float, float]) -> "Geoshape":
        return Geoshape("Line", tuple(coords))

    @staticmethod
    def polygon(*coords: tuple[float, float]) -> "Geoshape":
        ring = tuple(coords)
        return Geoshape("Polygon", ring if ring[0] == ring[-1] else (*ring, ring[0]))

    @staticmethod
    def multi(kind: str, *parts: "Geoshape") -> "Geoshape":
        return Geoshape(kind, tuple(c for p in parts for c in p.coords), 0.0, parts)

    @staticmethod
    def from_wkt(text: str) -> "Geoshape":
        """POINT, LINESTRING, POLYGON, BUFFER(POINT, km) and ENVELOPE(w, e, n, s); x is the longitude."""
        pairs = lambda s: tuple((float(y), float(x)) for x, y in (p.split() for p in re.split(r"\s*,\s*", s.strip())))
        kind, body = re.fullmatch(r"\s*([A-Za-z]+)\s*\((.*)\)\s*", text, re.S).groups()
        kind = kind.upper()
        if kind == "POINT":
            return Geoshape("Point", pairs(body))
        if kind == "LINESTRING":
            return Geoshape.line(*pairs(body))
        if kind == "POLYGON":
            return Geoshape.polygon(*pairs(re.match(r"\s*\((.*?)\)", body, re.S)[1]))
        if kind == "MULTIPOINT":
            return Geoshape.multi("MultiPoint", *(Geoshape("Point", (c,)) for c in pairs(re.sub(r"[()]", "", body))))
        if kind == "BUFFER":
            inner, radius = body.rsplit(",", 1)
            return Geoshape.circle(*Geoshape.from_wkt(inner).coords[0], float(radius))
        if kind == "ENVELOPE":
            west, east, north, south = map(float, body.split(","))
            return Geoshape.box(south, west, north, east)
        raise ValueError(f"no shape: {kind}")

    def column(self) -> Column:
        coords = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in self.coords])
        return F.struct(F.lit(self.type).alias("type"), coords.alias("coords"), F.lit(float(self.radius_km)).alias("radius_km"))


def point_column(lat: Column, lon: Column) -> Column:
    """A shape column of points; null where a coordinate is."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))).alias("coords"), F.lit(0.0).alias("radius_km"))
    return F.when(lat.isNotNull() & lon.isNotNull(), shape)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _in_ring(lat: Column, lon: Column, ring: tuple[tuple[float, float], ...]) -> Column:
    """Ray casting: an odd number of edges to the east."""
    crossings = F.lit(0)
    for (lat1, lon1), (lat2, lon2) in zip(ring, ring[1:]):
        if lat1 != lat2:
            at = (lat - lat1) / (lat2 - lat1) * (lon2 - lon1) + lon1
            crosses = ((lat >= min(lat1, lat2)) & (lat < max(lat1, lat2)) & (lon < at)).cast("int")
            crossings = crossings + crosses
    return crossings % 2 == 1


def _point_in(lat: Column, lon: Column, shape: Geoshape) -> Column:
    if shape.parts:
        return reduce(lambda a, b: a | b, (_point_in(lat, lon, p) for p in shape.parts))
    if shape.type == "Circle":
        (clat, clon), *_ = shape.coords
        return distance_km(lat, lon, F.lit(clat), F.lit(clon)) <= shape.radius_km
    if shape.type == "Box":
        (south, west), (north, east) = shape.coords
        across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
        return (lat >= south) & (lat <= north) & across
    if shape.type == "Polygon":
        return _in_ring(lat, lon, shape.coords)
    if shape.type == "Line":
        on = F.lit(False)
        for (a1, b1), (a2, b2) in zip(shape.coords, shape.coords[1:]):
            cross = F.abs((lat - a1) * (b2 - b1) - (lon - b1) * (a2 - a1))
            on = on | ((cross < 1e-12) & (lat >= min(a1, a2)) & (lat <= max(a1, a2)) & (lon >= min(b1, b2)) & (lon <= max(b1, b2)))
        return on
    return (lat == shape.coords[0][0]) & (lon == shape.coords[0][1])


def _corners(value: Column) -> Column:
    """The vertices of a shape column; a box has four."""
    c = value["coords"]
    corner = lambda a, b: F.struct(c[a]["lat"].alias("lat"), c[b]["lon"].alias("lon"))
    return F.when(value["type"] == "Box", F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).otherwise(c)


def _edges(shape: Geoshape) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """The edges of a constant line, polygon or box (one that does not cross the date line)."""
    ring = list(shape.coords)
    if shape.type == "Box":
        (s, w), (n, e) = shape.coords
        ring = [(s, w), (s, e), (n, e), (n, w), (s, w)]
    return list(zip(ring, ring[1:])) if shape.type in ("Line", "Polygon", "Box") else []


def _crossings(value: Column, shape: Geoshape, touching: bool) -> Column:
    """Whether an edge of the value crosses one of the constant shape; ``touching``: or meets it."""
    c = value["coords"]
    corner = lambda a, b: F.struct(c[a]["lat"].alias("lat"), c[b]["lon"].alias("lon"))
    ring = F.when(value["type"] == "Box", F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))).when(value["type"].isin("Line", "Polygon"), c)
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def turn(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon):
        return (b_lat - a_lat) * (p_lon - a_lon) - (b_lon - a_lon) * (p_lat - a_lat)

    def meets(e: Column) -> Column:
        found = F.lit(False)
        for (a1, b1), (a2, b2) in _edges(shape):
            (p, q), (s, t) = (e["p"], e["q"]), ((F.lit(a1), F.lit(b1)), (F.lit(a2), F.lit(b2)))
            d1, d2 = turn(*s, *t, p["lat"], p["lon"]), turn(*s, *t, q["lat"], q["lon"])
            d3, d4 = turn(p["lat"], p["lon"], q["lat"], q["lon"], *s), turn(p["lat"], p["lon"], q["lat"], q["lon"], *t)
            if touching:  # on either side or on the line, and the boxes of the edges overlap
                over = (F.least(p["lat"], q["lat"]) <= max(a1, a2)) & (F.greatest(p["lat"], q["lat"]) >= min(a1, a2)) & (F.least(p["lon"], q["lon"]) <= max(b1, b2)) & (F.greatest(p["lon"], q["lon"]) >= min(b1, b2))
                found = found | ((d1 * d2 <= 0) & (d3 * d4 <= 0) & over)
            else:
                found = found | ((d1 * d2 < 0) & (d3 * d4 < 0))
        return found

    return F.coalesce(F.exists(edges, meets), F.lit(False)) if _edges(shape) else F.lit(False)


def within(value: Column, shape: Geoshape) -> Column:
    """The value lies inside the constant shape: its corners do, and no edge of it leaves a polygon between them."""
    inside = F.forall(_corners(value), lambda c: _point_in(c["lat"], c["lon"], shape))
    if shape.type == "Polygon":
        inside = inside & ~_crossings(value, shape, False)
    if shape.type == "Circle":
        lat, lon = shape.coords[0]
        centre = value["coords"][0]
        round_ = distance_km(centre["lat"], centre["lon"], F.lit(lat), F.lit(lon)) + value["radius_km"] <= shape.radius_km
        return F.when(value["type"] == "Circle", round_).otherwise(inside)
    if shape.type == "Box":
        (south, west), (north, east) = shape.coords
        centre, reach = value["coords"][0], F.degrees(value["radius_km"] / EARTH_RADIUS_KM)
        wide = reach / F.cos(F.radians(centre["lat"]))
        round_ = (centre["lat"] - reach >= south) & (centre["lat"] + reach <= north) & (centre["lon"] - wide >= west) & (centre["lon"] + wide <= east)
        return F.when(value["type"] == "Circle", round_).otherwise(inside)
    return inside


def contains(value: Column, shape: Geoshape) -> Column:
    """The value covers all vertices of the constant shape (and its whole circle), and no edge of it leaves a polygon."""
    c, kind = value["coords"], value["type"]
    points = shape.coords
    if shape.type == "Box":
        (s, w), (n, e) = shape.coords
        points = ((s, w), (s, e), (n, w), (n, e))
    in_circle = [distance_km(c[0]["lat"], c[0]["lon"], F.lit(a), F.lit(b)) + shape.radius_km <= value["radius_km"] for a, b in points]
    in_box = [F.lit(a).between(c[0]["lat"], c[1]["lat"]) & F.lit(b).between(c[0]["lon"], c[1]["lon"]) for a, b in points]
    same = [(c[0]["lat"] == a) & (c[0]["lon"] == b) for a, b in points]

    def in_polygon(a: float, b: float) -> Column:
        edges = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        crossing = lambda e: (
            (F.lit(a) >= F.least(e["p"]["lat"], e["q"]["lat"])) & (F.lit(a) < F.greatest(e["p"]["lat"], e["q"]["lat"]))
            & (F.lit(b) < (F.lit(a) - e["p"]["lat"]) / (e["q"]["lat"] - e["p"]["lat"]) * (e["q"]["lon"] - e["p"]["lon"]) + e["p"]["lon"])
        )
        return F.size(F.filter(edges, crossing)) % 2 == 1

    all_of = lambda conditions: reduce(lambda a, b: a & b, conditions)
    return (
        F.when(kind == "Circle", all_of(in_circle))
        .when(kind == "Box", all_of(in_box))
        .when(kind == "Polygon", all_of([in_polygon(a, b) for a, b in points]) & ~_crossings(value, shape, False))
        .otherwise(all_of(same) if shape.radius_km == 0 else F.lit(False))
    )


def intersects(value: Column, shape: Geoshape) -> Column:
    """The shapes share a point."""
    c, kind = value["coords"], value["type"]
    touches = F.exists(_corners(value), lambda p: _point_in(p["lat"], p["lon"], shape)) | F.coalesce(contains(value, Geoshape("Point", shape.coords[:1])), F.lit(False))
    touches = touches | _crossings(value, shape, True)
    if shape.type in ("Circle", "Point"):
        lat, lon = shape.coords[0]
        near = lambda a, b: distance_km(a, b, F.lit(lat), F.lit(lon))
        both_round = near(c[0]["lat"], c[0]["lon"]) <= value["radius_km"] + shape.radius_km
        clamp_lat = F.least(F.greatest(F.lit(lat), c[0]["lat"]), c[1]["lat"])
        clamp_lon = F.least(F.greatest(F.lit(lon), c[0]["lon"]), c[1]["lon"])
        return F.when(kind.isin("Circle", "Point"), both_round).when(kind == "Box", near(clamp_lat, clamp_lon) <= shape.radius_km).otherwise(touches)
    if shape.type == "Box":
        (south, west), (north, east) = shape.coords
        centre = c[0]
        clamped = distance_km(centre["lat"], centre["lon"], F.least(F.greatest(centre["lat"], F.lit(south)), F.lit(north)), F.least(F.greatest(centre["lon"], F.lit(west)), F.lit(east)))
        overlap = (c[0]["lat"] <= north) & (c[1]["lat"] >= south) & (c[0]["lon"] <= east) & (c[1]["lon"] >= west)
        return F.when(kind == "Circle", clamped <= value["radius_km"]).when(kind == "Box", overlap).otherwise(touches)
    return touches
