"""Great circles on the sphere, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = 32) -> Column:
    """array<struct<step, lat, lon>> of steps + 1 points from the first to the second place, in degrees.

    Equal or opposite ends, where no single circle exists, give points on the straight line in latitude and longitude.
    """
    p1, l1, p2, l2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    half = F.sin((p2 - p1) / 2) * F.sin((p2 - p1) / 2) + F.cos(p1) * F.cos(p2) * F.sin((l2 - l1) / 2) * F.sin((l2 - l1) / 2)
    arc = F.lit(2.0) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    sine = F.sin(arc)

    def at(k: Column) -> Column:
        f = k / F.lit(float(steps))
        a, b = F.sin((1 - f) * arc) / sine, F.sin(f * arc) / sine
        x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
        y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
        z = a * F.sin(p1) + b * F.sin(p2)
        plain = sine < 1e-12
        lat = F.when(plain, lat1 + (lat2 - lat1) * f).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
        lon = F.when(plain, lon1 + (lon2 - lon1) * f).otherwise(F.degrees(F.atan2(y, x)))
        return F.struct(k.cast("int").alias("step"), lat.alias("lat"), lon.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value said, and so computed, once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _unit(point: Column) -> Column:
    """The unit vector of [lon, lat]."""
    lon, lat = F.radians(point[0]), F.radians(point[1])
    return _vector(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def _added(vectors: Column) -> Column:
    return F.aggregate(vectors, _vector(*[F.lit(0.0)] * 3), lambda a, v: _vector(*(a[c] + v[c] for c in "xyz")))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _times(v: Column, k: Column) -> Column:
    return _vector(*(v[c] * k for c in "xyz"))


def _edge(a: Column, b: Column) -> Column:
    """The unit normal of the great circle from a to b, times the angle between them; nothing for equal or opposite ends."""
    normal = _vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])
    length = lambda n: F.sqrt(_dot(n, n))
    return _let(normal, lambda n: _times(n, F.when(length(n) > 1e-15, F.atan2(length(n), _dot(a, b)) / length(n)).otherwise(0.0)))


def _ring(points: Column) -> Column:
    """The integral of place over a ring's inside, as a vector: half the sum of its edges; it points to the inside, the smaller side, whichever way round the ring goes."""

    def inside(units: Column) -> Column:
        ends = F.transform(units, lambda u, i: F.struct(u.alias("a"), F.get(units, (i + 1) % F.size(units)).alias("b")))
        whole = _added(F.transform(ends, lambda e: _edge(e["a"], e["b"])))
        return _let(whole, lambda w: _times(w, F.when(_dot(w, _added(units)) < 0, -0.5).otherwise(0.5)))

    return _let(F.transform(points, _unit), inside)


def polygon_centroid(polygons: Column) -> Column:
    """struct<lat, lon> of the middle of area on the sphere of polygons, array<array<array<array<double>>>>: polygon, ring, point, [lon, lat].

    A polygon's first ring is its outer one, the others are holes. A ring goes along great circles, over the date line or a pole as well, in either direction, and may or may not repeat its first
    point; it is taken to hold less than half of the sphere. Polygons without area (points, lines) give the middle of their points; no points, or points that cancel out: null.
    """
    signed = lambda r, i: _times(_ring(r), F.when(i == 0, 1.0).otherwise(-1.0))
    area = _added(F.flatten(F.transform(polygons, lambda p: F.transform(p, signed))))
    points = _added(F.transform(F.flatten(F.flatten(polygons)), _unit))
    some = lambda v: _dot(v, v) > 1e-24
    middle = _let(F.struct(area.alias("area"), points.alias("points")), lambda m: F.when(some(m["area"]), m["area"]).when(some(m["points"]), m["points"]))
    place = lambda v: F.struct(F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lon"))
    return _let(middle, lambda v: F.when(v.isNotNull(), place(v)))


def opacity(score: Column | str) -> Column:
    """How solid a country is drawn: 0.18 + 0.78 * (score / 100) ** 0.85."""
    score = F.col(score) if isinstance(score, str) else score
    return F.lit(0.18) + F.pow(score / 100.0, F.lit(0.85)) * F.lit(0.78)
