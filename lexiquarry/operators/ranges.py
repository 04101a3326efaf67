"""Predicates over numbers, ranges, addresses and places."""

from __future__ import annotations

import ipaddress
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371008.7714


def between(x: Column, low=None, high=None, low_in: bool = True, high_in: bool = True) -> Column:
    out = x.isNotNull()
    if low is not None:
        out = out & (x >= low if low_in else x > low)
    if high is not None:
        out = out & (x <= high if high_in else x < high)
    return out


def any_between(values: Column, low=None, high=None) -> Column:
    """Any value of an array is in the range."""
    return F.exists(values, lambda x: between(x, low, high))


def in_set(x: Column, values: list) -> Column:
    return x.isin(values)


# stored ranges: struct<min array, max array> against a query range of as many dimensions


def _dims(f: Column, low: list, high: list, test: Callable[[Column, Column, object, object], Column]) -> Column:
    out = F.lit(True)
    for i, (a, b) in enumerate(zip(low, high)):
        out = out & test(f["min"][i], f["max"][i], a, b)
    return out


def range_intersects(f: Column, low: list, high: list) -> Column:
    return _dims(f, low, high, lambda a, b, x, y: (a <= y) & (b >= x))


def range_contains(f: Column, low: list, high: list) -> Column:
    """The stored range holds the query's."""
    return _dims(f, low, high, lambda a, b, x, y: (a <= x) & (b >= y))


def range_within(f: Column, low: list, high: list) -> Column:
    """The stored range lies inside the query's."""
    return _dims(f, low, high, lambda a, b, x, y: (a >= x) & (b <= y))


def range_crosses(f: Column, low: list, high: list) -> Column:
    return range_intersects(f, low, high) & ~range_within(f, low, high)


# addresses as 16 bytes; IPv4 as mapped IPv6


def address(text: str) -> bytes:
    ip = ipaddress.ip_address(text)
    return ip.packed if ip.version == 6 else b"\0" * 10 + b"\xff\xff" + ip.packed


def ipv4_column(text: Column) -> Column:
    """The 16 bytes of a dotted address, in SQL functions."""
    parts = F.split(text, r"\.")
    digits = F.concat(*[F.lpad(F.hex(parts[i].cast("int")), 2, "0") for i in range(4)])
    return F.unhex(F.concat(F.lit("00" * 10 + "FFFF"), digits))


def ip_between(x: Column, low: str, high: str) -> Column:
    return (x >= F.lit(address(low))) & (x <= F.lit(address(high)))


def ip_prefix(x: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    return ip_between(x, str(net[0]), str(net[-1]))


# places: degrees


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """A box; one whose west lies east of its east crosses the date line."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def geo_within(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """Within a radius: a box of latitudes first, which reaches the scan, then the distance."""
    reach = math.degrees(metres / EARTH_RADIUS)
    return lat.between(lat0 - reach, lat0 + reach) & (haversine(lat, lon, lat0, lon0) <= metres)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]], holes: list[list[tuple[float, float]]] = ()) -> Column:
    """Even-odd rule over the ring's edges, as an expression; points in a hole are out."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        crossings = crossings + hit.cast("int")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    out = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)
    for h in holes:
        out = out & ~in_polygon(x, y, list(h))
    return out


def wkt_polygon(text: str) -> list[list[tuple[float, float]]]:
    """Rings of POLYGON((x y, ...), (...))."""
    body = text.strip()
    if not body.upper().startswith("POLYGON"):
        raise ValueError("not a polygon")
    rings = body[body.index("((") + 2 : body.rindex("))")].split("),")
    return [[tuple(map(float, p.split())) for p in r.strip().lstrip("(").split(",")][:-1] for r in rings]
