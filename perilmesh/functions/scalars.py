"""Scalar rules as Column expressions; every one stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def case_of(column, values: dict, other=None) -> Column:
    """The value for the column's key; ``other`` for keys that aren't listed."""
    out = None
    for key, value in values.items():
        out = F.when(_c(column) == key, F.lit(value)) if out is None else out.when(_c(column) == key, F.lit(value))
    return out.otherwise(F.lit(other))


def money_sum(column, digits: int = 4) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(_c(column).cast(f"decimal(18,{digits})")).cast("double")


def half_up(column) -> Column:
    """Rounding to integers, halves toward plus infinity."""
    return F.floor(_c(column) + 0.5)


def interpolate(x, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points``, clamped at both ends."""
    x = _c(x)
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * (float(y1 - y0) / float(x1 - x0)))
    return out.otherwise(F.lit(float(points[-1][1])))


def haversine(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    """Great-circle distance in units of ``radius``."""
    a = F.pow(F.sin((F.radians(_c(lat2)) - F.radians(_c(lat1))) / 2), 2) + F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def drive_hours(lat1, lon1, lat2, lon2, mph: float = 50.0) -> Column:
    return haversine(lat1, lon1, lat2, lon2, 3958.7613) / mph


def surge_depth(distance_km, wind_mph, elevation_m) -> Column:
    depth = 4 * F.pow(_c(wind_mph) / 140, 2) * F.exp(-_c(distance_km) / 30) - 0.25 * _c(elevation_m)
    return F.greatest(F.lit(0.0), F.bround(depth, 3))


def wind_at_property(peak, distance_km) -> Column:
    return _c(peak) * F.exp(-_c(distance_km) / 80.5)


def wind_damage(wind_mph, build_type) -> Column:
    curves = {b: interpolate(wind_mph, p) for b, p in X.WIND_CURVE.items()}
    return F.when(_c(build_type) == "masonry", curves["masonry"]).when(_c(build_type) == "manufactured", curves["manufactured"]).otherwise(curves["wood_frame"])


def surge_damage(depth_m, elevation_m) -> Column:
    return interpolate(F.greatest(_c(depth_m) - _c(elevation_m), F.lit(0.0)), X.SURGE_CURVE)


def damage_multiplier(peril, level, number) -> Column:
    """Multiplier of a peril's severity: a number for earthquake (Mw) and hail (mm), else a level or tier."""
    tier = case_of(level, X.INTENSITY, 1.0)
    out = F.when((_c(peril) == "earthquake") & _c(number).isNotNull(), F.when(_c(number) < 5.53, 0.0).otherwise(1 + 0.45 * (_c(number) - 7)))
    out = out.when((_c(peril) == "hail") & _c(number).isNotNull(), F.greatest(F.lit(0.0), 0.04 * (_c(number) - 20)))
    for name, levels in X.LEVELS.items():
        out = out.when(_c(peril) == name, F.coalesce(case_of(level, levels), tier))
    return out.otherwise(tier)


def damage_ratio(peril, build_type, multiplier) -> Column:
    """Share of insured value lost, 0 to 1; 0 for a build type that isn't known."""
    base = None
    for build, row in X.DAMAGE.items():
        value = case_of(peril, row, 0.0)
        base = F.when(_c(build_type) == build, value) if base is None else base.when(_c(build_type) == build, value)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base.otherwise(0.0) * _c(multiplier)))


def legacy_tier(multiplier) -> Column:
    return F.when(_c(multiplier) < 0.775, "moderate").when(_c(multiplier) < 1.225, "severe").otherwise("catastrophic")


def peril_decay(peril, distance_km, width_km) -> Column:
    d, w = _c(distance_km), _c(width_km)
    return (
        F.when((_c(peril) == "tornado") & (w > 0), F.exp(-d / (w / 2)))
        .when((_c(peril) == "hail") & (w > 0), F.when(d <= w, 1.0).otherwise(0.6 * F.exp(-(d - w) / w)))
        .when(_c(peril) == "earthquake", F.greatest(F.lit(0.0), 1 - d / F.greatest(F.lit(1.0), w)))
        .otherwise(1.0)
    )


def mmi_radius_km(magnitude, mmi) -> Column:
    return F.greatest(F.lit(0.0), (1.68 * _c(magnitude) - 3.29 - _c(mmi)) / 0.0206)


def in_ring(x, y, ring, most_points: int | None = None) -> Column:
    """Whether the point is inside a closed ring, an array of structs (x, y): parity of crossings.

    With ``most_points``, a bound on the ring's size, the edges are written out one by one, which compiles to plain code.
    """
    x, y, ring = _c(x), _c(y), _c(ring)

    def crossed(a, b):
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + 1e-15) + a["x"])

    if most_points is None:
        inside = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(False), lambda acc, i: acc != crossed(F.element_at(ring, i), F.element_at(ring, i + 1)))
    else:
        edges = (F.coalesce(crossed(F.get(ring, F.lit(i)), F.get(ring, F.lit(i + 1))), F.lit(False)).cast("int") for i in range(most_points - 1))
        inside = sum(edges, F.lit(0)) % 2 == 1
    return F.when(F.size(ring) >= 4, inside).otherwise(False)


def ring_distance(x, y, ring) -> Column:
    """Plane distance of a point to the nearest edge of a closed ring, in the ring's units."""
    x, y, ring = _c(x), _c(y), _c(ring)

    def to_edge(i):
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(ring) - 1), to_edge))


def reprice_factor(change, elasticity=X.ELASTICITY) -> Column:
    return (1 + _c(change)) * (1 - elasticity * F.greatest(_c(change), F.lit(0.0)))


def retained_xs(loss, attachment, exhaustion) -> Column:
    return F.least(_c(loss), _c(attachment)) + F.greatest(F.lit(0.0), _c(loss) - _c(exhaustion))


def ceded_xs(loss, attachment, exhaustion) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(loss), _c(exhaustion)) - _c(attachment))


def loss_p50(tiv, zone, build_type, elevation) -> Column:
    lift = F.greatest(F.lit(0.7), 1 - 0.05 * F.greatest(F.lit(0.0), _c(elevation)))
    return _c(tiv) * X.BASE_RATE * case_of(zone, X.ZONE_SEVERITY) * case_of(build_type, X.BUILD_VULNERABILITY) * lift


def damage_dollars(text) -> Column:
    """Dollars of '12.5K', '3M', '1B' or a plain number; null for blank or anything else."""
    text = F.upper(F.trim(_c(text)))
    factor = case_of(F.substring(text, -1, 1), {"K": 1e3, "M": 1e6, "B": 1e9}, 1.0)
    return F.regexp_replace(text, "[KMB]$", "").try_cast("double") * factor


def severity_tier(build_type="build_type", zone="flood_zone") -> Column:
    return F.when((_c(build_type) == "manufactured") | (_c(zone) == "VE"), "high").when(_c(zone) == "AE", "medium").otherwise("low")


def alert_category(event) -> Column:
    """The first category whose words are in an alert's name."""
    e = F.lower(_c(event))
    out = F.when(e.contains("tornado"), "tornado").when(e.contains("storm surge"), "storm_surge").when(e.contains("severe thunderstorm"), "severe_thunderstorm").when(e.contains("hurricane"), "hurricane")
    return out.when(e.contains("tropical storm") | e.contains("tropical depression"), "tropical_storm").when(e.contains("flood"), "flood").otherwise("other")


def storm_bucket(mph) -> Column:
    out = None
    for (low, name), (high, _) in zip(X.STORM_BUCKETS, [*X.STORM_BUCKETS[1:], (1e9, "")]):
        within = (_c(mph) >= low) & (_c(mph) < high)
        out = F.when(within, name) if out is None else out.when(within, name)
    return out


def territory(zip3, state) -> Column:
    out = None
    for s, coastal in X.COASTAL.items():
        near, far = X.BUCKET_NAMES[s]
        value = F.when(_c(zip3).isin(*coastal), near).otherwise(far)
        out = F.when(_c(state) == s, value) if out is None else out.when(_c(state) == s, value)
    return out.otherwise("__default__")


def quadkey(lat, lon, zoom: int = 9) -> Column:
    """Tile key of a point, one digit per level."""
    n = float(1 << zoom)
    x = F.least(F.lit(n - 1), F.greatest(F.lit(0.0), F.floor((_c(lon) + 180) / 360 * n))).cast("int")
    s = F.sin(F.radians(_c(lat)))
    y = F.least(F.lit(n - 1), F.greatest(F.lit(0.0), F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * n))).cast("int")
    digits = [(F.shiftright(x, z).bitwiseAND(F.lit(1)) + F.lit(2) * F.shiftright(y, z).bitwiseAND(F.lit(1))).cast("string") for z in range(zoom - 1, -1, -1)]
    return F.concat(*digits)


def lcg(key, rounds: int = 3) -> Column:
    """A uniform number in [0, 1) from an integer key, equal in any engine."""
    x = _c(key).cast("long")
    for _ in range(rounds):
        x = (x * 1103515245 + 12345) % 2147483648
    return x / F.lit(2147483648.0)


def normal(key, rounds: int = 3) -> Column:
    """A standard normal by Box and Muller from two uniform numbers of a key, to 9 digits."""
    key = _c(key).cast("long")
    u, v = lcg(key * 2 + 1, rounds), lcg(key * 2 + 2, rounds)
    return F.round(F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-9)))) * F.cos(2 * 3.141592653589793 * v), 9)
