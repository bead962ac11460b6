"""Scalar geometry as Catalyst expressions.

Everything here maps columns to columns and stays inside whole-stage code
generation.  Angles are degrees unless a name says otherwise, lengths are
kilometres, displacements millimetres.  Missing values are NULL throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.195
CROP_KM_PER_DEGREE_LAT, CROP_KM_PER_DEGREE_LON = 110.574, 111.320
SECONDS_PER_YEAR = 365.2425 * 86400


def finite(x: Column) -> Column:
    """``x`` with NaN and infinities turned into NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# -- viewing geometry ---------------------------------------------------------


def look_vector(heading: Column, incidence: Column) -> tuple[Column, Column, Column]:
    """Unit vector from ground to sensor as (east, north, up)."""
    h, i = F.radians(heading), F.radians(incidence)
    return -F.sin(i) * F.cos(h), F.sin(i) * F.sin(h), F.cos(i)


def heading_incidence(east: Column, north: Column, up: Column) -> tuple[Column, Column]:
    """Inverse of ``look_vector``; NULL for a zero vector."""
    norm = F.sqrt(east * east + north * north + up * up)
    incidence = F.degrees(F.acos(clip(up / F.nullif(norm, F.lit(0.0)), -1.0, 1.0)))
    return F.when(norm > 0, F.degrees(F.atan2(north, -east))), incidence


def normalize_look(east: Column, north: Column, up: Column, least: float = 0.5) -> tuple[Column, Column, Column]:
    """Components divided by the norm where the norm exceeds ``least``, else NULL."""
    norm = F.sqrt(east * east + north * north + up * up)
    return tuple(F.when(norm > least, c / norm) for c in (east, north, up))


def project_enu(e: Column, n: Column, u: Column, look: tuple[Column, Column, Column]) -> Column:
    """Displacement along the normalised look vector."""
    norm = F.sqrt(look[0] * look[0] + look[1] * look[1] + look[2] * look[2])
    return (e * look[0] + n * look[1] + u * look[2]) / F.nullif(norm, F.lit(0.0))


def angle_between(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Angle of two vectors in degrees; NULL if one of them is zero."""
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.degrees(F.acos(clip(dot(a, b) / F.nullif(length, F.lit(0.0)), -1.0, 1.0)))


def project_enu_sigma(
    se: Column,
    sn: Column,
    su: Column,
    look: tuple[Column, Column, Column],
    r_en: Column | float = 0.0,
    r_eu: Column | float = 0.0,
    r_nu: Column | float = 0.0,
) -> Column:
    """Standard deviation along the look vector, with clipped correlations."""
    norm = F.nullif(F.sqrt(look[0] * look[0] + look[1] * look[1] + look[2] * look[2]), F.lit(0.0))
    a, b, c = (x / norm for x in look)
    r = [clip(x if isinstance(x, Column) else F.lit(float(x)), -1.0, 1.0) for x in (r_en, r_eu, r_nu)]
    variance = (a * se) * (a * se) + (b * sn) * (b * sn) + (c * su) * (c * su)
    variance = variance + 2 * (a * b * r[0] * se * sn + a * c * r[1] * se * su + b * c * r[2] * sn * su)
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


# -- positions ----------------------------------------------------------------


def coordinate_key(lat: Column, lon: Column) -> Column:
    """Stable integer key of a position rounded half to even at 1e-6 degrees."""
    part = lambda x: F.rint(x * 1e6).cast("bigint")
    return part(lat) * F.lit(1_000_000_000).cast("bigint") + part(lon)


def distance_km(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Local equirectangular distance."""
    east, north = lonlat_to_xy(lon, lat, lon0, lat0)
    return F.hypot(east, north)


def lonlat_to_xy(lon: Column, lat: Column, lon0: Column | float, lat0: Column | float) -> tuple[Column, Column]:
    lon0, lat0 = _col(lon0), _col(lat0)
    return (lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * KM_PER_DEGREE


def xy_to_lonlat(x: Column, y: Column, lon0: Column | float, lat0: Column | float) -> tuple[Column, Column]:
    lon0, lat0 = _col(lon0), _col(lat0)
    return lon0 + x / (KM_PER_DEGREE * F.cos(F.radians(lat0))), lat0 + y / KM_PER_DEGREE


def haversine_km(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    a, b = F.radians(lat), F.radians(_col(lat0))
    half_lat, half_lon = (a - b) / 2, F.radians(lon - _col(lon0)) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(clip(h, 0.0, 1.0)))


def crop_box(lat0: float, lon0: float, radius_km: float, padding_km: float = 1.5) -> tuple[float, float, float, float]:
    """(lat_min, lat_max, lon_min, lon_max) around a circle; literals, so scans can prune."""
    reach = radius_km + padding_km
    dlat = reach / CROP_KM_PER_DEGREE_LAT
    dlon = reach / (CROP_KM_PER_DEGREE_LON * math.cos(math.radians(lat0)))
    return lat0 - dlat, lat0 + dlat, lon0 - dlon, lon0 + dlon


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# Transverse Mercator by the Krueger series in the third flattening (WGS84).
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6378.137 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
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
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_K0, _FALSE_EAST = 0.9996, 500.0


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _forward(v: Column) -> Column:
    x, y = v["y"], v["x"]
    for j, a in enumerate(_ALPHA, 1):
        y = y + a * F.sin(2 * j * v["x"]) * F.cosh(2 * j * v["y"])
        x = x + a * F.cos(2 * j * v["x"]) * F.sinh(2 * j * v["y"])
    return _pair(_FALSE_EAST + _K0 * _A * x, _K0 * _A * y)


def to_utm_km(lon: Column, lat: Column, zone: int = 11) -> tuple[Column, Column]:
    """Northern-hemisphere UTM easting and northing in kilometres."""
    lam = F.radians(lon - (zone * 6 - 183))
    t = let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - _E * F.atanh(_E * s)))
    gauss = let(t, lambda t: _pair(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))))
    out = let(gauss, _forward)
    return out["x"], out["y"]


def _backward(v: Column) -> Column:
    x, y = v["y"], v["x"]
    for j, b in enumerate(_BETA, 1):
        y = y - b * F.sin(2 * j * v["x"]) * F.cosh(2 * j * v["y"])
        x = x - b * F.cos(2 * j * v["x"]) * F.sinh(2 * j * v["y"])
    return _pair(x, y)


def _newton(tau: Column):
    """One step from conformal to geodetic latitude (tangents)."""

    def step(t: Column) -> Column:
        root = F.sqrt(1 + t * t)
        near = let(F.sinh(_E * F.atanh(_E * t / root)), lambda s: t * F.sqrt(1 + s * s) - s * root)
        return let(near, lambda n: t + (tau - n) / F.sqrt(1 + n * n) * (1 + (1 - _E2) * t * t) / ((1 - _E2) * root))

    return step


def from_utm_km(east: Column, north: Column, zone: int = 11) -> tuple[Column, Column]:
    """Longitude and latitude of northern-hemisphere UTM kilometres."""
    gauss = let(_pair(north / (_K0 * _A), (east - _FALSE_EAST) / (_K0 * _A)), _backward)

    def finish(g: Column) -> Column:
        tau = F.sin(g["y"]) / F.sqrt(F.pow(F.sinh(g["x"]), 2) + F.pow(F.cos(g["y"]), 2))
        lon = F.degrees(F.atan2(F.sinh(g["x"]), F.cos(g["y"]))) + (zone * 6 - 183)
        settle = lambda tau: let(let(let(tau, _newton(tau)), _newton(tau)), _newton(tau))
        return _pair(lon, F.degrees(F.atan(let(tau, settle))))

    out = let(gauss, finish)
    return out["x"], out["y"]


# -- planar geometry ----------------------------------------------------------

Point = tuple[Column, Column]


def cross_2d(a: Point, b: Point) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def orientation(a: Point, b: Point, c: Point) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def point_on_segment(a: Point, b: Point, p: Point, eps: float = 1e-10) -> Column:
    """Bounding-box containment; meant for points known to be collinear."""
    inside = [
        p[k].between(F.least(a[k], b[k]) - eps, F.greatest(a[k], b[k]) + eps) for k in (0, 1)
    ]
    return inside[0] & inside[1]


def segments_intersect(a: Point, b: Point, c: Point, d: Point, eps: float = 1e-10) -> Column:
    """Closed intersection: proper crossings, touching ends and collinear overlap."""
    o = [orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)]
    proper = ((o[0] > 0) != (o[1] > 0)) & ((o[2] > 0) != (o[3] > 0))
    for value, ends, p in ((o[0], (a, b), c), (o[1], (a, b), d), (o[2], (c, d), a), (o[3], (c, d), b)):
        proper = proper | ((F.abs(value) <= eps) & point_on_segment(*ends, p))
    return proper


def point_segment_distance(p: Point, a: Point, b: Point) -> Column:
    vx, vy = b[0] - a[0], b[1] - a[1]
    length = vx * vx + vy * vy
    t = F.when(length > 0, clip(((p[0] - a[0]) * vx + (p[1] - a[1]) * vy) / F.nullif(length, F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)
    return F.hypot(p[0] - (a[0] + t * vx), p[1] - (a[1] + t * vy))


def segment_distance(a: Point, b: Point, c: Point, d: Point) -> Column:
    apart = F.least(
        point_segment_distance(a, c, d), point_segment_distance(b, c, d), point_segment_distance(c, a, b), point_segment_distance(d, a, b)
    )
    return F.when(segments_intersect(a, b, c, d), 0.0).otherwise(apart)


def point_in_triangle(p: Point, t: tuple[Point, Point, Point], eps: float = 1e-10) -> Column:
    o = [orientation(t[i], t[(i + 1) % 3], p) for i in range(3)]
    return ((o[0] >= -eps) & (o[1] >= -eps) & (o[2] >= -eps)) | ((o[0] <= eps) & (o[1] <= eps) & (o[2] <= eps))


def segment_triangle_distance(a: Point, b: Point, t: tuple[Point, Point, Point]) -> Column:
    edges = F.least(*[segment_distance(a, b, t[i], t[(i + 1) % 3]) for i in range(3)])
    return F.when(point_in_triangle(a, t) | point_in_triangle(b, t), 0.0).otherwise(edges)


def triangle_metrics(t: tuple[Point, Point, Point]) -> dict[str, Column]:
    """area, longest and shortest edge, smallest angle, condition of the edge matrix."""
    (ax, ay), (bx, by), (cx, cy) = t
    edges = [F.hypot(bx - ax, by - ay), F.hypot(cx - bx, cy - by), F.hypot(ax - cx, ay - cy)]
    det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def angle(i: int) -> Column:
        p, q, far = edges[i], edges[i - 1], edges[(i + 1) % 3]
        return F.degrees(F.acos(clip((p * p + q * q - far * far) / F.nullif(2 * p * q, F.lit(0.0)), -1.0, 1.0)))

    return {
        "area": F.abs(det) / 2,
        "longest_edge": F.greatest(*edges),
        "shortest_edge": F.least(*edges),
        "min_angle": F.least(angle(0), angle(1), angle(2)),
        "condition": condition_2x2(bx - ax, cx - ax, by - ay, cy - ay),
    }


def condition_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Ratio of the singular values of [[a, b], [c, d]]; NULL if singular."""
    total, det = a * a + b * b + c * c + d * d, a * d - b * c
    root = F.sqrt(F.greatest(total * total - 4 * det * det, F.lit(0.0)))
    return F.when(det != 0, (total + root) / (2 * F.abs(det)))


def link_crosses_segment(link: tuple[Point, Point], seg: tuple[Point, Point], tol: float = 1e-10) -> Column:
    """Open at the link's ends, closed at the segment's ends; parallel lines never cross."""
    (px, py), (qx, qy) = link
    (ax, ay), (bx, by) = seg
    rx, ry, sx, sy = qx - px, qy - py, bx - ax, by - ay
    det = rx * sy - ry * sx
    safe = F.nullif(det, F.lit(0.0))
    t = ((ax - px) * sy - (ay - py) * sx) / safe
    u = ((ax - px) * ry - (ay - py) * rx) / safe
    return F.coalesce((F.abs(det) > tol) & (t > tol) & (t < 1 - tol) & (u >= -tol) & (u <= 1 + tol), F.lit(False))


def link_blocked_by_segment(link: tuple[Point, Point], seg: tuple[Point, Point], tol: float = 1e-10) -> Column:
    """Closed on both: touching ends and collinear overlap block the link."""
    p, q = link
    a, b = seg
    boxes = (
        (F.greatest(p[0], q[0]) >= F.least(a[0], b[0]) - tol)
        & (F.least(p[0], q[0]) <= F.greatest(a[0], b[0]) + tol)
        & (F.greatest(p[1], q[1]) >= F.least(a[1], b[1]) - tol)
        & (F.least(p[1], q[1]) <= F.greatest(a[1], b[1]) + tol)
    )
    o = [orientation(p, q, a), orientation(p, q, b), orientation(a, b, p), orientation(a, b, q)]
    apart = lambda x, y: ((x > tol) & (y > tol)) | ((x < -tol) & (y < -tol))
    return boxes & ~apart(o[0], o[1]) & ~apart(o[2], o[3])


# -- fields -------------------------------------------------------------------


def time_years(at: Column, origin: Column) -> Column:
    """Years of 365.2425 days since ``origin``."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return (micros(at) - micros(origin)) / 1e6 / SECONDS_PER_YEAR


def duration_normalize(value: Column, sigma: Column, days: Column) -> tuple[Column, Column]:
    """Rates per day; NULL where the duration is not positive and finite."""
    days = F.when((days > 0) & (days < float("inf")), days)
    return value / days, sigma / days


def matern32(distance: Column, length: Column | float) -> Column:
    s = math.sqrt(3) * distance / _col(length)
    return (1 + s) * F.exp(-s)


def kernel(name: str, distance: Column, length: Column | float) -> Column:
    """Correlation: exponential, matern32 or rbf."""
    if name == "matern32":
        return matern32(distance, length)
    ratio = distance / _col(length)
    if name == "exponential":
        return F.exp(-ratio)
    if name == "rbf":
        return F.exp(-0.5 * ratio * ratio)
    raise ValueError(f"unknown kernel {name}")


def correct_vertical(
    los: Column, look_up: Column, up: Column, up_sigma: Column, reference: Column, reference_sigma: Column
) -> dict[str, Column]:
    """Subtract the referenced vertical part from a line-of-sight value."""
    term = look_up * up - reference
    return {"vertical_term": term, "corrected": los - term, "sigma": F.hypot(F.abs(look_up) * up_sigma, reference_sigma)}


def solve_two_track(
    asc: Column,
    desc: Column,
    asc_look: Point,
    desc_look: Point,
    asc_sigma: Column,
    desc_sigma: Column,
    asc_up_sigma: Column | float = 0.0,
    desc_up_sigma: Column | float = 0.0,
    up_correlation: float = 1.0,
    max_condition: float = 8.0,
    least_det: float = 1e-6,
) -> dict[str, Column]:
    """East and north from two lines of sight, with propagated covariance.

    Everything is NULL and ``valid`` false where an input is missing, the looks
    are (nearly) parallel or their matrix is ill-conditioned.
    """
    (ae, an), (de, dn) = asc_look, desc_look
    det = ae * dn - an * de
    condition = condition_2x2(ae, an, de, dn)
    safe = F.when(F.abs(det) > least_det, det)
    e_a, e_d, n_a, n_d = dn / safe, -an / safe, -de / safe, ae / safe
    ua, ud = _col(asc_up_sigma), _col(desc_up_sigma)
    va, vd, vx = asc_sigma * asc_sigma + ua * ua, desc_sigma * desc_sigma + ud * ud, up_correlation * ua * ud
    var_e = e_a * e_a * va + e_d * e_d * vd + 2 * e_a * e_d * vx
    var_n = n_a * n_a * va + n_d * n_d * vd + 2 * n_a * n_d * vx
    out = {
        "east": e_a * asc + e_d * desc,
        "north": n_a * asc + n_d * desc,
        "sigma_east": F.sqrt(F.greatest(var_e, F.lit(0.0))),
        "sigma_north": F.sqrt(F.greatest(var_n, F.lit(0.0))),
        "cov_en": e_a * n_a * va + e_d * n_d * vd + (e_a * n_d + e_d * n_a) * vx,
        "condition": condition,
    }
    valid = F.coalesce(safe.isNotNull() & (condition <= max_condition) & out["east"].isNotNull() & out["sigma_east"].isNotNull(), F.lit(False))
    return {k: F.when(valid, v) for k, v in out.items()} | {"valid": valid}


def strain_invariants(ex: Column, ey: Column, nx: Column, ny: Column, *, scale: float = 1.0, wrap: bool = True) -> dict[str, Column]:
    """Strain components of displacement gradients (e by x, e by y, n by x, n by y).

    ``wrap`` keeps the principal azimuth in [0, 180).
    """
    xx, yy, xy = ex * scale, ny * scale, (ey + nx) * (0.5 * scale)
    mean, half = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    azimuth = F.degrees(F.atan2(2 * xy, xx - yy) / 2)
    return {
        "exx": xx,
        "eyy": yy,
        "exy": xy,
        "gamma": 2 * xy,
        "dilatation": xx + yy,
        "rotation": (nx - ey) * (0.5 * scale),
        "max_shear": half,
        "principal_1": mean + half,
        "principal_2": mean - half,
        "azimuth": F.pmod(azimuth, F.lit(180.0)) if wrap else azimuth,
    }


def regularized_precision(c11: Column, c12: Column, c22: Column, *, relative_floor: float = 1e-6, absolute_floor: float = 1.0) -> dict[str, Column]:
    """Inverse of a symmetric 2x2 matrix whose eigenvalues are floored first."""
    mean, half = (c11 + c22) / 2, F.hypot((c11 - c22) / 2, c12)
    high = mean + half
    floor = F.greatest(F.lit(absolute_floor), relative_floor * high)
    l1, l2 = F.greatest(high, floor), F.greatest(mean - half, floor)
    theta = F.atan2(2 * c12, c11 - c22) / 2
    c, s = F.cos(theta), F.sin(theta)
    return {"p11": c * c / l1 + s * s / l2, "p12": c * s * (1 / l1 - 1 / l2), "p22": s * s / l1 + c * c / l2}


def segment_from_strike(x: Column, y: Column, strike: Column, length: Column) -> tuple[Point, Point]:
    """End points of a finite segment given by centre, strike (from north) and length."""
    dx, dy = F.sin(F.radians(strike)) * length / 2, F.cos(F.radians(strike)) * length / 2
    return (x - dx, y - dy), (x + dx, y + dy)


def rotate_to_strike(east: Column, north: Column, strike: Column) -> dict[str, Column]:
    """Components parallel to and to the left of a strike direction."""
    s, c = F.sin(F.radians(strike)), F.cos(F.radians(strike))
    return {"parallel": east * s + north * c, "normal": -east * c + north * s}
