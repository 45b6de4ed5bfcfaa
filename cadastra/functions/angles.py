"""Bearings and azimuths as column expressions. Azimuths are degrees, clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREE = "°"
QUADRANT = r"^\s*([NSns])?\s*(\d+(?:\.\d+)?)\s*[°º]?\s*(?:(\d+(?:\.\d+)?)\s*['’′]\s*)?(?:(\d+(?:\.\d+)?)\s*[\"”″]\s*)?([EWew])?\s*$"
STRICT = r"^\s*([NS])\s*(\d+)°\s*(\d+)['’′]\s*(\d+(?:\.\d+)?)[\"”″]\s*([EW])\s*$"


def wrap180(a: Column) -> Column:
    """A line-axis angle in [-90, 90)."""
    return F.pmod(a + 90, F.lit(180.0)) - 90


def wrap360(a: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def angle_between(a: Column, b: Column) -> Column:
    """Smallest difference of two azimuths, 0 to 180. A turn is added first, so that differences of azimuths round alike
    on either side of 0 and one that lies on a limit falls as in SQL, whose % keeps the sign."""
    return F.abs(F.pmod(a - b + 180 + 360, F.lit(360.0)) - 180)


def axis_between(a: Column, b: Column) -> Column:
    """Smallest difference of two line axes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def axis_of(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Axis azimuth of a segment on a page whose y runs down, [0, 180)."""
    return F.pmod(F.degrees(F.atan2(x1 - x0, y0 - y1)), F.lit(180.0))


def travel_of(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Azimuth of travel on a page whose y runs down, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x1 - x0, y0 - y1)), F.lit(360.0))


def north_azimuth(de: Column, dn: Column) -> Column:
    """Azimuth of a step in east and north, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0))


def travel_sense(azimuth: Column, forward: Column) -> tuple[Column, Column]:
    """(residual, sense): the direction of travel, 1 or -1, that is nearer to the azimuth; a tie is -1."""
    ahead, back = angle_between(azimuth, forward), F.abs(F.pmod(azimuth - forward - 180 + 180 + 360, F.lit(360.0)) - 180)
    return F.least(ahead, back), F.when(ahead < back, 1).otherwise(-1)


def face_towards(azimuth: Column, wanted: Column) -> Column:
    """The azimuth, turned about when it is more than 90 degrees off what is wanted."""
    return F.when(angle_between(azimuth, wanted) > 90, F.pmod(azimuth + 180, F.lit(360.0))).otherwise(azimuth)


def quadrant_azimuth(angle: Column, ns: Column, ew: Column) -> Column:
    """Azimuth of a quadrant bearing; null unless both letters are given."""
    return F.when((ns == "N") & (ew == "E"), angle).when((ns == "S") & (ew == "E"), 180 - angle).when((ns == "S") & (ew == "W"), angle + 180).when((ns == "N") & (ew == "W"), 360 - angle)


def _loose(raw: Column) -> tuple[Column, Column, Column]:
    """(angle, N or S, E or W) of a read: the first three digit runs are degrees, minutes and seconds."""
    runs = F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), 0), lambda d: d.cast("double"))
    at = lambda i: F.coalesce(F.get(runs, F.lit(i)), F.lit(0.0))
    angle = F.when(raw.contains(DEGREE) & (F.size(runs) > 0), at(0) + at(1) / 60 + at(2) / 3600)
    upper = F.upper(raw)
    head, tail = F.substring(F.regexp_replace(upper, r"^[. ]+", ""), 1, 1), F.substring(upper, 2, 1 << 20)
    ns = F.when(head.isin("N", "S"), head)
    ew = F.when(tail.contains("E"), "E").when(tail.contains("W"), "W")
    return angle, ns, ew


def loose_azimuth(raw: Column) -> Column:
    """Tolerant reading of a bearing: needs a degree sign; with both quadrant letters an azimuth, else the plain angle; may be 360."""
    angle, ns, ew = _loose(raw)
    return F.coalesce(quadrant_azimuth(angle, ns, ew), angle)


def azimuth_candidates(raw: Column) -> Column:
    """Azimuths that a read may mean, sorted: two when one quadrant letter is missing, none when it isn't a bearing."""
    angle, ns, ew = _loose(raw)
    every = F.array(*(F.when((ns.isNull() | (ns == a)) & (ew.isNull() | (ew == b)), F.pmod(quadrant_azimuth(angle, F.lit(a), F.lit(b)), F.lit(360.0))) for a in "NS" for b in "EW"))
    plain = F.array(F.pmod(angle, F.lit(360.0)))
    return F.when(angle.isNull(), F.array().cast("array<double>")).when(ns.isNull() & ew.isNull(), plain).otherwise(F.array_sort(F.array_distinct(F.array_compact(every))))


def strict_degrees(raw: Column) -> Column:
    """Anchored reading of a bearing or angle with fractions kept; null when it can't be read."""
    part = lambda i: F.nullif(F.regexp_extract(raw, QUADRANT, i), F.lit(""))
    num = lambda i: F.coalesce(part(i).try_cast("double"), F.lit(0.0))
    angle = part(2).try_cast("double") + num(3) / 60 + num(4) / 3600
    ns, ew = F.upper(part(1)), F.upper(part(5))
    turned = F.coalesce(quadrant_azimuth(angle, ns, ew), F.when(ns == "N", angle).when(ns == "S", 180.0).when(ew == "E", 90.0).when(ew == "W", 270.0))
    return F.when(ns.isNull() & ew.isNull(), angle).otherwise(F.pmod(turned, F.lit(360.0)))


def full_quadrant(raw: Column) -> Column:
    """Azimuth of a complete quadrant bearing with degrees, minutes and seconds; else null."""
    part = lambda i: F.nullif(F.regexp_extract(F.upper(raw), STRICT, i), F.lit(""))
    angle = part(2).try_cast("double") + part(3).try_cast("double") / 60 + part(4).try_cast("double") / 3600
    return F.pmod(quadrant_azimuth(angle, part(1), part(5)), F.lit(360.0))


def to_dms(degrees: Column) -> Column:
    """D°MM'SS" to the nearest second, halves to even."""
    total = F.bround(F.pmod(degrees, F.lit(360.0)) * 3600).cast("bigint")
    return F.format_string("%d°%02d'%02d\"", (total / 3600).cast("bigint"), (F.pmod(total, F.lit(3600)) / 60).cast("bigint"), F.pmod(total, F.lit(60)))


def plain_bearing(raw: Column) -> Column:
    """A bearing as printed, without inner blanks, upper case."""
    return F.upper(F.regexp_replace(raw, r"\s+", ""))
