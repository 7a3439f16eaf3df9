"""Column functions: text keys, codes, casts, tiers, colours and distances. All are built-in expressions; a null argument
gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the plain letters that they decompose to, and letters that case folding spells out.
MARKED = "áàâäãåāăąçćčďđéèêëēėęěğíìîïīįıłñńňóòôöõōőřśšşťúùûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnooooooorssstuuuuuuuyyzzz"
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o"}
EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0
#: Populations from which a place is a major or a regional one, zooms by tier.
MAJOR, REGIONAL = 1_500_000, 350_000
#: WGS 84 first eccentricity and half axes, for the equal-area projection with standard parallel 30.
E2, AXIS = 0.0066943799901413165, 6378137.0


def clean(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def latin_key(c: Column) -> Column:
    """Lower case without marks; what is no letter, digit or apostrophe is one space."""
    t = F.translate(F.lower(c), MARKED + "‘’", PLAIN + "''")
    for a, b in SPELLED.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^a-z0-9']+", " "))


def match_key(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def alias_split(c: Column) -> Column:
    """Parts between bars, commas, semicolons and slashes, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"[|,;/]+"), lambda x: F.trim(x)), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(latin_key(c), "'", ""), " +", "-")


def stable_hash(*parts: Column, length: int = 12) -> Column:
    """First hexadecimal digits of the SHA-1 of the parts joined by bars; null parts are blank."""
    return F.upper(F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length))


def code_from_id(c: Column) -> Column:
    """Leading two or three capitals before an underscore, dash, hash or the end; UNK if none."""
    found = F.regexp_extract(F.upper(c), r"^([A-Z]{2,3})(?:[_\-#]|$)", 1)
    return F.when(found == "", "UNK").otherwise(found)


def first_valid_code(*columns: Column) -> Column:
    """First of the columns that is two capitals and not -99."""
    return F.coalesce(*[F.when(F.upper(F.trim(c)).rlike("^[A-Z]{2}$"), F.upper(F.trim(c))) for c in columns])


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def capital_score(kind: Column) -> Column:
    return F.when(kind == "country_capital", 3).when(kind == "admin_capital", 2).otherwise(1)


def base_tier(population: Column, score: Column) -> Column:
    return F.when((score >= 3) | (population >= MAJOR), "major").when((score >= 2) | (population >= REGIONAL), "regional").otherwise("minor")


def min_zoom(tier: Column) -> Column:
    return F.when(tier == "major", 0.8).when(tier == "regional", 1.6).otherwise(2.9)


def light_weight(population: Column, bonus: Column) -> Column:
    """0.18 to 1 by the logarithm of the population."""
    return F.greatest(F.lit(0.18), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(F.greatest(population, F.lit(1))) - 4.9) / 2)) * 0.72 + bonus))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_M


def mercator_length_m(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Length of a straight line between two points in the web Mercator plane."""
    return F.hypot(mercator_x(x1) - mercator_x(x0), mercator_y(y1) - mercator_y(y0))


def equal_area_y(lat: Column) -> Column:
    """Northing of the cylindrical equal-area projection on the WGS 84 ellipsoid, standard parallel 30 degrees."""
    e, s = E2**0.5, F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return q * (AXIS / (2 * _K0))


def equal_area_x(lon: Column) -> Column:
    return F.radians(lon) * (AXIS * _K0)


_K0 = (3**0.5 / 2) / (1 - E2 * 0.25) ** 0.5


def box_area_km2(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return (equal_area_x(xmax) - equal_area_x(xmin)) * (equal_area_y(ymax) - equal_area_y(ymin)) / 1e6


def to_int(c: Column) -> Column:
    """Text to a whole number through a decimal one; blank or invalid is 0."""
    return F.coalesce(F.trim(c).try_cast("double").cast("long"), F.lit(0).cast("long"))


def to_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def hex_channel(colour: Column, k: int) -> Column:
    """Red, green or blue (0, 1, 2) of #rrggbb."""
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int")


def lab(colour: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of #rrggbb."""
    linear = []
    for k in range(3):
        v = hex_channel(colour, k) / 255.0
        linear.append(F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4)))
    r, g, b = linear
    white = (0.95047, 1.0, 1.08883)
    rows = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    f = []
    for w, (x, y, z) in zip(white, rows, strict=True):
        t = (r * x + g * y + b * z) / w
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def delta_e(a: Column, b: Column) -> Column:
    """Distance of two colours in Lab."""
    return F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(lab(a), lab(b), strict=True)), F.lit(0.0)))


def tag_list(c: Column) -> Column:
    """Array to upper-case trimmed distinct tags, blanks dropped, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def date_key(c: Column) -> Column:
    """y.m.d.h text to an array of four numbers, missing parts 0."""
    parts = F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
