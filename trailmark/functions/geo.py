"""Geographic column expressions: distance, scores, coordinate parsing, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions.core import let

NUMBER = r"[-+]?\d+(?:\.\d+)?"
NULL_PAIR = "struct<lat:double,lon:double>"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres. The sine term is clamped so rounding never yields NaN."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Not least(): that skips nulls and would place a missing prediction at the antipode.
    return F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord))) * (2 * K.EARTH_RADIUS_KM)


def distance_score(km: Column) -> Column:
    """Piecewise-linear score of a distance; 0 beyond the last knot, null for a null distance."""
    first_km, first_score = K.SCORE_KNOTS[0]
    out = F.when(km.isNull(), F.lit(None).cast("double")).when(km <= first_km, F.lit(first_score))
    for (x0, y0), (x1, y1) in zip(K.SCORE_KNOTS, K.SCORE_KNOTS[1:]):
        out = out.when(km <= x1, y0 + (km - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(0.0))


def difficulty(km: Column) -> Column:
    return (
        F.when(km.isNull(), "unknown")
        .when(km <= K.EASY_KM, "easy")
        .when(km <= K.MEDIUM_KM, "medium")
        .otherwise("hard")
    )


def threshold_flag(km: Column, threshold: float) -> Column:
    return F.coalesce((km <= threshold).cast("int"), F.lit(0))


def format_score(text: Column) -> Column:
    """0 without think and answer blocks, 0.8 with both, 1.0 when a useful list is there too."""
    base = text.rlike(r"(?s)\A<think>.*</think>.*<answer>.*</answer>.*\z")
    useful = text.rlike(r"(?s)<useful>\s*\[.*?\]\s*</useful>")
    return F.when(~base, 0.0).when(useful, 1.0).otherwise(0.8)


def _pair(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def parse_pred(text: Column) -> Column:
    """Evaluator flavour: last answer block, last two comma fields, (0, 0) means no prediction."""
    answer = F.try_element_at(F.regexp_extract_all(text, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))

    def read(fields: Column) -> Column:
        return _pair(
            F.try_element_at(fields, F.lit(-2)).try_cast("double"), F.try_element_at(fields, F.lit(-1)).try_cast("double")
        )

    usable = lambda p: p.lat.isNotNull() & p.lon.isNotNull() & ~((p.lat == 0.0) & (p.lon == 0.0))
    return let(let(F.split(answer, ","), read), lambda p: F.when(usable(p), p))


def parse_coords(text: Column) -> Column:
    """Reward flavour: first answer block, else a boxed value, else the whole text.

    A ``lat=.. lon=..`` form wins and is not range-checked; otherwise the last pair in range.
    """
    scope = (
        F.when(text.rlike("(?s)<answer>(.*?)</answer>"), F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1))
        .when(text.rlike(r"\\boxed\{([^}]*)\}"), F.regexp_extract(text, r"\\boxed\{([^}]*)\}", 1))
        .otherwise(text)
    )
    keyword = rf"(?i)lat(?:itude)?\s*[=:]\s*({NUMBER})\s*[,;]?\s*lon(?:gitude)?\s*[=:]\s*({NUMBER})"
    pair = rf"[(\[]?\s*({NUMBER})\s*,\s*({NUMBER})\s*[)\]]?"

    def read(found: Column, pattern: str) -> Column:
        return _pair(
            F.regexp_extract(found, pattern, 1).try_cast("double"), F.regexp_extract(found, pattern, 2).try_cast("double")
        )

    def last_pair(found: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(found, F.lit(pair), F.lit(0)), lambda hit: read(hit, pair))
        return F.try_element_at(F.filter(pairs, lambda p: p.lat.between(-90, 90) & p.lon.between(-180, 180)), F.lit(-1))

    return let(scope, lambda s: F.when(s.rlike(keyword), read(s, keyword)).otherwise(last_pair(s)))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def _wave(weight_1: float, arg_1: Column, weight_2: float, arg_2: Column) -> Column:
    return (weight_1 * F.sin(arg_1) + weight_2 * F.sin(arg_2)) * 2.0 / 3.0


def wgs84_to_gcj02(lat: Column, lon: Column) -> Column:
    """Struct of GCJ-02 coordinates, rounded to 6; unchanged outside the bounding box."""
    x, y, pi = lon - 105.0, lat - 35.0, math.pi
    shared = _wave(20.0, 6.0 * x * pi, 20.0, 2.0 * x * pi)
    d_lat = (
        -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + shared
        + _wave(20.0, y * pi, 40.0, y / 3.0 * pi)
        + _wave(160.0, y / 12.0 * pi, 320.0, y * pi / 30.0)
    )
    d_lon = (
        300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + shared
        + _wave(20.0, x * pi, 40.0, x / 3.0 * pi)
        + _wave(150.0, x / 12.0 * pi, 300.0, x / 30.0 * pi)
    )
    rad = lat / 180.0 * pi
    curve = 1 - K.GCJ_ECCENTRICITY * F.sin(rad) * F.sin(rad)
    lat_out = lat + d_lat * 180.0 / (K.GCJ_AXIS * (1 - K.GCJ_ECCENTRICITY) / (curve * F.sqrt(curve)) * pi)
    lon_out = lon + d_lon * 180.0 / (K.GCJ_AXIS / F.sqrt(curve) * F.cos(rad) * pi)
    inside = lon.between(*K.CHINA_LON) & lat.between(*K.CHINA_LAT)
    return _pair(
        F.when(inside, F.round(lat_out, 6)).otherwise(lat),
        F.when(inside, F.round(lon_out, 6)).otherwise(lon),
    )


def box_valid(box: Column, limit: float = K.BBOX_SCALE) -> Column:
    """A 4-number box inside [0, limit]; false for null."""
    inside = F.forall(box, lambda v: v.isNotNull() & v.between(0.0, limit))
    return F.coalesce((F.size(box) == 4) & inside, F.lit(False))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x1, y1, x2, y2] arrays; 0 without overlap, null for a null box."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )

    def area(box: Column) -> Column:
        return F.greatest(zero, box[2] - box[0]) * F.greatest(zero, box[3] - box[1])

    union = area(a) + area(b) - inter
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        (inter > 0) & (union > 0), inter / union
    ).otherwise(zero)


def sharded_path(image_id: Column, root: str) -> Column:
    parts = F.split(image_id, "_")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.lit(root.rstrip("/")), parts[0], parts[1], image_id))


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    if not root:
        return path
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def fixed4(value: Column) -> Column:
    """Four decimals as text. Spark rounds the shortest decimal form half up."""
    return F.format_string("%.4f", value)


def ground_truth_text(lat: Column, lon: Column, country: Column, city: Column) -> Column:
    return F.concat_ws(", ", fixed4(lat), fixed4(lon), country, city)


def default_place(place: Column) -> Column:
    return F.coalesce(place, F.lit("Unknown"))
