"""Row filters and projections over metadata, trajectories and regions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import geo as G
from trailmark.functions import text as X


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all the columns present; NaN counts as missing."""
    return df.dropna(subset=list(columns))


def drop_sentinels(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not one of the written-out nulls."""
    return df.where(~F.lower(X.strip(F.col(column))).isin(K.SENTINELS))


def complete_places(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows with all four place names, when a level that prints them is asked for."""
    if not {"l3", "l4", "all"} & set(levels):
        return df
    names = ["country", "region", "city", "neighbourhood"]
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in names]))


def quality(max_km: float = 200.0, max_nudges: int = 5) -> Column:
    """Unmasked, close enough, with a tool call, not nudged too often; a missing mask counts as masked."""
    return (
        (F.coalesce("masked", F.lit(1.0)) == 0)
        & F.coalesce(F.col("km") <= max_km, F.lit(False))
        & (F.coalesce("n_tool_calls", F.lit(0)) >= 1)
        & (F.coalesce("n_nudges", F.lit(0)) <= max_nudges)
    )


def has_marker(messages: Column, profile: str) -> Column:
    """Any message holds a failure marker of the builder named by ``profile``."""
    def marked(text: Column) -> Column:
        folded = F.lower(text) if profile in ("fallback", "notool") else text
        hit = reduce(lambda a, b: a | b, [folded.contains(m) for m in K.FAILURE_MARKERS[profile]])
        return hit | text.contains(K.FALLBACK_EXACT_MARKER) if profile == "fallback" else hit

    return F.exists(messages, lambda m: F.coalesce(marked(m.content), F.lit(False)))


def assistant_calls(messages: Column) -> Column:
    """All readable calls of a trajectory, in order, as one array."""
    return F.flatten(
        F.transform(F.filter(messages, lambda m: m.role == "assistant"), lambda m: X.parsed_calls(m.content))
    )


def has_full_image_search(messages: Column, margin: int = 5) -> Column:
    """An image search whose box covers the whole image, of 1000 by 1000, but for ``margin`` on each side."""
    def full(call: Column) -> Column:
        box = X.call_field(call, "$.arguments.bbox_2d", "array<double>")
        corners = [F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)]
        whole = (corners[0] <= margin) & (corners[1] <= margin) & (corners[2] >= 1000 - margin) & (corners[3] >= 1000 - margin)
        return (X.call_field(call, "$.name") == K.IMAGE_SEARCH) & whole

    return F.exists(assistant_calls(messages), lambda c: F.coalesce(full(c), F.lit(False)))


def tool_count() -> Column:
    """Recorded number of tool calls, else the sum of the per-tool counters."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("n_crop_calls", "n_search_calls", "n_tavily_calls")]
    return F.coalesce(F.nullif(F.col("n_tool_calls"), F.lit(0)), parts[0] + parts[1] + parts[2])


def masked_without_tools() -> Column:
    return (F.coalesce("masked", F.lit(0.0)) != 0) & (tool_count() == 0)


def full_coverage(messages: Column, useful_results: Column) -> Column:
    """No search calls, or at least as many annotations as search calls."""
    searches = [K.IMAGE_SEARCH, K.TEXT_SEARCH]
    called = F.size(F.filter(assistant_calls(messages), lambda c: X.call_field(c, "$.name").isin(searches)))
    noted = F.size(F.filter(F.coalesce(useful_results, F.array()), lambda u: u.tool.isin(searches)))
    return (called == 0) | (noted >= called)


def keep_difficulty(df: DataFrame, wanted: Sequence[str], km: str = "km") -> DataFrame:
    return df.where(G.difficulty(F.col(km)).isin(list(wanted)))


def filter_overlong(df: DataFrame, max_length: int, length: Column | None = None, text: str = "prompt") -> DataFrame:
    """Rows up to a length; a null length is a failed row and drops too. Default: white-space words."""
    words = F.size(F.filter(F.split(F.col(text), r"(?U)\s+", -1), lambda w: w != ""))
    size = words if length is None else length
    return df.where(F.coalesce(size, F.lit(max_length + 1)) <= max_length)


def fit_length(values: Column, n: int, truncation: str = "right", pad: object = 0) -> Column:
    """An array cut (left or right, or an error) or right-padded to n entries."""
    cut = {
        "right": F.slice(values, 1, n),
        "left": F.slice(values, -n, n),
        "error": F.raise_error(F.concat(F.lit("sequence longer than "), F.lit(str(n)))),
    }[truncation]
    padding = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(values), F.lit(0)))
    return F.when(F.size(values) > n, cut).otherwise(F.concat(values, padding))


def browse(df: DataFrame, column: str, low: float, high: float, text: str, sort: str, ascending: bool, page: int, size: int) -> DataFrame:
    """One page of a result browser: numeric range, text search over all columns, sort with nulls last."""
    value = F.col(column).try_cast("double")
    combined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    needle = text.strip().lower()
    hits = df.where((value >= low) & (value <= high))
    hits = hits.where(combined.contains(needle)) if needle else hits
    order = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    ties = [F.col(c) for c in df.columns if c != sort]
    return hits.orderBy(order, *ties).offset((page - 1) * size).limit(size)


def filter_regions(df: DataFrame, max_km: float, useful: bool = True, positive_gain: bool = True) -> DataFrame:
    """Entries with regions, a useful region, any positive gain, and a prediction close enough."""
    regions = F.coalesce(F.col("verified_regions"), F.array())
    keep = (F.size(regions) > 0) & (F.coalesce(F.nullif(F.col("pred_km"), F.lit(0.0)), F.lit(99999.0)) <= max_km)
    if useful:
        keep &= F.coalesce(F.col("has_useful_region"), F.lit(False))
    if positive_gain:
        keep &= F.exists(regions, lambda r: F.coalesce(r.gain, F.lit(0.0)) > 0)
    return df.where(keep)


def region_stats(df: DataFrame) -> DataFrame:
    """Shares of entries with regions and useful regions, positive gains, distance of the predictions."""
    regions = F.coalesce(F.col("verified_regions"), F.array())
    gains = F.filter(F.transform(regions, lambda r: r.gain), lambda g: g.isNotNull())
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.size(regions) > 0, 1)).alias("n_with_regions"),
        F.count(F.when(F.col("has_useful_region"), 1)).alias("n_useful"),
        F.sum(F.size(gains)).alias("n_gains"),
        F.sum(F.size(F.filter(gains, lambda g: g > 0))).alias("n_positive"),
        F.avg("pred_km").alias("mean_pred_km"),
        F.avg((F.col("pred_km") < 25).cast("double")).alias("share_within_25"),
    )


def _round_to(value: Column, factor: int) -> Column:
    return F.bround(value / factor) * factor


def resize_target(height: Column, width: Column) -> Column:
    """Height and width as multiples of the pixel factor, within the pixel bounds."""
    f = K.PIXEL_FACTOR
    h, w = F.greatest(F.lit(f), _round_to(height, f)), F.greatest(F.lit(f), _round_to(width, f))
    shrink = F.sqrt(height * width / K.MAX_PIXELS)
    grow = F.sqrt(F.lit(float(K.MIN_PIXELS)) / (height * width))

    def pick(plain: Column, side: Column) -> Column:
        return (
            F.when(h * w > K.MAX_PIXELS, F.floor(side / shrink / f) * f)
            .when(h * w < K.MIN_PIXELS, F.ceil(side * grow / f) * f)
            .otherwise(plain)
            .cast("int")
        )

    return F.struct(pick(h, height).alias("height"), pick(w, width).alias("width"))


def bbox_geometry(df: DataFrame, bbox: str, width: str, height: str) -> DataFrame:
    """Pixel crop box of a normalised box, grown to the minimum side; null columns when it is unusable."""
    box, w, h = F.col(bbox), F.col(width), F.col(height)
    usable = G.box_valid(box)
    scaled = [F.when(usable, box[i] * (w if i % 2 == 0 else h) / K.BBOX_SCALE) for i in range(4)]
    clamped = df.withColumns(
        {
            "__l": F.when(usable, F.greatest(F.lit(0.0), scaled[0])),
            "__t": F.when(usable, F.greatest(F.lit(0.0), scaled[1])),
            "__r": F.when(usable, F.least(w.cast("double"), scaled[2])),
            "__b": F.when(usable, F.least(h.cast("double"), scaled[3])),
        }
    )

    def sound(left: Column, top: Column, right: Column, bottom: Column) -> Column:
        wide, tall = right - left, bottom - top
        aspect = F.try_divide(F.greatest(wide, tall), F.least(wide, tall)) <= K.MAX_ASPECT
        return F.coalesce((wide > 0) & (tall > 0) & aspect, F.lit(False))

    left, top, right, bottom = (F.col(c) for c in ("__l", "__t", "__r", "__b"))
    wide, tall = right - left, bottom - top
    first = sound(left, top, right, bottom)
    small = (tall < K.MIN_SIDE) | (wide < K.MIN_SIDE)
    # Grow so that the short side reaches the minimum, then shrink what no longer fits the image.
    ratio = F.try_divide(F.lit(float(K.MIN_SIDE)), F.least(wide, tall))
    grown = clamped.withColumns({"__ok": first, "__small": small, "__w": wide * ratio, "__h": tall * ratio})
    for long, short, limit in (("__w", "__h", w), ("__h", "__w", h)):
        over = F.col(long) > limit
        grown = grown.withColumns(
            {
                long: F.when(over, limit.cast("double")).otherwise(F.col(long)),
                short: F.when(over, F.col(short) * (limit / F.col(long))).otherwise(F.col(short)),
            }
        )

    def start(low: Column, high: Column, size: Column, limit: Column) -> Column:
        centred = F.greatest((low + high) / 2.0 - size / 2.0, F.lit(0.0))
        return F.when(centred + size > limit, limit - size).otherwise(centred)

    x0, y0 = start(left, right, F.col("__w"), w), start(top, bottom, F.col("__h"), h)
    moved = grown.withColumns(
        {
            "x1": F.when(F.col("__small"), F.floor(x0).cast("double")).otherwise(left),
            "y1": F.when(F.col("__small"), F.floor(y0).cast("double")).otherwise(top),
            "x2": F.when(F.col("__small"), F.ceil(x0 + F.col("__w")).cast("double")).otherwise(right),
            "y2": F.when(F.col("__small"), F.ceil(y0 + F.col("__h")).cast("double")).otherwise(bottom),
        }
    )
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    tall_enough = F.floor(y2) - F.floor(y1) >= K.MIN_SIDE
    wide_enough = F.floor(x2) - F.floor(x1) >= K.MIN_SIDE
    valid = F.col("__ok") & sound(x1, y1, x2, y2) & tall_enough & wide_enough
    out = moved.withColumn("box_ok", F.coalesce(valid, F.lit(False)))
    out = out.withColumns({c: F.when(F.col("box_ok"), F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    target = resize_target(F.floor(F.col("y2")) - F.floor(F.col("y1")), F.floor(F.col("x2")) - F.floor(F.col("x1")))
    return (
        out.withColumn("__size", F.when(F.col("box_ok"), target))
        .withColumns({"out_height": F.col("__size.height"), "out_width": F.col("__size.width")})
        .drop("__l", "__t", "__r", "__b", "__w", "__h", "__ok", "__small", "__size")
    )
