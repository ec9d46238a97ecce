"""Tones, crops and edits as column expressions: curves of one value, gains of a picture, boxes, what an edit costs. Amounts are from -100 to 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators.kernels import HIGHLIGHT_GAIN, HIGHLIGHT_PIVOT, SHADOW_GAIN, SHADOW_PIVOT

# The middle aimed at and the most stops, weights of light, and what an edit costs: stops over half, what is cropped away, denoising; rendered files keep a share less.
MIDDLE, MOST_STOPS, LIGHT = 118.0, 2.0, (0.299, 0.587, 0.114)
COST_STOP, COST_CROP, COST_DENOISE, COST_RENDERED = 3.0, 26.0, 4.0, 0.35
LEAST_SIDE = 16


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def highlights(v: Column, amount: Column) -> Column:
    return _unit(v + _unit((v - HIGHLIGHT_PIVOT) / (1 - HIGHLIGHT_PIVOT)) * (1 - v) * HIGHLIGHT_GAIN * amount / 100)


def shadows(v: Column, amount: Column) -> Column:
    depth = F.greatest(F.lit(0.0), SHADOW_PIVOT - v)
    return _unit(v + F.least(F.lit(1.0), depth / SHADOW_PIVOT) * depth * SHADOW_GAIN * amount / 100)


def whites_blacks(v: Column, whites: Column, blacks: Column) -> Column:
    """The upper half drawn by the whites, then the lower half by the blacks."""
    out = v + F.greatest(F.lit(0.0), v - 0.5) * 0.6 * whites / 100
    return _unit(out + F.greatest(F.lit(0.0), 0.5 - out) * 0.6 * blacks / 100)


def contrast(v: Column, amount: Column) -> Column:
    off = v - 0.5
    return _unit(v + off * (1 - 2 * F.abs(off)) * amount / 100)


def light(r: Column, g: Column, b: Column) -> Column:
    return r * LIGHT[0] + g * LIGHT[1] + b * LIGHT[2]


def balance_gains(kelvin: Column, tint: Column) -> list[Column]:
    """Factors of linear red, green and blue for a change in kelvin and tint, from 0.2 to 5."""
    warm, green = kelvin / 4000.0, tint / 200.0
    return [F.greatest(F.lit(0.2), F.least(F.lit(5.0), 1 + x)) for x in (warm, green * 0.5, -warm)]


def rendered(df: DataFrame, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """The rows with linear red, green and blue as they are shown after an edit, point by point: balance, exposure, curves, colour, and light alone for `monochrome`.

    Reads exposure_ev, temperature, tint, highlights, shadows, whites, blacks, contrast, saturation, vibrance, monochrome. What looks at neighbours (clarity, denoising,
    sharpening) and at places isn't here. Every step is a projection of its own, as its value stands in the next one more than once.
    """
    c = F.col
    gains = balance_gains(c("temperature"), c("tint"))
    df = df.withColumns({n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c(n) * gain * F.pow(F.lit(2.0), c("exposure_ev"))) ** (1 / 2.2)) for n, gain in zip(names, gains, strict=True)})
    for curve, amounts in ((highlights, ["highlights"]), (shadows, ["shadows"]), (whites_blacks, ["whites", "blacks"]), (contrast, ["contrast"])):
        df = df.withColumns({n: curve(c(n), *map(c, amounts)) for n in names})
    # Vibrance acts the less the more colour there is.
    df = df.withColumn("_light", light(*map(c, names)))
    df = df.withColumn("_strong", F.greatest(*(F.abs(c(n) - c("_light")) for n in names)))
    df = df.withColumn("_gain", 1 + c("saturation") / 100 + c("vibrance") / 100 * (1 - _unit(c("_strong") * 2.5)))
    df = df.withColumns({n: _unit(c("_light") + (c(n) - c("_light")) * c("_gain")) for n in names}).withColumn("_light", light(*map(c, names)))
    return df.withColumns({n: F.when(c("monochrome"), c("_light")).otherwise(c(n)) for n in names}).drop("_light", "_strong", "_gain")


def suggested_stops(mean_light: Column) -> Column:
    """Stops towards the middle, 2 places, within limits."""
    return F.greatest(F.lit(-MOST_STOPS), F.least(F.lit(MOST_STOPS), F.bround(F.log2(MIDDLE / F.greatest(mean_light, F.lit(1.0))), 2)))


def grey_gains(r: Column, g: Column, b: Column) -> list[Column]:
    """Half-way factors that draw channel means to their mean; dark channels are left alone."""
    mean = (r + g + b) / 3
    return [F.when(x > 1, 1 + (mean / F.greatest(x, F.lit(1.0)) - 1) * 0.5).otherwise(1.0) for x in (r, g, b)]


def brightest_tenth(values: Column) -> Column:
    """The mean of the values from the 90th percentile (between neighbours by their distance) on, 2 places; 0 without values."""
    def mean_from(own: Column, cut: Column) -> Column:
        top = F.filter(own, lambda v: v >= cut)
        return F.bround(F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.size(top), 2)

    def of(own: Column) -> Column:
        at = (F.size(own) - 1) * 0.9
        low, high = F.element_at(own, F.floor(at).cast("int") + 1), F.element_at(own, F.ceil(at).cast("int") + 1)
        return F.element_at(F.transform(F.array(low + (high - low) * (at - F.floor(at))), lambda cut: mean_from(own, cut)), 1)

    # Arrays of one element, so that the order and the cut are found once.
    return F.when(F.size(values) > 0, F.element_at(F.transform(F.array(F.array_sort(values)), of), 1)).otherwise(0.0)


def edit_cost(keep: Column, stops: Column, denoised: Column) -> Column:
    return COST_STOP * F.greatest(F.lit(0.0), stops - 0.5) + COST_CROP * (1 - keep) + F.when(denoised, COST_DENOISE).otherwise(0.0)


def uplift(current: Column, best: Column, cost: Column, is_raw: Column) -> Column:
    """What an edit gains after its cost, never below 0; files that aren't raw lose a share of the gain."""
    gain = F.greatest(F.lit(0.0), best - current)
    return F.greatest(F.lit(0.0), gain - F.bround(cost + F.when(is_raw, 0.0).otherwise(gain * COST_RENDERED), 2))


def box(width: Column, height: Column, x: Column, y: Column, ratio: float) -> Column:
    """struct<left, top, right, bottom>: the largest box of a shape around a place, within the frame; null if a side is under LEAST_SIDE."""
    cut = lambda v: F.floor(v).cast("long")
    w = F.least(width, cut(height * F.lit(ratio)))
    h = F.least(height, cut(w / F.lit(ratio)))
    w = F.least(width, cut(h * F.lit(ratio)))
    within = lambda most, at, side: F.greatest(F.lit(0), F.least(most - side, at - cut(side / 2)))
    left, top = within(width, x, w), within(height, y, h)
    return F.when((w >= LEAST_SIDE) & (h >= LEAST_SIDE), F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom")))


def inscribed(width: Column, height: Column, degrees: Column) -> Column:
    """struct<width, height>: the largest upright box within a frame turned by some degrees, at least 1 by 1."""
    half_turn = F.radians(F.abs(degrees) % 180)
    angle = F.when(half_turn > F.pi() / 2, F.pi() - half_turn).otherwise(half_turn)
    sin, cos = F.abs(F.sin(angle)), F.abs(F.cos(angle))
    wide = width >= height
    long_, short = F.greatest(width, height), F.least(width, height)
    # Either the short side's ends alone touch the turned frame, or all four corners do.
    slim = (short <= 2 * sin * cos * long_) | (F.abs(sin - cos) < 1e-10)
    a, b = F.try_divide(short * 0.5, sin), F.try_divide(short * 0.5, cos)
    spread = cos * cos - sin * sin
    w = F.when(slim, F.when(wide, a).otherwise(b)).otherwise(F.try_divide(width * cos - height * sin, spread))
    h = F.when(slim, F.when(wide, b).otherwise(a)).otherwise(F.try_divide(height * cos - width * sin, spread))
    whole = lambda v: F.greatest(F.lit(1).cast("long"), F.floor(v).cast("long"))
    return F.struct(whole(w).alias("width"), whole(h).alias("height"))
