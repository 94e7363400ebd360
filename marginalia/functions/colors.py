"""Contrast of text and background, and its repair, as column arithmetic over red, green and blue (0 to 255)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Relative luminance and the ratios that text must reach (WCAG AA), large from so many pixels on.
WEIGHTS, KNEE, SLOPE, OFFSET, GAMMA = (0.2126, 0.7152, 0.0722), 0.03928, 12.92, 0.055, 2.4
READABLE, READABLE_LARGE, LARGE, LARGE_BOLD, BOLD = 4.5, 3.0, 24.0, 18.66, 700
LIGHT, STEPS = 0.4, 10

Rgb = tuple[Column, Column, Column]


def rgb(color: Column) -> Rgb:
    """The parts of ``rgb(r, g, b)`` or ``rgba(r, g, b, a)``; nulls for other text."""
    parts = F.split(F.nullif(F.regexp_extract(color, r"rgba?\(([^)]+)\)", 1), F.lit("")), ",")
    return tuple(F.get(parts, F.lit(i)).try_cast("double") for i in range(3))


def luminance(color: Rgb) -> Column:
    def linear(v: Column) -> Column:
        return F.when(v / 255 <= KNEE, v / 255 / SLOPE).otherwise(F.pow((v / 255 + OFFSET) / (1 + OFFSET), F.lit(GAMMA)))

    return sum((linear(v) * w for v, w in zip(color, WEIGHTS)), F.lit(0.0))


def ratio(one: Column, other: Column) -> Column:
    """The contrast of two luminances."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def needed(size: Column, weight: Column) -> Column:
    """The ratio that text of a size in pixels and a weight has to reach."""
    return F.when((size >= LARGE) | ((size >= LARGE_BOLD) & (weight >= BOLD)), READABLE_LARGE).otherwise(READABLE)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), of), 1)


def repaired(text: Rgb, background: Rgb, need: Column) -> Column:
    """A struct of r, g, b, ratio and fixed: the text's colour as it is if it reads, else the first of ten mixtures with
    black or white, whichever is far from the background, that reaches ``need``; the last one if none does. Null where a
    colour is null. The mixture's parts are rounded, its ratio is that before rounding."""

    def mixed(k: Column, behind: Column) -> Column:
        target = F.when(behind > LIGHT, 0.0).otherwise(255.0)
        color = _bound(target, lambda t: F.struct(*[(v + (t - v) * k / STEPS).alias(n) for v, n in zip(text, "rgb")]))
        return _bound(color, lambda c: F.struct(*[c[n].alias(n) for n in "rgb"], _bound(luminance(tuple(c[n] for n in "rgb")), lambda own: ratio(own, behind)).alias("ratio")))

    # a fold mixes up to the first step that reads and carries only that one
    start = F.lit(None).cast("struct<k: int, c: struct<r: double, g: double, b: double, ratio: double>>")
    step = lambda behind: lambda best, k: F.when(best["c"]["ratio"] >= need, best).otherwise(F.struct(k.alias("k"), mixed(k.cast("double"), behind).alias("c")))
    final = lambda s: F.struct(*[F.when(s["k"] > 0, F.floor(s["c"][n] + 0.5).cast("double")).otherwise(s["c"][n]).alias(n) for n in "rgb"], s["c"]["ratio"].alias("ratio"), (s["k"] > 0).alias("fixed"))
    chosen = _bound(luminance(background), lambda behind: F.when(behind.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), start, step(behind))))
    result = _bound(chosen, lambda s: F.when(s.isNotNull(), final(s)))
    return F.when(sum(text, F.lit(0.0)).isNotNull(), result)
