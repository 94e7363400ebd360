"""Checks of drawn diagrams as joins between their shapes, by diagram.

Shapes are taken from the markup by a fold over its tree (``functions.svg``); a text's extent is an estimate by classes of
characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.svg import shapes as drawn
from ..session import materialize, shuffled

# Tolerances in pixels, and widths of characters in ems: beyond EAST_ASIAN, in monospaced fonts, and by class.
TOLERANCE, REACH, SLACK, SMALLEST = 4, 14, 0.9, 20
NARROW = r"[iljtfr.,:;'!|()\[\] ·]"
EAST_ASIAN, EAST_ASIAN_EM, EAST_ASIAN_MONO_EM, MONO_EM = 0x2E80, 0.9, 0.86, 0.6
NARROW_EM, WIDE_EM, LOWER_EM, OTHER_EM = 0.29, 0.64, 0.56, 0.43


def text_ems(text: Column, mono: Column) -> Column:
    """Width of a text in ems."""
    one = lambda c: (
        F.when(F.ascii(c) > EAST_ASIAN, F.when(mono, EAST_ASIAN_MONO_EM).otherwise(EAST_ASIAN_EM))
        .when(mono, MONO_EM)
        .when(c.rlike(NARROW), NARROW_EM)
        .when(c.rlike(r"[\p{Lu}\p{Nd}mw@%]"), WIDE_EM)
        .when(c.rlike(r"\p{Ll}"), LOWER_EM)
        .otherwise(OTHER_EM)
    )
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), F.lit(0.0), lambda a, w: a + w)


SHAPE = "kind string, n int, x0 double, y0 double, x1 double, y1 double, s string, ax double, ay double, size double, anchor string, mono boolean, points array<struct<x: double, y: double>>, straight array<boolean>, start boolean, end boolean"


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_SHAPE = [
    pa.field(name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<boolean>": pa.list_(pa.bool_()), "array<struct<x: double, y: double>>": pa.list_(POINT)}[kind])
    for name, kind in re.findall(r"(\w+) (array<.*?>+|\w+)(?:, |$)", SHAPE)
]


def shapes(svgs: DataFrame) -> DataFrame:
    """The shapes of diagrams (key, svg), one row each in drawing order ``n``, with the offsets of the groups they are in.

    Kinds: view (the canvas), rect, ellipse and polygon (x0 to y1), text (s, its anchor ax, ay, size, mono) and stroke
    (points, which ways between them are straight, arrows at start and end). A null, empty or malformed diagram has none,
    and neither has a part under a rotation or scale. Rows of shapes are returned as they are.
    """
    if "kind" in svgs.columns:
        return svgs
    schema = f"key {dict(svgs.dtypes)['key']}, {SHAPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"key": key, **shape} for shape in drawn(svg)] for key, svg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [shape for shapes_of in found for shape in shapes_of]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([pa.field("key", batch.column(0).type), *ARROW_SHAPE]))

    return svgs.select("key", "svg").mapInArrow(run, schema)


def stored(svgs: DataFrame) -> DataFrame:
    """The shapes with the widths of texts, parsed and measured once for what reads them several times."""
    if "kind" in svgs.columns:
        return svgs
    return materialize(_with_width(shapes(svgs)), "shapes")


def _with_width(rows: DataFrame) -> DataFrame:
    return rows if "wide" in rows.columns else rows.withColumn("wide", F.when(F.col("kind") == "text", text_ems(F.col("s"), F.col("mono")) * F.col("size")))


def boxes(svgs: DataFrame) -> DataFrame:
    """key, n, kind, x0, y0, x1, y1 of rectangles, ellipses and polygons."""
    return shapes(svgs).where(F.col("kind").isin("rect", "ellipse", "polygon")).select("key", "n", "kind", "x0", "y0", "x1", "y1")


def view(svgs: DataFrame) -> DataFrame:
    """key, vx, vy, vw, vh of the canvas; no row for a diagram without one."""
    return shapes(svgs).where("kind = 'view'").select("key", F.col("x0").alias("vx"), F.col("y0").alias("vy"), (F.col("x1") - F.col("x0")).alias("vw"), (F.col("y1") - F.col("y0")).alias("vh"))


def nodes(svgs: DataFrame) -> DataFrame:
    """Rectangles that are no bars and no backdrop: they hold no box of another extent, and no more than half of the
    canvas."""
    every = boxes(svgs)
    rects = every.where((F.col("kind") == "rect") & (F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= SMALLEST))
    corners = ("x0", "y0", "x1", "y1")
    inner = every.select("key", *[F.col(c).alias(f"_{c}") for c in corners])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in corners])
    holds = (rects["key"] == inner["key"]) & ~same & (F.col("_x0") >= F.col("x0")) & (F.col("_y0") >= F.col("y0")) & (F.col("_x1") <= F.col("x1")) & (F.col("_y1") <= F.col("y1"))
    small = rects.join(shuffled(inner), holds, "left_anti").join(shuffled(view(svgs)), "key", "left")
    frame = F.coalesce(F.col("vw") * F.col("vh"), F.lit(0.0))
    return small.where((frame == 0) | ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= 0.5 * frame)).select("key", "n", *corners)


def labels(svgs: DataFrame) -> DataFrame:
    """key, n, s, anchor (ax, ay), box (left, top, right, bottom), and the box without margin (wide_left, wide_right)."""
    rows = _with_width(shapes(svgs).where("kind = 'text'"))
    rows = rows.withColumn("w", F.when(F.col("mono"), F.col("wide")).otherwise(F.col("wide") * SLACK))
    left = lambda w: F.col("ax") - F.when(F.col("anchor") == "middle", F.col(w) / 2).when(F.col("anchor") == "end", F.col(w)).otherwise(0.0)
    return rows.select("key", "n", "s", "ax", "ay", left("w").alias("left"), (left("w") + F.col("w")).alias("right"), (F.col("ay") - 0.75 * F.col("size")).alias("top"), (F.col("ay") + 0.25 * F.col("size")).alias("bottom"), left("wide").alias("wide_left"), (left("wide") + F.col("wide")).alias("wide_right"))


def strokes(svgs: DataFrame) -> DataFrame:
    """key, n, (x1, y1) and (x2, y2) of the first and last point, start, end: whether an arrow is there, and the segments
    (ax, ay, bx, by, straight) between."""
    p = F.col("points")
    first, last = F.get(p, F.lit(0)), F.element_at(p, -1)
    ways = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.get(p, i)["x"].alias("ax"), F.get(p, i)["y"].alias("ay"), F.get(p, i + 1)["x"].alias("bx"), F.get(p, i + 1)["y"].alias("by"), F.get(F.col("straight"), i).alias("straight")))
    return shapes(svgs).where("kind = 'stroke'").select("key", "n", first["x"].alias("x1"), first["y"].alias("y1"), last["x"].alias("x2"), last["y"].alias("y2"), "start", "end", ways.alias("segments"))


def segments(svgs: DataFrame) -> DataFrame:
    """The strokes' segments, one row each."""
    return strokes(svgs).select("*", F.explode("segments").alias("way")).select("*", "way.*").drop("segments", "way")


def _inside(x: Column, y: Column, pad: float) -> Column:
    return x.between(F.col("b.x0") - pad, F.col("b.x1") + pad) & y.between(F.col("b.y0") - pad, F.col("b.y1") + pad)


def overflows(svgs: DataFrame) -> DataFrame:
    """Texts that pass the sides of the smallest box that holds their anchor."""
    home = labels(svgs).alias("t").join(shuffled(nodes(svgs)).alias("b"), (F.col("t.key") == F.col("b.key")) & _inside(F.col("t.ax"), F.col("t.ay"), 0))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    best = home.groupBy("t.key", "t.n", "t.s", "t.left", "t.right").agg(F.min_by(F.struct("b.x0", "b.x1"), F.struct(area, "b.n")).alias("box"))
    over = F.greatest(F.col("box.x0") - F.col("left"), F.col("right") - F.col("box.x1"))
    return best.where(over > TOLERANCE).select("key", F.lit("TEXT_OVERFLOW").alias("code"), "s")


def clipped(svgs: DataFrame) -> DataFrame:
    over = F.greatest(F.col("vx") - F.col("left"), F.col("right") - F.col("vx") - F.col("vw"))
    return labels(svgs).join(shuffled(view(svgs)), "key").where(over > TOLERANCE).select("key", F.lit("TEXT_CLIPPED").alias("code"), "s")


def over_boxes(svgs: DataFrame) -> DataFrame:
    """Texts that run into a box which isn't theirs."""
    rows = labels(svgs).alias("t").join(shuffled(nodes(svgs)).alias("b"), "key").where(~_inside(F.col("t.ax"), F.col("t.ay"), 0))
    w = F.least("wide_right", "x1") - F.greatest("wide_left", "x0")
    h = F.least("bottom", "y1") - F.greatest("top", "y0")
    return rows.where((w > 3) & (h > 0.4 * (F.col("bottom") - F.col("top")))).select("key", F.lit("TEXT_OVER_BOX").alias("code"), "s")


def overlaps(svgs: DataFrame) -> DataFrame:
    """Pairs of texts of one diagram that cover each other."""
    one = labels(stored(svgs))
    other = one.select("key", *[F.col(c).alias(f"_{c}") for c in ("n", "left", "right", "top", "bottom")])
    w = F.least("right", "_right") - F.greatest("left", "_left")
    h = F.least("bottom", "_bottom") - F.greatest("top", "_top")
    return one.join(shuffled(other), "key").where((F.col("n") < F.col("_n")) & (w > TOLERANCE) & (h > 1)).select("key", F.lit("TEXT_OVERLAP").alias("code"), "s")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    length = (bx - ax) ** 2 + (by - ay) ** 2
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length, F.lit(0.0)))))
    return F.sqrt((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2)


def crosses(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment crosses a box's inside: the parameters at which it enters and leaves are in order."""
    sides = ((ax - bx, ax - x0), (bx - ax, x1 - ax), (ay - by, ay - y0), (by - ay, y1 - ay))
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / F.nullif(p, F.lit(0.0))).otherwise(0.0) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, q / F.nullif(p, F.lit(0.0))).otherwise(1.0) for p, q in sides])
    beside = reduce(lambda a, b: a | b, [(p == 0) & (q < 0) for p, q in sides])
    return ~beside & (enter < leave)


def through_boxes(svgs: DataFrame) -> DataFrame:
    """Arrows of which a straight part crosses a box that they neither leave nor reach."""
    ends, way = [F.col(f"l.{n}") for n in ("x1", "y1", "x2", "y2")], [F.col(f"l.{n}") for n in ("ax", "ay", "bx", "by")]
    rows = segments(svgs).where("(start OR end) AND straight").alias("l").join(shuffled(nodes(svgs)).alias("b"), F.col("l.key") == F.col("b.key"))
    far = ~_inside(ends[0], ends[1], REACH) & ~_inside(ends[2], ends[3], REACH)
    hit = crosses(*way, F.col("b.x0") + 6, F.col("b.y0") + 6, F.col("b.x1") - 6, F.col("b.y1") - 6)
    return rows.where(far & hit).select("l.key", F.lit("EDGE_THROUGH_BOX").alias("code"), F.col("l.n").cast("string").alias("s"))


def dangling(svgs: DataFrame) -> DataFrame:
    """Arrow tips of strokes that leave a box and point at nothing: no box, text or other stroke is near."""
    lines, every = strokes(svgs), boxes(svgs)
    ends = lines.select("key", "n", "x1", "y1", "x2", "y2", F.explode(F.filter(F.array(F.struct(F.col("end").alias("on"), F.col("x2").alias("tx"), F.col("y2").alias("ty")), F.struct(F.col("start").alias("on"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))), lambda t: t["on"])).alias("tip"))
    ends = ends.select("*", "tip.tx", "tip.ty").drop("tip").alias("l")
    b = shuffled(every).alias("b")
    attached = ends.join(b, (F.col("l.key") == F.col("b.key")) & (_inside(F.col("l.x1"), F.col("l.y1"), REACH) | _inside(F.col("l.x2"), F.col("l.y2"), REACH)), "left_semi").alias("l")
    targets = shuffled(every.select("key", "x0", "y0", "x1", "y1").unionByName(labels(svgs).select("key", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1")))).alias("b")
    free = attached.join(targets, (F.col("l.key") == F.col("b.key")) & _inside(F.col("l.tx"), F.col("l.ty"), REACH), "left_anti").alias("l")
    o = shuffled(segments(svgs).select("key", "n", "ax", "ay", "bx", "by")).alias("o")
    near = segment_distance(*[F.col(c) for c in ("l.tx", "l.ty", "o.ax", "o.ay", "o.bx", "o.by")]) <= REACH
    return free.join(o, (F.col("l.key") == F.col("o.key")) & (F.col("l.n") != F.col("o.n")) & near, "left_anti").select("key", F.lit("DANGLING_ARROW").alias("code"), F.col("n").cast("string").alias("s"))


def lint(svgs: DataFrame) -> DataFrame:
    """key, code, s: all findings, each once. ``svgs``: key, svg. Diagrams are parsed once; the rules join their shapes."""
    found = stored(svgs)
    rules = (overflows, clipped, over_boxes, overlaps, dangling, through_boxes)
    return reduce(lambda a, b: a.unionByName(b), [rule(found) for rule in rules]).distinct()


def diagrams_of(reports: DataFrame) -> DataFrame:
    """Inline diagrams of reports (slug, html), numbered from 1."""
    rows = reports.select("slug", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<svg\b.*?</svg>"), F.lit(0))).alias("n", "svg"))
    return rows.select(F.concat_ws("#", "slug", (F.col("n") + 1).cast("string")).alias("key"), "svg")
