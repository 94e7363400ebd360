"""Figures and tables of laid-out pages from boxes: captions, the graphics or rules or lines that belong to them, regions.

Input is rows of boxes in page units with the origin at the lower left, whatever program read them from a file. A page's
characters and graphics are arrays: a page bounds them. Everything is column expressions over these arrays, joined and
grouped by page; growing a region until it holds still is the one step in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize

# How captions begin and go on, and distances in points.
LABEL = r"(?m)^[ \t]*(Figure|Fig\.|Table|TABLE|FIGURE)[ \t]*(\d+)\b"
GOES_ON_AS_CAPTION = r"^\s*[:.|—–-]|^\s+[A-Z(]"
GOES_ON_AS_SENTENCE = r"^\s*(,|and\b|or\b|is\b|are\b|was\b|shows?\b|presents?\b|compares?\b|reports?\b|illustrates?\b|summari[sz]es?\b|lists?\b|gives?\b|depicts?\b|in\b|of\b|for\b|with\b|to\b|also\b)"
AFTER = 40
LINE_CHARS, LINE_DROP, COLUMN_JUMP = 400, 3.0, 40.0
PARAGRAPH_CHARS, LEAST_LINE, LINE_GAP, LEFT_OUT, RIGHT_OUT, SHARED = 1500, 6.0, 0.9, 15.0, 60.0, 10.0
BASELINE = 2
FORM, DRAWN, DEEPEST = 5, (2, 3, 4), 12
SPECK, PAGE_SHARE, HEADER, FOOTER = 2.0, 0.85, 0.93, 0.06
WIDE, GUTTER, LEFT_SIDE, RIGHT_SIDE = 0.6, 8.0, 0.6, 0.4
ABOVE, BELOW, UNDER_CAPTION, GAP, SIDEWAYS = 60.0, 45.0, 4.0, 20.0, -20.0
RULE_HEIGHT, RULE_WIDTH, RULE_REACH, RULE_LIKE, TABLE_SHARE = 2.5, 50.0, 110.0, 0.35, 0.6
BLOCK_GAP, LEAST_BLOCK_LINE = 2.2, 8.0
LEAST_HEIGHT, LEAST_WIDTH, MARGIN, ROUND_CAPTION = 25.0, 40.0, 5.0, 400

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
CORNERS = ("x0", "y0", "x1", "y1")


def is_caption(after: Column) -> Column:
    """Whether what follows "Figure 3" makes a caption of it, not a sentence."""
    return after.rlike(GOES_ON_AS_CAPTION) & ~after.rlike(GOES_ON_AS_SENTENCE)


def box(x0: Column | float, y0: Column | float, x1: Column | float, y1: Column | float) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for n, c in zip(CORNERS, (x0, y0, x1, y1))])


def around(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    least, most = (lambda n: F.array_min(F.transform(boxes, lambda g: g[n]))), (lambda n: F.array_max(F.transform(boxes, lambda g: g[n])))
    return F.when(F.size(boxes) > 0, box(least("x0"), least("y0"), most("x1"), most("y1")))


def joined(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def baselines(chars: DataFrame, *keys: str) -> DataFrame:
    """Lines of text: per ``keys`` and rounded baseline the box around the characters (x0 to y1) on it."""
    rows = chars.where("x1 > x0 AND y1 > y0").groupBy(*keys, F.rint(F.col("y0") / BASELINE).alias("baseline"))
    return rows.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def leaf_graphics(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, n and box of what is drawn, in page units.

    ``objects``: doc, page, n, parent, kind, box and matrix (a to f) of forms. A form comes before what is in it. A box
    inside a form is in that form's units: it is carried out through the matrix of every enclosing form, innermost first.
    Things in more than DEEPEST forms, specks, full-page backgrounds and what lies in the header or footer are left out.
    ``pages``: doc, page, width, height.
    """
    kinds = dict(objects.dtypes)
    rows = objects.select("doc", "page", "n", "parent", "kind", *CORNERS, "matrix").repartition("doc", "page").sortWithinPartitions("doc", "page", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, forms = None, {}
        for batch in batches:
            out: list[tuple] = []
            for doc, page, n, parent, kind, *rect, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, page) != here:
                    here, forms = (doc, page), {None: ()}
                around_it = forms.get(parent)
                if around_it is None:
                    continue  # too deep, or in nothing that is known
                if kind == FORM:
                    if len(around_it) < DEEPEST:
                        forms[n] = (matrix, *around_it)
                elif kind in DRAWN:
                    out.append((doc, page, n, *carried_out(rect, around_it)))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, [*batch.schema.types[:3], *[pa.float64()] * 4])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "page", "n", *CORNERS])

    found = rows.mapInArrow(run, f"doc {kinds['doc']}, page {kinds['page']}, n {kinds['n']}, x0 double, y0 double, x1 double, y1 double")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    speck, whole = (w < SPECK) & (h < SPECK), w * h > PAGE_SHARE * F.col("width") * F.col("height")
    edge = (F.col("y0") > F.col("height") * HEADER) | (F.col("y1") < F.col("height") * FOOTER)
    return found.join(pages.select("doc", "page", "width", "height"), ["doc", "page"]).where(~speck & ~whole & ~edge).select("doc", "page", "n", *CORNERS)


def carried_out(rect: list[float], matrices: tuple) -> tuple[float, ...]:
    """The box around a box after each of some matrices (a, b, c, d, e, f)."""
    x0, y0, x1, y1 = rect
    for a, b, c, d, e, f in matrices:
        xs = [a * x + c * y + e for x in (x0, x1) for y in (y0, y1)]
        ys = [b * x + d * y + f for x in (x0, x1) for y in (y0, y1)]
        x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
    return x0, y0, x1, y1


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("num", T.IntegerType()), T.StructField("after", T.StringType())])))
def labels_of(texts: pd.Series) -> pd.Series:
    """Where a page's lines begin with the name of a figure or table, and what follows it."""
    label = re.compile(LABEL)

    def one(text: str) -> list[dict]:
        return [{"start": m.start(), "kind": "tbl" if m[1].lower().startswith("tab") else "fig", "num": int(m[2]), "after": text[m.end() : m.end() + AFTER]} for m in label.finditer(text or "") if len(m[2]) < 10]

    return texts.map(one)


def captions(pages: DataFrame) -> DataFrame:
    """doc, page, start, kind, num, caption, line and para: the captions of pages (doc, page, chars), with the box of their
    first line and that of the paragraph. ``chars``: an array of c (one character) and its box, in reading order."""
    text = F.array_join(F.transform("chars", lambda c: F.coalesce(F.nullif(c["c"], F.lit("")), F.lit(" "))), "")
    found = pages.select("doc", "page", "chars", text.alias("text")).select("*", F.explode(labels_of("text")).alias("m")).where(is_caption(F.col("m.after")))
    found = found.select("doc", "page", "m.*", F.trim(F.regexp_replace(F.substring("text", F.col("m.start") + 1, F.lit(ROUND_CAPTION)), r"\s+", " ")).alias("caption"), F.slice("chars", F.col("m.start") + 1, PARAGRAPH_CHARS).alias("chars"))
    found = found.withColumn("good", F.filter(F.slice("chars", 1, LINE_CHARS), lambda c: (c["x1"] > c["x0"]) & (c["y1"] > c["y0"]))).where(F.size("good") > 0)
    found = found.withColumn("first", F.get("good", F.lit(0))).withColumn("line", _first_line(F.col("first"), F.col("good"))).drop("good", "first")
    lines = baselines(found.select("doc", "page", "start", F.explode("chars").alias("c")).select("doc", "page", "start", "c.*"), "doc", "page", "start")
    lower_last = F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("down"), *CORNERS)))
    rows = found.drop("chars", "after").join(lines.groupBy("doc", "page", "start").agg(lower_last.alias("lines")), ["doc", "page", "start"])
    return rows.withColumn("para", _paragraph(F.col("line"), F.col("lines"))).drop("lines")


def _first_line(first: Column, chars: Column) -> Column:
    """The box around the characters on the baseline of the first one, up to a jump to another column."""
    state = F.struct(box(*[first[n] for n in CORNERS]).alias("box"), first["x1"].cast("double").alias("end"), F.lit(False).alias("over"))

    def step(s: Column, c: Column) -> Column:
        over = s["over"] | (F.abs(c["y0"] - first["y0"]) > LINE_DROP) | (c["x0"] - s["end"] > COLUMN_JUMP)
        return F.struct(F.when(over, s["box"]).otherwise(joined(s["box"], c)).alias("box"), F.when(over, s["end"]).otherwise(c["x1"].cast("double")).alias("end"), over.alias("over"))

    return F.aggregate(F.slice(chars, 2, LINE_CHARS), state, step, lambda s: s["box"])


def _paragraph(line: Column, lines: Column) -> Column:
    """The first line and those that follow closely below it in the same column."""
    height = F.greatest(line["y1"] - line["y0"], F.lit(LEAST_LINE))
    state = F.struct(line["y0"].alias("bottom"), F.lit(False).alias("over"))

    def step(s: Column, e: Column) -> Column:
        beneath = e["y1"] < s["bottom"] + 1
        far = beneath & (s["bottom"] - e["y1"] > height * LINE_GAP)
        aside = (e["x1"] < line["x0"] + SHARED) | (e["x0"] > line["x1"] - SHARED) | (e["x0"] < line["x0"] - LEFT_OUT) | (e["x1"] > line["x1"] + RIGHT_OUT)
        over = s["over"] | far
        return F.struct(F.when(~over & beneath & ~aside, e["y0"]).otherwise(s["bottom"]).alias("bottom"), over.alias("over"))

    bottom = F.aggregate(lines, state, step, lambda s: s["bottom"])
    return box(line["x0"], F.least(line["y0"], bottom), line["x1"], line["y1"])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in CORNERS]))
def grown(seeds: pd.Series, pools: pd.Series) -> pd.DataFrame:
    """The box around the seeds, grown over every box of the pool that lies within GAP above or below it and not far aside,
    until none is left; null without a seed. The order of the boxes doesn't matter."""
    out = []
    for seed, pool in zip(seeds, pools):
        if seed is None or not len(seed):
            out.append((None,) * 4)
            continue
        x0, y0, x1, y1 = _array(pool).T
        s = _array(seed)
        now = (*s[:, :2].min(0), *s[:, 2:].max(0))
        while True:
            near = (np.maximum(np.maximum(y0 - now[3], now[1] - y1), 0) <= GAP) & (np.minimum(x1, now[2]) - np.maximum(x0, now[0]) > SIDEWAYS)
            wider = (min([now[0], *x0[near]]), min([now[1], *y0[near]]), max([now[2], *x1[near]]), max([now[3], *y1[near]]))
            if wider == now:
                break
            now = wider
        out.append(tuple(map(float, now)))
    return pd.DataFrame(out, columns=list(CORNERS))


def _array(boxes: list) -> np.ndarray:
    return np.array([[b[n] for n in CORNERS] for b in boxes], float).reshape(-1, 4)


def regions(found: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, start, kind, num, caption, status, place and box of each caption (as of ``captions``).

    A figure is what is drawn above its caption, else a table-like frame below it. A table is framed by rules on the side
    of the nearest one, else on the other; else it is the lines of text next to the caption, else what is drawn above.
    status: ok, tiny or miss. ``pages``: doc, page, width, height, chars; ``graphics``: doc, page and boxes.
    """
    drawn = graphics.groupBy("doc", "page").agg(F.collect_list(F.struct(*CORNERS)).alias("boxes"))
    others = found.groupBy("doc", "page").agg(F.collect_list("para").alias("captions"))
    rows = found.join(pages.select("doc", "page", "width", "height"), ["doc", "page"]).join(drawn, ["doc", "page"], "left").join(others, ["doc", "page"])
    p, h = F.col("para"), F.col("height")
    rows = rows.withColumn("boxes", F.coalesce("boxes", F.array().cast(f"array<{BOX}>"))).withColumn("near", nearby(p, F.col("boxes")))
    rows = rows.withColumn("beside", around(F.col("near"))).withColumn("column", _column(F.col("line"), F.col("beside"), F.col("width")))
    rows = rows.withColumn("mine", F.filter("boxes", lambda g: _in_column(g, F.col("column")))).drop("boxes", "near", "beside")
    rows = rows.withColumn("pool", F.filter("mine", lambda g: g["y0"] >= p["y1"] - UNDER_CAPTION)).withColumn("seed", F.filter("pool", lambda g: g["y0"] - p["y1"] <= ABOVE))
    rows = rows.withColumn("above", grown("seed", "pool")).drop("seed", "pool")
    rows = rows.withColumn("above", F.when(F.col("above.x0").isNotNull(), box(F.col("above.x0"), F.greatest(F.col("above.y0"), p["y1"] + 1), F.col("above.x1"), F.col("above.y1"))))
    rows = rows.withColumn("rules", F.filter("mine", lambda g: (g["y1"] - g["y0"] < RULE_HEIGHT) & (g["x1"] - g["x0"] > RULE_WIDTH))).drop("mine")
    floor = F.coalesce(F.array_max(F.transform(F.filter("captions", lambda c: c["y1"] < p["y0"] - 2), lambda c: c["y1"])), F.lit(0.0))
    ceiling = F.coalesce(F.array_min(F.transform(F.filter("captions", lambda c: c["y0"] > p["y1"] + 2), lambda c: c["y0"])), h.cast("double"))
    rows = rows.withColumns({"floor": floor, "ceiling": ceiling, "side": _nearest_side(F.col("rules"), p)})
    rows = _with_span(_with_span(rows, "down"), "up").drop("rules", "captions")
    rows = _with_text(materialize(rows, "caption-frames"), pages)  # read twice; and conditions on it shall not repeat its making
    side, down, up, text_down, text_up = (F.col(c) for c in ("side", "down", "up", "text_down", "text_up"))
    first, other = F.when(side == "below", down).otherwise(up), F.when(side == "below", up).otherwise(down)
    text = F.when(side == "below", F.coalesce(text_down, text_up)).otherwise(F.coalesce(text_up, text_down))
    other_side = F.when(side == "below", "above").otherwise("below")
    figure = F.col("kind") == "fig"
    chosen = F.when(figure, F.coalesce(F.col("above"), down)).otherwise(F.coalesce(first, other, text, F.col("above")))
    place = F.when(figure, F.when(F.col("above").isNotNull(), "above").when(down.isNotNull(), "flip")).otherwise(F.when(first.isNotNull(), side).when(other.isNotNull(), other_side).when(text.isNotNull(), "text").when(F.col("above").isNotNull(), "graphics"))
    rows = rows.select("doc", "page", "start", "kind", "num", "caption", "width", "height", chosen.alias("b"), place.alias("place"), "column")
    left, right = F.when(figure, F.col("column.c0")).otherwise(F.least("column.c0", F.col("b.x0") - 2)), F.when(figure, F.col("column.c1")).otherwise(F.greatest("column.c1", F.col("b.x1") + 2))
    framed = box(F.greatest(left, F.col("b.x0") - MARGIN), F.greatest(F.lit(0.0), F.col("b.y0") - MARGIN), F.least(right, F.col("b.x1") + MARGIN), F.least(F.col("height").cast("double"), F.col("b.y1") + MARGIN))
    rows = rows.withColumn("box", F.when(F.col("b").isNotNull(), framed))
    small = (F.col("box.x1") - F.col("box.x0") < LEAST_WIDTH) | (F.col("box.y1") - F.col("box.y0") < LEAST_HEIGHT)
    return rows.withColumn("status", F.when(F.col("b").isNull(), "miss").when(small, "tiny").otherwise("ok")).select("doc", "page", "start", "kind", "num", "caption", "status", "place", "box")


def first_good(found: DataFrame) -> DataFrame:
    """Of each document's kind and number the first region that is ok, by page and place, with its rank by kind and number."""
    best = found.where("status = 'ok'").groupBy("doc", "kind", "num").agg(F.min_by(F.struct("page", "start", "caption", "place", "box"), F.struct("page", "start")).alias("best"))
    return best.select("doc", "kind", "num", F.row_number().over(Window.partitionBy("doc").orderBy("kind", "num")).alias("rank"), "best.*")


def nearby(para: Column, boxes: Column) -> Column:
    """The boxes that begin shortly above a caption or end shortly below it."""
    return F.filter(boxes, lambda g: (g["y0"] - para["y1"]).between(0, ABOVE) | (para["y0"] - g["y1"]).between(0, BELOW))


def _column(line: Column, beside: Column, width: Column) -> Column:
    """The part of the page's width that a caption stands for: a column, or all if the graphics ``beside`` it are wide."""
    narrow = line["x1"] - line["x0"] < WIDE * width
    left, right = narrow & (line["x1"] < LEFT_SIDE * width), narrow & (line["x0"] > RIGHT_SIDE * width)
    spread = F.coalesce(beside["x1"] - beside["x0"] > WIDE * width, F.lit(False))
    c0, c1 = F.when(~spread & right & ~left, width / 2 - GUTTER).otherwise(0.0), F.when(~spread & left, width / 2 + GUTTER).otherwise(width)
    return F.struct(c0.cast("double").alias("c0"), c1.cast("double").alias("c1"))


def _in_column(g: Column, column: Column) -> Column:
    return F.least(g["x1"], column["c1"]) - F.greatest(g["x0"], column["c0"]) > 0.5 * F.greatest(g["x1"] - g["x0"], F.lit(1.0))


def _first_by(boxes: Column, key: Callable[[Column], Column]) -> Column:
    """Of some boxes the one with the smallest key; null for none."""
    return F.array_min(F.transform(boxes, lambda g: F.struct(key(g).alias("key"), *[g[n].alias(n) for n in CORNERS])))


def _with_span(rows: DataFrame, way: str) -> DataFrame:
    """``rows`` with the box from the rule next ``down`` or ``up`` of a caption to the last rule of about its width, before
    the next caption; null if it isn't two rules or LEAST_HEIGHT high."""
    p, h, rule, whole = F.col("para"), F.col("height"), F.col("rule"), F.col("whole")
    if way == "down":
        near = lambda r: (p["y0"] - r["y1"]).between(0, RULE_REACH) & (r["y1"] > F.col("floor"))
        further = lambda r: (r["y1"] <= rule["y1"] + 0.5) & (r["y1"] > F.col("floor")) & (rule["y1"] - r["y1"] <= TABLE_SHARE * h)
        found = box(whole["x0"], whole["y0"], whole["x1"], F.least(rule["y1"], p["y0"] - 1))
    else:
        near = lambda r: (r["y0"] - p["y1"]).between(0, RULE_REACH) & (r["y0"] < F.col("ceiling"))
        further = lambda r: (r["y0"] >= rule["y0"] - 0.5) & (r["y0"] < F.col("ceiling")) & (r["y0"] - rule["y0"] <= TABLE_SHARE * h)
        found = box(whole["x0"], F.greatest(rule["y0"], p["y1"] + 1), whole["x1"], whole["y1"])
    rows = rows.withColumn("rule", _first_by(F.filter("rules", near), lambda r: -r["y1"] if way == "down" else r["y0"])).withColumn("wide", rule["x1"] - rule["x0"])
    rows = rows.withColumn("group", F.filter("rules", lambda r: further(r) & (F.abs(r["x1"] - r["x0"] - F.col("wide")) <= RULE_LIKE * F.col("wide"))))
    rows = rows.withColumn("whole", around(F.col("group"))).withColumn(way, found)
    return rows.withColumn(way, F.when((F.size("group") >= 2) & (F.col(f"{way}.y1") - F.col(f"{way}.y0") >= LEAST_HEIGHT), F.col(way))).drop("rule", "wide", "group", "whole")


def _nearest_side(rules: Column, para: Column) -> Column:
    down = F.array_min(F.filter(F.transform(rules, lambda r: para["y0"] - r["y1"]), lambda d: d.between(0, RULE_REACH)))
    up = F.array_min(F.filter(F.transform(rules, lambda r: r["y0"] - para["y1"]), lambda d: d.between(0, RULE_REACH)))
    return F.when(up.isNull() | (down <= up), "below").otherwise("above")


def _with_text(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` with text_down and text_up: the lines of text next to a table's caption, up to a wide gap. Only tables that
    no rules frame are looked at."""
    keys = ["doc", "page", "start"]
    bare = rows.where("kind = 'tbl' AND down IS NULL AND up IS NULL").select(*keys, "column", "para", "floor", "ceiling")
    chars = bare.join(pages.select("doc", "page", "chars"), ["doc", "page"]).select(*keys, "column", F.explode("chars").alias("c")).where(_in_column(F.col("c"), F.col("column")))
    lines = baselines(chars.select(*keys, "c.*"), *keys).groupBy(*keys).agg(F.collect_list(F.struct(*CORNERS)).alias("lines"))
    p = F.col("para")
    step = F.greatest(p["y1"] - p["y0"], F.lit(LEAST_BLOCK_LINE)) * BLOCK_GAP
    under = F.array_sort(F.transform(F.filter("lines", lambda e: (e["y1"] <= p["y0"] + 1) & (e["y1"] > F.col("floor"))), lambda e: F.struct((-e["y0"]).alias("key"), *[e[n].alias(n) for n in CORNERS])))
    over = F.array_sort(F.transform(F.filter("lines", lambda e: (e["y0"] >= p["y1"] - 1) & (e["y0"] < F.col("ceiling"))), lambda e: F.struct(e["y0"].alias("key"), *[e[n].alias(n) for n in CORNERS])))
    found = bare.join(lines, keys).select(*keys, _run(under, p["y0"], step, "y0", lambda edge, e: edge - e["y1"]).alias("text_down"), _run(over, p["y1"], step, "y1", lambda edge, e: e["y0"] - edge).alias("text_up"))
    return rows.join(found, keys, "left")


def _run(lines: Column, edge: Column, most: Column, end: str, gap: Callable[[Column, Column], Column]) -> Column:
    """The box around lines in order, until one is too far from the one before."""
    nothing = F.lit(None).cast(BOX)
    state = F.struct(nothing.alias("box"), edge.cast("double").alias("edge"), F.lit(False).alias("over"))

    def step(s: Column, e: Column) -> Column:
        over = s["over"] | (gap(s["edge"], e) > most)
        wider = F.when(s["box"].isNull(), box(*[e[n] for n in CORNERS])).otherwise(joined(s["box"], e))
        return F.struct(F.when(over, s["box"]).otherwise(wider).alias("box"), F.when(over, s["edge"]).otherwise(e[end].cast("double")).alias("edge"), over.alias("over"))

    return F.aggregate(lines, state, step, lambda s: F.when(s["box"]["y1"] - s["box"]["y0"] >= LEAST_HEIGHT, s["box"]))
