"""Captions and regions on small pages, growth against a plain loop."""

from __future__ import annotations

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import page_regions as ops

OBJECTS = "doc string, page int, n int, parent int, kind int, x0 double, y0 double, x1 double, y1 double, matrix array<double>"
PAGE = "doc string, page int, width double, height double, chars array<struct<c: string, x0: double, y0: double, x1: double, y1: double>>"
GRAPHIC = "doc string, page int, x0 double, y0 double, x1 double, y1 double"


def laid(x: float, y: float, text: str) -> list[tuple]:
    """A line of characters, five wide and eight high, and a line break without extent."""
    return [(c, x + 5.0 * k, float(y), x + 5.0 * k + 5, y + 8.0) for k, c in enumerate(text)] + [("\n", 0.0, 0.0, 0.0, 0.0)]


def test_a_picture_in_a_scaled_form(spark):
    form = ("d", 1, 1, None, 5, 100.0, 300.0, 500.0, 500.0, [0.4, 0.0, 0.0, 0.4, 100.0, 300.0])
    rows = [form, ("d", 1, 2, 1, 3, 0.0, 0.0, 1000.0, 500.0, None), ("d", 1, 3, None, 2, 0.0, 780.0, 600.0, 781.0, None)]
    rows += [("d", 1, 4, None, 2, 10.0, 100.0, 11.0, 101.0, None), ("d", 1, 5, None, 3, 0.0, 0.0, 600.0, 800.0, None), ("d", 1, 6, None, 1, 10.0, 100.0, 90.0, 120.0, None)]
    # a quarter turn, and a chain of forms that is too deep
    rows += [("d", 2, 1, None, 5, 0.0, 0.0, 1.0, 1.0, [0.0, 1.0, -1.0, 0.0, 300.0, 200.0]), ("d", 2, 2, 1, 2, 10.0, 20.0, 110.0, 60.0, None)]
    rows += [("d", 3, k, k - 1 or None, 5, 0.0, 0.0, 1.0, 1.0, [1.0, 0.0, 0.0, 1.0, 1.0, 0.0]) for k in range(1, 15)]
    rows += [("d", 3, 20 + k, k, 3, 100.0, 100.0, 200.0, 200.0, None) for k in (11, 12, 13)]
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2, 3)], "doc string, page int, width double, height double")
    got = {(r.page, r.n): (r.x0, r.y0, r.x1, r.y1) for r in ops.leaf_graphics(spark.createDataFrame(rows, OBJECTS), pages).collect()}
    assert got == {(1, 2): (100, 300, 500, 500), (2, 2): (240, 210, 280, 310), (3, 31): (111, 100, 211, 200), (3, 32): (112, 100, 212, 200)}


@pytest.mark.parametrize("after, caption", [(": Parameters", True), ("\r\nSummary of methods", True), (". The whole", True), (" Overview", True), (" (a) left", True), (" lists the results", False), (" shows it", False), (", and Table 3", False), (" is it", False), (" or", False), (" lower case", False), ("", False)])
def test_captions_and_sentences(spark, after, caption):
    assert spark.range(1).select(ops.is_caption(F.lit(after)).alias("c")).first().c is caption


@pytest.fixture(scope="module")
def pages(spark):
    """A figure in the left column, a ruled table in the right one, a table without rules, and a caption alone."""
    first = laid(60, 400, "Figure 1: A long caption") + laid(60, 390, "that goes on") + laid(60, 300, "and the body") + laid(330, 600, "Table 2. Results here") + laid(60, 200, "Figure 1 shows a model") + laid(60, 150, "Table 7 is not one")
    second = laid(60, 700, "Table 3: Without any rule") + [c for y in (680, 665, 650) for c in laid(60, y, "a b c d e f g h i j k l m n o p q r")] + laid(60, 500, "far away text") + laid(60, 100, "Figure 9. Nothing is near")
    return spark.createDataFrame([("d", 1, 600.0, 800.0, first), ("d", 2, 600.0, 800.0, second), ("d", 3, 600.0, 800.0, [])], PAGE)


def test_captions_of_pages(pages):
    rows = {(r.page, r.kind, r.num): r for r in ops.captions(pages).collect()}
    assert set(rows) == {(1, "fig", 1), (1, "tbl", 2), (2, "tbl", 3), (2, "fig", 9)}
    one = rows[1, "fig", 1]
    assert tuple(one.line) == (60, 400, 60 + 5 * 24, 408) and tuple(one.para) == (60, 390, 180, 408)
    assert one.caption.startswith("Figure 1: A long caption that goes on and the body")


def test_regions(spark, pages):
    graphics = [("d", 1, 70.0, 420.0, 200.0, 480.0), ("d", 1, 80.0, 495.0, 190.0, 560.0), ("d", 1, 80.0, 700.0, 190.0, 760.0)]
    graphics += [("d", 1, 330.0, y, 560.0, y + 0.5) for y in (585.0, 560.0, 500.0)] + [("d", 1, 330.0, 450.0, 400.0, 450.5)]
    found = ops.regions(ops.captions(pages), spark.createDataFrame(graphics, GRAPHIC), pages)
    got = {(r.kind, r.num): (r.status, r.place, r.box and tuple(r.box)) for r in found.collect()}
    assert got["fig", 1] == ("ok", "above", (65, 415, 205, 565))  # the third picture is too far above the second
    assert got["tbl", 2] == ("ok", "below", (325, 495, 565, 590.5))  # the last rule has another width
    assert got["tbl", 3] == ("ok", "text", (55, 645, 240, 693))
    assert got["fig", 9] == ("miss", None, None)
    best = ops.first_good(found.unionByName(found.withColumn("page", F.lit(9)))).orderBy("rank").collect()
    assert [(r.kind, r.num, r["rank"], r.page) for r in best] == [("fig", 1, 1, 1), ("tbl", 2, 2, 1), ("tbl", 3, 3, 2)]


def test_a_short_caption_over_wide_graphics_spans_the_page(spark, pages):
    wide = spark.createDataFrame([("d", 1, 70.0, 420.0, 560.0, 480.0)], GRAPHIC)
    found = ops.regions(ops.captions(pages), wide, pages).where("kind = 'fig' AND page = 1").first()
    assert tuple(found.box) == (65, 415, 565, 485)


def test_no_pages(spark, pages):
    none = pages.limit(0)
    assert ops.regions(ops.captions(none), spark.createDataFrame([], GRAPHIC), none).count() == 0


def test_growth_equals_a_plain_loop(spark):
    rnd = Random(4)
    cases = []
    for n in range(40):
        pool = [(x := rnd.uniform(0, 300), y := rnd.uniform(0, 900), x + rnd.uniform(1, 60), y + rnd.uniform(1, 30)) for _ in range(rnd.randrange(0, 60))]
        cases.append((n, [p for p in pool if p[1] < 60], pool))
    frame = spark.createDataFrame(cases, f"n int, seed array<{ops.BOX}>, pool array<{ops.BOX}>")
    for row, (_, seed, pool) in zip(frame.select("n", ops.grown("seed", "pool").alias("b")).orderBy("n").collect(), cases):
        want = tuple(f(p[k] for p in seed) for k, f in enumerate((min, min, max, max))) if seed else None
        again = bool(seed)
        while again:
            again = False
            for g in pool:
                if max(g[1] - want[3], want[1] - g[3], 0) <= 20 and min(g[2], want[2]) - max(g[0], want[0]) > -20:
                    wider = (min(want[0], g[0]), min(want[1], g[1]), max(want[2], g[2]), max(want[3], g[3]))
                    again |= wider != want
                    want = wider
        assert (want is None and row.b.x0 is None) or np.allclose(tuple(row.b), want)
