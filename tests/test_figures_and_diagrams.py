"""Figures and diagrams on small literal tables."""

from __future__ import annotations

import base64

import pytest

from marginalia.operators import diagrams, figures

URI = "data:image/png;base64," + base64.b64encode(b"\x89PNG").decode()


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        ("p", "fig1", "Figure 1", "image", "overview", URI, 0),
        ("p", "fig2", "Figure 2", "image", "overview", URI, 1),
        ("p", "tbl1", "Table 1", "table", "overview", "", 2),
        ("p", "fig9", "Figure 9", "image", "elsewhere", URI, 3),
    ]
    return spark.createDataFrame(rows, "slug string, id string, label string, kind string, ref_in_section string, data_uri string, pos int")


def test_placement(spark, four):
    body = "First.\n\nSee Figure 1 and Table 2.\n\nLast."
    sections = spark.createDataFrame([("p", "2-1-overview"), ("p", "3-end")], "slug string, section_id string")
    mine = figures.of_sections(sections, four)
    assert [(r.section_id, r.id) for r in mine.orderBy("pos").collect()] == [("2-1-overview", "fig1"), ("2-1-overview", "fig2")]
    bodies = spark.createDataFrame([("p", "2-1-overview", body, body)], "slug string, section_id string, body string, text string")
    out = figures.placed(bodies, mine).first().body
    assert out == "First.\n\nSee Figure 1 and Table 2.\n\n![Figure 1](/paper/p/fig/fig1)\n\nLast.\n\n![Figure 2](/paper/p/fig/fig2)"
    again = spark.createDataFrame([("p", "2-1-overview", out, out)], bodies.schema)
    assert figures.placed(again, mine).first().body == out


def test_a_table_of_the_same_number_is_no_mention(spark):
    bodies = spark.createDataFrame([("p", "s", "Figure 3 here.\n\nend", "")], "slug string, section_id string, body string, text string")
    tables = spark.createDataFrame([("p", "s", "tbl3", "Table 3", 0)], "slug string, section_id string, id string, label string, pos int")
    assert figures.placements(bodies, tables).first().paragraph is None


def test_union_by_id(spark):
    html = spark.createDataFrame([("p", f"fig{i}", "image", "html") for i in (2, 3)], "slug string, id string, kind string, source string")
    pdf = spark.createDataFrame([("p", f"fig{i}", "image", "pdf") for i in (1, 2, 5, 13)], html.schema)
    rows = figures.union_by_id(html, pdf).orderBy("rank").collect()
    assert [(r.id, r.source) for r in rows] == [("fig1", "pdf"), ("fig2", "html"), ("fig3", "html"), ("fig5", "pdf"), ("fig13", "pdf")]


def test_headings_references_and_orphans(spark, four):
    shown = spark.createDataFrame([("p", "![a](/paper/p/fig/fig1) x ![b](/fig/fig2) ![c](/fig/fig1)")], "slug string, text string")
    assert [r.id for r in figures.references(shown).orderBy("pos").collect()] == ["fig1", "fig2"]
    assert {r.id for r in figures.orphans(shown, four).collect()} == {"tbl1", "fig9"}
    web = spark.createDataFrame([("p", "a", " Set  Up "), ("p", "b", "Results"), ("p", "c", "None")], "slug string, id string, section_heading string")
    heads = spark.createDataFrame([("p", "Set up", 4), ("p", "Results", 9), ("p", "set UP", 7)], "slug string, heading string, line_no int")
    assert {(r.id, r.line_no) for r in figures.by_heading(web, heads).collect()} == {("a", 4), ("b", 9), ("c", None)}


def test_labels(spark):
    rows = [("p", 0, "image", "Figure 3: x"), ("p", 1, "image", "no number"), ("p", 2, "table", "TABLE IV y"), ("p", 3, "table", ""), ("p", 4, "image", "other")]
    frame = spark.createDataFrame(rows, "slug string, pos int, kind string, caption string")
    got = [(r.label, r.id) for r in figures.auto_labelled(frame).orderBy("pos").collect()]
    assert got == [("Figure 3", "fig3"), ("Image (auto 1)", "figauto1"), ("Table IV", "tbliv"), ("Table (auto 1)", "tblauto1"), ("Image (auto 2)", "figauto2")]


def test_images_are_lifted_once(spark):
    other = "data:image/png;base64," + base64.b64encode(b"other").decode()
    docs = spark.createDataFrame([("p", f"![]({URI}) ![]({other}) ![]({URI})")], "slug string, text string")
    none = spark.createDataFrame([], "slug string, id string, data_uri string")
    first = figures.lifted_images(docs, none)
    assert [(r.id, r.data_uri) for r in first.orderBy("id").collect()] == [("paste1", URI), ("paste2", other)]
    known = spark.createDataFrame([("p", "paste1", URI)], none.schema)
    assert [(r.id, r.data_uri) for r in figures.lifted_images(docs, known).collect()] == [("paste2", other)]
    assert bytes(first.select(figures.bytes_of(first.data_uri).alias("b")).first().b) in (b"\x89PNG", b"other")


def svg(*shapes: str) -> str:
    return '<svg viewBox="0 0 400 200">' + "".join(shapes) + "</svg>"


BOX = '<rect x="20" y="20" width="100" height="60"/>'
FAR = '<rect x="260" y="20" width="100" height="60"/>'
CASES = {
    "clean": (svg(BOX, '<text x="70" y="50" text-anchor="middle" font-size="12">short</text>'), set()),
    "overflow": (svg('<rect x="150" y="20" width="100" height="60"/>', '<text x="200" y="50" text-anchor="middle" font-size="14">a label much too long here</text>'), {"TEXT_OVERFLOW"}),
    "clip": (svg('<text x="380" y="150" font-size="14">outside</text>'), {"TEXT_CLIPPED"}),
    "overlap": (svg('<text x="50" y="150" font-size="14">one text</text><text x="60" y="152" font-size="14">other</text>'), {"TEXT_OVERLAP"}),
    "wedged": (svg(BOX, '<text x="100" y="100" font-size="14">beside</text>', '<text x="0" y="50" font-size="14">runs in</text>'), {"TEXT_OVER_BOX"}),
    "dangling": (svg(BOX, '<line x1="120" y1="50" x2="200" y2="50" marker-end="url(#a)"/>'), {"DANGLING_ARROW"}),
    "pointed": (svg(BOX, FAR, '<line x1="120" y1="50" x2="258" y2="50" marker-end="url(#a)"/>'), set()),
    "axis": (svg('<line x1="10" y1="190" x2="390" y2="190" marker-end="url(#a)"/>'), set()),
    "through": (svg('<rect x="10" y="80" width="40" height="40"/>', '<rect x="150" y="60" width="80" height="80"/>', '<rect x="340" y="80" width="40" height="40"/>', '<line x1="50" y1="100" x2="340" y2="100" marker-end="url(#a)"/>'), {"EDGE_THROUGH_BOX"}),
    "guide": (svg('<rect x="150" y="60" width="80" height="80"/>', '<line x1="20" y1="100" x2="340" y2="100"/>'), set()),
}


def test_lint(spark):
    frame = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "key string, svg string")
    found = {k: set() for k in CASES}
    for r in diagrams.lint(frame).collect():
        found[r.key].add(r.code)
    assert found == {k: v[1] for k, v in CASES.items()}


def test_diagrams_are_numbered(spark):
    report = spark.createDataFrame([("p", CASES["clean"][0] + "<p>" + CASES["clip"][0])], "slug string, html string")
    assert {(r.key, r.code) for r in diagrams.lint(diagrams.diagrams_of(report)).collect()} == {("p#2", "TEXT_CLIPPED")}


ARROWED = '<style>.f{fill:none;marker-end:url(#a)}</style>'
DRAWN = {
    "sized by a class": (svg("<style>.ts{font-size:10px;text-anchor:middle}</style>", '<rect x="20" y="30" width="150" height="62"/><text class="ts" x="95" y="74">one hundred and thirteen</text>'), set()),
    "without the class": (svg('<rect x="20" y="30" width="150" height="62"/><text text-anchor="middle" x="95" y="74">one hundred and thirteen</text>'), {"TEXT_OVERFLOW"}),
    "path into nowhere": (svg(ARROWED, BOX, '<path class="f" d="M120 50 h30 q20 0 30 60"/>'), {"DANGLING_ARROW"}),
    "path around a box": (svg(ARROWED, BOX, FAR, '<rect x="150" y="30" width="60" height="40"/><path class="f" d="M70 80 v60 H300 V82"/>'), set()),
    "path through a box": (svg(ARROWED, BOX, FAR, '<rect x="150" y="30" width="60" height="40"/><path class="f" d="M120 50 h20 H258"/>'), {"EDGE_THROUGH_BOX"}),
    "curve over a box": (svg(ARROWED, BOX, FAR, '<rect x="150" y="30" width="60" height="40"/><path class="f" d="M120 50 C 130 50 200 50 258 50"/>'), set()),
    "filled path": (svg(BOX, '<path marker-end="url(#a)" d="M120 50 h80"/>'), set()),
    "shifted group": (svg('<g transform="translate(200,0)"><g transform="translate(150)"><text x="40" y="50" font-size="14">outside</text></g></g>'), {"TEXT_CLIPPED"}),
    "rotated group": (svg('<g transform="rotate(4)"><text x="390" y="50" font-size="14">outside</text></g>'), set()),
    "backdrop": (svg('<rect x="5" y="5" width="180" height="150"/>', BOX, '<text x="70" y="120" font-size="12">wider than the box above</text>'), set()),
    "equal boxes": (svg(BOX, BOX, '<text x="30" y="50" font-size="16">much too long for it</text>'), {"TEXT_OVERFLOW"}),
    "polyline": (svg(BOX, '<polyline points="120,50 160,50 160,150" marker-end="url(#a)"/>'), {"DANGLING_ARROW"}),
    "not well formed": (svg("<g>", '<text x="390" y="50">outside</text>'), set()),
    "empty": ("", set()),
    "null": (None, set()),
}


def test_lint_of_nested_diagrams(spark):
    frame = spark.createDataFrame([(k, v[0]) for k, v in DRAWN.items()], "key string, svg string")
    found = {k: set() for k in DRAWN}
    for r in diagrams.lint(frame).collect():
        found[r.key].add(r.code)
    assert found == {k: v[1] for k, v in DRAWN.items()}


@pytest.mark.parametrize(
    "path, points",
    [
        ("M10 10h5v5l-5,0z", [(10, 10), (15, 10), (15, 15), (10, 15), (10, 10)]),
        ("m1 1 2 2 3-3 M9 9L8 8", [(1, 1), (3, 3), (6, 0)]),
        ("M.5.5L1 2 3", [(0.5, 0.5), (1, 2)]),
        ("M0 0X5 5", [(0, 0)]),
        ("M0 0A5 5 0 0 1 10 10 20 20", [(0, 0), (10, 10)]),
        ("M1 1zz5", [(1, 1), (1, 1), (1, 1)]),
        ("5 5", []),
        ("", []),
    ],
)
def test_path_vertices(path, points):
    from marginalia.functions.svg import path_vertices

    assert path_vertices(path)[0] == points


def test_lines_of_a_text(spark):
    svgs = [("k", svg('<g font-size="10" transform="translate(3 4)"><text x="1" y="2">a<tspan x="3" dy="1.2em">b <tspan>c</tspan></tspan>tail<tspan dy="2">d</tspan></text><text x="5" y="6">p<tspan>q</tspan>r</text><text> </text></g>'))]
    rows = diagrams.shapes(spark.createDataFrame(svgs, "key string, svg string")).where("kind = 'text'").orderBy("n").collect()
    assert [(r.s, r.ax, round(r.ay, 6), r["size"]) for r in rows] == [("a", 4, 6, 10), ("b c", 6, 18, 10), ("d", 6, 20, 10), ("pqr", 8, 10, 10)]
