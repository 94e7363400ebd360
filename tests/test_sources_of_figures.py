"""Archives, style sheets and colours against their definitions."""

from __future__ import annotations

import io
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions import colors, css
from marginalia.sources import archives


def packed(files: list[tuple[str, bytes]], mode: str = "w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, content in files:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("folder.png")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    return out.getvalue()


FILES = [("a/Main.TEX", b"\\x \xff"), ("a/fig.png", b"1" * 5000), ("readme", b"r"), ("b.pdf", b"22")]
WHOLE = packed(FILES)
ARCHIVES = {"plain": WHOLE, "packed": packed(FILES, "w:gz"), "cut": WHOLE[:3000], "text": b"no archive at all" * 100, "empty": b"", "null": None, "nothing": packed([])}


def test_members(spark):
    frame = spark.createDataFrame(list(ARCHIVES.items()), "path string, content binary")
    rows = archives.members(frame).collect()
    named = {k: [(r.n, r.name, r["size"], r.content and bytes(r.content)) for r in rows if r.archive == k and r.name] for k in ARCHIVES}
    errors = {r.archive for r in rows if r.error}
    good = [(0, "a/Main.TEX", 4, b"\\x \xff"), (1, "a/fig.png", 5000, None), (2, "b.pdf", 2, None)]
    assert named["plain"] == named["packed"] == good
    assert named["cut"][:1] == good[:1] and named["text"] == named["empty"] == named["null"] == named["nothing"] == []
    assert errors == {"cut", "text", "empty", "null"}
    assert [r.name for r in archives.members(frame.where("path = 'plain'"), endings=(".pdf",), contents=(".pdf",)).collect()] == ["b.pdf"]
    assert archives.members(frame.limit(0)).count() == 0


def test_archives_of_a_folder(spark, tmp_path):
    (tmp_path / "one.tar.gz").write_bytes(ARCHIVES["packed"])
    (tmp_path / "two.tar").write_bytes(ARCHIVES["cut"])
    rows = archives.members(archives.archives(spark, str(tmp_path))).collect()
    assert {(r.archive.rsplit("/", 1)[1], r.name) for r in rows if r.name} >= {("one.tar.gz", "b.pdf"), ("two.tar", "a/Main.TEX")}


def test_figures_of_latex(spark):
    tex = r"""\begin{figure}[t]\includegraphics[width=\x]{ one }\includegraphics{two}\caption[short]{Fig. 3b: \emph{A nested one}
      and \cite{x} more}\end{figure}\begin{figure*}\includegraphics{a/b/three.pdf}\end{figure*}\begin{figure}\caption{none}\end{figure}\includegraphics{outside}"""
    rows = spark.createDataFrame([("x", 0, "m.tex", tex.encode()), ("x", 1, "n.tex", b"\\begin{figure}\\includegraphics{four}\\caption{" + b"long " * 20_000 + b"}\\end{figure}"), ("x", 2, "p.png", None), ("y", 0, "m.tex", None)], "archive string, n int, name string, content binary")
    got = archives.figures(rows).orderBy("pos").collect()
    assert [(r.pos, r.graphic, r.caption[:40]) for r in got] == [(1, "one", "Fig. 3b: A nested one and x more"), (2, "a/b/three.pdf", ""), (3, "four", ("long " * 8)[:40])]
    named = archives.labelled(got and archives.figures(rows).withColumn("name", F.when(F.col("pos") != 2, F.lit("f.png")).otherwise("f.eps")))
    assert [(r.pos, r.label, r.id) for r in named.orderBy("pos").collect()] == [(1, "Fig 3b", "fig3b"), (3, "Figure 2", "fig2")]


def chosen(graphic: str, names: list[str]) -> str | None:
    """The first candidate, in order, that any image answers to."""
    base = lambda p: p.rsplit("/", 1)[-1]
    images = [n for n in names if n.lower().endswith(archives.IMAGES)]
    tries = [head + graphic + end for end in ("", *archives.IMAGES) for head in ("", "./")]
    tries += [n for n in images if base(n).startswith(base(graphic))]
    return next((n for c in tries for n in images if n == c or n.endswith("/" + c) or base(n) == c), None)


def test_matching_equals_trying_one_after_the_other(spark):
    rnd = random.Random(8)
    parts, ends = ["a", "ab", "abc", "b", "img", "."], ["", ".png", ".pdf", ".jpg", ".eps", ".txt", ".PNG"]
    path = lambda: "/".join(rnd.choices(parts, k=rnd.randrange(1, 3))) + rnd.choice(ends)
    members = {f"x{k}": list(dict.fromkeys(path() for _ in range(12))) for k in range(30)}
    wanted = [(k, i + 1, path()) for k in members for i in range(6)]
    have = spark.createDataFrame([(k, n, name) for k, names in members.items() for n, name in enumerate(names)], "archive string, n int, name string")
    got = {(r.archive, r.pos): r.name for r in archives.matched(spark.createDataFrame(wanted, "archive string, pos int, graphic string"), have).collect()}
    want = {(k, pos): chosen(graphic, members[k]) for k, pos, graphic in wanted}
    assert got == want and sum(v is not None for v in want.values()) > 40


def plain_blocks(text: str) -> list[tuple]:
    """Bracket by bracket, after strings and comments are blanked."""
    blank = re.sub(r"""/\*.*?(?:\*/|$)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", lambda m: " " * len(m[0]), text, flags=re.S)
    out, opened = [], []
    for i, c in enumerate(blank):
        if c == "{":
            opened.append((i + 1, len(opened)))
        elif c == "}" and opened:
            out.append((*opened.pop(), i))
    return sorted(out)


def test_style_blocks_equal_a_plain_scan():
    rnd = random.Random(2)
    pieces = ["a", "{", "}", ";", "'", '"', "/*", "*/", "\\", "\n", " ", "{}", ":root"]
    for _ in range(3000):
        text = "".join(rnd.choices(pieces, k=rnd.randrange(0, 40)))
        assert [(start, depth, stop) for _, depth, start, stop in css.scan(text)] == plain_blocks(text)


SHEETS = {
    "<style>@media (prefers-color-scheme: dark) {:root{--a:1} p{color:red}}</style>": "<style>@media all {html[data-theme='dark']{--a:1} p{color:red}}</style>",
    "@media (prefers-color-scheme:light){ :root {a:b}\n:root{c:d} }x{}": "@media all {html[data-theme='light']{a:b}html[data-theme='light']{c:d} }x{}",
    "@media print{:root{a:b}}": "@media print{:root{a:b}}",
    "a{}@media (prefers-color-scheme: dark){p{}": "a{}@media (prefers-color-scheme: dark){p{}",
    "@media (prefers-color-scheme: dark){p::after{content:'}'}q{}}z": "@media all {p::after{content:'}'}q{}}z",
    "": "",
}


def test_schemes_become_an_attribute(spark):
    frame = spark.createDataFrame([(k,) for k in SHEETS] + [(None,)], "html string")
    got = {r.html: r.out for r in frame.select("html", css.retargeted(F.col("html")).alias("out")).collect()}
    assert got == SHEETS | {None: None}


@pytest.mark.parametrize(
    "text, behind, need, result",
    [
        ("rgb(0, 0, 0)", "rgb(255, 255, 255)", 4.5, (0, 0, 0, False)),
        ("rgb(200, 200, 200)", "rgb(255, 255, 255)", 4.5, (100, 100, 100, True)),
        ("rgba(200, 200, 200, 0.5)", "rgb(255, 255, 255)", 3.0, (140, 140, 140, True)),
        ("rgb(30, 30, 60)", "rgb(0, 0, 0)", 4.5, (120, 120, 138, True)),
        ("rgb(9, 9, 9)", "rgb(9, 9, 9)", 30.0, (255, 255, 255, True)),
        ("red", "rgb(0, 0, 0)", 4.5, None),
    ],
)
def test_contrast_repair(spark, text, behind, need, result):
    r = spark.range(1).select(colors.repaired(colors.rgb(F.lit(text)), colors.rgb(F.lit(behind)), F.lit(need)).alias("c")).first().c
    assert (r and (r.r, r.g, r.b, r.fixed)) == result
    assert r is None or not r.fixed or need > 21 or r.ratio >= need


def test_large_text_needs_less(spark):
    rows = spark.createDataFrame([(24.0, 400, 3.0), (20.0, 700, 3.0), (20.0, 400, 4.5), (18.0, 900, 4.5)], "size double, weight int, need double")
    assert rows.where(colors.needed(F.col("size"), F.col("weight")) == F.col("need")).count() == 4
