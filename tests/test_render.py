"""Drafts, exports and rewrites of markup on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import render, workbench

URI = "data:image/png;base64,AAAA"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_figures_in_reports(spark):
    figures = spark.createDataFrame([("p", "fig1", URI, ""), ("p", "tbl1", "", "<table><tr><td>1</td></tr></table>")], "slug string, id string, data_uri string, html string")
    report = spark.createDataFrame([("p", '<img src="/fig/fig1"> and <img src="/fig/fig9">.'), ("q", "none")], "slug string, html string")
    got = {r.slug: r.html for r in render.resolved(report, figures).collect()}
    assert got == {"p": f'<img src="{URI}"> and <img src="" data-missing="1">.', "q": "none"}
    report = spark.createDataFrame([("p", 'a <img alt="t" src="/fig/tbl1"> b <img src="/fig/tbl2"> c')], "slug string, html string")
    assert render.inlined_tables(report, figures).first().html == 'a <table><tr><td>1</td></tr></table> b <img src="/fig/tbl2"> c'


REVIEW = "# T\n## 섹션별 리뷰\n### 1. Real\nkept\n\n### 2. Empty\n\n### 3\\. {template}\nsome text\n\n## Q&A\n### Q1. still here\nyes\n"


def test_tidy(spark):
    docs = spark.createDataFrame([("p", REVIEW), ("q", REVIEW)], "slug string, text string")
    live = spark.createDataFrame([("p", "1. real")], "slug string, key string")
    plan = workbench.tidy_plan(docs, live)
    assert {(r.slug, r.heading, r.reason, r.written) for r in plan.collect()} == {("p", "2. Empty", "빈 제목", 0), ("q", "2. Empty", "빈 제목", 0), ("p", "3\\. {template}", "섹션 아님", 9)}
    texts = {r.slug: r.text for r in render.tidied(docs, plan).collect()}
    assert texts["p"] == "# T\n## 섹션별 리뷰\n### 1. Real\nkept\n\n\n## Q&A\n### Q1. still here\nyes\n"
    assert "### 3" in texts["q"] and "Q1. still here" in texts["q"]


def test_retired_fields(spark):
    text = "## Wrap-up\n- **한 줄 contribution**: x\n- **메모**:\n- **다음에 볼 것**: kept\n"
    once = one(spark, render.without_retired_fields(F.lit(text)))
    assert once == "## Wrap-up\n- **한 줄 contribution**: x\n- **다음에 볼 것**: kept\n"
    assert one(spark, render.without_retired_fields(F.lit(once))) == once


def test_merged_blocks_become_sections(spark):
    text = "## 섹션별 리뷰\n### 1. A\n<!-- section_id: 1-a | lines: 0-3 -->\n**핵심 해설**\nfirst\n**DATASET**\n<!-- section_id: data-set | lines: 3-5 -->\n**요약**\nsecond\n## stray\n### 2. B\n<!-- section_id: 2-b -->\n**핵심 해설**\nthird\n## Q&A\n"
    docs = spark.createDataFrame([("p", text)], "slug string, text string")
    got = [(r.heading, r.section_id, r.explanation, r.summary) for r in workbench.sections(docs).orderBy("chunk_no", "part").collect()]
    assert got == [("1. A", "1-a", "first", ""), ("DATASET", "data-set", "", "second\n## stray"), ("2. B", "2-b", "third", "")]


def test_drafts_and_skeletons(spark):
    docs = spark.createDataFrame([("p", "Title", "short"), ("q", "Other", "")], "slug string, title string, tldr string")
    sections = spark.createDataFrame([("p", 1, "2\\. B", "", "sum"), ("p", 0, "1\\. A", "done\\.", ""), ("p", 2, "3. C", "", "")], "slug string, ordinal int, heading string, explanation string, summary string")
    got = {r.slug: r.draft.rstrip() for r in render.drafts(docs, sections).collect()}
    assert got == {"p": "# Title\n\n> short\n\n## 1. A\n\ndone.\n\n## 2. B\n\nsum", "q": "# Other"}
    records = spark.createDataFrame([("p", 'A "b"', "llm", ["x", "y"], [("1. A", "1-a", "0-9")])], "slug string, title string, category string, tags array<string>, sections array<struct<heading: string, id: string, lines: string>>")
    text = render.skeleton(records)
    front = text.select(workbench.frontmatter(F.col("text")).alias("m"), workbench.progress(F.col("text")).alias("p")).first()
    assert front.m["status"] == "to_read" and front.p.total == 1 and front.p.done == 0
    assert workbench.unfinished(text).first().lines == "0-9"


def test_tables(spark):
    html = '<table class="x"><tr><th>A</th><th>B|C</th></tr><tr><td style="y" colspan="2">1\n <b>2</b></td></tr></table>'
    tables = spark.createDataFrame([("t", html)], "key string, html string")
    assert render.markdown_tables(tables).first().markdown == "| A | B\\|C |\n| --- | --- |\n| 1 2 |  |"
    assert one(spark, render.plain_tables(F.lit('<table class="x"><tr id="r"><td colspan="2">1</td></tr></table>'))) == '<table><tr><td colspan="2">1</td></tr></table>'


def test_tree(spark):
    paths = spark.createDataFrame([("a/b/c/d.py",), ("a/x.py",), ("z",)], "path string")
    assert [(r.path, r.depth) for r in render.tree(paths).orderBy("rank").collect()] == [("a", 0), ("a/b", 1), ("a/b/c", 2), ("a/x.py", 1), ("z", 0)]


def test_hints_widths_and_kinds(spark):
    figures = spark.createDataFrame([("p", 1, "figure", "Figure 2", "", "second"), ("p", 0, "figure", "Figure 1", "하나", "one"), ("p", 2, "table", "Table 1", "", "t" * 200)], "slug string, pos int, kind string, label string, caption_ko string, caption_en string")
    assert render.figure_hint(figures).first().hint == "Figures:\n- Figure 1: 하나\n- Figure 2: second\nTables:\n- Table 1: " + "t" * 110
    assert one(spark, render.image_width(F.lit("![a|420](x) ![b](y)"), None)) == "![a](x) ![b](y)"
    assert one(spark, render.image_width(F.lit("![a|420](x)"), 300)) == "![a|300](x)"
    kinds = spark.createDataFrame([("https://x/y.png",), ("attachments/a.png",), ("../../etc/x",), ("figures/a.png",)], "a string").select(render.image_kind(F.col("a")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["remote", "attachment", "refused", "local"]


def test_page_figures(spark):
    html = '<h2>Setup</h2><figure><img src="a.png"><figcaption>One</figcaption></figure><figure><pre>code</pre><svg></svg><figcaption>x</figcaption></figure><h3>Results</h3><figure><svg></svg><figcaption>Two</figcaption></figure><figure><img src="logo.png"></figure><table><tr><td>1</td></tr></table>'
    pages = spark.createDataFrame([("p", html)], "key string, html string")
    assert [(r.n, r.kind, r.caption, r.heading) for r in render.page_figures(pages).orderBy("n").collect()] == [(1, "image", "One", "Setup"), (2, "drawing", "Two", "Results"), (3, "table", "", "Results")]
