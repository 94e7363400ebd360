"""Review documents, generated from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workbench as ops
from ..session import table
from .registry import query


def workbenches(spark, folder):
    """slug, text: a review of two sections, questions and a wrap-up for each document."""
    d = F.col("doc_id")
    first = F.element_at(F.split("text", "\n"), 1)
    text = F.concat(
        F.lit("---\nslug: d"), d.cast("string"), F.lit("\nstatus: "), F.when(d % 3 == 0, "to_read").otherwise("review_done"),
        F.lit("\ntags: ["), "lang", F.lit(', "src/'), "source", F.lit('"]\nstatus: '), F.when(d % 5 == 0, "archived").otherwise("exported"), F.lit('\ntitle_en: "Doc: '), d.cast("string"), F.lit('"\n---\n# Title '), d.cast("string"),
        F.lit("\n\n## TL;DR\n"), F.when(d % 4 == 0, "_(아직 비어있음)_").otherwise(first), F.lit("\n\n## 섹션별 리뷰\n### 1. Alpha\n<!-- section_id: 1-alpha | lines: 0-10 -->\n**핵심 해설**\n"), first,
        F.lit("\n\n**Reader's Notes**\nnote "), d.cast("string"), F.lit("\n### 2\\. Beta\n<!-- section_id: 2-beta | lines: 10-30 -->\n"), F.when(d % 2 == 0, "_(미진행)_").otherwise("**요약**\nshort"),
        F.lit("\n### 3. Gamma\n"), F.when(d % 7 == 0, "").otherwise("**핵심 해설**\ngamma text"), F.lit("\n## Q&A\n### Q from §1. Alpha\n1. Why?\n\n_답변:_ "), F.when(d % 3 == 1, "because").otherwise("(미진행)"),
        F.lit("\n### Q2. What else\n"), F.when(d % 3 == 2, "nothing").otherwise("<empty>"), F.lit("\n## Wrap-up\n- **한 줄 contribution**: one "), d.cast("string"), F.lit("\n- **후속으로 읽을 논문**:\n  1. First\n  2. Second "), "lang", F.lit("\n"),
    )
    return table(spark, folder, "documents").select(F.concat(F.lit("d"), d.cast("string")).alias("slug"), text.alias("text"))


WB = r"""
WITH s AS (SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS first FROM documents),
wb AS (SELECT 'd' || doc_id AS slug, doc_id, lang, source, first, replace('---|slug: d' || doc_id || '|status: ' || CASE WHEN doc_id % 3 = 0 THEN 'to_read' ELSE 'review_done' END || '|tags: [' || lang || ', "src/' || source || '"]|status: ' || CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE 'exported' END || '|title_en: "Doc: ' || doc_id || '"|---|', '|', chr(10)) AS head FROM s)"""


@query(WB + r" SELECT slug, CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE 'exported' END AS status, 'Doc: ' || doc_id AS title_en, 4 AS n_keys FROM wb")
def t01_frontmatter(spark, folder):
    m = ops.frontmatter(F.col("text"))
    return workbenches(spark, folder).select("slug", F.element_at(m, "status").alias("status"), F.element_at(m, "title_en").alias("title_en"), F.size(m).alias("n_keys"))


@query(WB + " SELECT slug, CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE 'exported' END AS status FROM wb")
def t04_status_read(spark, folder):
    """A document without the key is "unknown"."""
    return workbenches(spark, folder).select("slug", F.coalesce(F.element_at(ops.frontmatter(F.col("text")), "status"), F.lit("unknown")).alias("status"))


@query(WB + " SELECT slug, lang || '|src/' || source AS tags FROM wb")
def t03_tag_values(spark, folder):
    return workbenches(spark, folder).select("slug", F.array_join(ops.tag_values(F.element_at(ops.frontmatter(F.col("text")), "tags")), "|").alias("tags"))


@query(WB + r" SELECT slug, regexp_replace(head, 'status: [a-z_]+', 'status: in_progress') || '#' AS replaced, replace(head, chr(10) || '---' || chr(10), chr(10) || 'rating: 4' || chr(10) || '---' || chr(10)) || '#' AS added FROM wb")
def t02_frontmatter_upsert(spark, folder):
    head = lambda c: F.regexp_extract(c, r"(?s)\A(---\n.*?\n---\n#)", 1)
    text = F.col("text")
    return workbenches(spark, folder).select("slug", head(ops.with_key(text, "status", F.lit("in_progress"))).alias("replaced"), head(ops.with_key(text, "rating", F.lit("4"))).alias("added"))


@query(WB + " SELECT slug, 3 AS total, 3 - (doc_id % 2 = 0)::INT AS done FROM wb")
def a04_section_progress(spark, folder):
    return workbenches(spark, folder).select("slug", ops.progress(F.col("text")).alias("p")).select("slug", "p.total", "p.done")


@query(WB + r" SELECT slug, 1 AS pos, '2\. Beta' AS heading, '10-30' AS lines FROM wb WHERE doc_id % 2 = 0")
def p21_unfinished_sections(spark, folder):
    return ops.unfinished(workbenches(spark, folder))


@query(WB + " SELECT slug, doc_id % 4 = 0 AS needed FROM wb")
def p22_needs_introduction(spark, folder):
    return workbenches(spark, folder).select("slug", ops.needs_introduction(F.col("text")).alias("needed"))


@query(WB + " SELECT slug, CASE WHEN doc_id % 4 = 0 THEN '_(아직 비어있음)_' ELSE regexp_replace(first, '^\\s+|\\s+$', '', 'g') END AS body FROM wb")
def t05_heading_body(spark, folder):
    return workbenches(spark, folder).select("slug", ops.heading_body(F.col("text"), "TL;DR").alias("body"))


@query(WB + r""" SELECT slug, 0 AS n, '1. Alpha' AS heading, '1-alpha' AS section_id, '0-10' AS lines, regexp_replace(first, '^\s+|\s+$', '', 'g') AS explanation, '' AS summary, 'note ' || doc_id AS notes, true AS done FROM wb
UNION ALL SELECT slug, 1, '2\. Beta', '2-beta', '10-30', '', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'short' END, '', doc_id % 2 <> 0 FROM wb UNION ALL SELECT slug, 2, '3. Gamma', '', '', CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'gamma text' END, '', '', true FROM wb""")
def t07_review_sections(spark, folder):
    return ops.sections(workbenches(spark, folder)).select("slug", F.col("chunk_no").alias("n"), "heading", "section_id", "lines", "explanation", "summary", "notes", "done")


@query(WB + " SELECT slug, 'generated' AS kind, '1. Alpha' AS title, CASE WHEN doc_id % 3 = 1 THEN 'because' ELSE '' END AS answer FROM wb UNION ALL SELECT slug, 'written', 'Q2. What else', 'nothing' FROM wb WHERE doc_id % 3 = 2")
def t09_questions(spark, folder):
    return ops.questions(workbenches(spark, folder)).select("slug", "kind", "title", "answer")


@query(WB + " SELECT slug, 'one ' || doc_id AS one_line, 'First|Second ' || lang AS follow_ups FROM wb")
def t11_wrap_up(spark, folder):
    body = ops.heading_body(F.col("text"), "Wrap-up")
    return workbenches(spark, folder).select("slug", ops.dash_field(body, "한 줄 contribution").alias("one_line"), F.array_join(ops.follow_ups(body), "|").alias("follow_ups"))


@query(WB + r" SELECT slug, '3. Gamma' AS heading, '빈 제목' AS reason, 0 AS written FROM wb WHERE doc_id % 7 = 0 UNION ALL SELECT slug, '3. Gamma', '섹션 아님', length('**핵심 해설**' || chr(10) || 'gamma text') FROM wb WHERE doc_id % 7 <> 0 AND doc_id % 2 = 1")
def d09_tidy_plan(spark, folder):
    """Two headings are live in documents of odd ids; the others have no source."""
    docs = workbenches(spark, folder)
    live = docs.where(F.substring("slug", 2, 20).cast("long") % 2 == 1).select("slug", F.explode(F.array(F.lit("1. alpha"), F.lit("2. beta"))).alias("key"))
    return ops.tidy_plan(docs, live).select("slug", "heading", "reason", "written")


@query(WB + r" SELECT slug, 'a. b $\alpha_{x}$ c\* ' || doc_id || ' $$a\b$$' AS plain FROM wb")
def t14_markdown_unescape(spark, folder):
    text = F.concat(F.lit(r"a\. b $\\alpha\_{x}$ c\* "), F.substring("slug", 2, 20), F.lit(r" $$a\\b$$"))
    return workbenches(spark, folder).select("slug", ops.unescaped_markdown(text).alias("plain"))


@query(WB + " SELECT slug, 'p' || doc_id AS title, 2 AS n_stages FROM wb WHERE doc_id % 2 = 0")
def t12_pipeline_blocks(spark, folder):
    """Broken JSON is skipped."""
    good = F.concat(F.lit('x\n```pipeline\n{"title": "p'), F.substring("slug", 2, 20), F.lit('", "stages": [{"label": "a"}, {"label": "b", "icon": "i"}]}\n```\n'))
    text = F.when(F.substring("slug", 2, 20).cast("long") % 2 == 0, good).otherwise("```pipeline\n{broken\n```\n")
    rows = workbenches(spark, folder).select("slug", F.explode(ops.pipelines(text)).alias("p"))
    return rows.select("slug", "p.title", F.size("p.stages").alias("n_stages"))


@query(WB + r""", r AS (SELECT length('**핵심 해설**|' || first || '||**Reader''s Notes**|note ' || doc_id) AS written FROM wb WHERE doc_id % 2 = 1 UNION ALL SELECT length('**핵심 해설**|gamma text') FROM wb WHERE doc_id % 2 = 1 AND doc_id % 7 <> 0 UNION ALL SELECT 0 FROM wb WHERE doc_id % 7 = 0)
SELECT count(*) AS blocks, count_if(written > 200) AS written FROM r""")
def a28_tidy_totals(spark, folder):
    """Of documents of odd ids one heading is live; the others have no source."""
    docs = workbenches(spark, folder)
    live = docs.where(F.substring("slug", 2, 20).cast("long") % 2 == 1).select("slug", F.lit("2. beta").alias("key"))
    return ops.tidy_totals(ops.tidy_plan(docs, live))
