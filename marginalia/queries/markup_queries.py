"""Figures, diagrams, gates and rewrites over rows that are generated from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import diagrams, figures, render
from ..session import dealt, table
from ..streaming import jobs
from .registry import query

URI = "data:image/png;base64,iVBORw=="
SVG_TEXT = "(SELECT p_partkey, p_name, p_size, 40 + p_size AS w, 12 + p_partkey % 5 AS fs FROM part)"


def em(column: str) -> str:
    """The width of a text in ems, in DuckDB."""
    return f"list_sum(list_transform(string_split({column}, ''), lambda c: CASE WHEN unicode(c) > 11904 THEN 0.9 WHEN regexp_matches(c, '[iljtfr.,:;''!|()\\[\\] ·]') THEN 0.29 WHEN regexp_matches(c, '[\\p{{Lu}}\\p{{Nd}}mw@%]') THEN 0.64 WHEN regexp_matches(c, '\\p{{Ll}}') THEN 0.56 ELSE 0.43 END))"


EM = em("p_name")


def svgs(spark, folder):
    """A box with a centred label for each part."""
    p = dealt(table(spark, folder, "part"), "p_partkey")
    svg = F.format_string('<svg viewBox="0 0 400 200"><rect x="100" y="20" width="%d" height="60"/><text x="%s" y="50" text-anchor="middle" font-size="%d">%s</text></svg>', 40 + F.col("p_size"), (100 + (40 + F.col("p_size")) / 2).cast("string"), 12 + F.col("p_partkey") % 5, "p_name")
    return p.select(F.col("p_partkey").cast("string").alias("key"), svg.alias("svg"))


@query(f"SELECT p_partkey::VARCHAR AS key, 'TEXT_OVERFLOW' AS code, p_name AS s FROM {SVG_TEXT} WHERE ({EM} * fs * 0.9 - w) / 2 > 4")
def g22_diagram_lint(spark, folder):
    return diagrams.lint(svgs(spark, folder))


@query(f"SELECT p_partkey::VARCHAR AS key, round({EM} * fs, 6)::DOUBLE AS wide FROM {SVG_TEXT}")
def m12_text_width(spark, folder):
    return diagrams.labels(svgs(spark, folder)).select("key", F.round(F.col("wide_right") - F.col("wide_left"), 6).alias("wide"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)), 6) AS distance FROM (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS px, l_suppkey % 20 AS py, (l_partkey % 40)::DOUBLE AS dx, (l_linenumber * 3)::DOUBLE AS dy FROM lineitem))")
def m13_segment_distance(spark, folder):
    """Distance of a point from a segment that begins at the origin."""
    c = table(spark, folder, "lineitem")
    zero = F.lit(0.0)
    d = diagrams.segment_distance(F.col("l_quantity"), (F.col("l_suppkey") % 20).cast("double"), zero, zero, (F.col("l_partkey") % 40).cast("double"), (F.col("l_linenumber") * 3).cast("double"))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", F.round(d, 6).alias("distance"))


def part_figures(spark, folder):
    """Figures by brand: those of size divisible by three are tables; captions name numbers, or don't."""
    p = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 3 == 0, "table").otherwise("image")
    caption = F.when(p % 4 == 0, F.concat(F.lit("no number "), "p_name")).otherwise(F.concat(F.when(F.col("p_size") % 3 == 0, "Table ").otherwise("Figure "), p.cast("string"), F.lit(": "), "p_name"))
    uri = F.when(p % 5 == 0, "").otherwise(URI)
    return table(spark, folder, "part").select(F.col("p_brand").alias("slug"), p.cast("int").alias("pos"), kind.alias("kind"), caption.alias("caption"), F.concat(F.lit("fig"), p.cast("string")).alias("id"), F.concat(F.lit("Figure "), p.cast("string")).alias("label"), F.lower("p_type").alias("ref_in_section"), uri.alias("data_uri"), F.initcap("p_type").alias("section_heading"))


PARTS = "(SELECT p_brand AS slug, p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN 'table' ELSE 'image' END AS kind, p_partkey % 4 = 0 AS bare, p_type, p_partkey FROM part)"


@query(f"SELECT slug, pos, kind, CASE WHEN bare THEN upper(kind[1]) || kind[2:] || ' (auto ' || n || ')' ELSE CASE WHEN kind = 'table' THEN 'Table ' ELSE 'Figure ' END || pos END AS label, CASE WHEN bare THEN CASE WHEN kind = 'table' THEN 'tblauto' ELSE 'figauto' END || n ELSE CASE WHEN kind = 'table' THEN 'tbl' ELSE 'fig' END || pos END AS id FROM (SELECT *, row_number() OVER (PARTITION BY slug, kind, bare ORDER BY pos) AS n FROM {PARTS})")
def w07_auto_labels(spark, folder):
    return figures.auto_labelled(part_figures(spark, folder))


@query(f"SELECT slug, '2-1-' || lower(p_type) AS section_id, 'fig' || pos AS id, pos FROM {PARTS} WHERE pos % 5 <> 0 AND p_type IN ('ECONOMY', 'PROMO')")
def j03_figures_of_sections(spark, folder):
    every = part_figures(spark, folder)
    sections = every.select("slug").distinct().select("slug", F.explode(F.array(F.lit("2-1-economy"), F.lit("2-1-promo"))).alias("section_id"))
    return figures.of_sections(sections, every).select("slug", "section_id", "id", "pos")


@query(f"SELECT slug, 'fig' || pos AS id, CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'PROMO' THEN 8 END AS line_no FROM {PARTS}")
def j10_figures_by_heading(spark, folder):
    every = part_figures(spark, folder)
    headings = every.select("slug").distinct().select("slug", F.explode(F.array(F.struct(F.lit("economy ").alias("heading"), F.lit(3).alias("line_no")), F.struct(F.lit("PROMO").alias("heading"), F.lit(8).alias("line_no")), F.struct(F.lit("Promo").alias("heading"), F.lit(9).alias("line_no")))).alias("h")).select("slug", "h.*")
    return figures.by_heading(every, headings)


@query("SELECT doc_id::VARCHAR AS slug, 0 AS pos, 'a' || doc_id AS id FROM documents UNION ALL SELECT doc_id::VARCHAR, 1, 'b' FROM documents WHERE doc_id % 2 = 0")
def t28_figure_references(spark, folder):
    d = F.col("doc_id").cast("string")
    text = F.concat(F.lit("x ![l](/paper/p/fig/a"), d, F.lit(") y ![m](/fig/a"), d, F.lit(")"), F.when(F.col("doc_id") % 2 == 0, " ![n](/fig/b)").otherwise(""))
    return figures.references(table(spark, folder, "documents").select(d.alias("slug"), text.alias("text")))


@query(f"SELECT slug, 'fig' || pos AS id FROM {PARTS} WHERE pos % 2 = 1")
def j09_orphan_figures(spark, folder):
    """Figures that their document doesn't show: here it shows those of even numbers."""
    every = part_figures(spark, folder)
    docs = every.where("pos % 2 = 0").select("slug", F.concat(F.lit("![x](/fig/"), "id", F.lit(")")).alias("text"))
    return figures.orphans(docs, every).select("slug", "id")


@query("SELECT doc_id::VARCHAR AS slug, 'a <img src=\"' || CASE WHEN doc_id % 3 = 0 THEN 'data:image/png;base64,iVBORw==' ELSE '\" data-missing=\"1' END || '\"> b' AS html FROM documents")
def j14_inlined_images(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.lit('a <img src="/fig/f1"> b').alias("html"), "doc_id")
    known = docs.where("doc_id % 3 = 0").select("slug", F.lit("f1").alias("id"), F.lit(URI).alias("data_uri"))
    return render.resolved(docs.select("slug", "html"), known)


@query("SELECT p_partkey, 1 AS n_marks, p_name || ' <mark class=\"wb-edit\">new' || p_size || '</mark>' AS marked FROM part")
def g07_edit_marks(spark, folder):
    p = table(spark, folder, "part")
    after = F.concat("p_name", F.lit(" new"), F.col("p_size").cast("string"))
    marked = kernels.edit_marks(F.col("p_name"), after)
    return p.select("p_partkey", marked.alias("marked")).select("p_partkey", F.regexp_count("marked", F.lit("<mark")).alias("n_marks"), "marked")


@query("SELECT user_id::VARCHAR AS key, event_id AS seq, 'Read f' || event_id || '.md' AS entry FROM events WHERE event_type = 'view' UNION ALL SELECT user_id::VARCHAR, event_id, printf('%.1fs $%.4f', value / 1000, value) FROM events WHERE event_type = 'purchase'")
def r03_log_entries(spark, folder):
    """Typed lines of a job's stream, decoded and turned into log entries; broken lines are left out."""
    e = table(spark, folder, "events")
    number = F.col("event_id").cast("string")
    tool = F.concat(F.lit('{"type":"stream_event","event":{"type":"content_block_start","content_block":{"type":"tool_use","name":"Read","input":{"file_path":"a/f'), number, F.lit('.md"}}}}'))
    result = F.concat(F.lit('{"type":"result","duration_ms":'), F.col("value").cast("string"), F.lit(',"total_cost_usd":'), F.col("value").cast("string"), F.lit("}"))
    payload = F.when(F.col("event_type") == "view", tool).when(F.col("event_type") == "purchase", result).otherwise("{broken")
    lines = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), payload.alias("payload"))
    return jobs.log_entries(jobs.decoded(lines)).select("key", "seq", "entry")


@query("SELECT DISTINCT rank, path, depth FROM (SELECT row_number() OVER (ORDER BY path) AS rank, path, len(string_split(path, '/')) - 1 AS depth FROM (SELECT DISTINCT unnest([p_type, p_type || '/' || p_brand, p_type || '/' || p_brand || '/' || p_size]) AS path FROM part)) WHERE rank <= 300")
def w16_directory_tree(spark, folder):
    return render.tree(table(spark, folder, "part").select(F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("path")))


@query("SELECT user_id::VARCHAR AS slug, 2 AS width, '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || event_type || ' |  |' AS markdown FROM events")
def t30_markdown_tables(spark, folder):
    e = table(spark, folder, "events")
    html = F.concat(F.lit("<table><tr><th>k</th><th>v</th></tr><tr><td>"), "event_type", F.lit("</td></tr></table>"))
    return render.markdown_tables(e.select(F.col("user_id").cast("string").alias("key"), html.alias("html"))).select(F.col("key").alias("slug"), F.lit(2).alias("width"), "markdown")


@query("WITH p AS (SELECT path, v, lag(v) OVER (PARTITION BY path ORDER BY v) AS b FROM (SELECT s_suppkey AS path, (s_suppkey % 3)::BIGINT AS v FROM supplier)) SELECT path::VARCHAR AS path, CASE v WHEN 0 THEN 'gone' WHEN 1 THEN 'changed' ELSE 'added' END AS change FROM p")
def r01_change_feed(spark, folder):
    """Two listings of files: some are gone, some changed, some new."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 3).alias("k"))
    before = s.where("k <> 2").select("path", F.lit(1).cast("long").alias("changed_at"))
    after = s.where("k <> 0").select("path", F.lit(2).cast("long").alias("changed_at"))
    return jobs.changed_files(before, after)


