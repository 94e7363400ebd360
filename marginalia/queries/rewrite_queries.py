"""Rewrites, merges and pulls over rows of parts, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import quality, records as record_ops, render
from ..session import table
from ..sources import slots
from .registry import query

FORMULA = r"'\\\\' || p_type || '\_' || p_size"


@query(rf"""SELECT p_partkey, p_name || ' $' || replace(replace({FORMULA}, '\\', '\'), '\_', '_') || '$ \_' || p_brand || ' $$\' || p_size || '*$$' AS text FROM part""")
def t17_formulas_unescaped(spark, folder):
    r"""Inside formulas ``\\`` becomes ``\`` and ``\_`` becomes ``_``; outside, escapes stay."""
    formula = F.concat(F.lit(r"\\\\"), "p_type", F.lit(r"\_"), F.col("p_size").cast("string"))
    text = F.concat("p_name", F.lit(" $"), formula, F.lit(r"$ \_"), "p_brand", F.lit(r" $$\\"), F.col("p_size").cast("string"), F.lit(r"\*$$"))
    return table(spark, folder, "part").select("p_partkey", markup.formulas_unescaped(text).alias("text"))


@query(r"""SELECT p_partkey, p_name || ' <' || 1 || '> ' || p_size || chr(10) || '<' || 3 || '> $ ' || p_brand AS shielded, p_name || ' $' || p_type || '_' || p_size || '$ ' || p_size || chr(10) || '$$' || p_size || chr(10) || '$$ $ ' || p_brand AS restored FROM part""")
def t41_formula_shields(spark, folder):
    """Formulas are numbered marks while a text is rewritten, and come back as they were."""
    size = F.col("p_size").cast("string")
    text = F.concat("p_name", F.lit(" $"), "p_type", F.lit("_"), size, F.lit("$ "), size, F.lit("\n$$"), size, F.lit("\n$$ $ "), "p_brand")
    rows = table(spark, folder, "part").select("p_partkey", markup.shielded(text).alias("s"))
    return rows.select("p_partkey", F.translate("s.text", "\x02\x03", "<>").alias("shielded"), markup.restored(F.col("s.text"), F.col("s.formulas")).alias("restored"))


LINES_SQL = "SELECT l_orderkey, ['q' || l_quantity::INT, 'p|' || l_partkey, 's' || l_suppkey][1:1 + l_partkey % 3] AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem"


@query(rf"""WITH c AS ({LINES_SQL}), w AS (SELECT *, max(len(c)) OVER (PARTITION BY l_orderkey) AS width FROM c),
r AS (SELECT l_orderkey, n, width, '| ' || replace(array_to_string(c || list_transform(range(0, width - len(c)), lambda i: ''), ' | '), 'p|', 'p\|') || ' |' AS line FROM w)
SELECT l_orderkey AS key, string_agg(line || CASE WHEN n = 1 THEN chr(10) || '|' || repeat(' --- |', width) ELSE '' END, chr(10) ORDER BY n) AS markdown FROM r GROUP BY 1""")
def a30_table_width(spark, folder):
    """An order's lines as a table whose rows have one to three cells; all are filled up to the widest."""
    cells = F.array(F.concat(F.lit("<td>q"), F.col("l_quantity").cast("int").cast("string"), F.lit("</td>")), F.concat(F.lit('<th class="x"> <b>p|'), F.col("l_partkey").cast("string"), F.lit("</b></th>")), F.concat(F.lit("<td>\ns"), F.col("l_suppkey").cast("string"), F.lit("</td>")))
    row = F.concat(F.lit("<tr>"), F.array_join(F.slice(cells, 1, (1 + F.col("l_partkey") % 3).cast("int")), ""), F.lit("</tr>"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))).alias("rows"))
    return render.markdown_tables(lines.select("key", F.concat(F.lit("<table>"), F.array_join(F.col("rows.row"), ""), F.lit("</table>")).alias("html")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size > 9 THEN p_brand ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN p_type || '!' ELSE p_type END AS type FROM part""")
def g06_merge_kinds(spark, folder):
    """Merges of two kinds, one after the other: names that aren't empty win; types are replaced, twice."""
    p = table(spark, folder, "part")
    start = p.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    names = p.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_size") > 9, F.col("p_brand")).otherwise("").alias("name"))
    types = p.where("p_partkey % 5 = 0").select("p_partkey", F.concat("p_type", F.lit("!")).alias("type"))
    again = p.where("p_partkey % 4 = 0").select("p_partkey", F.col("p_name").alias("type"))

    def kind(field: str, other: str):
        return lambda record, rows: record_ops.merge_fields(record.drop(other), rows, "p_partkey", [field]).join(record.select("p_partkey", other), "p_partkey").select("p_partkey", "name", "type")

    return quality.applied(start, [("names", names), ("types", types), ("types", again)], {"names": kind("name", "type"), "types": kind("type", "name")})


@query("""SELECT p_partkey AS slug, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN [p_type, p_brand] ELSE ['mine', p_brand, p_type] END ELSE [p_brand, p_type] END AS tags, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS category FROM part""")
def g23_tags_kept_at_ingest(spark, folder):
    """Documents that are read in again keep their tags, before the new ones, and their category, where they had any."""
    p = table(spark, folder, "part")
    tags = F.when(F.col("p_size") % 4 == 0, F.array("p_type")).when(F.col("p_size") % 2 == 0, F.array(F.lit("mine"))).otherwise(F.array().cast("array<string>"))
    old = p.select(F.col("p_partkey").alias("slug"), tags.alias("tags"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("").alias("category"))
    return quality.kept_tags(old, p.select(F.col("p_partkey").alias("slug"), F.array("p_brand", "p_type").alias("tags"), F.col("p_type").alias("category")))


@query("""WITH l AS (SELECT user_id AS slug, arg_max(props, event_id) AS remote, arg_min(props, event_id) AS text FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT slug, CASE WHEN slug % 3 = 0 THEN text ELSE coalesce(remote, text) END AS text, CASE WHEN slug % 3 <> 0 AND remote <> text THEN text END AS backup, coalesce(slug % 3 <> 0 AND remote <> text, false) AS changed FROM l""")
def s20_pull(spark, folder):
    """The newest revision replaces a local text that differs, which is kept; every third document has an empty slot."""
    e = table(spark, folder, "events").where("event_type <> 'error'")
    local = e.groupBy(F.col("user_id").alias("slug")).agg(F.min_by("props", "event_id").alias("text"))
    slot = e.where("user_id % 3 <> 0").select(F.col("user_id").alias("slug"), F.col("event_id").alias("rev"), F.col("ts").alias("uploaded_at"), F.to_json(F.struct(F.col("props").alias("text"))).alias("body"))
    return slots.pulled(local, slot)


@query("""WITH f AS (SELECT l_orderkey, count_if(l_quantity > 10 OR l_tax > 0) AS shown, arg_min(l_partkey, l_partkey * 8 + l_linenumber) FILTER (l_quantity > 10 OR l_tax > 0) AS first FROM lineitem GROUP BY 1)
SELECT o_orderkey AS slug, o_orderpriority || chr(10) || '"' AS text, coalesce(shown, 0)::INT AS figures, first::VARCHAR AS first FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def s21_push_payload(spark, folder):
    """Orders as documents, their lines as figures: those with neither bytes nor markup aren't sent."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("slug"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").cast("string").alias("id"), F.when(F.col("l_quantity") > 10, "data:x").otherwise("").alias("data_uri"), F.when(F.col("l_tax") > 0, "<table>").otherwise("").alias("html"))
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("slug"), F.concat("o_orderpriority", F.lit('\n"')).alias("text"), F.lit("<html>").alias("report"))
    body = F.from_json("body", "text string, figures array<struct<id: string>>")
    return slots.payload(docs, lines).select("slug", body.alias("b")).select("slug", "b.text", F.size("b.figures").alias("figures"), F.get("b.figures", F.lit(0))["id"].alias("first"))


@query(r"""SELECT p_partkey AS slug, '---|title_en: "' || p_name || ' \"' || p_size || '\""|category: ' || p_type || '|tags: [' || p_brand || ', ' || p_type || ']|status: to_read|---|# ' || p_name || ' "' || p_size || '"||## 섹션별 리뷰|' || array_to_string(list_transform(range(1, p_size % 3 + 2), lambda i: '### ' || p_name || ' ' || i || '|<!-- section_id: s' || i || ' | lines: ' || (10 * i) || '-' || (p_size + 10 * i) || ' -->|_(미진행)_|'), '|') || '|## Q&A||## Wrap-up|' AS text FROM part""")
def g18_skeletons(spark, folder):
    """A new document with one to three open sections for each part."""
    size = F.col("p_size").cast("string")
    sections = F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda i: F.struct(F.concat_ws(" ", "p_name", i.cast("string")).alias("heading"), F.concat(F.lit("s"), i.cast("string")).alias("id"), F.concat_ws("-", (10 * i).cast("string"), (F.col("p_size") + 10 * i).cast("string")).alias("lines")))
    records = table(spark, folder, "part").select(F.col("p_partkey").alias("slug"), F.concat("p_name", F.lit(' "'), size, F.lit('"')).alias("title"), F.col("p_type").alias("category"), F.array("p_brand", "p_type").alias("tags"), sections.alias("sections"))
    return render.skeleton(records).select("slug", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"))
