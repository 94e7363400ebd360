"""Gates and placements over records, bodies and reports whose fields are the values of orders, their lines and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import figures, quality
from ..session import table
from ..sources import sinks
from .registry import query

CATEGORIES = "['" + "', '".join((*quality.CATEGORIES, "bio", "", "math")) + "']"
RULES = {
    "error": {
        "missing_title": "o_totalprice < 50000", "missing_authors": "o_orderstatus = 'P'", "no_sections": "n = 0", "low_coverage": "detected > 0 AND n / detected < 0.5", "empty_paragraphs": "blank > 0", "missing_notes": "unnoted > 0", "repository_without_link": "github AND o_custkey % 3 = 0",
    },
    "warning": {
        "missing_title_ko": "o_custkey % 4 = 0", "missing_venue": "o_orderpriority = '5-LOW'", "missing_year": "year(o_orderdate) < 1995", "missing_url": "o_custkey % 11 = 0", "missing_abstract_en": "o_custkey % 13 = 0", "missing_abstract_ko": "o_orderkey % 6 = 0",
        "unknown_category": f"NOT {CATEGORIES}[o_custkey % 10 + 1] IN {CATEGORIES}[1:7]", "partial_coverage": "detected > 0 AND n / detected >= 0.5 AND n < detected", "missing_summaries": "lacking > 0.3 * n", "short_notes": "short > 0", "copied_summary": "copied > 0", "no_prerequisites": "o_custkey % 3 = 1",
        "no_key_terms": "o_orderkey % 8 = 0", "unresolved_ambiguities": "github AND unresolved > 0", "no_figures_field": "o_custkey % 5 = 0",
    },
}
GATE_SQL = f"""WITH l AS (SELECT l_orderkey, count(*) AS n, count_if(l_tax = 0) AS blank, count_if(l_quantity >= 20 AND l_suppkey % 3 = 0) AS unnoted, count_if(l_partkey % 4 = 0) AS lacking, count_if(l_suppkey % 3 = 1) AS short, count_if(l_partkey % 4 = 1 AND l_quantity >= 2) AS copied FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, count_if(asked AND NOT answered) AS unresolved FROM (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS asked, bool_or(l_linestatus = 'O') AS answered FROM lineitem GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT orders.*, o_custkey % 9 AS detected, o_orderkey % 2 = 0 AS github, coalesce(n, 0) AS n, coalesce(blank, 0) AS blank, coalesce(unnoted, 0) AS unnoted, coalesce(lacking, 0) AS lacking, coalesce(short, 0) AS short, coalesce(copied, 0) AS copied, coalesce(unresolved, 0) AS unresolved FROM orders LEFT JOIN l ON o_orderkey = l.l_orderkey LEFT JOIN u ON o_orderkey = u.l_orderkey) """
GATE_SQL += " UNION ALL ".join(f"SELECT o_orderkey AS slug, '{severity}' AS severity, '{rule}' AS rule FROM o WHERE {test}" for severity, rules in RULES.items() for rule, test in rules.items())


def records(spark, folder) -> DataFrame:
    """Orders as records, their lines as sections: every rule of the gate is broken by some and kept by others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    id_of = lambda letter, l: F.concat(F.lit(letter), l["l_linenumber"].cast("string"))

    def section(l: Column) -> Column:
        part, supplier = l["l_partkey"] % 4, l["l_suppkey"] % 3
        return F.struct(
            id_of("s", l).alias("id"), F.lit("x").alias("title_en"), F.when(part == 0, " ").when(part == 1, "k" * 70).otherwise("short").alias("summary_ko"),
            F.array(F.struct(F.when(l["l_tax"] == 0, " ").otherwise("e").alias("en"), F.repeat(F.lit("k"), l["l_quantity"].cast("int") * 50).alias("ko"))).alias("paragraphs"),
            F.when(supplier == 1, "n" * 60).when(supplier == 2, "n" * 100).alias("readers_notes_md"),
        )

    # lines are gathered as they are; the long texts of sections are made behind the shuffle
    gathered = F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(gathered.alias("lines"))
    sections = F.transform("lines", section)
    ambiguities = F.transform(F.filter("lines", lambda l: l["l_returnflag"] == "R"), lambda l: F.struct(id_of("a", l).alias("id"), F.lit("s").alias("section_id")))
    clarifications = F.transform(F.filter("lines", lambda l: l["l_linestatus"] == "O"), lambda l: F.struct(id_of("a", l).alias("ambiguity_id")))
    text = lambda test, value: F.when(test, "").otherwise(value)
    category = F.element_at(F.array(*map(F.lit, (*quality.CATEGORIES, "bio", "", "math"))), (c % 10 + 1).cast("int"))
    metadata = F.struct(
        text(F.col("o_totalprice") < 50000, F.col("o_orderpriority")).alias("title"), text(c % 4 == 0, F.lit("t")).alias("title_ko"), F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("authors"),
        text(F.col("o_orderpriority") == "5-LOW", F.lit("v")).alias("venue"), F.when(F.year("o_orderdate") >= 1995, F.year("o_orderdate")).alias("year"), category.alias("category"), text(c % 11 == 0, F.lit("u")).alias("url"), text(c % 3 == 0, F.lit("g")).alias("github_url"),
        text(c % 13 == 0, F.lit("a")).alias("abstract_en"), F.when(k % 6 != 0, "b").alias("abstract_ko"),
    )
    none = lambda test: F.when(test, F.array().cast("array<string>")).otherwise(F.array(F.lit("p")))
    return table(spark, folder, "orders").join(lines, "o_orderkey", "left").select(
        k.alias("slug"), metadata.alias("metadata"), sections.alias("sections"), none(c % 3 == 1).alias("prerequisites"), none(k % 8 == 0).alias("key_terms"), F.when(k % 2 == 0, F.struct(F.lit("r").alias("repo"))).alias("github"),
        F.coalesce(ambiguities, F.array().cast("array<struct<id: string, section_id: string>>")).alias("ambiguities"), clarifications.alias("code_clarifications"), F.when(c % 5 != 0, F.array().cast("array<struct<id: string>>")).alias("figures"), (c % 9).cast("int").alias("detected_sections"),
    )


@query(GATE_SQL)
def g09_quality_gate(spark, folder):
    return quality.findings(records(spark, folder)).select("slug", "severity", "rule")


@query("""SELECT o_orderkey AS slug, count(l_orderkey)::INT AS sections, (o_custkey % 3 <> 1)::INT AS prerequisites, (o_orderkey % 8 <> 0)::INT AS key_terms, coalesce(count_if(l_returnflag = 'R'), 0)::INT AS ambiguities, coalesce(count_if(l_linestatus = 'O'), 0)::INT AS code_clarifications, 0 AS figures
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")
def a24_record_sizes(spark, folder):
    return quality.sizes(records(spark, folder))


NAMED = "(SELECT p_partkey, p_size % 5 AS wanted, [p_partkey % 5, p_partkey // 5 % 5, p_partkey // 25 % 5] AS named FROM part)"


def bodies(spark, folder):
    """Three paragraphs of which each names a figure, in words that vary, and things of the same number that are none."""
    p = table(spark, folder, "part")
    number = lambda i: F.floor(F.col("p_partkey") / 5**i) % 5
    said = ("As Fig. {} shows, and Table {} too.", "See Figure {}.", "(figure {}) and Figure 9{}")
    paragraphs = [F.concat(*[x for i, piece in enumerate(text.split("{}")) for x in ([number(n).cast("string")] if i else []) + [F.lit(piece)]]) for n, text in enumerate(said)]
    docs = p.select(F.col("p_partkey").cast("string").alias("slug"), F.lit("s").alias("section_id"), F.concat_ws("\n\n", *paragraphs).alias("body"), F.lit("").alias("text"), (F.col("p_size") % 5).cast("string").alias("wanted"))
    wanted = docs.select("slug", "section_id", F.concat(F.lit("fig"), "wanted").alias("id"), F.concat(F.lit("Figure "), "wanted").alias("label"), F.lit(0).alias("pos"))
    return docs.drop("wanted"), wanted


@query(f"SELECT p_partkey::VARCHAR AS slug, CASE WHEN list_contains(named, wanted) THEN list_position(named, wanted) - 1 END AS paragraph FROM {NAMED}")
def j30_paragraph_that_names_a_figure(spark, folder):
    return figures.placements(*bodies(spark, folder)).select("slug", "paragraph")


@query(f"""SELECT p_partkey::VARCHAR AS slug, list_position(string_split(body, '|'), mark) - 1 AS place, len(string_split(body, '|')) AS paragraphs FROM (SELECT p_partkey, mark, CASE i WHEN 1 THEN '0|' || mark || '|1|2' WHEN 2 THEN '0|1|' || mark || '|2' ELSE '0|1|2|' || mark END AS body
FROM (SELECT p_partkey, list_position(named, wanted) AS i, '![Figure ' || wanted || '](/paper/' || p_partkey || '/fig/fig' || wanted || ')' AS mark FROM {NAMED}))""")
def g19_figure_placement(spark, folder):
    """The figure behind the first paragraph that names it, or at the end."""
    paragraphs = F.split("body", "\n\n")
    placed = figures.placed(*bodies(spark, folder)).select("slug", paragraphs.alias("p"))
    return placed.select("slug", (F.array_position(F.transform("p", lambda x: F.startswith(x, F.concat(F.lit("![Figure")))), True) - 1).alias("place"), F.size("p").cast("long").alias("paragraphs"))


@query("SELECT p_partkey::VARCHAR AS slug, len(list_filter(range(0, p_size % 4 + 1), lambda j: (p_partkey >> j) % 2 = 0)) = 0 AS complete FROM part")
def p27_complete_reports(spark, folder):
    """Reports whose contents list one to four sections, of which the bits of the key say whether they are there."""
    p = table(spark, folder, "part")
    pieces = lambda made: F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), made), "")
    nav = pieces(lambda j: F.concat(F.lit('<a href="#s'), j.cast("string"), F.lit('">x</a>')))
    there = pieces(lambda j: F.when(F.floor(F.col("p_partkey") / F.pow(F.lit(2.0), j)) % 2 == 1, F.concat(F.lit('<h2 id="s'), j.cast("string"), F.lit('">x</h2>'))).otherwise(""))
    return sinks.complete_reports(p.select(F.col("p_partkey").cast("string").alias("slug"), F.concat(F.lit("<nav>"), nav, F.lit('</nav><h2 id="other">'), there).alias("html")))
