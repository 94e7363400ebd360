"""From lines of a text to its section index: one shuffle by document, then windows over it.

A line is a heading by its form; a chain of filters then drops what only looks like one. Frames carry doc_id, line_no
(from 0), and, from the start, running sizes of line texts, so that a section's body is a difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

# Forms of headings and limits.
ROMAN = r"^(I{1,3}|IV|V|VI{1,3}|IX|X|XI{0,3})\.\s+[A-Z]"
NUMBERED = r"^(\d+)(?:\.\d+)*\.?\s+(\S.*)$"
ALL_CAPS = r"^[A-Z][A-Z\s]{3,40}$"
METRIC = r"\b(?:[mM]?AP\w*|AR\w*|G?FLOPs?|TFLOPs?|params?|epochs?|fps|mIoU|IoU)\b"
REFERENCES = r"(?i)^\s*(?:\d+\.?\s+)?(?:references|bibliography)\s*$"
TOC_TAIL = r"(?:\s*\.){2,}\s*\d*\s*$|\s+\d{1,3}\s*$"
STANDARD = r"^(ABSTRACT|INTRODUCTION|CONCLUSIONS?|REFERENCES|BIBLIOGRAPHY|APPEND(IX|ICES)|ACKNOWLED\w+|RELATED WORK|METHODS?|RESULTS|DISCUSSION|LIMITATIONS)\b"
ORDINAL = r"^(\d+)(\.\d+)*\.?\s"
LONGEST, LONGEST_NUMBERED, BODY = 100, 80, 80


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def whole() -> WindowSpec:
    return Window.partitionBy("doc_id")


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$", "")


def is_numbered_title(label: Column) -> Column:
    """Whether a line led by a number reads like a title, not like data, a list item or a sentence."""
    top, rest = F.regexp_extract(label, NUMBERED, 1).try_cast("bigint"), trimmed(F.regexp_extract(label, NUMBERED, 2))
    reasons_against = (
        ~rest.rlike(r"^\p{Lu}")
        | ~F.coalesce(top.between(1, 20), F.lit(False))
        | rest.rlike(r"[-,;:]$")
        | rest.rlike(r"^(A|An|The)\s")
        | rest.rlike(METRIC)
        | rest.rlike(r"[{}]")
        | rest.rlike(r"\d+\.\d")
        | (rest.rlike(r"\.$") & F.contains(rest, F.lit(" ")))
        | (F.contains(rest, F.lit(",")) & (F.length(rest) > 40))
    )
    return ~reasons_against


def is_heading(label: Column) -> Column:
    """Roman or Arabic number with a title, or a short line of capitals. A numbered line is never taken for the latter."""
    numbered = label.rlike(NUMBERED) & (F.length(label) < LONGEST_NUMBERED)
    capitals = label.rlike(ALL_CAPS) & (F.length(label) > 4) & (F.contains(label, F.lit(" ")) | (F.length(label) >= 7))
    form = F.when(label.rlike(ROMAN), True).when(numbered, is_numbered_title(label)).otherwise(capitals)
    return (label != "") & (F.length(label) <= LONGEST) & form


def measured(lines: DataFrame) -> DataFrame:
    """Lines with label, sizes up to and before them, and the index's end: the last bibliography line behind 30 % of the
    text, else the number of lines."""
    rows = lines.select("doc_id", "line_no", "line", trimmed(F.col("line")).alias("label")).withColumn("size", F.length("label"))
    rows = rows.withColumns({"through": F.sum("size").over(by_doc()), "total": F.count(F.lit(1)).over(whole())})
    bibliography = F.when(F.col("line").rlike(REFERENCES) & (F.col("line_no") > F.col("total") * 0.3), F.col("line_no"))
    rows = rows.withColumn("end", F.coalesce(F.max(bibliography).over(whole()), F.col("total")))
    return rows.withColumn("all_size", F.sum(F.when(F.col("line_no") < F.col("end"), F.col("size")).otherwise(0)).over(whole()))


def boundaries(rows: DataFrame) -> DataFrame:
    return rows.where(is_heading(F.col("label")))


def cut_at_references(hits: DataFrame) -> DataFrame:
    return hits.where("line_no < end")


def drop_contents(hits: DataFrame) -> DataFrame:
    """Without lines that, less dots and page number, come again as a later heading."""
    later = hits.select(F.col("doc_id").alias("_doc"), F.col("label").alias("_label"), F.col("line_no").alias("_line"))
    bare = F.regexp_replace("label", TOC_TAIL, "")
    again = (F.col("doc_id") == F.col("_doc")) & (bare == F.col("_label")) & (F.col("_line") > F.col("line_no")) & (bare != F.col("label"))
    return hits.join(later, again, "left_anti")


def drop_repeats(hits: DataFrame) -> DataFrame:
    """Without all copies of a label that comes more than once."""
    return hits.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "label"))).where("_copies = 1").drop("_copies")


def drop_backwards(hits: DataFrame) -> DataFrame:
    """Without numbers below an earlier one, and without a second plain number; unnumbered lines stay."""
    top = F.when(F.col("label").rlike(ORDINAL), F.regexp_extract("label", ORDINAL, 1).try_cast("bigint"))
    plain = F.col("_top").isNotNull() & (F.regexp_extract("label", ORDINAL, 2) == "")
    rows = hits.withColumn("_top", top).withColumn("_plain", plain)
    seen = F.count_if("_plain").over(Window.partitionBy("doc_id", "_top").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_high": F.max("_top").over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), "_seen": seen})
    back = F.col("_top").isNotNull() & ((F.col("_top") < F.coalesce("_high", F.lit(0))) | (F.col("_plain") & (F.col("_seen") > 0)))
    return rows.where(~back).drop("_top", "_plain", "_high", "_seen")


def drop_banners(hits: DataFrame) -> DataFrame:
    """In a text of three numbered headings or more, lines of capitals must be standard titles."""
    numbered = F.col("label").rlike(r"^\d")
    banner = ~numbered & (F.upper("label") == F.col("label")) & F.col("label").rlike("[A-Z]") & ~F.col("label").rlike(STANDARD)
    return hits.withColumn("_numbered", F.count_if(numbered).over(whole())).where((F.col("_numbered") < 3) | ~banner).drop("_numbered")


def drop_bodyless(hits: DataFrame, least: int = BODY) -> DataFrame:
    """Without headings that own fewer characters than ``least`` before the next one."""
    rows = hits.withColumn("_before", F.col("through") - F.col("size"))
    body = F.coalesce(F.lead("_before").over(by_doc()), F.col("all_size")) - F.col("through")
    return rows.withColumn("body", body).where(F.col("body") >= least).drop("_before")


def ranges(hits: DataFrame) -> DataFrame:
    """doc_id, start, stop (exclusive), heading, ordinal."""
    return hits.select("doc_id", F.col("line_no").alias("start"), F.lead("line_no").over(by_doc()).alias("_next"), "end", F.col("label").alias("heading"), F.row_number().over(by_doc()).alias("ordinal")).select("doc_id", "start", F.coalesce("_next", "end").alias("stop"), "heading", "ordinal")


def section_index(lines: DataFrame) -> DataFrame:
    """All filters in order, then ranges."""
    hits = cut_at_references(boundaries(measured(lines)))
    return ranges(drop_bodyless(drop_banners(drop_backwards(drop_repeats(drop_contents(hits))))))


def markdown_index(lines: DataFrame) -> DataFrame:
    """Sections of a marked-up text: headings in order but for a single top title; an introduction before a first heading
    that stands below the second line; a text without headings is one body."""
    pattern = r"^(#{1,6})\s+(\S.*?)\s*#*\s*$"
    totals = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    found = lines.select("doc_id", "line_no", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("heading")).where("level > 0")
    rows = found.withColumns({"_least": F.min("level").over(whole()), "_most": F.max("level").over(whole()), "_n": F.row_number().over(by_doc())})
    rows = rows.withColumn("_top", F.count_if(F.col("level") == F.col("_least")).over(whole()))
    title = (F.col("_n") == 1) & (F.col("level") == F.col("_least")) & (F.col("_top") == 1) & (F.col("_least") < F.col("_most"))
    kept = rows.where(~title).select("doc_id", "line_no", "heading")
    lead = kept.groupBy("doc_id").agg(F.min("line_no").alias("first")).where("first > 1").select("doc_id", F.lit(0).alias("line_no"), F.lit("Introduction").alias("heading"))
    body = totals.join(kept.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("line_no"), F.lit("Body").alias("heading"))
    every = kept.unionByName(lead).unionByName(body).join(totals, "doc_id")
    return every.select("doc_id", F.col("line_no").alias("start"), F.coalesce(F.lead("line_no").over(by_doc()), F.col("total").cast("int")).alias("stop"), "heading")


def section_of_line(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """Each mention (doc_id, line_no) with the heading of the section that holds its line; null outside all sections.

    Sections of a document don't overlap, so an equi-join on the document with a range condition finds one at most.
    """
    inside = (F.col("m.doc_id") == F.col("s.doc_id")) & (F.col("m.line_no") >= F.col("s.start")) & (F.col("m.line_no") < F.col("s.stop"))
    return mentions.alias("m").join(sections.alias("s"), inside, "left").select("m.*", "s.heading")
