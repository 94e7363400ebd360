"""The section index, stage by stage, over documents with generated headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as ops
from ..session import table
from .registry import query


def plain_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _with_headings(spark, folder, heading):
    two = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.array(heading(F.col("doc_id"), i), x)))
    return table(spark, folder, "documents").select("doc_id", F.posexplode(two).alias("line_no", "line"))


def headed_lines(spark, folder):
    """A generated heading before each line: numbers, parts, capitals, repeats, contents lines, references."""

    def heading(d, i):
        n = i.cast("string")
        k = (d + i) % 9
        return (
            F.when(k == 0, F.concat(F.floor(i / 2 + 1).cast("string"), F.lit(" Section "), n))
            .when(k == 1, F.concat((i + 1).cast("string"), F.lit("."), (d % 3 + 1).cast("string"), F.lit(" Part "), n, F.lit(" AP")))
            .when(k == 2, "RELATED WORK")
            .when(k == 3, F.concat(F.lit("1 Overview "), (i % 4).cast("string"), F.lit("x")))
            .when(k == 4, F.concat(F.lit("IV. RESULT "), n))
            .when(k == 5, F.when(i > 12, "References").otherwise(F.concat(F.lit("DECODED BANNER "), F.translate(n, "0123456789", "ABCDEFGHIJ"))))
            .when(k == 6, F.concat(F.floor((i + 3) / 2 + 1).cast("string"), F.lit(" Section "), (i + 3).cast("string"), F.lit(" . . . 12")))
            .when(k == 7, F.concat((i % 25).cast("string"), F.lit(". Step: value,")))
            .otherwise("")
        )

    return _with_headings(spark, folder, heading)


HEADED = r"""
WITH src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents),
gen AS (SELECT doc_id, i, t, CASE (doc_id + i) % 9
  WHEN 0 THEN (i // 2 + 1) || ' Section ' || i WHEN 1 THEN (i + 1) || '.' || (doc_id % 3 + 1) || ' Part ' || i || ' AP'
  WHEN 2 THEN 'RELATED WORK' WHEN 3 THEN '1 Overview ' || (i % 4) || 'x' WHEN 4 THEN 'IV. RESULT ' || i
  WHEN 5 THEN CASE WHEN i > 12 THEN 'References' ELSE 'DECODED BANNER ' || translate(i::VARCHAR, '0123456789', 'ABCDEFGHIJ') END
  WHEN 6 THEN ((i + 3) // 2 + 1) || ' Section ' || (i + 3) || ' . . . 12' WHEN 7 THEN (i % 25) || '. Step: value,' ELSE '' END AS h FROM src),
lines AS (SELECT doc_id, 2 * i AS line_no, h AS line FROM gen UNION ALL SELECT doc_id, 2 * i + 1, t FROM gen)"""
TRIM = r"regexp_replace({0}, '^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$', '', 'g')"
REST = TRIM.format(r"regexp_extract(label, '^(\d+)(?:\.\d+)*\.?\s+(\S.*)$', 2)")
MEASURED = HEADED + rf""",
lab AS (SELECT doc_id, line_no, line, {TRIM.format('line')} AS label FROM lines),
m1 AS (SELECT *, length(label) AS size, sum(length(label)) OVER (PARTITION BY doc_id ORDER BY line_no) AS through, count(*) OVER (PARTITION BY doc_id) AS total FROM lab),
m2 AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(line, '(?i)^\s*(?:\d+\.?\s+)?(?:references|bibliography)\s*$') AND line_no > total * 0.3 THEN line_no END) OVER (PARTITION BY doc_id), total) AS stop_at FROM m1),
m3 AS (SELECT *, sum(CASE WHEN line_no < stop_at THEN size ELSE 0 END) OVER (PARTITION BY doc_id) AS all_size FROM m2),
nt AS (SELECT *, regexp_matches(label, '^(\d+)(?:\.\d+)*\.?\s+(\S.*)$') AND length(label) < 80 AS numbered, TRY_CAST(regexp_extract(label, '^(\d+)(?:\.\d+)*\.?\s+(\S.*)$', 1) AS BIGINT) AS top, {REST} AS rest FROM m3),
d01 AS (SELECT * FROM nt WHERE label <> '' AND length(label) <= 100 AND CASE
  WHEN regexp_matches(label, '^(I{{1,3}}|IV|V|VI{{1,3}}|IX|X|XI{{0,3}})\.\s+[A-Z]') THEN true
  WHEN numbered THEN regexp_matches(rest, '^\p{{Lu}}') AND coalesce(top BETWEEN 1 AND 20, false) AND NOT regexp_matches(rest, '[-,;:]$') AND NOT regexp_matches(rest, '^(A|An|The)\s')
    AND NOT regexp_matches(rest, '\b(?:[mM]?AP\w*|AR\w*|G?FLOPs?|TFLOPs?|params?|epochs?|fps|mIoU|IoU)\b') AND NOT regexp_matches(rest, '[{{}}]') AND NOT regexp_matches(rest, '\d+\.\d')
    AND NOT (ends_with(rest, '.') AND contains(rest, ' ')) AND NOT (contains(rest, ',') AND length(rest) > 40)
  ELSE regexp_matches(label, '^[A-Z][A-Z\s]{{3,40}}$') AND length(label) > 4 AND (contains(label, ' ') OR length(label) >= 7) END)"""
D02 = MEASURED + ", d02 AS (SELECT * FROM d01 WHERE line_no < stop_at)"
D03 = D02 + r""", d03 AS (SELECT * FROM d02 a WHERE NOT EXISTS (SELECT 1 FROM d02 b WHERE b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.label = regexp_replace(a.label, '(?:\s*\.){2,}\s*\d*\s*$|\s+\d{1,3}\s*$', '', 'g') AND regexp_replace(a.label, '(?:\s*\.){2,}\s*\d*\s*$|\s+\d{1,3}\s*$', '', 'g') <> a.label))"""
D04 = D03 + ", d04 AS (SELECT * FROM d03 QUALIFY count(*) OVER (PARTITION BY doc_id, label) = 1)"
D05 = D04 + r""", o AS (SELECT * EXCLUDE (top), CASE WHEN regexp_matches(label, '^(\d+)(\.\d+)*\.?\s') THEN TRY_CAST(regexp_extract(label, '^(\d+)(\.\d+)*\.?\s', 1) AS BIGINT) END AS top, regexp_matches(label, '^(\d+)\.?\s') AS plain FROM d04),
o2 AS (SELECT *, max(top) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, count_if(plain) OVER (PARTITION BY doc_id, top ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_seen, coalesce(n_seen, 0) AS seen FROM o),
d05 AS (SELECT * FROM o2 WHERE NOT (top IS NOT NULL AND (top < coalesce(high, 0) OR (plain AND seen > 0))))"""
D06 = D05 + r""", c6 AS (SELECT *, count_if(regexp_matches(label, '^\d')) OVER (PARTITION BY doc_id) AS n_numbered FROM d05),
d06 AS (SELECT * FROM c6 WHERE n_numbered < 3 OR regexp_matches(label, '^\d') OR NOT (upper(label) = label AND regexp_matches(label, '[A-Z]')) OR regexp_matches(label, '^(ABSTRACT|INTRODUCTION|CONCLUSIONS?|REFERENCES|BIBLIOGRAPHY|APPEND(IX|ICES)|ACKNOWLED\w+|RELATED WORK|METHODS?|RESULTS|DISCUSSION|LIMITATIONS)\b'))"""
D07 = D06 + """, b7 AS (SELECT *, coalesce(lead(through - size) OVER (PARTITION BY doc_id ORDER BY line_no), all_size) - through AS body FROM d06), d07 AS (SELECT * FROM b7 WHERE body >= 80)"""
INDEX = D07 + """, idx AS (SELECT doc_id, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), stop_at) AS stop, label AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM d07)"""


def _hits(spark, folder, *stages):
    rows = ops.boundaries(ops.measured(headed_lines(spark, folder)))
    for stage in stages:
        rows = stage(rows)
    return rows.select("doc_id", "line_no", "label")


@query(MEASURED + " SELECT doc_id, line_no, label FROM d01")
def d01_section_boundaries(spark, folder):
    return _hits(spark, folder)


@query(D02 + " SELECT doc_id, line_no, label FROM d02")
def d02_cut_at_references(spark, folder):
    return _hits(spark, folder, ops.cut_at_references)


@query(D03 + " SELECT doc_id, line_no, label FROM d03")
def d03_contents_dropped(spark, folder):
    return _hits(spark, folder, ops.cut_at_references, ops.drop_contents)


@query(D04 + " SELECT doc_id, line_no, label FROM d04")
def d04_repeats_dropped(spark, folder):
    return _hits(spark, folder, ops.cut_at_references, ops.drop_contents, ops.drop_repeats)


@query(D05 + " SELECT doc_id, line_no, label FROM d05")
def d05_backwards_dropped(spark, folder):
    return _hits(spark, folder, ops.cut_at_references, ops.drop_contents, ops.drop_repeats, ops.drop_backwards)


@query(D06 + " SELECT doc_id, line_no, label FROM d06")
def d06_banners_dropped(spark, folder):
    return _hits(spark, folder, ops.cut_at_references, ops.drop_contents, ops.drop_repeats, ops.drop_backwards, ops.drop_banners)


@query(INDEX + " SELECT doc_id, start, stop, heading, ordinal FROM idx")
def d07_section_index(spark, folder):
    return ops.section_index(headed_lines(spark, folder))


@query(INDEX + " SELECT doc_id, start || '-' || stop || ': ' || heading AS line, ordinal FROM idx")
def s26_section_index_lines(spark, folder):
    found = ops.section_index(headed_lines(spark, folder))
    return found.select("doc_id", F.concat(F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(": "), "heading").alias("line"), "ordinal")


@query(INDEX + r", s AS (SELECT doc_id, start || '-' || stop || ': ' || heading AS line FROM idx UNION ALL SELECT doc_id, '# ' || source FROM documents) SELECT doc_id, TRY_CAST(regexp_extract(line, '^(\d+)-(\d+):\s*(.+)$', 1) AS INT) AS start, TRY_CAST(regexp_extract(line, '^(\d+)-(\d+):\s*(.+)$', 2) AS INT) AS stop, regexp_extract(line, '^(\d+)-(\d+):\s*(.+)$', 3) AS heading FROM s WHERE regexp_matches(line, '^(\d+)-(\d+):\s*(.+)$')")
def s05_parsed_index(spark, folder):
    """Index lines parsed again; comments and other lines are skipped."""
    pattern = r"^(\d+)-(\d+):\s*(.+)$"
    comments = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("# "), "source").alias("line"))
    lines = s26_section_index_lines(spark, folder).select("doc_id", "line").unionByName(comments).where(F.col("line").rlike(pattern))
    return lines.select("doc_id", F.regexp_extract("line", pattern, 1).cast("int").alias("start"), F.regexp_extract("line", pattern, 2).cast("int").alias("stop"), F.regexp_extract("line", pattern, 3).alias("heading"))


@query(D02 + " SELECT doc_id, label, count(*) AS n FROM d02 GROUP BY 1, 2")
def a16_label_multiplicity(spark, folder):
    return _hits(spark, folder, ops.cut_at_references).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(D02 + r" SELECT doc_id, count_if(regexp_matches(label, '^\d')) >= 3 AS numbered FROM d02 GROUP BY 1")
def a17_numbered_gate(spark, folder):
    return _hits(spark, folder, ops.cut_at_references).groupBy("doc_id").agg((F.count_if(F.col("label").rlike(r"^\d")) >= 3).alias("numbered"))


@query(D07 + " SELECT doc_id, line_no, body FROM d07")
def a18_body_length(spark, folder):
    rows = ops.cut_at_references(ops.boundaries(ops.measured(headed_lines(spark, folder))))
    for stage in (ops.drop_contents, ops.drop_repeats, ops.drop_backwards, ops.drop_banners, ops.drop_bodyless):
        rows = stage(rows)
    return rows.select("doc_id", "line_no", "body")


@query(MEASURED + " SELECT DISTINCT doc_id, total, stop_at AS \"end\" FROM m3")
def a19_bibliography_line(spark, folder):
    return ops.measured(headed_lines(spark, folder)).select("doc_id", "total", "end").distinct()


@query(INDEX + r" SELECT doc_id, nullif(count_if(NOT regexp_matches(heading, '(?i)reference|acknowledg')), 0) AS main_sections FROM idx GROUP BY 1")
def a21_main_sections(spark, folder):
    found = ops.section_index(headed_lines(spark, folder))
    return found.groupBy("doc_id").agg(F.nullif(F.count_if(~F.col("heading").rlike("(?i)reference|acknowledg")), F.lit(0)).alias("main_sections"))


@query(HEADED + ", n AS (SELECT doc_id, line_no AS l, label FROM (SELECT doc_id, line_no, line AS label FROM lines) WHERE starts_with(label, 'IV.')), x AS (SELECT doc_id, min(l) AS line_no FROM n GROUP BY 1)" + INDEX[len(HEADED):] + " SELECT x.doc_id AS doc_id, x.line_no AS line_no, idx.heading AS heading FROM x LEFT JOIN idx ON idx.doc_id = x.doc_id AND x.line_no >= idx.start AND x.line_no < idx.stop")
def j04_section_of_first_mention(spark, folder):
    """The first line that mentions a label, and the section that holds it."""
    lines = headed_lines(spark, folder)
    mentions = lines.where(F.startswith("line", F.lit("IV."))).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    return ops.section_of_line(mentions, ops.section_index(lines))


@query(D03 + " SELECT doc_id, line_no, label FROM d02 EXCEPT ALL SELECT doc_id, line_no, label FROM d03")
def j31_contents_lines(spark, folder):
    every = ops.cut_at_references(ops.boundaries(ops.measured(headed_lines(spark, folder))))
    return every.join(ops.drop_contents(every).select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no", "label")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2) SELECT doc_id, line FROM c WHERE n = 1")
def x11_unrepeated_lines(spark, folder):
    """Lines that come once in their document; both copies of a repeated one go."""
    lines = plain_lines(spark, folder).where(F.trim("line") != "")
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id", "line")


def marked_lines(spark, folder):
    def heading(d, i):
        k = (d + i) % 5
        level = F.when(i == 0, F.when(d % 2 == 0, 1).otherwise(2)).otherwise(i % 3 + 2)
        return F.when((i == 0) & (d % 4 == 3), "").when((k == 0) | (i == 0), F.concat(F.repeat(F.lit("#"), level), F.lit(" Head "), i.cast("string"), F.lit(" ##"))).otherwise("")

    return _with_headings(spark, folder, heading)


MARKED = """
WITH src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents),
gen AS (SELECT doc_id, i, t, CASE WHEN i = 0 AND doc_id % 4 = 3 THEN '' WHEN (doc_id + i) % 5 = 0 OR i = 0 THEN repeat('#', CASE WHEN i = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END ELSE i % 3 + 2 END) || ' Head ' || i || ' ##' ELSE '' END AS h FROM src),
lines AS (SELECT doc_id, 2 * i AS line_no, h AS line FROM gen UNION ALL SELECT doc_id, 2 * i + 1, t FROM gen),
tot AS (SELECT doc_id, count(*) AS total FROM lines GROUP BY 1),
f AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,6})\\s+(\\S.*?)\\s*#*\\s*$', 1)) AS level, regexp_extract(line, '^(#{1,6})\\s+(\\S.*?)\\s*#*\\s*$', 2) AS heading FROM lines),
w AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS least, max(level) OVER (PARTITION BY doc_id) AS most, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM f WHERE level > 0),
w2 AS (SELECT *, count_if(level = least) OVER (PARTITION BY doc_id) AS tops FROM w),
k AS (SELECT doc_id, line_no, heading FROM w2 WHERE NOT (n = 1 AND level = least AND tops = 1 AND least < most)),
e AS (SELECT * FROM k UNION ALL SELECT doc_id, 0, 'Introduction' FROM (SELECT doc_id, min(line_no) AS f FROM k GROUP BY 1) WHERE f > 1 UNION ALL SELECT doc_id, 0, 'Body' FROM tot WHERE doc_id NOT IN (SELECT doc_id FROM k))"""


@query(MARKED + " SELECT e.doc_id AS doc_id, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY e.doc_id ORDER BY line_no), total) AS stop, heading FROM e JOIN tot ON tot.doc_id = e.doc_id")
def d08_markdown_index(spark, folder):
    return ops.markdown_index(marked_lines(spark, folder))


@query(MARKED + " SELECT doc_id, min(level) AS least, max(level) AS most, count_if(level = least) AS tops FROM w2 GROUP BY 1")
def a29_heading_levels(spark, folder):
    levels = marked_lines(spark, folder).select("doc_id", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).alias("level")).where("level > 0")
    counted = levels.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_id").agg(F.min("level").alias("least"), F.max("level").alias("most"), F.min_by("n", "level").alias("tops"))


@query(MARKED + ", a AS (SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^#{1,4}\\s') THEN trim(regexp_replace(line, '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading, line FROM lines) SELECT doc_id, line_no, heading FROM a WHERE line_no % 2 = 1")
def j24_nearest_heading_above(spark, folder):
    """Each line with the nearest heading of the first four levels above it."""
    from pyspark.sql import Window

    own = F.when(F.col("line").rlike(r"^#{1,4}\s"), F.trim(F.regexp_replace("line", "^#+", "")))
    rows = marked_lines(spark, folder).withColumn("heading", F.last(own, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("line_no % 2 = 1").select("doc_id", "line_no", "heading")


@query("SELECT conv_id, turn, CASE WHEN contains(text, '미진행') OR length(text) < 40 THEN 'not_started' ELSE 'done' END AS state FROM conversations")
def p20_section_state(spark, folder):
    state = F.when(F.contains("text", F.lit("미진행")) | (F.length("text") < 40), "not_started").otherwise("done")
    return table(spark, folder, "conversations").select("conv_id", "turn", state.alias("state"))


@query("SELECT conv_id, turn, length(trim(text)) > 20 AND NOT starts_with(trim(text), '_(') AS real FROM conversations WHERE role = 'assistant'")
def p14_real_answer(spark, folder):
    t = F.trim("text")
    return table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", ((F.length(t) > 20) & ~F.startswith(t, F.lit("_("))).alias("real"))
