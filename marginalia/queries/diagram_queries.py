"""Diagrams with nested groups, classes and paths, drawn from the values of parts and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import diagrams
from ..session import dealt, table
from .markup_queries import em
from .registry import query

PART = "(SELECT p_partkey::VARCHAR AS key, p_partkey % 11 AS a, p_partkey % 17 AS b, p_partkey % 30 AS c, p_size AS s, p_name FROM part)"


def drawn(spark, folder, *pieces) -> DataFrame:
    """One diagram for each part: ``pieces`` inside an svg element."""
    return dealt(table(spark, folder, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit('<svg viewBox="0 0 400 200" xmlns="http://www.w3.org/2000/svg">'), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces], F.lit("</svg>")).alias("svg"))


@query(f"""SELECT key, 'rect' AS kind, (s + 2 + a)::DOUBLE AS x, (b + 3 + 2)::DOUBLE AS y, (s + 20)::DOUBLE AS w, c::DOUBLE AS h, NULL::DOUBLE AS size FROM {PART} WHERE c > 0
UNION ALL SELECT key, 'ellipse', (s + 7 - a)::DOUBLE, (b + s - 5)::DOUBLE, (2 * a)::DOUBLE, 10::DOUBLE, NULL FROM {PART}
UNION ALL SELECT key, 'polygon', 0, 0, greatest(s, 3)::DOUBLE, greatest(4, b)::DOUBLE, NULL FROM {PART}
UNION ALL SELECT key, 'text', (s + 2 + 4)::DOUBLE, (b + 3 + 9)::DOUBLE, NULL, NULL, (10 + a)::DOUBLE FROM {PART}
UNION ALL SELECT key, 'text', (s + 2 + b)::DOUBLE, (b + 3 + 9 + 1.5 * (10 + a))::DOUBLE, NULL, NULL, (10 + a)::DOUBLE FROM {PART}""")
def w18_diagram_tree(spark, folder):
    """Offsets of nested groups and sizes of classes; what is rotated, hidden or empty has no shape."""
    p, s, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    a, b, c = p % 11, p % 17, p % 30
    pieces = ["<style>.big, .k { font-size: ", 10 + a, 'px } .other{font-size:3px}</style><g transform="translate(', s, ",", b, ')"><g transform=" translate( 2 3 ) " class="other k"><rect x="', a, '" y="2" width="', s + 20, '" height="', c, '"/><text x="4" y="9">', name]
    pieces += ['<tspan x="', b, '" dy="1.5em">second</tspan></text></g><ellipse cx="7" cy="', s, '" rx="', a, '" ry="5"/></g><g transform="rotate(9)"><rect width="50" height="50"/></g><defs><rect width="50" height="50"/></defs><polygon points="0,0 ', s, ",4 3,", b, '"/>']
    shapes = diagrams.shapes(drawn(spark, folder, *pieces)).where("kind <> 'view'")
    return shapes.select("key", "kind", F.coalesce("x0", "ax").alias("x"), F.round(F.coalesce("y0", "ay"), 6).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "size")


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k, q, s) AS pos, k, q, s FROM (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS k, l_quantity::INT AS q, l_suppkey % 20 AS s FROM lineitem)),
g AS (SELECT *, count_if(k = 5) OVER (PARTITION BY l_orderkey ORDER BY pos) AS part FROM l)
SELECT l_orderkey::VARCHAR AS key, pos::INT AS pos, sum(CASE WHEN k = 2 THEN 0 ELSE q END) OVER w::DOUBLE AS x, sum(CASE WHEN k = 1 THEN 0 ELSE s END) OVER w::DOUBLE AS y, k IN (0, 1, 2, 5) AS straight FROM g
WINDOW w AS (PARTITION BY l_orderkey, part ORDER BY pos)
UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, 0, 0, 0, NULL FROM lineitem""")
def m14_path_vertices(spark, folder):
    """The vertices of a path whose commands are an order's lines: relative ones add up from the last absolute one."""
    k, q, s = F.col("k"), F.col("q").cast("string"), F.col("s").cast("string")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 6).cast("int").alias("k"), F.col("l_quantity").cast("int").alias("q"), (F.col("l_suppkey") % 20).alias("s"))
    to = F.concat(q, F.lit(" "), s)
    step = F.when(k == 0, F.concat(F.lit("l"), q, F.lit(","), s)).when(k == 1, F.concat(F.lit("h"), q)).when(k == 2, F.concat(F.lit("v "), s)).when(k == 3, F.concat(F.lit("c1-1 2.5.5 "), to)).when(k == 4, F.concat(F.lit("a 5 5 0 0 1 "), to)).otherwise(F.concat(F.lit("L"), to))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "k", "q", "s", step.alias("step"))))
    paths = lines.groupBy("l_orderkey").agg(F.array_join(ordered["step"], "").alias("d"))
    svgs = paths.select(F.col("l_orderkey").cast("string").alias("key"), F.concat(F.lit('<svg><path fill="none" d="M0 0'), "d", F.lit('M1 1L2 2"/></svg>')).alias("svg"))
    points = diagrams.shapes(svgs).select("key", "straight", F.posexplode("points").alias("pos", "p"))
    return points.select("key", "pos", "p.x", "p.y", F.when(F.col("pos") > 0, F.get("straight", F.col("pos") - 1)).alias("straight"))


@query(f"SELECT p_partkey::VARCHAR AS key, 'TEXT_CLIPPED' AS code, p_name AS s FROM part WHERE 250 + 2 * p_size + {em('p_name')} * 16 * 0.9 - 400 > 4")
def j26_clipped_labels(spark, folder):
    return diagrams.clipped(drawn(spark, folder, '<text x="', 250 + 2 * F.col("p_size"), '" y="50">', F.col("p_name"), "</text>"))


@query(f"""SELECT key, 'TEXT_OVERLAP' AS code, p_name AS s FROM (SELECT p_partkey::VARCHAR AS key, p_name, 50 + {em("p_name")} * 16 * 0.9 AS r1, 40 + 3 * p_size AS l2, 40 + 3 * p_size + {em("p_type")} * 16 * 0.9 AS r2, p_partkey % 23 AS dy FROM part)
WHERE least(r1, r2) - greatest(50, l2) > 4 AND 16 - dy > 1""")
def j27_overlapping_labels(spark, folder):
    """Two labels of a part, side by side or below each other by its size and key."""
    pieces = ['<text x="50" y="50">', F.col("p_name"), '</text><g transform="translate(40,0)"><text x="', 3 * F.col("p_size"), '" y="', 50 + F.col("p_partkey") % 23, '">', F.col("p_type"), "</text></g>"]
    return diagrams.overlaps(drawn(spark, folder, *pieces))


@query("""WITH d AS (SELECT p_partkey::VARCHAR AS key, 300 + p_size AS tip, 30 + p_partkey % 90 AS y FROM part)
SELECT key, 'DANGLING_ARROW' AS code FROM d WHERE tip + 14 < 340 UNION ALL SELECT key, 'EDGE_THROUGH_BOX' FROM d WHERE y + 6 <= 100 AND 100 <= y + 74""")
def j28_connectors(spark, folder):
    """A path leaves a box, passes or crosses a second one by that one's height, and reaches a third one or falls short."""
    box = '<rect x="{}" y="{}" width="{}" height="{}"/>'.format
    pieces = ['<style>.f{fill:none;marker-end:url(#a)}</style><g transform="translate(', F.col("p_partkey") % 7, ',5)">', box(10, 80, 40, 40), box(340, 80, 40, 40), '<rect x="150" y="', 30 + F.col("p_partkey") % 90, '" width="80" height="80"/><path class="f" d="M50 100 h100 H', 300 + F.col("p_size"), '"/></g>']
    return diagrams.lint(drawn(spark, folder, *pieces)).select("key", "code")
