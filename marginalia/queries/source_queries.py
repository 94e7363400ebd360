"""Archives, style sheets and colours that are made from the values of parts and customers."""

from __future__ import annotations

import gzip
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..functions import colors, css
from ..session import dealt, materialize, table
from ..sources import archives
from .registry import query

TEX = r"""\begin{figure*}\centering\includegraphics[width=1]{img/%(name)s}\caption[s]{\textbf{Figure %(size)d} of {a}
 %(name)s}\end{figure*} no \includegraphics{img/stray}
\begin{figure}\caption{A \emph{%(name)s}}\includegraphics{plots/%(name)s-}\includegraphics{img/%(name)s}\end{figure}
\begin{figure}text only\end{figure}\begin{figure}\includegraphics{ %(third)s }\caption{Table 4A: y}\end{figure}"""


def archive_of(name: str, size: int) -> bytes:
    """A tar archive of LaTeX and images that are named after a part."""
    text = TEX % {"name": name, "size": size, "third": "nowhere" if size % 3 == 0 else f"other_{size}"}
    blocks = []
    for path, content in (("main.tex", text.encode()), (f"src/img/{name}.{'jpeg' if size % 2 else 'png'}", b"1"), (f"{name}-b.pdf", b"2"), ("notes.txt", b"-"), (f"other_{size}.svg", b"3"), (f"old/other_{size}.svg", b"4")):
        info = tarfile.TarInfo(path)
        info.size = len(content)
        blocks += [info.tobuf(), content, bytes(-len(content) % tarfile.BLOCKSIZE)]
    archive = b"".join(blocks) + bytes(2 * tarfile.BLOCKSIZE)
    return gzip.compress(archive, 1) if size % 2 else archive


def part_archives(spark, folder):
    make = F.arrow_udf(lambda names, sizes: pa.array(map(archive_of, names.to_pylist(), sizes.to_pylist()), pa.binary()), T.BinaryType())
    parts = dealt(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", per_task=2_500)
    return parts.select(F.col("p_partkey").cast("string").alias("path"), make("p_name", "p_size").alias("content"))


@query("""SELECT p_partkey::VARCHAR AS archive, n, name, size FROM part, LATERAL (VALUES (1, 'src/img/' || p_name || CASE WHEN p_size % 2 = 1 THEN '.jpeg' ELSE '.png' END, 1), (2, p_name || '-b.pdf', 1), (3, 'other_' || p_size || '.svg', 1), (4, 'old/other_' || p_size || '.svg', 1)) m(n, name, size)""")
def s13_archive_members(spark, folder):
    """The images in archives, packed or not, whose contents aren't read."""
    return archives.members(part_archives(spark, folder), contents=()).where(~F.lower("name").endswith(".tex")).select("archive", "n", "name", "size")


@query("""SELECT p_partkey::VARCHAR AS archive, pos, name, label, id, caption FROM part, LATERAL (VALUES
(1, 'src/img/' || p_name || CASE WHEN p_size % 2 = 1 THEN '.jpeg' ELSE '.png' END, 'Figure ' || p_size, 'fig' || p_size, 'Figure ' || p_size || ' of a ' || p_name),
(2, p_name || '-b.pdf', 'Figure 2', 'fig2', 'A ' || p_name),
(3, CASE WHEN p_size % 3 > 0 THEN 'other_' || p_size || '.svg' END, 'Table 4', 'tbl4', 'Table 4A: y')) m(pos, name, label, id, caption) WHERE name IS NOT NULL""")
def j29_archive_figures(spark, folder):
    """LaTeX figures with the members that they mean: by the name with an ending, by its beginning, or none."""
    found = materialize(archives.members(part_archives(spark, folder)), "members")  # archives are read once
    return archives.labelled(archives.matched(materialize(archives.figures(found), "figures"), found)).select("archive", "pos", "name", "label", "id", "caption")


CSS_SQL = "(SELECT p_partkey, p_name, p_size, length(p_name) AS a, length(p_size::VARCHAR) AS b, CASE WHEN p_size % 2 = 0 THEN 5 ELSE 4 END AS s FROM part)"


@query(f"""SELECT p_partkey, selector, depth, start::INT AS start, stop::INT AS stop FROM {CSS_SQL}, LATERAL (VALUES
('.' || replace(p_name, ' ', '.'), 0, a + 2, a + 2 + 2 + b),
('@media (prefers-color-scheme: ' || CASE WHEN p_size % 2 = 0 THEN 'light' ELSE 'dark' END || ')', 0, 2 * a + b + 48 + s, 3 * a + 2 * b + 108 + s),
(':root', 1, 2 * a + b + 54 + s, 2 * a + 2 * b + 58 + s),
('p::after', 1, 2 * a + 2 * b + 74 + s, 3 * a + 2 * b + 105 + s)) m(selector, depth, start, stop)""")
def w15_style_blocks(spark, folder):
    """Nested blocks of style sheets whose strings and comments hold brackets; the last block is never closed."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    scheme = F.when(F.col("p_size") % 2 == 0, "light").otherwise("dark")
    sheet = F.concat(F.lit("."), F.replace(name, F.lit(" "), F.lit(".")), F.lit("{x:"), size, F.lit("}/* { "), name, F.lit(" */}\n@media (prefers-color-scheme: "), scheme, F.lit(") {:root{--n:"), size, F.lit("} /*}*/p::after{content:'}"), name, F.lit("\\'{'; a:\"}\"; b:url(x)}; } .open { x:1;"))
    return table(spark, folder, "part").select("p_partkey", F.explode(css.blocks(sheet)).alias("b")).select("p_partkey", "b.*")


def lin(part: str) -> str:
    """A colour's part as light, in DuckDB."""
    return f"(CASE WHEN {part} / 255.0 <= 0.03928 THEN {part} / 255.0 / 12.92 ELSE pow(({part} / 255.0 + 0.055) / 1.055, 2.4) END)"


@query(f"""WITH c AS (SELECT c_custkey, c_custkey * 37 % 256 AS r, c_nationkey * 11 % 256 AS g, c_custkey % 251 AS b, (c_custkey * 13) % 256 AS br, (c_custkey // 7) % 256 AS bg, (c_nationkey * 9) % 256 AS bb, 10 + c_custkey % 20 AS size, CASE WHEN c_custkey % 3 = 0 THEN 700 ELSE 400 END AS weight FROM customer),
l AS (SELECT *, 0.2126 * {lin('br')} + 0.7152 * {lin('bg')} + 0.0722 * {lin('bb')} AS behind, CASE WHEN size >= 24 OR (size >= 18.66 AND weight >= 700) THEN 3 ELSE 4.5 END AS need FROM c),
s AS (SELECT *, unnest(range(0, 11)) AS k, CASE WHEN behind > 0.4 THEN 0 ELSE 255 END AS t FROM l),
m AS (SELECT *, r + (t - r) * k / 10 AS mr, g + (t - g) * k / 10 AS mg, b + (t - b) * k / 10 AS mb FROM s),
q AS (SELECT *, (greatest(o, behind) + 0.05) / (least(o, behind) + 0.05) AS ratio FROM (SELECT *, 0.2126 * {lin('mr')} + 0.7152 * {lin('mg')} + 0.0722 * {lin('mb')} AS o FROM m))
SELECT c_custkey, k > 0 AS fixed, (CASE WHEN k > 0 THEN floor(mr + 0.5) ELSE mr END)::DOUBLE AS r, (CASE WHEN k > 0 THEN floor(mg + 0.5) ELSE mg END)::DOUBLE AS g, (CASE WHEN k > 0 THEN floor(mb + 0.5) ELSE mb END)::DOUBLE AS b, round(ratio, 6) AS ratio FROM q
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ratio < need, CASE WHEN ratio < need THEN -k ELSE k END) = 1""")
def m17_contrast(spark, folder):
    """Text colours that don't read on their background are mixed with black or white in ten steps until they do."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    css_color = lambda *parts: F.concat(F.lit("rgb("), F.concat_ws(", ", *[p.cast("string") for p in parts]), F.lit(")"))
    text, behind = css_color(k * 37 % 256, n * 11 % 256, k % 251), css_color(k * 13 % 256, F.floor(k / 7) % 256, n * 9 % 256)
    need = colors.needed(10 + k % 20, F.when(k % 3 == 0, 700).otherwise(400))
    parts = {f"{name}{i}": part for name, color in (("t", text), ("b", behind)) for i, part in enumerate(colors.rgb(color))}
    rows = dealt(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", need.alias("need"), *[part.alias(name) for name, part in parts.items()])
    rows = rows.select("c_custkey", colors.repaired(*[tuple(F.col(f"{name}{i}") for i in range(3)) for name in "tb"], F.col("need")).alias("c"))
    return rows.select("c_custkey", "c.fixed", "c.r", "c.g", "c.b", F.round("c.ratio", 6).alias("ratio"))
