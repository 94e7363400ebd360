"""Source archives of papers: their members as rows, the figures that their LaTeX names, and the files that are meant."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import shuffled

# What is text, what is an image, in the order in which endings are tried, and how LaTeX says it.
TEXT, IMAGES = (".tex",), (".png", ".pdf", ".jpg", ".jpeg", ".svg", ".eps")
FIGURE = r"(?s)\\begin\{figure\*?\}(.*?)\\end\{figure\*?\}"
GRAPHIC = r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}"
CAPTION = r"(?s)\\caption(?:\[[^\]]*\])?\{((?:[^{}]++|\{[^{}]*\})*+)\}"
COMMAND = r"\\[a-zA-Z]+\*?\s*"
NUMBERED = r"^(Figure|Fig\.?|Table|Tab\.?)\s+(\d+[a-z]?)"

#: Members and bytes of their contents that are handed on together.
TOGETHER, TOGETHER_BYTES = 4096, 1 << 20

MEMBER = "archive string, n int, name string, size long, content binary, error string"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the archives in a folder of any store; Spark reads them whole, up to 2 GB each."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def members(found: DataFrame, endings: Sequence[str] = TEXT + IMAGES, contents: Sequence[str] = TEXT) -> DataFrame:
    """archive, n, name, size, content, error: the files in archives (path, content) whose names end in one of ``endings``,
    in the archive's order; only those with one of the endings ``contents`` are read.

    A tar archive is read member by member, packed by gzip or not. One that is damaged gives what came before the damage
    and a row with an error and no name; null, empty and other files give the error alone.
    """
    keep, wanted = tuple(endings), tuple(contents)

    def of(path: str, raw: bytes | None) -> Iterator[tuple]:
        n = 0
        try:
            with tarfile.open(fileobj=io.BytesIO(raw or b""), mode="r|*") as archive:
                for member in archive:
                    name = member.name.lower()
                    if member.isfile() and name.endswith(keep):
                        yield path, n, member.name, member.size, archive.extractfile(member).read() if name.endswith(wanted) else None, None
                        n += 1
        except (tarfile.TarError, EOFError, OSError) as failed:
            yield path, n, None, None, None, f"{type(failed).__name__}: {failed}"

    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["archive", "n", "name", "size", "content", "error"])
        for batch in batches:
            rows, held = [], 0
            for path, raw in zip(batch.column(0), batch.column(1)):
                for row in of(path.as_py(), raw.as_py()):  # one archive at a time
                    rows.append(row)
                    held += len(row[4] or b"")
                    if len(rows) >= TOGETHER or held >= TOGETHER_BYTES:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return found.select("path", "content").mapInArrow(run, MEMBER)


def plain_caption(caption: Column) -> Column:
    """A caption without LaTeX commands, braces and double blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(caption, COMMAND, " "), r"[{}]", ""), r"\s+", " "))


def figures(found: DataFrame) -> DataFrame:
    """archive, pos, graphic, caption: the figures of an archive's LaTeX files (members with their content) that show a
    graphic, in order; of several graphics the first."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    tex = found.where(F.lower("name").endswith(".tex")).select("archive", "n", F.posexplode(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(1))).alias("m", "body"))
    rows = tex.select("archive", "n", "m", F.trim(F.regexp_extract("body", GRAPHIC, 1)).alias("graphic"), plain_caption(F.regexp_extract("body", CAPTION, 1)).alias("caption")).where(F.col("body").rlike(GRAPHIC))
    return rows.select("archive", F.row_number().over(Window.partitionBy("archive").orderBy("n", "m")).alias("pos"), "graphic", "caption")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matched(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``wanted`` (archive, pos, graphic) with the ``name`` of the image member (archive, n, name) that is meant, and its
    ``tier``; null where there is none.

    A graphic is a path, perhaps without folder or ending. Tiers: the name as it is (0), then with each ending of IMAGES; last,
    names that begin with it. Within a tier the first member of the archive counts. Both kinds of candidate are joined by equal keys: the base name, or a beginning of a member's
    base name that is as long as some graphic of its archive, so no reference meets all members.
    """
    images = found.where(F.lower("name").rlike(r"\.(" + "|".join(e[1:] for e in IMAGES) + ")$")).select("archive", "n", "name", base_name(F.col("name")).alias("base"))
    asked = wanted.select("archive", "graphic").distinct()
    tries = F.array(F.col("graphic"), *[F.concat("graphic", F.lit(e)) for e in IMAGES])
    exact = asked.select("archive", "graphic", F.posexplode(tries).alias("tier", "path")).withColumn("base", base_name(F.col("path")))
    exact = exact.join(shuffled(images), ["archive", "base"])
    meant = (F.col("name") == F.col("path")) | (F.col("name") == F.concat(F.lit("./"), "path")) | F.endswith(F.col("name"), F.concat(F.lit("/"), F.col("path"))) | (F.col("base") == F.col("path"))
    begun = asked.withColumn("start", base_name(F.col("graphic")))
    lengths = begun.select("archive", F.length("start").alias("k")).distinct()
    beginnings = images.join(shuffled(lengths), "archive").where(F.length("base") >= F.col("k")).select("archive", "n", "name", F.substring("base", F.lit(1), F.col("k")).alias("start"))
    prefix = begun.join(shuffled(beginnings), ["archive", "start"]).withColumn("tier", F.lit(len(IMAGES) + 1))
    every = exact.where(meant).select("archive", "graphic", "tier", "n", "name").unionByName(prefix.select("archive", "graphic", "tier", "n", "name"))
    best = every.groupBy("archive", "graphic").agg(F.min(F.struct("tier", "n", "name")).alias("best")).select("archive", "graphic", "best.tier", "best.name")
    return wanted.join(shuffled(best), ["archive", "graphic"], "left")


def labelled(found: DataFrame) -> DataFrame:
    """Matched figures (archive, pos, caption, name) with label and id: by the number in the caption, else by their place
    among the figures that have an image."""
    kept = found.where(F.col("name").isNotNull() & ~F.lower("name").endswith(".eps"))
    n = F.row_number().over(Window.partitionBy("archive").orderBy("pos")).cast("string")
    word, number = F.regexp_extract("caption", NUMBERED, 1), F.regexp_extract("caption", NUMBERED, 2)
    label = F.when(number != "", F.concat_ws(" ", F.rtrim(word, F.lit(".")), number)).otherwise(F.concat(F.lit("Figure "), n))
    kind = F.when(word.startswith("Tab"), "tbl").otherwise("fig")
    return kept.select("*", label.alias("label"), F.when(number != "", F.concat(kind, F.lower(number))).otherwise(F.concat(F.lit("fig"), n)).alias("id"))
