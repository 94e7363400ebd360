"""Figures: joins with sections, mentions and bodies; all equi-joins on normalised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import without_numbering

IMAGE_REFERENCE = r"!\[[^\]]*\]\((?:/paper/[^/)]+)?/fig/([^)\s]+)\)"


def of_sections(sections: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures with bytes that refer to a section, in file order. Keys: section ids without their numbers."""
    left = sections.select("slug", "section_id", without_numbering(F.col("section_id")).alias("key")).where("key <> ''")
    right = figures.where("data_uri <> ''").select("slug", "id", "label", "pos", without_numbering(F.coalesce("ref_in_section", F.lit(""))).alias("key"))
    return left.join(right, ["slug", "key"]).select("slug", "section_id", "id", "label", "pos")


def mention_pattern(label: Column) -> Column:
    """How prose names a label; tables and figures of one number differ. Null without a number."""
    number = F.regexp_extract(label, r"(\d+)", 1)
    words = F.when(label.rlike(r"(?i)^\s*(table|표)"), r"Table|표").otherwise(r"Figure|Fig\.?|그림")
    return F.when(number != "", F.concat(F.lit("(?i)(?:"), words, F.lit(r")\s*"), number, F.lit(r"(?!\d)")))


def placements(bodies: DataFrame, figures: DataFrame) -> DataFrame:
    """slug, section_id, id, paragraph: the first paragraph that names a figure; null where none does. Figures that the
    document shows already are left out, so a second run changes nothing."""
    paragraphs = bodies.select("slug", "section_id", F.posexplode(F.split("body", "\n\n")).alias("paragraph", "text"))
    wanted = figures.join(bodies.select("slug", "section_id", F.col("text").alias("_whole")), ["slug", "section_id"]).where(~F.contains("_whole", F.concat(F.lit("/fig/"), "id", F.lit(")")))).drop("_whole")
    found = wanted.withColumn("_pattern", mention_pattern(F.col("label"))).join(paragraphs, ["slug", "section_id"])
    named = found.where(F.expr("regexp_like(text, _pattern)")).groupBy("slug", "section_id", "id").agg(F.min("paragraph").alias("paragraph"))
    return wanted.select("slug", "section_id", "id", "label", "pos").join(named, ["slug", "section_id", "id"], "left")


def placed(bodies: DataFrame, figures: DataFrame) -> DataFrame:
    """slug, section_id, body with its figures: each behind the paragraph that names it (of several, the last in file
    order comes first, as each is put right behind the paragraph), others at the end."""
    spots = placements(bodies, figures)
    mark = F.concat(F.lit("!["), F.regexp_replace("label", r"[\[\]]", ""), F.lit("](/paper/"), "slug", F.lit("/fig/"), "id", F.lit(")"))
    marks = spots.groupBy("slug", "section_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("paragraph", F.lit(1 << 30)).alias("at"), F.when(F.col("paragraph").isNull(), F.col("pos")).otherwise(-F.col("pos")).alias("order"), mark.alias("mark")))).alias("marks"))
    rows = bodies.join(marks, ["slug", "section_id"], "left")
    behind = F.transform(F.split("body", "\n\n"), lambda p, i: F.concat(F.array(p), F.transform(F.filter(F.coalesce("marks", F.array()), lambda m: m["at"] == i), lambda m: m["mark"])))
    last = F.transform(F.filter("marks", lambda m: m["at"] == 1 << 30), lambda m: m["mark"])
    whole = F.array_join(F.concat(F.flatten(behind), F.coalesce(last, F.array().cast("array<string>"))), "\n\n")
    return rows.select("slug", "section_id", F.when(F.col("marks").isNull(), F.col("body")).otherwise(whole).alias("body"))


def union_by_id(first: DataFrame, second: DataFrame) -> DataFrame:
    """Figures of the first source, and those of the second one whose id it lacks; figures before tables, then numbers."""
    more = second.join(first.select("slug", "id"), ["slug", "id"], "left_anti")
    number = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"), F.lit(1 << 30))
    order = Window.partitionBy("slug").orderBy(F.col("kind") == "table", number, "id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order))


def by_heading(figures: DataFrame, headings: DataFrame) -> DataFrame:
    """Each figure with the first line of the heading that it stood under; null for none: these go to a gallery."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    first = headings.groupBy("slug", key(F.col("heading")).alias("key")).agg(F.min("line_no").alias("line_no"))
    return figures.withColumn("key", key(F.col("section_heading"))).join(first, ["slug", "key"], "left").select("slug", "id", "line_no")


def references(documents: DataFrame) -> DataFrame:
    """slug, pos, id of figures that a text shows, each once."""
    return documents.select("slug", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(IMAGE_REFERENCE), F.lit(1)))).alias("pos", "id"))


def orphans(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures that their document doesn't show."""
    return figures.join(references(documents), ["slug", "id"], "left_anti")


def label_and_id(caption: Column, kind: Column) -> Column:
    """Label and id by the number in a caption, Arabic or Roman; null for captions without one."""
    pattern = r"(?i)^\s*(fig(?:ure)?\.?|table)\s+([0-9]+|[IVX]+)\b"
    number = F.regexp_extract(caption, pattern, 2)
    word = F.when(F.lower(F.regexp_extract(caption, pattern, 1)).startswith("t"), "Table").when(number != "", "Figure").otherwise(F.initcap(kind))
    return F.when(number != "", F.struct(F.concat_ws(" ", word, number).alias("label"), F.concat(F.when(word == "Table", "tbl").otherwise("fig"), F.lower(number)).alias("id")))


def auto_labelled(figures: DataFrame) -> DataFrame:
    """Unlabelled figures and tables numbered apart, in order."""
    found = figures.withColumn("found", label_and_id(F.col("caption"), F.col("kind")))
    order = Window.partitionBy("slug", "kind", F.col("found").isNull()).orderBy("pos")
    n = F.row_number().over(order).cast("string")
    return found.select("slug", "pos", "kind", F.coalesce("found.label", F.concat(F.initcap("kind"), F.lit(" (auto "), n, F.lit(")"))).alias("label"), F.coalesce("found.id", F.concat(F.when(F.col("kind") == "table", "tblauto").otherwise("figauto"), n)).alias("id"))


def bytes_of(data_uri: Column) -> Column:
    """The bytes of a data address; null for others."""
    return F.when(data_uri.rlike(r"^data:[^;,]+;base64,"), F.try_to_binary(F.regexp_extract(data_uri, r"^data:[^;,]+;base64,(.*)$", 1), F.lit("base64")))


def lifted_images(documents: DataFrame, known: DataFrame) -> DataFrame:
    """slug, id, data_uri of images inside texts: one per content, numbered on from those that ``known`` has."""
    found = documents.select("slug", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\((data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+)\)"), F.lit(1)))).alias("pos", "data_uri"))
    new = found.join(known.select("slug", "data_uri"), ["slug", "data_uri"], "left_anti")
    taken = known.groupBy("slug").agg(F.max(F.coalesce(F.regexp_extract("id", r"^paste(\d+)$", 1).try_cast("int"), F.lit(0))).alias("taken"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("pos")) + F.coalesce("taken", F.lit(0))
    return new.join(taken, "slug", "left").select("slug", F.concat(F.lit("paste"), n.cast("string")).alias("id"), "data_uri")
