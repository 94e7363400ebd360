"""From review documents to drafts and exports, and rewrites of markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workbench import blocks, stripped, unescaped_markdown

# What the format marks, and limits of displays.
RETIRED = ("다음에 볼 것", "메모")
TREE_DEPTH, TREE_ITEMS, CAPTION_CHARS = 3, 300, 110


def resolved(texts: DataFrame, figures: DataFrame, key: str = "html", reference: str = r'src="/fig/([^"]+)"') -> DataFrame:
    """slug and text with each figure address replaced by the figure's bytes; unknown ones get a placeholder.

    A text is cut at its addresses; pieces are joined with ``figures`` (slug, id, data_uri) and put together in order.
    """
    around = F.split(key, reference, -1)
    ids = F.regexp_extract_all(key, F.lit(reference), F.lit(1))
    pieces = F.transform(around, lambda t, i: F.struct(t.alias("text"), F.get(ids, i).alias("id")))
    rows = texts.select("slug", F.posexplode(pieces).alias("pos", "p")).select("slug", "pos", "p.text", "p.id")
    known = figures.select("slug", "id", "data_uri")
    rows = rows.join(known, ["slug", "id"], "left")
    shown = F.when(F.col("id").isNull(), "").when(F.coalesce(F.col("data_uri"), F.lit("")) != "", F.concat(F.lit('src="'), "data_uri", F.lit('"'))).otherwise(F.lit('src="" data-missing="1"'))
    whole = rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("text", shown).alias("t")))).alias("all"))
    return whole.select("slug", F.array_join(F.transform("all", lambda x: x["t"]), "").alias(key))


def inlined_tables(texts: DataFrame, figures: DataFrame) -> DataFrame:
    """As ``resolved``, for images of tables: the table's own markup takes the image's place."""
    tables = figures.where("html <> ''").select("slug", "id", "html")
    image = r'<img[^>]*src="/fig/(tbl[^"]+)"[^>]*>'
    ids = F.regexp_extract_all("html", F.lit(image), F.lit(1))
    whole = F.regexp_extract_all("html", F.lit(image), F.lit(0))
    pieces = F.transform(F.split("html", image, -1), lambda t, i: F.struct(t.alias("text"), F.get(ids, i).alias("id"), F.get(whole, i).alias("tag")))
    rows = texts.select("slug", F.posexplode(pieces).alias("pos", "p")).select("slug", "pos", "p.text", "p.id", "p.tag")
    rows = rows.join(tables, ["slug", "id"], "left")
    put = rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("text", F.coalesce("html", "tag", F.lit(""))).alias("t")))).alias("all"))
    return put.select("slug", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("html"))


def _before(text: Column, part: Column) -> Column:
    """What stands before the first occurrence of a part."""
    return F.call_function("substring_index", text, part, F.lit(1))


def tidied(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents without the blocks of a tidy plan (slug, heading), and with no more than two blank lines in a row."""
    doomed = plan.groupBy("slug").agg(F.collect_set("heading").alias("_doomed"))
    rows = documents.join(doomed, "slug", "left").withColumn("_blocks", blocks(F.col("text")))
    gone = F.filter("_blocks", lambda b: F.array_contains("_doomed", stripped(F.regexp_extract(b, r"\A### ([^\n]*)", 1))))
    without = F.aggregate(gone, F.col("text"), lambda t, b: F.concat(_before(t, b), F.substring(t, F.length(_before(t, b)) + F.length(b) + 1, F.length(t))))
    text = F.when(F.size(gone) > 0, F.regexp_replace(without, r"\n{4,}", "\n\n\n")).otherwise(F.col("text"))
    return rows.withColumn("text", F.when(F.col("_doomed").isNull(), F.col("text")).otherwise(text)).drop("_doomed", "_blocks")


def without_retired_fields(text: Column) -> Column:
    """Retired wrap-up items go when they are empty, never when they hold text. A second pass changes nothing."""
    for label in RETIRED:
        text = F.regexp_replace(text, rf"(?m)^[-*+][ \t]+\*\*{label}\*\*:?[ \t]*\n(?!\s*[^\s\-*+#])", "")
    return text


def drafts(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """slug, draft: title, introduction and the sections' explanations (else summaries) in order, without escapes.

    ``documents``: slug, title, tldr. ``sections``: slug, ordinal, heading, explanation, summary. Parts of one document
    meet in one row, as its draft does anyway.
    """
    body = F.coalesce(F.nullif("explanation", F.lit("")), F.nullif("summary", F.lit("")))
    part = F.concat(F.lit("## "), unescaped_markdown(F.col("heading")), F.lit("\n\n"), unescaped_markdown(body))
    parts = sections.where(body.isNotNull()).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("part")))).alias("parts"))
    rows = documents.join(parts, "slug", "left")
    head = F.concat(F.lit("# "), "title")
    intro = F.when(F.coalesce(F.col("tldr"), F.lit("")) != "", F.concat(F.lit("> "), "tldr"))
    return rows.select("slug", F.concat_ws("\n\n", head, intro, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")).alias("draft"))


def skeleton(records: DataFrame) -> DataFrame:
    """slug, text: a new document for each record (slug, title, category, tags, sections array of (heading, id, lines))."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title_en: "), quote("title")), F.concat(F.lit("category: "), "category"), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), F.lit("status: to_read"), F.lit("---"))
    review = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("### "), s["heading"], F.lit("\n<!-- section_id: "), s["id"], F.lit(" | lines: "), s["lines"], F.lit(" -->\n_(미진행)_\n"))), "\n")
    return records.select("slug", F.concat(front, F.lit("\n# "), "title", F.lit("\n\n## 섹션별 리뷰\n"), review, F.lit("\n## Q&A\n\n## Wrap-up\n")).alias("text"))


def markdown_tables(tables: DataFrame) -> DataFrame:
    """key, markdown of HTML tables: cells without markup and line ends, rows filled to the widest one."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), cell))
    found = tables.select("key", cells.alias("rows")).withColumn("width", F.array_max(F.transform("rows", lambda r: F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    lines = F.transform("rows", line)
    return found.where("width > 0").select("key", F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n").alias("markdown"))


def plain_tables(html: Column) -> Column:
    """Table markup without attributes but spans."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<(table|thead|tbody|tr|th|td)((?:\s+(?:col|row)span=\"\d+\")*)[^>]*>", "<$1$2>"), r"\s+>", ">")


def tree(paths: DataFrame) -> DataFrame:
    """rank, path, depth of files and all their folders down to a depth, sorted, as many as a display takes."""
    parts = F.split("path", "/")
    every = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(TREE_DEPTH))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    top = every.orderBy("path").limit(TREE_ITEMS)
    return top.select(F.row_number().over(Window.orderBy("path")).alias("rank"), "path", (F.size(F.split("path", "/")) - 1).alias("depth"))


def figure_hint(figures: DataFrame) -> DataFrame:
    """slug, hint: figures and tables of a document in order, with captions cut; bytes aren't read."""
    line = F.concat(F.lit("- "), "label", F.lit(": "), F.substring(F.coalesce(F.nullif("caption_ko", F.lit("")), "caption_en", F.lit("")), 1, CAPTION_CHARS))
    rows = figures.groupBy("slug", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    text = F.concat_ws("\n", F.concat(F.initcap("kind"), F.lit("s:")), F.transform("lines", lambda x: x["line"]))
    return rows.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("hint"))


def image_width(text: Column, width: int | None) -> Column:
    """The width of an image's alternative text set, or removed for none."""
    bare = F.regexp_replace(text, r"!\[([^\]|]*)\|\d+\]\(", "![$1](")
    return bare if width is None else F.regexp_replace(bare, r"!\[([^\]|]*)\]\(", f"![$1|{width}](")


def image_kind(address: Column) -> Column:
    """Remote images and attachments stay as they are; others are copied, unless their path leaves the folder."""
    return F.when(address.rlike(r"^(https?:|data:)"), "remote").when(F.startswith(address, F.lit("attachments/")), "attachment").when(address.rlike(r"(^/|(^|/)\.\.(/|$))"), "refused").otherwise("local")


def page_figures(pages: DataFrame) -> DataFrame:
    """key, pos, kind, caption, src, heading of figures and single tables in pages, with the nearest heading above.

    Decorative images and data addresses are left out; a figure without an image counts if it has a drawing and a caption.
    """
    element = r"(?is)<h[1-4]\b[^>]*>.*?</h[1-4]>|<figure\b[^>]*>.*?</figure>|<table\b[^>]*>.*?</table>"
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    rows = pages.select("key", F.posexplode(F.regexp_extract_all("html", F.lit(element), F.lit(0))).alias("pos", "e"))
    rows = rows.withColumns({"tag": F.lower(F.regexp_extract("e", r"(?i)^<(\w+)", 1)), "src": F.regexp_extract("e", r'(?is)<img\b[^>]*\bsrc="([^"]*)"', 1), "caption": clean(F.regexp_extract("e", r"(?is)<(?:figcaption|caption)\b[^>]*>(.*?)</(?:figcaption|caption)>", 1))})
    above = F.last(F.when(F.col("tag").rlike("^h[1-4]$"), clean(F.col("e"))), ignorenulls=True).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("heading", above).where("tag IN ('figure', 'table')")
    image = (F.col("src") != "") & ~F.col("src").rlike("(?i)^data:|logo|icon|avatar|sprite")
    drawn = (F.col("src") == "") & F.col("e").rlike(r"(?i)<(svg|canvas)\b") & (F.col("caption") != "") & ~F.col("e").rlike(r"(?i)<(pre|blockquote)\b")
    kind = F.when((F.col("tag") == "table") | F.col("e").rlike(r"(?i)<table\b"), "table").when(image, "image").when(drawn, "drawing")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("key", F.row_number().over(Window.partitionBy("key").orderBy("pos")).alias("n"), "kind", "caption", "src", "heading")
