"""Text functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Patterns and word lists that decide results.
BLOG_AT_INGEST = r"(?i)(^|\.)blog\.|/blog\b|/posts?\b|/engineering\b|/research\b"
BLOG_ON_LIST = r"(?i)(^|\.)blog\.|/blog/|/posts?/|/engineering/|/research/"
ARXIV_LIKE = r"(?i)arxiv\.org|^\d{4}\.\d{4,5}(v\d+)?$|^[a-z\-]+/\d{7}$"
DECORATIVE = r"(?i)logo|icon|avatar|sprite"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
LATEX_RESIDUE = r"\\{1,2}(rowcolors?|cellcolor|columncolor)\s*(\[[^\]]*\])?\s*(\{[^}]*\}|[\d.]+)?\s*|\\{1,2}(hline|toprule|midrule|bottomrule)\b|\\{1,2}cline\s*\{[^}]*\}"


def printed(number: Column, decimals: int) -> Column:
    """A number with so many decimals, rounded by its exact value as C and Python do it, where Java rounds its shortest
    decimal form up: 0.15 is a little less, and gives 0.1. Null for null."""

    @F.arrow_udf("string")
    def run(numbers: pa.Array) -> pa.Array:
        return pa.array([None if n is None else f"{n:.{decimals}f}" for n in numbers.to_pylist()], pa.string())

    return run(number.cast("double"))


def squeezed(text: Column) -> Column:
    """ASCII white space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " "))


def visible_text(html: Column) -> Column:
    """Roughly what a reader sees: no scripts, styles or tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return squeezed(F.regexp_replace(bare, r"<[^>]+>", " "))


def unescaped(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def escaped(text: Column) -> Column:
    """The five characters of HTML as entities."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def slug_ascii(text: Column) -> Column:
    found = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(found == "", "section").otherwise(found)


def slug_hangul(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9가-힣]+", "-"), r"^-+|-+$", "")


def reference_id(text: Column) -> Column:
    """A leading Roman number, or any number before white space, goes; other characters become dashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^[IVX]+\.\s*|\d+(\.\d+)?\s+", ""), r"[^A-Za-z0-9가-힣]+", "-"))


def without_numbering(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^[\d\-.]+", ""), r"^-+|-+$", "")


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def heading_key(text: Column) -> Column:
    return F.lower(squeezed(text))


def unescaped_heading_key(text: Column) -> Column:
    return F.lower(squeezed(F.replace(text, F.lit("\\"), F.lit(""))))


def dashed(text: Column, limit: int) -> Column:
    """Lower-case words joined by dashes, cut to a length."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(words, 1, limit), r"^-+|-+$", "")


def web_slug(url: Column, title: Column) -> Column:
    """Host and title; a last fragment of one or two characters goes, as do dashes at the ends."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)
    main = F.element_at(F.split(F.regexp_replace(F.when(host == "", "web").otherwise(host), r"^www\.", ""), r"\."), 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    words = F.when(title != "", dashed(title, 40)).otherwise(dashed(F.element_at(F.split(path, "/"), -1), 40))
    tail = F.regexp_replace(words, r"^(.+)-[^-]{0,2}$", "$1")
    slug = F.regexp_replace(F.concat(main, F.lit("-"), tail), r"^-+|-+$", "")
    return F.when(slug == "", "web").otherwise(slug)


def arxiv_id(text: Column) -> Column:
    """New-style id in an address or alone; null if there is none."""
    linked = F.regexp_extract(text, r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    alone = F.regexp_extract(F.trim(text), r"^(\d{4}\.\d{4,5})(?:v\d+)?$", 1)
    return F.coalesce(F.nullif(linked, F.lit("")), F.nullif(alone, F.lit("")))


def first_title_line(text: Column) -> Column:
    """The first line of 21 to 199 characters that isn't a stamp."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & (F.length(x) < 200) & ~F.startswith(F.lower(x), F.lit("arxiv")))
    return F.get(lines, F.lit(0))


def first_page_title(text: Column) -> Column:
    """The first non-empty line, after a stamp; a very short one is joined with the next; 300 characters at most."""
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: squeezed(x)), lambda x: x != "")
    at = F.when(F.startswith(F.lower(F.get(lines, F.lit(0))), F.lit("arxiv:")) & (F.size(lines) > 1), F.lit(1)).otherwise(F.lit(0))
    one = F.get(lines, at)
    title = F.when((F.length(one) < 15) & (F.size(lines) > 1), F.concat_ws(" ", one, F.get(lines, F.lit(1)))).otherwise(one)
    title = squeezed(title)
    return F.when(F.length(title) >= 5, F.substring(title, 1, 300))


def looks_like_title(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.length(text).between(5, 300) & ~low.rlike(r"\.(pdf|docx|doc|tex|dvi)$") & ~F.contains(low, F.lit("microsoft word")) & ~F.startswith(low, F.lit("untitled")) & ~text.rlike(r"[\n\r]")


def file_slug(name: Column) -> Column:
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(.)\.[^.]*$", "$1")
    words = F.lower(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""))
    return F.substring(F.when(words == "", "paper").otherwise(words), 1, 48)


def heading_parts(heading: Column) -> Column:
    """Number (Roman or dotted), title and depth (dots of the number) of a heading."""
    pattern = r"^([IVX]+|\d+(?:\.\d+)*)\.?\s+(\S.*)$"
    number = F.regexp_extract(heading, pattern, 1)
    return F.struct(number.alias("number"), F.when(number == "", heading).otherwise(F.regexp_extract(heading, pattern, 2)).alias("title"), F.regexp_count(number, F.lit(r"\.")).alias("depth"))


def illustration_base(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"-\d+$", "")


def initials(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(text, r"[:\-]", " "), r"\s+"), lambda w: w != "")
    letters = F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.when(F.size(words) == 0, "?").otherwise(F.array_join(letters, ""))


def repository(url: Column) -> Column:
    pattern = r"github\.com[/:]([^/]+)/([^/#?]+)"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "").alias("name"))


def version(text: Column) -> Column:
    """Three whole numbers, after an optional v; null for anything else."""
    plain = F.regexp_extract(F.trim(text), r"^v?(\d+\.\d+\.\d+)$", 1)
    return F.when(plain != "", F.transform(F.split(plain, r"\."), lambda p: p.cast("int")))


def tidy_blank_lines(text: Column) -> Column:
    """No white space at line ends, and no more than one blank line in a row."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t\r\x0B\f]+$", ""), r"\n{3,}", "\n\n")


def numbered_items(text: Column) -> Column:
    """Texts of numbered and bulleted lines, without blanks and placeholders in italics."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:\d+\.|[-*])[ \t]+(\S.*)$"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("_")))


def latex_residue_removed(text: Column) -> Column:
    return F.regexp_replace(text, LATEX_RESIDUE, "")


def deemphasized(text: Column) -> Column:
    """Each line without one run of asterisks or underscores at either end."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[*_]+|[*_]+$", "")), "\n")


def pdf_upload(name: Column, content: Column) -> Column:
    """Whether a file's name and its first bytes say PDF."""
    return F.endswith(F.lower(name), F.lit(".pdf")) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))
