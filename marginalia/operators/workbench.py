"""Review documents: frontmatter and marked-up blocks as columns, and edits of them.

Java's look-ahead splits a text into its blocks, so all parsing stays in generated code; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Headings and labels of the document format.
REVIEW = "섹션별 리뷰"
OPEN_MARK = "(미진행"
NEXT_SECTION = r"(?:\*\*[^\n*]+\*\*\s*)?<!--\s*section_id:"
NOTES = r"\*\*(?:Claude )?Reader's Notes\*\*"
LABELS = {
    "raw_excerpt": (r"\*\*원문 발췌\*\*[^\n]*\n", rf"\*\*핵심 해설\*\*|\*\*요약\*\*|\*\*Claude 1차 번역\*\*|{NOTES}|{NEXT_SECTION}|\z"),
    "explanation": (r"\*\*핵심 해설\*\*\s*\n", rf"{NOTES}|{NEXT_SECTION}|\z"),
    "summary": (r"\*\*요약\*\*\s*\n", rf"\*\*Claude 1차 번역\*\*|{NOTES}|{NEXT_SECTION}|\z"),
    "notes": (rf"{NOTES}\s*\n", rf"{NEXT_SECTION}|\z"),
}
BODY_BOUND = r"\n##\s+(?:Q ?& ?A|Wrap-up|메타|정리)\b"
PARSER_BOUND = r"(?m)^##\s+(?:Q&A|Wrap-up|메타|그림)\s*$"
#: A tidy plan names blocks that hold more written characters.
LONG_NOTE = 200
UNREAL_ANSWERS = ("미진행", "여기에 본인 답변", "답변하면")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def frontmatter_block(text: Column) -> Column:
    """What stands between a first line of dashes and the next one; else nothing."""
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)


def frontmatter(text: Column) -> Column:
    """A map of the block's keys; values lose white space and quotes around them; of equal keys the last one counts."""
    lines = F.filter(F.split(frontmatter_block(text), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))), r'^"+|"+$', "").alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def tag_values(value: Column) -> Column:
    """Tags of a list, in brackets or not, without quotes and empty ones."""
    inner = F.regexp_replace(F.trim(value), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", "")), lambda x: x != "")


def with_key(text: Column, key: str, value: Column | None) -> Column:
    """The first line of a key replaced, or removed for no value; a missing key is added as the block's last line.

    As in the format's own tools the first matching line counts, wherever it stands.
    """
    pattern = rf"(?m)^{key}:.*$"
    if value is None:
        return F.regexp_replace(text, rf"(?s)\A(.*?)(?<=\n){key}:[^\n]*\n", "$1")
    line = F.concat(F.lit(f"{key}: "), value)
    head = F.element_at(F.split(text, pattern, 2), 1)
    tail = F.substring(text, F.length(head) + F.length(F.regexp_substr(text, F.lit(pattern))) + 1, F.length(text))
    return F.when(text.rlike(pattern), F.concat(head, line, tail)).otherwise(F.regexp_replace(text, r"(?s)\A---\n(.*?)\n---\n", F.concat(F.lit("---\n$1\n"), line, F.lit("\n---\n"))))


def review_body(text: Column, bound: str = BODY_BOUND) -> Column:
    """What stands under the review heading, up to the next known heading."""
    rest = F.get(F.split(text, rf"##\s+{REVIEW}\s*\n", 2), F.lit(1))
    return F.element_at(F.split(rest, bound, 2), 1)


def blocks(text: Column) -> Column:
    """The review's blocks, each from its heading on."""
    return F.filter(F.split(review_body(text), r"(?m)(?=^### )"), lambda b: F.startswith(b, F.lit("### ")))


def progress(text: Column) -> Column:
    """Blocks, and those that aren't marked as open."""
    every = F.coalesce(blocks(text), F.array().cast("array<string>"))
    return F.struct(F.size(every).alias("total"), F.size(F.filter(every, lambda b: ~F.contains(b, F.lit(OPEN_MARK)))).alias("done"))


def unfinished(documents: DataFrame) -> DataFrame:
    """slug, pos, heading, lines of blocks that are marked as open."""
    rows = documents.select("slug", F.posexplode(blocks(F.col("text"))).alias("pos", "block")).where(F.contains("block", F.lit(OPEN_MARK)))
    return rows.select("slug", "pos", F.regexp_extract("block", r"^###\s+(.+?)\s*\n", 1).alias("heading"), F.regexp_extract("block", r"<!--\s*section_id:[^|]*\|\s*lines:\s*(\S+)\s*-->", 1).alias("lines"))


def labelled(block: Column, label: str) -> Column:
    """What follows a label, up to the next known one or the next section's marker."""
    begin, end = LABELS[label]
    return stripped(F.regexp_extract(block, rf"(?s){begin}(.+?)(?={end})", 1))


def sections(documents: DataFrame) -> DataFrame:
    """One row per review section with its fields. A second marker in a block begins a section of its own, whose title is
    the bold or heading line right above it, or else its id."""
    body = review_body(F.col("text"), PARSER_BOUND)
    chunks = F.filter(F.split(body, r"(?m)(?=^###\s|^##\s+\d)"), lambda c: stripped(c).rlike(r"^#{2,3}\s+\S"))
    rows = documents.select("slug", F.posexplode(chunks).alias("chunk_no", "chunk"))
    marker = r"(?=\*\*[^*\n]+\*\*\s*\n\s*<!--\s*section_id:)|(?<!\*\*\n)(?=<!--\s*section_id:)"
    pieces = F.split("chunk", marker)
    # the first piece is the heading; it belongs to the first marker's piece
    joined = F.when(F.size(pieces) <= 2, F.array("chunk")).otherwise(F.concat(F.array(F.concat(F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1)))), F.slice(pieces, 3, F.size(pieces))))
    rows = rows.select("slug", "chunk_no", F.posexplode(F.when(F.col("chunk").rlike(r"<!--\s*section_id:"), joined).otherwise(F.array("chunk"))).alias("part", "segment"))
    own = F.regexp_extract("segment", r"\A\s*#{2,3}\s+(.+?)\s*(?:\n|\z)", 1)
    bold = F.regexp_extract("segment", r"\A\s*\*\*([^*\n]+?)\*\*", 1)
    sid = F.regexp_extract("segment", r"<!--\s*section_id:\s*(\S+)", 1)
    fallback = F.initcap(F.replace(F.regexp_replace(sid, r"^[\d\-.]+", ""), F.lit("-"), F.lit(" ")))
    heading = F.coalesce(F.nullif(own, F.lit("")), F.nullif(bold, F.lit("")), fallback)
    return rows.select("slug", "chunk_no", "part", heading.alias("heading"), sid.alias("section_id"), F.regexp_extract("segment", r"lines:\s*(\S+)\s*-->", 1).alias("lines"), *[labelled(F.col("segment"), x).alias(x) for x in LABELS], (~F.contains("segment", F.lit(OPEN_MARK))).alias("done"))


def needs_introduction(text: Column) -> Column:
    """Whether any of three placeholders of the introduction is left."""
    return F.contains(text, F.lit("아직 비어있음")) | text.rlike(r"## 핵심 contribution[\s\S]*?\n1\. \n2\. \n3\. ") | F.contains(text, F.lit("ingest는 사전지식 카드를 미리 만들지 않음"))


def heading_body(text: Column, title: str) -> Column:
    return stripped(F.regexp_extract(text, rf"(?ms)^##\s+{title}\s*\n(.+?)(?=^##\s|\z)", 1))


def real_answer(answer: Column) -> Column:
    text = stripped(answer)
    good = (text != "") & (text != "<empty>") & ~F.startswith(text, F.lit("("))
    for mark in UNREAL_ANSWERS:
        good = good & ~F.contains(text, F.lit(mark))
    return good


def questions(documents: DataFrame) -> DataFrame:
    """slug, pos, kind, title, answer. Generated questions stay without an answer; written ones only with a real one."""
    chunks = F.filter(F.split(heading_body(F.col("text"), "Q&A"), r"(?m)(?=^###\s+Q)"), lambda c: F.startswith(c, F.lit("### Q")))
    rows = documents.select("slug", F.posexplode(chunks).alias("pos", "chunk"))
    source = F.regexp_extract("chunk", r"\A###\s+Q\s+from\s+§(.+?)\s*(?:\n|\z)", 1)
    given = stripped(F.regexp_replace(F.regexp_extract("chunk", r"(?ms)^[ \t>]*[*_]{0,2}\s*답변\s*[*_]{0,2}\s*:?\s*[*_]{0,2}(.*?)(?=^[ \t]*###\s|\z)", 1), r"(?m)^[*_]+|[*_]+$", ""))
    written = stripped(F.regexp_extract("chunk", r"(?s)\A[^\n]*\n(.*)\z", 1))
    kind = F.when(source != "", "generated").otherwise("written")
    rows = rows.select("slug", "pos", kind.alias("kind"), F.when(source != "", source).otherwise(F.regexp_extract("chunk", r"\A###\s+(Q[0-9]*[.)]?\s*\S.*?)\s*(?:\n|\z)", 1)).alias("title"), F.when(source != "", given).otherwise(written).alias("answer"))
    rows = rows.withColumn("answer", F.when(real_answer(F.col("answer")), F.col("answer")).otherwise(""))
    return rows.where("kind = 'generated' OR answer <> ''")


def dash_field(body: Column, label: str) -> Column:
    """The value of a bold-labelled list item; it may go on over lines, and its colon is optional."""
    value = stripped(F.regexp_extract(body, rf"(?s)[-*+][ \t]+\*\*{label}\*\*:?[ \t]*(.*?)(?=\n[-*+][ \t]+\*\*|\z)", 1))
    return F.when(F.startswith(value, F.lit(":")), stripped(F.substring(value, 2, F.length(value)))).otherwise(value)


def follow_ups(body: Column) -> Column:
    part = F.regexp_extract(body, r"(?s)[-*+][ \t]+\*\*후속으로 읽을 논문\*\*:[ \t]*\n(.*?)(?=\n[-*+][ \t]+\*\*|\z)", 1)
    return F.regexp_extract_all(part, F.lit(r"(?m)^\s*\d+\.[ \t]+(.+?)[ \t]*$"), F.lit(1))


def pipelines(text: Column) -> Column:
    """Fenced pipeline blocks that are valid JSON."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```pipeline\s*\n(.*?)\n```"), F.lit(1))
    parsed = F.transform(found, lambda j: F.from_json(j, "title string, stages array<struct<label: string, icon: string, caption: string>>"))
    return F.filter(parsed, lambda p: p["stages"].isNotNull())


def tidy_plan(documents: DataFrame, live: DataFrame) -> DataFrame:
    """slug, heading, reason, written: blocks without a body, and blocks whose heading isn't in ``live`` (slug, key).

    ``written`` is the length of their text without comments. Documents that ``live`` lacks lose only empty blocks.
    """
    rows = documents.select("slug", F.posexplode(blocks(F.col("text"))).alias("pos", "block"))
    heading = stripped(F.regexp_extract("block", r"\A### ([^\n]*)", 1))
    body = stripped(F.regexp_extract("block", r"(?s)\A[^\n]*\n?(.*)\z", 1))
    rows = rows.select("slug", "pos", heading.alias("heading"), body.alias("body"))
    rows = rows.withColumns({"key": F.lower(F.trim(F.regexp_replace(F.replace("heading", F.lit("\\"), F.lit("")), r"\s+", " "))), "written": F.length(stripped(F.regexp_replace("body", r"(?s)<!--.*?-->", "")))})
    known = live.select("slug", "key", F.lit(True).alias("_live")).distinct()
    sourced = live.select("slug", F.lit(True).alias("_sourced")).distinct()
    rows = rows.join(known, ["slug", "key"], "left").join(sourced, "slug", "left")
    reason = F.when(F.col("body") == "", "빈 제목").when(F.col("_sourced") & F.col("_live").isNull(), "섹션 아님")
    return rows.select("slug", "pos", "heading", reason.alias("reason"), F.when(F.col("body") == "", 0).otherwise(F.col("written")).alias("written")).where("reason IS NOT NULL")


def tidy_totals(plan: DataFrame, long: int = LONG_NOTE) -> DataFrame:
    """blocks, written: how many blocks a plan removes, and how many of these hold more than ``long`` written characters."""
    return plan.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("written") > long).alias("written"))


def unescaped_markdown(text: Column) -> Column:
    """Escapes go: before any punctuation inside dollars, before inactive punctuation elsewhere."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\$\$.*?\$\$|\$[^$\n]*?\$|(?:(?!\$\$.*?\$\$|\$[^$\n]*?\$).)+"), F.lit(0))
    math = lambda p: F.regexp_replace(p, r"\\([!-/:-@\[-`{-~])", "$1")
    prose = lambda p: F.regexp_replace(p, r"""\\([.,:;!?()<>=/"'-])""", "$1")
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("$")) & F.endswith(p, F.lit("$")) & (F.length(p) > 1), math(p)).otherwise(prose(p))), "")
