"""The section index on small texts that each show one rule."""

from __future__ import annotations

from marginalia.operators import sections

PROSE = "This sentence stands for a paragraph of a paper and is long enough to count as the body of a section here."


def index(spark, text: str) -> list[str]:
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return [r.heading for r in sections.section_index(lines).orderBy("start").collect()]


def test_a_chapter_without_body_goes(spark):
    assert index(spark, "\n".join(["1 Introduction", PROSE, "2 Model Architecture", "2.1 Overview", PROSE])) == ["1 Introduction", "2.1 Overview"]


def test_table_rows_are_no_headings(spark):
    assert index(spark, "\n".join(["1 Results", PROSE, "40.6 AP on the set", "2 Dense overlap 74.57", "50 APval", PROSE])) == ["1 Results"]


def test_templates_and_sentences_are_no_headings(spark):
    assert index(spark, "\n".join(["3 Method", PROSE, "1. Question: {question}", PROSE, "4. Read the text and answer.", PROSE])) == ["3 Method"]


def test_repeats_and_references_go(spark):
    text = ["1 Start", PROSE, PROSE, "ABILITIES", PROSE, "ABILITIES", PROSE, "2 End", PROSE, "References", "I. Name, J. Other: a title of some length that goes on and on and on.", PROSE]
    assert index(spark, "\n".join(text)) == ["1 Start", "2 End"]


def test_numbers_that_restart_go(spark):
    text = ["1 First", PROSE, "4.3.4 STAL", PROSE, "DECODED REASONING", PROSE, "6 Conclusion", PROSE, "2 Cross", PROSE, "6 Again", PROSE]
    assert index(spark, "\n".join(text)) == ["1 First", "4.3.4 STAL", "6 Conclusion"]


def test_contents_lines_go(spark):
    """The line of the contents that equals its heading makes both a repeat."""
    text = ["1 Introduction 3", "2 Level 2", "3 Method . . . . 9", "1 Introduction", PROSE, "2 Level 2", PROSE, "3 Method", PROSE]
    assert index(spark, "\n".join(text)) == ["1 Introduction", "3 Method"]


def test_an_empty_text_has_no_sections(spark):
    assert index(spark, "") == []


def test_backwards_filter_equals_a_fold(spark):
    """The window form against a plain loop over random numbers."""
    import random

    rnd = random.Random(5)
    docs = {d: [rnd.choice([f"{rnd.randint(1, 6)} Title {i}", f"{rnd.randint(1, 6)}.{rnd.randint(1, 3)} Part {i}", f"PLAIN {i}"]) for i in range(12)] for d in range(60)}
    rows = spark.createDataFrame([(d, i, x) for d, labels in docs.items() for i, x in enumerate(labels)], "doc_id long, line_no int, label string")
    got = {(r.doc_id, r.line_no) for r in sections.drop_backwards(rows).collect()}
    want = set()
    for d, labels in docs.items():
        high, plain = 0, set()
        for i, label in enumerate(labels):
            number = label.split(" ")[0]
            if number[0].isdigit():
                top, bare = int(number.split(".")[0]), "." not in number
                if top < high or (bare and top in plain):
                    continue
                high = top
                plain |= {top} if bare else set()
            want.add((d, i))
    assert got == want
