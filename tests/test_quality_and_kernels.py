"""Quality gates, fuzzy sections, edit marks and colours."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.functions import kernels
from marginalia.operators import quality, records


def test_marks():
    assert kernels.marked("one two three", "one 2 three") == 'one <mark class="wb-edit">2 </mark>three'
    assert kernels.marked("a", "a b c\nd") == 'a <mark class="wb-edit">b c</mark>\n<mark class="wb-edit">d</mark>'
    assert kernels.marked(r"done\.", "done.") == "done."
    assert kernels.marked("a b", 'a <span style="x"> b') == 'a <span style="x"> b'


def test_unchanged_words_are_a_longest_subsequence():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        longest = max((bin(s).count("1") for s in range(1 << len(b)) if _within([x for k, x in enumerate(b) if s >> k & 1], a)), default=0)
        flags = kernels.unchanged(a, b)
        assert sum(flags) == longest and _within([x for x, f in zip(b, flags) if f], a)


def test_long_texts_are_compared_in_linear_memory(monkeypatch):
    import random

    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 3000)}" for _ in range(20_000)]
    other = [w if rnd.random() > 0.02 else "new" for w in words]
    flags = kernels.unchanged(words, other)
    assert sum(flags) >= sum(a == b for a, b in zip(words, other))
    assert _within([x for x, f in zip(other, flags) if f], words)
    monkeypatch.setattr(kernels, "CELLS", 100)  # cut at words that both have once
    own = [f"u{i}" if i % 50 == 0 else w for i, w in enumerate(words)]
    changed = ["new" if i % 7 == 3 else w for i, w in enumerate(own)]
    flags = kernels.unchanged(own, changed)
    assert sum(flags) >= 0.99 * sum(w != "new" for w in changed) and _within([x for x, f in zip(changed, flags) if f], own)


def test_marks_equal_a_word_by_word_walk():
    """Random texts against a plain statement of the rule: each word on its own, blanks between marked words inside."""
    import random
    import re

    rnd = random.Random(3)
    for _ in range(300):
        old, new = ("".join(rnd.choice(["a", "b ", "c", " ", "\n", "<", "!", "d "]) for _ in range(rnd.randint(0, 25))) for _ in range(2))
        got = kernels.marked(old, new, "{", "}")
        assert re.sub("[{}]", "", got) == new
        for inside in re.findall(r"\{(.*?)\}", got, re.S):
            assert inside and not inside[0].isspace() and "\n" not in inside and not set(inside) & set("<>")
            assert all(any(map(str.isalnum, w)) for w in inside.split())
        assert not re.search(r"\}[ ]*\{", got)


def _within(part: list, whole: list) -> bool:
    rest = iter(whole)
    return all(x in rest for x in part)


def test_columns(spark):
    red = '<span style="color: red">{}</span>'
    rows = [("k", "one two", "one 2", red.format("a") + " " + red.format("b") + red.format("c")), ("l", None, "new", "plain")]
    frame = spark.createDataFrame(rows, "k string, old string, new string, html string")
    got = {r.k: r for r in frame.select("k", kernels.edit_marks(F.col("old"), F.col("new")).alias("m"), kernels.merged_color_runs(F.col("html")).alias("h")).collect()}
    assert got["k"].m == 'one <mark class="wb-edit">2</mark>' and got["l"].m == "new"
    assert got["k"].h == red.format("a bc") and got["l"].h == "plain"
    ratio = spark.range(1).select(kernels.contrast(F.lit("#000000"), F.lit("#ffffff")).alias("a"), kernels.contrast(F.lit("#777777"), F.lit("#ffffff")).alias("b")).first()
    assert ratio.a == pytest.approx(21) and ratio.b == pytest.approx(4.478, abs=1e-3)


def record(**changes):
    base = {
        "slug": "p", "metadata": {"title": "T", "title_ko": "티", "authors": ["A"], "venue": "V", "year": 2024, "category": "llm", "url": "u", "github_url": "", "abstract_en": "a", "abstract_ko": "b"},
        "sections": [{"id": f"s{i}", "title_en": "x", "summary_ko": "요약", "paragraphs": [{"en": "e", "ko": "k"}], "readers_notes_md": "n" * 90} for i in range(3)],
        "prerequisites": ["p"], "key_terms": ["t"], "github": None, "ambiguities": [], "code_clarifications": [], "figures": [], "detected_sections": 3,
    }
    return base | changes


def test_gate(spark):
    section = lambda i, **c: record()["sections"][0] | {"id": f"s{i}"} | c
    cases = {
        "clean": (record(), set()),
        "no title": (record(metadata=record()["metadata"] | {"title": " "}), {("error", "missing_title")}),
        "category": (record(metadata=record()["metadata"] | {"category": "odd"}), {("warning", "unknown_category")}),
        "none": (record(sections=[], detected_sections=None), {("error", "no_sections")}),
        "one of three": (record(sections=[section(1)]), {("error", "low_coverage")}),
        "two of three": (record(sections=[section(1), section(2)]), {("warning", "partial_coverage")}),
        "summaries": (record(sections=[section(1, summary_ko=""), section(2), section(3)]), {("warning", "missing_summaries")}),
        "paragraphs": (record(sections=[section(1, paragraphs=[{"en": "", "ko": "x"}]), section(2), section(3)]), {("error", "empty_paragraphs")}),
        "notes": (record(sections=[section(1, readers_notes_md="", paragraphs=[{"en": "e", "ko": "k" * 1200}]), section(2), section(3)]), {("error", "missing_notes")}),
        "short notes": (record(sections=[section(1, readers_notes_md="short"), section(2), section(3)]), {("warning", "short_notes")}),
        "copied": (record(sections=[section(1, summary_ko="가" * 70, paragraphs=[{"en": "e", "ko": "가" * 90}]), section(2), section(3)]), {("warning", "copied_summary")}),
        "repository": (record(github={"repo": "a/b"}, ambiguities=[{"id": "q1", "section_id": "s1"}]), {("error", "repository_without_link"), ("warning", "unresolved_ambiguities")}),
        "figures": (record(figures=None), {("warning", "no_figures_field")}),
    }
    frame = spark.createDataFrame([r | {"slug": name} for name, (r, _) in cases.items()], quality.RECORD)
    found = {name: set() for name in cases}
    for r in quality.findings(frame).collect():
        found[r.slug].add((r.severity, r.rule))
    assert found == {name: want for name, (_, want) in cases.items()}
    sizes = {r.slug: r.sections for r in quality.sizes(frame).collect()}
    assert sizes["clean"] == 3 and sizes["none"] == 0


def test_fuzzy_sections(spark):
    sections = spark.createDataFrame([("p", "2-method", "Method", "방법", 0), ("p", "3-method-details", "Method Details", "", 1)], "slug string, section_id string, title_en string, title_ko string, ord int")
    refs = spark.createDataFrame([("p", "method"), ("p", "3-method-details"), ("p", "Method Detail"), ("p", "nothing alike")], "slug string, ref string")
    got = {r.ref: r.section_id for r in quality.matched_sections(refs, sections).collect()}
    assert got == {"method": "2-method", "3-method-details": "3-method-details", "Method Detail": "3-method-details", "nothing alike": None}


def test_batches_of_merges(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, label string, at int")
    new = spark.createDataFrame([(2, "B", 0), (3, "c", 1)], old.schema)
    up = lambda a, b: records.upsert(a, b, "id", "at").select("id", "label", F.col("place.at").alias("at"))
    got = quality.applied(old, [("section", new), ("section", new)], {"section": up})
    assert {(r.id, r.label) for r in got.collect()} == {(1, "a"), (2, "B"), (3, "c")}
    with pytest.raises(ValueError, match="operation 0"):
        quality.applied(old, [("odd", new)], {})


def test_tags_survive_a_second_reading(spark):
    schema = "slug string, tags array<string>, category string"
    old = spark.createDataFrame([("p", ["VLM"], "llm"), ("q", [], "")], schema)
    new = spark.createDataFrame([("p", ["vlm", "new"], "other"), ("q", ["x"], "y")], schema)
    assert {(r.slug, tuple(r.tags), r.category) for r in quality.kept_tags(old, new).collect()} == {("p", ("VLM", "new"), "llm"), ("q", ("x",), "y")}
