"""Quality gates of nested document records: one rule is one boolean column, findings are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shuffled
from .library import first_of_each

# Required and recommended fields, categories and limits.
REQUIRED = ("title", "authors")
RECOMMENDED = ("title_ko", "venue", "year", "url", "abstract_en", "abstract_ko")
CATEGORIES = ("vlm", "llm", "vision", "speech", "rl", "robotics", "other")
NOTES_FROM, NOTES_LEAST, MISSING_SHARE, COPIED_PREFIX = 1000, 80, 0.3, 60

RECORD = """slug string, metadata struct<title: string, title_ko: string, authors: array<string>, venue: string, year: int, category: string, url: string, github_url: string, abstract_en: string, abstract_ko: string>,
sections array<struct<id: string, title_en: string, summary_ko: string, paragraphs: array<struct<en: string, ko: string>>, readers_notes_md: string>>, prerequisites array<string>, key_terms array<string>, github struct<repo: string>,
ambiguities array<struct<id: string, section_id: string>>, code_clarifications array<struct<ambiguity_id: string>>, figures array<struct<id: string>>, detected_sections int"""


def _empty(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")) == "", F.lit(True))


def findings(records: DataFrame) -> DataFrame:
    """slug, severity, rule, detail of everything that a record (see RECORD) lacks."""
    m = "metadata."
    n = F.size(F.coalesce("sections", F.array()))
    coverage = n / F.nullif("detected_sections", F.lit(0))
    lacking = F.filter("sections", lambda s: F.coalesce(F.trim(s["summary_ko"]) == "", F.lit(True)))
    chars = lambda s: F.aggregate(s["paragraphs"], F.lit(0), lambda a, p: a + F.length(F.coalesce(p["ko"], F.lit(""))))
    notes = lambda s: F.length(F.trim(F.coalesce(s["readers_notes_md"], F.lit(""))))
    blank = F.filter("sections", lambda s: F.exists(s["paragraphs"], lambda p: (F.coalesce(F.trim(p["en"]), F.lit("")) == "") | (F.coalesce(F.trim(p["ko"]), F.lit("")) == "")))
    without_notes = F.filter("sections", lambda s: (chars(s) >= NOTES_FROM) & (notes(s) == 0))
    short_notes = F.filter("sections", lambda s: (notes(s) > 0) & (notes(s) < NOTES_LEAST))
    copied = F.filter("sections", lambda s: (F.length(s["summary_ko"]) >= COPIED_PREFIX) & F.startswith(F.coalesce(F.get(s["paragraphs"], F.lit(0))["ko"], F.lit("")), F.substring(s["summary_ko"], 1, COPIED_PREFIX)))
    ids = lambda found: F.array_join(F.transform(F.slice(found, 1, 5), lambda s: s["id"]), ",")
    unresolved = F.array_except(F.transform("ambiguities", lambda a: a["id"]), F.transform(F.coalesce("code_clarifications", F.array().cast("array<struct<ambiguity_id: string>>")), lambda c: c["ambiguity_id"]))
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    rules = [
        *[("error", f"missing_{f}", none(m + f) if f == "authors" else _empty(m + f), F.lit(f)) for f in REQUIRED],
        *[("warning", f"missing_{f}", _empty(m + f), F.lit(f)) for f in RECOMMENDED],
        ("warning", "unknown_category", ~F.coalesce(F.col(m + "category").isin(*CATEGORIES), F.lit(False)), F.coalesce(m + "category", F.lit(""))),
        ("error", "no_sections", n == 0, F.lit("")),
        ("error", "low_coverage", coverage < 0.5, F.format_string("%d of %d", n, "detected_sections")),
        ("warning", "partial_coverage", (coverage >= 0.5) & (coverage < 1), F.format_string("%d of %d", n, "detected_sections")),
        ("warning", "missing_summaries", F.size(lacking) > MISSING_SHARE * n, ids(lacking)),
        ("error", "empty_paragraphs", F.size(blank) > 0, ids(blank)),
        ("error", "missing_notes", F.size(without_notes) > 0, ids(without_notes)),
        ("warning", "short_notes", F.size(short_notes) > 0, ids(short_notes)),
        ("warning", "copied_summary", F.size(copied) > 0, ids(copied)),
        ("warning", "no_prerequisites", none("prerequisites"), F.lit("")),
        ("warning", "no_key_terms", none("key_terms"), F.lit("")),
        ("error", "repository_without_link", F.col("github").isNotNull() & _empty(m + "github_url"), F.coalesce("github.repo", F.lit(""))),
        ("warning", "unresolved_ambiguities", F.col("github").isNotNull() & (F.size(unresolved) > 0), F.array_join(unresolved, ",")),
        ("warning", "no_figures_field", F.col("figures").isNull(), F.lit("")),
    ]
    rows = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail"))) for severity, rule, test, detail in rules])
    return records.select("slug", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select("slug", "f.*")


def sizes(records: DataFrame) -> DataFrame:
    """How much each collection of a record holds."""
    parts = ("sections", "prerequisites", "key_terms", "ambiguities", "code_clarifications", "figures")
    return records.select("slug", *[F.when(F.col(p).isNull(), 0).otherwise(F.size(p)).alias(p) for p in parts])


def matched_sections(references: DataFrame, sections: DataFrame) -> DataFrame:
    """slug, ref, section_id: sections (slug, section_id, title_en, title_ko, ord) whose key holds a reference's key or
    is held by it; of several the closest in length, then the first. An exact id needs no search; no match gives null.

    The join is on the document, so that it compares the few sections of one document.
    """
    key = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    candidates = sections.select("slug", "section_id", "ord", F.posexplode(F.array(key(F.col("section_id")), key(F.col("title_en")), key(F.col("title_ko")))).alias("which", "k")).where("k <> ''")
    wanted = references.select("slug", "ref", key(F.col("ref")).alias("r")).distinct()
    score = F.when(F.col("ref") == F.col("section_id"), 2.0).otherwise(F.least(F.length("k"), F.length("r")) / F.greatest(F.length("k"), F.length("r")))
    meets = (F.col("r") != "") & (F.contains("k", F.col("r")) | F.contains("r", F.col("k")))
    hits = wanted.alias("w").join(shuffled(candidates).alias("c"), (F.col("w.slug") == F.col("c.slug")) & meets, "left")
    return hits.groupBy("w.slug", "ref").agg(F.max_by("section_id", F.struct(score, -F.col("ord"), -F.col("which"))).alias("section_id"))


def applied(record: DataFrame, operations: list[tuple[str, DataFrame]], merges: dict) -> DataFrame:
    """Merges in order, one after the other in one plan; an unknown kind is refused by its place."""
    for place, (kind, rows) in enumerate(operations):
        if kind not in merges:
            raise ValueError(f"operation {place}: unknown kind {kind}")
        record = merges[kind](record, rows)
    return record


def kept_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents read in anew keep their tags and category where they had some."""
    before = old.select("slug", F.col("tags").alias("_tags"), F.col("category").alias("_category"))
    return new.join(before, "slug", "left").withColumns({"tags": F.when(F.size("_tags") > 0, first_of_each(F.concat("_tags", "tags"))).otherwise(F.col("tags")), "category": F.coalesce(F.nullif("_category", F.lit("")), "category")}).drop("_tags", "_category")
