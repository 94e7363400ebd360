"""Filters, orders, joins and tag edits of a library of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def rating(text: Column) -> Column:
    """A whole number as text, clamped to 0..5; anything else is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.trim(text).try_cast("int"), F.lit(0))))


def published_month(slug: Column, year: Column) -> Column:
    """YYYYMM from a slug YYMM.NNNNN (a month out of range counts as January); else the year's start as YYYY00; else 0."""
    yymm = F.regexp_extract(slug, r"^(\d{4})\.\d{4,5}", 1)
    y, m = F.substring(yymm, 1, 2).try_cast("int"), F.substring(yymm, 3, 2).try_cast("int")
    return F.when(yymm != "", (2000 + y) * 100 + F.when(m.between(1, 12), m).otherwise(1)).otherwise(F.coalesce(year * 100, F.lit(0)))


def display_title(*titles: str) -> Column:
    """The first title that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(t), F.lit("")) for t in titles])


def with_status(rows: DataFrame, chosen: str = "all", searching: bool = False) -> DataFrame:
    """Rows of one status; "all" hides archived ones unless a search is active."""
    if chosen != "all":
        return rows.where(F.col("status") == chosen)
    return rows if searching else rows.where(F.col("status") != "archived")


def with_tags(rows: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Rows that have every selected tag or one below it."""
    for tag in selected:
        rows = rows.where(F.exists("tags", _at_or_below(tag)))
    return rows


def _at_or_below(tag: str):
    return lambda t: (t == tag) | t.startswith(tag + "/")


def matching(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose titles, category, slug or tags contain the text, whatever the case."""
    hay = F.lower(F.concat_ws(" ", "title_en", "title_ko", "category", "slug", F.array_join("tags", " ")))
    return rows.where(F.contains(hay, F.lower(F.lit(text))))


#: Sort modes; ``seq`` settles ties.
ORDERS = {
    "created": ("created_at",),
    "edited": ("updated_at",),
    "published": ("published_ym", "created_at"),
    "rating": ("rating", "updated_at"),
}


def sort_keys(mode: str) -> list[Column]:
    """The keys of a sort mode; an unknown mode sorts by creation."""
    return [F.desc(c) for c in ORDERS.get(mode, ORDERS["created"])] + [F.asc("seq")]


def ranked(rows: DataFrame, mode: str, top: int | None = None) -> DataFrame:
    """Rows of a sort mode, numbered from 1: all of them, or the first ``top``, a distributed top-k of which only these
    rows meet in one window."""
    keys = sort_keys(mode)
    if top is None:
        return numbered(rows, *keys)
    return rows.orderBy(*keys).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def numbered(rows: DataFrame, *keys: Column) -> DataFrame:
    """All rows with their rank, from 1, in an order without ties.

    Ranges of the order are sorted apart and stored; a row's rank is its place in its range behind the sizes of all
    ranges before it, which is one number per range.
    """
    place = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's place in it
    stored = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place), "ordered")
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row per range, however many rows these hold
    return stored.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + at + 1).drop("_part", "_place", "_before")


def post_title(title: Column, other: Column, label: Column, longest: int = 70, kept: int = 67) -> Column:
    """A title of at most ``longest`` characters; a longer one is cut and marked. Without it the other title, then the
    content type's label."""
    own = F.trim(F.coalesce(title, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(own, 1, kept)), F.lit("…"))
    return F.when(F.length(own) > longest, cut).when(own != "", own).otherwise(F.coalesce(F.nullif(F.trim(other), F.lit("")), label))


def exploded_tags(rows: DataFrame, key: str = "slug") -> DataFrame:
    return rows.select(key, F.posexplode("tags").alias("pos", "tag"))


def tag_counts(rows: DataFrame) -> DataFrame:
    """tag, n, rank: how often each tag occurs, twice in a document that has it twice; most frequent first, then the one
    that is seen first in the order of ``seq``."""
    each = exploded_tags(rows, "seq").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    return numbered(each, F.desc("n"), F.asc("first")).select("tag", "n", "rank")


def tag_prefixes(tag: Column) -> Column:
    """Every prefix of a tag at a slash, itself included."""
    parts = F.split(tag, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def tag_tree(rows: DataFrame) -> DataFrame:
    """Documents at or below each prefix, each counted once."""
    exploded = rows.select("slug", F.explode(F.array_distinct(F.flatten(F.transform("tags", tag_prefixes)))).alias("prefix"))
    return exploded.groupBy("prefix").agg(F.count(F.lit(1)).alias("documents"))  # prefixes are distinct inside a document


def first_of_each(values: Column) -> Column:
    """Distinct values whatever the case, the first spelling of each, order kept."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def edited_tags(tags: Column, add: Sequence[str], remove: Sequence[str]) -> Column:
    """Tags without the removed ones and with the added ones behind, both whatever the case."""
    gone = F.array(*[F.lit(r.lower()) for r in remove]).cast("array<string>")
    left = F.filter(tags, lambda t: ~F.array_contains(gone, F.lower(t)))
    for tag in add:
        left = F.when(F.exists(left, _same(tag)), left).otherwise(F.concat(left, F.array(F.lit(tag))))
    return left


def _same(tag: str):
    return lambda t: F.lower(t) == tag.lower()


def renamed_tags(tags: Column, old: str, new: str) -> Column:
    """A tag renamed, or removed for an empty new name; case variants of the result merge, first one stays."""
    moved = F.transform(tags, lambda t: F.when(F.lower(t) == old.strip().lower(), F.lit(new.strip())).otherwise(t))
    return first_of_each(F.filter(moved, lambda t: t != ""))


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The group of the first tag or tag segment that ``groups`` (tag, group) knows; null where none is known.

    ``groups`` are a display's settings, a few rows, and meet every document as one map: tags are neither exploded nor
    sorted, and the documents are made once.
    """
    segments = F.flatten(F.transform("tags", lambda t: F.concat(F.array(t), F.split(t, "/"))))
    each = groups.where("tag IS NOT NULL").groupBy("tag").agg(F.min("group").alias("group"))
    known = each.agg(F.map_from_entries(F.collect_list(F.struct("tag", "group"))).alias("known"))
    found = F.filter(F.transform(segments, lambda s: F.lower(F.trim(s))), lambda s: F.map_contains_key("known", s))
    return rows.select("slug", "tags").crossJoin(F.broadcast(known)).select("slug", F.element_at("known", F.get(found, F.lit(0))).alias("group"))


def bulk_edit(library: DataFrame, wanted: DataFrame, status: str | None, add: Sequence[str], remove: Sequence[str]) -> DataFrame:
    """Wanted slugs with their new status and tags; ``missing`` marks slugs that the library lacks."""
    rows = wanted.join(library.select("slug", "status", "tags"), "slug", "left")
    missing = F.col("status").isNull()
    return rows.select("slug", missing.alias("missing"), F.when(~missing, F.lit(status) if status else F.col("status")).alias("status"), F.when(~missing, edited_tags(F.col("tags"), add, remove)).alias("tags"))
