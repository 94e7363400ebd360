"""Library: rows, filters, orders, joins, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import library as ops
from ..plans.library import LIBRARY_SQL, library, views
from ..session import table
from .registry import query

RATING_SQL = "greatest(0, least(5, coalesce(TRY_CAST(trim(rating_text) AS INTEGER), 0)))"
YM_SQL = r"""CASE WHEN regexp_matches(slug, '^\d{4}\.\d{4,5}') THEN (2000 + slug[1:2]::INT) * 100 + CASE WHEN slug[3:4]::INT BETWEEN 1 AND 12 THEN slug[3:4]::INT ELSE 1 END
 ELSE coalesce(year * 100, 0) END"""


def rows(spark: SparkSession, folder: str, tags: bool = True, sections: bool = True) -> DataFrame:
    found = library(spark, folder, tags, sections)
    return found.withColumns({"rating": ops.rating(F.col("rating_text")), "published_ym": ops.published_month(F.col("slug"), F.col("year"))})


ROWS_SQL = f"{LIBRARY_SQL}, rows AS (SELECT *, {RATING_SQL} AS rating, {YM_SQL} AS published_ym FROM library)"


@query(f"""{ROWS_SQL} SELECT slug, status, rating, title_en, sections_done, sections_total, row_number() OVER (ORDER BY rating DESC, updated_at DESC, seq) AS rank
FROM rows WHERE status IN ('in_progress', 'review_done') AND len(list_filter(tags, lambda t: t = 'ECONOMY' OR starts_with(t, 'ECONOMY/'))) > 0
ORDER BY rating DESC, updated_at DESC, seq LIMIT 20""")
def flagship_reading_queue(spark, folder):
    """In-progress or reviewed documents under a tag, best first, with their progress."""
    wanted = ops.with_tags(rows(spark, folder).where(F.col("status").isin("in_progress", "review_done")), ["ECONOMY"])
    return ops.ranked(wanted, "rating", 20).select("slug", "status", "rating", "title_en", "sections_done", "sections_total", "rank")


@query(f"""{ROWS_SQL} SELECT slug, status, rating, category, title_en, title_ko, created_at, updated_at, review_started, exported_at, sections_total, sections_done, published_ym, len(tags) AS n_tags,
array_to_string(tags, ',') AS tags FROM rows""")
def p01_library_rows(spark, folder):
    return rows(spark, folder).select("slug", "status", "rating", "category", "title_en", "title_ko", "created_at", "updated_at", "review_started", "exported_at", "sections_total", "sections_done", "published_ym", F.size("tags").alias("n_tags"), F.array_join("tags", ",").alias("tags"))


@query(f"{ROWS_SQL} SELECT rating_text, rating, count(*) AS n FROM rows GROUP BY 1, 2")
def p02_rating_parse(spark, folder):
    return rows(spark, folder, tags=False, sections=False).groupBy("rating_text", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(f"{ROWS_SQL} SELECT published_ym, count(*) AS n FROM rows GROUP BY 1")
def p03_published_month(spark, folder):
    return rows(spark, folder, tags=False, sections=False).groupBy("published_ym").agg(F.count(F.lit(1)).alias("n"))


@query(f"{ROWS_SQL} SELECT slug, status FROM rows WHERE status <> 'archived'")
def p04_status_filter(spark, folder):
    return ops.with_status(rows(spark, folder, tags=False, sections=False)).select("slug", "status")


@query(f"{ROWS_SQL} SELECT slug FROM rows WHERE len(list_filter(tags, lambda t: t = 'PROMO' OR starts_with(t, 'PROMO/'))) > 0 AND len(list_filter(tags, lambda t: t = 'SMALL/Brand#4' OR starts_with(t, 'SMALL/Brand#4/'))) > 0")
def p05_tag_filter(spark, folder):
    return ops.with_tags(rows(spark, folder, sections=False), ["PROMO", "SMALL/Brand#4"]).select("slug")


@query(f"{ROWS_SQL} SELECT slug FROM rows WHERE contains(lower(concat_ws(' ', title_en, title_ko, category, slug, array_to_string(tags, ' '))), lower('CUSTOMER 77'))")
def p06_text_search(spark, folder):
    return ops.matching(rows(spark, folder, sections=False), "CUSTOMER 77").select("slug")


@query(f"{ROWS_SQL} SELECT count(*) AS hits, count_if(status = 'archived') AS archived FROM rows WHERE contains(lower(concat_ws(' ', title_en, title_ko, category, slug, array_to_string(tags, ' '))), 'urgent')")
def p07_archived_hits(spark, folder):
    found = ops.with_status(ops.matching(rows(spark, folder, sections=False), "urgent"), searching=True)
    return found.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status") == "archived").alias("archived"))


@query(f"""{ROWS_SQL}, t AS (SELECT slug, seq, CASE WHEN seq % 5 = 0 THEN '' ELSE concat_ws(' ', title_en, category, repeat(slug || ' ', seq % 5)) END AS title_en, title_ko FROM rows)
SELECT slug, CASE WHEN length(trim(title_en)) > 70 THEN rtrim(left(trim(title_en), 67)) || '…' WHEN trim(title_en) <> '' THEN trim(title_en) WHEN trim(title_ko) <> '' THEN trim(title_ko) ELSE 'Paper review' END AS post_title FROM t""")
def p29_post_title(spark, folder):
    """Titles of up to 70 characters stay; a longer one is cut to 67 and marked; without one, the translated title or a label."""
    title = F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat_ws(" ", "title_en", "category", F.expr("repeat(slug || ' ', int(seq % 5))")))
    return rows(spark, folder, tags=False, sections=False).select("slug", ops.post_title(title, F.col("title_ko"), F.lit("Paper review")).alias("post_title"))


@query(f"{ROWS_SQL} SELECT slug, coalesce(nullif(title_ko, ''), nullif(title_en, ''), slug) AS title FROM rows")
def p30_display_title(spark, folder):
    return rows(spark, folder, tags=False, sections=False).select("slug", ops.display_title("title_ko", "title_en", "slug").alias("title"))


@query(f"{ROWS_SQL} SELECT slug FROM rows WHERE category IN ('high', 'low') ORDER BY seq LIMIT 50")
def p31_selected_run(spark, folder):
    """Chosen sections only, and at most so many: an IN filter with a limit."""
    return rows(spark, folder, tags=False, sections=False).where(F.col("category").isin("high", "low")).orderBy("seq").limit(50).select("slug")


@query(f"{ROWS_SQL}, v AS (SELECT user_id AS key, max(epoch(ts)::BIGINT) AS last_viewed FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'view') GROUP BY 1) SELECT slug, coalesce(last_viewed, 0) AS last_viewed FROM rows LEFT JOIN v ON v.key = rows.seq")
def j01_last_viewed(spark, folder):
    seen = views(spark, folder)
    found = rows(spark, folder, tags=False, sections=False).select("slug", "seq")
    return found.join(seen, found["seq"] == seen["key"], "left").select("slug", F.coalesce("last_viewed", F.lit(0)).alias("last_viewed"))


@query(f"{ROWS_SQL} SELECT slug, slug = 'doc-77' AS on_remote FROM rows")
def j02_remote_flag(spark, folder):
    slot = spark.range(1).select(F.lit("doc-77").alias("slot"))
    found = rows(spark, folder, tags=False, sections=False).select("slug")
    return found.join(F.broadcast(slot), found["slug"] == F.col("slot"), "left").select("slug", F.col("slot").isNotNull().alias("on_remote"))


@query(f"{ROWS_SQL} SELECT slug FROM rows WHERE seq IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')")
def j07_selected_semi_join(spark, folder):
    wanted = table(spark, folder, "events").where("event_type = 'error'").select(F.col("user_id").alias("seq"))
    return rows(spark, folder, tags=False, sections=False).join(wanted, "seq", "left_semi").select("slug")


GROUPS = {"economy": "ledger", "brand#3": "mascots", "promo": "posters"}
GROUPS_SQL = "(SELECT unnest(['economy', 'brand#3', 'promo']) AS tag, unnest(['ledger', 'mascots', 'posters']) AS grp)"


@query(f"""{ROWS_SQL}, cand AS (SELECT slug, unnest(list_transform(flatten(list_transform(tags, lambda t: list_concat([t], string_split(t, '/')))), lambda s: lower(trim(s)))) AS tag,
unnest(range(len(flatten(list_transform(tags, lambda t: list_concat([t], string_split(t, '/'))))))) AS pos FROM rows),
hit AS (SELECT slug, arg_min(grp, pos) AS grp FROM cand JOIN {GROUPS_SQL} g ON g.tag = cand.tag GROUP BY 1)
SELECT rows.slug AS slug, hit.grp AS "group" FROM rows LEFT JOIN hit ON hit.slug = rows.slug""")
def j17_illustration_group(spark, folder):
    groups = spark.createDataFrame(list(GROUPS.items()), "tag string, group string")
    return ops.with_group(rows(spark, folder, sections=False), groups)


WANTED_SQL = "(SELECT 'doc-' || unnest(range(1, 400, 3)) AS slug UNION ALL SELECT 'nope-' || unnest(range(3)))"
EDIT_SQL = """CASE WHEN status IS NULL THEN NULL ELSE
 CASE WHEN len(list_filter(kept, lambda t: lower(t) = 'survey')) > 0 THEN kept ELSE list_concat(kept, ['survey']) END END"""


@query(f"""{ROWS_SQL}, w AS {WANTED_SQL}, e AS (SELECT w.slug AS slug, status, list_filter(tags, lambda t: lower(t) <> 'promo') AS kept FROM w LEFT JOIN rows ON rows.slug = w.slug)
SELECT slug, status IS NULL AS missing, CASE WHEN status IS NOT NULL THEN 'archived' END AS status, array_to_string({EDIT_SQL}, ',') AS tags FROM e""")
def g25_bulk_edit(spark, folder):
    return _edited(spark, folder)


@query(f"""{ROWS_SQL}, w AS {WANTED_SQL} SELECT status IS NULL AS missing, count(*) AS n FROM w LEFT JOIN rows ON rows.slug = w.slug GROUP BY 1""")
def j22_changed_and_missing(spark, folder):
    return _edited(spark, folder).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def _edited(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.range(1, 400, 3).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("slug")).unionByName(spark.range(3).select(F.concat(F.lit("nope-"), F.col("id").cast("string")).alias("slug")))
    return ops.bulk_edit(rows(spark, folder, sections=False), wanted, "archived", ["survey"], ["promo"]).withColumn("tags", F.array_join("tags", ","))


for _mode, _keys in {"created": "created_at DESC", "edited": "updated_at DESC", "published": "published_ym DESC, created_at DESC", "rating": "rating DESC, updated_at DESC"}.items():

    def _ranked(spark, folder, mode=_mode):
        return ops.ranked(rows(spark, folder, tags=False, sections=False), mode).select("rank", "slug")

    _ranked.__name__ = f"o01_sorted_by_{_mode}"
    query(f"{ROWS_SQL} SELECT row_number() OVER (ORDER BY {_keys}, seq) AS rank, slug FROM rows")(_ranked)


@query(f"{ROWS_SQL} SELECT slug, array_to_string(tags[1:3], ',') AS shown, greatest(len(tags) - 3, 0) AS more FROM rows")
def o05_card_tags(spark, folder):
    return rows(spark, folder, sections=False).select("slug", F.array_join(F.slice("tags", 1, 3), ",").alias("shown"), F.greatest(F.size("tags") - 3, F.lit(0)).alias("more"))


@query(f"{ROWS_SQL}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM rows) SELECT tag, row_number() OVER (ORDER BY tag) AS rank FROM t WHERE contains(lower(tag), 'brand#2') AND tag NOT IN ('PROMO/Brand#2', 'SMALL/Brand#2') ORDER BY tag LIMIT 12")
def o06_tag_suggestions(spark, folder):
    found = ops.exploded_tags(rows(spark, folder, sections=False)).select("tag").where(F.contains(F.lower("tag"), F.lit("brand#2")) & ~F.col("tag").isin("PROMO/Brand#2", "SMALL/Brand#2")).distinct()
    return found.orderBy("tag").limit(12).withColumn("rank", F.row_number().over(Window.orderBy("tag")))


@query(f"{ROWS_SQL} SELECT slug, updated_at FROM rows WHERE updated_at >= 900000000 ORDER BY updated_at DESC, slug DESC LIMIT 1")
def o07_latest_candidate(spark, folder):
    return rows(spark, folder, tags=False, sections=False).where("updated_at >= 900000000").orderBy(F.desc("updated_at"), F.desc("slug")).limit(1).select("slug", "updated_at")


@query(f"{ROWS_SQL} SELECT row_number() OVER (ORDER BY status, slug) AS rank, rpad(status, 12, ' ') || slug AS line FROM rows")
def o11_listing(spark, folder):
    found = ops.numbered(rows(spark, folder, tags=False, sections=False).select("status", "slug"), F.asc("status"), F.asc("slug"))
    return found.select("rank", F.concat(F.rpad("status", 12, " "), "slug").alias("line"))


@query(f"{ROWS_SQL}, d AS (SELECT slug, row_number() OVER (ORDER BY created_at DESC, seq) AS rank FROM rows ORDER BY created_at DESC, seq LIMIT 100) SELECT slug, rank FROM d WHERE rank BETWEEN 20 AND 45")
def o13_shift_range(spark, folder):
    return ops.ranked(rows(spark, folder, tags=False, sections=False), "created", 100).where("rank BETWEEN 20 AND 45").select("slug", "rank")


@query(f"{ROWS_SQL} SELECT tag, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM (SELECT tag, count(*) AS n, min(seq * 1000 + pos) AS first FROM (SELECT seq, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM rows) GROUP BY 1)")
def a01_tag_counts(spark, folder):
    return ops.tag_counts(rows(spark, folder, sections=False))


@query(f"{ROWS_SQL}, p AS (SELECT slug, unnest([array_to_string(string_split(tag, '/')[1:i], '/') FOR i IN range(1, len(string_split(tag, '/')) + 1)]) AS prefix FROM (SELECT slug, unnest(tags) AS tag FROM rows)) SELECT prefix, count(DISTINCT slug) AS documents FROM p GROUP BY 1")
def a03_tag_tree(spark, folder):
    return ops.tag_tree(rows(spark, folder))


@query(f"{ROWS_SQL}, p AS (SELECT slug, unnest([array_to_string(string_split(tag, '/')[1:i], '/') FOR i IN range(1, len(string_split(tag, '/')) + 1)]) AS prefix FROM (SELECT slug, unnest(tags) AS tag FROM rows)), c AS (SELECT prefix, count(DISTINCT slug) AS documents FROM p GROUP BY 1) SELECT row_number() OVER (ORDER BY documents DESC, prefix) AS rank, prefix, documents FROM c")
def o03_tag_tree_order(spark, folder):
    tree = ops.tag_tree(rows(spark, folder))  # one row per prefix of the tag vocabulary
    return ops.numbered(tree, F.desc("documents"), F.asc("prefix"))


@query(f"{ROWS_SQL} SELECT DISTINCT unnest([array_to_string(string_split(tag, '/')[1:i], '/') FOR i IN range(1, len(string_split(tag, '/')) + 1)]) AS path FROM (SELECT unnest(tags) AS tag FROM rows)")
def x10_tag_paths(spark, folder):
    return rows(spark, folder).select(F.explode(F.flatten(F.transform("tags", ops.tag_prefixes))).alias("path")).distinct()


@query(f"{ROWS_SQL}, u AS (SELECT slug, tag, min(pos) AS pos FROM (SELECT slug, trim(unnest(tags)) AS tag, unnest(range(len(tags))) AS pos FROM rows) WHERE tag <> '' GROUP BY ALL) SELECT slug, string_agg(tag, ',' ORDER BY pos) AS tags FROM u GROUP BY 1")
def x03_distinct_tags(spark, folder):
    clean = F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""))
    return rows(spark, folder).where(F.size("tags") > 0).select("slug", F.array_join(clean, ",").alias("tags"))


@query(f"{ROWS_SQL}, k AS (SELECT slug, list_filter(tags, lambda t: lower(t) NOT IN ('economy', 'small')) AS kept FROM rows) SELECT slug, array_to_string(CASE WHEN len(list_filter(kept, lambda t: lower(t) = 'promo')) > 0 THEN kept ELSE list_concat(kept, ['promo']) END, ',') AS tags FROM k")
def x04_tags_added_and_removed(spark, folder):
    return rows(spark, folder).select("slug", F.array_join(ops.edited_tags(F.col("tags"), ["promo"], ["Economy", "small"]), ",").alias("tags"))


@query(f"""{ROWS_SQL}, m AS (SELECT slug, unnest(list_transform(tags, lambda t: CASE WHEN lower(t) = 'economy' THEN 'promo' ELSE t END)) AS tag, unnest(range(len(tags))) AS pos FROM rows),
u AS (SELECT slug, arg_min(tag, pos) AS tag, min(pos) AS pos FROM m GROUP BY slug, lower(tag)) SELECT slug, string_agg(tag, ',' ORDER BY pos) AS tags FROM u GROUP BY 1""")
def x05_tag_renamed(spark, folder):
    return rows(spark, folder).where(F.size("tags") > 0).select("slug", F.array_join(ops.renamed_tags(F.col("tags"), "economy", "promo"), ",").alias("tags"))


@query(f"{ROWS_SQL}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM rows) SELECT tag FROM t EXCEPT SELECT 'PROMO' EXCEPT SELECT p_type FROM part WHERE p_size > 49")
def x13_unselected_tags(spark, folder):
    every = ops.exploded_tags(rows(spark, folder)).select("tag").distinct()
    chosen = spark.range(1).select(F.lit("PROMO").alias("tag")).unionByName(table(spark, folder, "part").where("p_size > 49").select(F.col("p_type").alias("tag")))
    return every.join(chosen, "tag", "left_anti")


@query(f"""{ROWS_SQL}, now AS (SELECT slug, status FROM rows WHERE seq % 5 <> 0) SELECT slug, status FROM rows WHERE slug NOT IN (SELECT slug FROM now)""")
def r11_vanished_keys(spark, folder):
    """Keys of the previous snapshot that the current one lacks."""
    before = rows(spark, folder)
    return before.select("slug", "status").join(before.where("seq % 5 <> 0").select("slug"), "slug", "left_anti")


@query(f"""{ROWS_SQL} SELECT slug, '[' || array_to_string(list_transform(list_filter([lower(category), CASE WHEN status = 'exported' THEN 'released' ELSE '' END], lambda x: x <> '' AND x <> 'low'), lambda x: '"' || x || '"'), ', ') || ']' AS tags FROM rows""")
def g16_draft_tags(spark, folder):
    """A draft's tag list: category and kind, without empty and default ones."""
    parts = F.filter(F.array(F.lower("category"), F.when(F.col("status") == "exported", "released").otherwise("")), lambda x: (x != "") & (x != "low"))
    return rows(spark, folder).select("slug", F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")).alias("tags"))


@query(f"""{ROWS_SQL} SELECT slug, CASE WHEN regexp_matches(slug, '^\\d{{4}}\\.\\d{{4,5}}$') THEN 'paper' WHEN category LIKE '%medium%' THEN 'web' ELSE 'file' END AS source FROM rows""")
def g24_promotion_source(spark, folder):
    """Which way a saved document is promoted, by the fields it has."""
    return rows(spark, folder).select("slug", F.when(F.col("slug").rlike(r"^\d{4}\.\d{4,5}$"), "paper").when(F.contains("category", F.lit("medium")), "web").otherwise("file").alias("source"))
