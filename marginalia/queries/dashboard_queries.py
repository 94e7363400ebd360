"""Dashboards, dates and hashes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window, functions as F

from ..functions import hashes
from ..functions.text import printed
from ..operators import dashboards as ops, library as lib
from ..plans.library import views
from ..session import dealt, shuffled, table
from .library_queries import ROWS_SQL, rows
from .registry import query

AS_OF = date(2000, 6, 15)
AS_OF_SECONDS = 961027200
DATE_SQL = r"CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN coalesce(epoch(TRY_CAST({0}[1:10] AS DATE))::BIGINT, 0) ELSE 0 END"
INTAKE_SQL = f"CASE WHEN created_at <> 0 THEN created_at ELSE {DATE_SQL.format('review_started')} END"
EXPORT_SQL = DATE_SQL.format("exported_at")
MONTH_SQL = "strftime(make_timestamp(({0}) * 1000000), '%Y-%m')"
EXPORTED_SQL = f"{ROWS_SQL}, exp AS (SELECT *, {EXPORT_SQL} AS export_s, {INTAKE_SQL} AS intake_s FROM rows WHERE status = 'exported' OR ({EXPORT_SQL}) <> 0)"
AXIS_SQL = "(SELECT strftime(DATE '1999-07-01' + to_months(i::INT), '%Y-%m') AS month FROM range(12) t(i))"


@query(f"""{ROWS_SQL} SELECT count_if(status <> 'archived') AS "all", count_if(status = 'to_read') AS to_read, count_if(status = 'in_progress') AS in_progress, count_if(status = 'review_done') AS review_done, count_if(status = 'exported') AS exported, count_if(status = 'archived') AS archived FROM rows""")
def a02_status_counts(spark, folder):
    return ops.status_counts(rows(spark, folder))


@query(f"{ROWS_SQL} SELECT count(*) AS documents, sum(sections_done) AS done, sum(sections_total) AS total, CASE WHEN sum(sections_total) > 0 THEN round(sum(sections_done) / sum(sections_total) * 100)::INT ELSE 0 END AS percent FROM rows")
def a05_progress_kpi(spark, folder):
    return ops.progress(rows(spark, folder))


@query(f"{ROWS_SQL}, d AS (SELECT r::INT AS rating, count(rows.rating) AS n FROM range(1, 6) t(r) LEFT JOIN rows ON rows.rating = r GROUP BY 1) SELECT rating, n, greatest(4, round(n / greatest(1, max(n) OVER ()) * 100))::INT AS width FROM d")
def a06_rating_distribution(spark, folder):
    return ops.rating_distribution(rows(spark, folder))


@query(f"{ROWS_SQL} SELECT count(*) AS rated, coalesce(avg(rating), 0) AS average FROM rows WHERE rating > 0")
def a07_average_rating(spark, folder):
    return rows(spark, folder).where("rating > 0").agg(F.count(F.lit(1)).alias("rated"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average"))


@query(f"{ROWS_SQL}, c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM rows) GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, tag) AS rank, tag, n FROM c ORDER BY n DESC, tag LIMIT 6")
def a08_top_tags(spark, folder):
    top = lib.exploded_tags(rows(spark, folder)).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(6)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))


@query(f"{ROWS_SQL}, s AS (SELECT {INTAKE_SQL} AS s FROM rows) SELECT CASE WHEN s <> 0 THEN {MONTH_SQL.format('s')} END AS month, count(*) AS n FROM s GROUP BY 1")
def a09_monthly_intake(spark, folder):
    return ops.monthly(rows(spark, folder), ops.intake_seconds())


@query(f"{ROWS_SQL}, s AS (SELECT {INTAKE_SQL} AS s FROM rows), m AS (SELECT {MONTH_SQL.format('s')} AS month, count(*) AS n FROM s WHERE s <> 0 GROUP BY 1), d AS (SELECT a.month AS month, coalesce(n, 0) AS n FROM {AXIS_SQL} a LEFT JOIN m ON m.month = a.month) SELECT month, n, CASE WHEN n = 0 THEN 2 ELSE greatest(6, round(n / greatest(1, max(n) OVER ()) * 76))::INT END AS height FROM d")
def a10_month_chart(spark, folder):
    return ops.month_chart(rows(spark, folder), ops.intake_seconds(), AS_OF)


@query(f"{EXPORTED_SQL} SELECT (SELECT count(*) FROM exp) AS exported, (SELECT count(*) FROM rows) AS documents, round((SELECT count(*) FROM exp) / (SELECT count(*) FROM rows) * 100)::INT AS rate")
def a11_export_rate(spark, folder):
    marked = rows(spark, folder).select(((F.col("status") == "exported") | (ops.date_seconds("exported_at") != 0)).alias("out"))
    return marked.agg(F.count_if("out").alias("exported"), F.count(F.lit(1)).alias("documents")).withColumn("rate", F.round(F.col("exported") / F.col("documents") * 100).cast("int"))


@query(f"{EXPORTED_SQL} SELECT count(*) AS pairs, round(median(round((export_s - intake_s) / 86400)))::BIGINT AS median_days FROM exp WHERE intake_s <> 0 AND export_s <> 0 AND export_s >= intake_s")
def a12_median_export_lag(spark, folder):
    return ops.median_lag(rows(spark, folder))


@query(f"{EXPORTED_SQL} SELECT CASE WHEN export_s <> 0 THEN {MONTH_SQL.format('export_s')} END AS month, count(*) AS n FROM exp GROUP BY 1")
def a13_monthly_exports(spark, folder):
    return ops.monthly(ops.exported(rows(spark, folder)), F.col("export_s"))


@query(f"{EXPORTED_SQL} SELECT row_number() OVER (ORDER BY export_s DESC, seq) AS rank, slug, exported_at, left(coalesce(nullif(title_ko, ''), nullif(title_en, ''), slug), 46) AS title FROM exp WHERE export_s <> 0 ORDER BY export_s DESC, seq LIMIT 5")
def a14_recent_exports(spark, folder):
    top = ops.exported(rows(spark, folder)).where("export_s <> 0").orderBy(F.desc("export_s"), "seq").limit(5)
    return top.select(F.row_number().over(Window.orderBy(F.desc("export_s"), "seq")).alias("rank"), "slug", "exported_at", F.substring(lib.display_title("title_ko", "title_en", "slug"), 1, 46).alias("title"))


@query(f"{ROWS_SQL} SELECT slug, 90 * (sections_done = 0)::INT + 60 * (sections_total - sections_done) AS seconds, round(0.15 * (sections_done = 0)::INT + 0.07 * (sections_total - sections_done), 2)::DOUBLE AS dollars FROM rows")
def a26_analysis_estimate(spark, folder):
    """90 s and $0.15 for an introduction, 60 s and $0.07 for each open section."""
    first, left = (F.col("sections_done") == 0).cast("int"), F.col("sections_total") - F.col("sections_done")
    return rows(spark, folder).select("slug", (90 * first + 60 * left).alias("seconds"), F.round(0.15 * first + 0.07 * left, 2).alias("dollars"))


@query(f"{ROWS_SQL} SELECT status, {MONTH_SQL.format('updated_at')} AS month, count(*) AS n FROM rows GROUP BY 1, 2")
def m01_month_key(spark, folder):
    return rows(spark, folder).groupBy("status", ops.month_key("updated_at").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{ROWS_SQL} SELECT slug, {DATE_SQL.format('review_started')} AS seconds FROM rows")
def m02_date_prefix(spark, folder):
    return rows(spark, folder).select("slug", ops.date_seconds("review_started").alias("seconds"))


@query(f"""{ROWS_SQL}, a AS (SELECT slug, created_at AS s, {AS_OF_SECONDS} - created_at AS ago FROM rows) SELECT slug, CASE WHEN s = 0 THEN '' WHEN ago < 90 THEN 'just now' WHEN ago < 3600 THEN (ago // 60)::VARCHAR || 'm ago' WHEN ago < 86400 THEN (ago // 3600)::VARCHAR || 'h ago'
WHEN ago < 604800 THEN (ago // 86400)::VARCHAR || 'd ago' WHEN ago < 2592000 THEN (ago // 604800)::VARCHAR || 'w ago' WHEN ago < 31536000 THEN (ago // 2592000)::VARCHAR || 'mo ago' ELSE (ago // 31536000)::VARCHAR || 'y ago' END AS ago FROM a""")
def m03_relative_time(spark, folder):
    return rows(spark, folder).select("slug", ops.relative_time(F.col("created_at"), AS_OF_SECONDS).alias("ago"))


@query(f"{ROWS_SQL}, v AS (SELECT user_id AS key, max(epoch(date_trunc('second', ts))::BIGINT) AS last_viewed FROM events WHERE event_type = 'view' GROUP BY 1) SELECT slug, greatest(updated_at, coalesce(last_viewed, 0)) AS at, CASE WHEN coalesce(last_viewed, 0) > updated_at THEN 'viewed' ELSE 'edited' END AS what FROM rows LEFT JOIN v ON v.key = rows.seq")
def m04_last_activity(spark, folder):
    seen = F.coalesce("last_viewed", F.lit(0))
    found = rows(spark, folder)
    joined = found.join(views(spark, folder), found["seq"] == F.col("key"), "left")
    return joined.select("slug", F.greatest("updated_at", seen).alias("at"), F.when(seen > F.col("updated_at"), "viewed").otherwise("edited").alias("what"))


@query(f"{ROWS_SQL} SELECT slug, abs(updated_at - (updated_at + seq % 4 - 1)) > 1 AS conflict FROM rows")
def m05_edit_conflict(spark, folder):
    """An edit conflicts when the stored time differs by more than a second from the one that the editor saw."""
    seen = F.col("updated_at") + F.col("seq") % 4 - 1
    return rows(spark, folder).select("slug", (F.abs(F.col("updated_at") - seen) > 1).alias("conflict"))


@query(f"{ROWS_SQL} SELECT slug, round(sections_done / greatest(sections_total, 1) * 100)::INT AS percent, least(sections_total, 14) AS segments FROM rows")
def m06_card_progress(spark, folder):
    return rows(spark, folder).select("slug", F.round(F.col("sections_done") / F.greatest("sections_total", F.lit(1)) * 100).cast("int").alias("percent"), F.least("sections_total", F.lit(14)).alias("segments"))


@query(f"{ROWS_SQL}, c AS (SELECT status, count(*) AS n FROM rows GROUP BY 1) SELECT status, n, greatest(4, round(n / max(n) OVER () * 100))::INT AS width FROM c")
def m07_bar_widths(spark, folder):
    counts = rows(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("top")))).select("status", "n", F.greatest(F.lit(4.0), F.round(F.col("n") / F.col("top") * 100)).cast("int").alias("width"))


CODES_SQL = "list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)"


@query(f"""{ROWS_SQL}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM rows) SELECT tag, list_reduce(list_concat([0::BIGINT], {CODES_SQL.format("string_split(tag, '/')[1]")}), lambda h, c: (h * 37 + c) % 4294967296) % 360 AS hue FROM t""")
def m08_tag_hue(spark, folder):
    return lib.exploded_tags(rows(spark, folder)).select("tag").distinct().select("tag", hashes.tag_hue(F.col("tag")).alias("hue"))


@query(f"SELECT url, abs(list_reduce(list_concat([5381::BIGINT], {CODES_SQL.format('url')}), lambda h, c: ((h * 33 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) AS hash FROM pages")
def m09_djb2(spark, folder):
    return table(spark, folder, "pages").select("url", hashes.djb2(F.col("url")).alias("hash"))


@query(f"SELECT url, list_reduce(list_concat([0::BIGINT], {CODES_SQL.format('url')}), lambda h, c: (h * 31 + c) % 10) AS digit FROM pages")
def m10_digit_hash(spark, folder):
    return table(spark, folder, "pages").select("url", hashes.digit_hash(F.col("url")).alias("digit"))


@query("SELECT a.p_partkey AS one, b.p_partkey AS other, least(length(a.p_name), length(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) AS ratio FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def m11_length_ratio(spark, folder):
    """All pairs of a brand's parts of one size: as many rows as the square of such a group. Groups are dealt to tasks by
    their number; the few bytes of their parts say nothing about the pairs."""
    part = dealt(table(spark, folder, "part").select("p_partkey", F.length("p_name").alias("n"), "p_brand", "p_size"), "p_brand", "p_size", per_task=5_000)
    other = part.select(F.col("p_partkey").alias("other"), F.col("n").alias("other_n"), "p_brand", "p_size")
    a, b = F.col("n"), F.col("other_n")
    return part.join(shuffled(other), ["p_brand", "p_size"]).where("p_partkey < other").select(F.col("p_partkey").alias("one"), "other", (F.least(a, b) / F.greatest(a, b)).alias("ratio"))


@query("SELECT event_id, round(value / 1000, 1) AS seconds, printf('%.4f', value) AS cost FROM events")
def m18_run_cost(spark, folder):
    """Duration in seconds and cost with four decimals, from a result event's numbers."""
    return table(spark, folder, "events").select("event_id", F.round(F.col("value") / 1000, 1).alias("seconds"), printed(F.col("value"), 4).alias("cost"))
