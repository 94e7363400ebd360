"""Stateful operators over whole tables: chunked events, deadlines, and a cache that batches of changes keep."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..session import scratch_root, table
from ..streaming import deadlines, frames
from ..streaming.row_cache import RowCache
from .registry import query


@query("SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, props AS data FROM events WHERE event_type <> 'error' AND props IS NOT NULL")
def r05_stream_frames(spark, folder):
    """Data blocks of server-sent text; comments, named events and broken ones are skipped. Each event's text arrives in two
    chunks, cut at a place that varies with its id, often inside the JSON or the blank line behind it."""
    e = table(spark, folder, "events")
    broken = F.element_at(F.array(*map(F.lit, ("data: broken\n\n", ": note\n\n", 'event: x\ndata: {"k": 1}\n\n', "data:\n\n"))), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.when((F.col("event_type") == "error") | F.col("props").isNull(), broken).otherwise(F.concat(F.lit("data: "), "props", F.lit("\n\n")))
    at = F.col("event_id") * 7 % (F.length("text") + 1)
    halves = F.array(F.struct((2 * F.col("event_id")).alias("seq"), F.left("text", at).alias("text")), F.struct((2 * F.col("event_id") + 1).alias("seq"), F.substring("text", at + 1, F.length("text")).alias("text")))
    chunks = e.withColumn("text", text).select(F.col("user_id").alias("key"), F.explode(halves).alias("half")).select("key", "half.*")
    order = F.row_number().over(Window.partitionBy("key").orderBy("seq", "n")).cast("long")
    return frames.frames(chunks).select("key", order.alias("n"), "data")


HOURS_3 = 3 * 3_600_000
JOB = "user_id || '@' || strftime(ts, '%Y-%m-%d')"


@query(f"""WITH e AS (SELECT {JOB} AS job, epoch_us(ts) // 1000 AS ms, event_type AS t FROM events), s AS (SELECT job, min(ms) AS started FROM e WHERE t = 'view' GROUP BY 1),
l AS (SELECT * FROM e JOIN s USING (job) WHERE ms BETWEEN started AND started + {HOURS_3}), x AS (SELECT job, min(ms) AS ended, arg_min(t, ms) AS how FROM l WHERE t IN ('error', 'purchase') GROUP BY 1),
o AS (SELECT job, started, coalesce(ended, started + {HOURS_3}) AS ended, CASE how WHEN 'error' THEN 'cancelled' WHEN 'purchase' THEN 'done' ELSE 'timeout' END AS outcome FROM s LEFT JOIN x USING (job))
SELECT o.*, (SELECT count(*) FROM l WHERE l.job = o.job AND t NOT IN ('view', 'error', 'purchase') AND ms <= ended) AS lines FROM o""")
def r09_job_outcomes(spark, folder):
    """A user's day as a job: it begins with a view, ends with a purchase or an error, or after three hours."""
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", "cancel").otherwise("line")
    events = table(spark, folder, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("job"), "ts", kind.alias("kind"))
    return deadlines.outcomes(events, HOURS_3)


@query("""WITH o AS (SELECT o_orderkey AS slug, epoch_ms(o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS changed_at, o_custkey AS figures_at FROM orders WHERE o_orderkey % 7 <> 0),
l AS (SELECT l_orderkey AS slug, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT slug, changed_at, figures_at, lines, quantity, CASE WHEN slug % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS built FROM o JOIN l USING (slug)""")
def r12_row_cache(spark, folder):
    """Orders as documents, rows from their lines. Batches: all; a second listing, in which every third one changed; the
    same again; the removal of every seventh one. Rows say which batch built them."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")

    def build(changed):
        return lines.join(changed.select("slug"), lines.l_orderkey == F.col("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))

    first = orders.select(F.col("o_orderkey").alias("slug"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("changed_at"), F.col("o_custkey").alias("figures_at"), F.lit(False).alias("gone"))
    second = first.withColumn("changed_at", F.col("changed_at") + (F.col("slug") % 3 == 0).cast("long"))
    cache = RowCache(spark, f"{scratch_root(spark)}/row-cache-{uuid.uuid4().hex}", build, buckets=8)
    for number, changes in enumerate((first, second, second, second.where("slug % 7 = 0").withColumn("gone", F.lit(True)))):
        cache.apply(changes, number)
    return cache.read()
