"""The library relation and its satellites, bound to the order tables: one document per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import table

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
#: The statuses, in the order in which folders are searched.
STATUSES = ("to_read", "in_progress", "review_done", "exported", "archived")


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {ts})")


def from_epoch(seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {seconds}, {EPOCH})")


def lines_by_order(spark: SparkSession, folder: str, tags: bool, sections: bool) -> DataFrame:
    """l_orderkey with what its lines give, in one aggregation: counts of sections, and tags in line order (a type, or a
    type and brand below it)."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate")
    found = []
    if sections:
        found += [F.count(F.lit(1)).alias("sections_total"), F.count_if(F.col("l_linestatus") == "F").alias("sections_done"), F.max("l_shipdate").alias("last_ship")]
    if tags:
        part = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
        tag = F.when(F.col("l_linenumber") % 2 == 1, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", "p_brand"))
        lines = lines.join(part, lines["l_partkey"] == part["p_partkey"], "left")
        found.append(F.array_sort(F.collect_list(F.when(F.col("p_partkey").isNotNull(), F.struct("l_linenumber", "l_partkey", "l_suppkey", tag.alias("tag"))))).alias("all"))
    grouped = lines.groupBy("l_orderkey").agg(*found)
    return grouped.withColumn("tags", F.col("all.tag")).drop("all") if tags else grouped


def library(spark: SparkSession, folder: str, tags: bool = True, sections: bool = True) -> DataFrame:
    """One row per document. Unknown times are 0, unknown dates and titles are empty strings.

    Without ``tags`` or ``sections`` these columns (with exported_at, which comes from sections) are left out, and so is
    the work for them.
    """
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    if tags or sections:
        lines = lines_by_order(spark, folder, tags, sections)
        rows = rows.join(lines, rows["o_orderkey"] == lines["l_orderkey"], "left").drop("l_orderkey")
    k = F.col("o_orderkey")
    status = (
        F.when(k % 7 == 0, "archived")
        .when(F.col("o_orderstatus") == "F", "exported")
        .when((F.col("o_orderstatus") == "O") & (k % 2 == 0), "to_read")
        .when(F.col("o_orderstatus") == "O", "in_progress")
        .when(k % 11 == 0, "shelved")
        .otherwise("review_done")
    )
    created = epoch_seconds("o_orderdate")
    own = []
    if sections:
        own += [
            F.when((status == "exported") & (k % 9 != 0) & F.col("last_ship").isNotNull(), F.date_format("last_ship", "yyyy-MM-dd")).otherwise("").alias("exported_at"),
            F.coalesce("sections_total", F.lit(0)).cast("bigint").alias("sections_total"),
            F.coalesce("sections_done", F.lit(0)).cast("bigint").alias("sections_done"),
        ]
    if tags:
        own.append(F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return rows.select(
        k.alias("seq"),
        F.when(k % 3 == 0, F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad(k.cast("string"), F.greatest(F.lit(5), F.length(k.cast("string"))), F.lit("0")))).otherwise(F.concat(F.lit("doc-"), k.cast("string"))).alias("slug"),
        status.alias("status"),
        F.when(k % 10 == 0, "n/a").when(k % 17 == 0, "9").otherwise(F.substring("o_orderpriority", 1, 1)).alias("rating_text"),
        F.when(k % 13 == 0, F.lit(0).cast("bigint")).otherwise(created).alias("created_at"),
        (created + (k % 1000) * 86400).alias("updated_at"),
        F.when(k % 4 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("review_started"),
        *own,
        F.concat_ws(" ", F.lit("Order"), k.cast("string"), F.lit("of customer"), F.col("o_custkey").cast("string")).alias("title_en"),
        F.when(k % 3 == 0, F.concat(F.lit("주문 "), k.cast("string"))).otherwise("").alias("title_ko"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("category"),
        F.year("o_orderdate").alias("year"),
    )


def views(spark: SparkSession, folder: str) -> DataFrame:
    """key, last_viewed (epoch seconds): the last view event of a user stands for a document's."""
    events = table(spark, folder, "events").where("event_type = 'view'")
    return events.groupBy(F.col("user_id").alias("key")).agg(F.max(epoch_seconds("ts")).alias("last_viewed"))


LIBRARY_SQL = """
WITH sec AS (
  SELECT l_orderkey, count(*) AS sections_total, count_if(l_linestatus = 'F') AS sections_done, max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY 1
), tg AS (
  SELECT l_orderkey, list(CASE WHEN l_linenumber % 2 = 1 THEN p_type ELSE p_type || '/' || p_brand END
                          ORDER BY l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 1 THEN p_type ELSE p_type || '/' || p_brand END) AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
), base AS (
  SELECT o_orderkey AS seq, o_custkey, o_orderpriority, o_orderdate, last_ship, sections_total, sections_done, tags,
         CASE WHEN o_orderkey % 7 = 0 THEN 'archived' WHEN o_orderstatus = 'F' THEN 'exported'
              WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'to_read' WHEN o_orderstatus = 'O' THEN 'in_progress'
              WHEN o_orderkey % 11 = 0 THEN 'shelved' ELSE 'review_done' END AS status
  FROM orders LEFT JOIN sec ON o_orderkey = sec.l_orderkey LEFT JOIN tg ON o_orderkey = tg.l_orderkey
), library AS (
  SELECT seq,
         CASE WHEN seq % 3 = 0 THEN strftime(o_orderdate, '%y%m') || '.' || lpad(seq::VARCHAR, greatest(5, length(seq::VARCHAR))::INT, '0') ELSE 'doc-' || seq END AS slug,
         status,
         CASE WHEN seq % 10 = 0 THEN 'n/a' WHEN seq % 17 = 0 THEN '9' ELSE o_orderpriority[1] END AS rating_text,
         CASE WHEN seq % 13 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS created_at,
         epoch(o_orderdate)::BIGINT + (seq % 1000) * 86400 AS updated_at,
         CASE WHEN seq % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS review_started,
         CASE WHEN status = 'exported' AND seq % 9 <> 0 AND last_ship IS NOT NULL THEN strftime(last_ship, '%Y-%m-%d') ELSE '' END AS exported_at,
         coalesce(sections_total, 0) AS sections_total, coalesce(sections_done, 0) AS sections_done,
         coalesce(tags, []) AS tags, 'Order ' || seq || ' of customer ' || o_custkey AS title_en,
         CASE WHEN seq % 3 = 0 THEN '주문 ' || seq ELSE '' END AS title_ko, lower(o_orderpriority[3:]) AS category,
         year(o_orderdate) AS year
  FROM base
)"""
