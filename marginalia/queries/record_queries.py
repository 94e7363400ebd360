"""Merges, versions, logs and quality flags."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import records as ops
from ..operators.library import numbered
from ..operators.records import revised, stale
from ..plans.library import epoch_seconds
from ..session import table
from .registry import query

MESSAGE = "CASE WHEN event_id % 50 = 0 THEN 'HTTP 429: quota' WHEN event_id % 77 = 0 THEN 'OAuth token: not logged in' WHEN event_id % 90 = 0 THEN 'bash: command not found' WHEN event_id % 41 = 0 THEN 'exec: No such file or directory: /usr/bin/claude' WHEN event_id % 23 = 0 THEN 'open: No such file or directory: paper.json' ELSE event_type || ' ' || props END"
JOBS = f"WITH e AS (SELECT user_id AS key, event_id AS seq, event_type, value, props, {MESSAGE} AS message FROM events), b AS (SELECT *, CASE WHEN regexp_matches(message, '(?i)does not support this model') THEN 'cli_outdated' WHEN regexp_matches(message, '(?i)authenticat|oauth|not logged in|invalid api key|401') THEN 'auth' WHEN regexp_matches(message, '(?i)rate.?limit|usage limit|429|quota') THEN 'rate_limit' WHEN regexp_matches(message, '(?i)command not found|No such file or directory.*claude|ENOENT') THEN 'cli_missing' END AS blocker FROM e)"


def job_events(spark, folder):
    """key, seq, event_type, value, props, message, blocker: users stand for runs."""
    e = F.col("event_id")
    message = F.when(e % 50 == 0, "HTTP 429: quota").when(e % 77 == 0, "OAuth token: not logged in").when(e % 90 == 0, "bash: command not found").when(e % 41 == 0, "exec: No such file or directory: /usr/bin/claude").when(e % 23 == 0, "open: No such file or directory: paper.json").otherwise(F.concat_ws(" ", "event_type", "props"))
    rows = table(spark, folder, "events").select(F.col("user_id").alias("key"), e.alias("seq"), "event_type", "value", "props", message.alias("message"))
    return rows.withColumn("blocker", ops.blocker(F.col("message")))


@query(JOBS + " SELECT blocker, count(*) AS n FROM b GROUP BY 1")
def g12_blocker_kinds(spark, folder):
    return job_events(spark, folder).groupBy("blocker").agg(F.count(F.lit(1)).alias("n"))


@query(JOBS + " SELECT key, arg_min(blocker, seq) AS blocker, min(seq) AS at FROM b WHERE blocker IS NOT NULL GROUP BY 1")
def r07_first_blocker(spark, folder):
    return ops.first_blocker(job_events(spark, folder), "key", "seq")


@query(JOBS + ", s AS (SELECT key, seq, coalesce(bool_or(blocker IS NOT NULL) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM b) SELECT key, seq FROM s WHERE NOT blocked")
def r08_stop_on_blocker(spark, folder):
    return ops.before_blocker(job_events(spark, folder), "key", "seq").select("key", "seq")


@query(JOBS + " SELECT key, event_type AS target, arg_max(seq, seq) AS session FROM b WHERE event_type IN ('signup', 'view') GROUP BY 1, 2")
def r10_latest_session(spark, folder):
    """The latest session of each run and target."""
    rows = job_events(spark, folder).where(F.col("event_type").isin("signup", "view"))
    return rows.groupBy("key", F.col("event_type").alias("target")).agg(F.max("seq").alias("session"))


@query(JOBS + " SELECT key, seq, TRY_CAST(json_extract_string(CASE WHEN json_valid(p) THEN p END, '$.k') AS INTEGER) AS k FROM (SELECT key, seq, CASE WHEN seq % 9 = 0 THEN '{broken' ELSE props END AS p FROM b)")
def g11_tolerant_json(spark, folder):
    """A number out of an event's payload; null where the payload is no JSON."""
    p = F.when(F.col("seq") % 9 == 0, "{broken").otherwise(F.col("props"))
    return job_events(spark, folder).select("key", "seq", F.from_json(p, "k int", {"mode": "PERMISSIVE"}).getField("k").alias("k"))


@query(JOBS + " SELECT seq, CASE WHEN name IN ('Read', 'Edit', 'Write') THEN name || ' ' || string_split(path, '/')[-1] WHEN name = 'Bash' THEN 'Bash: ' || left(message, 80) ELSE name END AS summary FROM (SELECT seq, message, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'error' THEN 'Bash' ELSE event_type END AS name, 'papers/' || key || '/w.md' AS path FROM b)")
def g13_tool_summaries(spark, folder):
    name = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "error", "Bash").otherwise(F.col("event_type"))
    return job_events(spark, folder).select("seq", ops.tool_summary(name, F.concat_ws("/", F.lit("papers"), F.col("key").cast("string"), F.lit("w.md")), F.col("message")).alias("summary"))


@query(JOBS + " SELECT key, count_if(event_type = 'error') AS failed, count_if(event_type = 'purchase') AS succeeded FROM b GROUP BY 1")
def a34_job_outcomes(spark, folder):
    return job_events(spark, folder).groupBy("key").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("succeeded"))


@query(JOBS + ", l AS (SELECT key, arg_max(event_type, seq) AS status, count_if(event_type = 'error') AS failed FROM b GROUP BY 1) SELECT key, status, failed FROM l WHERE status IN ('click', 'error') OR failed > 3")
def p23_active_jobs(spark, folder):
    """Runs that go on, have ended in an error, or have failures."""
    last = job_events(spark, folder).groupBy("key").agg(F.max_by("event_type", "seq").alias("status"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return last.where(F.col("status").isin("click", "error") | (F.col("failed") > 3))


@query(JOBS + ", t AS (SELECT key, seq, message, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM b) SELECT key, string_agg(message, chr(10) ORDER BY seq) AS tail FROM t WHERE n <= 12 GROUP BY 1")
def o09_log_tail(spark, folder):
    return ops.log_tail(job_events(spark, folder), "key", "seq", "message", 12).select("key", F.array_join("tail", "\n").alias("tail"))


@query(JOBS + " SELECT key, seq, event_type FROM b WHERE event_type IN ('click', 'view', 'error')")
def r04_stream_shape(spark, folder):
    """Only known kinds pass."""
    return job_events(spark, folder).where(F.col("event_type").isin("click", "view", "error")).select("key", "seq", "event_type")


@query("SELECT user_id AS slug, max(event_id) AS rev, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def s18_newest_revision(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("slug"), F.col("event_id").alias("rev"), epoch_seconds("ts").alias("uploaded_at"), "value")
    return ops.newest(rows, "slug", "rev", "uploaded_at").select("slug", "rev", "value")


@query("WITH r AS (SELECT user_id AS slug, event_id AS rev, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT slug, rev FROM r WHERE n > 1")
def s19_pruned_revisions(spark, folder):
    """Revisions that a new one makes redundant."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("slug"), F.col("event_id").alias("rev"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("rev")))).where("n > 1").select("slug", "rev")


@query("WITH r AS (SELECT user_id AS slug, strftime(ts, 'workbench-%Y%m%d%H%M%S-') || lpad(event_id::VARCHAR, 9, '0') AS stamp FROM events) SELECT slug, stamp FROM r QUALIFY row_number() OVER (PARTITION BY slug ORDER BY stamp DESC) <= 5")
def w05_history_retention(spark, folder):
    stamp = F.concat(F.lit("workbench-"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    return ops.retained(table(spark, folder, "events").select(F.col("user_id").alias("slug"), stamp.alias("stamp")), "slug", "stamp")


@query("SELECT user_id, event_type, event_id, coalesce(props <> lag(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id), true) AS changed FROM events")
def w10_changed_versions(spark, folder):
    before = F.lag("props").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table(spark, folder, "events").select("user_id", "event_type", "event_id", F.coalesce(F.col("props") != before, F.lit(True)).alias("changed"))


@query("WITH p AS (SELECT event_id, props FROM events WHERE props IS NOT NULL) SELECT event_id, props FROM p QUALIFY row_number() OVER (PARTITION BY props ORDER BY event_id) = 1")
def w08_first_occurrence(spark, folder):
    return table(spark, folder, "events").where("props IS NOT NULL").groupBy("props").agg(F.min("event_id").alias("event_id"))


OLD = "SELECT p_partkey AS id, p_name AS label, p_type AS caption, p_brand AS source FROM part WHERE p_partkey % 3 <> 0"
NEW = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '' ELSE upper(p_name) END AS label, CASE WHEN p_size % 5 = 0 THEN NULL ELSE lower(p_type) END AS caption, '' AS source FROM part WHERE p_partkey % 2 = 0"


def _parts(spark, folder):
    part = table(spark, folder, "part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("caption"), F.col("p_brand").alias("source"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.upper("p_name")).alias("label"), F.when(F.col("p_size") % 5 != 0, F.lower("p_type")).alias("caption"), F.lit("").alias("source"))
    return old, new


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.label ELSE o.label END AS label, CASE WHEN n.id IS NOT NULL THEN n.caption ELSE o.caption END AS caption, o.id IS NULL AS appended FROM o FULL JOIN n ON n.id = o.id")
def g01_section_upsert(spark, folder):
    old, new = (x.withColumn("at", F.col("id")) for x in _parts(spark, folder))
    return ops.upsert(old, new, "id", "at").select("id", "label", "caption", F.col("place.appended").alias("appended"))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT id, 'old' AS origin FROM o UNION ALL SELECT id, 'new' FROM n")
def g02_list_append(spark, folder):
    old, new = _parts(spark, folder)
    return old.select("id", F.lit("old").alias("origin")).unionByName(new.select("id", F.lit("new").alias("origin")))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.label, ''), o.label) AS label, coalesce(nullif(n.caption, ''), o.caption) AS caption, coalesce(nullif(n.source, ''), o.source) AS source FROM o FULL JOIN n ON n.id = o.id")
def g03_figure_merge(spark, folder):
    old, new = _parts(spark, folder)
    return ops.merge_fields(old, new, "id", ["label", "caption", "source"])


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT o.id AS id, CASE WHEN n.id IS NOT NULL THEN n.label ELSE o.label END AS label, CASE WHEN n.id IS NOT NULL THEN n.source ELSE o.source END AS source FROM o LEFT JOIN n ON n.id = o.id")
def g04_metadata_patch(spark, folder):
    """A patch's keys replace old ones, empty values too; keys that it lacks stay."""
    old, new = _parts(spark, folder)
    patch = new.select(F.col("id").alias("_id"), F.create_map(F.lit("label"), "label", F.lit("source"), "source").alias("patch"))
    merged = lambda c: F.when(F.map_contains_key("patch", F.lit(c)), F.element_at("patch", c)).otherwise(F.col(c)).alias(c)
    return old.join(patch, old["id"] == F.col("_id"), "left").select("id", merged("label"), merged("source"))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT id, 'html' AS origin FROM o UNION ALL SELECT id, 'pdf' FROM n WHERE id NOT IN (SELECT id FROM o)")
def j08_figures_without_twin(spark, folder):
    """Figures of one source, and those of another one that it lacks."""
    old, new = _parts(spark, folder)
    return old.select("id", F.lit("html").alias("origin")).unionByName(new.join(old, "id", "left_anti").select("id", F.lit("pdf").alias("origin")))


@query("WITH k AS (SELECT p_partkey AS id, p_size % 3 = 0 AS is_table, p_size AS number FROM part) SELECT row_number() OVER (ORDER BY is_table, number, id) AS rank, id FROM k")
def o04_figure_order(spark, folder):
    """Figures before tables, then by number."""
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3 == 0).alias("is_table"), F.col("p_size").alias("number"))
    return numbered(rows, F.asc("is_table"), F.asc("number"), F.asc("id")).select("rank", "id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders")
def o02_base_order(spark, folder):
    return numbered(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "rank")


@query("WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS src, unnest(range(len(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)))) AS pos FROM pages) SELECT page_id, src, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM a WHERE NOT regexp_matches(src, ',') QUALIFY n <= 30")
def o08_capped_links(spark, folder):
    """At most 30 of a page's targets that pass a filter, counted after it."""
    rows = table(spark, folder, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("pos", "src")).where(~F.contains("src", F.lit(",")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("n <= 30").select("page_id", "src", "n")


@query("WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS src, unnest(range(len(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)))) AS pos FROM pages) SELECT page_id, 'fig' || row_number() OVER (PARTITION BY page_id ORDER BY pos) AS id, src FROM a WHERE length(src) > 4")
def w06_contiguous_ids(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("pos", "src")).where(F.length("src") > 4)
    return rows.select("page_id", F.concat(F.lit("fig"), F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("string")).alias("id"), "src")


@query("SELECT d.doc_id AS doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def j20_presence_check(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("_id")).distinct()
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.join(labels, docs["doc_id"] == labels["_id"], "left").select("doc_id", F.col("_id").isNotNull().alias("labelled"))


@query("SELECT d.lang AS lang, count(*) AS documents, avg((quality IS NULL)::INT)::DOUBLE AS missing_share, avg((quality IS NULL)::INT) > 0.3 AS flagged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def a22_missing_ratio(spark, folder):
    """Share of rows without an entry in each group, and whether it is above the limit."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    share = F.avg(F.col("quality").isNull().cast("int"))
    return docs.join(table(spark, folder, "labels"), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), share.alias("missing_share"), (share > 0.3).alias("flagged"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, count_if(role = 'assistant') AS answers FROM conversations GROUP BY 1")
def a23_text_sizes(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations")
def j23_question_above(spark, folder):
    """Each turn with the nearest question at or above it."""
    above = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, folder, "conversations").select("conv_id", "turn", above.alias("question"))


@query("SELECT q.conv_id AS conv_id, q.turn AS turn, md5(q.text) AS question, md5(a.text) AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def t09_question_answer_pairs(spark, folder):
    rows = table(spark, folder, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    paired = rows.select("conv_id", "turn", "role", "text", F.lead("role").over(after).alias("next_role"), F.lead("turn").over(after).alias("next_turn"), F.lead("text").over(after).alias("next_text"))
    return paired.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("question"), F.md5(F.col("next_text").cast("binary")).alias("answer"))


@query("""SELECT slug, seq, base, forced OR base = current AS accepted FROM (
SELECT user_id AS slug, event_id AS seq, event_id % 12 = 0 AS forced, current, CASE WHEN event_id % 3 = 0 THEN current - 1 ELSE current END AS base FROM (
SELECT *, coalesce(count_if(event_id % 3 <> 0 OR event_id % 12 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS current FROM events))""")
def r13_revision_check(spark, folder):
    """A write is rejected when it is based on another revision than the slug's current one, unless forced; each accepted
    write makes a new revision. Here every third write is one revision late, and some of these are forced."""
    e, earlier = F.col("event_id"), Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    writes = table(spark, folder, "events").select(F.col("user_id").alias("slug"), e.alias("seq"), (e % 12 == 0).alias("forced"), F.count_if((e % 3 != 0) | (e % 12 == 0)).over(earlier).alias("sent_after"))
    writes = writes.withColumn("base", F.when(F.col("seq") % 3 == 0, F.col("sent_after") - 1).otherwise(F.col("sent_after")))
    return revised(writes.select("slug", "seq", "base", "forced")).select("slug", "seq", "base", "accepted")


@query("""WITH report AS (SELECT o_custkey AS slug, max(o_orderdate) AS changed_at FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
source AS (SELECT o_custkey AS slug, max(o_orderdate) AS changed_at FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT r.slug, coalesce(s.changed_at > r.changed_at, false) AS stale FROM report r LEFT JOIN source s USING (slug)""")
def p26_staleness(spark, folder):
    """A report is stale when its source has changed since."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderdate").alias("changed_at"), (F.col("o_orderkey") % 3 == 0).alias("report"))
    listing = lambda rows: rows.groupBy("slug").agg(F.max("changed_at").alias("changed_at"))
    return stale(listing(orders.where("report")), listing(orders.where("NOT report")))
