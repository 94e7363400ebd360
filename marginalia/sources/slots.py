"""A slot of revisions: pushed documents are appended, the newest one counts, older ones are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.records import newest


def payload(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """slug, body: text, report and figures of documents as JSON; of figures only what a reader shows."""
    shown = figures.where("data_uri <> '' OR html <> ''").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "data_uri", "html"))).alias("all"))
    rows = documents.join(shown, "slug", "left")
    parts = F.transform(F.coalesce("all", F.array()), lambda f: F.struct(f["id"].alias("id"), f["data_uri"].alias("data_uri"), f["html"].alias("html")))
    return rows.select("slug", F.to_json(F.struct("text", "report", parts.alias("figures"))).alias("body"))


def pushed(slot: DataFrame, incoming: DataFrame) -> DataFrame:
    """The slot's revisions (slug, rev, uploaded_at, body) and a new one for each incoming body (slug, uploaded_at, body)
    that isn't based on an outdated revision (base), unless forced."""
    current = slot.groupBy("slug").agg(F.max("rev").alias("_rev"))
    rows = incoming.join(current, "slug", "left").withColumn("_rev", F.coalesce("_rev", F.lit(0)))
    new = rows.where((F.col("base") == F.col("_rev")) | F.col("forced")).select("slug", (F.col("_rev") + 1).alias("rev"), "uploaded_at", "body")
    return slot.select("slug", "rev", "uploaded_at", "body").unionByName(new)


def pruned(slot: DataFrame) -> DataFrame:
    """The newest revision of each slug: by number, then by time."""
    return newest(slot, "slug", "rev", "uploaded_at")


def pulled(local: DataFrame, slot: DataFrame) -> DataFrame:
    """slug, text, backup, changed: local texts after a pull; the old text is the backup where it changed. An empty slot
    changes nothing."""
    remote = pruned(slot).select("slug", F.get_json_object("body", "$.text").alias("_text"))
    rows = local.join(remote, "slug", "left")
    changed = F.col("_text").isNotNull() & (F.col("_text") != F.col("text"))
    return rows.select("slug", F.when(changed, F.col("_text")).otherwise(F.col("text")).alias("text"), F.when(changed, F.col("text")).alias("backup"), changed.alias("changed"))
