"""Writers: drafts and partitioned libraries. Each writes aside first where something is replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.library import STATUSES


def write_library(documents: DataFrame, folder: str) -> None:
    """Documents partitioned by status; unknown statuses are placed with the first one, and the column ``said`` keeps
    what the document says."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(STATUSES[0])
    documents.select("*", F.col("status").alias("said")).withColumn("status", known).write.mode("overwrite").partitionBy("status").parquet(folder)


def moved(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents with new statuses (slug, new_status); unknown slugs change nothing."""
    return documents.join(changes, "slug", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def migrated(flat: DataFrame, placed: DataFrame, busy: DataFrame) -> DataFrame:
    """What a migration moves: flat documents that no placed one clashes with, and that no job works on."""
    return flat.join(placed.select("slug"), "slug", "left_anti").join(busy.select("slug"), "slug", "left_anti")


def replace_table(rows: DataFrame, folder: str, accepted=lambda new, old: True) -> bool:
    """Write aside, compare with what is there, and swap only if ``accepted`` says so. True if the table is new."""
    spark = rows.sparkSession
    aside = f"{folder}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, there = hadoop(folder), hadoop(aside)
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = spark.read.parquet(aside)
    if files.exists(here):
        if not accepted(new, spark.read.parquet(folder)):
            files.delete(there, True)
            return False
        files.delete(here, True)
    files.rename(there, here)
    return True


def complete_reports(reports: DataFrame) -> DataFrame:
    """slug, complete: every anchor that a report's navigation names must exist."""
    anchors = F.array_distinct(F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav\b.*?</nav>", 0), F.lit(r'href="#([^"]+)"'), F.lit(1)))
    ids = F.regexp_extract_all("html", F.lit(r'\bid="([^"]+)"'), F.lit(1))
    return reports.select("slug", (F.size(F.array_except(anchors, ids)) == 0).alias("complete"))


def embedded_json(value: str) -> Column:
    """A column as JSON that may stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def drafts(documents: DataFrame, folder: str) -> None:
    """Texts of documents as text files, one folder per slug."""
    documents.select("slug", F.col("text").alias("value")).write.mode("overwrite").partitionBy("slug").text(folder)
