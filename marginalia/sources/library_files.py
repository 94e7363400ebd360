"""A library kept as files: one folder per document, in folders by status; and single-document files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.workbench import frontmatter, progress, tag_values
from ..plans.library import STATUSES

FIGURE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "label", "kind", "caption_en", "caption_ko", "ref_in_section", "section_heading", "data_uri", "html", "source")])


def whole_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """path, text of each file, whole, and its time of change."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("changed_at"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """slug, status, path, text of every document, by status folder or straight in the root.

    Of two copies of a slug that in a status folder counts, in the order of statuses. Names that begin with a dot or an
    underscore are no documents. A status folder's name is the status; documents in the root have the one that they say.
    """
    files = whole_texts(spark, f"{root}/*/workbench.md").unionByName(whole_texts(spark, f"{root}/*/*/workbench.md")) if _nested(spark, root) else whole_texts(spark, f"{root}/*/workbench.md")
    parts = F.split("path", "/")
    rows = files.select("*", F.element_at(parts, -2).alias("slug"), F.element_at(parts, -3).alias("folder"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("folder")), F.lit(0)), F.lit(len(STATUSES) + 1))
    rows = rows.where(~F.col("slug").rlike("^[._]")).withColumn("_rank", rank)
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy("_rank", "path"))).where("_n = 1")
    said = F.element_at(frontmatter(F.col("text")), "status")
    return best.select("slug", F.when(F.col("folder").isin(*STATUSES), F.col("folder")).otherwise(F.coalesce(said, F.lit(STATUSES[0]))).alias("status"), "path", "text", "changed_at")


def _nested(spark: SparkSession, root: str) -> bool:
    """Whether any status folder holds documents; Hadoop's own listing, so any store will do."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/workbench.md")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def find(documents: DataFrame, slug: str) -> DataFrame:
    """One document by its slug."""
    return documents.where(F.col("slug") == slug)


def library_rows(documents: DataFrame) -> DataFrame:
    """slug, status, title_en, tags, sections_total, sections_done, changed_at of documents."""
    rows = documents.withColumns({"front": frontmatter(F.col("text")), "progress": progress(F.col("text"))})
    tags = F.coalesce(tag_values(F.element_at("front", "tags")), F.array().cast("array<string>"))
    return rows.select("slug", "status", F.coalesce(F.element_at("front", "title_en"), F.lit("")).alias("title_en"), tags.alias("tags"), F.col("progress.total").alias("sections_total"), F.col("progress.done").alias("sections_done"), "changed_at")


def figures(spark: SparkSession, pattern: str) -> DataFrame:
    """path and fields of each figure with an id; a file holds a list or an object with one. Broken files hold none; of
    equal ids the last one counts."""
    files = whole_texts(spark, pattern)
    listed = F.from_json("text", T.ArrayType(FIGURE))
    wrapped = F.from_json("text", T.StructType([T.StructField("figures", T.ArrayType(FIGURE))])).getField("figures")
    rows = files.select("path", F.posexplode(F.when(F.trim("text").startswith("["), listed).otherwise(wrapped)).alias("pos", "f")).where("f.id IS NOT NULL")
    last = rows.groupBy("path", F.col("f.id").alias("id")).agg(F.max_by(F.struct("pos", "f"), "pos").alias("r"))
    return last.select("path", F.col("r.pos").alias("pos"), "r.f.*")


def pdf_uploads(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, accepted of uploaded files: name and first bytes must both say PDF."""
    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select("path", "length", (F.endswith(F.lower("path"), F.lit(".pdf")) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).alias("accepted"))


def merged_groups(shipped: DataFrame, local: DataFrame) -> DataFrame:
    """Groups (name, members) of both tables: shipped members first, then local ones that are new."""
    right = local.select("name", F.col("members").alias("_more"))
    none = F.array().cast("array<string>")
    return shipped.join(right, "name", "full").select("name", F.array_union(F.coalesce("members", none), F.coalesce("_more", none)).alias("members"))


def group_files(groups: DataFrame, files: DataFrame, base: Column) -> DataFrame:
    """Files (name) of each group by their base names, sorted; groups without files are left out."""
    wanted = groups.select(F.col("name").alias("group"), F.explode("members").alias("base"))
    return files.select("name", base.alias("base")).join(wanted, "base").groupBy("group").agg(F.sort_array(F.collect_set("name")).alias("files"))
