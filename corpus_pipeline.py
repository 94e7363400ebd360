"""A training-corpus pipeline: each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import exact_dedup, language_id, packing, simhash_dedup, toxicity
from marginalia.llm.carried import carried, restored
from marginalia.session import materialize, release, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Collection[str] | None = None, least: float = 0.55) -> DataFrame:
    """Documents that the classifier finds to be in one of ``languages`` (None: any that can be learned), with a score of
    ``least`` or more; a lower one means that no language stands out.

    Null, empty and letterless texts go. Where no label can be learned, every text with a letter stays. Rows that repeat
    stay or go together, whole texts are scored, and the columns are those of ``docs``, whatever their names.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(language_id.has_letter(F.col("text")))
    rows = carried(docs, found=language_id.predicted(F.col("text"), model)).where((F.col("found.lang") != language_id.NONE) & (F.col("found.score") >= least))
    return restored(rows if languages is None else rows.where(F.col("found.lang").isin(*languages)))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.

    Null and empty texts have the score of no evidence and stay unless labels of one kind alone say otherwise. Rows that
    repeat stay or go together, whole texts are scored, and the columns are those of ``docs``, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return restored(carried(docs, score=toxicity.scored(F.col("text"), model)).where(F.col("score") < toxicity.THRESHOLD))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space: the longest text, then the smallest doc_id.

    Null counts as empty, so null, empty and blank texts are one group. Columns stay, whatever their names.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Texts without words are near nothing but their equals. Columns stay, whatever their names.
    """
    return simhash_dedup.deduplicate(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Null and empty texts are the end id alone; repeated rows are packed as often
    as they occur."""
    return packing.pack(docs)


STAGES = [
    ("language identification", keep_identified),
    ("toxicity", keep_civil),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack_windows),
]

#: SQL can express neither the classifiers nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if number:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
