"""Exact deduplication with a split of heavy hitters; DataFrame functions only.

Misra-Gries counters (``freqItems``, which implements that algorithm as a mergeable aggregate) name every digest that
makes up more than ``support`` of the rows, and perhaps others: at most 1/support candidates. Their exact groups are
computed next, which verifies them; these winners, again at most 1/support rows, are broadcast and answer all rows of
heavy groups on the map side. What remains has no group above ``support`` of the rows and is shuffled by digest,
aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .carried import carried, restored

#: A digest in more than this share of the rows is heavy; 1 / SUPPORT bounds what is broadcast.
SUPPORT = 1 / 500
#: ``[\x20\x09-\x0D]``
BLANKS = " \t\n\x0b\f\r"


def normalized(text: Column) -> Column:
    """A text without its ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of ``docs``: row, doc_id, digest (sha-256, binary), size in code points."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalized(F.col(text_col)), 256)).alias("digest"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("size"),
    )


def _group(rows: DataFrame) -> DataFrame:
    """The row that stays of each digest: the longest text, then the smallest doc_id (null last), then the first row."""
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def _resolved(docs: DataFrame, id_col: str, text_col: str, support: float) -> DataFrame:
    """The digest rows with their group's keep_id, keep_row and group_size."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    candidates = rows.select(F.hex("digest").alias("digest")).freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    heavy = materialize(_group(rows.join(F.broadcast(candidates), "digest", "left_semi")), "heavy")
    winners = F.broadcast(heavy)
    hot = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    cold = rest.join(_group(rest), "digest")
    return hot.unionByName(cold)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``, dropped ones too.

    Texts are equal when identical without ASCII white space; null counts as empty, so null, empty and blank texts are
    one group. Very long texts are digested whole. Of rows that repeat a doc_id and a text, exactly one is kept. Extra columns are ignored; an empty table
    gives an empty result.
    """
    return _resolved(docs, id_col, text_col, support).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were, whatever their names.

    Rows go by what they hold (doc_id, digest, size), never by a row number of the scan, which another run of the scan
    may deal out differently. Rows that agree in all three are one row afterwards, the one whose text sorts first. Null, empty and blank texts are one
    group; an empty table stays empty.
    """
    found = materialize(_resolved(docs, id_col, text_col, support).select(F.col("doc_id").alias("id"), "digest", "size", (F.col("row") == F.col("keep_row")).alias("kept")), "groups")
    dropped, kept = found.where("NOT kept").drop("kept"), found.where("kept").drop("kept")
    rows = carried(docs, id=F.col(id_col), digest=F.unhex(F.sha2(normalized(F.col(text_col)), 256)), size=F.coalesce(F.length(text_col), F.lit(0)))

    def same(one: DataFrame, other: DataFrame) -> Column:
        return one["id"].eqNullSafe(other["id"]) & (one["digest"] == other["digest"]) & (one["size"] == other["size"])

    stay = rows.join(dropped, same(rows, dropped), "left_anti")
    repeated = kept.join(dropped, same(kept, dropped), "left_semi")
    if not repeated.isEmpty():
        first = F.min_by("row", F.struct(f"row.`{text_col}`", F.to_json("row")))  # of texts that differ in white space alone
        stay = stay.unionByName(rows.join(repeated, same(rows, repeated), "left_semi").groupBy("digest").agg(first.alias("row")).select("row", F.lit(None).alias("id"), "digest", F.lit(None).alias("size")))
    return restored(stay)
