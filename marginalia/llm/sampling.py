"""Deterministic, bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def chance(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))


#: So many labels are broadcast with their counts; with more of them, the sampled ids are.
MOST_LABELS = 100_000


def sampled(labelled: DataFrame, id_col: str, label: str, per_label: int, rows: int) -> DataFrame:
    """The rows of ``labelled`` that a fit learns from: about ``per_label`` of each label that isn't null, whichever
    labels there are, and about ``rows`` in all at most; with so many labels that this leaves none, a share of ``rows``.

    A row is in by its id alone, so repeated ids are in together. Rows stay where they are: what is broadcast to them is
    the count of each label, MOST_LABELS at most, or else the ids and labels that are in, some ``rows`` of them.
    """
    known = labelled.where(F.col(label).isNotNull())
    counts = known.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_count"))
    labels = counts.count()
    chosen = chance(F.col(id_col)) < F.lit(min(per_label, rows / max(1, labels))) / F.col("_count")
    if labels <= MOST_LABELS:
        return known.join(F.broadcast(counts), F.col(label) == F.col("_label")).where(chosen).drop("_label", "_count")
    narrow = known.select(id_col, label).join(counts, F.col(label) == F.col("_label")).where(chosen)
    picked = narrow.select(F.col(id_col).alias("_id"), "_label").distinct()
    return known.join(F.broadcast(picked), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(label) == F.col("_label")), "left_semi")


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, the same ones in every run: a bound for samples whose ids repeat."""
    return rows.orderBy(*order).limit(most)
