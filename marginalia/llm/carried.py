"""Rows that travel whole beside a decision about them, so that no column name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def carried(docs: DataFrame, **made: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and the columns ``made`` from them."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in made.items()])


def restored(rows: DataFrame) -> DataFrame:
    """The rows as they were."""
    return rows.select("row.*")


def whole_numbers(docs: DataFrame, id_col: str) -> None:
    """Raise a TypeError unless ids are whole numbers, where their order counts."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} must be a whole number, not {dict(docs.dtypes)[id_col]}")
