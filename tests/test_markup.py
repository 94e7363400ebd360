"""Formulas and emphasis."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.functions import markup


@pytest.mark.parametrize("text", ["", "plain", "a $x$ b $$y\nz$$ c", "$1 and no more", "$a$$b$", "5$ 6$ 7"])
def test_shields_come_off_whole(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(markup.shielded(F.col("t")).alias("s"))
    assert rows.select(markup.restored(F.col("s.text"), F.col("s.formulas")).alias("t")).first().t == text
    if "$x$" in text:
        assert "$" not in rows.first().s.text


def test_escapes(spark):
    rows = spark.createDataFrame([(r"$\\alpha\_1$ keeps \_ outside", r"\*\*<span>x</span>\*\* and \*y\*")], "a string, b string")
    got = rows.select(markup.formulas_unescaped(F.col("a")).alias("a"), markup.emphasis_at_spans(F.col("b")).alias("b")).first()
    assert got.a == r"$\alpha_1$ keeps \_ outside"
    assert got.b == r"**<span>x</span>** and \*y\*"
