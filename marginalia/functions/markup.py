"""Formulas and emphasis in marked-up text, as expressions over its parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FORMULA = r"\$\$.*?\$\$|\$[^$\n]*?\$"
EMPHASIS = r"[*_~]"


def parts(text: Column) -> Column:
    """Formulas and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s){FORMULA}|(?:(?!{FORMULA}).)+"), F.lit(0))


def is_formula(part: Column) -> Column:
    return F.startswith(part, F.lit("$")) & F.endswith(part, F.lit("$")) & (F.length(part) > 1)


def shielded(text: Column) -> Column:
    """text with numbered marks for formulas, and the formulas."""
    found = parts(text)
    marked = F.transform(found, lambda p, i: F.when(is_formula(p), F.concat(F.lit("\x02"), i.cast("string"), F.lit("\x03"))).otherwise(p))
    return F.struct(F.array_join(marked, "").alias("text"), F.transform(found, lambda p: F.when(is_formula(p), p)).alias("formulas"))


def restored(text: Column, formulas: Column) -> Column:
    """The formulas back in their places."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)\x02\\d+\x03|[^\x02\x03]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("\x02")), F.get(formulas, F.regexp_extract(p, r"(\d+)", 1).cast("int"))).otherwise(p)), "")


def formulas_unescaped(text: Column) -> Column:
    """Inside formulas doubled backslashes are halved, and emphasis isn't escaped."""
    fixed = lambda p: F.regexp_replace(F.replace(p, F.lit("\\\\"), F.lit("\\")), rf"\\({EMPHASIS})", "$1")
    return F.array_join(F.transform(parts(text), lambda p: F.when(is_formula(p), fixed(p)).otherwise(p)), "")


def emphasis_at_spans(text: Column) -> Column:
    """Emphasis right before or behind a span isn't escaped."""
    text = F.regexp_replace(text, rf"\\({EMPHASIS})(?=(?:\\?{EMPHASIS}){{0,3}}<span)", "$1")
    for _ in range(3):  # a run is three characters at most
        text = F.regexp_replace(text, rf"(</span>{EMPHASIS}{{0,2}})\\({EMPHASIS})", "$1$2")
    return text
