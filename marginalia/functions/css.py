"""Blocks of style sheets by a scan over brackets that skips strings and comments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[{};]""", re.S)
#: A block that holds for a light or dark surrounding, and the root's rules in it.
SCHEME = re.compile(r"@media\s*\(prefers-color-scheme:\s*(light|dark)\s*\)")
ROOT = re.compile(r"(^|\})\s*:root\s*\{")

BLOCK = T.StructType([T.StructField("selector", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


def scan(css: str) -> list[tuple[str, int, int, int]]:
    """(selector, depth, start, stop) of every block in the order of their opening brackets. start is behind the opening
    bracket, stop before the closing one. Blocks that are never closed are left out, as are closing brackets too many."""
    done, opened, begin = [], [], 0
    for m in TOKEN.finditer(css):
        sign = m[0]
        if sign == "{":
            selector = re.sub(r"/\*.*?\*/", "", css[begin : m.start()], flags=re.S).strip()
            opened.append((m.end(), selector, len(opened)))
        elif sign == "}" and opened:
            start, selector, depth = opened.pop()
            done.append((start, selector, depth, m.start()))
        if sign in "{};":
            begin = m.end()
    return [(selector, depth, start, stop) for start, selector, depth, stop in sorted(done)]


@F.pandas_udf(T.ArrayType(BLOCK))
def blocks(css: pd.Series) -> pd.Series:
    """The blocks of each style sheet; null has none."""
    return css.map(lambda text: [dict(zip(("selector", "depth", "start", "stop"), b)) for b in scan(text or "")])


def retargeted(html: Column, attribute: str = "data-theme") -> Column:
    """Blocks for light or dark surroundings hold for an attribute of the page instead, with all that they say: their
    ``:root`` becomes ``html[attribute='scheme']``. From the first one on that is never closed, text stays as it is."""

    def one(text: str | None) -> str | None:
        out, at = [], 0
        for selector, _, start, stop in scan(text or ""):
            found = re.search(SCHEME.pattern + r"\Z", selector)
            head = (text or "").rfind("@media", 0, start)
            if not found or head < at:
                continue
            named = f"html[{attribute}='{found[1]}']"
            out += [text[at:head], "@media all {", ROOT.sub(lambda m: f"{m[1]}{named}{{", text[start:stop]), "}"]
            at = stop + 1
        return "".join([*out, text[at:]]) if out else text

    return F.pandas_udf(lambda texts: texts.map(one), T.StringType())(html)
