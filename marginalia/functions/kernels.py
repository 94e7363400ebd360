"""The few per-row functions that no expression covers, as Arrow-batched UDFs over small texts."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


#: Pairs of words that are compared outright; longer texts are first cut at words that both have once.
CELLS = 1 << 30


def _prefix_lengths(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of ``before`` and each prefix of ``after``; one row is kept."""
    row = np.zeros(len(after) + 1, np.int32)
    for word in before:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (after == word)))
    return row


def _anchors(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int]]:
    """A longest chain, ascending in both, of words that occur once in each: where long texts are cut."""
    (words, at, n), (others, place, m) = (np.unique(x, return_index=True, return_counts=True) for x in (before, after))
    shared, x, y = np.intersect1d(words[n == 1], others[m == 1], assume_unique=True, return_indices=True)
    pairs = sorted(zip(at[n == 1][x].tolist(), place[m == 1][y].tolist()))
    ends: list[int] = []  # the smallest last place of a chain of each length
    last, link = [], [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        link[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [j], [i]
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(pairs[i])
        i = link[i]
    return chain[::-1]


def unchanged(before: list[str], after: list[str]) -> list[bool]:
    """Of each word of ``after``, whether it belongs to a longest common subsequence with ``before``.

    Equal ends are taken first; the rest is halved at the best place, so memory is linear in the texts. Only where
    both are so long that their product exceeds CELLS, they are cut at common words of their own first, and the result
    is a common subsequence that holds these.
    """
    known: dict[str, int] = {}
    old, new = (np.fromiter((known.setdefault(w, len(known)) for w in x), np.int64, len(x)) for x in (before, after))
    same = np.zeros(len(new), bool)
    open_parts = [(0, len(old), 0, len(new))]
    while open_parts:
        a, b, c, d = open_parts.pop()
        short = min(b - a, d - c)
        differ = np.flatnonzero(old[a : a + short] != new[c : c + short])
        head = int(differ[0]) if len(differ) else short
        same[c : c + head] = True
        a, c, short = a + head, c + head, short - head
        differ = np.flatnonzero(old[b - short : b][::-1] != new[d - short : d][::-1]) if short else np.zeros(0, int)
        tail = int(differ[0]) if len(differ) else short
        same[d - tail : d] = True
        b, d = b - tail, d - tail
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and (cuts := _anchors(old[a:b], new[c:d])):
            same[[c + y for _, y in cuts]] = True
            edges = [(-1, -1), *cuts, (b - a, d - c)]
            open_parts += [(a + p + 1, a + q, c + r + 1, c + t) for (p, r), (q, t) in zip(edges, edges[1:])]
        elif b - a == 1:
            found = np.flatnonzero(new[c:d] == old[a])
            same[c + found[:1]] = True
        else:
            middle = (a + b) // 2
            place = int((_prefix_lengths(old[a:middle], new[c:d]) + _prefix_lengths(old[middle:b][::-1], new[c:d][::-1])[::-1]).argmax())
            open_parts += [(a, middle, c, c + place), (middle, b, c + place, d)]
    return same.tolist()


def marked(before: str, after: str, opening: str = '<mark class="wb-edit">', closing: str = "</mark>") -> str:
    """``after`` with marks around words that changed; none around markup or over line ends."""
    plain = lambda t: re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", t)
    tokens = re.findall(r"\s+|\S+", after)
    same = iter(unchanged([plain(t) for t in before.split()], [plain(t) for t in tokens if not t.isspace()]))
    kinds = "".join(("n" if "\n" in t else "b") if t.isspace() else "k" if next(same) or re.search(r'[<>"]', t) or not any(map(str.isalnum, t)) else "c" for t in tokens)
    out, at = [], 0
    for run in re.finditer("c[cb]*", kinds):  # from a changed word, over blanks, up to the next other word or line end
        out += [*tokens[at : run.start()], opening, *tokens[run.start() : run.end()], closing]
        at = run.end()
    return "".join(out + tokens[at:])


def edit_marks(before: Column, after: Column) -> Column:
    """Marks of what changed; a text without an earlier version has none."""

    @F.pandas_udf("string")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([marked(a, b) for a, b in zip(old, new)])

    return F.when(before.isNotNull() & (before != after), run(F.coalesce(before, F.lit("")), after)).otherwise(after)


def merged_color_runs(text: Column) -> Column:
    """Neighbouring spans of one colour as one span, until nothing changes."""
    pair = re.compile(r'<span style="color: ?([^";]+);?">((?:(?!</?span).)*)</span>(\s*)<span style="color: ?\1;?">((?:(?!</?span).)*)</span>', re.S)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def merge(t: str) -> str:
            while (new := pair.sub(r'<span style="color: \1">\2\3\4</span>', t)) != t:
                t = new
            return t

        return texts.map(merge)

    return F.when(F.contains(text, F.lit("</span>")), run(text)).otherwise(text)


def luminance(color: Column) -> Column:
    """Relative luminance of a colour #rrggbb."""
    channel = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(channel(2)) + 0.7152 * linear(channel(4)) + 0.0722 * linear(channel(6))


def contrast(one: Column, other: Column) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    a, b = luminance(one), luminance(other)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
