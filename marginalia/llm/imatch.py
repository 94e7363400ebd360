"""I-Match document fingerprints; DataFrame functions only.

The lexicon is the set of terms whose document frequency, counted over distinct texts, lies in a band: terms in LOWEST
of these or more, and in HIGHEST or fewer; so a large group of copies counts once and keeps its terms. A document's
distinct lexicon terms are sorted, and several randomised subsets of the lexicon are hashed, each to one code. Subsets
come in scales, from one in 32 lexicon terms to one in 2048, so that documents of a few lines and of a few hundred pages
both meet some subsets of which they hold a term or two: such a code survives an edit unless the edit touches these terms.
Subsets that keep most terms, as for matching copies with a few changed words, would all change with a changed quarter.

A band that starts at a share of the texts holds at most (distinct terms of an average text) / LOWEST terms,
whatever the corpus; it becomes a bitmap of fixed size (1 MB), the only value of a small table that the plan reads once
as a scalar: as a constant, every text of the plan would hold it several times over. Nothing is joined on terms. A term is in it by PROBES bits of its hash, so a term outside the band counts as inside with a probability of
(1 - exp(-PROBES * lexicon / BITMAP)) ** PROBES: 1e-6 for 30 000 lexicon terms, 2e-3 for 400 000. Equal texts have equal
fingerprints all the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .carried import whole_numbers

LOWEST, HIGHEST = 0.0005, 0.2
#: Bits of the lexicon's bitmap, kept as 64-bit words.
BITMAP = 1 << 23
#: Bits of a term's hash by which it is in the lexicon: from these places of it.
PROBES = (0, 20, 40)
#: (one of so many lexicon terms, subsets of that scale).
SCALES = ((32, 16), (256, 16), (2048, 16))
#: Codes below which a scale's likeness counts as weak evidence.
SURE = 4
HEX = 6
#: Characters of a range of documents that a window sorts together, and the most ranges.
RANGE_CHARS, RANGES = 8_000_000, 100_000


def terms(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _place(hashed: Column) -> list[Column]:
    """The word of the bitmap and the bit in it that stand for a hash."""
    place = F.pmod(hashed, F.lit(BITMAP))
    return [F.floor(place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")]


def _probed(hashed: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(hashed, p) for p in PROBES])


def _known(bitmap: Column, hashed: Column) -> Column:
    found = _has(bitmap, hashed)
    for p in PROBES[1:]:
        found = found & _has(bitmap, F.shiftrightunsigned(hashed, p))
    return found


def _bitmap(masks: DataFrame, label: str) -> Column:
    """word, mask as an array of BITMAP / 64 words, 0 where there is none. These rows don't grow with the corpus."""
    words = masks.sparkSession.range(BITMAP // 64).join(masks, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return materialize(words.agg(ordered["mask"].alias("bitmap")), label).scalar()


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is named once in the plan and not copied."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _has(bitmap: Column, hashed: Column) -> Column:
    place = F.pmod(hashed, F.lit(BITMAP))
    return F.getbit(F.get(bitmap, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1


def distinct_texts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """text: one row of each distinct text; and their number.

    Digests are counted first, and a bitmap of fixed size marks those that occur again. A row without a mark is the
    only one of its text and stays where it is; the others, among them a few that share a mark by chance, are grouped.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    counted = rows.groupBy("digest").count().select(*_place(F.xxhash64("digest")), "count")
    stored = materialize(counted.groupBy("word").agg(F.bit_or(F.when(F.col("count") > 1, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("mask"), F.count(F.lit(1)).alias("texts")), "digests")  # BITMAP / 64 rows at most
    total = stored.agg(F.sum("texts").alias("texts")).first()["texts"] or 0
    marked = _has(_bitmap(stored.select("word", "mask"), "repeats"), F.xxhash64("digest"))
    again = rows.where(marked).groupBy("digest").agg(F.first("text").alias("text"))
    return rows.where(~marked).select("text").unionByName(again.select("text")), total


def lexicon(docs: DataFrame, text_col: str = "text", lowest: float = LOWEST, highest: float = HIGHEST) -> Column:
    """The lexicon's bitmap as a scalar: an array of BITMAP / 64 words, whatever the corpus. Term hashes are counted before the shuffle.

    Each distinct text counts once. In corpora of under 1 / lowest texts a term needs two texts.
    """
    texts, total = distinct_texts(docs, text_col)
    seen = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy(F.xxhash64("term").alias("hash")).count()
    chosen = seen.where((F.col("count") >= max(2, math.ceil(lowest * total))) & (F.col("count") <= max(2, math.floor(highest * total))))
    masks = chosen.select(F.explode(_probed(F.col("hash"))).alias("probe")).select(*_place(F.col("probe"))).groupBy("word").agg(F.bit_or("bit").alias("mask"))
    return _bitmap(masks, "lexicon")


def _cell(term_hash: Column, shift: int, rate: int) -> Column:
    return F.pmod(F.shiftright(term_hash, shift), F.lit(rate))


def _below(shift: int, rate: int, subsets: int) -> Callable[[Column], Column]:
    return lambda h: _cell(h, shift, rate) < subsets


def _inside(shift: int, rate: int, subset: int) -> Callable[[Column], Column]:
    return lambda h: _cell(h, shift, rate) == subset


def _with_codes(rows: DataFrame, text: str, out: str, bitmap: Column) -> DataFrame:
    """Adds ``out``, an array of one code for each subset, empty where the text has none of its terms; and
    ``out``_rest, a hash of all terms of a text that has no code at all (null for others)."""

    rows = rows.withColumn("_terms", terms(F.col(text)))
    # a function over arrays takes no scalar; it takes a column, which is named once, so that no row holds the bitmap
    held = _bound(F.col("_bitmap"), lambda b: F.array_sort(F.array_distinct(F.filter("_terms", lambda t: _known(b, F.xxhash64(t))))))
    rows = rows.withColumn("_bitmap", bitmap).select(*rows.columns, held.alias("_sorted"))
    rows = rows.withColumn("_hashes", F.transform("_sorted", lambda t: F.xxhash64(F.lit("subset"), t)))
    parts = []
    for i, (rate, subsets) in enumerate(SCALES):
        rows = rows.withColumn(f"_scale{i}", F.filter("_hashes", _below(13 * i, rate, subsets)))
        parts += [F.filter(f"_scale{i}", _inside(13 * i, rate, k)) for k in range(subsets)]
    rows = rows.withColumn("_cells", F.array(*parts))
    code = F.transform("_cells", lambda c: F.when(F.size(c) > 0, F.right(F.lpad(F.lower(F.hex(F.xxhash64(c))), 16, "0"), F.lit(HEX))).otherwise(F.lit("")))
    rows = rows.withColumn(out, code)
    rest = F.when(F.array_max(out) == "", F.lower(F.hex(F.xxhash64(F.array_sort(F.array_distinct("_terms"))))))
    return rows.withColumn(f"{out}_rest", rest).drop("_terms", "_sorted", "_hashes", "_cells", *[f"_scale{i}" for i in range(len(SCALES))])


def _text_of(codes: str) -> Column:
    """The fingerprint as a string: codes in the order of subsets, dots for empty ones; or the hash of all terms."""
    return F.coalesce(F.concat(F.lit("all-"), F.col(f"{codes}_rest")), F.array_join(F.transform(codes, lambda c: F.when(c == "", F.lit("." * HEX)).otherwise(c)), ""))


def likeness(one: str, other: str) -> Column:
    """Of the scale that agrees best, the share of equal codes among those that either text has; 1 for equal
    fingerprints."""
    shares, at = [], 1
    for _, subsets in SCALES:
        pairs = F.arrays_zip(F.slice(one, at, subsets).alias("a"), F.slice(other, at, subsets).alias("b"))
        either = F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != ""))
        shares.append(F.size(F.filter(either, lambda p: p["a"] == p["b"])) / F.greatest(F.size(either), F.lit(SURE)))
        at += subsets
    equal = (F.col(one) == F.col(other)) & F.col(f"{one}_rest").eqNullSafe(F.col(f"{other}_rest"))
    return F.when(equal, F.lit(1.0)).otherwise(F.greatest(*shares))


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[list, int, list]:
    """Inner bounds of ranges of doc_id, each a doc_id that occurs, and the smallest one."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    size = docs.agg(F.sum(F.length(text_col)).alias("chars")).first()
    wanted = min(RANGES, max(4 * partitions, (size["chars"] or 0) // RANGE_CHARS))
    found = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, [i / wanted for i in range(1, wanted)], F.lit(min(10_000_000, 100 * wanted))).alias("bounds")).first()
    if found["least"] is None:
        return [], 0, key
    return sorted({b for b in found["bounds"] if b > found["least"]}), found["least"], key


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Each row with next_<column> of the document that follows in ascending doc_id (the first one follows the last).

    Rows of a range of doc_ids are sorted together; the first row of a range is also sent to the range before it, as
    a ghost behind its last row. Null ids come first; rows of one doc_id are ordered by a hash of their text.
    """
    bounds, least, key = _ranges(docs, id_col, text_col)
    step = max(1, math.isqrt(len(bounds)))
    literal = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, bounds[::step]))), ",").cast("array<bigint>") if bounds else literal
    rows = docs.withColumn("_key", key)
    rows = rows.withColumn("_block", F.greatest(F.lit(0), F.size(F.filter(coarse, lambda b: b <= F.col("_key"))) - 1))
    fine = F.slice(literal, F.col("_block") * step + 1, F.lit(step)) if bounds else literal
    rows = rows.withColumn("_range", F.col("_block") * step + F.size(F.filter(fine, lambda b: b <= F.col("_key"))))
    begins = F.when(F.col("_key") == least, F.lit(len(bounds))).when(F.get(literal, F.col("_range") - 1) == F.col("_key"), F.col("_range") - 1) if bounds else F.when(F.col("_key") == least, F.lit(0))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost"))
    places = F.when(begins.isNotNull(), F.array(own, F.struct(begins.alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    rows = rows.select("*", F.inline(places)).drop("_range", "_block")
    order = Window.partitionBy("range").orderBy("ghost", "_key", F.xxhash64(text_col))
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("NOT ghost").drop("range", "ghost", "_key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null counts as empty. The edited text has its last quarter (rounded down) replaced by as many code points from the
    start of the next document. Equal texts have equal fingerprints; a text without any lexicon term in a subset is
    fingerprinted by all its terms. Null ids come first; rows of one doc_id follow each other in a fixed order. Ids that
    aren't whole numbers raise a TypeError. Extra columns are ignored; an empty table gives an empty result.
    """
    whole_numbers(docs, id_col)
    bitmap = lexicon(docs, text_col, lowest, highest)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = _with_codes(rows, "text", "codes", bitmap)
    rows = with_next(rows, "doc_id", "text", ["text", "codes", "codes_rest"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))).drop("text", "next_text")
    rows = _with_codes(rows, "edited", "edited_codes", bitmap)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _text_of("codes").alias("fingerprint"),
        _text_of("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"),
        likeness("codes", "next_codes").alias("near_next"),
    )
