"""BPE encoding and decoding through a table of distinct words, and a table of pieces.

Spark splits texts into words by the vocabulary's pattern. Documents are kept in chunks: a chunk lists its distinct words
once, and each document as numbers of these words, one per position. The chunks' word lists, never the positions, are
shuffled by word; each distinct word is encoded once; its ids are joined with the table of pieces to decode them, and
joined back to the chunks that hold the word. A chunk's numbers then pick ids and decoded words by position. Chunks are
stored in buckets, so that ids move to them and they don't move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, spread
from .words import LETTER, NUMBER, WHITE_SPACE, char_classes, encoder, strings

#: Words of a chunk, about: a longer document is a chunk of its own.
CHUNK_WORDS = 6_000_000
#: Words whose ids are laid out at once, about.
SLICE_WORDS = 300_000
#: A place is the number of a chunk and that of a word in it; chunks of a task, likewise, follow the task's number. That
#: leaves 24 bits for tasks; a number that is too large for its bits is an error.
SLOT_BITS, CHUNK_BITS = 26, 13
#: Characters of a bucket of chunks, and rows of a task of the word table. A word has one row a chunk, so that even one in
#: every chunk is a task's share until there are TASK_ROWS chunks, some 60 TB of text, and twice that at twice the size.
BUCKET_CHARS, TASK_ROWS = 200_000_000, 2_000_000
#: Rows of the word table's task that are sorted by chunk at once.
RUN_ROWS = 1_000_000

_newer: dict[str, list[str]] = {}


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, begin = [], None
    for i, point in enumerate(points):
        if begin is None:
            begin = point
        if i + 1 == len(points) or points[i + 1] != point + 1:
            out.append(f"\\x{{{begin:x}}}-\\x{{{point:x}}}")
            begin = None
    return "".join(out)


def newer_classes(spark: SparkSession) -> list[str]:
    """Letters and numbers, as class insides, that the library knows and this Java doesn't yet: thousands at most."""
    version = spark.sql("SELECT java_method('java.lang.System', 'getProperty', 'java.version')").first()[0]
    if version not in _newer:
        table = char_classes()
        every = ["".join(map(chr, np.flatnonzero(table == kind))) for kind in (LETTER, NUMBER)]
        unknown = spark.range(1).select(*[F.regexp_replace(F.lit(e), rf"\p{{{name}}}", "") for e, name in zip(every, "LN")]).first()
        _newer[version] = [_ranges(list(map(ord, u))) for u in unknown]
    return _newer[version]


def split_words(text: Column, spark: SparkSession, specials: list[str]) -> Column:
    """The words of a text, which tile it. A special string is a word, and nothing is joined over its ends."""
    space = _ranges(WHITE_SPACE)
    letter, number = (rf"[\p{{{name}}}[\x{{80}}-\x{{10ffff}}&&[{more}]]]" if more else rf"\p{{{name}}}" for name, more in zip("LN", newer_classes(spark)))
    other = rf"[^{space}[{letter}{number}]]"
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"

    def words(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(pattern), F.lit(0))

    if not specials:
        return words(text)
    named = "|".join(rf"\Q{s}\E" for s in sorted(specials, key=len, reverse=True))
    parts = F.filter(F.split(text, f"(?={named})|(?<={named})"), lambda p: p != "")
    return F.when(text.rlike(named), F.flatten(F.transform(parts, lambda p: F.when(p.isin(*specials), F.array(p)).otherwise(words(p))))).otherwise(words(text))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def chunks(split: DataFrame, kind: str) -> DataFrame:
    """chunk, words (distinct ones, by falling frequency, then in order), n_words, doc_ids, sizes (words of each document), numbers
    (the word at each position, packed). ``split``: doc_id, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = chunk = TaskContext.get().partitionId() << CHUNK_BITS
        held, size = [], 0

        def row() -> pa.RecordBatch:
            if chunk - first >= 1 << CHUNK_BITS or chunk >= 1 << (63 - SLOT_BITS):
                raise OverflowError(f"chunk {chunk - first} of task {first >> CHUNK_BITS} has no number")
            coded = pa.concat_arrays([words for _, words, _ in held]).dictionary_encode()
            each = coded.indices.to_numpy(zero_copy_only=False)
            known = pa.table({"n": np.bincount(each, minlength=len(coded.dictionary)), "word": coded.dictionary})
            order = pc.sort_indices(known, [("n", "descending"), ("word", "ascending")]).to_numpy()
            if len(order) > 1 << SLOT_BITS:
                raise OverflowError(f"a chunk of {len(order)} distinct words")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            names, sizes = pa.concat_arrays([ids for ids, _, _ in held]), np.concatenate([n for _, _, n in held])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), one(coded.dictionary.take(pa.array(order))), pa.array([len(order)], pa.int64()), one(names), one(pa.array(sizes, pa.int32())), pa.array([_pack(rank[each])], pa.binary())], ["chunk", "words", "n_words", "doc_ids", "sizes", "numbers"])

        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            words, at = lists.flatten(), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_WORDS, "right")) - 1)
                held.append((batch.column(0).slice(at, stop - at), words.slice(ends[at], ends[stop] - ends[at]), np.diff(ends[at : stop + 1])))
                size += int(ends[stop] - ends[at])
                at = stop
                if size >= CHUNK_WORDS:
                    yield row()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield row()

    return split.mapInArrow(run, f"chunk long, words array<string>, n_words long, doc_ids array<{kind}>, sizes array<int>, numbers binary")


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """id, piece (its bytes in hexadecimal digits): as many rows as the vocabulary has entries."""
    return spark.createDataFrame(pd.DataFrame([(i, piece.hex()) for i, piece in encoder(vocabulary).pieces().items()], columns=["id", "piece"]), "id int, piece string")


def decode(rows: DataFrame, pieces: DataFrame, key: str = "key", ids: str = "ids") -> DataFrame:
    """key, ids, decoded (binary: the joined bytes of the ids' pieces) of rows with distinct keys and arrays of ids.

    Each id is joined with the table of pieces. Keys without ids are left out; ids outside the vocabulary are dropped.
    """
    each = rows.select(key, F.posexplode(ids).alias("at", "id")).join(F.broadcast(pieces), "id")
    ordered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "id", "piece"))).alias("parts"))
    return ordered.select(key, F.col("parts.id").alias("ids"), F.unhex(F.array_join("parts.piece", "")).alias("decoded"))


def decoded_text(decoded: Column) -> Column:
    """Bytes as text: what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(decoded.cast("string"))


def word_table(places: DataFrame, pieces: DataFrame, vocabulary: str, partitions: int) -> DataFrame:
    """word, ids, decoded of each distinct word of ``places`` (word, place); all are dealt out by word alike."""

    @F.arrow_udf("array<int>")
    def encode(words: pa.Array) -> pa.Array:
        return pa.array(encoder(vocabulary).encode_words(strings(words)), pa.list_(pa.int32()))

    # naming a word's first place keeps this exchange equal to that of the join below, so Spark runs it once; Spark
    # may not move what isn't deterministic, so a word is encoded after it was found distinct
    there = F.when(F.col("first") >= 0, True).otherwise(F.raise_error(F.lit("a word without a place")).cast("boolean"))
    distinct = places.groupBy("word").agg(F.min("place").alias("first")).where(there)
    encoded = distinct.sortWithinPartitions("word").select("word", encode.asNondeterministic()("word").alias("ids"))
    return decode(encoded.repartition(partitions, "word"), pieces, "word")


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words as a row per chunk for every RUN_ROWS of them: slots in ascending order, as differences, with their
    words' ids.

    Rows in: place, ids, decoded (null where it is the word itself).
    """
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN_ROWS:
            yield _bundled(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield _bundled(pa.Table.from_batches(held))


def _bundled(rows: pa.Table) -> pa.RecordBatch:
    order = pc.sort_indices(rows.column("place")).to_numpy()
    places, lists, decoded = rows.column("place").to_numpy()[order], rows.column("ids").combine_chunks().take(pa.array(order)), rows.column("decoded").combine_chunks().take(pa.array(order))
    chunk, slot, length = places >> SLOT_BITS, places & ((1 << SLOT_BITS) - 1), lists.value_lengths().to_numpy(zero_copy_only=False)
    ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(length)])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
    other = decoded.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        changed = [{"slot": int(slot[i]), "decoded": decoded[i].as_py()} for i in a + np.flatnonzero(other[a:b])]
        out.append((int(chunk[a]), _pack(np.diff(slot[a:b], prepend=0)), _pack(length[a:b]), _pack(ids[ends[a] : ends[b]]), changed))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("slot", pa.int32()), ("decoded", pa.binary())]))]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["chunk", "slots", "lengths", "ids", "changed"])


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, with ``keep_ids``, ids and decoded) of every row.

    Null counts as empty: no ids. Special strings inside texts are special tokens, as the library has it by default.
    Repeated rows give repeated results; extra columns are ignored, whatever their names; an empty table gives an empty
    result. A chunk and its words' ids meet in one task: chunks are bounded, but for a longer document. ``vocabulary``:
    a byte-level one.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    if not encoder(vocabulary).byte_level:
        raise ValueError("a byte-level vocabulary is needed")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    split = rows.select("doc_id", split_words(F.col("text"), spark, list(encoder(vocabulary).specials)).alias("words"))
    buckets = min(spread(spark, chars, BUCKET_CHARS), 100_000)  # Spark's limit of buckets
    stored = materialize(chunks(split, kind), "word-chunks", buckets=(buckets, "chunk"), compression="zstd")
    listed = stored.agg(F.sum("n_words")).first()[0] or 0
    place = F.shiftleft("chunk", SLOT_BITS) + F.col("slot")
    places = stored.select("chunk", F.posexplode("words").alias("slot", "word")).select("word", place.alias("place"))
    partitions = spread(spark, listed, TASK_ROWS)
    places = places.where(F.col("word").isNotNull()).repartition(partitions, "word")
    table = word_table(places, piece_table(spark, vocabulary), vocabulary, partitions).hint("merge")
    # a decoded word travels only where it isn't the word itself, which its chunk has
    joined = places.join(table, "word").select("place", "ids", F.when(F.col("decoded") != F.col("word").cast("binary"), F.col("decoded")).alias("decoded"))
    back = joined.mapInArrow(bundles, "chunk long, slots binary, lengths binary, ids binary, changed array<struct<slot: int, decoded: binary>>")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def meet(chunk: pa.Table, words: pa.Table) -> pa.Table:
        slots = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_unpack(d), dtype=np.int64) for d in words.column("slots").to_pylist()]])
        many = np.concatenate([np.zeros(0, np.uint32), *map(_unpack, words.column("lengths").to_pylist())])
        flat = np.concatenate([np.zeros(0, np.uint32), *map(_unpack, words.column("ids").to_pylist())])
        length, begin = np.zeros(len(slots), np.uint32), np.zeros(len(slots), np.uint32)
        length[slots], begin[slots] = many, np.cumsum(many) - many
        pieces = chunk.column("words").combine_chunks().flatten()
        changed = {x["slot"]: x["decoded"] for row in words.column("changed").to_pylist() for x in row}
        if changed:
            pieces = pa.array([changed.get(i, w.encode()) for i, w in enumerate(pieces.to_pylist())], pa.binary())
        numbers, sizes = _unpack(chunk.column("numbers")[0].as_py()), chunk.column("sizes").combine_chunks().flatten().to_numpy()
        names, bounds = chunk.column("doc_ids").combine_chunks().flatten(), np.concatenate([[0], np.cumsum(sizes)])
        parts, at = [], 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_WORDS, "right")) - 1)
            parts.append(documents(names.slice(at, stop - at), bounds[at : stop + 1] - bounds[at], numbers[bounds[at] : bounds[stop]], begin, length, flat, pieces))
            at = stop
        return pa.Table.from_batches(parts)

    def documents(names: pa.Array, bounds: np.ndarray, numbers: np.ndarray, begin: np.ndarray, length: np.ndarray, flat: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
        many = length[numbers].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(begin[numbers] - ends[:-1], many) + np.arange(ends[-1])].astype("<u4")
        decoded = pieces.take(pa.array(numbers)).cast(pa.large_binary())
        offsets = np.frombuffer(decoded.buffers()[1], np.int64)[: len(numbers) + 1] if len(numbers) else np.zeros(1, np.int64)
        raw, data, at = memoryview(ids.tobytes()), memoryview(decoded.buffers()[2] or b""), ends[bounds]
        spans = list(zip(offsets[bounds[:-1]], offsets[bounds[1:]]))
        columns = {
            "doc_id": names,
            "n_tokens": pa.array(np.diff(at), pa.int64()),
            "ids_sha256": [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1], at[1:])],
            "decoded_sha256": [hashlib.sha256(data[x:y]).hexdigest() for x, y in spans],
        }
        if keep_ids:
            columns |= {"ids": pa.array([ids[x:y].astype(np.int32) for x, y in zip(at[:-1], at[1:])], pa.list_(pa.int32())), "decoded": [bytes(data[x:y]).decode() for x, y in spans]}
        return pa.RecordBatch.from_pydict(columns)

    return stored.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(meet, schema)
