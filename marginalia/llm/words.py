"""Pre-tokenisation of whole texts with numpy, and a table of distinct words with their token ids.

The byte-level pattern of the public vocabularies is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and the word-level one keeps the runs and drops white space. Both are runs of one character class with three
repairs (a space joins the next run, contractions, the last white space of a run), so a batch of texts is cut with
array operations over its code points. Words then become a dictionary-encoded Arrow column: each distinct word is
encoded once, and ids are gathered by position.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters of white space in the sense of the pattern's \s.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points of a slice that is cut at once: bounds the memory of the arrays.
SLICE_CHARS = 1_000_000
#: Bytes of the texts of a batch that are Python strings at once.
SLICE_BYTES = 1 << 21
#: Distinct words a worker keeps before it starts its table anew; more where encoding a word costs more.
TABLE_WORDS, COSTLY_WORDS = 300_000, 700_000
#: Stands for the end of a word in vocabularies that mark it; no text in UTF-8 has this byte.
WORD_END = b"\xff"

_classes: np.ndarray | None = None
_unknown: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library sees it.

    Python's Unicode tables are older than the library's and those of ``regex`` newer, so what is a letter or number to
    ``regex`` alone is settled by the library: it joins a letter, or a digit, or neither.
    """
    global _classes
    if _classes is None:
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        every = "".join(map(chr, range(0x40000)))  # higher planes hold neither letters nor numbers
        kinds = np.frombuffer("".join(map(unicodedata.category, every)).encode(), np.uint8)[::2]
        table = np.full(0x110000, OTHER, np.uint8)
        table[:0x40000][kinds == ord("L")] = LETTER
        table[:0x40000][kinds == ord("N")] = NUMBER
        newer = regex.findall(r"[\p{L}\p{N}]", "".join(map(every.__getitem__, np.flatnonzero(kinds == ord("C")))))
        for first, kind in (("a", LETTER), ("1", NUMBER)):
            for _, (begin, end) in ByteLevel(add_prefix_space=False).pre_tokenize_str("\n".join(first + c for c in newer)):
                if end - begin == 2:
                    table[ord(newer[begin // 3])] = kind
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def unknown_points() -> np.ndarray:
    """Whether Python's Unicode tables lack a code point: what newer tables make of it, the library must say."""
    global _unknown
    if _unknown is None:
        _unknown = np.zeros(0x110000, bool)
        _unknown[:0x40000] = [unicodedata.category(chr(c)) == "Cn" for c in range(0x40000)]
    return _unknown


def vocabulary_path(name: str) -> str:
    """A path as given, or the place of a public vocabulary of that name on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each; a longer text stands alone."""
    begin = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > limit:
            yield begin, i
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _segments(texts: list[str], specials: Iterable[str]) -> tuple[list[str], list[tuple[int, int]]]:
    """The texts cut around special strings; the spans of these in the joined text."""
    import regex

    pattern = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)))
    cut: list[str] = []
    spans, at = [], 0
    for text in texts:
        last = 0
        for m in pattern.finditer(text):
            cut += [text[last : m.start()], m[0]]
            spans.append((at + m.start(), at + m.end()))
            last = m.end()
        cut.append(text[last:])
        at += len(text)
    return cut, spans


def split_words(texts: list[str], specials: Iterable[str] = (), byte_level: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one Arrow column, and the bounds of each text in it (one more than texts).

    ``byte_level``: words tile the text. Otherwise digits stand alone and white space makes words of its own, which
    a word-level vocabulary encodes to nothing.
    """
    joined = "".join(texts)
    n = len(joined)
    ends = np.cumsum([0, *map(len, texts)])
    if not n:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = char_classes()[points]
    fresh = np.zeros(n + 3, bool)  # where a segment begins; nothing is joined over it
    fresh[ends] = True
    fresh[n:] = True
    spans: list[tuple[int, int]] = []
    if specials and any(s in joined for s in specials):
        cut, spans = _segments(texts, specials)
        fresh[np.cumsum([0, *map(len, cut)])] = True
    begins = np.empty(n + 3, bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:n])
    begins[n:] = True
    begins |= fresh
    if byte_level:
        after = np.flatnonzero(begins[1:n] & (kinds[:-1] == SPACE) & ~fresh[1:n]) + 1
        begins[after - 1] = True
        begins[after[points[after - 1] == 32]] = False
    else:
        begins[:n] |= kinds == NUMBER
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    quote = np.flatnonzero((points == 39) & begins[:n])
    quote = quote[~fresh[quote + 1]]
    one, two = padded[quote + 1], padded[quote + 2]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    begins[short + 1] = False
    begins[short + 2] = True
    pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    long = quote[pair & ~fresh[quote + 2]]
    begins[long + 1] = False
    begins[long + 3] = True
    for a, b in spans:
        begins[a] = True
        begins[a + 1 : b] = False
        begins[b] = True
    starts = np.flatnonzero(begins[:n])
    data = joined.encode()
    if len(data) == n:
        offsets = np.append(starts, n)
    else:
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.append((np.cumsum(widths) - widths)[starts], len(data))
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return words, np.searchsorted(starts, ends)


class WordTable:
    """Distinct words with their ids. ``encode``: from a list of words to a list of id lists."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = TABLE_WORDS):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word; unseen words are encoded, all at once."""
        if len(self.place) > self.limit:
            self.clear()
        get = self.place.get
        rows = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [words[i] for i in missing]
            ids = self.encode(new)
            base = len(self.place)
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(sizes.sum())
            while base + len(new) > len(self.begin):
                self.begin, self.length = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.length, np.zeros_like(self.length)])
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            at = slice(base, base + len(new))
            self.length[at] = sizes
            self.begin[at] = self.used + np.cumsum(sizes) - sizes
            self.used += total
            self.place.update(zip(new, range(base, base + len(new))))
            rows[missing] = np.arange(base, base + len(new))
        return rows


class Encoder:
    """Ids of whole texts by a table of distinct words. Equal to the tokenizers library on the same file."""

    def __init__(self, path: str):
        self.path = vocabulary_path(path)
        spec = json.load(open(self.path))
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_level = spec["normalizer"] is None
        self.size = max([*spec["model"]["vocab"].values(), *self.specials.values()]) + 1
        self.encode_words = self._ranked(spec)
        self.table = WordTable(self.encode_words)

    @cached_property
    def library(self):
        """The library's tokenizer; byte-level words do without it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def pieces(self) -> dict[int, bytes]:
        """The bytes of each id, special tokens' too."""
        spec = json.load(open(self.path))
        return byte_pieces(spec["model"]["vocab"] | self.specials)

    def _by_library(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _ranked(self, spec: dict) -> Callable[[list[str]], list[list[int]]]:
        """One byte pair merge at a time, straight on a word's bytes, where ids are ranks: those of merged symbols follow
        the order of the merges, behind all others. The end of a word is a byte that UTF-8 doesn't have."""
        import tiktoken

        vocabulary, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or merged[0] != len(vocabulary) - len(merged) - sum(s in vocabulary for s in self.specials):
            return self._by_library
        mark = WORD_END if end else b""
        ranks = {}
        for token, i in vocabulary.items():
            if token not in self.specials:
                whole = bool(end) and token.endswith(end)
                ranks[_bytes_of(token.removesuffix(end) if whole else token) + mark * whole] = i
        core = tiktoken.Encoding("words", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        special = self.specials
        if end:
            blank = frozenset(map(chr, WHITE_SPACE))
            return lambda words: [[] if w[0] in blank else core(w.encode() + mark) for w in words]
        return lambda words: [[special[w]] if w in special else core(w.encode()) for w in words]

    def _plain(self, texts: list[str]) -> list[str]:
        """What the word-level vocabulary's normaliser makes of the texts; white space is dropped later."""
        out = []
        for t in texts:
            if not t.isascii():
                points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                if unknown_points()[points].any():
                    t = self.library.normalizer.normalize_str(t)
                t = (t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("Σ", "σ")
            out.append(t.lower())
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice of the texts: its first and last index, all ids, and each text's bounds in them."""
        for a, b in slices(texts):
            part = texts[a:b]
            if not self.byte_level:
                if any(s in t for s in self.specials for t in part):
                    found = self._by_library(part)
                    yield a, b, np.fromiter((i for x in found for i in x), np.uint32), np.cumsum([0, *map(len, found)])
                    continue
                part = self._plain(part)
            words, bounds = split_words(part, self.specials if self.byte_level else (), self.byte_level)
            ids, lengths = self._gather(words)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            yield a, b, ids, ends[bounds]

    def _gather(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = words.dictionary_encode()
        rows = self.table.rows(strings(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        lengths = self.table.length[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.table.begin[rows] - (ends - lengths), lengths) + np.arange(total)
        return self.table.flat[at], lengths


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_alphabet = byte_alphabet()


def _bytes_of(token: str) -> bytes:
    return bytes(_alphabet[c] for c in token)


def byte_pieces(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """The bytes that each id stands for."""
    return {i: _bytes_of(token) for token, i in vocabulary.items()}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; its table of words outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def sliced(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow column of texts with about ``limit`` bytes each; a longer text adds its own. A worker
    keeps what it once took, so a batch's texts are made Python strings a part at a time, and what Arrow has free goes
    back to the system at the end."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)])
    pa.default_memory_pool().release_unused()


def in_slices(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut by the bytes of their column ``text``."""
    for batch in batches:
        for a, b in sliced(batch.column(text)):
            yield batch.slice(a, b - a)


def strings(column: pa.Array) -> list[str]:
    """The values of an Arrow column of strings, converted at once."""
    return column.to_numpy(zero_copy_only=False).tolist()
