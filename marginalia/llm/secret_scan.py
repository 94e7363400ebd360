"""Secrets in texts: fixed patterns, and a token-efficiency test for random strings that no pattern names.

A byte-pair vocabulary spends few tokens on what it has seen in writing and many on random characters. A run of key
characters with few characters per token is therefore random, unless it is a digest or an identifier, which are random by
nature and no secrets: checksums by their length, UUIDs, numbers, words, paths and names made of words.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import vocabulary_path

# What the base patterns are, and how long a match must be.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LENGTH},}}")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})

#: Least characters of a random string, and the characters per token below which a run counts as random. Base-62 strings
#: have 1.3 to 1.8, compound words of the test corpora 2.0 or more (tests hold both ends).
RANDOM_LENGTH, EFFICIENCY = 20, 1.9
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{RANDOM_LENGTH},}}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEXADECIMAL = re.compile(r"(?:0x)?([0-9A-Fa-f]+)")
#: A part of a name: a word in one case or with a capital, or a short number.
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}")
#: The split of the byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Span = tuple[int, int, int]  # start, kind as its place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Matches of the three base kinds: leftmost, not overlapping within a kind, too short ones dropped afterwards."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_digest(run: str) -> bool:
    """Hexadecimal digits in the number of a common checksum."""
    m = HEXADECIMAL.fullmatch(run)
    return bool(m) and len(m[1]) in DIGEST_LENGTHS


def is_identifier(run: str) -> bool:
    """UUIDs, numbers, and names: parts between ``_ - / + =`` that are words or short numbers, at least four letters or
    digits to a part on average, so that a random string isn't taken for a name in short pieces."""
    if UUID.fullmatch(run) or not any(c.isalpha() for c in run):
        return True
    parts = [p for p in re.split(r"[+/_=-]+", run) if p]
    pieces = [NAME_PART.findall(p) for p in parts]
    return all("".join(found) == p for found, p in zip(pieces, parts)) and sum(map(len, parts)) >= 4 * sum(map(len, pieces))


class Efficiency:
    """Characters per token of a run under a tiktoken vocabulary."""

    def __init__(self, vocabulary: str):
        import tiktoken

        lines = open(vocabulary_path(vocabulary), "rb").read().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
        self.encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def of(self, run: str) -> float:
        return len(run) / len(self.encoding.encode_ordinary(run))


def random_spans(text: str, efficiency: Efficiency, base: list[Span], below: float, known: Collection[str] = ()) -> list[Span]:
    """Runs that tokenise badly, are neither digest nor identifier nor among ``known`` SHA-256 digests of harmless strings,
    and touch no base span."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if any(a < m.end() and m.start() < b for a, _, b in base) or is_digest(run) or is_identifier(run):
            continue
        if efficiency.of(run) < below and not (known and hashlib.sha256(run.encode()).hexdigest() in known):
            found.append((m.start(), 3, m.end()))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_meters: dict[str, Efficiency] = {}


def scan(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", below: float = EFFICIENCY, known: Collection[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind; base_sha256 is the digest of the
    base ones alone. ``known``: SHA-256 digests (lowercase hex) of strings that are no secrets, at most some thousands, as
    they go to every task. Null counts as empty and has no spans; whole texts are read, however long; repeated rows
    repeat; extra columns are ignored and an empty table gives an empty result.
    """
    kind, harmless = dict(docs.dtypes)[id_col], frozenset(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meter = _meters.get(vocabulary) or _meters.setdefault(vocabulary, Efficiency(vocabulary))
            counts: tuple[list[int], ...] = ([], [], [])
            digests, spans = [], []
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + random_spans(text, meter, base, below, harmless))))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(3)}, "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
