"""Token counts by byte-pair merging with a heap and a linked list, without making ids.

A word is a linked list of symbols; a heap holds the ranks of adjacent pairs. The lowest rank is popped again and again;
each merge shortens the list by one, so the count is initial symbols minus merges. Distinct words of a batch are counted
once, and a text's count is the sum over its words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import COSTLY_WORDS, byte_alphabet, slices, split_words, strings, texts_of, vocabulary_path


class MergeCounter:
    """Counts of words under a byte-level vocabulary (a tokenizers .json without normaliser)."""

    def __init__(self, path: str, limit: int = COSTLY_WORDS):
        spec = json.load(open(vocabulary_path(path)))
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normaliser or prefix space is needed")
        vocabulary = spec["model"]["vocab"]
        self.first = {byte: vocabulary[c] for c, byte in byte_alphabet().items()}
        self.specials = {x["content"] for x in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {vocabulary[a] << 32 | vocabulary[b]: rank << 32 | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self.known: dict[str, int] = {}
        self.limit = limit

    def count(self, word: str) -> int:
        """Symbols of a word after all merges."""
        if word in self.specials:
            return 1
        first, merge = self.first, self.merge
        symbol = [first[b] for b in word.encode()]
        n = len(symbol)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbol[i] << 32 | symbol[i + 1]
            if (m := merge.get(pair)) is not None:
                heap.append((m >> 32, i, pair, m & 0xFFFFFFFF))
        heapify(heap)
        left = n
        while heap:
            _, i, pair, new = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or symbol[i] << 32 | symbol[j] != pair:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merge.get(p := new << 32 | symbol[k])) is not None:
                    heappush(heap, (m >> 32, i, p, m & 0xFFFFFFFF))
            h = before[i]
            if h >= 0 and (m := merge.get(p := symbol[h] << 32 | new)) is not None:
                heappush(heap, (m >> 32, h, p, m & 0xFFFFFFFF))
        return left

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self.count(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def text_counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            words, bounds = split_words(texts[a:b], self.specials)
            coded = words.dictionary_encode()
            each = self.counts(strings(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            out.append(np.diff(np.concatenate([[0], np.cumsum(each)])[bounds]))
        return np.concatenate(out)


_counters: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row.

    Null counts as empty: no bytes, no tokens. A special string inside a text is one token. Extra columns are ignored,
    repeated rows repeat, an empty table gives an empty result. The counter's table lives in the worker and is bounded.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = _counters.get(vocabulary) or _counters.setdefault(vocabulary, MergeCounter(vocabulary))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(counter.text_counts(texts_of(batch.column(1))), pa.int64())})

    rows = docs.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
