"""Hubs, chunks and samples at their bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe_codec, language_id, toxicity, words
from marginalia.llm.components import stars


def test_a_hub_is_one_component(spark):
    links = spark.range(1, 3000).selectExpr("id AS a", "cast(0 AS long) AS b").unionByName(spark.range(5000, 5003).selectExpr("id AS a", "id + 1 AS b"))
    got = {(r.a, r.b) for r in stars(links).collect()}
    assert got == {(k, 0) for k in range(1, 3000)} | {(k, 5000) for k in (5001, 5002, 5003)}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_codec_with_a_word_in_every_chunk(spark, tokenizer, monkeypatch):
    """Small chunks, a document that is longer than one, and runs of a few rows."""
    monkeypatch.setattr(bpe_codec, "CHUNK_WORDS", 40)
    monkeypatch.setattr(bpe_codec, "SLICE_WORDS", 15)
    monkeypatch.setattr(bpe_codec, "RUN_ROWS", 7)
    texts = [f"the {k} the {'the word ' * (k % 5)}" for k in range(60)] + ["the end " * 500]
    rows = bpe_codec.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    ids = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {k: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, (t, i) in enumerate(zip(texts, ids))}


@pytest.mark.parametrize("name, bits", [("CHUNK_BITS", 0), ("SLOT_BITS", 2)])
def test_numbers_that_do_not_fit_are_errors(spark, monkeypatch, name, bits):
    monkeypatch.setattr(bpe_codec, "CHUNK_WORDS", 40)
    monkeypatch.setattr(bpe_codec, name, bits)
    docs = spark.createDataFrame([(k, f"some words and {k} more of them " * 4) for k in range(30)], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="has no number|distinct words"):
        bpe_codec.encode_decode(docs).collect()


def test_toxic_sample_is_bounded_by_whole_texts(spark, monkeypatch):
    seen: list[list[str]] = []
    monkeypatch.setattr(toxicity, "fit_texts", lambda texts, labels: seen.append(texts))
    docs = spark.createDataFrame([(k, f"text {k} " * 100) for k in range(200)] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.range(600).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 5000)
    toxicity.fit(docs, labels)
    every, some = seen
    assert some == every[: len(some)] and len(every) > 100
    assert sum(map(len, some[:-1])) < 5000 <= sum(map(len, some))


def test_kernel_in_slices_learns_the_same(monkeypatch):
    random = np.random.default_rng(0)
    sets, labels = random.random((90, language_id.BUCKETS)) < 0.05, [("de", "en", "fr")[k % 3] for k in range(90)]
    whole = language_id.fit_sets(sets, labels)
    monkeypatch.setattr(language_id, "KERNEL_ROWS", 7)
    assert np.allclose(language_id.fit_sets(sets, labels).weights, whole.weights, atol=1e-5)


def test_batches_of_texts_are_python_strings_a_part_at_a_time(spark):
    class Bounded:
        """Stands for a model; refuses texts of more bytes at once than ``most``, longer single ones aside."""

        languages, most = ["en"], 2 * words.SLICE_BYTES

        def scores(self, texts):
            if len(texts) > 1 and sum(map(len, texts)) > self.most:
                raise ValueError("too many texts at once")
            return np.array([float(len(t)) for t in texts])

        def predict(self, texts):
            return ["en"] * len(texts), self.scores(texts)

    sizes = [1, 0, 3_000_000, *[40_000] * 300, None]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").coalesce(1).select("doc_id", F.repeat(F.lit("a"), "n").alias("text"))
    got = docs.select("doc_id", language_id.predicted(F.col("text"), Bounded()).alias("p"), toxicity.scored(F.col("text"), Bounded()).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in got] == [float(n or 0) for n in sizes]
    assert [(r.p.lang, r.p.score) for r in got] == [("en", float(n)) if n else ("und", 0.0) for n in sizes]
    column = pa.array(["a" * (n or 0) if n is not None else None for n in sizes])
    parts = list(words.sliced(column))
    assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == len(sizes) and len(parts) > 4
    assert list(words.sliced(column[:0])) == [(0, 0)]
