"""Language identification with string kernels.

A text is the set of its byte n-grams of lengths 1 to ORDERS, each hashed to one of BUCKETS places (the blended
spectrum, presence only). The kernel of two texts is the cosine of their sets: shared n-grams over the geometric mean of
the set sizes. Nystroem landmarks stand for the training texts, and one-versus-rest kernel ridge regression gives a
margin per language. Scoring is one matrix product of a batch's presence matrix with the landmarks and a second one with
the dual coefficients.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .sampling import first_rows, fold, sampled
from .words import in_slices, sliced, texts_of

BUCKETS, ORDERS = 8192, 4
#: Bounds of the training sample: texts of a language, and texts in all.
PER_LANGUAGE, SAMPLE = 400, 40_000
#: Landmarks in all at least, and of each language.
LANDMARKS, LANDMARKS_EACH = 192, 24
RIDGE, SHARPNESS = 0.3, 6.0
#: Rows of the kernel that a fit holds at once.
KERNEL_ROWS = 4096
FOLDS = 5
NONE = "und"
#: Bytes, and documents, whose presence matrix is made at once.
SLICE_BYTES, SLICE_DOCUMENTS = 500_000, 256

_MULTIPLIER = np.uint32(2654435761)


def presence(texts: list[bytes]) -> np.ndarray:
    """Which places each text's n-grams take: a boolean matrix of one row per text."""
    out = np.zeros((len(texts), BUCKETS), bool)
    flat = out.reshape(-1)
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)
    gram = raw
    for order in range(1, ORDERS + 1):
        if order > 1:
            if len(raw) < order:
                break
            gram = (gram[:-1] << np.uint32(8)) | raw[order - 1 :]
        place = ((gram + np.uint32(order)) * _MULTIPLIER) >> np.uint32(19)
        inside = row[: len(gram)]
        if order == 1:
            flat[inside + place] = True
        else:
            same = inside == row[order - 1 :]
            flat[(inside + place)[same]] = True
    return out


@dataclass
class Model:
    """Landmarks as packed presence bits, their set sizes, and the coefficients of each language."""

    languages: list[str]
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS // 8), np.uint8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))

    def __post_init__(self) -> None:
        self._matrix: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrix": None}

    def matrix(self) -> np.ndarray:
        if self._matrix is None:
            sets = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            self._matrix = (sets / np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1))).T.copy()
        return self._matrix

    def kernel(self, sets: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        return sets.astype(np.float32) @ self.matrix() / size

    def margins(self, sets: np.ndarray) -> np.ndarray:
        return self.kernel(sets) @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and its share of a softmax over the margins, for each text."""
        names, scores = [], []
        for part in _batches(t.encode().lower() for t in texts):
            margins = SHARPNESS * self.margins(presence(part))
            best = margins.argmax(axis=1)
            shares = np.exp(margins - margins.max(axis=1, keepdims=True))
            names += [self.languages[i] for i in best]
            scores.append(shares.max(axis=1) / shares.sum(axis=1))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def _batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and (size + len(t) > SLICE_BYTES or len(held) >= SLICE_DOCUMENTS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def fit_sets(sets: np.ndarray, labels: list[str]) -> Model:
    """Kernel ridge regression on rows of presence; the landmarks are dealt round the languages in the order given."""
    names = sorted(set(labels))
    if not names:
        return Model([])
    ranks, seen = [], dict.fromkeys(names, 0)
    for label in labels:
        ranks.append(seen[label])
        seen[label] += 1
    chosen = sorted(range(len(labels)), key=lambda i: (ranks[i], i))[: max(LANDMARKS, LANDMARKS_EACH * len(names))]
    model = Model(names, np.packbits(sets[chosen], axis=1), np.zeros((len(chosen) + 1, len(names)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(sets[chosen]).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # the landmarks' kernel ** -1/2, up to a rotation
    squares = RIDGE * np.eye(len(chosen) + 1)
    squares[-1, -1] = 1e-6
    products = np.zeros((len(chosen) + 1, len(names)))
    index = np.searchsorted(names, labels)
    for a in range(0, len(labels), KERNEL_ROWS):  # a slice of the kernel at a time
        part = np.hstack([model.kernel(sets[a : a + KERNEL_ROWS]).astype(np.float64) @ root, np.ones((len(labels[a : a + KERNEL_ROWS]), 1))])
        squares += part.T @ part
        products += part.T @ np.where(index[a : a + KERNEL_ROWS, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve(squares, products)
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from whole texts of a bounded sample of rows outside the held-out fold, a share of each language.

    The sample holds about ``per_language`` texts of every language, SAMPLE in all. Null texts and labels teach nothing.
    Only the presence bits of the sampled texts, BUCKETS / 8 bytes each, come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    learn = sampled(rows.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("text").isNotNull()), "doc_id", "lang", per_language, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2):
            at = 0
            for part in _batches(t.encode().lower() for t in texts_of(batch.column(2))):
                bits = np.packbits(presence(part), axis=1)
                yield pa.RecordBatch.from_pydict({"at": batch.column(0).slice(at, len(part)), "lang": batch.column(1).slice(at, len(part)), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})
                at += len(part)

    found = learn.select(F.xxhash64(F.lit("order"), "doc_id").alias("at"), "lang", "text").mapInArrow(run, "at long, lang string, bits binary")
    rows = sorted((r["at"], r["lang"], bytes(r["bits"])) for r in first_rows(found, ["at", "lang", "bits"], 2 * SAMPLE).toArrow().to_pylist())
    if not rows:
        return Model([])
    sets = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(bool)
    return fit_sets(sets, [r[1] for r in rows])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predicted(text: Column, model: Model) -> Column:
    """A struct of lang and score; ``und`` with score 0 for null and for texts without a letter."""

    @F.arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        found = [model.predict(texts_of(texts.slice(a, b - a))) for a, b in sliced(texts)]
        names, scores = [n for part, _ in found for n in part], np.concatenate([s for _, s in found]).astype(float)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    nothing = F.struct(F.lit(NONE).alias("lang"), F.lit(0.0).alias("score"))
    if not model.languages:
        return nothing
    return F.when(has_letter(text), run(text)).otherwise(nothing)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Whole texts are read, however long. Null, empty and letterless texts are ``und``, as is everything where no label can be learned. Extra columns are
    ignored, repeated rows repeat, an empty table gives an empty result.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == 0).alias("held_out"), predicted(F.col(text_col), model).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
