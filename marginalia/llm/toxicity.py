"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the average of the vectors of its character n-grams (with word borders) and of itself, all hashed to
BUCKETS rows, so an unseen spelling shares most of them. A window of WINDOW words is the average of its words' vectors
and goes through a linear softmax; rows and softmax are trained together. Labels are given to texts, not windows: after
a first fit with the texts' labels, windows of toxic texts that look clean teach nothing any more, but for the worst one.
All windows of all clean texts are learned.
A text's evidence is that of its worst window, wherever that begins, plus SHARES of that of the whole text's average; of
the shares the one is taken that errs least on texts which the fit hasn't seen, and a logistic curve is set on them.
Because averages and the softmax are linear, a word's share of the logit is one number, kept in a bounded table per worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, release
from .sampling import first_rows, fold, sampled
from .words import TABLE_WORDS, sliced, texts_of

BUCKETS, WIDTH = 1 << 16, 8
SHORTEST, LONGEST = 3, 5
WINDOW = 3
#: Weights of a text's average beside its worst window, to choose from.
SHARES = (0.0, 0.5, 2.0)
#: Bound of the training sample: texts of each label. Of these, whole texts are learned.
PER_LABEL = 1500
FOLDS, HELD = 3, 1
THRESHOLD = 0.7
PASSES = (2, 6)
#: Weight of clean windows that already score as clean.
SETTLED = 0.5
#: Bound of the training sample in code points: whole texts, in a random order, up to the one that passes it.
SAMPLE_CHARS = 40_000_000
#: Minibatches of a pass over a small sample, at least; they hold 64 to 4096 windows.
STEPS = 150
SEED = 7

#: Bytes that belong to words: ASCII letters and digits, and all of other characters.
_IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of word bytes and of other bytes of lower-cased texts, whether each is a word, and each text's bounds."""
    parts = [t.lower().encode() for t in texts]
    data = b"".join(parts)
    ends = np.cumsum([0, *map(len, parts)])
    if not data:
        return pa.array([], pa.large_binary()), np.zeros(0, bool), np.zeros(len(ends), np.int64)
    kind = _IN_WORD[np.frombuffer(data, np.uint8)]
    begins = np.empty(len(data) + 1, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[ends] = True
    starts = np.flatnonzero(begins[:-1])
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
    return runs, kind[starts], np.searchsorted(starts, ends)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of the words, and the bounds of each word in them."""
    text = b"".join(b"<" + w + b">" for w in words)
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    with np.errstate(over="ignore"):
        value = np.full(len(raw), 1469598103934665603, np.uint64)
        for order in range(1, LONGEST + 1):
            n = len(raw) - order + 1
            if n <= 0:
                break
            value = (value[:n] ^ raw[order - 1 :]) * np.uint64(1099511628211)
            if order >= SHORTEST:
                inside = word[:n] == word[order - 1 :]
                found.append(value[inside])
                owner.append(word[:n][inside])
        place = np.arange(len(raw), dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
        whole = (raw + np.uint64(7)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
        found.append(np.bitwise_xor.reduceat(whole * (whole >> np.uint64(29) | np.uint64(1)), np.cumsum(sizes) - sizes) if len(words) else np.zeros(0, np.uint64))
    owner.append(np.arange(len(words)))
    owners = np.concatenate(owner)
    hashed = np.concatenate(found)
    buckets = ((hashed ^ (hashed >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def windows_of(words: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window (windows don't pass a text's end), and each text's bounds in the windows."""
    counts = np.diff(bounds)
    each = -(-counts // size)
    ends = np.concatenate([[0], np.cumsum(each)])
    first = np.repeat(bounds[:-1], each) + size * (np.arange(ends[-1]) - np.repeat(ends[:-1], each))
    return first, ends


@dataclass
class Model:
    """``rows``: what each bucket adds to the toxic logit, once averaged. ``base``: the softmax's bias. ``share``, ``slope``
    and ``shift``: the weight of a text's average beside its worst window, and the calibration of their sum."""

    rows: np.ndarray
    base: float
    share: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > TABLE_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            buckets, bounds = grams(new)
            sums = np.add.reduceat(self.rows[buckets], bounds[:-1])
            known.update(zip(new, (sums / np.diff(bounds)).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window logit of each text, over windows from every word on, and the logit of its average; a
        shorter text is one window. A text without words has that of no evidence, the bias."""
        worst, whole = np.full(len(texts), self.base), np.full(len(texts), self.base)
        runs, is_word, bounds = split(texts)
        if not len(runs):
            return worst, whole
        coded = runs.dictionary_encode()
        logits = self.word_logits(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)][is_word]
        ends = np.concatenate([[0], np.cumsum(is_word)])[bounds]
        counts = np.diff(ends)
        filled = np.flatnonzero(counts)
        if len(filled):
            total = np.concatenate([[0.0], np.cumsum(logits)])
            whole[filled] += (total[ends[1:]] - total[ends[:-1]])[filled] / counts[filled]
            each = np.maximum(counts[filled] - WINDOW + 1, 1)
            first = _runs(ends[:-1][filled], each)
            stop = np.minimum(first + WINDOW, np.repeat(ends[1:][filled], each))
            worst[filled] += np.maximum.reduceat((total[stop] - total[first]) / (stop - first), np.cumsum(each) - each)
        return worst, whole

    def scores(self, texts: list[str]) -> np.ndarray:
        at = 0
        found = []
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 800_000):
                size += len(texts[stop])
                stop += 1
            worst, whole = self.evidence(texts[at:stop])
            found.append(1 / (1 + np.exp(-np.clip(self.slope * (worst + self.share * whole) + self.shift, -40, 40))))
            at = stop
        return np.concatenate(found) if found else np.zeros(0)


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] numbers), then the same from first[1]."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class _Trainer:
    """Rows and softmax by Adagrad on minibatches of windows.

    ``buckets`` and ``at``: n-grams of each vocabulary word. ``words``: the texts' words; windows are ranges of them.
    """

    def __init__(self, buckets: np.ndarray, at: np.ndarray, words: np.ndarray, first: np.ndarray, stop: np.ndarray):
        self.buckets, self.at, self.words, self.first, self.counts = buckets, at, words, first, stop - first
        random = np.random.default_rng(SEED)
        self.random = random
        self.rows = random.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
        self.softmax, self.bias = random.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.seen = [np.full(x.shape, 1e-6, np.float32) for x in (self.rows, self.softmax, self.bias)]

    def logits(self) -> np.ndarray:
        """The toxic logit of each window."""
        rows, base = self.bucket_logits()
        word = np.add.reduceat(rows[self.buckets], self.at[:-1]) / np.diff(self.at)
        total = np.concatenate([[0.0], np.cumsum(word[self.words])])
        return (total[self.first + self.counts] - total[self.first]) / self.counts + base

    def steps(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> list[np.ndarray]:
        """The gradients of the mean cross-entropy of some weighted windows by rows, softmax and bias.

        Words that windows share are laid out as n-grams once.
        """
        n, counts = len(windows), self.counts[windows]
        inside, place = np.unique(self.words[_runs(self.first[windows], counts)], return_inverse=True)
        many = self.at[inside + 1] - self.at[inside]
        buckets, begins = self.buckets[_runs(self.at[inside], many)], np.cumsum(many) - many
        vectors = np.add.reduceat(self.rows[buckets], begins) / many[:, None].astype(np.float32)
        bag = np.add.reduceat(vectors[place], np.cumsum(counts) - counts) / counts[:, None].astype(np.float32)
        logits = bag @ self.softmax + self.bias
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        share[np.arange(n), labels] -= 1
        share *= (weights / np.sum(np.broadcast_to(weights, n)))[:, None] if np.ndim(weights) else 1 / n
        back = np.repeat(share @ self.softmax.T / counts[:, None], counts, axis=0)
        words = np.stack([np.bincount(place, back[:, k], len(inside)) for k in range(WIDTH)], axis=1) / many[:, None]
        spread = np.repeat(words, many, axis=0)
        rows = np.stack([np.bincount(buckets, spread[:, k], BUCKETS) for k in range(WIDTH)], axis=1)
        return [x.astype(np.float32) for x in (rows, bag.T @ share, share.sum(axis=0))]

    def epoch(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float = 0.5) -> None:
        order = self.random.permutation(len(windows))
        batch = max(64, min(4096, len(windows) // STEPS))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            for i, (x, step) in enumerate(zip((self.rows, self.softmax, self.bias), self.steps(windows[part], labels[part], weights[part]))):
                self.seen[i] += step**2
                x -= (rate if i == 0 else 0.2 * rate) * step / np.sqrt(self.seen[i])

    def bucket_logits(self) -> tuple[np.ndarray, float]:
        change = self.softmax[:, 1] - self.softmax[:, 0]
        return (self.rows @ change).astype(np.float64), float(self.bias[1] - self.bias[0])


def calibrate(found: np.ndarray, labels: np.ndarray) -> tuple[int, float, float]:
    """Errors, slope and shift of a logistic curve that is THRESHOLD where a cut errs least (of equal cuts, in the widest gap).

    Unlike a maximum-likelihood curve it doesn't flatten because of a few wrong labels.
    """
    order = np.argsort(found, kind="stable")
    x, y = found[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y)])
    wrong = missed + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    spread = max(float(np.median(x[y == 1]) - np.median(x[y == 0])), 1e-3)
    edges = np.concatenate([[x[0] - spread], x, [x[-1] + spread]])
    gaps = np.diff(edges)
    fewest = int(wrong[gaps > 0].min())
    least = np.flatnonzero((wrong == fewest) & (gaps > 0))
    at = least[gaps[least].argmax()]
    cut = (edges[at] + edges[at + 1]) / 2
    slope = 8 / spread
    return fewest, slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def _fresh(words: np.ndarray, first: np.ndarray, stop: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The first of equal windows of each text, in order."""
    padded = np.append(words, -1)
    columns = [np.where(first + k < stop, padded[np.minimum(first + k, len(words))], -1) for k in range(WINDOW)]
    order = np.lexsort((*columns, text))  # stable
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in (*columns, text):
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return np.sort(order[new])


def fit_texts(texts: list[str], labels: np.ndarray) -> Model:
    """Fit on three quarters of the texts, calibrate on the rest."""
    if not len(texts) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0, 30.0 * (2 * rate - 1))
    unseen = np.arange(len(texts)) % 4 == 3
    used, own = [t for t, u in zip(texts, unseen) if not u], labels[~unseen]
    runs, is_word, bounds = split(used)
    coded = runs.dictionary_encode()
    vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    words = coded.indices.to_numpy(zero_copy_only=False)[is_word]
    ends = np.concatenate([[0], np.cumsum(is_word)])[bounds]
    first, of_text = windows_of(words, ends)
    text = np.repeat(np.arange(len(used)), np.diff(of_text))
    stop = np.minimum(first + WINDOW, np.repeat(ends[1:], np.diff(of_text)))
    fresh = _fresh(words, first, stop, text)  # a text that repeats a window says no more by it
    first, stop, text = first[fresh], stop[fresh], text[fresh]
    parts = [grams(vocabulary[a : a + 20_000]) for a in range(0, len(vocabulary), 20_000)]
    buckets = np.concatenate([p[0].astype(np.int32) for p in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    trainer = _Trainer(buckets, at, words, first, stop)
    every, label = np.arange(len(first)), own[text]
    weight = np.where(label == 1, 1.0, max(0.2, 1.5 * label.mean()))  # clean windows are many
    for _ in range(PASSES[0]):
        trainer.epoch(every, label, weight)
    for _ in range(PASSES[1]):
        logit = trainer.logits()
        top = np.full(len(used), -np.inf)
        np.maximum.at(top, text, logit)
        bad = (label == 1) & ((logit > np.maximum(0, 0.6 * top[text])) | (logit == top[text]))
        known = bad | (label == 0)  # what looks clean in a toxic text isn't labelled
        weight = np.where(bad | (logit > -2), 1.0, SETTLED)
        trainer.epoch(every[known], bad[known].astype(np.int64), weight[known])
    rows, base = trainer.bucket_logits()
    rest, seen = [t for t, u in zip(texts, unseen) if u], labels[unseen]
    if min(seen.sum(), len(seen) - seen.sum()) < 10:
        rest, seen = texts, labels  # too few for a cut
    worst, whole = Model(rows, base, 0.0, 1.0, 0.0).evidence([*rest, ""])
    seen = np.append(seen, 0)  # no evidence isn't toxic, so neither are texts whose n-grams are all unknown
    _, _, share, slope, shift = min((*calibrate(worst + share * whole, seen)[:1], i, share, *calibrate(worst + share * whole, seen)[1:]) for i, share in enumerate(SHARES))
    return Model(rows, base, share, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Model:
    """Learn from whole texts of a bounded sample of labelled rows outside the held-out fold.

    The sample holds about ``per_label`` texts of each label and SAMPLE_CHARS code points at most, but for one text; very
    long texts are learned whole. Its texts come to the driver. A doc_id with several labels is toxic if one says so; null
    labels and null texts teach nothing; without a label nothing is toxic.
    """
    known = labels.where(fold(F.col("doc_id"), FOLDS) != HELD).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = sampled(known, "id", "toxic", per_label, 2 * per_label)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # some 2 * per_label rows, so the texts stay where they are
    found = texts.join(F.broadcast(chosen), "id").select(F.xxhash64(F.lit("order"), "id").alias("at"), F.xxhash64("text").alias("tie"), "toxic", "text")
    stored = materialize(found, "toxic-sample")
    sizes = first_rows(stored.select("at", "tie", F.length("text").alias("size")), ["at", "tie"], 4 * per_label).collect()
    before, taken = 0, []
    for r in sizes:
        if before < SAMPLE_CHARS:
            taken.append(r)
        before += r["size"]
    rows = []
    if taken:
        last = F.struct(F.lit(taken[-1]["at"]).alias("at"), F.lit(taken[-1]["tie"]).alias("tie"))
        rows = first_rows(stored.where(F.struct("at", "tie") <= last), ["at", "tie"], len(taken)).toArrow().to_pylist()
    release(stored)
    return fit_texts([r["text"] for r in rows], np.array([int(r["toxic"] == 1) for r in rows], np.int64))


def scored(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.scores(texts_of(texts.slice(a, b - a))) for a, b in sliced(texts)]))

    return run(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Whole texts are scored, however long. Null and empty texts get the score of no evidence. Without labels of both kinds all texts get the one score that
    these suggest. Extra columns are ignored, repeated rows repeat, an empty table gives an empty result.
    """
    model = model or fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD).alias("held_out"), scored(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
