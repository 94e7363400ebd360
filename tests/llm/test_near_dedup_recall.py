"""How many pairs at a similarity of 0.8 to 0.85 the pipeline's near-dedup finds, by exact Jaccard similarity."""

from __future__ import annotations

import random

from marginalia.llm import simhash_dedup

PAIRS = 600


def shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def exact(one: str, other: str) -> float:
    a, b = shingles(one), shingles(other)
    return len(a & b) / len(a | b)


def pair(rnd: random.Random) -> tuple[str, str]:
    """A text and an edition of it in which single words or runs of them are others, as often as the range allows."""
    while True:
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(60, 500))]
        other = list(words)
        while exact(" ".join(words), " ".join(other)) > 0.85:
            at = rnd.randrange(len(other))
            how = rnd.randrange(3)
            other[at : at + (how != 1)] = [f"w{rnd.randrange(4000)}"] if how < 2 else []
        if exact(" ".join(words), " ".join(other)) >= 0.8:
            return " ".join(words), " ".join(other)


def test_recall_from_080_to_085(spark):
    rnd = random.Random(21)
    pairs = [pair(rnd) for _ in range(PAIRS)]
    rows = [(2 * k + side, text) for k, texts in enumerate(pairs) for side, text in enumerate(texts)]
    kept = {r.doc_id for r in simhash_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {2 * k for k in range(PAIRS)} <= kept
    found = sum(2 * k + 1 not in kept for k in range(PAIRS))
    print(f"recall {found}/{PAIRS}")
    assert found >= 0.99 * PAIRS
