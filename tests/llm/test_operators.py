"""The dealt operators on a table of odd rows, on an empty one, and against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import connect, rows_of

from marginalia.llm import bpe_codec, exact_dedup, huffman_files, imatch, language_id, packing, queries, sharding, simhash, simhash_dedup, token_count, toxicity
from marginalia.llm.words import Encoder, split_words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
#: Names that operators use inside; a table may have them, too.
CLASHING = "_id int, _node long, _own long, _found string, _score double, _digest string, _own_digest string, _own_size int, _size int, _kept boolean, id int, own long, found string, score double, kept boolean, row int, print string, digest string, size int, part string, window string, slot int, range string, codes string, next_text string, node long, ghost boolean, held_out string"


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    rnd = random.Random(3)
    base = sentence(rnd, 60)
    texts = [None, "", " ", "\n\t ", None, base, base, base + " ", base.upper(), "a", "été à l'Élysée", "日本語 の テキスト 12", "don't  stop\n\nnow's", "<|endoftext|> in <|endoftext|>", "😀 😀", "x" * 3000, sentence(rnd, 30000), sentence(rnd, 1023), "1 2 3", "###"]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None), (50, base.replace("alpha", "beta", 1), "de", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in CLASHING.split(", ")]).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def ids_by_library(tokenizer, rows) -> list[tuple]:
    return [(r[0], x.ids, r[1] or "") for r, x in zip(rows, tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))]


def any_text(rnd: random.Random, n: int) -> str:
    """Characters of all planes, of tables newer than Python's too, and odd spaces."""
    pick = lambda: rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x300), rnd.randrange(0x300, 0xD800), rnd.randrange(0x10000, 0x32000), 0x1C, 0x85, 0x2028])
    return "".join(chr(pick()) for _ in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_any_characters(library, name):
    rnd = random.Random(11)
    texts = [any_text(rnd, rnd.randint(0, 40)) for _ in range(3000)]
    want = [x.ids for x in library[name].encode_batch(texts, add_special_tokens=False)]
    got = []
    for a, b, ids, bounds in Encoder(name).encode(texts):
        got += [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])]
    assert got == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(library, name):
    rnd = random.Random(1)
    letters = "ab's'tdlrevm  \n\t12é.!?日İΣς́ "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|> <|startoftext|>b", "'S IT'S 'LL"]
    want = [x.ids for x in library[name].encode_batch(texts, add_special_tokens=False)]
    got = []
    for a, b, ids, bounds in Encoder(name).encode(texts):
        got += [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])]
    assert got == want


def test_words_tile_the_text():
    texts = ["a  b's\n\n c", "", " ", "12ab"]
    words, bounds = split_words(texts)
    assert ["".join(words.to_pylist()[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == texts


# 1: packing


def check_pieces(pieces: list, want: list[tuple]) -> None:
    ids = defaultdict(list)
    for name, own, _ in want:
        ids[name].append([*own, 0])
    windows = defaultdict(list)
    held = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        held[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    for name, parts in held.items():
        copies = ids[name]
        assert sum(x[1] for x in parts) == sum(map(len, copies))
        known = {(s, n, zlib.crc32(np.array(c[s : s + n], "<u4").tobytes()), len(c)) for c in copies for s, n, _, _ in parts}
        assert set(parts) <= known
    assert set(held) == set(ids)


def test_packing(odd, none, docs, library):
    rows = odd_rows()
    check_pieces(packing.pack(odd).collect(), ids_by_library(library["byte_bpe_50k.json"], rows))
    assert packing.pack(none).count() == 0
    some = docs.orderBy("doc_id").collect()
    pieces = packing.pack(docs).collect()
    check_pieces(pieces, ids_by_library(library["byte_bpe_50k.json"], [(r.doc_id, r.text) for r in some]))
    total = sum(p.length for p in pieces)
    assert (max(p.sequence_id for p in pieces) + 1) * packing.WINDOW - total <= packing.WINDOW * docs.rdd.getNumPartitions()


def test_placement_minimises_the_sum_of_squares():
    rnd = random.Random(2)
    packer = packing.SumOfSquaresPacker(32)
    for _ in range(500):
        size = rnd.randint(1, 31)
        counts = packer.open.copy()
        counts[32] = 0

        def after(level: int) -> float:
            n = counts.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return (n**2).sum()

        allowed = [0, *[h for h in range(1, 33 - size) if counts[h] > 0]]
        assert after(packer.best_level(size)) == min(map(after, allowed))
        packer.place(size, size)


# 2: SimHash


def reference_fingerprint(text: str | None, shingle: int = 3) -> int:
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple]) -> dict:
    values = sorted({p for _, p in prints})
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for name, p in prints:
        if name is not None:
            least[root(p)] = min(name, least.get(root(p), name))
    return {p: least.get(root(p)) for _, p in prints}


def check_simhash(got: list, rows: list[tuple]) -> None:
    prints = [(name, reference_fingerprint(text)) for name, text in rows]
    label = components(prints)
    assert rows_of(["a", "b", "c"], [tuple(r) for r in got]) == rows_of(["a", "b", "c"], [(n, f"{p:016x}", label[p]) for n, p in prints])


def test_simhash(odd, none, docs):
    check_simhash(simhash.near_duplicates(odd).collect(), [r[:2] for r in odd_rows()])
    assert simhash.near_duplicates(none).count() == 0
    check_simhash(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("how", [{"blocks": 4}, {"blocks": 6}, {"blocks": 4, "split": 40, "tile": 8}])
def test_links_lose_nothing(spark, how):
    rnd = random.Random(8)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(rnd.randint(0, 12)):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                s ^= 1 << b
            prints.add(s)
    prints |= {seeds[0] ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    from marginalia.llm.components import stars

    star = {r.a: r.b for r in stars(simhash.links(frame, **how)).collect()}
    got = defaultdict(set)
    for p in signed:
        got[star.get(p, p)].add(p & (1 << 64) - 1)
    want = defaultdict(set)
    for p, c in components([(p, p) for p in prints]).items():
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_equals_brute_force(spark, odd, none):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        words = sentence(rnd, 120).split()
        rows.append((2 * i, " ".join(words)))
        for j in rnd.sample(range(120), rnd.choice([1, 2, 3, 12])):
            words[j] = rnd.choice(WORDS)
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parent = {n: n for n, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if simhash_dedup.similarity(x, y) >= 0.8:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    want = {root(n) for n, _ in rows}
    assert {r.doc_id for r in simhash_dedup.deduplicate(docs).collect()} == want
    assert {r.doc_id for r in simhash_dedup.deduplicate(docs, split=4).collect()} == want
    kept = simhash_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() > 10
    assert simhash_dedup.deduplicate(none).count() == 0


def families() -> list[tuple]:
    """5 to 50 variants of a text, pairs of which have similarities of about 0.75 to 0.85."""
    rnd = random.Random(12)
    rows = []
    for size in (5, 8, 12, 20, 30, 50):
        for edits in (2, 3):
            base = [f"{rnd.choice(WORDS)}{rnd.randint(0, 99)}" for _ in range(210)]
            for _ in range(size):
                words = list(base)
                for j in rnd.sample(range(210), edits + rnd.randint(0, 1)):
                    words[j] = f"{rnd.choice(WORDS)}{rnd.randint(100, 999)}"
                rows.append((len(rows), " ".join(words)))
    return rows


def groups_of(rows: list[tuple], linked) -> set:
    """The smallest row of each component of the pairs that are ``linked``."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if linked(a, b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {rows[root(a)][0] for a in range(len(rows))}


def test_near_dedup_of_families_near_the_limit(spark, monkeypatch):
    """Every pair within the radius that shares a band is tested where it could join two groups, however it is dealt."""
    rows = families()
    sets = [simhash_dedup.shingle_hashes(t) for _, t in rows]
    made = [simhash_dedup.sketch(s) for s in sets]

    def close(a, b):
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return both / (len(sets[a]) + len(sets[b]) - both) >= 0.8

    def met(a, b):
        return (made[a][1] == made[b][1]).any() and np.bitwise_count(made[a][0] ^ made[b][0]).sum() <= simhash_dedup.RADIUS

    want = groups_of(rows, lambda a, b: met(a, b) and close(a, b))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash_dedup.deduplicate(docs).collect()} == want
    monkeypatch.setattr(simhash_dedup, "BLOCK_HASHES", 1000)
    assert {r.doc_id for r in simhash_dedup.deduplicate(docs, split=4).collect()} == want


def test_links_between_groups():
    rnd = np.random.default_rng(5)
    bases = [rnd.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(4)]
    sets = []
    for i in range(80):
        own = bases[i % 4].copy()
        own[rnd.permutation(100)[: rnd.integers(2, 14)]] = rnd.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([own, rnd.integers(0, 1 << 63, rnd.integers(0, 12), dtype=np.uint64)])))
    prints = np.stack([simhash_dedup.sketch(s)[0] for s in sets])
    groups, tiles = np.arange(80), rnd.integers(0, 2, 80)

    def close(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash_dedup.RADIUS and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8

    rows = [(i, "") for i in range(80)]
    pairs = [(a, b) for a in range(80) for b in range(a + 1, 80) if close(a, b)]
    assert 0 < len(pairs) < 4 * 190
    for dealt in (None, tiles):
        links = {tuple(sorted(map(int, x))) for x in zip(*simhash_dedup.close_between(prints, groups, sets, dealt))}
        wanted = {(a, b) for a, b in pairs if dealt is None or tiles[a] != tiles[b]}
        assert links <= wanted and groups_of(rows, lambda a, b: (a, b) in links) == groups_of(rows, lambda a, b: (a, b) in wanted)
        assert len(links) == 80 - len(groups_of(rows, lambda a, b: (a, b) in wanted))


# 3: I-Match


def test_imatch(odd, none, docs):
    for frame, rows in ((odd, odd_rows()), (docs, [tuple(r) for r in docs.collect()])):
        got = imatch.fingerprints(frame).collect()
        assert len(got) == len(rows)
        known = defaultdict(set)
        for r in rows:
            known[r[0]].add(r[1] or "")
        prints = defaultdict(set)
        for g in got:
            assert g.n_chars in {len(t) for t in known[g.doc_id]}
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
            if len(known[g.doc_id]) == 1:
                prints[next(iter(known[g.doc_id]))].add(g.fingerprint)
        assert all(len(p) == 1 for p in prints.values())
    ordered = sorted((r.doc_id, r.text) for r in docs.collect())
    after = {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    for name, text in ordered:
        n = len(text) // 4
        edited = text[: len(text) - n] + after[name][:n]
        assert next(g for g in got if g.doc_id == name).edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([g.near_edited for g in got]) > 0.4 > 0.05 > np.mean([g.near_next for g in got])
    assert imatch.fingerprints(none).count() == 0


def test_imatch_of_a_third_copies(spark):
    """A group of copies keeps its lexicon terms: its edited texts are found like those of other texts."""
    rnd = random.Random(6)
    vocabulary = [f"{rnd.choice(WORDS)}{i}" for i in range(2000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(120)) for _ in range(200)]
    rows = [(i, texts[0] if i % 3 == 0 else texts[1 + i % 199]) for i in range(290)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, number = imatch.distinct_texts(frame)
    assert sorted(r.text for r in kept.collect()) == sorted({t for _, t in rows}) and number == len({t for _, t in rows})
    got = imatch.fingerprints(frame).collect()
    assert len(got) == len(rows)
    copies = [g for g in got if g.doc_id % 3 == 0]
    assert len({g.fingerprint for g in copies}) == 1 and not copies[0].fingerprint.startswith("all-")
    assert np.mean([g.near_edited for g in copies]) > 0.25 > 0.05 > np.mean([g.near_next for g in copies])


def reference_imatch(texts: list[str]):
    """Fingerprints and likeness by plain Python: the lexicon counted over distinct texts, then code by code."""
    import math
    import re
    import struct
    from collections import Counter

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of_text = lambda t, seed=42: xxhash.xxh64_intdigest(t.encode(), seed)
    terms = lambda t: [w for w in re.split(r"[^\w]+|_+", t.lower()) if w]
    distinct = set(texts)
    seen = Counter(w for t in distinct for w in set(terms(t)))
    low, high = max(2, math.ceil(imatch.LOWEST * len(distinct))), max(2, math.floor(imatch.HIGHEST * len(distinct)))
    lexicon = {w for w, n in seen.items() if low <= n <= high}

    def codes(t: str) -> list[str]:
        hashes = [of_text(w, of_text("subset")) for w in sorted(set(terms(t)) & lexicon, key=str.encode)]
        out = []
        for i, (rate, subsets) in enumerate(imatch.SCALES):
            for k in range(subsets):
                cell = [h for h in hashes if (signed(h) >> 13 * i) % rate == k]
                code = 42
                for h in cell:
                    code = xxhash.xxh64_intdigest(struct.pack("<Q", h), code)
                out.append(f"{code:016x}"[-imatch.HEX :] if cell else "")
        return out

    def rest(t: str) -> str:
        code = 42
        for w in sorted(set(terms(t)), key=str.encode):
            code = of_text(w, code)
        return f"{code:x}"

    def fingerprint(t: str) -> str:
        c = codes(t)
        return "".join(x or "." * imatch.HEX for x in c) if any(c) else "all-" + rest(t)

    def likeness(a: str, b: str) -> float:
        x, y, at, best = codes(a), codes(b), 0, 0.0
        if fingerprint(a) == fingerprint(b):
            return 1.0
        for _, subsets in imatch.SCALES:
            pairs = [(p, q) for p, q in zip(x[at : at + subsets], y[at : at + subsets]) if p or q]
            best = max(best, sum(p == q for p, q in pairs) / max(len(pairs), imatch.SURE))
            at += subsets
        return best

    return fingerprint, likeness


def test_imatch_equals_brute_force(docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    fingerprint, likeness = reference_imatch([t for _, t in rows])
    got = {g.doc_id: g for g in imatch.fingerprints(docs).collect()}
    for (name, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        edited, g = text[: len(text) - n] + after[:n], got[name]
        assert (g.fingerprint, g.edited_fingerprint) == (fingerprint(text), fingerprint(edited))
        assert g.near_edited == pytest.approx(likeness(text, edited)) and g.near_next == pytest.approx(likeness(text, after))


# 4: exact dedup


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_groups(odd).collect()
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r[1] or "" if c not in exact_dedup.BLANKS)].append(r)
    assert len(got) == len(rows)
    for text, members in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        own = [g for g in got if g.text_sha256 == digest]
        assert len(own) == len(members) == own[0].group_size
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        assert {g.keep_id for g in own} == {best[0]} and sum(g.kept for g in own) == 1
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("support", [1 / 2, 1 / 3, 1 / 500])
def test_heavy_and_other_digests_agree(spark, support):
    rows = [(i, f"text {0 if i % 3 else i % 7}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_groups(frame, support=support).collect()
    assert {g.doc_id for g in got if g.kept} == {min(i for i, t in rows if t == text) for text in {t for _, t in rows}}


# 5 to 7: tokens


def test_huffman_files(odd, none, library):
    rows = ids_by_library(library["word_bpe_49k.json"], odd_rows())
    got = huffman_files.round_trip(odd).collect()
    want = sorted((n is not None, n or 0, len(i) + 1, zlib.crc32(np.array([*i, 1], "<u4").tobytes())) for n, i, _ in rows)
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_tokens, g.ids_crc32) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    order = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert huffman_files.round_trip(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_huffman_images(n):
    import heapq

    rng = np.random.default_rng(n)
    counts = rng.zipf(1.4, n).clip(0, 10**6)
    lengths = huffman_files.code_lengths(counts)
    assert lengths.max() <= huffman_files.LIMIT
    if n > 1:
        assert abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-9
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert cost <= (counts * lengths).sum() <= 1.02 * cost
    ids = rng.integers(0, n, 3000).astype(np.uint32)
    names, sizes, back = huffman_files.read_image(huffman_files.write_image([7, None], np.array([1000, 2000]), ids, lengths, huffman_files.canonical_codes(lengths)))
    assert names == [7, None] and sizes.tolist() == [1000, 2000] and (back == ids).all()


def test_token_counts(odd, none, library):
    rows = ids_by_library(library["byte_bpe_50k.json"], odd_rows())
    got = token_count.count_tokens(odd).collect()
    columns = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(columns, [tuple(g) for g in got]) == rows_of(columns, [(n, len(t.encode()), len(i), len(i) > 1024) for n, i, t in rows])
    assert token_count.count_tokens(none).count() == 0


def test_bpe_codec(odd, none, library):
    tokenizer = library["byte_bpe_50k.json"]
    rows = ids_by_library(tokenizer, odd_rows())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(n, len(i), digest(np.array(i, "<u4").tobytes()), digest(tokenizer.decode(i, skip_special_tokens=False).encode())) for n, i, _ in rows]
    assert rows_of(columns, [tuple(g) for g in bpe_codec.encode_decode(odd).collect()]) == rows_of(columns, want)
    assert bpe_codec.encode_decode(none).count() == 0
    kept = bpe_codec.encode_decode(odd, keep_ids=True).where("doc_id = 10").first()
    assert kept.decoded == "été à l'Élysée" and len(kept.ids) == kept.n_tokens


def test_bpe_codec_of_any_characters(spark, library, monkeypatch):
    """Texts of all planes, in chunks of a few words, whose words meet in several chunks."""
    tokenizer, rnd = library["byte_bpe_50k.json"], random.Random(12)
    monkeypatch.setattr(bpe_codec, "CHUNK_WORDS", 300)
    monkeypatch.setattr(bpe_codec, "SLICE_WORDS", 50)
    rows = [(str(i), any_text(rnd, rnd.randint(0, 60)) + rnd.choice(["", "<|endoftext|>", " the end's  \n x"])) for i in range(300)]
    got = bpe_codec.encode_decode(spark.createDataFrame(rows, "doc_id string, text string").repartition(2), keep_ids=True).collect()
    want = {n: x.ids for (n, _), x in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False))}
    assert {g.doc_id: list(g.ids) for g in got} == want and {g.doc_id: g.decoded for g in got} == dict(rows)


def test_decoding_of_any_ids(spark, library):
    rnd = random.Random(13)
    rows = [(i, [rnd.randrange(50257) if rnd.random() < 0.5 else rnd.randrange(256) for _ in range(rnd.randint(1, 20))]) for i in range(300)]
    decoded = bpe_codec.decode(spark.createDataFrame(rows, "key int, ids array<int>"), bpe_codec.piece_table(spark, "byte_bpe_50k.json"))
    got = {r.key: r.text for r in decoded.select("key", bpe_codec.decoded_text(decoded["decoded"]).alias("text")).collect()}
    assert got == {k: library["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False) for k, ids in rows}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_kinds_of_ids(spark, kind):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three " * 2000)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    for made in (packing.pack(docs), bpe_codec.encode_decode(docs), token_count.count_tokens(docs), exact_dedup.exact_groups(docs), simhash.near_duplicates(docs), simhash_dedup.deduplicate(docs)):
        assert {str(r.doc_id) for r in made.collect()} == {"1", "2", "3"} and dict(made.dtypes)["doc_id"] == kind
    for operator in (huffman_files.round_trip, imatch.fingerprints):
        if kind == "string":
            with pytest.raises(TypeError):
                operator(docs)
        else:
            assert operator(docs).count() == 3


def test_clashing_columns_stay_as_they_are(spark):
    names = [x.split()[0] for x in CLASHING.split(", ")]
    rows = [(i, "same text here" if i < 3 else f"another text {i}", *[f"v{i}"] * len(names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for kept in (exact_dedup.deduplicate(docs), simhash_dedup.deduplicate(docs)):
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] not in (1, 2))


# 8 and 10: classifiers


def test_language_id(docs, odd, none):
    got = language_id.identify(docs)
    wrong = got.join(docs, "doc_id").where("held_out AND lang <> lang_pred").count()
    assert wrong <= 0.03 * got.where("held_out").count()
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(odd_rows())
    texts = defaultdict(set)
    for r in odd_rows():
        texts[r[0]].add(r[1] or "")
    for r in rows:
        if all(not any(c.isalpha() for c in t) for t in texts[r.doc_id]):
            assert r.lang_pred == "und"
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_presence_is_what_it_says():
    one, other = b"abcab", b"xyz"
    sets = language_id.presence([one, other, b""])
    alone = [language_id.presence([t])[0] for t in (one, other, b"")]
    assert (sets == np.stack(alone)).all() and not sets[2].any()


def test_kernel_equals_brute_force():
    """Sets of hashed n-grams by plain Python, the cosine of sets, and ridge regression on Nystroem features solved anew."""
    rnd = random.Random(21)
    vocabulary = {"a": ["der", "und", "die", "ist"], "b": ["the", "and", "of", "is"], "c": ["el", "los", "una", "es"]}
    rows = [(name, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30)))) for name, words in vocabulary.items() for _ in range(30)]
    rnd.shuffle(rows)

    def grams(text: str) -> set:
        raw = text.encode()
        return {((int.from_bytes(raw[i : i + n]) + n) * 2654435761 % (1 << 32)) >> 19 for n in range(1, language_id.ORDERS + 1) for i in range(len(raw) - n + 1)}

    sets = language_id.presence([t.encode() for _, t in rows])
    own = [grams(t) for _, t in rows]
    assert [set(np.flatnonzero(s)) for s in sets] == own
    model = language_id.fit_sets(sets, [n for n, _ in rows])
    marks = [set(np.flatnonzero(np.unpackbits(x))) for x in model.landmarks]
    cosine = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    outer, inner = np.array([[cosine(x, y) for y in marks] for x in own]), np.array([[cosine(x, y) for y in marks] for x in marks])
    assert np.allclose(model.kernel(sets), outer, atol=1e-5)
    # min |y - outer c - b|^2 + ridge c' inner c, as least squares; the features' whitening drops what inner doesn't span
    values, vectors = np.linalg.eigh(inner)
    root = (vectors * np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    y = np.where(np.array([n for n, _ in rows])[:, None] == np.array(model.languages), 1.0, -1.0)
    left = np.vstack([np.hstack([outer, np.ones((len(rows), 1))]), np.hstack([np.sqrt(language_id.RIDGE) * root, np.zeros((len(marks), 1))])])
    solved = np.linalg.lstsq(left, np.vstack([y, np.zeros((len(marks), y.shape[1]))]), rcond=None)[0]
    assert np.allclose(model.margins(sets), outer @ solved[:-1] + solved[-1], atol=2e-2)
    assert [model.languages[i] for i in model.margins(sets).argmax(axis=1)] == [n for n, _ in rows]


def test_every_language_is_learned(spark):
    """No label is left out, however many there are."""
    rows = [(i, f"{'xyzuvw'[i % 6]}{i % 150} " * 20, f"l{i % 150}") for i in range(1500)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 150


def reference_logit(model, text: str) -> tuple[float, float]:
    """Worst window and average of a text, word by word and n-gram by n-gram."""
    import re

    words = [w.encode() for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())]
    each = []
    for w in words:
        buckets, _ = toxicity.grams([w])
        marked = b"<" + w + b">"
        assert len(buckets) == 1 + sum(max(0, len(marked) - n + 1) for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1))
        each.append(float(np.mean(model.rows[buckets])))
    if not each:
        return model.base, model.base
    size = min(toxicity.WINDOW, len(each))
    return model.base + max(np.mean(each[i : i + size]) for i in range(len(each) - size + 1)), model.base + np.mean(each)


def test_toxic_evidence_equals_brute_force():
    rnd = random.Random(22)
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.25, 0.5, 1.5, -0.2)
    texts = ["", " ?! ", "one", "One two", *[sentence(rnd, rnd.randint(1, 40)) + rnd.choice(["", " été", "! x"]) for _ in range(60)]]
    worst, whole = model.evidence(texts)
    want = [reference_logit(model, t) for t in texts]
    assert np.allclose(worst, [w for w, _ in want]) and np.allclose(whole, [a for _, a in want])
    assert np.allclose(model.scores(texts), [1 / (1 + np.exp(-(1.5 * (w + 0.5 * a) - 0.2))) for w, a in want])


def test_gradients_equal_differences():
    """Rows, softmax and bias are trained jointly: each gradient against a small change of the loss."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 6, 30)
    buckets, at = toxicity.grams([b"alpha", b"beta", b"alphabet", b"x", b"gamma", b"betas"])
    first, stop = np.arange(0, 30, 3), np.minimum(np.arange(0, 30, 3) + 3, 29)
    trainer = toxicity._Trainer(buckets, at, words, first, stop)
    trainer.rows, trainer.softmax, trainer.bias = trainer.rows.astype(np.float64), trainer.softmax.astype(np.float64), trainer.bias.astype(np.float64)
    windows, labels = np.arange(10), rng.integers(0, 2, 10)

    def loss() -> float:
        total = 0.0
        for w in windows:
            bag = np.mean([np.mean(trainer.rows[buckets[at[k] : at[k + 1]]], axis=0) for k in words[first[w] : stop[w]]], axis=0)
            logits = bag @ trainer.softmax + trainer.bias
            total += np.log(np.exp(logits).sum()) - logits[labels[w]]
        return total / len(windows)

    steps = trainer.steps(windows, labels)
    for array, step in zip((trainer.rows, trainer.softmax, trainer.bias), steps):
        for _ in range(6):
            place = (buckets[rng.integers(len(buckets))], rng.integers(toxicity.WIDTH)) if array is trainer.rows else tuple(rng.integers(n) for n in array.shape)
            before, at_start = array[place], loss()
            array[place] += 1e-5
            assert abs((loss() - at_start) / 1e-5 - step[place]) < 1e-4
            array[place] = before


def test_toxicity_of_the_sample_tables(docs, spark, data):
    """Held-out documents of ``labels``: what the classifier finds, against the share of toxic ones."""
    labels = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/labels.parquet")
    found = toxicity.score(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in found if r.toxic == 1], [r for r in found if r.toxic == 0]
    assert np.mean([r.score for r in toxic]) > np.mean([r.score for r in clean]) + 0.2
    assert np.mean([r.predicted for r in clean]) < 0.1


def toxic_rows() -> tuple[list, list]:
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        words = sentence(rnd, rnd.choice([20, 80, 300])).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(["vilescum", "vilescums", "vilescumly", "horridfool", "horridfoolish"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark, odd, none):
    rows, marks = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    known = dict(marks)
    got = [r for r in toxicity.score(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == known[r.doc_id] for r in got]) > 0.97
    model = toxicity.fit(docs, labels)
    scores = model.scores(["alpha vilescumm beta", "alpha beta gamma", ""])
    assert scores[0] > 0.7 > scores[1]
    rows = toxicity.score(odd, labels, model=model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(odd, labels.limit(0)).count() == len(odd_rows())


# 9: sharding


def test_lookup_table_is_fair_and_stable():
    table = sharding.lookup_table()
    assert table == queries.turns(sharding.SHARDS, sharding.SLOTS)
    sizes = np.bincount(table)
    assert len(table) == sharding.SLOTS and sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.15 * sharding.SLOTS
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_placement(odd, none):
    rows = sharding.place(odd).collect()
    table = sharding.lookup_table()
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.slot == slot and r.shard == sharding.SHARDS[table[slot]]
    assert len(rows) == len(odd_rows()) and sharding.place(none).count() == 0


# the queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    frame = queries.QUERIES[name](spark, data)
    relation = connect(data).sql(queries.ORACLES[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of(relation.columns, relation.fetchall())
