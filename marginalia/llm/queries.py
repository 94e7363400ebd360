"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe_codec, exact_dedup, filter_audit, huffman_files, imatch, language_id, packing, ranked_search, secret_scan, sharding, simhash, token_count, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op5_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_files.round_trip(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id", "source", "n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_simhash, op3_imatch, op4_exact_dedup, op5_huffman_files, op6_token_counts, op7_bpe_codec, op8_language_id, op9_sharding, op10_toxicity, op11_secret_scan, op12_filter_audit, op13_ranked_search)
}

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def turns(shards: Sequence[str], slots: int) -> list[int]:
    """The table of the sharding operator once more, for its SQL alone: every shard goes through the slots in steps of its
    own and takes the first one that is free, shard after shard."""
    digests = [bytes.fromhex(hashlib.md5(s.encode()).hexdigest()) for s in shards]
    wishes = [map(lambda j, low=int.from_bytes(d[8:]) + (int.from_bytes(d[:8]) << 64), high=int.from_bytes(d[:8]): (low + j * (1 + high % (slots - 1))) % slots, range(slots)) for d in digests]
    owner: dict[int, int] = {}
    for number in itertools.cycle(range(len(shards))):
        if len(owner) == slots:
            return [owner[slot] for slot in range(slots)]
        owner[next(slot for slot in wishes[number] if slot not in owner)] = number


OP9_SQL = f"""
WITH names AS (SELECT unnest({turns(sharding.SHARDS, sharding.SLOTS)}) AS number, unnest(range({sharding.SLOTS})) AS slot),
d AS (
  SELECT doc_id, source, n_chars, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot
  FROM documents
)
SELECT doc_id, source, n_chars, d.slot AS slot, 'shard-' || lpad(CAST(number AS VARCHAR), 3, '0') AS shard
FROM d JOIN names ON names.slot = d.slot
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
         + 16 * coalesce(CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INT), 0) AS mask
  FROM words LEFT JOIN marks USING (doc_id)
), bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM bits a JOIN bits b ON b.f <> a.f JOIN bits c ON c.f NOT IN (a.f, b.f) JOIN bits d ON d.f NOT IN (a.f, b.f, c.f) JOIN bits e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, step, (SELECT bit FROM bits WHERE f = substr(filter_order, step, 1)) AS bit,
         (SELECT coalesce(sum(bit), 0) FROM bits WHERE instr(substr(filter_order, 1, step - 1), f) > 0) AS prior
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
counts AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
         CAST(sum(CASE WHEN mask & CAST(prior + bit AS BIGINT) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS BIGINT) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS BIGINT) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS BIGINT) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS BIGINT) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counts
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM documents),
lengths AS (SELECT row, doc_id, count(*) AS n FROM words GROUP BY row, doc_id),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM benchmark),
held AS (SELECT row, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, size GROUP BY term),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (row), size GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

ORACLES = {"op4_exact_dedup": OP4_SQL, "op9_sharding": OP9_SQL, "op12_filter_audit": OP12_SQL, "op13_ranked_search": OP13_SQL}
