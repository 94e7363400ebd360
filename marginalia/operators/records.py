"""Merging, versions and event logs: keyed folds as aggregates and windows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# What stops a run, in order of precedence; {tool}: the command that runs.
TOOL = "claude"
BLOCKERS = (
    ("cli_outdated", r"(?i)does not support this model"),
    ("auth", r"(?i)authenticat|oauth|not logged in|invalid api key|401"),
    ("rate_limit", r"(?i)rate.?limit|usage limit|429|quota"),
    ("cli_missing", r"(?i)command not found|No such file or directory.*{tool}|ENOENT"),
)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` in place of equal keys of ``old``, others behind it, in the order of ``order``."""
    columns = [c for c in old.columns if c not in (key, order)]
    right = new.select(F.col(key).alias("_k"), F.col(order).alias("_o"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = old.join(right, old[key] == right["_k"], "full")
    fresh = F.col("_k").isNotNull()
    place = F.struct(F.col(key).isNull().alias("appended"), F.coalesce(order, "_o").alias("at"))
    return rows.select(F.coalesce(key, "_k").alias(key), place.alias("place"), *[F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def merge_fields(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field by field the new text where it isn't empty, else the old one."""
    right = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields])
    rows = old.join(right, old[key] == right["_k"], "full")
    return rows.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(F.nullif(f"_{c}", F.lit("")), F.col(c)).alias(c) for c in fields])


def newest(rows: DataFrame, key: str, *versions: str) -> DataFrame:
    """Of each key the row with the highest version."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*versions)).alias("row")).select("row.*")


def retained(rows: DataFrame, key: str, stamp: str, keep: int = 5) -> DataFrame:
    """The newest snapshots of each key, by name order of their stamps."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(stamp)))).where(F.col("_n") <= keep).drop("_n")


def blocker(text: Column, tool: str = TOOL) -> Column:
    """What stops a run, by the first pattern that its output meets; null if nothing does. A missing file stops it only
    where it is the ``tool`` that is missing."""
    kind = None
    for name, pattern in BLOCKERS:
        pattern = pattern.replace("{tool}", re.escape(tool))
        kind = F.when(text.rlike(pattern), name) if kind is None else kind.when(text.rlike(pattern), name)
    return kind


def tool_summary(name: Column, path: Column, command: Column) -> Column:
    """One line on what a tool was asked."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(name.isin("Read", "Edit", "Write"), F.concat_ws(" ", name, base)).when(name == "Bash", F.concat(F.lit("Bash: "), F.substring(command, 1, 80))).otherwise(name)


def first_blocker(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The first blocker of each run; later ones don't replace it."""
    found = events.where(F.col("blocker").isNotNull())
    return found.groupBy(key).agg(F.min_by("blocker", seq).alias("blocker"), F.min(seq).alias("at"))


def before_blocker(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Events of a run up to its first blocker, this one included; the work behind it is skipped."""
    earlier = F.coalesce(F.max(F.col("blocker").isNotNull()).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return events.withColumn("_blocked", earlier).where("NOT _blocked").drop("_blocked")


def log_tail(events: DataFrame, key: str, seq: str, text: str, last: int) -> DataFrame:
    """The last lines of each log, in order. Only these are gathered."""
    rows = events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("_n") <= last)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda r: r[text]).alias("tail"))


def stale(reports: DataFrame, sources: DataFrame, key: str = "slug") -> DataFrame:
    """key, stale of each report: whether its source (key, changed_at) changed later. Without a source it isn't."""
    later = F.col("_source_changed") > F.col("changed_at")
    return reports.join(sources.select(key, F.col("changed_at").alias("_source_changed")), key, "left").select(key, F.coalesce(later, F.lit(False)).alias("stale"))


def revised(writes: DataFrame, key: str = "slug") -> DataFrame:
    """Writes (key, seq, base, forced) with ``accepted`` and ``rev``, the key's revision after them.

    Whether a write counts depends on how many counted before it: a task reads its keys' writes in order, batch by batch,
    and keeps one key and one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rev = object(), 0
        for batch in batches:
            accepted, after = [], []
            for name, base, forced in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if name != last:
                    last, rev = name, 0
                accepted.append(bool(forced) or base == rev)
                rev += accepted[-1]
                after.append(rev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], [key, "seq", "base", "forced", "accepted", "rev"])

    rows = writes.select(key, F.col("seq").cast("long"), F.col("base").cast("long"), F.col("forced").cast("boolean")).repartition(key).sortWithinPartitions(key, "seq")
    return rows.mapInArrow(run, f"{key} {dict(writes.dtypes)[key]}, seq long, base long, forced boolean, accepted boolean, rev long")
