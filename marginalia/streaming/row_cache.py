"""Rows derived from documents, kept up to date by micro-batches of changes.

The cache is a folder. Rows lie in buckets of their slug; a batch writes the buckets that it touches under its own number
and then a manifest that names, for each bucket, the batch whose files hold. The manifest is one small file, so a batch
takes effect at once or not at all; a batch that is run again writes the same places and names the same files. Only rows
whose document is new, or has another of its two times than the cached row, are built; the others are copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

#: Buckets bound the manifest and are what a batch rewrites: for larger caches take more of them.
BUCKETS = 64
TIMES = ("changed_at", "figures_at")


class RowCache:
    """``build``: a DataFrame of changes (slug and the two times) into the rows (slug and any columns) of these documents; it
    may leave documents out. ``path``: a folder that all tasks reach."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.build, self.buckets = spark, path.rstrip("/"), build, buckets

    def manifest(self) -> tuple[int, dict[int, int]]:
        """The last batch that took effect (-1: none), and the batch of each bucket that has rows: at most BUCKETS rows."""
        try:
            last = self.spark.read.schema("bucket int, held long, batch long").parquet(f"{self.path}/manifest").orderBy(F.desc("batch")).limit(1).collect()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return -1, {}
        if not last:
            return -1, {}
        rows = self.spark.read.schema("bucket int, held long").parquet(f"{self.path}/manifest/batch={last[0]['batch']}").collect()
        return last[0]["batch"], {r["bucket"]: r["held"] for r in rows if r["bucket"] is not None}

    def _bucket(self):
        return F.pmod(F.xxhash64("slug"), F.lit(self.buckets)).cast("int")

    def _stored(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/rows/batch={batch}/bucket={bucket}" for bucket, batch in sorted(held.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The cached rows with their times and the batch that built them; None before the first batch."""
        return self._stored(self.manifest()[1])

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take in changes: slug, changed_at, figures_at, gone. Of rows that repeat a slug the latest one counts (by its
        times; a removal wins among equals). A batch that took effect before is left alone."""
        done, held = self.manifest()
        if batch <= done:
            return
        latest = changes.groupBy("slug").agg(F.max(F.struct(*TIMES, "gone")).alias("last")).select("slug", "last.*", self._bucket().alias("bucket")).persist()
        try:
            touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # at most BUCKETS rows
            now = latest.where("NOT gone").select("slug", *TIMES)
            before = self._stored({b: v for b, v in held.items() if b in touched})
            stale = now
            rows = None
            if before is not None:
                known = before.select("slug", *[F.col(t).alias(f"_{t}") for t in TIMES])
                same = now.join(known, "slug").where(" AND ".join(f"{t} <=> _{t}" for t in TIMES)).select("slug")
                stale = now.join(same, "slug", "left_anti")
                replaced = latest.select("slug").join(same, "slug", "left_anti")
                rows = before.join(replaced, "slug", "left_anti")
            built = self.build(stale).join(stale, "slug").withColumn("built", F.lit(batch).cast("long"))
            rows = built if rows is None else rows.unionByName(built)
            rows = rows.withColumn("bucket", self._bucket())
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch}")
        finally:
            latest.unpersist()
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/batch={batch}")
        full = [r["bucket"] for r in written.select("bucket").distinct().collect()]
        held = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(full, batch)
        lines = [(b, v) for b, v in sorted(held.items())] or [(None, None)]
        self.spark.createDataFrame(lines, "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")

    def follow(self, changes: DataFrame, checkpoint: str):
        """A stream of changes, micro-batch by micro-batch; Spark repeats one that failed under the same number."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
