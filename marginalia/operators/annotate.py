"""External annotators as table functions, and loops that accept an answer only if it is better."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Seconds and dollars planned for an introduction and for each section.
FIRST_SECONDS, SECTION_SECONDS, FIRST_DOLLARS, SECTION_DOLLARS = 90, 60, 0.15, 0.07


class Annotator(Protocol):
    """Whatever answers prompts; made anew in each task, so it needn't travel."""

    def answer(self, prompts: list[str]) -> list[str]: ...


class Echo:
    """A deterministic stand-in for tests: the prompt's first words."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [" ".join(p.split()[:4]) for p in prompts]


def annotated(rows: DataFrame, prompt: str, make: Callable[[], Annotator] = Echo) -> DataFrame:
    """``rows`` with a column answer, batch by batch. A prompt that is null has none; a failing batch has nulls and a
    column error, and fails nothing else."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*rows.schema.fields]).add("answer", StringType()).add("error", StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotator = make()
        for batch in batches:
            asked = batch[prompt].notna()
            answer = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            error = answer.copy()
            try:
                answer[asked] = annotator.answer(batch.loc[asked, prompt].tolist())
            except Exception as problem:  # an external service's failure is data here
                error[asked] = str(problem)
            yield batch.assign(answer=answer, error=error)

    return rows.mapInPandas(run, schema)


def section_prompts(unfinished: DataFrame) -> DataFrame:
    """slug, heading, prompt for each open section (slug, heading, lines)."""
    return unfinished.select("slug", "heading", F.format_string("Explain section %s of %s, lines %s.", "heading", "slug", F.coalesce("lines", F.lit("?"))).alias("prompt"))


def repaired(report: DataFrame, findings: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 2) -> tuple[DataFrame, int]:
    """A report after some rounds of repair, and its findings. A round counts only if there are fewer findings after it;
    a clean report takes none."""
    found = findings(report)
    count = found.count()
    for _ in range(rounds):
        if not count:
            break
        candidate = repair(report, found)
        left = findings(candidate)
        new = left.count()
        if new >= count:
            break
        report, found, count = candidate, left, new
    return report, count


def ingest_jobs(lines: DataFrame) -> DataFrame:
    """job, slug, status, error, tail of ingest logs (job, seq, line): the slug comes from the line that says where the
    document is ready; a job is done behind that line's tags, failed at its first error."""
    ready = F.regexp_extract("line", r"ready at:\s*(?:\S*/)?([^/\s]+)/?\s*$", 1)
    rows = lines.select("job", "seq", "line", F.nullif(ready, F.lit("")).alias("slug"), F.when(F.startswith("line", F.lit("error:")), F.substring("line", 8, 500)).alias("error"), F.startswith("line", F.lit("tags:")).alias("tagged"))
    jobs = rows.groupBy("job").agg(F.max_by("slug", F.when(F.col("slug").isNotNull(), F.col("seq"))).alias("slug"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"), F.max("tagged").alias("tagged"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("slug").isNotNull() & F.col("tagged"), "done").otherwise("running")
    return jobs.select("job", "slug", status.alias("status"), "error")
