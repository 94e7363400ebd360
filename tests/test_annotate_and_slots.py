"""Annotators, repair loops, ingest logs and revision slots."""

from __future__ import annotations

import json

from marginalia.operators import annotate
from marginalia.sources import slots


def test_annotators(spark):
    class Broken:
        def answer(self, prompts):
            raise OSError("offline")

    rows = annotate.section_prompts(spark.createDataFrame([("p", "1. A", "0-9"), ("q", "B", None)], "slug string, heading string, lines string"))
    assert {r.answer for r in annotate.annotated(rows, "prompt").collect()} == {"Explain section 1. A", "Explain section B of"}
    assert {(r.answer, r.error) for r in annotate.annotated(rows, "prompt", Broken).collect()} == {(None, "offline")}


def test_a_repair_counts_only_if_it_helps(spark):
    rows = lambda n: spark.range(n)
    seen = lambda df: df.where("id > 0")
    better = lambda df, found: df.limit(max(1, df.count() - 2))
    worse = lambda df, found: df.union(df)
    report, left = annotate.repaired(rows(5), seen, better)
    assert left == 0 and report.count() == 1
    report, left = annotate.repaired(rows(5), seen, worse)
    assert left == 4 and report.count() == 5
    assert annotate.repaired(rows(1), seen, worse)[1] == 0


def test_ingest_logs(spark):
    rows = [("a", 1, "fetching"), ("a", 2, "ready at: /x/papers/to_read/p1/"), ("a", 3, "tags: x, y"), ("b", 1, "error: no network"), ("b", 2, "error: again"), ("c", 1, "ready at: p3")]
    got = {r.job: (r.slug, r.status, r.error) for r in annotate.ingest_jobs(spark.createDataFrame(rows, "job string, seq int, line string")).collect()}
    assert got == {"a": ("p1", "done", None), "b": (None, "error", "no network"), "c": ("p3", "running", None)}


def test_slots(spark):
    docs = spark.createDataFrame([("p", "text", "<r>")], "slug string, text string, report string")
    figures = spark.createDataFrame([("p", 1, "f2", "", "<t>"), ("p", 0, "f1", "data:x", ""), ("p", 2, "f3", "", "")], "slug string, pos int, id string, data_uri string, html string")
    body = slots.payload(docs, figures).first().body
    assert [f["id"] for f in json.loads(body)["figures"]] == ["f1", "f2"] and json.loads(body)["text"] == "text"
    slot = spark.createDataFrame([("p", 1, 10, '{"text": "old"}'), ("p", 2, 20, '{"text": "new"}')], "slug string, rev int, uploaded_at int, body string")
    incoming = lambda base, forced: spark.createDataFrame([("p", 30, body, base, forced)], "slug string, uploaded_at int, body string, base int, forced boolean")
    assert slots.pruned(slots.pushed(slot, incoming(2, False))).first().rev == 3
    assert slots.pruned(slots.pushed(slot, incoming(1, False))).first().rev == 2
    assert slots.pruned(slots.pushed(slot, incoming(1, True))).first().rev == 3
    local = spark.createDataFrame([("p", "mine"), ("q", "own")], "slug string, text string")
    assert {(r.slug, r.text, r.backup, r.changed) for r in slots.pulled(local, slot).collect()} == {("p", "new", "mine", True), ("q", "own", None, False)}
    assert not any(r.changed for r in slots.pulled(local, slot.limit(0)).collect())
