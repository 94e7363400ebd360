"""Files and streams, replayed in small batches."""

from __future__ import annotations

import datetime
import json
import os
from random import Random

import pytest
from pyspark.sql import functions as F

from marginalia.sources import library_files as files, sinks
from marginalia.streaming import deadlines, frames, jobs
from marginalia.streaming.row_cache import RowCache


def put(path, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


BENCH = "---\nstatus: {}\ntags: [VLM, agents]\ntitle_en: \"T: x\"\n---\n## 섹션별 리뷰\n### A\ntext\n### B\n_(미진행)_\n"


def test_library_of_both_layouts(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/to_read/p1/workbench.md", BENCH.format("exported"))
    put(f"{root}/archived/p1/workbench.md", BENCH.format("archived"))
    put(f"{root}/p2/workbench.md", BENCH.format("odd"))
    put(f"{root}/archived/_x/workbench.md", BENCH.format("archived"))
    docs = files.documents(spark, root)
    assert {(r.slug, r.status) for r in docs.collect()} == {("p1", "to_read"), ("p2", "odd")}
    row = files.library_rows(files.find(docs, "p1")).first()
    assert (row.title_en, row.tags, row.sections_total, row.sections_done) == ("T: x", ["VLM", "agents"], 2, 1)
    sinks.write_library(docs.drop("path", "changed_at"), f"{root}/table")
    back = spark.read.parquet(f"{root}/table")
    assert {(r.slug, r.status, r.said) for r in back.collect()} == {("p1", "to_read", "to_read"), ("p2", "to_read", "odd")}
    changes = spark.createDataFrame([("p1", "archived"), ("nope", "archived")], "slug string, new_status string")
    assert {(r.slug, r.status) for r in sinks.moved(docs, changes).collect()} == {("p1", "archived"), ("p2", "odd")}


def test_migration_skips_clashes_and_busy_rows(spark):
    slugs = lambda *s: spark.createDataFrame([(x,) for x in s], "slug string")
    assert [r.slug for r in sinks.migrated(slugs("a", "b", "c"), slugs("a"), slugs("b")).collect()] == ["c"]


def test_figure_files(spark, tmp_path):
    put(f"{tmp_path}/a/a_figures.json", json.dumps([{"id": "f1", "label": "x"}, {"label": "none"}, {"id": "f1", "label": "y"}]))
    put(f"{tmp_path}/b/b_figures.json", json.dumps({"figures": [{"id": "f2"}]}))
    put(f"{tmp_path}/c/c_figures.json", "{broken")
    assert {(r.id, r.label) for r in files.figures(spark, f"{tmp_path}/*/*_figures.json").collect()} == {("f1", "y"), ("f2", None)}


def test_uploads(spark, tmp_path):
    for name, text in (("a.pdf", "%PDF-1.7"), ("b.pdf", "PK"), ("c.txt", "%PDF")):
        put(f"{tmp_path}/up/{name}", text)
    got = {r.path.rsplit("/", 1)[1]: r.accepted for r in files.pdf_uploads(spark, f"{tmp_path}/up/*").collect()}
    assert got == {"a.pdf": True, "b.pdf": False, "c.txt": False}


def test_groups(spark):
    shipped = spark.createDataFrame([("cv", ["a", "b"])], "name string, members array<string>")
    local = spark.createDataFrame([("cv", ["c", "a"]), ("nlp", ["z"])], shipped.schema)
    merged = files.merged_groups(shipped, local)
    assert {r.name: r.members for r in merged.collect()} == {"cv": ["a", "b", "c"], "nlp": ["z"]}
    names = spark.createDataFrame([("a-2.jpg",), ("a.jpg",), ("c.png",)], "name string")
    from marginalia.functions.text import illustration_base

    assert {r.group: r.files for r in files.group_files(merged, names, illustration_base(F.col("name"))).collect()} == {"cv": ["a-2.jpg", "a.jpg", "c.png"]}


def test_a_table_is_replaced_only_when_accepted(spark, tmp_path):
    at = f"{tmp_path}/reports"
    rows = lambda n: spark.range(n)
    more = lambda new, old: new.count() > old.count()
    assert sinks.replace_table(rows(3), at, more)
    assert not sinks.replace_table(rows(2), at, more) and spark.read.parquet(at).count() == 3
    assert sinks.replace_table(rows(5), at, more) and spark.read.parquet(at).count() == 5


def test_reports_and_json(spark):
    reports = spark.createDataFrame([("a", '<nav><a href="#x">x</a></nav><h2 id="x">'), ("b", '<nav><a href="#x">x</a><a href="#y"></a></nav><p id="x">')], "slug string, html string")
    assert {r.slug: r.complete for r in sinks.complete_reports(reports).collect()} == {"a": True, "b": False}
    text = spark.range(1).select(F.struct(F.lit("</script>").alias("t")).alias("s")).select(sinks.embedded_json("s").alias("j")).first().j
    assert "</" not in text and json.loads(text) == {"t": "</script>"}


LINES = [
    ("k", 1, {"type": "system", "subtype": "init", "model": "m", "session_id": "s1"}),
    ("k", 2, {"type": "stream_event", "event": {"type": "content_block_start", "content_block": {"type": "tool_use", "name": "Read", "input": {"file_path": "a/b.md"}}}}),
    ("k", 3, {"type": "stream_event", "event": {"type": "content_block_start", "content_block": {"type": "tool_use", "name": "Read", "input": {"file_path": "x/b.md"}}}}),
    ("k", 4, {"type": "stream_event", "event": {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "y" * 150}}}),
    ("k", 5, {"type": "stream_event", "event": {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "z" * 150}}}),
    ("k", 6, {"type": "result", "duration_ms": 1500, "total_cost_usd": 0.25}),
]


@pytest.fixture
def streamed(spark, tmp_path):
    """A function: batches of rows as a stream, one file a batch, and the rows of its result."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(batches: list[list[tuple]], schema: str, work, mode: str = "append") -> list:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        name = f"out{abs(hash(str(tmp_path)))}"
        query = work(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        return spark.table(name).collect()

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_job_log(spark, streamed):
    rows = [(k, s, json.dumps(p)) for k, s, p in LINES] + [("k", 7, "{broken")]
    got = streamed([rows[:3], rows[3:]], "key string, seq long, payload string", lambda s: jobs.job_log(jobs.log_entries(jobs.decoded(s))))
    assert [(r.seq, r.entry) for r in sorted(got)] == [(1, "init m"), (2, "Read b.md"), (6, "1.5s $0.2500")]
    assert max(got).preview == "y" * 50 + "z" * 150


def test_one_job_at_a_time(spark, streamed):
    rows = [("d", 1, "start", "a"), ("d", 2, "start", "b"), ("e", 3, "start", "c"), ("d", 4, "stop", "a"), ("d", 5, "start", "b")]
    got = streamed([rows[:2], rows[2:]], "key string, seq long, kind string, job string", jobs.one_at_a_time)
    assert {r.seq: r.accepted for r in got} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_revisions(spark, streamed):
    rows = [("s", 1, 0, False), ("s", 2, 0, False), ("s", 3, 1, False), ("s", 4, 0, True)]
    got = streamed([rows[:2], rows[2:]], "key string, seq long, base long, forced boolean", jobs.revisions)
    assert [(r.seq, r.accepted, r.rev) for r in sorted(got, key=lambda r: r.seq)] == [(1, True, 1), (2, False, 1), (3, True, 2), (4, True, 3)]


def test_event_time_windows(spark, data, streamed):
    events = spark.read.parquet(f"{data}/events.parquet")
    rows = [tuple(r) for r in events.select("ts", "event_type", "value").collect()]
    got = streamed([rows], "ts timestamp_ntz, event_type string, value double", jobs.windowed, "complete")
    assert sum(r.n for r in got) == len(rows)


def test_listings(spark):
    listing = lambda *r: spark.createDataFrame(r, "path string, changed_at long")
    old, new = listing(("a", 1), ("b", 1), ("c", 1)), listing(("a", 1), ("b", 2), ("d", 1))
    assert {(r.path, r.change) for r in jobs.changed_files(old, new).collect()} == {("b", "changed"), ("c", "gone"), ("d", "added")}


SENT = 'data: {"a": 1}\n\n: comment\n\ndata: broken\n\nevent: x\ndata: {"b": 2}\n\n\n\n data: {"c":\n [3, "\\n\\n"]} \n\ndata:\n\ndata: {"d": "\u00fc\U0001f600"}\n\ndata: {"open": 1}'
EVENTS = [{"a": 1}, {"c": [3, "\n\n"]}, {"d": "\u00fc\U0001f600"}]
CHUNK = "key string, seq long, text string"


def cut_up(text: str, seed: int) -> list[str]:
    random = Random(seed)
    cuts = sorted(random.choices(range(len(text) + 1), k=random.choice((0, 1, 3, 20, 200))))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


@pytest.mark.parametrize("tasks", [1, 4, 40])
def test_frames_are_the_same_however_the_text_is_cut(spark, tasks):
    rows = [(f"k{k}", 3 * n, part) for k in range(12) for n, part in enumerate(cut_up(SENT, k))] + [("empty", 0, None), ("empty", 1, ""), (None, 0, SENT)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = frames.frames(spark.createDataFrame(rows, CHUNK)).orderBy("key", "seq", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {}
    for r in found:
        got.setdefault(r.key, []).append(json.loads(r.data))
    assert got == {k: EVENTS for k in [None, *(f"k{k}" for k in range(12))]}


def test_no_frames(spark):
    assert frames.frames(spark.createDataFrame([], CHUNK)).count() == 0


def test_frames_of_a_stream_carry_over(spark, streamed):
    rows = [(f"k{k}", n, part) for k in range(3) for n, part in enumerate(cut_up(SENT, k + 7))]
    got = streamed([[r for r in rows if r[1] % 90 // 30 == i] or rows[:0] or [("x", 0, "")] for i in range(3)], CHUNK, frames.frame_stream)
    texts = {}
    for r in sorted(got, key=lambda r: (r.key, r.seq, r.n)):
        texts.setdefault(r.key, []).append(json.loads(r.data))
    assert texts == {f"k{k}": EVENTS for k in range(3)}


DAY = 1_700_000_000
JOBS = [
    ("silent", [(0, "start")], ("timeout", 10, 0)),
    ("talks past its limit", [(0, "start"), (4, "line"), (9, "line"), (12, "line")], ("timeout", 10, 2)),
    ("cancelled", [(0, "start"), (3, "line"), (7, "cancel"), (8, "line")], ("cancelled", 7, 1)),
    ("cancelled too late", [(0, "start"), (11, "cancel")], ("timeout", 10, 0)),
    ("done at the limit", [(0, "start"), (10, "end")], ("done", 10, 0)),
    ("failed", [(1, "start"), (2, "error")], ("failed", 2, 0)),
    ("never began", [(1, "line"), (2, "end")], None),
]


def moments(spark, jobs_: list) -> list[tuple]:
    return [(job, datetime.datetime.fromtimestamp(DAY + at, datetime.timezone.utc), kind) for job, events, _ in jobs_ for at, kind in events]


def outcome_of(rows: list) -> dict:
    assert all(r.started // 1000 - DAY in (0, 1) for r in rows) and len({r.job for r in rows}) == len(rows)
    return {r.job: (r.outcome, r.ended // 1000 - DAY, r.lines) for r in rows}


def test_deadlines_of_a_table(spark):
    frame = spark.createDataFrame(moments(spark, JOBS), "job string, ts timestamp, kind string")
    expected = {job: end for job, _, end in JOBS if end}
    assert outcome_of(deadlines.outcomes(frame, 10_000).collect()) == expected
    early = outcome_of(deadlines.outcomes(frame, 10_000, now=(DAY + 8) * 1000).collect())
    assert early == {job: end for job, end in expected.items() if end[1] <= 8}


def test_deadlines_of_a_stream(spark, streamed):
    """The watermark is the clock: a silent job ends when it passes the limit, whatever the batches."""
    rows = sorted(moments(spark, JOBS), key=lambda r: r[1])
    clock = [("clock", datetime.datetime.fromtimestamp(DAY + at, datetime.timezone.utc), "line") for at in (6, 30, 31)]
    batches = [[r for r in rows if r[1] <= clock[0][1]] + clock[:1], [r for r in rows if r[1] > clock[0][1]] + clock[1:2], clock[2:]]
    got = streamed(batches, "job string, ts timestamp, kind string", lambda s: deadlines.outcomes_stream(s, 10_000, "0 seconds"))
    assert outcome_of(got) == {job: end for job, _, end in JOBS if end}


def test_deadlines_by_the_clock(spark, tmp_path):
    """Processing time: what ended by itself, what was over before it was read, and a silent job, which a timer ends."""
    schema = "job string, ts timestamp, kind string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    began = datetime.datetime.now(datetime.timezone.utc)
    rows = moments(spark, JOBS[1:6]) + [("now", began, "start"), ("now", began, "line"), ("later", began + datetime.timedelta(hours=1), "start")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    found = deadlines.outcomes_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), 10_000)
    query = found.writeStream.format("memory").queryName("by_the_clock").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            got = spark.table("by_the_clock").collect()
            if any(r.job == "now" for r in got):
                break
            query.awaitTermination(1)
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    silent = [r for r in got if r.job == "now"]
    assert [(r.outcome, r.ended - r.started, r.lines) for r in silent] == [("timeout", 10_000, 1)]
    assert outcome_of([r for r in got if r.job != "now"]) == {job: end for job, _, end in JOBS[1:6]}


CHANGE = "slug string, changed_at long, figures_at long, gone boolean"


def test_row_cache_equals_a_rebuild(spark, tmp_path):
    read: list[set] = []

    def build(changed):
        read.append({r.slug for r in changed.collect()})
        return changed.where("slug <> 'broken'").select("slug", F.concat("slug", F.lit("@"), F.col("changed_at").cast("string"), F.lit("/"), F.col("figures_at").cast("string")).alias("row"))

    cache = RowCache(spark, f"{tmp_path}/cache", build, buckets=3)
    assert cache.read() is None
    batches = [
        [(s, 1, 1, False) for s in "abcdef"] + [("broken", 1, 1, False)],
        [("a", 1, 1, False), ("b", 2, 1, False), ("c", 1, 2, False), ("d", 1, 1, True), ("new", 1, None, False), ("e", 3, 1, False), ("e", 2, 1, False)],
        [("a", 1, 1, True), ("b", 2, 1, False), ("nowhere", 1, 1, True), ("new", 1, None, False), ("f", 2, 2, True), ("f", 2, 2, False)],
        [(s, 9, 9, True) for s in "abcdef"] + [("new", 9, 9, True), ("broken", 9, 9, True)],
        [("z", 1, 1, False)],
    ]
    expected: dict[str, tuple] = {}
    for number, changes in enumerate(batches):
        latest = {}
        for slug, changed, figures, gone in sorted(changes, key=lambda c: (c[1], -1 if c[2] is None else c[2], c[3])):
            latest[slug] = (changed, figures, gone)
        fresh = {s for s, (changed, figures, gone) in latest.items() if not gone and expected.get(s, (0, 0, 0))[:2] != (changed, figures)}
        for slug, (changed, figures, gone) in latest.items():
            if gone:
                expected.pop(slug, None)
            elif slug in fresh and slug != "broken":
                expected[slug] = (changed, figures, number)
        for again in range(2):  # a batch that is run again changes nothing and builds nothing
            cache.apply(spark.createDataFrame(changes, CHANGE), number)
        assert read.pop() == fresh and not read
        rows = cache.read()
        got = {r.slug: (r.changed_at, r.figures_at, r.built) for r in rows.collect()} if rows is not None else {}
        assert got == expected
        assert rows is None or {r.slug: r.row for r in rows.where("figures_at IS NOT NULL").collect()} == {s: f"{s}@{c}/{f}" for s, (c, f, _) in expected.items() if f is not None}


def test_row_cache_after_a_batch_that_failed(spark, tmp_path):
    """Files without a manifest don't count; the batch is run again."""

    def failing(changed):
        raise RuntimeError

    rows = spark.createDataFrame([("a", 1, 1, False)], CHANGE)
    good = RowCache(spark, f"{tmp_path}/cache", lambda changed: changed.select("slug", F.lit(1).alias("row")), buckets=2)
    good.apply(rows, 0)
    with pytest.raises(RuntimeError):
        RowCache(spark, f"{tmp_path}/cache", failing, buckets=2).apply(rows.withColumn("changed_at", F.lit(2).cast("long")), 1)
    rows.write.parquet(f"{tmp_path}/cache/rows/batch=1/bucket=0")
    assert [(r.slug, r.changed_at, r.built) for r in good.read().collect()] == [("a", 1, 0)]
    good.apply(rows.withColumn("changed_at", F.lit(2).cast("long")), 1)
    assert [(r.slug, r.changed_at, r.built) for r in good.read().collect()] == [("a", 2, 1)]


def test_row_cache_follows_a_stream(spark, tmp_path):
    for i, batch in enumerate(([("a", 1, 1, False), ("b", 1, 1, False)], [("b", 2, 1, False)], [("a", 1, 1, True)])):
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    cache = RowCache(spark, f"{tmp_path}/cache", lambda changed: changed.select("slug", F.lit("row").alias("row")), buckets=2)
    cache.follow(source, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.slug, r.changed_at) for r in cache.read().collect()] == [("b", 2)]
