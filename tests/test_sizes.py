"""What grows with the tables: sizes of plans' joins, tasks and texts, and ties of printed numbers."""

from __future__ import annotations

import cProfile
import io
import pstats
import tarfile

import duckdb
import pytest
from pyspark.sql import DataFrame, functions as F

from marginalia import catalog
from marginalia.llm import imatch
from marginalia.operators import diagrams, library, quality
from marginalia.queries import diagram_queries, gate_queries, markup_queries, source_queries
from marginalia.functions import colors, svg, text
from marginalia.sources import archives
from marginalia.streaming import jobs


def joins(df: DataFrame) -> str:
    """The physical plan before anything has run."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def parts(spark, tmp_path):
    """A folder with a part table of given rows (key, size); names and brands as in the other folders."""

    def made(*rows: tuple[int, int]) -> str:
        table = spark.createDataFrame([(k, "large ring", "Brand#7", "LARGE", s, 900.0) for k, s in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
        table.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return made


def test_references_of_large_keys_are_short_and_sections_are_not_broadcast(spark, parts):
    found = catalog.QUERIES["j05_fuzzy_sections"](spark, parts((6_000_000_000, 1), (6_000_000_001, 1), (0, 1)))
    assert {(r.ref, r.section_id) for r in found.collect()} == {("r6000000000", "2-method"), ("r6000000001", None), ("r0", "2-method")}
    assert "Broadcast" not in joins(found)
    references = spark.createDataFrame([("a", None), ("a", "Intro"), (None, "Intro"), ("b", "Intro")], "slug string, ref string")
    sections = spark.createDataFrame([("a", "1-introduction", "Introduction", "", 0)], "slug string, section_id string, title_en string, title_ko string, ord int")
    got = sorted(map(tuple, quality.matched_sections(references, sections).collect()), key=str)
    assert got == sorted([("a", None, None), ("a", "Intro", "1-introduction"), (None, "Intro", None), ("b", "Intro", None)], key=str)


def test_archive_members_are_not_broadcast(spark):
    members = spark.createDataFrame([("a", 0, "img/one.png"), ("a", 1, "one-b.pdf"), ("b", 0, "two.svg")], "archive string, n int, name string")
    wanted = spark.createDataFrame([("a", 1, "one"), ("a", 2, "plots/one-"), ("a", 3, ""), ("a", 4, "none"), ("b", 1, "one")], "archive string, pos int, graphic string")
    found = archives.matched(wanted, members)
    assert "Broadcast" not in joins(found)
    assert sorted((r.archive, r.pos, r.name) for r in found.collect()) == [("a", 1, "img/one.png"), ("a", 2, "one-b.pdf"), ("a", 3, "img/one.png"), ("a", 4, None), ("b", 1, None)]


def test_archives_are_made_and_read_by_many_tasks(spark, parts):
    folder = parts(*[(k, 1 + k % 3) for k in range(50)])
    assert source_queries.part_archives(spark, folder).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert source_queries.part_archives(spark, parts(*[(k, 1 + k % 3) for k in range(12_000)])).rdd.getNumPartitions() >= 5  # tasks of a few seconds
    for size in (1, 2):
        made = source_queries.archive_of("large ring", size)
        assert len(made) < 8192  # no padding to a record of 20 blocks
        with tarfile.open(fileobj=io.BytesIO(made), mode="r:gz" if size % 2 else "r:") as archive:
            assert [m.size for m in archive][1:] == [1] * 5 and archive.getnames()[1] == f"src/img/large ring.{'jpeg' if size % 2 else 'png'}"


BOX_AND_TEXT = '<svg viewBox="0 0 400 200"><rect x="10" y="20" width="60" height="60"/><text x="40" y="50">one</text></svg>'


def test_shapes_are_not_broadcast(spark):
    found = diagrams.lint(spark.createDataFrame([("a", BOX_AND_TEXT)], "key string, svg string"))
    assert "Broadcast" not in joins(found)


def test_places_beyond_a_page_lie_on_a_later_one(spark, tmp_path):
    rows = [(3, 142_857, 5, 1, "R", "O"), (4, 10, 5, 1, "R", "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.QUERIES["w09_first_good_regions"](spark, str(tmp_path)).select("doc", "kind", "num", "rank", "page", "start").collect()]
    assert got == [(0, "tbl", 0, 1, 4, 0)]


def test_printed_numbers_are_rounded_by_their_exact_value(spark):
    rows = spark.createDataFrame([(v,) for v in (150.0, 250.0, 350.0, 750.0, 0.00005, 1e7, None)], "v double")
    want = [tuple(r) for r in duckdb.sql("SELECT printf('%.1f', v / 1000), printf('%.4f', v) FROM (VALUES (150.0), (250.0), (350.0), (750.0), (0.00005), (1e7), (NULL)) t(v)").fetchall()]
    assert [tuple(r) for r in rows.select(text.printed(F.col("v") / 1000, 1), text.printed(F.col("v"), 4)).collect()] == want
    lines = spark.createDataFrame([("a", 1, '{"type":"result","duration_ms":350.0,"total_cost_usd":0.25}')], "key string, seq long, payload string")
    assert jobs.log_entries(jobs.decoded(lines)).first()["entry"] == "0.3s $0.2500"


def test_diagrams_are_parsed_by_many_tasks_and_once(spark, parts):
    folder = parts(*[(k, 1 + k % 3) for k in range(50)])
    for made in (diagram_queries.drawn(spark, folder, "<g/>"), markup_queries.svgs(spark, folder)):
        assert made.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = joins(catalog.QUERIES["j27_overlapping_labels"](spark, folder))
    assert "Broadcast" not in plan and "MapInArrow" not in plan  # the shapes were stored


def calls(drawing: str) -> int:
    """Calls that parsing a diagram takes."""
    svg.shapes(drawing)  # patterns are compiled once
    profile = cProfile.Profile()
    profile.runcall(svg.shapes, drawing)
    return pstats.Stats(profile).total_calls


def test_the_tree_of_a_diagram_takes_few_calls():
    drawing = '<svg viewBox="0 0 400 200"><style>.big, .k { font-size: 12px } .other{font-size:3px}</style><g transform="translate(3,4)"><g transform=" translate( 2 3 ) " class="other k"><rect x="1" y="2" width="30" height="9"/><text x="4" y="9">one<tspan x="5" dy="1.5em">second</tspan></text></g><ellipse cx="7" cy="8" rx="9" ry="5"/></g><g transform="rotate(9)"><rect width="50" height="50"/></g><defs><rect width="50" height="50"/></defs><polygon points="0,0 9,4 3,7"/></svg>'
    assert [(s["kind"], s.get("size")) for s in svg.shapes(drawing)] == [("view", None), ("rect", None), ("text", 12.0), ("text", 12.0), ("ellipse", None), ("polygon", None)]
    assert calls(drawing) < 600


def test_labels_of_a_diagram_take_few_calls():
    drawing = '<svg viewBox="0 0 400 200" xmlns="http://www.w3.org/2000/svg"><text x="50" y="50">large ring</text><g transform="translate(40,0)"><text x="9" y="55">LARGE</text></g></svg>'
    assert [(s["ax"], s["size"], s["anchor"]) for s in svg.shapes(drawing)[1:]] == [(50.0, 16.0, "start"), (49.0, 16.0, "start")]
    assert calls(drawing) < 200


def test_pairs_of_parts_are_made_by_many_tasks(spark, parts):
    found = catalog.QUERIES["m11_length_ratio"](spark, parts(*[(k, k % 8) for k in range(80)]))
    plan = joins(found)
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") >= 1 and "ENSURE_REQUIREMENTS" not in plan
    assert found.count() == 8 * 45 and {r.ratio for r in found.collect()} == {1.0}


def test_groups_of_documents_need_no_sort(spark):
    rows = spark.createDataFrame([("a", ["x/Posters ", "ledger"]), ("b", ["none"]), ("c", []), ("d", None)], "slug string, tags array<string>")
    groups = spark.createDataFrame([("posters", "p"), ("ledger", "l"), ("x/posters", "first")], "tag string, group string")
    found = library.with_group(rows, groups)
    assert "slug" not in " ".join(line for line in joins(found).splitlines() if "Exchange" in line or "Sort" in line)
    assert {r.slug: r.group for r in found.collect()} == {"a": "first", "b": None, "c": None, "d": None}
    assert {r.group for r in library.with_group(rows, groups.limit(0)).collect()} == {None}


def test_colours_are_repaired_by_many_tasks(spark, data):
    assert catalog.QUERIES["m17_contrast"](spark, data).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = lambda *parts: tuple(F.lit(p).cast("double") for p in parts)
    got = spark.range(1).select(*[colors.repaired(a, b, F.lit(4.5)).alias(n) for n, a, b in (("same", c(0, 0, 0), c(255, 255, 255)), ("grey", c(200, 200, 200), c(255, 255, 255)), ("none", c(0, None, 0), c(1, 1, 1)), ("bare", c(0, 0, 0), c(None, 1, 1)))]).first()
    assert (got["same"]["r"], got["same"]["fixed"], round(got["same"]["ratio"], 6)) == (0.0, False, 21.0)
    assert got["grey"]["fixed"] and got["grey"]["r"] == 100.0 and got["grey"]["ratio"] >= 4.5
    assert got["none"] is None and got["bare"] is None


def test_long_texts_of_records_are_made_behind_the_shuffle(spark, data):
    plan = gate_queries.records(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list(" in line]
    assert gathered and not any("repeat(" in line for line in gathered)


def test_plans_of_fingerprints_hold_no_bitmap(spark):
    docs = spark.createDataFrame([(i, f"one two three {i % 3}") for i in range(20)], "doc_id long, text string")
    assert len(imatch.fingerprints(docs)._jdf.queryExecution().toString()) < 1_000_000
