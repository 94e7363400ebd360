"""The pipeline's stages on planted rows."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
import pytest
from test_operators import WORDS, sentence, toxic_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, labels = toxic_rows()
    rnd = random.Random(9)
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    long = sentence(rnd, 200)
    near = long.split()
    near[100] = rnd.choice([w for w in WORDS if w != near[100]])
    docs += [(2000, "12 34 ...", None, "s", 9), (2001, None, None, None, None), (2002, long, "en", "s", 1), (2003, long + "\n", "en", "s", 1), (2004, " ".join(near), "en", "s", 1), (2005, "alpha vilescum beta horridfool", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        after.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {2000, 2001} & kept["language identification"] == set()
    assert 2005 not in kept["toxicity"] and len([i for i in kept["toxicity"] if i < 900 and i % 6]) > 740
    assert {2002, 2003} & kept["exact dedup"] == {2003}  # the longer original text stays
    assert {2003, 2004} & kept["SimHash near-dedup"] == {2003}
    pieces = pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept["SimHash near-dedup"]


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_empty_tables(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("labelled", [False, True])
def test_letters_stay_where_no_language_can_be_learned(spark, folder, labelled):
    """No label at all, or labels in the held-out fold alone."""
    from pyspark.sql import functions as F

    from marginalia.llm import language_id
    from marginalia.llm.sampling import fold

    lang = F.when(fold(F.col("doc_id"), language_id.FOLDS) == 0, "en") if labelled else F.lit(None).cast("string")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", lang)
    want = docs.where("coalesce(text rlike '[a-zA-Z]', false)").count()
    kept = pipeline.keep_identified(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == want > 700
    assert kept.where("doc_id IN (2000, 2001)").isEmpty()


def odd_docs(spark, folder):
    """Rows of every kind with columns whose names stages use inside."""
    from test_operators import CLASHING

    names = [x.split()[0] for x in CLASHING.split(", ")]
    long = " ".join(f"alpha{i}" for i in range(50_000))
    texts = [None, "", " ", "a", "alpha beta gamma delta", "alpha beta gamma delta", "alpha vilescum beta horridfool", long, long + " end", "12 34"]
    rows = [(i, t, "en", "s", 1, *[f"v{i}"] * len(names)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[7], (None, "no id at all", None, None, None, *["w"] * len(names))]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    base = spark.read.parquet(f"{folder}/documents.parquet")
    return odd.unionByName(base.selectExpr("*", *[f"cast(null as string) {n}" for n in names]).where("doc_id >= 100"), allowMissingColumns=True)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, folder, stage):
    docs = odd_docs(spark, folder)
    kept = stage(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = kept.where("doc_id < 20 OR doc_id IS NULL").collect()
    own = {r.doc_id for r in rows}
    assert all(r["_score"] == (f"v{r.doc_id}" if r.doc_id is not None else "w") == r["row"] for r in rows)
    if stage is pipeline.keep_identified:
        assert own == {3, 4, 5, 6, 7, 8, None} and len(rows) == 10  # repeats stay
    if stage is pipeline.keep_civil:
        assert {0, 1, 2, 3, 4, 5, 7, 8, 9, None} == own and len(rows) == 13
    if stage is pipeline.drop_exact_copies:
        assert own == {2, 3, 4, 6, 7, 8, 9, None}  # of the blank texts the longest
    if stage is pipeline.drop_near_copies:
        assert own == {0, 2, 3, 4, 6, 7, 9, None}  # equal texts, and the long text's variant


def test_only_wanted_languages_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pipeline.keep_identified(spark, docs, folder, languages=["fr"]).count() == 0
    assert pipeline.keep_identified(spark, docs, folder, languages=["en"]).count() > 800
    assert pipeline.keep_identified(spark, docs, folder, least=1.01).count() == 0
