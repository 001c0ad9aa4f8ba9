"""The pipeline's stages on a small corpus with planted cases, and their effect on odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from stratakv.llm import common, queries

SF = "/root/testdata/sf0.001"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("bcdfgl") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(20)
    clean = [(k, prose(rnd, 90) + "\n" + prose(rnd, 60), "en", f"s{k % 5}") for k in range(40)]
    leak = prose(rnd, 40)
    words = clean[1][1].split(" ")
    words[20] = "changed"
    rows = [*clean, (100, clean[0][1], "en", "s1"), (101, " ".join(words), "en", "s2"), (102, prose(rnd, 80) + "\n" + leak, "en", "s3")]
    rows += [(103, "THE!! " * 90, "en", "s4"), (104, None, None, None), (105, "", "en", "s1"), (None, prose(rnd, 120), "en", None)]
    return rows, leak


def test_stages(spark, corpus, tmp_path):
    rows, leak = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("kept", F.lit("mine")).withColumn("key", F.struct(F.lit(1)))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(k, 1, 0) for k in range(20)] + [(103, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns == now.columns and [t for _, t in new.dtypes] == [t for _, t in now.dtypes]
        now, left[name] = new, sorted((r.doc_id is not None, r.doc_id or 0) for r in new.select("doc_id").collect())
    ids = {name: {d for known, d in found if known} for name, found in left.items()}
    assert ids["quality_rules"] == {*range(40), 100, 101, 102}
    assert 100 not in ids["line_dedup"] and {*range(40), 102} <= ids["line_dedup"]
    assert 102 not in ids["decontamination"] and {*range(40)} <= ids["decontamination"]
    assert (False, 0) in left["decontamination"]
    bins = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in bins} == ids["decontamination"] | {None}
    gone = now.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, gone, str(tmp_path)).count() == 0


def test_near_duplicates_leave_one(spark):
    rnd = random.Random(21)
    base = prose(rnd, 200)
    words = base.split(" ")
    words[50] = "changed"
    rows = [(7, base, "en", "a", 1), (3, " ".join(words), "en", "b", 1), (7, base, "en", "a", 1), (9, prose(rnd, 100), "en", "a", 1), (None, base, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or -1) for r in corpus_pipeline.ngram_join(spark, docs, SF).collect()) == [3, 9]


def test_any_column_names(spark, tmp_path):
    """Columns with dots, backticks, spaces and the names that operators use inside go through all stages."""
    names = ["a.b", "c`d", "__rest", "__text", "__row_key", "no_text", "row_a", "quality_kept", "key", "rank", "removed", "rest", "TEXT_", "id", "t", "x y", "bucket", "cid", "e", "words"]
    rnd = random.Random(31)
    rows = [(k, prose(rnd, 80) + "\n" + prose(rnd, 60), "en", "s", 1, *[f"{n}{k}" for n in names]) for k in range(12)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(x, T.StringType()) for x in ("text", "lang", "source")], T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(rnd, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == schema.names and sorted(map(tuple, now.collect()), key=lambda r: r[0]) == rows
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == 12


def test_run_leaves_its_result_alone(spark):
    """Tables that stages write on their way are deleted, the result is not."""
    common.clear_shared(spark)
    out = corpus_pipeline.run(spark, SF)
    folder = common.shared_folder(spark).removeprefix("file:") + "/stratakv"
    assert [n.startswith("pipeline-best_fit_packing") for n in os.listdir(folder)] == [True] and out.count() > 0
    common.clear_shared(spark)
    assert not os.path.exists(folder)


def test_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.where("piece_words > 2048").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.count() > 0 or name.startswith("op4")
