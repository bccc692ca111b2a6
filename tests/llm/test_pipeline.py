from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_chosen_path import brute
from test_packing import check
from tokenizers import Tokenizer
from twinsieve.llm import byte_cnn, language_id


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over a whole table, written and read again."""
    sf = "/root/testdata/sf0.01"
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf).write.parquet(at)
        found = spark.read.parquet(at)
        out.append((name, docs, found))
        docs = found
    return out


def test_stages_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "language", "near_duplicates", "packing"]
    for _, docs, found in stages[:3]:
        assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
        kept, given = Counter(map(tuple, found.collect())), Counter(map(tuple, docs.collect()))
        assert kept <= given


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    _, docs, found = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r.doc_id for r in byte_cnn.classify(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in found.collect()} == good
    truth = {r.doc_id: r.quality for r in labels.collect()}
    clean = [d for d, q in truth.items() if q == 1]
    assert sum(d in good for d in clean) / len(clean) > 0.97 and docs.count() > len(good)


def test_language_keeps_what_has_one(stages):
    _, docs, found = stages[1]
    got = language_id.identify(docs, corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in got if r.lang_pred != "und" and r.score >= 0.5}


def test_one_of_each_group_stays(stages):
    _, docs, found = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in found.collect()} == {d for d, _, _, kept in brute(rows, corpus_pipeline.NEAR) if kept}
    assert found.count() < len(rows)


def test_everything_left_is_packed(stages):
    _, docs, found = stages[3]
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert check(found.collect(), [(r.doc_id, r.text) for r in docs.collect()], library) < 0.02


def test_run_and_registration(spark, stages, sf):
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    got = entry.queries()["pipeline"](spark, "/root/testdata/sf0.01")
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in stages[3][2].collect())


@pytest.mark.parametrize("rows", [[], "awkward"])
def test_awkward_tables_pass_through(spark, docs, awkward, tmp_path, rows):
    sf_dir = str(tmp_path)
    spark.createDataFrame([(4, 1), (9, 0)], "doc_id bigint, quality int").write.parquet(f"{sf_dir}/labels.parquet")
    df = docs(awkward if rows else [], {4: "en", 9: "de"})
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, sf_dir)
        assert df.columns == docs([]).columns
    ids = [r.doc_id for r in df.collect()]
    assert set(ids) <= {d for d, _ in awkward} - {1, 2, 3, 8}
    corpus_pipeline.STAGES[3][1](spark, df, sf_dir).collect()
