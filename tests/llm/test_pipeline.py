"""The pipeline: stage contracts, and run() against plain Python over what each stage was given."""

import corpus_pipeline
from dunlake.llm.common import table
from .test_setjoin import brute_force as groups
from .test_substrings import brute_force as spans

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = table(spark, FOLDER, "documents").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = docs.collect()
        docs = stage(spark, docs, FOLDER).cache()
        left = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == COLUMNS
        assert all(r.n_chars == len(r.text) for r in left.values())
        assert 0.5 * len(given) < len(left) <= len(given)
        if name == "n-gram Jaccard join":
            expected = groups([(r.doc_id, r.text) for r in given])
            assert set(left) == {i for i, _, c in expected if i == c}
        if name == "suffix-array dedup":
            expected = spans([(r.doc_id, r.text) for r in given])
            for row in given:
                if row.doc_id in left and expected[row.doc_id][1] == 0:
                    assert left[row.doc_id] == row
                elif row.doc_id in left:
                    assert len(left[row.doc_id].text.encode()) <= expected[row.doc_id][0] - expected[row.doc_id][1]
                else:
                    assert expected[row.doc_id][1] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == set(left)
    whole = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces}


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", "s", 4), (3, "word", "en", "s", 4), (None, "x y z", "en", "s", 5)]
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        folder = tmp_path / f"{len(given)}"
        spark.createDataFrame(given, schema).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, str(folder))
            assert kept.count() >= 0
            docs = kept if kept.columns == COLUMNS else docs
        assert corpus_pipeline.run(spark, str(folder)).count() == (2 if given else 0)
