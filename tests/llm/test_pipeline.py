"""The pipeline against each stage done by plain means on its own input."""

import duckdb
import pytest
from tokenizers import Tokenizer

from eventloom.llm import bpe, decontaminate, lines, quality
from tests.llm.test_bpe import digest
from tests.llm.test_ngram_join import brute

pipeline = pytest.importorskip("corpus_pipeline")


def ids(con, sql, where):
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{where}/*.parquet')")
    return con.execute(sql).fetchall()


def test_stages(spark, small, tmp_path):
    con, d = duckdb.connect(), spark.read.parquet(f"{small}/documents.parquet")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{small}/benchmark.parquet')")
    extra = d.withColumn("quality", d["doc_id"]).withColumn("name", d["lang"])
    extra.write.parquet(str(tmp_path / "in"))
    docs, at, out = spark.read.parquet(str(tmp_path / "in")), tmp_path / "in", {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        out[k] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == extra.columns
        if k == 0:
            assert set(out[0]) == {x[0] for x in ids(con, f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept", at)}
        if k == 1:
            want = {x[0]: x[1] for x in ids(con, f"SELECT doc_id, kept_chars FROM ({lines.ORACLE_SQL})", at)}
            assert {i: len(r.text) for i, r in out[1].items()} == {i: n for i, n in want.items() if i in out[1]}
        if k == 2:
            groups = brute([(r.doc_id, r.text) for r in before.collect()])
            assert set(out[2]) == {i for i, (_, root) in groups.items() if i == root}
        if k == 3:
            assert set(out[3]) == {x[0] for x in ids(con, f"SELECT doc_id FROM ({decontaminate.ORACLE_SQL}) WHERE NOT contaminated", at)}
        if k == 4:
            tokenizer = Tokenizer.from_file(bpe.public_vocabulary())
            assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in out[4].items()} == {r.doc_id: digest(tokenizer, r.text) for r in before.collect()}
        at = tmp_path / str(k)
    assert {r.doc_id for r in pipeline.run(spark, small).collect()} == set(out[4])


def test_empty_nulls_and_repeats(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    good = next(r.text for r in pipeline.quality_rules(spark, docs, small).collect())
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, good, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    for rows_, want in ((rows, 1), ([], 0)):
        at = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").select(*names)
        for k, (_, stage) in enumerate(pipeline.STAGES):
            path = str(tmp_path / f"{want}-{k}")
            stage(spark, at, small).write.parquet(path)
            at = spark.read.parquet(path)
        assert at.count() <= want
    assert remove_leaves_nothing(spark)


def remove_leaves_nothing(spark):
    from eventloom.llm import common

    path = common.own_folder(spark, "x")
    spark.range(3).write.parquet(path)
    common.remove(spark, path)
    return path not in common._WRITTEN
