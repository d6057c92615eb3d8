from eventloom.llm import ngram_join

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_one_row_of_each_component(spark):
    other, third = TEXT.replace("a", "o"), TEXT.replace("a", "u")
    rows = [(1, TEXT, "x"), (1, TEXT, "x"), (1, TEXT, "y"), (2, TEXT, "x"), (None, TEXT, "x")]  # repeated least id, and a null copy
    rows += [(None, other, "x"), (None, other, "x")]  # nothing but null ids
    rows += [(3, third, "x"), (2, third, "x")]  # one id with two texts
    rows += [(7, "", "x"), (None, None, "x"), (7, "", "x")]  # without words
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = got.collect()
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted((str(r.doc_id), r.text) for r in out if r.text) == sorted([("1", TEXT), ("None", other), ("2", third)])
    assert sum(not r.text for r in out) == 3
