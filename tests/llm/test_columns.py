"""Extra columns with names that the operators use themselves, null ids, repeated rows and empty tables."""

from eventloom.llm import decontaminate, lines, ngram_join, quality, urls

CLASHING = ["m_doc", "m_n", "m_key", "r_at", "r_lines", "r_doc", "g_doc", "b_row", "u_row", "row", "id", "n", "key", "at", "hash", "kept", "line_no", "q", "held_row", "pos"]
LINE = "Shared over many sites here"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def documents(spark, rows):
    extra = "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c} of {i}" for c in CLASHING)) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string" + extra)


def held(df, rows, texts=True):
    for r in df.collect():
        i = int(r["row"].split(" of ")[1])
        assert all(r[c] == f"{c} of {i}" for c in CLASHING) and r.doc_id == rows[i][0] and (not texts or r.text == rows[i][1])


def test_clashing_columns_stay(spark):
    rows = [(i if i else None, f"{LINE}\nown line of document {i}", f"s{i}", "en") for i in range(12)] + [(50, ITEM, "s", "en"), (50, "clean words only in this one", "s", "en"), (None, None, None, None), (3, "", "s", None)]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([("b1", ITEM), ("b2", "two words"), (None, "x")], "item_id string, text string")
    out = lines.drop_boilerplate(docs)
    assert out.columns == docs.columns
    held(out, rows, texts=False)
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and out.count() == len(rows) - 1
    held(out, rows)
    held(decontaminate.judge(docs, bench), rows)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    held(out, rows)
    held(quality.keep_good(docs), rows)
    lists = spark.createDataFrame([], "list string, kind string, entry string, verdict string, valid_from long, valid_to long")
    held(urls.decide(docs.withColumnsRenamed({"source": "url", "hash": "x"}).selectExpr("*", "1L AS fetched_at", "x AS hash"), lists), rows)


def test_items_under_a_window_are_compared_word_by_word(spark):
    docs = spark.createDataFrame([(1, "say Two, words twice: two words"), (1, "other text"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("b", "two words"), ("c", "twice"), ("d", "twice two"), ("e", "absent")], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, bench).collect())
    assert got == [(1, 2, 0, 0), (1, 6, 5, 3), (2, 0, 0, 0)]
    assert decontaminate.report(docs.limit(0), bench).collect() == [] and {r.n_hit for r in decontaminate.report(docs, bench.limit(0)).collect()} == {0}


def test_both_sides_of_the_broadcast_bound_agree(spark, small, monkeypatch):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == want


def test_empty_tables(spark):
    docs = documents(spark, [])
    bench = spark.createDataFrame([("b", ITEM)], "item_id string, text string")
    for out in (lines.drop_boilerplate(docs), decontaminate.drop_contaminated(docs, bench), ngram_join.one_of_each(docs), quality.keep_good(docs)):
        assert out.collect() == []
