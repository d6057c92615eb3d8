from eventloom.llm import lines


def test_short_lines_go_on_more_sites(spark):
    rows = [(i, f"own line of document {i}\nAll rights reserved.\n\nLes.\nrare", f"s{i % 20}" if i < 40 else "s1") for i in range(50)]
    rows += [(100 + i, "two words", f"s{i}") for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(df).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own line of document {i}\n" for i in range(1, 50))
    assert all(got[100 + i] == "two words" for i in range(14))
    assert lines.ALL_ORACLE_SQL.count("CASE WHEN len(") == 1 and "WHERE line <> ''" in lines.ALL_ORACLE_SQL


def test_hot_lines_around_the_threshold_get_exact_counts(spark):
    lines_of = {f"this line stands on {n} sites": n for n in range(7, 14)}
    rows = [(i, "\n".join([f"document number {i} is here"] + [t for t, n in lines_of.items() if i % 3 == 0 or i % n == n - 1]), "s0" if i % 3 == 0 else f"s{i % 13}") for i in range(600)]
    rows += [(None, "this line stands on 9 sites", None), (700, None, "s1")]
    sites = {t: {s for _, text, s in rows if text and s and t in text.split("\n")} for t in lines_of}
    assert {len(s) >= lines.MIN_SITES for s in sites.values()} == {True, False}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {t: min((-1 if i is None else i) for i, text, _ in rows if text and t in text.split("\n")) for t in lines_of}
    want = {i: text and "\n".join(x for x in text.split("\n") if x not in sites or len(sites[x]) < lines.MIN_SITES or first[x] == i) for i, text, _ in rows if i is not None}
    got = {r.doc_id: r.line_dedup.text for r in lines.cleaned(df, short_sites=lines.SHORT_SITES).collect() if r.doc_id is not None}
    assert got == want and first["this line stands on 9 sites"] == -1
