from eventloom.llm import components, lines, quality, urls


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 130)] + [(5, 9), (9, 7), (7, 5), (50, 50), (200, 199)] + [(300, 301 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 131)} | {5: 5, 7: 5, 9: 5, 199: 199, 200: 199} | {300 + i: 300 for i in range(41)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_intervals(spark):
    rows = [("l", "host", "h", "block", "add", 10), ("l", "host", "h", "block", "remove", 20), ("l", "host", "h", "block", "add", 20), ("l", "host", "h", "block", "add", 30), ("l", "domain", "x.y", "allow", "remove", 5)]
    got = urls.intervals(spark.createDataFrame(rows, "list string, kind string, entry string, verdict string, action string, at long"))
    assert sorted((r.valid_from, r.valid_to) for r in got.collect()) == [(10, 20), (20, 30), (30, urls.FOREVER)]


def test_most_specific_entry_decides(spark):
    lists = spark.createDataFrame([("l", "domain", "example.com", "block", 0, 100), ("l", "prefix", "a.example.com/en", "allow", 0, 50), ("l", "url", "a.example.com/en/bad", "block", 0, 100)], "list string, kind string, entry string, verdict string, valid_from long, valid_to long")
    rows = [("http://a.example.com/en/ok", 10), ("http://a.example.com/en/ok", 60), ("http://A.example.com/en/bad?x", 10), ("http://example.com", 10), ("http://notexample.com/", 10), (None, 10), ("http://a.example.com/en", None)]
    got = urls.decide(spark.createDataFrame([(*r, "x") for r in rows], "url string, fetched_at long, kind string"), lists)
    assert [(r.url, r.fetched_at, r.url_filter.blocked) for r in got.collect() if r.url_filter.blocked] and sorted(str((r.url, r.fetched_at)) for r in got.where("url_filter.blocked").collect()) == sorted(str(x) for x in [("http://a.example.com/en/ok", 60), ("http://A.example.com/en/bad?x", 10), ("http://example.com", 10)])
    assert got.count() == len(rows) and got.columns == ["url", "fetched_at", "kind", "url_filter"]


def test_quality_keeps_clean_and_rejects_junk(spark):
    import random

    rng = random.Random(1)
    prose = lambda lang: " ".join(rng.choices(quality.COMMON_WORDS[lang], [1 / (i + 1) for i in range(12)])[0] if rng.random() < 0.2 else "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 9))) for _ in range(300))
    clean = [prose(k) + "." for k in quality.COMMON_WORDS for _ in range(5)]
    junk = [" ".join(w + "***" for w in prose("en").split()), " | ".join(prose("en").split()), prose("en").upper(), "word " * 200, "too short", "qqq " + " ".join("".join(rng.choices("bcdfg", k=6)) for _ in range(300))]
    rows = [(i, t, "en" if t in junk else list(quality.COMMON_WORDS)[i // 5]) for i, t in enumerate(clean + junk)]
    got = quality.keep_good(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, q_n long"))
    assert got.columns == ["doc_id", "text", "lang", "q_n"] and sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_boilerplate_keeps_its_first_place(spark):
    rows = [(i, f"Shared over many sites here\nown line of document {i}\nshort one", f"s{i % 12}", 0) for i in range(40)] + [(99, "Shared over many sites here", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pos long")
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(df).collect()}
    assert got[0].startswith("Shared over") and all("Shared over" not in got[i] for i in range(1, 40)) and 99 not in got
    assert all("short one" in got[i] for i in range(40))
