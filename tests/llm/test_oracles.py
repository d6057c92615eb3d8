"""Every query that SQL can express, on the small tables and on rows that are hard."""

import os

import duckdb
import pytest

from eventloom.llm.queries import ORACLES, QUERIES

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
DOCUMENTS = [
    (1, None, "en", "s1"), (2, "", None, None), (3, " \t\n", "en", "s1"), (4, LONG, "en", "s2"), (5, "Alpha BETA " + LONG[11:] + " pi", "xx", "s2"), (6, "x " * 300, "de", "s3"), (7, "É " + LONG + " é", "fr", None),
    (8, "one two", "es", "s1"), (9, "ONE, two!", "es", "s1"), (10, "a b c\na b c\n\na b c \n a b c", "en", "s4"), (11, "#" * 400 + " word " * 60, "en", "s4"), (12, "\n".join(f"a line of words {i % 3} here" for i in range(40)), "en", "s5"),
    (13, "the of and to " * 40 + LONG, "en", "s6"), (14, "😀 " * 120, "en", "s6"), (15, LONG, "en", "s2"),
] + [(100 + i, f"This very line is on many sites indeed\nown text number {i}", "en", f"site{i % 14}") for i in range(30)]
BENCHMARK = [(1, LONG), (2, LONG), (3, "two"), (4, ""), (5, None), (6, "one two"), (7, "zeta " * 20), (8, "words 1 here a line of words 2 here a line of words 0 here")]
PAGES = [(1, None, None), (2, "", ""), (3, "http://A.example.com/en/x", "p" * 2000), (4, "https://u@a.example.com:80/en/y?q#f", "p" * 2000), (5, "a.example.com", "short"), (6, "http://b.example.org//en//", "short"), (7, "http://b.example.org/en", "é" * 600), (9, "x:y", "é" * 600)]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("hard")
    extra = ", n_words long, m_words string, at long"
    tables = {"documents": (DOCUMENTS, "doc_id long, text string, lang string, source string" + extra), "benchmark": (BENCHMARK, "item_id long, text string" + extra), "pages": (PAGES, "page_id long, url string, html string" + extra)}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def none(spark, hard, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for name in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{hard}/{name}.parquet").where("false").write.parquet(f"{d}/{name}.parquet")
    return str(d)


def compare(spark, name, where):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        p = f"{where}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    df = QUERIES[name](spark, where)
    cols = sorted(df.columns)
    got = sorted([tuple(map(str, r)) for r in df.select(*cols).collect()])
    want = sorted([tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()])
    assert got == want, ([r for r in got if r not in want][:3], [r for r in want if r not in got][:3])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small(spark, small, name):
    compare(spark, name, small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_hard_rows(spark, hard, name):
    compare(spark, name, hard)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, name):
    assert QUERIES[name](spark, none).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_hard_rows_give_a_row_each(spark, hard, name):
    assert QUERIES[name](spark, hard).count() == (len(PAGES) if name.startswith("op7") else len(DOCUMENTS))
