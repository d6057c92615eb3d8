"""Line dedup by distinct-site spread.

Per line hash one HyperLogLog sketch of the sites it stands on; sketches merge
in the partial aggregation, so a line that is on a third of all rows costs one
row a task. Lines whose estimate is near the threshold get an exact distinct
count, their rows dealt over ``SALTS`` parts first. A line on ``MIN_SITES`` sites or more is boilerplate: all but its first
occurrence (smallest doc_id, then place) go.

Lines of fewer than ``MIN_LINE_WORDS`` words, which running text may repeat by
chance, are boilerplate on ``SHORT_SITES`` sites or more. ``op3_line_dedup`` leaves
them out altogether (``short_sites`` None), because its SQL does; the pipeline and
``op3_line_dedup_all`` do not. Two seeded 64-bit hashes name a line.

Defined results: null text stays null and has no lines; a null site counts as
no site; a null doc_id counts as the smallest; rows of one doc_id share their removed places, so a row that repeats an id
loses what any of them loses; of equal first places all stay; an empty table gives no
rows; extra columns of any name are kept (``line_dedup`` is replaced by the operator's
own); a very long text is one row of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import columns_of, cut, whole_row

MIN_SITES, MIN_LINE_WORDS = 10, 4
SHORT_SITES = 15
#: Share of the threshold around it within which the sketch is not trusted; over five standard errors at this precision.
BAND, LOG_K = 0.2, 12
#: Parts into which the rows of a line near the threshold are dealt, so that no one task counts a line that is on many rows.
SALTS = 32

_SPACES = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, short_sites: int | None) -> DataFrame:
    rows = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    rows = rows.select("doc_id", "source", "pos", F.trim("raw", F.lit(_SPACES)).alias("line"))
    long = F.size(F.split("line", r"[\x20\x09-\x0D]+", -1)) >= MIN_LINE_WORDS
    rows = rows.where(long if short_sites is None else F.col("line") != "")
    return rows.select("doc_id", "source", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), long.alias("long"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, short_sites: int | None = None) -> DataFrame:
    """h1, h2 and first occurrence of the lines on at least ``min_sites`` sites, ``short_sites`` for short ones."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce("source", F.lit("\x00")), F.lit(LOG_K))).alias("est"),
        F.max(F.col("source").isNull().cast("int")).alias("nulls"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.max("long").alias("long"),
    ).withColumn("est", F.col("est") - F.col("nulls"))
    need = F.lit(min_sites) if short_sites is None else F.when(F.col("long"), min_sites).otherwise(short_sites)
    low, high = need * (1 - BAND), need * (1 + BAND)
    wide = cut(spread.where(F.col("est") >= low))
    near = wide.where(F.col("est") <= high).select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    exact = salted.join(near, ["h1", "h2", "salt"]).groupBy("h1", "h2", "long", "first", "source").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h1", "h2", "long", "first").agg(F.count("source").alias("sites")).where(F.col("sites") >= need)
    return wide.where(F.col("est") > high).select("h1", "h2", "first").unionByName(exact.select("h1", "h2", "first"))


def removed_places(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int | None = None) -> DataFrame:
    """doc_id with the places of the lines that go; lines are split and hashed once."""
    lines = cut(_lines(docs, short_sites))
    hit = lines.join(cut(boilerplate(lines, min_sites, short_sites)), ["h1", "h2"])
    hit = hit.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    return hit.groupBy(F.col("doc_id").alias("r_doc")).agg(F.collect_set("pos").alias("r_at"))


def _cleaned(docs: DataFrame, min_sites: int, short_sites: int | None) -> DataFrame:
    """row (a struct of the columns of ``docs``), n_lines, n_removed and cleaned text of every row."""
    gone = removed_places(docs.select("doc_id", "text", "source"), min_sites, short_sites)
    held = docs.select(whole_row(docs).alias("row"), "doc_id")
    df = held.join(gone, F.col("doc_id").eqNullSafe(F.col("r_doc")), "left").withColumn("text", F.col("row.text"))
    stay = F.expr("array_except(sequence(0, size(split(text, '\\n', -1)) - 1), r_at)")
    df = df.withColumn("r_lines", F.split("text", "\n", -1)).withColumn("r_stay", F.when(F.col("r_at").isNotNull(), stay))
    text = F.when(F.col("r_at").isNull(), F.col("text")).otherwise(F.array_join(F.transform("r_stay", lambda i: F.get("r_lines", i)), "\n"))
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size("r_lines")), F.lit(0)).cast("long")
    removed = F.when(F.col("r_at").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size("r_lines") - F.size("r_stay")).cast("long")
    return df.select("row", n.alias("n_lines"), removed.alias("n_removed"), text.alias("kept"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int | None = None) -> DataFrame:
    """The rows of ``docs`` with a struct column ``line_dedup``: n_lines, n_removed, text."""
    docs = docs.drop("line_dedup")
    return _cleaned(docs, min_sites, short_sites).select(*columns_of(docs), F.struct("n_lines", "n_removed", F.col("kept").alias("text")).alias("line_dedup"))


def report(docs: DataFrame, short_sites: int | None = None) -> DataFrame:
    out = _cleaned(docs.select("doc_id", "text", "source"), MIN_SITES, short_sites)
    kept = F.coalesce("kept", F.lit(""))
    return out.select("row.doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_boilerplate(docs: DataFrame) -> DataFrame:
    """The documents without boilerplate lines; those that had words and are left with none go."""
    out = _cleaned(docs, MIN_SITES, SHORT_SITES)
    keep = out.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return keep.select(*columns_of(docs, text=F.col("kept")))


ORACLE_SQL = rf"""
    WITH l AS (SELECT doc_id, source, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, n
               FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n
                     FROM documents WHERE text IS NOT NULL)),
    w AS (SELECT * FROM l WHERE len(string_split_regex(line, '[\x20\x09-\x0D]+')) >= {MIN_LINE_WORDS}),
    b AS (SELECT line, min(struct_pack(d := doc_id, i := i)) AS first FROM w GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
    g AS (SELECT DISTINCT doc_id, w.i FROM w JOIN b ON w.line = b.line WHERE struct_pack(d := w.doc_id, i := w.i) <> b.first),
    r AS (SELECT d.doc_id, d.i, d.raw, d.n, g.i IS NOT NULL AS gone
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n
                FROM documents WHERE text IS NOT NULL) d LEFT JOIN g ON d.doc_id = g.doc_id AND d.i = g.i),
    k AS (SELECT doc_id, max(n) AS n, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN k USING (doc_id)"""

#: The same with short lines in it, under their own threshold.
ALL_ORACLE_SQL = ORACLE_SQL.replace(f"WHERE len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) >= {MIN_LINE_WORDS}", "WHERE line <> ''").replace(
    f">= {MIN_SITES}", f">= CASE WHEN len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) >= {MIN_LINE_WORDS} THEN {MIN_SITES} ELSE {SHORT_SITES} END"
)
