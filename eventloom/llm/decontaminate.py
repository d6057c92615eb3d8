"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` consecutive k-grams the smallest hash is kept, so a
shared run of ``WINDOW`` words shares a kept hash. Fingerprints of documents
join those of the benchmark; each meeting is extended word by word to both
sides, and counts where the equal run has at least ``WINDOW`` words. Extending
``WINDOW - K`` words to a side is enough: any longer run holds further kept
hashes. Items of fewer words are matched whole.

The benchmark side is broadcast only up to ``BROADCAST_ROWS`` counted rows; past
that both joins shuffle on the fingerprint and AQE may split hot ones. Only
documents with a meeting are read again for the extension.

Defined results: null text has no words and no hits; items without words match
nothing; an item that repeats counts once per item_id, ids as strings, null
ids left out; rows that repeat an id are judged each by its own text, and rows that
repeat both alike; an empty table gives no rows, an empty benchmark no hits; extra
columns of any name are kept (``match`` is replaced by the operator's own); a very
long text is one row of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import columns_of, whole_row

WINDOW, K = 13, 5
#: Share of a document's words, in twentieths, from which it is contaminated.
TWENTIETHS = 20
BROADCAST_ROWS = 200_000

#: Fixed value: characters that part words, once A-Z are lower case.
PARTING = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_PARTING_CHARS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: str) -> Column:
    """Words of a text column as an array; only A-Z are lower-cased."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _UPPER.lower()))
    bare = F.trim(low, F.lit(_PARTING_CHARS))
    return F.filter(F.split(bare, f"[{PARTING}]+", -1), lambda w: w != "")


# explode_outer below: for explode the optimizer derives a filter on the array and
# pushes it to the scan with all its definitions, so each would be worked out twice.


def _gram(n: int, i: str = "i") -> str:
    return "xxhash64(" + ", ".join(f"get(m_words, {i} + {j})" for j in range(n)) + ")"


def _grams(n: int) -> Column:
    return F.expr(f"CASE WHEN size(m_words) < {n} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(m_words) - {n}), i -> {_gram(n)}) END")


def _kept(window: int, k: int) -> Column:
    """Distinct minima over windows of k-grams; empty for texts under one window."""
    w = window - k + 1
    return F.expr(f"CASE WHEN size(m_grams) < {w} THEN CAST(array() AS array<bigint>) ELSE array_distinct(transform(sequence(1, size(m_grams) - {w - 1}), i -> array_min(slice(m_grams, i, {w})))) END")


def _around(at: str, reach: int, k: int) -> Column:
    """Words of the k-gram at ``at``, those before it (nearest first) and those after it."""
    return F.struct(
        F.expr(f"reverse(slice(m_words, greatest({at} - {reach}, 0) + 1, least({reach}, {at})))").alias("left"),
        F.expr(f"slice(m_words, {at} + 1, {k})").alias("mid"),
        F.expr(f"slice(m_words, {at} + {k + 1}, {reach})").alias("right"),
    )


def _equal_run(a: str, b: str) -> Column:
    same = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return F.expr(f"CAST(CASE WHEN size({same}) = 0 THEN 0 ELSE coalesce(nullif(array_position({same}, false), 0) - 1, size({same})) END AS int)")


def _sided(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def benchmark_grams(benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(hash, item, around) of the kept k-grams of long items; (n, hash, item, m_words) of short items."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("m_words"))
    long = items.where(F.size("m_words") >= window).withColumn("m_grams", _grams(k))
    long = long.withColumn("m_kept", _kept(window, k)).withColumn("m_at", F.expr("filter(sequence(0, size(m_grams) - 1), i -> array_contains(m_kept, m_grams[i]))"))
    seeds = long.select("item", "m_words", "m_grams", F.explode_outer("m_at").alias("q")).where("q IS NOT NULL")
    seeds = seeds.select(F.expr("m_grams[q]").alias("hash"), "item", _around("q", window - k, k).alias("theirs")).distinct()
    short = items.where((F.size("m_words") > 0) & (F.size("m_words") < window))
    short = short.select(F.size("m_words").alias("n"), F.expr("xxhash64(array_join(m_words, ' '))").alias("hash"), "item", F.col("m_words").alias("theirs")).distinct()
    return seeds, short


def _short_grams(n: int) -> Column:
    return F.expr(f"CASE WHEN size(m_words) < {n} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(1, size(m_words) - {n - 1}), i -> xxhash64(array_join(slice(m_words, i, {n}), ' '))) END")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, spans (word ranges that are hit, end exclusive) and items of the documents with hits."""
    seeds, short = benchmark_grams(benchmark, window, k)
    small = seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # at most window - 1 values
    words = docs.select("doc_id", "text").withColumn("m_words", words_of("text")).drop("text")
    # prints of every length in one look at the texts: n is 0 for kept k-grams, else the words of an item
    named = lambda n, hashes: F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("hash")))
    prints = words.withColumn("m_grams", _grams(k)).select("doc_id", F.explode_outer(F.concat(named(0, _kept(window, k)), *(named(n, F.array_distinct(_short_grams(n))) for n in lengths))).alias("x"))
    prints = prints.where("x IS NOT NULL").select("doc_id", "x.n", "x.hash")
    wanted = seeds.select(F.lit(0).alias("n"), "hash").unionByName(short.select("n", "hash")).distinct()
    found = prints.join(_sided(wanted, small), ["n", "hash"], "left_semi")
    by_doc = found.groupBy(F.col("doc_id").alias("m_doc")).agg(F.collect_set(F.struct("n", "hash")).alias("m_found"))
    again = docs.select("doc_id", "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("m_doc"))).select("doc_id", "m_found", words_of("text").alias("m_words"))
    of = lambda n: F.transform(F.filter("m_found", lambda x: x["n"] == n), lambda x: x["hash"])
    # places of the found hashes, then extension along the words of both sides
    at = again.withColumn("m_grams", _grams(k)).withColumn("m_mine", of(0))
    at = at.select("doc_id", "m_words", "m_grams", F.explode_outer(F.expr("CASE WHEN size(m_grams) = 0 OR size(m_mine) = 0 THEN CAST(array() AS array<int>) ELSE filter(sequence(0, size(m_grams) - 1), i -> array_contains(m_mine, m_grams[i])) END")).alias("p")).where("p IS NOT NULL")
    at = at.select("doc_id", F.expr("m_grams[p]").alias("hash"), "p", _around("p", window - k, k).alias("ours"))
    # equal surroundings extend alike, so they are compared once
    at = at.groupBy("doc_id", "hash", "ours").agg(F.collect_set("p").alias("ps"))
    both = at.join(_sided(seeds, small), "hash").where("ours.mid = theirs.mid")
    both = both.withColumn("l", _equal_run("ours.left", "theirs.left")).withColumn("r", _equal_run("ours.right", "theirs.right")).where(f"l + r + {k} >= {window}")
    spans = both.select("doc_id", "item", F.expr(f"transform(ps, p -> struct(p - l AS s, p + {k} + r AS e))").alias("spans"))
    for n in lengths:
        mine = again.withColumn("m_mine", of(n)).withColumn("m_grams", _short_grams(n)).where("size(m_mine) > 0")
        mine = mine.select("doc_id", F.explode("m_mine").alias("hash"), F.col("m_grams").alias("g"), "m_words")
        theirs = short.where(F.col("n") == n).select("hash", "item", "theirs")
        same = F.expr(f"transform(filter(sequence(0, size(g) - 1), i -> g[i] = hash AND slice(m_words, i + 1, {n}) = theirs), p -> struct(p AS s, p + {n} AS e))")
        spans = spans.unionByName(mine.join(_sided(theirs, small), "hash").select("doc_id", "item", same.alias("spans")).where("size(spans) > 0"))
    out = spans.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return out


#: Words in the union of sorted spans.
_N_HIT = "coalesce(aggregate(m_spans, struct(0L AS n, 0 AS upto), (a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.upto)) AS n, greatest(a.upto, x.e) AS upto), a -> a.n), 0L)"


def _n_words() -> Column:
    """Words of text, counted without lower-casing."""
    bare = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit("".join(c for c in _PARTING_CHARS if c not in _UPPER)))
    return F.size(F.filter(F.split(bare, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda w: w != "")).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a struct of the id and a hash of the text, for ids may repeat) and text."""
    return docs.select(_key().alias("doc_id"), "text")


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))


def _judged(sized: DataFrame, docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``sized`` (with m_key and m_n) with a struct column ``m_match``."""
    found = hits(_keyed(docs), benchmark, window, k).select(F.col("doc_id").alias("m_doc"), F.col("spans").alias("m_spans"), F.col("items").alias("m_items"))
    df = sized.join(found, F.col("m_key").eqNullSafe(F.col("m_doc")), "left").withColumn("m_hit", F.expr(_N_HIT))
    items = F.coalesce("m_items", F.array().cast("array<string>"))
    return df.withColumn("m_match", F.struct(
        F.col("m_n").alias("n_words"), F.col("m_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.col("m_spans").alias("spans"),
        ((F.col("m_hit") > 0) & (TWENTIETHS * F.col("m_hit") >= F.col("m_n"))).alias("contaminated"),
    ))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of ``docs`` with a struct column ``match``: n_words, n_hit, n_items, items, spans, contaminated."""
    docs = docs.drop("match")
    out = _judged(docs.select(whole_row(docs).alias("row"), _key().alias("m_key"), _n_words().alias("m_n")), docs, benchmark, window, k)
    return out.select(*columns_of(docs), F.col("m_match").alias("match"))


def _report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """m_key and m_match of every document; the last join carries keys and word counts, not texts."""
    return _judged(docs.select(_key().alias("m_key"), _n_words().alias("m_n")), docs, benchmark, WINDOW, K)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns for every document."""
    out = _report(docs, benchmark)
    return out.select(F.col("m_key.id").alias("doc_id"), "m_match.n_words", "m_match.n_hit", "m_match.n_items", F.sha2(F.array_join("m_match.items", ","), 256).alias("items_sha256"), "m_match.contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns as they were."""
    bad = _report(docs, benchmark).where("m_match.contaminated").select(F.col("m_key").alias("m_bad")).distinct()
    held = docs.select(whole_row(docs).alias("row"), _key().alias("m_key"))
    return held.join(bad, F.col("m_key").eqNullSafe(F.col("m_bad")), "left_anti").select(*columns_of(docs))


ORACLE_SQL = r"""
    WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
    bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
    ig AS (SELECT DISTINCT item_id, n, list_slice(words, i, i + n - 1) AS g
           FROM (SELECT item_id, words, least(len(words), 13) AS n, unnest(range(1, CAST(greatest(len(words) - 13, 0) + 2 AS BIGINT))) AS i FROM bw WHERE len(words) > 0)),
    ns AS (SELECT DISTINCT n FROM ig),
    dg AS (SELECT doc_id, n, i, list_slice(words, i, i + n - 1) AS g
           FROM (SELECT doc_id, words, n, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS i FROM dw, ns WHERE len(words) >= n)),
    m AS (SELECT doc_id, i, dg.n, CAST(item_id AS VARCHAR) AS item FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g),
    h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS w FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
