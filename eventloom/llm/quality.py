"""Quality rules: distribution divergence against language references.

Every figure is a column expression over one row: no shuffle, no Python code.
Two histograms of a document, of character classes and of common words, are
held against references by Jensen-Shannon distance (base 2, square root).

Defined results: null text has no words and fails the base rule; a language
without reference (null included) skips the word rule; texts under the length
guards skip the rule they guard; rows that repeat are judged each by itself;
extra columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import where_held

#: The commonest words of each language, commonest first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por"],
}
#: Share of the word of rank r in running text: ZIPF / r.
ZIPF = 0.06
#: Shares of A-Z, digits, punctuation, symbols and all other characters of words in plain prose.
CHAR_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "point": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]"}
CHAR_SHARES = {"upper": 0.02, "digit": 0.002, "point": 0.028, "symbol": 0.0, "other": 0.95}
MAX_CHAR_DISTANCE, MIN_CHARS = 0.22, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.30, 100
#: Fixed values of the base rule.
SPACE = r"\x20\x09-\x0D"
LEAST_WORDS, MOST_REPEATED = 50, 50

SPACES = " \t\n\x0b\f\r"


def _half(p: Column, q: Column) -> Column:
    """p * log2(p / mean), 0 at p = 0."""
    return F.when(p > 0, p * F.log2(p * 2 / (p + q))).otherwise(F.lit(0.0))


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def with_base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds q_n (words), q_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and class counts, as one struct column q."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.expr("trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM q_text)")
    df = docs.withColumn("q_text", t).withColumn("q_bare", bare)
    df = df.withColumn("q_words", F.when(F.col("q_bare") == "", F.array().cast("array<string>")).otherwise(F.split("q_bare", f"[{SPACE}]+", -1)))
    df = df.withColumn("q_n", F.size("q_words").cast("long"))
    # windows of three words as hashes; each value carries its place in the low bits, so one sort of longs brings equals together
    place = F.expr("length(bin(q_n))")
    windows = F.expr("CASE WHEN q_n < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, CAST(q_n AS int) - 3), i -> xxhash64(get(q_words, i), get(q_words, i + 1), get(q_words, i + 2))) END")
    df = df.withColumn("q_bits", place).withColumn("q_h", windows)
    df = df.withColumn("q_sorted", F.expr("sort_array(transform(q_h, (x, i) -> shiftleft(x, q_bits) | CAST(i AS bigint)))"))
    df = df.withColumn("q_near", F.expr("filter(q_sorted, (x, k) -> shiftrightunsigned(x, q_bits) = shiftrightunsigned(get(q_sorted, k - 1), q_bits) OR shiftrightunsigned(x, q_bits) = shiftrightunsigned(get(q_sorted, k + 1), q_bits))"))
    # the few that agree in the high bits are compared by their whole hash
    df = df.withColumn("q_pairs", F.expr("array_sort(transform(q_near, x -> struct(get(q_h, CAST(x & (shiftleft(1L, q_bits) - 1) AS int)) AS h, x & (shiftleft(1L, q_bits) - 1) AS i)))"))
    df = df.withColumn("q_at", F.expr("sort_array(transform(filter(q_pairs, (e, k) -> e.h = get(q_pairs, k - 1).h OR e.h = get(q_pairs, k + 1).h), e -> e.i))"))
    covered = F.expr("aggregate(q_at, struct(0L AS n, -3L AS last), (a, i) -> struct(a.n + least(3L, i - a.last) AS n, i AS last), a -> a.n)")
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumn("q_lines", lines)
    figures = {
        "n_words": F.col("q_n"),
        "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": covered,
        **{name: F.regexp_count("q_text", F.lit(pattern)).cast("long") for name, pattern in CHAR_CLASSES.items()},
    }
    return df.withColumn("q", F.struct(*[c.alias(n) for n, c in figures.items()]))


def char_distance() -> Column:
    total = F.greatest(F.col("q.word_chars"), F.lit(1)).cast("double")
    counts = {n: F.col(f"q.{n}") for n in CHAR_CLASSES}
    counts["other"] = F.col("q.word_chars") - reduce(lambda a, b: a + b, list(counts.values()))
    terms = [_half(counts[n] / total, F.lit(CHAR_SHARES[n])) + _half(F.lit(CHAR_SHARES[n]), counts[n] / total) for n in CHAR_SHARES]
    return _distance(reduce(lambda a, b: a + b, terms) / 2)


def _by_language(lang: str, values: dict[str, Column]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(lang) == k, v) if out is None else out.when(F.col(lang) == k, v)
    return out


def word_distance(lang: str = "lang") -> tuple[Column, Column]:
    """Counts of the language's common words, and the distance of ``q_counts`` from the reference."""
    forms = sorted({f for ws in COMMON_WORDS.values() for w in ws for f in (w, w.capitalize(), w.upper())})
    listed = _by_language(lang, {k: F.array(*[F.lit(w) for w in ws]) for k, ws in COMMON_WORDS.items()})
    hits = F.transform(F.filter("q_words", lambda w: w.isin(forms)), F.lower)
    counts = F.struct(hits.alias("hits"), listed.alias("listed"))
    shares = [ZIPF / (r + 1) for r in range(len(next(iter(COMMON_WORDS.values()))))]
    total = F.greatest(F.col("q_n"), F.lit(1)).cast("double")
    terms = [_half(F.get("q_counts", F.lit(i)) / total, F.lit(s)) + _half(F.lit(s), F.get("q_counts", F.lit(i)) / total) for i, s in enumerate(shares)]
    rest, ref = 1 - reduce(lambda a, b: a + b, [F.get("q_counts", F.lit(i)) for i in range(len(shares))]) / total, F.lit(1 - sum(shares))
    terms.append(_half(rest, ref) + _half(ref, rest))
    return counts, _distance(reduce(lambda a, b: a + b, terms) / 2)


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a struct column ``quality``: the figures, base_failed, both distances (null where not applied), kept."""
    counts, words = word_distance(lang)
    df = with_base_figures(docs, text).withColumn("q_hits", counts)
    df = df.withColumn("q_counts", F.transform("q_hits.listed", lambda w: F.size(F.filter("q_hits.hits", lambda h: h == w)).cast("double")))
    failed = (F.col("q.n_words") < LEAST_WORDS) | (100 * F.col("q.n_repeat_words") > MOST_REPEATED * F.col("q.n_words"))
    df = df.withColumns({
        "q_failed": failed,
        "q_char": F.when(F.col("q.word_chars") >= MIN_CHARS, char_distance()),
        "q_word": F.when((F.col("q_n") >= MIN_WORDS) & F.col("q_counts").isNotNull(), words),
    })
    kept = ~F.col("q_failed") & (F.coalesce("q_char", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("q_word", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    quality = F.struct(
        "q.n_words", "q.word_chars", F.col("q.symbol").alias("n_symbols"), "q.n_dup_lines", "q.n_repeat_words",
        F.col("q_failed").alias("base_failed"), F.col("q_char").alias("char_distance"), F.col("q_word").alias("word_distance"), kept.alias("kept"),
    )
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], quality.alias("quality"))


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang")).select("doc_id", *[f"quality.{c}" for c in FIGURES], "quality.base_failed", "quality.kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns as they were."""
    judged = judge(docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang")}))
    back = {f"in_{i}": c for i, c in enumerate(docs.columns) if c not in ("text", "lang")}
    return where_held(judged, F.col("quality.kept")).drop("quality").withColumnsRenamed(back).select(*[f"`{c}`" for c in docs.columns])


def _oracle() -> str:
    shares = [ZIPF / (r + 1) for r in range(12)]
    half = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} * 2 / ({p} + {q})) ELSE 0 END)"
    both = lambda p, q: f"{half(p, q)} + {half(q, p)}"
    count = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    classes = {n: count(p.replace("'", "''")) for n, p in CHAR_CLASSES.items()}
    chars = " + ".join(both(f"(c_{n} / greatest(word_chars, 1.0))", f"CAST({CHAR_SHARES[n]} AS DOUBLE)") for n in CHAR_SHARES)
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON_WORDS.items()) + " END"
    forms = {k: sorted({f for w in ws for f in (w, w.capitalize(), w.upper())}) for k, ws in COMMON_WORDS.items()}
    every = sorted({f for fs in forms.values() for f in fs})
    cw = [f"(len(list_filter(hits, lambda h: h = listed[{i + 1}])) / greatest(n_words, 1.0))" for i in range(12)]
    rest = f"(1 - ({' + '.join(f'w{i}' for i in range(12))}))"
    words = " + ".join(both(f"w{i}", f"CAST({s!r} AS DOUBLE)") for i, s in enumerate(shares)) + " + " + both(rest, f"CAST({1 - sum(shares)!r} AS DOUBLE)")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
    a AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, {listed} AS listed FROM d),
    tri AS (SELECT doc_id, i, list_slice(words, i, i + 2) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM a)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    b AS (SELECT a.doc_id, text, lang, listed, CAST(len(words) AS BIGINT) AS n_words, CAST(length(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS wc,
                 list_transform(list_filter(words, lambda x: x IN ({', '.join(repr(f) for f in every)})), lambda x: lower(x)) AS hits,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
          FROM a LEFT JOIN cov USING (doc_id)),
    c AS (SELECT * EXCLUDE (wc), coalesce(wc, 0) AS word_chars, {', '.join(f'{e} AS c_{n}' for n, e in classes.items())} FROM b),
    e AS (SELECT *, word_chars - c_upper - c_digit - c_point - c_symbol AS c_other, {', '.join(f'{x} AS w{i}' for i, x in enumerate(cw))} FROM c),
    f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
                 CASE WHEN word_chars >= {MIN_CHARS} THEN sqrt(greatest(({chars}) / 2, 0)) ELSE 0 END AS cd,
                 CASE WHEN n_words >= {MIN_WORDS} AND listed IS NOT NULL THEN sqrt(greatest(({words}) / 2, 0)) ELSE 0 END AS wd FROM e)
    SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND cd <= {MAX_CHAR_DISTANCE} AND wd <= {MAX_WORD_DISTANCE} AS kept FROM f"""


ORACLE_SQL = _oracle()
