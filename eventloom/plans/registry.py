"""Queries of the log-analytics operators over the test tables, each with its DuckDB twin.

Events stand in for classified log rows: a user is a node, an event type is an
event. The vocabulary has four of the five types, so that the unknown token
occurs. Times are epoch microseconds.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import classify as C
from eventloom.functions import repair as R
from eventloom.functions.rules import RULES
from eventloom.functions.vocab import Vocabulary
from eventloom.operators import binning as B
from eventloom.operators import effects as X
from eventloom.operators import entropy as E
from eventloom.operators import links as L
from eventloom.operators import notes as N
from eventloom.operators import pcmci as P
from eventloom.operators import sampling as S
from eventloom.operators import sequences as Q
from eventloom.operators import work as K
from eventloom.sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = ["click", "error", "purchase", "signup"]
VOCABULARY = Vocabulary.of(NAMES)
HOUR, DAY, MINUTE = 3_600_000_000, 86_400_000_000, 60_000_000


def query(sql: str | None = None):
    """Registers a query under its function's name, with its twin where there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, node, ts (microseconds), event, token."""
    node = F.concat(F.lit("node"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", node.alias("node"), R.micros(F.col("ts")).alias("ts"), F.col("event_type").alias("event"), VOCABULARY.token(F.col("event_type")).alias("token"))


T = (
    "t AS (SELECT event_id, user_id, 'node' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS node, epoch_us(ts) AS ts, event_type AS event, "
    "CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 88 END AS INTEGER) AS token FROM events)"
)


def floor_of(width: int, c: str = "ts") -> str:
    return f"CAST(floor({c} / {width}.0) AS BIGINT)"


# --- tokens, repair, classification ---------------------------------------


@query(f"WITH {T} SELECT event_id, node, ts, token FROM t")
def tokenize_events(spark, sf_dir):
    return tokens(spark, sf_dir).select("event_id", "node", "ts", "token")


@query("""SELECT event_id, CASE event_id % 6 WHEN 3 THEN 12 WHEN 5 THEN event_id END AS pid, CASE WHEN event_id % 6 < 3 THEN NULL ELSE event_type END AS name, CAST(NULL AS VARCHAR) AS facility FROM events""")
def sentinel_clean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id") % 6
    text = F.when(i == 0, "nan").when(i == 1, "None").when(i == 2, "<NA>").when(i == 3, "12.0").when(i == 4, "x7").otherwise(F.col("event_id").cast("string"))
    name = F.when(i < 3, text).otherwise(F.col("event_type"))
    fixed = R.typed(R.repaired(e.select("event_id", text.alias("pid"), name.alias("name")), ["event_id", "pid", "name", "facility"]), ["event_id", "pid"])
    return fixed


#: Lines that reach rules all over the list, both tiers and neither.
LINES = [
    "cxi_core 0000:d5:00.0: hsn0 link down alert", "amdgpu 0000:c1:00.0: retry page fault", "Machine Check on Bank 17", "mce MC5_STATUS 0x0", "Machine Check, no number",
    "EDAC MC0: 1 CE", "LustreError: 11-0: MDC refused", "No space left on device", "Out of memory: Killed process 7", "segfault at 0 ip 00", "CALL TRACE: AMDGPU_ring", "nothing to see",
    "", "Bank 17 alone", "slurmstepd startup took 3 s", "pam_unix(sshd): session", "Fatal error during GPU init", "MC99_STATUS high", "RIP: 0010:a1", "LNETERROR: 9: x FAILED",
]


def _line() -> Column:
    return F.get(F.array(*[F.lit(x) for x in LINES]), (F.col("event_id") % len(LINES)).cast("int"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LINE_SQL = f"([{', '.join(map(_sql_text, LINES))}])[event_id % {len(LINES)} + 1]"
_BANK_SQL = "CASE WHEN b = '' THEN NULL " + " ".join(f"WHEN try_cast(b AS BIGINT) <= {last} THEN '{name}'" for last, name in C.BANKS) + f" ELSE '{C.BANK_UNKNOWN}' END"
_RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, {_sql_text(('(?i)' if i else '') + p)}) THEN '{label}'" for label, p, i in RULES) + " END"
_CLASSIFIED_SQL = f"""l AS (SELECT event_id, {_LINE_SQL} AS line FROM events), d AS (SELECT DISTINCT line, regexp_extract(line, '(?:Bank\\s*|MC)(\\d+)(?:_STATUS)?', 1) AS b FROM l),
    c AS (SELECT line, CASE WHEN line = '' THEN NULL WHEN contains(line, 'Machine Check') OR (contains(line, 'MC') AND contains(line, '_STATUS')) THEN coalesce({_BANK_SQL}, {_RULES_SQL}) ELSE {_RULES_SQL} END AS event_token FROM d)"""


def classified_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", _line().alias("line"))
    return lines.select("event_id", C.classify(F.col("line")).alias("event_token")).withColumn("dataset_type", C.dataset_type(F.col("event_token")))


@query(f"WITH {_CLASSIFIED_SQL} SELECT event_id, event_token, CASE WHEN event_token IS NULL THEN 'residuals' ELSE 'parsed_logs' END AS dataset_type FROM l JOIN c USING (line)")
def classify_lines(spark, sf_dir):
    return classified_lines(spark, sf_dir)


@query(f"WITH {_CLASSIFIED_SQL} SELECT event_token, CASE WHEN event_token IS NULL THEN 'residuals' ELSE 'parsed_logs' END AS dataset_type, count(*) AS n FROM l JOIN c USING (line) GROUP BY ALL")
def classification_counts(spark, sf_dir):
    return classified_lines(spark, sf_dir).groupBy("event_token", "dataset_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, {_BANK_SQL} AS label FROM (SELECT event_id, CASE WHEN event_id % 71 = 70 THEN '' WHEN event_id % 71 = 69 THEN '99999999999999999999' ELSE CAST(event_id % 71 AS VARCHAR) END AS b FROM events)")
def mce_bank_decode(spark, sf_dir):
    i = F.col("event_id") % 71
    line = F.when(i == 70, "Machine Check").when(i == 69, "Bank 99999999999999999999").when(i % 2 == 0, F.concat(F.lit("Machine Check Bank  "), i.cast("string"))).otherwise(F.concat(F.lit("MC"), i.cast("string"), F.lit("_STATUS")))
    return table(spark, sf_dir, "events").select("event_id", C.bank_label(line).alias("label"))


# --- binning ---------------------------------------------------------------


@query(f"WITH {T} SELECT node, {floor_of(HOUR)} AS bin, token, least(count(*), 10) AS cnt FROM t WHERE token BETWEEN 0 AND 86 GROUP BY ALL")
def binned_counts_node(spark, sf_dir):
    return B.counts(R.known_tokens(tokens(spark, sf_dir)), HOUR, ["node", "token"], cap=10)


@query(f"WITH {T} SELECT {floor_of(MINUTE)} AS bin, token, least(count(*), 10) AS cnt FROM t WHERE token BETWEEN 0 AND 86 AND ts > 1704100000000000 GROUP BY ALL")
def binned_counts_global(spark, sf_dir):
    return B.counts(R.known_tokens(R.valid(tokens(spark, sf_dir), "ts", 1704100000000000)), MINUTE, ["token"], cap=10)


@query(f"WITH {T}, g AS (SELECT min({floor_of(DAY)}) + 5 AS lo FROM t) SELECT {floor_of(DAY)} AS bin, token, count(*) AS cnt FROM t, g WHERE {floor_of(DAY)} BETWEEN g.lo AND g.lo + 9 GROUP BY ALL")
def binned_in_range(spark, sf_dir):
    b = B.counts(tokens(spark, sf_dir), DAY, ["token"])
    lo = b.agg(F.min("bin").alias("m")).first().m  # one number
    return B.in_range(b, (lo or 0) + 5, (lo or 0) + 14)


@query(f"WITH {T} SELECT node, {floor_of(DAY)} AS bin, " + ", ".join(f"count(*) FILTER (WHERE token = {i}) AS {n}" for i, n in enumerate(NAMES)) + " FROM t GROUP BY ALL")
def binned_wide(spark, sf_dir):
    return B.wide(B.counts(tokens(spark, sf_dir), DAY, ["node", "token"]), ["node", "bin"], dict(enumerate(NAMES)))


@query(f"WITH {T}, b AS (SELECT token, {floor_of(HOUR)} AS bin, count(*) AS cnt FROM t GROUP BY ALL), s AS (SELECT token, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY token) SELECT token, bin, coalesce(cnt, 0) AS cnt FROM s LEFT JOIN b USING (token, bin)")
def dense_series(spark, sf_dir):
    return B.dense(B.counts(tokens(spark, sf_dir), HOUR, ["token"]), ["token"])


_M = f"""m AS (SELECT node, min(ts) AS min_ts, max(ts) AS max_ts, {floor_of(DAY, 'min(ts)')} AS min_bin, {floor_of(DAY, 'max(ts)')} - {floor_of(DAY, 'min(ts)')} + 1 AS n_bins FROM t GROUP BY node),
    n AS (SELECT *, row_number() OVER (ORDER BY node) - 1 AS rank, CAST(coalesce(sum(n_bins + 1) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_bin FROM m)"""


@query(f"WITH {T}, {_M} SELECT *, start_bin + n_bins AS separator_bin FROM n")
def node_manifest(spark, sf_dir):
    return B.manifest(tokens(spark, sf_dir), DAY)


@query(f"""WITH {T}, {_M}, b AS (SELECT node, {floor_of(DAY)} AS bin, count(*) AS cnt FROM t GROUP BY ALL),
    r AS (SELECT node, rank, unnest(range(0, n_bins)) AS i, start_bin, min_bin FROM n)
    SELECT r.node, rank, start_bin + i AS slot, FALSE AS is_separator, coalesce(cnt, 0) AS cnt FROM r LEFT JOIN b ON r.node = b.node AND b.bin = min_bin + i
    UNION ALL SELECT 'NaN_BREAK', rank, start_bin + n_bins, TRUE, NULL FROM n""")
def timeline_with_separators(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return B.timeline(B.counts(t, DAY, ["node"]), B.manifest(t, DAY))


@query(f"WITH {T}, {_M}, b AS (SELECT sum(n_bins) AS n FROM n) SELECT n AS n_rows FROM (SELECT CAST(n AS BIGINT) AS n FROM b)")
def data_rows_only(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return B.data_rows(B.timeline(B.counts(t, DAY, ["node"]), B.manifest(t, DAY))).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {T}, {_M} SELECT node, rank, start_bin + n_bins AS separator_bin, lead(start_bin) OVER (ORDER BY rank) - (start_bin + n_bins) AS gap FROM n")
def separator_gaps(spark, sf_dir):
    return B.separator_gaps(B.manifest(tokens(spark, sf_dir), DAY))


@query(f"WITH {T} SELECT count(*) AS n_rows, count(DISTINCT node) AS n_nodes, min(ts) AS min_ts, max(ts) AS max_ts FROM t")
def global_stats(spark, sf_dir):
    return B.stats(tokens(spark, sf_dir))


_RARITY_SQL = "CASE " + " ".join(f"WHEN c >= {n} THEN '{name}'" for name, n in reversed(C.RARITY)) + " END"
_DIST = f"""dist AS (SELECT event, c AS total_count, 100.0 * c / sum(c) OVER () AS pct_of_all_events, nodes_with_event, 100.0 * nodes_with_event / (SELECT count(DISTINCT node) FROM t) AS pct_nodes, {_RARITY_SQL} AS rarity
    FROM (SELECT event, count(*) AS c, count(DISTINCT node) AS nodes_with_event FROM t GROUP BY event))"""


@query(f"WITH {T}, {_DIST} SELECT event, total_count, round(pct_of_all_events, 6) AS pct_of_all_events, nodes_with_event, round(pct_nodes, 6) AS pct_nodes, rarity FROM dist")
def event_distribution(spark, sf_dir):
    d = B.distribution(tokens(spark, sf_dir))
    return d.withColumns({c: F.round(c, 6) for c in ("pct_of_all_events", "pct_nodes")})


@query(f"WITH {T}, {_DIST} SELECT total_count AS median FROM (SELECT total_count, row_number() OVER (ORDER BY total_count) - 1 AS i, count(*) OVER () AS n FROM dist) WHERE i = n // 2")
def median_count(spark, sf_dir):
    return B.upper_median(B.distribution(tokens(spark, sf_dir)), "total_count")


@query(f"WITH {T}, {_DIST} SELECT rarity, count(*) AS n, string_agg(event, ',' ORDER BY event) AS events FROM dist GROUP BY rarity")
def rarity_bands(spark, sf_dir):
    return B.band_counts(B.distribution(tokens(spark, sf_dir)))


@query(f"WITH {T}, b AS (SELECT node, token, {floor_of(DAY)} AS bin, count(*) AS cnt FROM t GROUP BY ALL) SELECT token, CAST(sum(CASE WHEN cnt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS cells_capped, max(cnt) AS max_cnt FROM b GROUP BY token")
def cap_audit(spark, sf_dir):
    return B.cap_audit(B.counts(tokens(spark, sf_dir), DAY, ["node", "token"]), 1, "token")


@query(f"WITH {T} SELECT token, max(c) AS max_cnt FROM (SELECT token, {floor_of(HOUR)} AS bin, count(*) AS c FROM t GROUP BY ALL) GROUP BY token HAVING max(c) > 0")
def active_tokens(spark, sf_dir):
    return B.active_tokens(B.counts(tokens(spark, sf_dir), HOUR, ["token"]))


@query(f"WITH {T}, {_M}, g AS (SELECT CASE WHEN token < 2 THEN 'low' ELSE 'high' END AS variable_group, count(*) AS c FROM t WHERE token < 4 GROUP BY ALL) SELECT variable_group, round(c / (2.0 * (SELECT sum(n_bins) FROM n)), 9) AS mean_count FROM g")
def group_means(spark, sf_dir):
    t = tokens(spark, sf_dir)
    groups = spark.createDataFrame([(0, "low"), (1, "low"), (2, "high"), (3, "high")], "token int, variable_group string")
    return B.group_means(B.counts(t, DAY, ["node", "token"]), B.manifest(t, DAY), groups).withColumn("mean_count", F.round("mean_count", 9))


@query("""WITH f AS (SELECT event_id, 'f' || CAST(event_id % 23 AS VARCHAR) AS file FROM events), r AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT file FROM f))
    SELECT event_id, file FROM f JOIN r USING (file) WHERE i >= floor(n * 0.8) AND i < floor(n * 0.9)""")
def split_by_position(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), (F.col("event_id") % 23).cast("string")).alias("file"))
    return logs.split_of(e, "file", "val")


# --- sequences ---------------------------------------------------------------

_SEQ = "s AS (SELECT node, ts, event_id, token, row_number() OVER (ORDER BY node, ts, event_id) - 1 AS g FROM t)"
LENGTH, STRIDE, CAP = 64, 32, 10


def sequence(spark, sf_dir) -> DataFrame:
    return Q.ordinals(tokens(spark, sf_dir).select("node", "ts", "event_id", "token"), ["node", "ts", "event_id"])


def windowed(spark, sf_dir) -> DataFrame:
    seq = sequence(spark, sf_dir)
    return Q.window_rows(seq, tokens(spark, sf_dir).count(), LENGTH, STRIDE)


_WIN = f"""z AS (SELECT greatest(1, floor((count(*) - {LENGTH}) / {STRIDE}.0) + 1) AS nw FROM s),
    w AS (SELECT CAST(win AS BIGINT) AS win, g - win * {STRIDE} AS pos, node, ts, token FROM s, (SELECT unnest(range(0, CAST(nw AS BIGINT))) AS win FROM z) WHERE g BETWEEN win * {STRIDE} AND win * {STRIDE} + {LENGTH}),
    c AS (SELECT win, pos, ts, CASE WHEN token < 87 AND row_number() OVER (PARTITION BY win, token ORDER BY pos) > {CAP} THEN 88 ELSE token END AS token FROM w)"""


@query(f"WITH {T}, {_SEQ} SELECT g, node, ts, event_id, token FROM s")
def sorted_tokens(spark, sf_dir):
    return sequence(spark, sf_dir)


@query("SELECT CAST(0 AS BIGINT) AS faults")
def sort_check(spark, sf_dir):
    return Q.order_faults(sequence(spark, sf_dir), ["node", "ts", "event_id"]).agg(F.count(F.lit(1)).alias("faults"))


@query(f"WITH {T}, {_SEQ}, {_WIN} SELECT win, pos, token FROM c")
def sequence_windows(spark, sf_dir):
    return Q.capped(windowed(spark, sf_dir), CAP).select("win", "pos", "token")


@query(f"""WITH {T}, {_SEQ}, {_WIN}, d AS (SELECT win, pos, token, coalesce(least(greatest((ts - lag(ts) OVER (PARTITION BY win ORDER BY pos)) / 1e6, 0), 86400), 0) AS delta FROM c),
    a AS (SELECT win, list(token ORDER BY pos) AS k, sum(delta) FILTER (WHERE pos < {LENGTH}) AS total FROM d GROUP BY win)
    SELECT win, array_to_string([coalesce(k[i + 1], 87) FOR i IN range({LENGTH})], ',') AS event_ids, array_to_string([coalesce(k[i + 2], 87) FOR i IN range({LENGTH})], ',') AS target, CAST(round(total) AS BIGINT) AS seconds FROM a""")
def training_windows(spark, sf_dir):
    w = Q.training_windows(Q.with_deltas(Q.capped(windowed(spark, sf_dir), CAP), per_second=1_000_000), LENGTH)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return w.select("win", text("event_ids").alias("event_ids"), text("target").alias("target"), F.round("seconds", 0).cast("bigint").alias("seconds"))


@query(f"WITH {T}, {_SEQ}, {_WIN} SELECT win, string_agg(DISTINCT CAST(token AS VARCHAR), ',' ORDER BY CAST(token AS VARCHAR)) AS tokens FROM c GROUP BY win")
def window_uniques(spark, sf_dir):
    u = Q.window_uniques(Q.capped(windowed(spark, sf_dir), CAP))
    return u.select("win", F.array_join(F.array_sort(F.transform("tokens", lambda x: x.cast("string"))), ",").alias("tokens"))


_BASKET_SQL = """CASE WHEN d < 1 THEN CAST(greatest(least(trunc(d * 1000), 999), 0) AS INTEGER) WHEN d < 60 THEN 1000 + CAST(trunc(d - 1) AS INTEGER) WHEN d < 3600 THEN 1060 + CAST(trunc((d - 60) / 60) AS INTEGER)
    WHEN d < 86400 THEN 1120 + CAST(trunc((d - 3600) / 3600) AS INTEGER) WHEN d < 31536000 THEN 1144 + CAST(trunc((d - 86400) / 86400) AS INTEGER) ELSE 1509 END"""


@query(f"""WITH {T}, g AS (SELECT event_id, (ts - lag(ts) OVER (PARTITION BY node ORDER BY ts, event_id)) / 1e6 AS d FROM t), b AS (SELECT event_id, {_BASKET_SQL} AS basket FROM g WHERE d IS NOT NULL)
    SELECT event_id, basket, CASE WHEN basket < 1000 THEN basket || 'ms' WHEN basket < 1060 THEN basket - 999 || 's' WHEN basket < 1120 THEN basket - 1059 || 'min' WHEN basket < 1144 THEN basket - 1119 || 'hr' WHEN basket < 1509 THEN basket - 1143 || 'day' ELSE '365+days' END AS label FROM b""")
def time_baskets(spark, sf_dir):
    from pyspark.sql import Window as W

    d = (F.col("ts") - F.lag("ts").over(W.partitionBy("node").orderBy("ts", "event_id"))) / F.lit(1e6)
    gaps = tokens(spark, sf_dir).withColumn("d", d).where("d IS NOT NULL")
    return gaps.select("event_id", C.time_basket(F.col("d")).alias("basket")).withColumn("label", C.basket_label(F.col("basket")))


_NEXT = "p AS (SELECT node, token, lead(token) OVER (PARTITION BY node ORDER BY ts, event_id) AS next_token FROM t), pp AS (SELECT * FROM p WHERE next_token IS NOT NULL)"


def next_pairs(spark, sf_dir) -> DataFrame:
    return Q.next_tokens(tokens(spark, sf_dir), ["node"], ["ts", "event_id"])


@query(f"WITH {T}, {_NEXT} SELECT token, next_token, count(*) AS n FROM pp GROUP BY ALL")
def next_token_pairs(spark, sf_dir):
    return next_pairs(spark, sf_dir).groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {T} SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 3")
def top_tokens(spark, sf_dir):
    return Q.top_tokens(tokens(spark, sf_dir), 3)


@query("SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return Q.seeded_sample(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query("""WITH s AS (SELECT event_type, min(event_id) AS first_at FROM events GROUP BY 1) SELECT event_type AS value, CAST(row_number() OVER (ORDER BY first_at, event_type) AS INTEGER) AS id FROM s UNION ALL SELECT '<UNK>', 0""")
def first_seen_vocabulary(spark, sf_dir):
    return Q.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


# --- transfer entropy --------------------------------------------------------

SIX_HOURS = 6 * HOUR
_SERIES = f"""b AS (SELECT token, {floor_of(SIX_HOURS)} AS bin, count(*) % 3 AS c FROM t WHERE token < 4 GROUP BY ALL), lim AS (SELECT min(bin) AS lo, max(bin) AS hi FROM b),
    se AS (SELECT k.token, k.bin, coalesce(c, 0) AS x FROM (SELECT token, unnest(range(lo, hi + 1)) AS bin FROM (SELECT DISTINCT token FROM b), lim) k LEFT JOIN b USING (token, bin)),
    hs AS (SELECT token, bin, x AS y, row_number() OVER o - 1 AS i, lag(x, 3) OVER o || ',' || lag(x, 2) OVER o || ',' || lag(x, 1) OVER o AS h FROM se WINDOW o AS (PARTITION BY token ORDER BY bin)),
    wanted AS (SELECT DISTINCT a.token AS cause, e.token AS effect, tau FROM b a, b e, (SELECT unnest(range(1, 5)) AS tau) WHERE a.token <> e.token)"""
_TE = """jn AS (SELECT cause, effect, tau, s.x, h, y, count(*) AS n1 FROM wanted JOIN hs ON hs.token = effect AND i >= 3 + tau JOIN {src} s ON s.token = cause AND s.bin = hs.bin - tau - 1 GROUP BY ALL),
    cl AS (SELECT *, sum(n1) OVER (PARTITION BY cause, effect, tau, x, h) AS xh, sum(n1) OVER (PARTITION BY cause, effect, tau, h, y) AS hy, sum(n1) OVER (PARTITION BY cause, effect, tau, h) AS nh, sum(n1) OVER (PARTITION BY cause, effect, tau) AS n FROM jn),
    te AS (SELECT cause, effect, CAST(tau AS INTEGER) AS tau, greatest(sum(n1 / n * log2(n1 * nh / (xh * hy))), 0) AS te FROM cl GROUP BY ALL)"""


def series(spark, sf_dir) -> DataFrame:
    b = B.counts(R.known_tokens(tokens(spark, sf_dir), n=4), SIX_HOURS, ["token"]).withColumn("cnt", F.col("cnt") % 3)  # three symbols, whatever the scale
    span = b.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = b.select("token").distinct().crossJoin(F.broadcast(span)).select("token", F.explode(F.sequence("lo", "hi")).alias("bin"))  # tokens by bins
    return spine.join(b, ["token", "bin"], "left").select("token", "bin", F.coalesce("cnt", F.lit(0)).alias("x"))


def entropies(spark, sf_dir) -> DataFrame:
    s = series(spark, sf_dir)
    return E.transfer_entropy(s, E.lags(E.pairs(s.select("token").distinct()), 1, 4))


@query(f"WITH {T}, {_SERIES}, {_TE.format(src='se')} SELECT cause, effect, tau, round(te, 6) AS te FROM te")
def te_all_lags(spark, sf_dir):
    return entropies(spark, sf_dir).withColumn("te", F.round("te", 6))


@query(f"WITH {T}, {_SERIES}, {_TE.format(src='se')} SELECT cause, effect, arg_max(tau, struct_pack(a := te, b := -tau)) AS tau, round(max(te), 6) AS te FROM te GROUP BY cause, effect HAVING max(te) >= 1e-8")
def te_lag_search(spark, sf_dir):
    return E.best_lag(entropies(spark, sf_dir)).withColumn("te", F.round("te", 6))


@query(f"""WITH {T}, {_SERIES}, one AS (SELECT perm, a.token, a.bin, v.x FROM (SELECT perm, token, bin, row_number() OVER (PARTITION BY perm, token ORDER BY bin) AS i FROM se, (SELECT unnest(range(0, 20)) AS perm) WHERE token = 0) a
    JOIN (SELECT perm, x, row_number() OVER (PARTITION BY perm, token ORDER BY md5('0001:' || perm || ':' || bin), bin) AS i FROM se, (SELECT unnest(range(0, 20)) AS perm) WHERE token = 0) v USING (perm, i)),
    src AS (SELECT -1 AS perm, token, bin, x FROM se WHERE token = 0 UNION ALL SELECT perm, token, bin, x FROM one),
    jn AS (SELECT perm, s.x, h, y, count(*) AS n1 FROM hs JOIN src s ON s.bin = hs.bin - 2 WHERE hs.token = 1 AND i >= 4 GROUP BY ALL),
    cl AS (SELECT *, sum(n1) OVER (PARTITION BY perm, x, h) AS xh, sum(n1) OVER (PARTITION BY perm, h, y) AS hy, sum(n1) OVER (PARTITION BY perm, h) AS nh, sum(n1) OVER (PARTITION BY perm) AS n FROM jn),
    te AS (SELECT perm, greatest(sum(n1 / n * log2(n1 * nh / (xh * hy))), 0) AS te FROM cl GROUP BY perm)
    SELECT 0 AS cause, 1 AS effect, 1 AS tau, round(o.te, 6) AS te, round(avg(CASE WHEN s.te >= o.te THEN 1.0 ELSE 0 END), 6) AS p_value, avg(CASE WHEN s.te >= o.te THEN 1.0 ELSE 0 END) < {E.bonferroni()!r} AS significant
    FROM te s, te o WHERE o.perm = -1 AND s.perm >= 0 GROUP BY o.te""")
def te_permutation(spark, sf_dir):
    s = series(spark, sf_dir)
    wanted = spark.createDataFrame([(0, 1, 1)], "cause int, effect int, tau int")
    observed = E.transfer_entropy(s, wanted)
    perms = E.shuffled(s.where("token = 0"), "0001", 20)
    # each permutation is a source of its own: negative token numbers name them
    sources = perms.select((-1 - F.col("perm")).alias("token"), "bin", "x").unionByName(s.where("token = 1").select("token", "bin", "x"))
    asked = spark.range(20).select((-1 - F.col("id")).cast("int").alias("cause"), F.lit(1).alias("effect"), F.lit(1).alias("tau"))
    surrogate = E.transfer_entropy(sources, asked).select(F.lit(0).alias("cause"), "effect", "tau", F.col("te").alias("te_s"))
    return E.permutation_test(observed, surrogate).withColumns({"te": F.round("te", 6), "p_value": F.round("p_value", 6)})


@query(f"WITH {T}, {_SERIES} SELECT round(corr(a.x, e.x), 6) AS r FROM se a JOIN se e ON a.bin = e.bin - 1 WHERE a.token = 0 AND e.token = 1")
def lagged_correlation(spark, sf_dir):
    s = series(spark, sf_dir)
    cause = s.where("token = 0").select((F.col("bin") + 1).alias("bin"), F.col("x").alias("a"))
    return cause.join(s.where("token = 1").select("bin", "x"), "bin").agg(F.round(P.lagged_correlation("a", "x"), 6).alias("r"))


# The four queries above keep the residues that their SQL asks for, so what they find is not dependence; those below do the whole job.
CAPPED = ["10min", "1min"]


def _capped_sql(window: str) -> str:
    seconds, last = E.WINDOWS[window]
    return (
        _SERIES.replace(floor_of(SIX_HOURS), floor_of(seconds * 1_000_000)).replace("count(*) % 3", f"least(count(*), {CAP})").replace("range(1, 5)", f"range(1, {last + 1})")
    )


def _each_window(sql: str, ctes: str = "") -> str:
    """The rows of ``sql`` over the series of every window of CAPPED, named by the column at."""
    return " UNION ALL ".join(f"SELECT '{w}' AS at, * FROM (WITH {T}, {_capped_sql(w)}{ctes} {sql})" for w in CAPPED)


def capped_series(spark, sf_dir, window: str) -> DataFrame:
    """Counts by token and bin of one window, capped as in the reference, 0 where nothing happened."""
    b = B.counts(R.known_tokens(tokens(spark, sf_dir), n=4), E.WINDOWS[window][0] * 1_000_000, ["token"], cap=CAP)
    span = b.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = b.select("token").distinct().crossJoin(F.broadcast(span)).select("token", F.explode(F.sequence("lo", "hi")).alias("bin"))  # tokens by bins
    return spine.join(b, ["token", "bin"], "left").select("token", "bin", F.coalesce("cnt", F.lit(0)).alias("x"))


def each_window(spark, sf_dir, found: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What ``found`` gives for the series of every window of CAPPED, named by the column at."""
    parts = [found(capped_series(spark, sf_dir, w), w).select(F.lit(w).alias("at"), "*") for w in CAPPED]
    return functools.reduce(DataFrame.unionByName, parts)


def capped_entropies(series_: DataFrame, window: str) -> DataFrame:
    return E.transfer_entropy(series_, E.lags(E.pairs(series_.select("token").distinct()), 1, E.WINDOWS[window][1]))


@query(_each_window("SELECT cause, effect, tau, round(te, 6) AS te FROM te", f", {_TE.format(src='se')}"))
def te_capped_all_lags(spark, sf_dir):
    return each_window(spark, sf_dir, capped_entropies).withColumn("te", F.round("te", 6))


@query(_each_window("SELECT cause, effect, arg_max(tau, struct_pack(a := te, b := -tau)) AS tau, round(max(te), 6) AS te FROM te GROUP BY cause, effect HAVING max(te) >= 1e-8", f", {_TE.format(src='se')}"))
def te_capped_lag_search(spark, sf_dir):
    return each_window(spark, sf_dir, lambda s, w: E.best_lag(capped_entropies(s, w))).withColumn("te", F.round("te", 6))


@query()
def te_capped_permutation(spark, sf_dir):
    """Every ordered pair at its best lag, SHUFFLES permutations each."""
    found = each_window(spark, sf_dir, lambda s, w: E.permutation_tests(s, E.best_lag(capped_entropies(s, w))))
    return found.withColumns({c: F.round(c, 6) for c in ("te", "p_value")})


_CORRELATIONS = "SELECT a.token AS cause, e.token AS effect, CAST(tau AS INTEGER) AS tau, round(corr(a.x, e.x), 6) AS r FROM (SELECT DISTINCT tau FROM wanted) w, se a JOIN se e ON a.token <> e.token WHERE a.bin = e.bin - tau GROUP BY ALL"


def capped_correlations(series_: DataFrame, window: str) -> DataFrame:
    wanted = E.lags(E.pairs(series_.select("token").distinct()), 1, E.WINDOWS[window][1])
    effect = series_.select(F.col("token").alias("effect"), F.col("bin").alias("to"), F.col("x").alias("y"))
    both = effect.join(F.broadcast(wanted), "effect").withColumn("bin", F.col("to") - F.col("tau")).join(series_.withColumnRenamed("token", "cause"), ["cause", "bin"])
    return both.groupBy("cause", "effect", "tau").agg(F.round(P.lagged_correlation("x", "y"), 6).alias("r"))


@query(_each_window(_CORRELATIONS))
def lagged_correlations(spark, sf_dir):
    return each_window(spark, sf_dir, capped_correlations)


# --- sampling and graphs -----------------------------------------------------


@query(f"WITH {T} SELECT node, 'nat_' || lpad(CAST(((row_number() OVER (ORDER BY node) - 1) // 8) * 8 AS VARCHAR), 5, '0') AS \"group\" FROM (SELECT DISTINCT node FROM t)")
def node_groups(spark, sf_dir):
    return S.node_groups(tokens(spark, sf_dir).select("node").distinct())


HALF = 12
_RARE = f"""h AS (SELECT node, {floor_of(HOUR)} AS hour, max(CASE WHEN token = 1 THEN 1 ELSE 0 END) AS rare FROM t GROUP BY ALL), o AS (SELECT node, min(hour) AS lo, max(hour) AS hi FROM h GROUP BY node),
    r AS (SELECT node, hour - lo AS r, hi - lo AS lim, row_number() OVER (PARTITION BY node ORDER BY hour) AS k FROM h JOIN o USING (node) WHERE rare = 1)"""


def _cover(half: int) -> str:
    return f"""cov(node, k, lo, hi, opened) AS (SELECT node, k, greatest(r - {half}, 0), least(r + {half}, lim), TRUE FROM r WHERE k = 1
    UNION ALL SELECT c.node, r.k, CASE WHEN r.r <= c.hi THEN c.lo ELSE greatest(r.r - {half}, 0) END, CASE WHEN r.r <= c.hi THEN c.hi ELSE least(r.r + {half}, r.lim) END, r.r > c.hi FROM cov c JOIN r ON r.node = c.node AND r.k = c.k + 1)"""


_COVER = _cover(HALF)


def rare_rows(spark, sf_dir) -> DataFrame:
    hours = tokens(spark, sf_dir).groupBy("node", B.bin_of(F.col("ts"), HOUR).alias("hour")).agg(F.max((F.col("token") == 1).cast("int")).alias("rare"))
    span = hours.groupBy("node").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    return hours.where("rare = 1").join(span, "node").select("node", (F.col("hour") - F.col("lo")).alias("r"), (F.col("hi") - F.col("lo")).alias("lim"))


@query(f"WITH RECURSIVE {T}, {_RARE}, {_COVER} SELECT node, lo, hi FROM cov WHERE opened")
def rare_windows(spark, sf_dir):
    return S.greedy_cover(rare_rows(spark, sf_dir), ["node"], "r", HALF, "lim")


@query(f"""WITH RECURSIVE {T}, {_RARE}, {_COVER}, wn AS (SELECT node, lo, hi FROM cov WHERE opened),
    fl AS (SELECT node, lo, hi, CASE WHEN lo > max(hi) OVER (PARTITION BY node ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS opens FROM wn),
    sg AS (SELECT node, lo, hi, CAST(sum(opens) OVER (PARTITION BY node ORDER BY lo, hi) AS BIGINT) AS segment FROM fl) SELECT node, segment, min(lo) AS lo, max(hi) AS hi FROM sg GROUP BY node, segment""")
def merged_windows(spark, sf_dir):
    return S.merged(S.greedy_cover(rare_rows(spark, sf_dir), ["node"], "r", HALF, "lim"), ["node"])


@query(f"""WITH {T}, {_M}, s AS (SELECT node, token, count(*) AS s FROM t GROUP BY ALL) SELECT node, token FROM s JOIN n USING (node) WHERE s * 1.0 / n_bins < 0.4""")
def rare_tokens(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return S.rare_tokens(B.counts(t, DAY, ["node", "token"]), B.manifest(t, DAY), 0.4)


def day_cells(spark, sf_dir) -> DataFrame:
    """group, node, t, token, cnt with a row for every day of a node; token and cnt null where nothing happened."""
    t = tokens(spark, sf_dir)
    m = B.manifest(t, DAY).select("node", "min_bin", "n_bins")
    spine = m.select("node", "min_bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("t"))
    cells = B.counts(R.known_tokens(t, n=4), DAY, ["node", "token"]).withColumnRenamed("bin", "b")
    full = spine.join(cells.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & (F.col("min_bin") + F.col("t") == F.col("b")), "left")
    return full.select("node", "t", "token", F.coalesce("cnt", F.lit(0)).alias("cnt")).join(S.node_groups(t.select("node")), "node")


TARGET, SAMPLE_WINDOW, RARE = 20, 6, 0.1
_GROUPS = "g AS (SELECT node, 'nat_' || lpad(CAST(((row_number() OVER (ORDER BY node) - 1) // 8) * 8 AS VARCHAR), 5, '0') AS \"group\" FROM (SELECT DISTINCT node FROM t))"
_SAMPLE = f"""WITH RECURSIVE {T}, {_M}, {_GROUPS},
    ce AS (SELECT node, {floor_of(DAY)} AS b, token, count(*) AS cnt FROM t WHERE token BETWEEN 0 AND 3 GROUP BY ALL),
    cl AS (SELECT sp.node, sp.t, n_bins, token, cnt FROM (SELECT node, min_bin, n_bins, unnest(range(0, n_bins)) AS t FROM n) sp LEFT JOIN ce ON ce.node = sp.node AND b = min_bin + sp.t),
    rw AS (SELECT node, t, coalesce(sum(cnt), 0) AS total FROM cl GROUP BY node, t),
    ra AS (SELECT node, token FROM cl WHERE cnt > 0 GROUP BY node, token HAVING sum(cnt) * 1.0 / max(n_bins) < {RARE}),
    r AS (SELECT node, t AS r, n_bins - 1 AS lim, row_number() OVER (PARTITION BY node ORDER BY t) AS k FROM (SELECT DISTINCT node, t, n_bins FROM cl JOIN ra USING (node, token) WHERE cnt > 0)),
    {_cover(SAMPLE_WINDOW // 2)},
    kn AS (SELECT DISTINCT node, t FROM (SELECT node, unnest(range(lo, hi + 1)) AS t FROM cov WHERE opened)),
    fl AS (SELECT rw.*, kn.t IS NOT NULL AS known FROM rw LEFT JOIN kn USING (node, t)),
    pl AS (SELECT *, CASE WHEN NOT known THEN row_number() OVER (PARTITION BY node, known ORDER BY total <= 0, md5(concat_ws(':', '42', node, CAST(t AS VARCHAR)))) END AS place FROM fl),
    re AS (SELECT *, CASE WHEN known THEN 0 ELSE min(place) OVER (PARTITION BY node ORDER BY t RANGE BETWEEN {SAMPLE_WINDOW // 2} PRECEDING AND {SAMPLE_WINDOW // 2} FOLLOWING) END AS reached FROM pl),
    en AS (SELECT node, max(reached) FILTER (WHERE k <= {TARGET}) AS upto FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY reached, t) AS k FROM re) GROUP BY node),
    op AS (SELECT node, t, CASE WHEN t > lag(t) OVER (PARTITION BY node ORDER BY t) + 1 THEN 1 ELSE 0 END AS opens FROM re JOIN en USING (node) WHERE reached <= upto OR known),
    sm AS (SELECT "group", node, CAST(sum(opens) OVER (PARTITION BY node ORDER BY t) AS BIGINT) AS segment, t FROM op JOIN g USING (node))"""


@query(f"{_SAMPLE} SELECT * FROM sm")
def contiguous_sample(spark, sf_dir):
    return S.contiguous_sample(day_cells(spark, sf_dir), TARGET, SAMPLE_WINDOW, RARE)


@query(f"""{_SAMPLE} SELECT *, FALSE AS is_separator FROM sm UNION ALL SELECT DISTINCT "group", node, segment, CAST(NULL AS BIGINT) AS t, TRUE AS is_separator
    FROM (SELECT *, max(segment) OVER (PARTITION BY node) AS last FROM sm) WHERE segment < last""")
def separated_sample(spark, sf_dir):
    return S.separated(contiguous_sample(spark, sf_dir))


@query(f"""WITH {T}, {_GROUPS}, li AS (SELECT "group", row_number() OVER (ORDER BY "group") - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT "group" FROM g)),
    mx AS (SELECT i AS c, n, n // 2 AS half FROM li WHERE i < floor(n * 0.5) AND n > 1),
    sd AS (SELECT c, CAST('0x' || substr(md5('42:a:' || c), 1, 8) AS BIGINT) % half AS i FROM mx UNION ALL SELECT c, half + CAST('0x' || substr(md5('42:b:' || c), 1, 8) AS BIGINT) % (n - half) FROM mx),
    rk AS (SELECT c, node, row_number() OVER (PARTITION BY c, i ORDER BY md5('42:' || c || ':' || node)) AS k FROM sd JOIN li USING (i) JOIN g USING ("group"))
    SELECT node, 'cross_' || lpad(CAST(c AS VARCHAR), 5, '0') AS "group" FROM rk WHERE k <= 4""")
def cross_groups(spark, sf_dir):
    return S.cross_groups(node_groups(spark, sf_dir), 0.5)


@query()
def pcmci_links(spark, sf_dir):
    cells = day_cells(spark, sf_dir).select("group", "node", F.lit(0).alias("segment"), "t", VOCABULARY.name(F.col("token")).alias("var"), F.col("cnt").alias("value"))
    return P.real_edges(P.group_links(cells, NAMES, alpha=0.05))


# --- links -------------------------------------------------------------------

_LINKS = f"""{_NEXT}, q AS (SELECT CAST(substr(node, 5) AS BIGINT) // 8 AS gi, token, next_token, count(*) AS n FROM pp GROUP BY ALL), tot AS (SELECT gi, sum(n) AS total FROM q GROUP BY gi),
    lk AS (SELECT ['click', 'error', 'purchase', 'signup'][token + 1] AS cause, ['click', 'error', 'purchase', 'signup'][next_token + 1] AS effect, CAST(1 + n % 2 AS INTEGER) AS tau, n / 100.0 AS val, 1.0 / (n * n + 1) AS p_val, '-->' AS edge,
        'nat_' || lpad(CAST(gi * 8 AS VARCHAR), 5, '0') AS group_id, CAST(total AS BIGINT) AS T_data_rows FROM q JOIN tot USING (gi) WHERE token < 4 AND next_token < 4)"""


def group_links(spark, sf_dir) -> DataFrame:
    """Links as a group's job would leave them, from counts of successions."""
    p = next_pairs(spark, sf_dir).withColumn("gi", F.floor(F.col("user_id") / 8)).groupBy("gi", "token", "next_token").agg(F.count(F.lit(1)).alias("n"))
    total = p.groupBy("gi").agg(F.sum("n").alias("T_data_rows"))
    rows = p.join(total, "gi").where("token < 4 AND next_token < 4")
    name = VOCABULARY.name
    return rows.select(
        name(F.col("token")).alias("cause"), name(F.col("next_token")).alias("effect"), (1 + F.col("n") % 2).cast("int").alias("tau"), (F.col("n") / 100.0).alias("val"), (1.0 / (F.col("n") * F.col("n") + 1)).alias("p_val"), F.lit("-->").alias("edge"),
        F.concat(F.lit("nat_"), F.lpad((F.col("gi") * 8).cast("string"), 5, "0")).alias("group_id"), "T_data_rows",
    )


@query(f"WITH {T}, {_LINKS} SELECT cause, effect, tau, min(p_val) AS p_val, arg_min(group_id, struct_pack(a := p_val, b := group_id)) AS group_id, round(arg_min(val, struct_pack(a := p_val, b := group_id)), 9) AS val FROM lk GROUP BY cause, effect, tau")
def links_best(spark, sf_dir):
    return L.best(group_links(spark, sf_dir)).select("cause", "effect", "tau", "p_val", "group_id", F.round("val", 9).alias("val"))


_FISHER = """fi AS (SELECT cause, effect, tau, count(*) AS n_votes, min(p_val) AS p_val_best, -sum(ln(greatest(p_val, 1e-300))) AS half, exp(sum(sqrt(T_data_rows) * ln(greatest(p_val, 1e-300))) / sum(sqrt(T_data_rows))) AS geo FROM lk WHERE T_data_rows >= 20 GROUP BY ALL HAVING count(*) >= 2),
    fp AS (SELECT *, least(exp(-half) * list_sum([exp(i * ln(half) - lgamma(i + 1)) FOR i IN range(n_votes)]), 1.0) AS p FROM fi)"""


@query(f"WITH {T}, {_LINKS}, {_FISHER} SELECT cause, effect, tau, n_votes, p_val_best, round(p, 9) AS p_val FROM fp WHERE p <= 0.01")
def links_voted(spark, sf_dir):
    v = L.voted(group_links(spark, sf_dir), weighted=False, min_rows=20)
    return v.select("cause", "effect", "tau", "n_votes", "p_val_best", F.round("p_val", 9).alias("p_val"))


@query(f"WITH {T}, {_LINKS}, {_FISHER} SELECT cause, effect, tau, n_votes, round(geo, 9) AS p_val FROM fi WHERE geo <= 0.5")
def links_voted_weighted(spark, sf_dir):
    v = L.voted(group_links(spark, sf_dir), min_rows=20, alpha=0.5)
    return v.select("cause", "effect", "tau", "n_votes", F.round("p_val", 9).alias("p_val"))


@query(f"""WITH {T}, {_DIST}, {_LINKS}, {_FISHER}, j AS (SELECT fp.cause, fp.effect, fp.tau, n_votes, p, a.rarity AS ra, e.rarity AS re, least(greatest(1, a.nodes_with_event // 8), greatest(1, e.nodes_with_event // 8)) AS max_votes, a.total_count AS cause_count, e.total_count AS effect_count
        FROM fp JOIN dist a ON a.event = fp.cause JOIN dist e ON e.event = fp.effect WHERE p <= 0.01),
    o AS (SELECT *, CASE WHEN list_position(['ZERO', 'ULTRA_RARE', 'RARE', 'MODERATE', 'COMMON', 'VERY_COMMON'], ra) < list_position(['ZERO', 'ULTRA_RARE', 'RARE', 'MODERATE', 'COMMON', 'VERY_COMMON'], re) THEN ra ELSE re END AS edge_rarity FROM j)
    SELECT cause, effect, tau, n_votes, edge_rarity, CAST(max_votes AS BIGINT) AS max_votes, round(round(least(1.0, n_votes * 1.0 / max_votes), 4), 3) AS vote_fraction, round(round(least(1.0, n_votes * 1.0 / max_votes) * -log10(greatest(p, 1e-300)), 4), 3) AS score, cause_count, effect_count
    FROM o WHERE p <= CASE edge_rarity WHEN 'ULTRA_RARE' THEN 1e-4 WHEN 'RARE' THEN 1e-3 WHEN 'MODERATE' THEN 5e-3 ELSE 1e-2 END""")
def link_scores(spark, sf_dir):
    s = L.scored(L.voted(group_links(spark, sf_dir), weighted=False, min_rows=20), B.distribution(tokens(spark, sf_dir)))
    return L.ranked(s).select("cause", "effect", "tau", "n_votes", "edge_rarity", "max_votes", F.round("vote_fraction", 3).alias("vote_fraction"), F.round("score", 3).alias("score"), "cause_count", "effect_count")


@query(f"WITH {T}, {_LINKS} SELECT cause, effect, tau, p_val, group_id FROM lk ORDER BY p_val, cause, effect, tau, group_id LIMIT 20")
def topk_links(spark, sf_dir):
    return group_links(spark, sf_dir).select("cause", "effect", "tau", "p_val", "group_id").orderBy("p_val", "cause", "effect", "tau", "group_id").limit(20)


@query(f"WITH {T}, {_LINKS}, {_FISHER} SELECT cause, effect, tau, CAST(n_votes AS INTEGER) AS n_votes, '-->' AS edge FROM fp WHERE p <= 0.01")
def report_round_trip(spark, sf_dir):
    v = L.voted(group_links(spark, sf_dir), weighted=False, min_rows=20).withColumn("p_comb", F.col("p_val"))
    lines = v.select(logs.report_line().alias("value")).unionByName(spark.createDataFrame([("cause tau edge effect",)], "value string"))
    return logs.parse_report(lines).select("cause", "effect", "tau", "n_votes", "edge")


@query("SELECT CAST(a.t AS INTEGER) AS cause, CAST(b.t AS INTEGER) AS effect, CAST(tau AS INTEGER) AS tau FROM (SELECT unnest(range(0, 5)) AS t) a, (SELECT unnest(range(0, 5)) AS t) b, (SELECT unnest(range(1, 4)) AS tau) WHERE a.t <> b.t")
def pair_lags(spark, sf_dir):
    return E.lags(E.pairs(spark.range(5).select(F.col("id").cast("int").alias("token"))), 1, 3)


# --- work, model, effects ------------------------------------------------------


@query(f"WITH {T} SELECT DISTINCT node FROM t WHERE node NOT IN (SELECT DISTINCT node FROM t WHERE token = 1 AND event_id % 97 = 0)")
def pending_work(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return K.pending(t.select("node").distinct(), t.where("token = 1 AND event_id % 97 = 0").select("node").distinct(), ["node"])


@query(f"WITH {T} SELECT DISTINCT node FROM t WHERE token IN (0, 1)")
def completed_work(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return K.completed(t.where("token = 0").select("node"), t.where("token = 1").select("node"))


@query(f"WITH {T}, f AS (SELECT DISTINCT node, 'part-' || (event_id % 7) || '.parquet' AS f FROM t) SELECT node, string_agg('/data/' || f, ',' ORDER BY f) AS files FROM f WHERE f <> 'part-3.parquet' GROUP BY node")
def manifest_files(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("f", F.concat(F.lit("/old/part-"), (F.col("event_id") % 7).cast("string"), F.lit(".parquet")))
    listing = spark.createDataFrame([(f"/data/part-{i}.parquet",) for i in range(7) if i != 3], "path string")
    return K.files_of(B.manifest(t, DAY, file="f"), listing).select("node", F.array_join("files", ",").alias("files"))


@query("SELECT event_id, event_id % 5 AS worker, CAST(least(event_id // greatest(1, (SELECT count(*) FROM events) // 6), 5) AS INTEGER) AS chunk FROM events")
def work_assignment(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select("event_id", K.round_robin(F.col("event_id"), 5).alias("worker"), K.chunk_of(F.col("event_id"), e.count(), 6).alias("chunk"))


_MODEL = "mo AS (SELECT token, next_token, n, (n + 1.0) / (sum(n) OVER (PARTITION BY token) + 90) AS p FROM (SELECT token, next_token, count(*) AS n FROM pp GROUP BY ALL))"


@query(f"WITH {T}, {_NEXT}, {_MODEL} SELECT token, next_token, n, round(p, 9) AS p FROM mo")
def ngram_model(spark, sf_dir):
    return X.ngram_model(next_pairs(spark, sf_dir), 90).withColumn("p", F.round("p", 9))


@query(f"""WITH {T}, {_NEXT}, {_MODEL}, rk AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY p DESC, next_token) AS r FROM mo)
    SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN r = 1 THEN n ELSE 0 END) / sum(n), 9) AS accuracy, round(sum(CASE WHEN r <= 5 THEN n ELSE 0 END) / sum(n), 9) AS top5_accuracy FROM rk WHERE next_token NOT IN (87, 88, 89)""")
def top5_accuracy(spark, sf_dir):
    p = next_pairs(spark, sf_dir)
    return X.accuracy(p, X.ngram_model(p, 90)).withColumns({c: F.round(c, 9) for c in ("accuracy", "top5_accuracy")})


@query(f"WITH {T}, {_NEXT}, {_MODEL} SELECT round(sum(-ln(p) * n) / sum(n), 9) AS loss FROM mo WHERE next_token NOT IN (87, 88, 89)")
def cross_entropy(spark, sf_dir):
    p = next_pairs(spark, sf_dir)
    return X.cross_entropy(p, X.ngram_model(p, 90), 90).withColumn("loss", F.round("loss", 9))


@query("SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)")
def rank_mean(spark, sf_dir):
    return X.rank_mean(table(spark, sf_dir, "events"), "user_id", "value").withColumn("mean_of_means", F.round("mean_of_means", 6))


def short_windows(spark, sf_dir) -> DataFrame:
    return Q.window_rows(sequence(spark, sf_dir), tokens(spark, sf_dir).count(), 3, 3)


_SHORT = """w3 AS (SELECT win, token, min(pos) AS pos FROM (SELECT i AS win, g - i * 3 AS pos, token FROM s, (SELECT unnest(range(0, CAST(greatest(1, floor((count(*) - 3) / 3.0) + 1) AS BIGINT))) AS i FROM s) WHERE g BETWEEN i * 3 AND i * 3 + 3) GROUP BY ALL),
    nc AS (SELECT token, count(*) AS n FROM w3 GROUP BY token), na AS (SELECT count(DISTINCT win) AS n FROM w3),
    ef AS (SELECT a.token AS cause, e.token AS effect, count(*) AS n_both, sum(CASE WHEN e.pos > a.pos THEN 1 ELSE 0 END) AS n_after, avg(e.pos - a.pos) AS tgap FROM w3 a JOIN w3 e ON a.win = e.win AND a.token <> e.token GROUP BY ALL),
    ae AS (SELECT cause, effect, n_after / c.n - CASE WHEN na.n > c.n THEN (x.n - n_both) / (na.n - c.n) ELSE 0 END AS ate, tgap, c.n AS n FROM ef JOIN nc c ON c.token = cause JOIN nc x ON x.token = effect, na)"""


@query(f"WITH {T}, {_SEQ}, {_SHORT} SELECT cause, effect, round(ate, 6) AS ate, round(tgap, 6) AS tgap, n FROM ae WHERE n >= 10")
def effect_table(spark, sf_dir):
    return X.effects(short_windows(spark, sf_dir), n_bootstrap=20).select("cause", "effect", F.round("ate", 6).alias("ate"), F.round("tgap", 6).alias("tgap"), "n")


@query()
def effect_intervals(spark, sf_dir):
    return X.effects(windowed(spark, sf_dir), n_bootstrap=500)


@query(f"WITH {T}, {_NEXT}, {_MODEL} SELECT token AS cause, next_token AS effect, round(p, 6) AS ate FROM mo WHERE token <> next_token AND p >= 0.1")
def effect_edges(spark, sf_dir):
    return X.edges(_model_edges(spark, sf_dir), 0.1).withColumn("ate", F.round("ate", 6))


def _model_edges(spark, sf_dir) -> DataFrame:
    m = X.ngram_model(next_pairs(spark, sf_dir), 90)
    return m.where("token <> next_token").select(F.col("token").alias("cause"), F.col("next_token").alias("effect"), F.col("p").alias("ate"))


@query(f"""WITH RECURSIVE {T}, {_NEXT}, {_MODEL}, ed AS (SELECT token AS c, next_token AS e, p AS a FROM mo WHERE token <> next_token AND p >= 0.05),
    cas(pth, last, total) AS (SELECT [c, e], e, CAST(a AS DOUBLE) FROM ed UNION ALL SELECT list_append(pth, e), e, total * a FROM cas JOIN ed ON c = last WHERE NOT list_contains(pth, e) AND len(pth) < 5 AND total * a >= 0.02)
    SELECT array_to_string(pth, '>') AS path, CAST(len(pth) - 1 AS INTEGER) AS depth, round(total, 6) AS effect FROM cas WHERE total >= 0.02""")
def cascades(spark, sf_dir):
    return X.cascades(X.edges(_model_edges(spark, sf_dir), 0.05), 4).withColumn("effect", F.round("effect", 6))


@query(f"WITH {T}, {_NEXT}, {_MODEL} SELECT CAST(a.t AS INTEGER) AS cause, CAST(b.t AS INTEGER) AS effect, round(coalesce(p, 0), 6) AS ate FROM (SELECT unnest(range(0, 6)) AS t) a CROSS JOIN (SELECT unnest(range(0, 6)) AS t) b LEFT JOIN mo ON mo.token = a.t AND mo.next_token = b.t WHERE a.t <> b.t")
def effect_matrix(spark, sf_dir):
    wanted = E.pairs(spark.range(6).select(F.col("id").cast("int").alias("token")))
    return X.full_matrix(wanted, _model_edges(spark, sf_dir)).withColumn("ate", F.round("ate", 6))


@query(f"WITH {T}, {_NEXT}, {_MODEL} SELECT printf('Explain why %s may lead to %s (average effect %.4f, 95%% interval %.4f to %.4f).', CAST(token AS VARCHAR), CAST(next_token AS VARCHAR), CAST(p AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)) AS prompt FROM mo WHERE token <> next_token")
def edge_prompts(spark, sf_dir):
    none = F.lit(None).cast("double")
    return _model_edges(spark, sf_dir).select(X.explanation(F.col("cause").cast("string"), F.col("effect").cast("string"), F.col("ate"), none, none).alias("prompt"))


# --- notes -------------------------------------------------------------------


def notes(spark, sf_dir) -> DataFrame:
    """Documents as notes; each links to the next document and to one that does not exist."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.col("text"), F.lit("\nsee [[dir/n"), (F.col("doc_id") + 1).cast("string"), F.lit("]] and [[gone]]"))
    return d.select(F.concat(F.lit("dir/n"), F.col("doc_id").cast("string")).alias("note"), body.alias("body"))


_NOTES = "nt AS (SELECT 'dir/n' || doc_id AS note, text || chr(10) || 'see [[dir/n' || (doc_id + 1) || ']] and [[gone]]' AS body FROM documents), nl AS (SELECT note, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM nt)"


@query(f"""WITH {_NOTES}, x AS (SELECT note, line, text, string_agg(text, chr(10)) OVER (PARTITION BY note ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM nl)
    SELECT note, CAST(line AS VARCHAR) AS line, context FROM x WHERE contains(lower(text), 'licensed under')""")
def note_search(spark, sf_dir):
    return N.search(notes(spark, sf_dir), "Licensed UNDER")


@query(f"WITH {_NOTES}, k AS (SELECT note, unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)\\]\\]', 1)) AS target FROM nt) SELECT DISTINCT k.note, target, m.note IS NOT NULL AS resolved FROM k LEFT JOIN nt m ON m.note = target")
def note_links(spark, sf_dir):
    return N.wiki_links(notes(spark, sf_dir))


@query(f"WITH {_NOTES}, k AS (SELECT note, unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)\\]\\]', 1)) AS target FROM nt) SELECT DISTINCT k.note, target FROM k LEFT JOIN nt m ON m.note = target WHERE m.note IS NULL")
def dangling_links(spark, sf_dir):
    return N.dangling(notes(spark, sf_dir))


@query(f"WITH {_NOTES} SELECT note FROM nt WHERE starts_with(note, 'dir/') ORDER BY note")
def note_list(spark, sf_dir):
    return N.listing(notes(spark, sf_dir), "dir")


@query(f"WITH {_NOTES}, a AS (SELECT unnest(['[[dir/n1]]', 'dir/n2.md', ' dir/n3 ', 'nope']) AS name, unnest(['dir/n1', 'dir/n2', 'dir/n3', 'nope']) AS note) SELECT name, coalesce(body, 'Note not found: ' || name) AS body FROM a LEFT JOIN nt USING (note)")
def note_read(spark, sf_dir):
    wanted = spark.createDataFrame([("[[dir/n1]]",), ("dir/n2.md",), (" dir/n3 ",), ("nope",)], "name string")
    return N.read_note(notes(spark, sf_dir), wanted)


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'no record' WHEN 1 THEN NULL ELSE 'd' || event_id END AS said, event_id % 3 = 2 AS valid, count(*) AS n FROM events GROUP BY ALL")
def diagnosis_records(spark, sf_dir):
    i = F.col("event_id") % 3
    whole = F.to_json(F.struct(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("diagnosis"), F.array(F.lit("a")).alias("affected_components"), F.lit("network").alias("domain"), F.lit("high").alias("severity"), F.array(F.lit("b")).alias("causal_chain"), F.array(F.lit("c")).alias("recommended_actions"), F.array(F.struct(F.lit("s").alias("source"), F.lit("x").alias("excerpt"))).alias("supporting_evidence")))
    text = F.when(i == 0, "no record").when(i == 1, '{"severity": "high"}').otherwise(whole)
    out = N.diagnoses(table(spark, sf_dir, "events").select(text.alias("value")))
    return out.select(F.when(F.col("raw") == "no record", F.col("raw")).otherwise(F.col("diagnosis")).alias("said"), "valid").groupBy("said", "valid").agg(F.count(F.lit(1)).alias("n"))
