"""URL filters by temporal list join.

Dated list events (an entry is added or removed) become validity intervals; each
capture meets the intervals of its own keys that hold at its fetch time. Keys of
a capture are its URL with and without query string and port, every path prefix, its host and every parent
domain, so the join is an equi-join on (kind, entry) with a range on time: no
scan of the list per capture. Of the entries that hold, the most specific
decides; on a tie allow beats block.

Events of one entry are few and ordered by a window over that entry. Captures
of a hot host meet a handful of intervals each; AQE may split that join.

Defined results: null or empty urls have no key and are not blocked; a null
fetch time meets nothing; an entry that is added again while it holds starts a
new interval; of events of one entry at one instant, remove comes first, so an
add at the same time holds; repeated rows are judged each alike; extra columns
of captures of any name are kept (``url_filter`` is replaced by the operator's own);
an empty table gives no rows; a very long url has a key for each part of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import columns_of, whole_row

#: Specificity of the kinds of entry.
KINDS = {"domain": 1, "host": 2, "prefix": 3, "url": 4}
FOREVER = 1 << 62

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)"

PORT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?[^/:?#]*(:[0-9]+)"
QUERY = r"^[^?#]*(\?[^#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def port_of(url: Column) -> Column:
    """The port with its colon, or nothing."""
    return F.regexp_extract(url, PORT, 1)


def query_of(url: Column) -> Column:
    """The query string with its question mark, or nothing."""
    return F.regexp_extract(url, QUERY, 1)


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, entry, verdict, valid_from, valid_to (exclusive) of events (list, kind, entry, verdict, action, at)."""
    w = W.partitionBy("list", "kind", "entry").orderBy("at", F.when(F.col("action") == "remove", 0).otherwise(1), "verdict")
    rows = events.withColumn("valid_to", F.coalesce(F.lead("at").over(w), F.lit(FOREVER)))
    return rows.where((F.col("action") == "add") & (F.col("valid_to") > F.col("at"))).select("list", "kind", "entry", "verdict", F.col("at").alias("valid_from"), "valid_to")


def keys_of(host: Column, path: Column, port: Column, query: Column) -> Column:
    """Every (kind, entry) that can name a URL."""
    labels, parts = F.split(host, "\\.", -1), F.filter(F.split(path, "/", -1), lambda p: p != "")
    key = lambda kind, entry: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"))
    ends = F.when(F.size(labels) > 1, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(ends, lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    depths = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(depths, lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    urls = F.array_distinct(F.array(*[key("url", F.concat(host, p, path, q)) for p in (F.lit(""), port) for q in (F.lit(""), query)]))
    return F.when(host != "", F.concat(F.array(key("host", host)), urls, F.array_distinct(domains), prefixes))


def decide(captures: DataFrame, lists: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures with a struct column ``url_filter``: blocked, n_active, kind and entry that decided."""
    captures = captures.drop("url_filter")
    rows = captures.select(whole_row(captures).alias("row"), F.struct(F.col(url), F.col(at)).alias("u_row"), host_of(F.col(url)).alias("u_host"), path_of(F.col(url)).alias("u_path"))
    seen = rows.select("u_row", "u_host", "u_path").groupBy("u_row", "u_host", "u_path").agg(F.lit(1).alias("one"))
    whole = F.col("u_row")[url]
    keyed = seen.select("u_row", F.explode(keys_of(F.col("u_host"), F.col("u_path"), port_of(whole), query_of(whole))).alias("k")).select("u_row", "k.kind", "k.entry")
    met = keyed.join(lists, ["kind", "entry"]).where((F.col("valid_from") <= F.col(f"u_row.{at}")) & (F.col(f"u_row.{at}") < F.col("valid_to")))
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    weight = F.struct(rank[F.col("kind")].alias("rank"), F.length("entry").alias("length"), (F.col("verdict") == "allow").alias("allows"), "kind", "entry")
    best = met.groupBy("u_row").agg(F.max(weight).alias("best"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u_row", "b_row")
    out = rows.join(best, F.col("u_row").eqNullSafe(F.col("b_row")), "left")
    verdict = F.struct(
        F.coalesce(~F.col("best.allows"), F.lit(False)).alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.kind").alias("kind"), F.col("best.entry").alias("entry"),
    )
    return out.select(*columns_of(captures), verdict.alias("url_filter"))


def _digit(of: Column, salt: str, n: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), of)), 1, 7), 16, 10).cast("long")) % n


START, DAY = 1_704_067_200, 86_400


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` carry no fetch time; one is derived from the id, over a year from START."""
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919 * 60, F.lit(365 * DAY))).alias("fetched_at"))


def derived_events(pages: DataFrame) -> DataFrame:
    """List events for the hosts of ``pages``, by hash of the host: blocked for some months, a language path allowed within."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    host = F.col("h")
    added = F.lit(START) + _digit(host, "a", 300) * DAY
    event = lambda kind, entry, verdict, action, at: F.struct(F.lit("derived").alias("list"), F.lit(kind).alias("kind"), entry.alias("entry"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at.alias("at"))
    blocked = F.array(event("host", host, "block", "add", added), event("host", host, "block", "remove", added + 60 * DAY), event("host", host, "block", "add", added + 90 * DAY))
    allowed = F.array(event("prefix", F.concat(host, F.lit("/en")), "allow", "add", added + 10 * DAY), event("prefix", F.concat(host, F.lit("/en")), "allow", "remove", added + 30 * DAY))
    none = F.array().cast("array<struct<list:string,kind:string,entry:string,verdict:string,action:string,at:bigint>>")
    every = F.concat(F.when(_digit(host, "b", 2) == 0, blocked).otherwise(none), F.when(_digit(host, "c", 3) == 0, allowed).otherwise(none))
    return hosts.select(F.explode(every).alias("e")).select("e.*")


def report(pages: DataFrame) -> DataFrame:
    out = decide(dated_captures(pages), intervals(derived_events(pages)))
    return out.select("page_id", "fetched_at", "url_filter.blocked", "url_filter.n_active", F.col("url_filter.kind").alias("decided_by"), F.col("url_filter.entry").alias("entry"))


_D = "CAST(('0x' || substr(md5('{s}' || h), 1, 7)) AS BIGINT) % {n}"
ORACLE_SQL = rf"""
    WITH c AS (SELECT page_id, url, {START} + ((page_id * 7919 * 60) % ({365 * DAY}) + {365 * DAY}) % ({365 * DAY}) AS fetched_at,
                      lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS h, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS p FROM pages),
    x AS (SELECT h, {START} + {_D.format(s='a', n=300)} * {DAY} AS a, {_D.format(s='b', n=2)} AS b, {_D.format(s='c', n=3)} AS k FROM (SELECT DISTINCT h FROM c WHERE h <> '')),
    iv AS (SELECT 'host' AS kind, h AS entry, FALSE AS allows, a AS f, a + {60 * DAY} AS t FROM x WHERE b = 0
           UNION ALL SELECT 'host', h, FALSE, a + {90 * DAY}, {FOREVER} FROM x WHERE b = 0
           UNION ALL SELECT 'prefix', h || '/en', TRUE, a + {10 * DAY}, a + {30 * DAY} FROM x WHERE k = 0),
    m AS (SELECT page_id, iv.* FROM c JOIN iv ON iv.f <= fetched_at AND fetched_at < iv.t
          AND ((kind = 'host' AND entry = h) OR (kind = 'prefix' AND entry = h || '/en' AND list_filter(string_split(p, '/'), lambda s: s <> '')[1] = 'en'))),
    g AS (SELECT page_id, count(*) AS n, arg_max(kind, kind) AS kind, arg_max(entry, kind) AS entry, arg_max(allows, kind) AS allows FROM m GROUP BY page_id)
    SELECT page_id, CAST(fetched_at AS BIGINT) AS fetched_at, coalesce(NOT allows, FALSE) AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_active, kind AS decided_by, entry
    FROM c LEFT JOIN g USING (page_id)"""
