"""Votes, p-value combination and rarity-aware ranking of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR, GROUP_SIZE = 1e-300, 8
#: Rarity labels from rarest, and the largest p of each.
ORDER = ["ZERO", "ULTRA_RARE", "RARE", "MODERATE", "COMMON", "VERY_COMMON"]
P_LIMIT = {"ULTRA_RARE": 1e-4, "RARE": 1e-3, "MODERATE": 5e-3, "COMMON": 1e-2, "VERY_COMMON": 1e-2}
KEY = ["cause", "effect", "tau"]


def best(links: DataFrame) -> DataFrame:
    """The link of least p for each (cause, effect, tau); the first group on ties."""
    rest = [c for c in links.columns if c not in KEY]
    pick = F.min_by(F.struct(*rest), F.struct("p_val", "group_id"))
    return links.groupBy(*KEY).agg(pick.alias("b")).select(*KEY, *[f"b.{c}" for c in rest])


def fisher_p(chi2: Column, n: Column) -> Column:
    """Tail of chi-square with 2n degrees: exp(-x/2) times the first n terms of its series, each from the one before."""
    half = chi2 / 2
    more = F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda a, i: F.struct((a["term"] * half / i).alias("term"), (a["total"] + a["term"] * half / i).alias("total"))
    return F.least(F.exp(-half) * F.aggregate(more, start, step, lambda a: a["total"]), F.lit(1.0))


def voted(links: DataFrame, weighted: bool = True, min_rows: int = 200, min_votes: int = 2, alpha: float = 0.01, rows: str = "T_data_rows") -> DataFrame:
    """One link for each key with votes and a combined p: a mean of logs weighted by sqrt(rows), or Fisher's method.

    Groups under ``min_rows`` and keys under ``min_votes`` drop out. The value
    shown is of the longest group (weighted) or of the least p.
    """
    used = links.where(F.col(rows) >= min_rows)
    logs = F.log(F.greatest("p_val", F.lit(FLOOR)))
    weight = F.sqrt(F.col(rows).cast("double"))
    by = F.struct(F.col(rows), (-F.col("p_val")).alias("p"), "group_id") if weighted else F.struct((-F.col("p_val")).alias("p"), "group_id")
    g = used.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_votes"), F.min("p_val").alias("p_val_best"), F.sum(logs).alias("s"), F.sum(weight * logs).alias("ws"), F.sum(weight).alias("w"),
        F.max_by(F.struct("val", "edge"), by).alias("r"),
    ).where(F.col("n_votes") >= min_votes)
    p = F.exp(F.col("ws") / F.col("w")) if weighted else fisher_p(-2 * F.col("s"), F.col("n_votes"))
    return g.select(*KEY, p.alias("p_val"), "p_val_best", "n_votes", "r.val", "r.edge").where(F.col("p_val") <= alpha)


def cap_totals(groups: DataFrame) -> DataFrame:
    """Capped cells summed over all groups, those that vote not included too."""
    return groups.agg(F.sum("total_cells_capped").alias("total_cells_capped"), F.count(F.lit(1)).alias("n_groups"))


def _rank(rarity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ORDER]), rarity)


def scored(links: DataFrame, events: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """Links under their rarity's p limit with vote share and score; events: (event, total_count, nodes_with_event, rarity).

    Events that are not listed count as commonest, with one possible vote.
    """
    side = lambda name: events.select(F.col("event").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("total_count", "nodes_with_event", "rarity")])
    both = links.join(F.broadcast(side("cause")), "cause", "left").join(F.broadcast(side("effect")), "effect", "left")  # a row for each event of the vocabulary
    rare = {s: F.coalesce(f"{s}_rarity", F.lit("VERY_COMMON")) for s in ("cause", "effect")}
    votes = {s: F.greatest(F.floor(F.coalesce(f"{s}_nodes_with_event", F.lit(0)) / group_size), F.lit(1)) for s in ("cause", "effect")}
    edge = F.when(_rank(rare["cause"]) < _rank(rare["effect"]), rare["cause"]).otherwise(rare["effect"])
    both = both.withColumns({"edge_rarity": edge, "max_votes": F.least(votes["cause"], votes["effect"]).cast("bigint")})
    limit = F.lit(None).cast("double")
    for name, p in P_LIMIT.items():
        limit = F.when(F.col("edge_rarity") == name, p).otherwise(limit)
    both = both.withColumn("p_thresh", limit).where(F.col("p_val") <= F.col("p_thresh"))
    share = F.least(F.col("n_votes") / F.col("max_votes"), F.lit(1.0))
    log_p = -F.log10(F.greatest("p_val", F.lit(FLOOR)))
    return both.select(
        *links.columns, "edge_rarity", "max_votes", "p_thresh", F.round(share, 4).alias("vote_fraction"), F.round(log_p, 4).alias("log_p"), F.round(share * log_p, 4).alias("score"),
        F.coalesce("cause_total_count", F.lit(0)).alias("cause_count"), F.coalesce("effect_total_count", F.lit(0)).alias("effect_count"),
    )


def ranked(links: DataFrame, n: int | None = None) -> DataFrame:
    out = links.orderBy(F.desc("score"), "p_val", *KEY)
    return out if n is None else out.limit(n)


def by_p(links: DataFrame, n: int | None = None) -> DataFrame:
    out = links.orderBy("p_val", *KEY)
    return out if n is None else out.limit(n)
