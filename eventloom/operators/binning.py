"""Node manifests, dense time-binned counts, the synthetic time axis, distributions.

Event-sized data is only ever grouped by keys or filtered; windows run over
node- or token-sized tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.classify import rarity

SEPARATOR = "NaN_BREAK"


def bin_of(at: Column, width: int) -> Column:
    """Bin number, anchored to the epoch; floors for times before it too."""
    return F.floor(at / F.lit(width)).cast("bigint")


def manifest(events: DataFrame, width: int, at: str = "ts", file: str | None = None) -> DataFrame:
    """Per node: rank in name order, range, bins, and its stretch of the synthetic axis (in units of ``width`` seconds).

    node i starts after all earlier nodes' bins and one separator each.
    """
    aggs = [F.min(at).alias("min_ts"), F.max(at).alias("max_ts")] + ([F.sort_array(F.collect_set(file)).alias("files")] if file else [])
    nodes = events.groupBy("node").agg(*aggs)
    nodes = nodes.withColumn("min_bin", bin_of(F.col("min_ts"), width)).withColumn("n_bins", bin_of(F.col("max_ts"), width) - F.col("min_bin") + 1)
    order = W.orderBy("node")  # the table has a row for each node, not for each event
    before = F.coalesce(F.sum(F.col("n_bins") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return nodes.withColumns({"rank": F.row_number().over(order) - 1, "start_bin": before}).withColumn("separator_bin", F.col("start_bin") + F.col("n_bins"))


def counts(events: DataFrame, width: int, keys: list[str], at: str = "ts", cap: int | None = None) -> DataFrame:
    """Counts by keys and bin, capped where asked; partial sums before the shuffle take the edge off hot keys."""
    c = events.groupBy(*keys, bin_of(F.col(at), width).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return c if cap is None else c.withColumn("cnt", F.least("cnt", F.lit(cap)))


def in_range(binned: DataFrame, low: int, high: int) -> DataFrame:
    return binned.where(F.col("bin").between(low, high))


def stats(events: DataFrame, at: str = "ts", node: str = "node") -> DataFrame:
    """Row count, distinct nodes and time range in one pass."""
    return events.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(node).alias("n_nodes"), F.min(at).alias("min_ts"), F.max(at).alias("max_ts"))


def dense(binned: DataFrame, keys: list[str], value: str = "cnt") -> DataFrame:
    """Every bin between each key's first and last one; absent bins count 0."""
    spine = binned.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("bin"))
    return spine.join(binned, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce(value, F.lit(0)).alias(value))


def wide(binned: DataFrame, keys: list[str], tokens: dict[int, str]) -> DataFrame:
    """One column for each token, by conditional sums over a given list: no pass to find the values."""
    return binned.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("token") == t, F.col("cnt"))), F.lit(0)).alias(name) for t, name in tokens.items()])


def timeline(binned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows on the synthetic axis: dense (node, slot) positions and a separator after each node, with null counts."""
    bins = nodes.select("node", "rank", "start_bin", "min_bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("i"))
    rows = bins.select("node", "rank", (F.col("start_bin") + F.col("i")).alias("slot"), (F.col("min_bin") + F.col("i")).alias("bin"))
    data = rows.join(binned, ["node", "bin"], "left").select("node", "rank", "slot", F.lit(False).alias("is_separator"), F.coalesce("cnt", F.lit(0)).alias("cnt"))
    breaks = nodes.select(F.lit(SEPARATOR).alias("node"), "rank", F.col("separator_bin").alias("slot"), F.lit(True).alias("is_separator"), F.lit(None).cast("bigint").alias("cnt"))
    return data.unionByName(breaks)


def separator_gaps(nodes: DataFrame) -> DataFrame:
    """Distance from each separator to the next node's start; 1 everywhere when the axis is right."""
    return nodes.withColumn("gap", F.lead("start_bin").over(W.orderBy("rank")) - F.col("separator_bin")).select("node", "rank", "separator_bin", "gap")


def data_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_separator"))


def cap_audit(binned: DataFrame, cap: int, by: str) -> DataFrame:
    """Cells over the cap by a key, counted before clipping."""
    return binned.groupBy(by).agg(F.sum((F.col("cnt") > cap).cast("bigint")).alias("cells_capped"), F.max("cnt").alias("max_cnt"))


def active_tokens(binned: DataFrame) -> DataFrame:
    """Tokens whose series is not all zero."""
    return binned.groupBy("token").agg(F.max("cnt").alias("max_cnt")).where("max_cnt > 0")


def distribution(events: DataFrame, event: str = "event", node: str = "node") -> DataFrame:
    """Per event: total, share of all, nodes with it, share of nodes, rarity."""
    per_node = events.groupBy(event, node).agg(F.count(F.lit(1)).alias("c"))
    rows = per_node.groupBy(event).agg(F.sum("c").alias("total_count"), F.count(F.lit(1)).alias("nodes_with_event"))
    n_nodes = per_node.agg(F.countDistinct(node).alias("n_nodes"))
    every = W.partitionBy()  # a row for each event of the vocabulary
    rows = rows.crossJoin(F.broadcast(n_nodes)).withColumn("all", F.sum("total_count").over(every))
    return rows.select(
        event, "total_count", (100.0 * F.col("total_count") / F.col("all")).alias("pct_of_all_events"),
        "nodes_with_event", (100.0 * F.col("nodes_with_event") / F.greatest("n_nodes", F.lit(1))).alias("pct_nodes"), rarity(F.col("total_count")).alias("rarity"),
    )


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The element at n // 2 of the sorted values, never an average of two."""
    w = W.orderBy(value)
    return rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy())}).where(F.col("i") == F.floor(F.col("n") / 2)).select(F.col(value).alias("median"))


def band_counts(rows: DataFrame, band: str = "rarity", event: str = "event") -> DataFrame:
    return rows.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(event)), ",").alias("events"))


def group_means(binned: DataFrame, n_bins: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean count by variable group over all cells of the dense matrix, zeros included, without building it.

    n_bins: (node, n_bins); groups: (token, variable_group).
    """
    cells = groups.groupBy("variable_group").agg(F.count(F.lit(1)).alias("n_tokens"))
    total = n_bins.agg(F.sum("n_bins").alias("bins"))
    sums = binned.join(F.broadcast(groups), "token").groupBy("variable_group").agg(F.sum("cnt").alias("s"))
    return cells.join(sums, "variable_group", "left").crossJoin(F.broadcast(total)).select("variable_group", (F.coalesce("s", F.lit(0)) / (F.col("n_tokens") * F.col("bins"))).alias("mean_count"))
