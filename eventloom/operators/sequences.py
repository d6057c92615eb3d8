"""Global order, sliding training windows, caps, deltas, pads, targets, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.classify import time_basket
from eventloom.functions.vocab import PAD, UNK
from eventloom.session import checkpointed

DAY = 86_400


def ordinals(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Global 0-based position ``g`` in ``order`` without one task that holds everything.

    Rows are dealt into ranges, sorted there and written once; a row's number
    within its range is its place, and the summed sizes of the ranges before, a row
    for each partition, are joined to it. ``order`` must be unique for the numbers
    to be the same in every run.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # partition in the upper 31 bits, place in the lower 33; the checkpoint holds both fast
    placed = checkpointed(ranged.withColumn("o_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("o_part", F.shiftright("o_id", 33))
    before = F.sum("o_n").over(W.orderBy("o_part").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("o_part").agg(F.count(F.lit(1)).alias("o_n")).select(F.col("o_part").alias("o_of"), F.coalesce(before, F.lit(0)).alias("o_start"))
    found = placed.join(F.broadcast(starts), F.col("o_part") == F.col("o_of"))  # as many rows as partitions
    g = F.col("o_id").bitwiseAND((1 << 33) - 1) + F.col("o_start")
    return found.withColumn("g", g.cast("bigint")).drop("o_id", "o_part", "o_of", "o_start")


def order_faults(df: DataFrame, order: list[str], g: str = "g") -> DataFrame:
    """Rows that stand before their predecessor by ordinal; empty when the order holds. Every row is looked at."""
    before = df.select((F.col(g) + 1).alias("next"), F.struct(*order).alias("b"))
    return df.join(before, F.col(g) == F.col("next")).where(F.struct(*order) < F.col("b")).select(g, *order)


def n_windows(n: int, length: int, stride: int) -> int:
    return max(1, (n - length) // stride + 1)


def window_rows(seq: DataFrame, n: int, length: int, stride: int, g: str = "g") -> DataFrame:
    """Each row once for every window that reads it: window i reads rows i * stride to i * stride + length.

    Windows of a row are computed from its ordinal, so there is no range join.
    """
    last = n_windows(n, length, stride) - 1
    lo = F.greatest(F.ceil((F.col(g) - length) / F.lit(stride)), F.lit(0)).cast("bigint")
    hi = F.least(F.floor(F.col(g) / F.lit(stride)), F.lit(last)).cast("bigint")
    rows = seq.where(lo <= hi).withColumn("win", F.explode(F.sequence(lo, hi)))
    return rows.withColumn("pos", F.col(g) - F.col("win") * stride)


def capped(rows: DataFrame, cap: int, pad: int = PAD, unknown: int = UNK) -> DataFrame:
    """Tokens beyond the first ``cap`` of their kind in a window become unknown; special tokens stay; cap 0 keeps all."""
    if not cap:
        return rows
    nth = F.row_number().over(W.partitionBy("win", "token").orderBy("pos"))
    return rows.withColumn("token", F.when((F.col("token") < pad) & (nth > cap), unknown).otherwise(F.col("token")))


def with_deltas(rows: DataFrame, at: str = "ts", per_second: int = 1, most: int = DAY) -> DataFrame:
    """Seconds since the row before in the window, held within a day; the first is 0."""
    d = (F.col(at) - F.lag(at).over(W.partitionBy("win").orderBy("pos"))) / F.lit(per_second)
    return rows.withColumn("delta", F.coalesce(F.least(F.greatest(d, F.lit(0.0)), F.lit(float(most))), F.lit(0.0)))


def training_windows(rows: DataFrame, length: int, pad: int = PAD) -> DataFrame:
    """win, event_ids, target, time_deltas of ``length`` each, and seconds, their sum; a short tail is padded on the right.

    ``time_deltas`` are 32-bit floats, as a model reads them; ``seconds`` is summed in order before they are narrowed.
    """
    whole = rows.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "delta"))).alias("w"))  # at most length + 1 rows a window
    tokens, deltas = F.col("w.token"), F.col("w.delta")
    fill = lambda a, v, n: F.slice(F.concat(a, F.array_repeat(F.lit(v), n)), 1, n)
    full, times = fill(tokens, pad, length + 1), fill(deltas, 0.0, length)
    seconds = F.aggregate(times, F.lit(0.0), lambda a, x: a + x)
    return whole.select("win", F.slice(full, 1, length).alias("event_ids"), F.slice(full, 2, length).alias("target"), times.cast("array<float>").alias("time_deltas"), seconds.alias("seconds"))


def next_tokens(seq: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Token and the next one of the same key."""
    return seq.withColumn("next_token", F.lead("token").over(W.partitionBy(*by).orderBy(*order))).where("next_token IS NOT NULL")


def time_features(seconds: Column) -> tuple[Column, Column]:
    """Basket and log feature of a time difference."""
    return time_basket(seconds), F.log1p(seconds * 1000)


def sample_key(id_: Column, seed: int) -> Column:
    """The same order in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def seeded_sample(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement by hash order; top-n per partition first, so nothing is sorted whole."""
    return df.orderBy(sample_key(F.col(id_), seed), id_).limit(n)


def top_tokens(df: DataFrame, n: int | None) -> DataFrame:
    counted = df.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted if n is None else counted.orderBy(F.desc("n"), "token").limit(n)


def first_seen(df: DataFrame, value: str, order: str, unknown: str = "<UNK>") -> DataFrame:
    """Vocabulary in order of first appearance, ids from 1; 0 is unknown. The window runs over distinct values."""
    seen = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("at"))
    ids = seen.select(F.col(value).alias("value"), F.row_number().over(W.orderBy("at", value)).alias("id"))
    return ids.unionByName(df.sparkSession.createDataFrame([(unknown, 0)], "value string, id int"))


def window_uniques(rows: DataFrame) -> DataFrame:
    return rows.groupBy("win").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
