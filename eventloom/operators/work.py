"""What has been done and what is left: ledgers, assignments, window outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(all_: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without an entry in the ledger."""
    return all_.join(done.select(*keys), keys, "left_anti")


def completed(*ledgers: DataFrame) -> DataFrame:
    """Distinct union of ledgers."""
    out = ledgers[0]
    for one in ledgers[1:]:
        out = out.unionByName(one)
    return out.distinct()


def files_of(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest entries with the files that exist, by base name; files that do not are left out."""
    asked = manifest.select("node", F.explode("files").alias("f")).withColumn("base", F.substring_index("f", "/", -1))
    have = listing.select("path", F.substring_index("path", "/", -1).alias("base"))
    return asked.join(have, "base").groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("files"))


def round_robin(i: Column, workers: int) -> Column:
    return F.pmod(i, F.lit(workers))


def chunk_of(i: Column, n: int, workers: int) -> Column:
    """Contiguous equal chunks, the remainder to the last worker."""
    return F.least(F.floor(i / max(1, n // workers)), F.lit(workers - 1)).cast("int")


def write_windows(frames: dict[str, DataFrame], path: str) -> None:
    """One table for all time windows, a folder for each."""
    out = None
    for name, df in frames.items():
        part = df.withColumn("window", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").partitionBy("window").parquet(path)
