"""Readers and sinks of logs, tokens, node matrices, links, edges, reports and notes."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.repair import LOG_COLUMNS, repaired, typed
from eventloom.functions.vocab import column_order

RAW_SCHEMA = ", ".join(f"{c} string" for c in LOG_COLUMNS)
LINK_SCHEMA = "cause string, effect string, tau int, val double, p_val double, edge string, group_id string, nodes array<string>"
DIAGNOSIS_SCHEMA = "diagnosis string, affected_components array<string>, domain string, severity string, causal_chain array<string>, recommended_actions array<string>, supporting_evidence array<struct<source:string,excerpt:string>>"


# --- raw logs -------------------------------------------------------------


def batch_paths(batch: int, inputs: dict[int, str], outputs: dict[int, str]) -> tuple[str, str]:
    """Input glob and output folder of a batch number; an unknown number is an error, not an undefined path."""
    if batch not in inputs or batch not in outputs:
        raise ValueError(f"batch {batch} is none of {sorted(inputs)}")
    return inputs[batch], outputs[batch]


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that match the patterns in any store that Spark reads, sorted; patterns without files are left out."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found += [s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or []]
    return sorted(found)


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Log rows with LOG_COLUMNS as repaired text; unreadable files are skipped, absent columns are null.

    One columnar scan split by Spark, whatever the number of files; only the
    columns that a query uses are read.
    """
    raw = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(*paths)
    return repaired(raw)


def read_classified(spark: SparkSession, *folders: str, columns: list[str] | None = None) -> DataFrame:
    """Classified logs of several folders, missing ones skipped; ``columns`` prunes the scan."""
    df = spark.read.parquet(*(existing(spark, list(folders)) or folders))
    return df.select(*columns) if columns else df


def write_classified(df: DataFrame, path: str) -> None:
    """Typed and classified rows, a folder for each dataset_type."""
    typed(df).write.mode("overwrite").partitionBy("dataset_type").parquet(path)


def with_source_file(df: DataFrame) -> DataFrame:
    return df.withColumn("src_file", F.input_file_name())


def split_of(df: DataFrame, file: str, split: str, overlap: bool = True) -> DataFrame:
    """Rows of a split by position of their file in name order: val [0.8, 0.9), test [0.9, 1), train all (or, without overlap, [0, 0.8)).

    The files are numbered in a table of their own, which is as small as the listing.
    """
    files = df.select(F.col(file).alias("f")).distinct()
    place = files.select("f", (F.row_number().over(W.orderBy("f")) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    low, high = {"train": (0.0, 1.0 if overlap else 0.8), "val": (0.8, 0.9), "test": (0.9, 1.0)}[split]
    inside = (F.col("i") >= F.floor(F.col("n") * low)) & (F.col("i") < F.floor(F.col("n") * high))
    return df.join(place.where(inside), F.col(file) == F.col("f"), "left_semi")


# --- node matrices --------------------------------------------------------


def write_nodes(df: DataFrame, path: str) -> None:
    """Node matrices, a folder for each node, snappy."""
    df.write.mode("overwrite").partitionBy("node").option("compression", "snappy").parquet(path)


def read_node(spark: SparkSession, path: str, node: str) -> DataFrame:
    """One node's rows; the folder of the node is the only one listed and read."""
    return spark.read.parquet(path).where(F.col("node") == node)


def read_matrix(spark: SparkSession, path: str, like: str = "%", columns: list[str] | None = None) -> DataFrame:
    """Node matrices with separators zeroed and NaN elsewhere refused when read."""
    columns = columns or column_order()
    df = spark.read.parquet(path).where(F.col("node").like(like))
    cell = lambda c: F.when(F.col("is_separator"), F.lit(0.0)).when(F.isnan(c), F.raise_error(F.concat(F.lit("NaN in a data row of "), F.col("node")))).otherwise(F.col(c)).cast("double")
    return df.select("node", "timestamp", "is_separator", *[cell(c).alias(c) for c in columns if c in df.columns])


def node_names(spark: SparkSession, path: str, like: str = "%") -> DataFrame:
    return spark.read.parquet(path).select("node").distinct().where(F.col("node").like(like)).orderBy("node")


# --- sequences ------------------------------------------------------------


def write_sequence(df: DataFrame, path: str, partitions: int) -> None:
    """Token rows in (node, ts) order, by construction within and across files."""
    df.repartitionByRange(partitions, "node", "ts").sortWithinPartitions("node", "ts").write.mode("overwrite").parquet(path)


def export_arrays(df: DataFrame, path: str, columns: list[str], rows: int) -> None:
    """Columns as .npy files for tools outside Spark, streamed a partition at a time; ``rows`` is the row count."""
    import numpy as np

    kinds = {"int": np.int32, "bigint": np.int64, "double": np.float64, "float": np.float32}
    files = [np.lib.format.open_memmap(f"{path}/{c}.npy", "w+", kinds[dict(df.dtypes)[c]], (rows,)) for c in columns]
    for i, row in enumerate(df.select(*columns).toLocalIterator(prefetchPartitions=True)):
        for f, v in zip(files, row, strict=True):
            f[i] = v
    for f in files:
        f.flush()


# --- links, edges, reports ------------------------------------------------


def write_json(df: DataFrame, path: str) -> None:
    """JSON rows; Spark's commit makes the folder whole or absent."""
    df.write.mode("overwrite").json(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of group files with their group's header fields, one row a link."""
    schema = f"group_id string, nodes array<string>, T_total long, T_data_rows long, total_cells_capped long, capped_per_var_group map<string,int>, links array<struct<{LINK_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    groups = spark.read.schema(schema).option("multiLine", "true").json(path)
    return groups.select("T_data_rows", "total_cells_capped", F.explode_outer("links").alias("l")).select("T_data_rows", "total_cells_capped", "l.*")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", decimals: dict[str, int] | None = None) -> None:
    """CSV with header; named columns with fixed decimals."""
    df.withColumns({c: F.format_string(f"%.{d}f", F.col(c)) for c, d in (decimals or {}).items()}).write.mode(mode).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def report_line(cause="cause", tau="tau", edge="edge", effect="effect", val="val", p="p_comb", votes="n_votes") -> Column:
    """A link as a fixed-width text line."""
    return F.format_string("%-30s %5d  %5s  %-30s %9.4f  %10.2e  %6d", cause, tau, edge, effect, val, p, votes)


def write_report(df: DataFrame, path: str, title: str) -> None:
    head = df.sparkSession.createDataFrame([(title,)], "value string")
    head.unionByName(df.select(report_line().alias("value"))).write.mode("overwrite").text(path)


#: Fixed value: a line of the report, seven columns.
REPORT_LINE = r"^\s*(\S+)\s+(\d+)\s+([\-\<\>]+)\s+(\S+)\s+([-\d.e+]+)\s+([\d.e+\-]+)\s+(\d+)\s*$"


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Links of fixed-width lines; lines of another form are left out."""
    hit = lines.where(F.col(column).rlike(REPORT_LINE))
    part = lambda i: F.regexp_extract(column, REPORT_LINE, i)
    return hit.select(
        part(1).alias("cause"), part(2).cast("int").alias("tau"), part(3).alias("edge"), part(4).alias("effect"),
        part(5).cast("double").alias("val"), part(6).cast("double").alias("p_comb"), part(7).cast("int").alias("n_votes"),
    )


def write_metadata(spark: SparkSession, path: str, **values) -> None:
    """A one-row JSON table of counts and ranges."""
    spark.createDataFrame([(json.dumps(values, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_effects(df: DataFrame, path: str) -> None:
    """Edges, as a table for joins and as CSV for reading."""
    df.write.mode("overwrite").parquet(f"{path}/effects")
    write_csv(df, f"{path}/effects_csv", decimals={"ate": 6})


# --- notes and prompts ----------------------------------------------------


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """note (path under the folder without .md) and body of every markdown file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.input_file_name()
    name = F.regexp_replace(F.element_at(F.split(path, "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", 2), -1), r"\.md$", "")
    return files.select(name.alias("note"), F.col("value").alias("body"))


def prompt(text: str | None = None, file: str | None = None, domain: str | None = None) -> str:
    """A prompt from an argument, a file or standard input, with its domain in front where one is given."""
    if text is None:
        with open(file, encoding="utf-8") if file else sys.stdin as f:
            text = f.read()
    return f"[Domain: {domain}] {text}" if domain else text
