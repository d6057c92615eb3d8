"""Note lookup, search with context, listing, wiki links, diagnosis records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.sources.logs import DIAGNOSIS_SCHEMA

#: What a diagnosis may say.
SEVERITIES = ["low", "medium", "high", "critical"]
REQUIRED = ["diagnosis", "affected_components", "domain", "severity", "causal_chain", "recommended_actions", "supporting_evidence"]


def key_of(name: Column) -> Column:
    """A note's name from a plain name, a file name or a [[link]]."""
    bare = F.trim(name)
    inner = F.when(bare.startswith("[[") & bare.endswith("]]"), bare.substr(F.lit(3), F.length(bare) - 4)).otherwise(bare)
    return F.regexp_replace(inner, r"\.md$", "")


def read_note(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """name and body for each wanted (name); a miss says so."""
    asked = wanted.select("name", key_of(F.col("name")).alias("note"))
    return asked.join(notes, "note", "left").select("name", F.coalesce("body", F.concat(F.lit("Note not found: "), F.col("name"))).alias("body"))


def _split() -> Column:
    """Lines of the body; a last line end opens no line."""
    body = F.regexp_replace("body", r"\r\n?|\n", "\n")
    return F.split(F.when(body.endswith("\n"), body.substr(F.lit(1), F.length(body) - 1)).otherwise(body), "\n", -1)


def lines(notes: DataFrame) -> DataFrame:
    """note, line (from 1), text."""
    return notes.where("body <> ''").select("note", F.posexplode(_split()).alias("i", "text")).select("note", (F.col("i") + 1).alias("line"), "text")


def search(notes: DataFrame, query: str, reach: int = 2) -> DataFrame:
    """A row for each line that holds the query, whatever the case, with lines around it.

    Only notes that hold the query are split; context is cut from a note's own lines, so nothing is shuffled.
    """
    asked = query.lower()
    found = notes.where((F.col("body") != "") & F.lower("body").contains(asked)).select("note", _split().alias("lines"))
    numbered = F.filter(F.transform("lines", lambda x, i: F.when(F.lower(x).contains(asked), i)), lambda i: i.isNotNull())
    around = lambda i: F.slice("lines", F.greatest(i - reach, F.lit(0)) + 1, reach + 1 + F.least(i, F.lit(reach)))
    hits = F.transform(numbered, lambda i: F.struct((i + 1).cast("string").alias("line"), F.array_join(around(i), "\n").alias("context")))
    return found.select("note", F.explode(hits).alias("hit")).select("note", "hit.line", "hit.context")


def listing(notes: DataFrame, folder: str | None = None) -> DataFrame:
    kept = notes if folder is None else notes.where(F.col("note").startswith(folder.rstrip("/") + "/"))
    return kept.select("note").orderBy("note")


def wiki_links(notes: DataFrame) -> DataFrame:
    """note, target of every [[target]] and whether the target is a note."""
    links = notes.select("note", F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"), 1)).alias("t"))
    links = links.select("note", key_of(F.col("t")).alias("target")).distinct()
    known = notes.select(F.col("note").alias("k")).distinct()
    return links.join(known, F.col("target") == F.col("k"), "left").select("note", "target", F.col("k").isNotNull().alias("resolved"))


def dangling(notes: DataFrame) -> DataFrame:
    return wiki_links(notes).where("NOT resolved").select("note", "target")


def diagnoses(texts: DataFrame, column: str = "value", domains: list[str] | None = None) -> DataFrame:
    """Parsed records with ``valid``: all fields there, severity (and domain, where a list is given) among the known; a text that is no record is kept as raw."""
    d = F.from_json(column, DIAGNOSIS_SCHEMA)
    parsed = texts.select(F.col(column).alias("raw"), d.alias("d"))
    ok = F.col("d").isNotNull()
    for f in REQUIRED:
        ok = ok & F.col(f"d.{f}").isNotNull()
    ok = ok & F.col("d.severity").isin(SEVERITIES)
    if domains:
        ok = ok & F.col("d.domain").isin(domains)
    return parsed.select("raw", "d.*", F.coalesce(ok, F.lit(False)).alias("valid"))
