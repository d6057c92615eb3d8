"""Removal of repeated 400-byte strings by prefix doubling over sampled suffixes.

Every start of a LENGTH-byte string is tied to an anchor: the least hash among
the REACH byte grams that begin at the start, the leftmost on ties. Equal
strings are tied to equal anchors at equal distance, whatever stands around
them. So the anchors are an index of all starts, and only their suffixes are
ranked. The rank of a suffix for k bytes is the least place that bears those k
bytes; the rank for 2 k bytes is the rank of the pair (rank for k bytes here,
name of the k bytes at offset k), found by grouping the pairs of all remaining
suffixes. Suffixes whose pair occurs once drop out. Offsets grow until HALVES is
past; a last pair adds everything that the strings of an anchor's starts cover,
to the left of it and past LENGTH.

After the rounds the starts of an anchor have no repeated string (it fell out
early), or all have (the last pair is shared), or they are open. Open starts are
settled byte by byte, by 128-bit names of their strings; of a shared last pair
one bearer stands for all. So the result is exact, and only the edges of repeats
are looked at bytewise.

Texts are written once, compressed, with a number for each row, which names the
row from then on. Ranks are numbers of places, so equal ranks mean equal pairs,
and a task that is run again gives the same ranks. Counting is by partially
aggregated groupBys, whose results are written, and equi-joins of two exchanged
sides that AQE can split, so a passage on a third of all rows makes no hot task.

Defined results: null text is empty; texts shorter than LENGTH lose nothing;
equal texts of LENGTH bytes or more are removed whole, each of them, also where
they are rows with one doc_id; extra columns are ignored; strings never cross
documents; a very long text is handled whole, in memory in proportion to it; an
empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut_lean as cut
from eventloom.llm.common import drop, scan_tasks
from eventloom.llm.hashing import STEPS, U64, Sums, mix
from eventloom.llm.passages import HELD, WORDS, sampled, shared_windows

LENGTH, GRAM, REACH = 400, 16, 128
#: Bytes that the rounds of doubling rank: 68, 136, 272, all within any string past its anchor.
HALVES = (LENGTH - REACH) // 4, (LENGTH - REACH) // 2


LOW = U64(0xFFFFFFFF)
OPEN, LEAD, SURE = 0, 1, 2


class Text:
    """Anchors and range names of a block of texts, one after another."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts])
        self.sums = Sums(self.data)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first and last start tied to it, for all starts of LENGTH-byte strings within a text, and the text's number."""
        starts = len(self.data) - LENGTH + 1
        m = starts + REACH - 1  # grams that any start looks at
        h = (self.sums.at[GRAM : GRAM + m] - self.sums.at[:m]) * self.sums.down[:m] * STEPS[4]
        h ^= h >> U64(32)
        h *= STEPS[5]
        low = (h & ~LOW) | np.arange(m, dtype=U64)
        step = 1
        while step < REACH:  # REACH is a power of two
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        past = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(past)), self.sizes)[:starts]
        inside = np.flatnonzero(np.arange(LENGTH, LENGTH + starts) <= past[owner])
        at = (low[inside] & LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[new], inside[new], inside[np.concatenate((new[1:], [len(at)])) - 1], owner[inside[new]]

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.sums.ranges(start, end) + (end - start).astype(U64) * STEPS[0]


def _sample(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of the text, place (with its distances to its first and last start, both under 256), and the names of the growing parts, of each anchor."""
    t = Text(texts)
    at, first, last, owner = t.anchors()
    place = ((at - (np.cumsum(t.sizes) - t.sizes)[owner]) << 16) + ((at - first) << 8) + (at - last)
    cover = mix(t.name(first, last + LENGTH) + STEPS[1] * (at - first).astype(U64))
    parts = [t.name(at, at + HALVES[0]), *(t.name(at + k, at + 2 * k) for k in HALVES), cover]
    return owner, place, *(p.view(np.int64) for p in parts)


PARTS = ["p0", *(f"p{i + 1}" for i in range(len(HALVES))), "cover"]


def anchors_of(packed: DataFrame) -> DataFrame:
    """doc, place and the names of the growing parts of every anchor; packed: (doc, packed)."""

    run = sampled(_sample, LENGTH, ["doc", "place", *PARTS])
    return packed.select("doc", "packed").mapInArrow(run, "doc long, place long, " + ", ".join(f"{p} long" for p in PARTS))


def reranked(rows: DataFrame, part: str, tasks: int) -> DataFrame:
    """One round: the suffixes whose pair (rank, part) others bear too, with the least place that bears it as rank."""
    pair = [*(["rank"] if "rank" in rows.columns else []), part]
    # the ranks are written, so that both sides of the join are dealt anew and AQE can split a hot pair
    ranks = cut(rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "place")).alias("least")).where("c > 1").drop("c"), tasks)
    out = cut(rows.join(ranks, pair).drop(*pair).withColumnRenamed("least", "rank"))
    drop(ranks)
    return out


def doubled(rows: DataFrame, tasks: int) -> DataFrame:
    """Rounds of rank pairs over the anchors: doc, place, and state: sure, open, or lead (stands for a shared last pair)."""
    for part in PARTS[:-1]:
        before, rows = rows, reranked(rows, part, tasks)
        drop(before)
    last = cut(rows.groupBy("rank", "cover").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "place")).alias("lead")), tasks)
    # only groups with an open member need their shared strings spelled out
    need = cut(last.groupBy("rank").agg(F.max(F.col("c") == 1).alias("some_open")), tasks)
    ranked = rows.join(last, ["rank", "cover"]).join(need, "rank")
    state = F.when(F.col("c") == 1, OPEN).when(F.col("some_open") & (F.struct("doc", "place") == F.col("lead")), LEAD).otherwise(SURE)
    out = cut(ranked.select("doc", "place", state.alias("state")))
    drop(rows, last, need)
    return out


def settled(packed: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc, sure starts as flat (from, to) pairs, and open starts with their 128-bit names; packed: (doc, packed)."""
    by_doc = ranks.groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("state").alias("states"))
    both = packed.select("doc", "packed").join(by_doc, "doc")
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            held = 0
            for doc, raw, places, states in zip(*(batch.column(i) for i in range(4)), strict=True):
                place, state = places.values.to_numpy(), states.values.to_numpy()
                at = place >> 16
                first, past = at - ((place >> 8) & 255), at - (place & 255) + 1
                known = state != OPEN
                sure = np.stack([first[known], past[known]], 1).ravel()
                look = np.flatnonzero(state != SURE)
                starts = np.unique(np.concatenate([np.arange(first[i], past[i]) for i in look])) if len(look) else np.empty(0, np.int64)
                n1 = n2 = np.empty(0, U64)
                if len(starts):
                    data = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8)
                    starts = starts[starts + LENGTH <= len(data)]
                    n1, n2 = Sums(data).ranges(starts, starts + LENGTH), Sums(data + np.uint8(1)).ranges(starts, starts + LENGTH)
                for c, v in zip(cols, (doc.as_py(), sure.astype(np.int32), starts.astype(np.int32), n1.view(np.int64), n2.view(np.int64)), strict=True):
                    c.append(v)
                held += len(sure) + len(starts)
                if held > HELD:
                    yield emit(cols)
                    cols, held = [[] for _ in kinds], 0
            if held:
                yield emit(cols)

    def emit(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "sure", "at", "n1", "n2"])

    return both.mapInArrow(run, "doc long, sure array<int>, at array<int>, n1 array<long>, n2 array<long>")


def repeats(packed: DataFrame, tasks: int) -> DataFrame:
    """doc, sure, more: every place where a string begins that begins elsewhere too, as ranges and as single starts; packed: (doc, packed)."""
    ranks = doubled(cut(anchors_of(packed)), tasks)
    edges = cut(settled(packed, ranks), tasks)
    drop(ranks)
    opened = edges.select("doc", F.explode(F.arrays_zip("at", "n1", "n2")).alias("x")).select("doc", "x.at", "x.n1", "x.n2")
    names = cut(opened.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), tasks)
    again = opened.join(names, ["n1", "n2"]).groupBy("doc").agg(F.collect_list("at").alias("more"))
    out = cut(edges.select("doc", "sure").join(again, "doc", "left").select("doc", "sure", "more"), tasks)
    drop(edges, names)
    return out


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans (flat from, to pairs in bytes) and n_shared_words of every row.

    n_shared_words is about passages shorter than LENGTH bytes as well, of which
    nothing is removed: words in runs of more than 50 that another row has too.
    """
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches):
        zip_, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 40
        for batch in batches:
            shut = [zip_.compress((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(shut))), batch.column(0), pa.array(shut, pa.binary())], names=["doc", "key", "packed"])
            n += len(shut)

    packed = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(pack, f"doc long, key {kind}, packed binary"))
    tasks = scan_tasks(packed)
    shared = shared_windows(packed, tasks)
    joined = packed.join(repeats(packed, tasks), "doc", "left").join(shared, "doc", "left").select("key", "packed", "sure", "more", "word_sure", "word_more")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64()]

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for shut, sure, more, *words in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                raw = unpack.decompress(shut.as_py())
                ends = [0, *merge(sure, more).tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                n_shared = int(np.diff(merge(*words, WORDS))[::2].sum())
                for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(ends) // 2 - 1, sha256(kept).hexdigest(), ends[1:-1], n_shared), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_shared_words"])

    out = joined.mapInArrow(finish, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>, n_shared_words long")
    return out.withColumnRenamed("key", key)


def merge(sure: pa.ListScalar, more: pa.ListScalar, length: int = LENGTH) -> np.ndarray:
    """Maximal ranges that strings of a length cover, as flat (from, to) pairs, from start ranges and single starts."""
    pairs, single = (np.empty(0, np.int64) if x.values is None else x.values.to_numpy().astype(np.int64) for x in (sure, more))
    a, b = pairs[::2], pairs[1::2]
    start, end = np.concatenate((a[b > a], single)), np.concatenate((b[b > a] - 1, single)) + length
    if not len(start):
        return start
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return np.stack([start[new], end[np.concatenate((new[1:], [len(end)])) - 1]], 1).ravel()
