"""Words in passages of more than 50 words that stand in another text too.

Words are lower-cased (A-Z) runs without white space, so line breaks, double
spaces and capitals do not part equal passages. Every window of WORDS words is
tied to an anchor: the least hash among the GRAM-word strings that begin in its
first REACH places, the leftmost on ties. Equal windows are tied to equal
anchors, so an anchor whose string no other text has drops out with all of its
windows. An anchor whose windows as a whole stand in another text is sure; the
windows of the others are held against each other by 128-bit names over 64-bit
names of words, where one bearer stands for the sure ones. So the result is exact
up to clashes of these names.

Defined results: texts are told apart by their row, so repeats within one row
do not count, equal rows do; null and texts of fewer than WORDS words have 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut_lean as cut
from eventloom.llm.common import drop
from eventloom.llm.hashing import LOWER, SPACE, STEPS, U64, Sums, mix, powers

WORDS, GRAM = 51, 8
REACH = WORDS - GRAM + 1
#: Starts that a task holds before it passes them on; those of one text stay together.
HELD = 100_000

LOW = U64(0xFFFFFFFF)
OPEN, LEAD, SURE = 0, 1, 2


class Words:
    """Names of runs of words of a block of texts."""

    def __init__(self, texts: list[bytes]):
        raw = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (~SPACE[raw]).view(np.int8), [0]))))
        self.values = Sums(raw).ranges(edge[::2], edge[1::2])
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(edge[::2], begin)  # the texts' first words
        self.at, self.down = self.summed(self.values)

    def summed(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers(len(values) + 1)
        at = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=at[1:])
        return at, down

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.at[end] - self.at[start]) * self.down[start] + (end - start).astype(U64) * STEPS[0])

    def other_names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names from the same words by another function, so that both together have 128 bits."""
        at, down = self.summed(mix(self.values * STEPS[2]))
        return mix((at[end] - at[start]) * down[start])

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Anchor, first and last window tied to it, the name of its string, and the text's number, for all windows within a text."""
        starts = len(self.values) - WORDS + 1
        at = np.arange(starts + REACH - 1)
        h = self.names(at, at + GRAM)
        low = (h & ~LOW) | at.astype(U64)
        step = 1
        while 2 * step <= REACH:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < REACH:
            low = np.minimum(low[: step - REACH], low[REACH - step :])
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[:starts]
        inside = np.flatnonzero(np.arange(WORDS, WORDS + starts) <= self.bounds[owner + 1])
        at = (low[inside] & LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[: len(at)])
        first, last = inside[new], inside[np.concatenate((new[1:], [len(at)])).astype(np.int64)[: len(new)] - 1]
        return at[new], first, last, h[at[new]], owner[first]


def _sample(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of the text, place (with its distances to its first and last window), gram and cover of each anchor."""
    t = Words(texts)
    if len(t.values) < WORDS:
        return (np.empty(0, np.int64),) * 4
    at, first, last, gram, owner = t.anchors()
    cover = mix(t.names(first, last + WORDS) + STEPS[1] * (at - first).astype(U64))
    return owner, ((at - t.bounds[owner]) << 16) + ((at - first) << 8) + (at - last), gram.view(np.int64), cover.view(np.int64)


def sampled(sample, least: int, names: list[str]):
    """An Arrow function over (doc, packed) that samples blocks of texts of at least so many bytes; a longer text is a block of its own."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, rows, size = [], [], 0
            for i, shut in enumerate(batch.column(1)):
                data = open_(shut.as_py())
                if len(data) >= least:
                    texts.append(data)
                    rows.append(i)
                    size += len(data)
                if size > 1 << 18:
                    yield emit(batch, rows, sample(texts))
                    texts, rows, size = [], [], 0
            if texts:
                yield emit(batch, rows, sample(texts))

    def emit(batch, rows, found):
        owner, *cols = found
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows)[owner])), *(pa.array(c) for c in cols)], names=names)

    return run


def anchors_of(packed: DataFrame) -> DataFrame:
    """doc, place (with its distances to its first and last window), gram and cover of every anchor; packed: (doc, packed)."""
    names = ["doc", "place", "gram", "cover"]
    return packed.select("doc", "packed").mapInArrow(sampled(_sample, 2 * WORDS - 1, names), ", ".join(f"{c} long" for c in names))


def judged(rows: DataFrame, tasks: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """doc, place and state of the anchors whose string another text has: sure, open, or lead (stands for sure ones); the tables to drop after."""
    across = F.min("doc") < F.max("doc")
    grams = cut(rows.groupBy("gram").agg(across.alias("across")).where("across").drop("across"), tasks)
    held = cut(rows.join(grams, "gram"))
    drop(rows, grams)
    last = cut(held.groupBy("gram", "cover").agg(across.alias("sure"), F.min(F.struct("doc", "place")).alias("lead")), tasks)
    need = cut(last.groupBy("gram").agg(F.max(~F.col("sure")).alias("some_open")), tasks)
    state = F.when(~F.col("sure"), OPEN).when(F.col("some_open") & (F.struct("doc", "place") == F.col("lead")), LEAD).otherwise(SURE)
    return held.join(last, ["gram", "cover"]).join(need, "gram").select("doc", "place", state.alias("state")), (held, last, need)


def spelled(packed: DataFrame, states: DataFrame) -> DataFrame:
    """doc, sure windows as flat (from, to) pairs, and the other windows with their names; those of leads are known to stand elsewhere."""
    by_doc = states.groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("state").alias("states"))
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            held = 0
            for doc, raw, places, kept in zip(*(batch.column(i) for i in range(4)), strict=True):
                place, state = places.values.to_numpy(), kept.values.to_numpy()
                at = place >> 16
                first, past = at - ((place >> 8) & 255), at - (place & 255) + 1
                sure = np.stack([first[state != OPEN], past[state != OPEN]], 1).ravel()
                look = np.flatnonzero(state != SURE)
                s = n1 = n2 = known = np.empty(0, np.int64)
                if len(look):
                    t = Words([open_(raw.as_py())])
                    s = np.concatenate([np.arange(first[i], past[i]) for i in look])
                    known = np.repeat(state[look] == LEAD, (past - first)[look])
                    n1, n2 = (f(s, s + WORDS).view(np.int64) for f in (t.names, t.other_names))
                for c, v in zip(cols, (doc.as_py(), sure.astype(np.int32), s.astype(np.int32), known.astype(bool), n1, n2), strict=True):
                    c.append(v)
                held += len(sure) + len(s)
                if held > HELD:
                    yield emit(cols)
                    cols, held = [[] for _ in kinds], 0
            if held:
                yield emit(cols)

    def emit(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "sure", "at", "known", "n1", "n2"])

    both = packed.select("doc", "packed").join(by_doc, "doc")
    return both.mapInArrow(run, "doc long, sure array<int>, at array<int>, known array<boolean>, n1 array<long>, n2 array<long>")


def shared_windows(packed: DataFrame, tasks: int) -> DataFrame:
    """doc, word_sure, word_more: the windows that another text has too, as ranges and one by one; packed: (doc, packed)."""
    states, after = judged(cut(anchors_of(packed)), tasks)
    edges = cut(spelled(packed, states), tasks)
    drop(*after)
    opened = edges.select("doc", F.explode(F.arrays_zip("at", "known", "n1", "n2")).alias("x")).select("doc", "x.*")
    across = F.max("known") | (F.min("doc") < F.max("doc"))
    names = cut(opened.groupBy("n1", "n2").agg(across.alias("across")).where("across").drop("across"), tasks)
    again = opened.where("NOT known").join(names, ["n1", "n2"]).groupBy("doc").agg(F.collect_list("at").alias("word_more"))
    out = cut(edges.select("doc", F.col("sure").alias("word_sure")).join(again, "doc", "left"), tasks)
    drop(edges, names)
    return out
