"""Next-token model, intervention effects with bootstrap, effect edges, cascades, prediction metrics.

The scorer is a smoothed first-order model from grouped counts; any table of
(cause present?, outcome) rows can take its place in ``effects``.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventloom.session import checkpointed

SPECIAL = (87, 88, 89)
#: Windows and cells of a block, and more than there are tokens.
BLOCK, CELLS, SIDE = 1024, 1024, 1 << 31


def ngram_model(pairs: DataFrame, n_tokens: int, smooth: float = 1.0) -> DataFrame:
    """token, next_token, n, p of observed pairs, with additive smoothing over ``n_tokens`` targets."""
    cells = pairs.groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("token"))  # over cells of the vocabulary squared
    return cells.withColumn("p", (F.col("n") + smooth) / (total + smooth * n_tokens))


def top_predictions(model: DataFrame, n: int = 5) -> DataFrame:
    """The likeliest next tokens of each token, ties by id."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), F.col("next_token").alias("t")))), 1, n)
    return model.groupBy("token").agg(ranked.alias("r")).select("token", F.col("r.t").alias("top"))


def accuracy(pairs: DataFrame, model: DataFrame, special: tuple[int, ...] = SPECIAL) -> DataFrame:
    """Accuracy and top-5 accuracy over pairs whose target is a real event; the model is vocabulary-sized."""
    top = top_predictions(model)
    seen = pairs.where(~F.col("next_token").isin(*special)).groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("c"))
    hit = seen.join(F.broadcast(top), "token", "left")
    first, five = F.coalesce(F.get("top", F.lit(0)) == F.col("next_token"), F.lit(False)), F.coalesce(F.array_contains("top", F.col("next_token")), F.lit(False))
    rate = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0)) / F.sum("c")
    return hit.agg(F.sum("c").alias("n"), rate(first).alias("accuracy"), rate(five).alias("top5_accuracy"))


def cross_entropy(pairs: DataFrame, model: DataFrame, n_tokens: int, smooth: float = 1.0, special: tuple[int, ...] = SPECIAL, fallback: float = 0.01) -> DataFrame:
    """Mean -ln p(target) over real targets; ``fallback`` where there is none."""
    base = model.groupBy("token").agg(F.sum("n").alias("total"))
    seen = pairs.where(~F.col("next_token").isin(*special)).groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("c"))
    p = F.coalesce("p", smooth / (F.coalesce("total", F.lit(0)) + smooth * n_tokens))
    scored = seen.join(model.select("token", "next_token", "p"), ["token", "next_token"], "left").join(F.broadcast(base), "token", "left")
    return scored.agg(F.coalesce(F.sum(-F.log(p) * F.col("c")) / F.sum("c"), F.lit(fallback)).alias("loss"))


def rank_mean(metrics: DataFrame, part: str, value: str) -> DataFrame:
    """Unweighted mean over parts of the mean of each part."""
    return metrics.groupBy(part).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"))


def cooccurrence(rows: DataFrame) -> DataFrame:
    """win, cause, effect, n, gap: windows in which both occur, by first position; a window has at most its length of rows."""
    first = rows.groupBy("win", "token").agg(F.min("pos").alias("pos"))
    a, b = (first.select("win", F.col("token").alias(x), F.col("pos").alias("p" + x)) for x in ("cause", "effect"))
    return a.join(b, "win").where("cause <> effect").select("win", "cause", "effect", (F.col("peffect") - F.col("pcause")).cast("double").alias("gap"))


def poisson(hashes: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of 32-bit hashes by inversion, 6 at most."""
    total, term, steps = 0.0, 0.36787944117144233, []
    for k in range(1, 7):
        total += term
        term /= k
        steps.append(total)
    return np.searchsorted(steps, hashes / 4294967296.0, side="right")


def sums(rows: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """draw, cause, effect, n_both, n_after, gap: weights of the windows that hold both, and the effect after the cause; gap is summed for draw 0 alone.

    Each task adds up its windows; its rows are to be summed. The row of cause and
    effect null weighs all windows, those of a token with itself the windows that hold
    it. A block of windows gives a table of weights by draw and one of cells by window, whose
    product is the block's sums; a task holds the sums of the vocabulary's pairs.
    """
    first = rows.groupBy("win", "token").agg(F.min("pos").alias("pos"))
    held = F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "pos")))
    windows = first.groupBy("win").agg(held.alias("held")).select(F.col("win").cast("string").alias("win"), "held.token", "held.pos")
    kind = rows.schema["token"].dataType

    def run(batches):
        codes: dict = {}
        added: dict[int, np.ndarray] = {}  # by cause * SIDE + effect: n_both and n_after by draw, and the gap
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            wins = [w.encode() for w in batch.column(0).to_pylist()]
            weights = np.ones((n_bootstrap + 1, len(wins)), np.float32)
            for draw in range(1, n_bootstrap + 1):
                start = b"%d:%d:" % (seed, draw)
                digests = b"".join([md5(start + w).digest() for w in wins])
                weights[draw] = poisson(np.frombuffer(digests, ">u4")[::4])
            add(added, 0, weights.sum(axis=1, dtype=np.float64), None, 0)
            lists = batch.column(1)
            found = lists.flatten().dictionary_encode()
            names = np.array([codes.setdefault(t, len(codes) + 1) for t in found.dictionary.to_pylist()], np.int64)
            token = names[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            pos = batch.column(2).flatten().to_numpy()
            # every token of a window with every token of it
            each = np.repeat(n, n)
            left = np.repeat(np.arange(len(token)), each)
            right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(np.cumsum(n) - n, n), each)
            at, gap = np.repeat(np.arange(len(n)), n)[left], (pos[right] - pos[left]).astype(np.float64)
            keys, cell = np.unique(token[left] * SIDE + token[right], return_inverse=True)
            for a in range(0, len(keys), CELLS):
                mine = (cell >= a) & (cell < a + CELLS)
                c, w, g = cell[mine] - a, at[mine], gap[mine]
                both, after = (np.zeros((len(wins), min(CELLS, len(keys) - a)), np.float32) for _ in range(2))
                both[w, c], after[w, c] = 1, g > 0
                gaps = np.bincount(c, weights=g, minlength=both.shape[1])
                # sums of a block stay far below 2**24, so they are exact in 32 bits
                both, after = weights @ both, weights @ after
                for i in range(both.shape[1]):
                    add(added, int(keys[a + i]), both[:, i], after[:, i], gaps[i])
        tokens = [None, *codes]
        for key, (both, after, gap) in added.items():
            cols = [np.arange(n_bootstrap + 1), both.astype(np.int64), after.astype(np.int64), np.where(np.arange(n_bootstrap + 1) == 0, gap, 0.0)]
            same = [pa.array([tokens[x]] * (n_bootstrap + 1), to_arrow_type(kind)) for x in divmod(key, SIDE)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *same, *map(pa.array, cols[1:])], names=["draw", "cause", "effect", "n_both", "n_after", "gap"])

    def add(added, key, both, after, gap):
        if key not in added:
            added[key] = [np.zeros(n_bootstrap + 1), np.zeros(n_bootstrap + 1), 0.0]
        cell = added[key]
        cell[0] += both
        if after is not None:
            cell[1] += after
        cell[2] += gap

    return windows.mapInArrow(run, f"draw long, cause {kind.simpleString()}, effect {kind.simpleString()}, n_both long, n_after long, gap double")


def effects(rows: DataFrame, n_bootstrap: int = 500, min_occurrences: int = 10, seed: int = 42) -> DataFrame:
    """cause, effect, ate, ci_lo, ci_hi, tgap, n: share of windows with the effect after the cause, less its share in windows without the cause.

    Bootstrap draws are Poisson weights by hash of (seed, draw, window); draw 0 is
    the data itself. ``sums`` adds them up without a copy of a window for a draw.
    Causes in fewer windows than ``min_occurrences`` are left out.
    """
    drawn = checkpointed(sums(rows, n_bootstrap, seed))
    n_all = drawn.where("cause IS NULL").groupBy("draw").agg(F.sum("n_both").alias("n_all"))  # a row for each draw
    with_token = drawn.where("cause = effect").groupBy("draw", "cause").agg(F.sum("n_both").alias("n_with"))
    pair = drawn.where("cause <> effect").groupBy("draw", "cause", "effect").agg(*(F.sum(x).alias(x) for x in ("n_both", "n_after", "gap"))).where("n_both > 0")
    pair = pair.withColumn("gap", F.col("gap") / F.col("n_both"))
    c = with_token.select("draw", "cause", F.col("n_with").alias("n_cause"))
    e = with_token.select("draw", F.col("cause").alias("effect"), F.col("n_with").alias("n_effect"))
    cells = pair.join(c, ["draw", "cause"]).join(e, ["draw", "effect"]).join(F.broadcast(n_all), "draw")
    without = F.col("n_all") - F.col("n_cause")
    ate = F.col("n_after") / F.col("n_cause") - F.when(without > 0, (F.col("n_effect") - F.col("n_both")) / without).otherwise(0.0)
    cells = cells.withColumn("ate", ate)
    own = F.col("draw") == 0
    out = cells.groupBy("cause", "effect").agg(
        F.max(F.when(own, F.col("ate"))).alias("ate"), F.percentile(F.when(~own, F.col("ate")), F.lit(0.025)).alias("ci_lo"), F.percentile(F.when(~own, F.col("ate")), F.lit(0.975)).alias("ci_hi"),
        F.max(F.when(own, F.col("gap"))).alias("tgap"), F.max(F.when(own, F.col("n_cause"))).cast("bigint").alias("n"),
    )
    return out.where(F.col("n") >= min_occurrences)


def full_matrix(pairs: DataFrame, parts: DataFrame, value: str = "ate") -> DataFrame:
    """Every wanted pair with its value; pairs that no part has stay 0."""
    return pairs.join(parts, ["cause", "effect"], "left").select("cause", "effect", F.coalesce(value, F.lit(0.0)).alias(value))


def edges(table: DataFrame, threshold: float = 0.02, ordered: bool = False) -> DataFrame:
    """Effects of at least ``threshold``; with ``ordered`` only those whose effect comes later on average."""
    kept = table.where(F.col("ate") >= threshold)
    return kept.where(F.col("tgap") > 0) if ordered else kept


def cascades(edges_: DataFrame, max_depth: int = 5, least: float = 0.02) -> DataFrame:
    """path (tokens joined by >), depth and effect (product along it) of paths without repeats.

    One join with the edge table a step; the product falls with each step, so
    ``least`` prunes while paths grow.
    """
    step = edges_.select(F.col("cause").alias("at"), F.col("effect").alias("to"), F.col("ate").alias("a"))
    front = edges_.select(F.array("cause", "effect").alias("p"), F.col("ate").cast("double").alias("total")).where(F.col("total") >= least)
    every = front
    for _ in range(max_depth - 1):
        front = front.join(step, F.element_at("p", -1) == F.col("at")).where(~F.array_contains("p", F.col("to")))
        front = front.select(F.array_append("p", F.col("to")).alias("p"), (F.col("total") * F.col("a")).alias("total")).where(F.col("total") >= least)
        every = every.unionByName(front)
    return every.select(F.array_join(F.transform("p", lambda x: x.cast("string")), ">").alias("path"), (F.size("p") - 1).alias("depth"), F.col("total").alias("effect"))


def explanation(cause: Column, effect: Column, ate: Column, lo: Column, hi: Column) -> Column:
    """Prompt text for one edge; an absent interval reads as 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.format_string("Explain why %s may lead to %s (average effect %.4f, 95%% interval %.4f to %.4f).", cause, effect, ate.cast("double"), zero(lo), zero(hi))
