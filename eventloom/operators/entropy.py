"""Transfer entropy between binned series: lag search and permutation test.

The series act at tau + 1 bins: the pair is shifted by tau, and the kernel reads
the source one step before the target. A histogram of (source, history, next)
per pair and lag is all that is needed, so the plan is windows of a series, one
groupBy, and arithmetic over its groups.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY, SHUFFLES, ALPHA = 3, 1000, 0.05
#: Bin seconds and largest lag of each time window.
WINDOWS = {"5sec": (5, 120), "1min": (60, 10), "10min": (600, 6)}
LEAST_ENTROPY = 1e-8


def bonferroni(alpha: float = ALPHA, n: int = 87) -> float:
    return alpha / (n * (n - 1))


def pairs(tokens: DataFrame) -> DataFrame:
    """Every ordered pair of different tokens; the vocabulary is the bound."""
    return tokens.select(F.col("token").alias("cause")).crossJoin(F.broadcast(tokens.select(F.col("token").alias("effect")))).where("cause <> effect")


def lags(pairs_: DataFrame, low: int, high: int) -> DataFrame:
    return pairs_.withColumn("tau", F.explode(F.sequence(F.lit(low), F.lit(high))))


def _effect_histories(series: DataFrame, k: int) -> DataFrame:
    """token, bin, y and the k values before, oldest first, where all are there."""
    w = W.partitionBy("token").orderBy("bin")
    h = F.concat_ws(",", *[F.lag("x", i).over(w).cast("string") for i in range(k, 0, -1)])
    return series.withColumns({"h": h, "i": F.row_number().over(w) - 1}).where(F.col("i") >= k).select(F.col("token").alias("effect"), "bin", "i", F.col("x").alias("y"), "h")


def transfer_entropy(series: DataFrame, wanted: DataFrame, k: int = HISTORY) -> DataFrame:
    """cause, effect, tau, te (bits) for each wanted (cause, effect, tau).

    series: (token, bin, x), dense over one common range of bins. Histories are
    worked out once for each effect and shared by its causes and lags.
    """
    y = _effect_histories(series, k)
    x = series.select(F.col("token").alias("cause"), F.col("bin").alias("xbin"), "x")
    both = y.join(F.broadcast(wanted), "effect").where(F.col("i") >= k + F.col("tau")).withColumn("xbin", F.col("bin") - F.col("tau") - 1)
    joint = both.join(x, ["cause", "xbin"]).groupBy("cause", "effect", "tau", "x", "h", "y").agg(F.count(F.lit(1)).alias("n_xhy"))
    key = ["cause", "effect", "tau"]
    w = lambda *c: W.partitionBy(*key, *c)  # noqa: E731  over histogram cells, not rows
    cells = joint.withColumns({
        "n_xh": F.sum("n_xhy").over(w("x", "h")), "n_hy": F.sum("n_xhy").over(w("h", "y")), "n_h": F.sum("n_xhy").over(w("h")), "n": F.sum("n_xhy").over(w()),
    })
    term = F.col("n_xhy") / F.col("n") * F.log2(F.col("n_xhy") * F.col("n_h") / (F.col("n_xh") * F.col("n_hy")))
    return cells.groupBy(*key).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("te"))


def best_lag(entropies: DataFrame, least: float = LEAST_ENTROPY) -> DataFrame:
    """The lag of most entropy for each pair, the shortest on ties; pairs under the floor are dropped."""
    best = F.max(F.struct("te", (-F.col("tau")).alias("t")))
    return entropies.groupBy("cause", "effect").agg(best.alias("b")).select("cause", "effect", (-F.col("b.t")).alias("tau"), "b.te").where(F.col("te") >= least)


def shuffled(series: DataFrame, seed: str, times: int) -> DataFrame:
    """``times`` permutations of a series as (perm, token, bin, x), by hash order: the same in every run and engine."""
    base = series.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    at = W.partitionBy("perm", "token").orderBy("bin")
    by = W.partitionBy("perm", "token").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "perm", "bin")), "bin")
    values = base.select("perm", "token", F.row_number().over(by).alias("i"), "x")
    return base.select("perm", "token", F.row_number().over(at).alias("i"), "bin").join(values, ["perm", "token", "i"]).select("perm", "token", "bin", "x")


def permutation_test(observed: DataFrame, surrogates: DataFrame, alpha: float | None = None) -> DataFrame:
    """p_value (share of surrogates that reach the observation, without correction) and significance."""
    both = surrogates.join(F.broadcast(observed), ["cause", "effect", "tau"])
    tested = both.groupBy("cause", "effect", "tau", "te").agg(F.avg((F.col("te_s") >= F.col("te")).cast("double")).alias("p_value"))
    return tested.withColumn("significant", F.col("p_value") < (bonferroni() if alpha is None else alpha))


def surrogates_of(x: np.ndarray, y: np.ndarray, tau: int, seeds: list[tuple[int, ...] | None], k: int = HISTORY) -> np.ndarray:
    """Transfer entropy at ``tau`` with the source as it is (seed None) or permuted by a generator of that seed.

    Only cells that hold the source change with a permutation; the others are
    summed up once.
    """
    n = len(x) - tau
    source, target = x[: len(x) - tau], y[tau:]
    if n <= k:
        return np.zeros(len(seeds))
    h = np.unique(np.stack([target[k - i : n - i] for i in range(k, 0, -1)], axis=1), axis=0, return_inverse=True)[1].ravel()
    hy = np.unique(np.stack([h, target[k:]], axis=1), axis=0, return_inverse=True)[1].ravel()
    symbols, codes = np.unique(source, return_inverse=True)
    weight = np.concatenate([[0.0], (m := np.arange(1, n + 1)) * np.log2(m)])  # m log2 m of every count there can be
    fixed = weight[np.bincount(h)].sum() - weight[np.bincount(hy)].sum()
    out = []
    for seed in seeds:
        at = (codes if seed is None else np.random.default_rng(seed).permutation(codes))[k - 1 : n - 1].astype(np.int64)
        cells = weight[np.bincount(hy * len(symbols) + at)].sum() - weight[np.bincount(h * len(symbols) + at)].sum()
        out.append(max(0.0, (cells + fixed) / (n - k)))
    return np.array(out)


def permutation_tests(series: DataFrame, wanted: DataFrame, times: int = SHUFFLES, alpha: float | None = None, k: int = HISTORY, block: int = 50) -> DataFrame:
    """cause, effect, tau, te, p_value, significant for each wanted (cause, effect, tau), by ``times`` permutations of the source.

    series: as for ``transfer_entropy``. Each permutation has the seed (cause,
    effect, number), so blocks of them are tasks of their own and every run has
    the same ones. Series travel as one array a token; their length is the range
    of bins, whatever the number of events.
    """
    xs = F.transform(F.array_sort(F.collect_list(F.struct("bin", "x"))), lambda s: s["x"].cast("int"))
    arrays = series.groupBy("token").agg(xs.alias("xs"))
    first = F.explode(F.sequence(F.lit(0), F.lit(times - 1), F.lit(block)))
    asked = wanted.select("cause", "effect", F.col("tau").cast("int").alias("tau"), first.alias("low"))
    asked = asked.repartition(4 * series.sparkSession.sparkContext.defaultParallelism, "cause", "effect", "low")  # small rows with much work: a number given, so that they are not put together again
    side = lambda c: F.broadcast(arrays.select(F.col("token").alias(c), F.col("xs").alias(f"xs_{c}")))
    rows = asked.join(side("cause"), "cause").join(side("effect"), "effect").select("cause", "effect", "tau", "low", "xs_cause", "xs_effect")

    def run(batches):
        for batch in batches:
            te, reached, done = [], [], []
            for c, e, tau, low, x, y in zip(*batch.columns, strict=True):
                x, y = (np.asarray(v.values) for v in (x, y))
                numbers = range(low.as_py(), min(low.as_py() + block, times))
                got = surrogates_of(x, y, tau.as_py(), [None, *((c.as_py(), e.as_py(), i) for i in numbers)], k)
                te.append(got[0])
                reached.append(int((got[1:] >= got[0] - 1e-12).sum()))
                done.append(len(numbers))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(pa.int32()) for i in range(3)), pa.array(te, pa.float64()), pa.array(reached, pa.int64()), pa.array(done, pa.int64())], names=["cause", "effect", "tau", "te", "reached", "done"])

    blocks = rows.mapInArrow(run, "cause int, effect int, tau int, te double, reached long, done long")
    tested = blocks.groupBy("cause", "effect", "tau").agg(F.max("te").alias("te"), (F.sum("reached") / F.sum("done")).alias("p_value"))
    return tested.withColumn("significant", F.col("p_value") < (bonferroni() if alpha is None else alpha))


def transfer_entropy_of(x: list[int], y: list[int], tau: int, k: int = HISTORY) -> float:
    """The kernel over two short series in plain Python: for tests and for series that are already local."""
    n = len(x)
    if n <= k or tau >= n - k:
        return 0.0
    cells = Counter((x[i - tau - 1], tuple(y[i - k : i]), y[i]) for i in range(k + tau, n) if i - tau - 1 >= 0)
    total = sum(cells.values())
    xh, hy, h = Counter(), Counter(), Counter()
    for (a, b, c), m in cells.items():
        xh[a, b] += m
        hy[b, c] += m
        h[b] += m
    return max(0.0, sum(m / total * math.log2(m * h[b] / (xh[a, b] * hy[b, c])) for (a, b, c), m in cells.items()))
