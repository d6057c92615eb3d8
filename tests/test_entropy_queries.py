"""Transfer entropy over capped counts: what residues hide must be found."""

import datetime
import random

import numpy as np
import pytest

from eventloom.operators import entropy as E
from eventloom.plans import registry


@pytest.fixture(scope="module")
def driven(spark, tmp_path_factory):
    """Two days in which errors come in number as clicks did three 10-minute bins before, always in multiples of 3; purchases follow nothing."""
    rng, rows = random.Random(5), []
    clicks = [rng.choice([0, 3, 6, 9]) for _ in range(288)]
    for i, n in enumerate(clicks):
        for kind, m in (("click", n), ("error", clicks[i - 3] if i >= 3 else 0), ("purchase", rng.choice([1, 2, 3]))):
            rows += [(len(rows) + j, 1, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=10 * i, seconds=30 * j), kind, 1.0) for j in range(m)]
    d = tmp_path_factory.mktemp("driven")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return str(d)


def test_counts_keep_their_size_up_to_the_cap(spark, driven):
    assert {r.x for r in registry.capped_series(spark, driven, "10min").where("token = 0").collect()} == {0, 3, 6, 9}
    # in the residues that the SQL of the older queries asks for, nothing is left of the dependence
    assert {r.te for r in registry.te_all_lags(spark, driven).where("cause = 0 AND effect = 1").collect()} == {0.0}
    best = {(r.cause, r.effect): r for r in registry.te_capped_lag_search(spark, driven).where("at = '10min'").collect()}
    assert best[0, 1].tau == 2 and best[0, 1].te > 1  # the kernel reads the source one step before


def test_surrogates_match_the_kernel():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    for tau in (1, 5):
        got = E.surrogates_of(x, y, tau, [None, (0, 1, 7)])
        mixed = np.concatenate([np.random.default_rng((0, 1, 7)).permutation(x[: 300 - tau]), x[300 - tau :]])
        assert got == pytest.approx([E.transfer_entropy_of(s.tolist(), y.tolist(), tau) for s in (x, mixed)], abs=1e-9)
    assert E.surrogates_of(x[:4], y[:4], 1, [None]) == [0.0]


def test_every_pair_is_tested_at_its_best_lag(spark, driven):
    got = {(r.cause, r.effect): r for r in registry.te_capped_permutation(spark, driven).where("at = '10min'").collect()}
    assert set(got) == {(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if a != b}  # a single pair before
    assert got[0, 1].tau == 2 and got[0, 1].p_value == 0 and got[0, 1].significant
    assert all(round(r.p_value * 1000, 6) % 1 == 0 for r in got.values()) and not got[2, 0].significant
    best = {(r.cause, r.effect): (r.tau, r.te) for r in registry.te_capped_lag_search(spark, driven).where("at = '10min'").collect()}
    assert {k: (r.tau, r.te) for k, r in got.items()} == best


def test_correlations_of_every_pair_and_lag(spark, driven):
    got = {(r.cause, r.effect, r.tau): r.r for r in registry.lagged_correlations(spark, driven).where("at = '10min'").collect()}
    assert len(got) == 6 * 6 and got[0, 1, 3] == 1.0 and abs(got[0, 1, 2]) < 0.5
