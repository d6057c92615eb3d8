import datetime
import hashlib
import math
import random

import pytest

from eventloom.operators import effects
from eventloom.plans import registry


def test_effects_further_than_three_events_count(spark, tmp_path):
    kinds = (["click"] + ["purchase"] * 9 + ["error"] + ["signup"] * 89) * 12
    rows = [(i, 1, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), k, 1.0) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.cause, r.effect): r for r in registry.effect_intervals(spark, str(tmp_path)).collect()}
    assert got[0, 1].tgap == 10 and got[0, 1].ci_lo <= got[0, 1].ate <= got[0, 1].ci_hi


def test_draws_are_never_broadcast_nor_joined_to_windows(spark):
    rows = spark.createDataFrame([(w, t, t) for w in range(50) for t in range(3)], "win long, token int, pos int")
    drawn = effects.sums(rows, 20, 42)
    assert "Join" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_equals_a_plain_version(spark):
    rng, n = random.Random(5), 20
    held = {w: {t: rng.randint(0, 3) * 10 + t for t in rng.sample(range(5), rng.randint(1, 4))} for w in range(60)}
    rows = [(w, t, p + extra) for w, x in held.items() for t, p in x.items() for extra in (0, 50)] + [(60, None, 0)]
    got = effects.effects(spark.createDataFrame(rows, "win long, token int, pos int"), n_bootstrap=n).collect()
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k)) for k in range(1, 7)]
    weight = lambda draw, w: 1 if draw == 0 else sum(int(hashlib.md5(f"42:{draw}:{w}".encode()).hexdigest()[:8], 16) / 2**32 >= s for s in steps)
    want = {}
    for a in range(5):
        for b in range(5):
            values = []
            for draw in range(n + 1):
                total = lambda keep: sum(weight(draw, w) for w in range(61) if keep(held.get(w, {})))
                both = total(lambda x: a in x and b in x)
                if a == b or not both:
                    continue
                n_a, without = total(lambda x: a in x), total(lambda x: a not in x)
                values.append(total(lambda x: a in x and b in x and x[b] > x[a]) / n_a - ((total(lambda x: b in x) - both) / without if without else 0))
            if a != b:
                at = lambda q: sorted(values[1:])[int(q)] * (1 - q % 1) + sorted(values[1:])[min(int(q) + 1, len(values) - 2)] * (q % 1)
                gaps = [x[b] - x[a] for x in held.values() if a in x and b in x]
                want[a, b] = (values[0], at(0.025 * (len(values) - 2)), at(0.975 * (len(values) - 2)), sum(gaps) / len(gaps), sum(a in x for x in held.values()))
    assert {(r.cause, r.effect): pytest.approx((r.ate, r.ci_lo, r.ci_hi, r.tgap, r.n)) for r in got} == {k: v for k, v in want.items() if v[4] >= 10}
