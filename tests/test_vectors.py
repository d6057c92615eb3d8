"""Golden values and properties of single operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import classify as C
from eventloom.functions import repair as R
from eventloom.functions.rules import RULES
from eventloom.functions.vocab import EVENTS, GROUPS, Vocabulary, column_order
from eventloom.operators import binning as B
from eventloom.operators import entropy as E
from eventloom.operators import links as L
from eventloom.operators import notes as N
from eventloom.operators import pcmci as P
from eventloom.operators import sampling as S
from eventloom.operators import sequences as Q
from eventloom.sources import logs


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_vocabulary_is_whole():
    assert len(EVENTS) == len(set(EVENTS)) == 87
    assert sorted(column_order()) == sorted(EVENTS)
    assert [len(v) for v in GROUPS.values()] == [8, 10, 9, 10, 5, 11, 11, 16, 7]
    assert len(RULES) == 80 and {r[0] for r in RULES} <= set(EVENTS)
    assert {e for _, e in C.BANKS} | {C.BANK_UNKNOWN} == set(EVENTS) - {r[0] for r in RULES}


def test_tokens(spark):
    v = Vocabulary()
    assert one(spark, v.token, "NET_CXI_RAW_DATA", "HW_MCE_UNK", "what", None) == [0, 86, 88, 88]
    assert one(spark, v.name, 0, 86, 88, kind="int") == ["NET_CXI_RAW_DATA", "HW_MCE_UNK", None]


def test_time_baskets(spark):
    seconds = [0.0, 0.15, 0.5, 1.5, 30.0, 120.0, 1800.0, 7200.0, 86400.0, 604800.0, 31536000.0, 4e7, -3.0, 59.9, 3599.0, 86399.0]
    assert one(spark, C.time_basket, *seconds, kind="double") == [0, 150, 500, 1000, 1029, 1061, 1089, 1121, 1144, 1150, 1509, 1509, 0, 1058, 1118, 1142]
    assert one(spark, C.basket_label, 0, 999, 1000, 1060, 1120, 1144, 1509, kind="int") == ["0ms", "999ms", "1s", "1min", "1hr", "1day", "365+days"]


def test_banks_and_gate(spark):
    lines = ["MC5_STATUS", "Machine Check seen, Bank 17", "Machine Check Bank 64", "Machine Check", "Bank 17", "", None, "Machine Check Bank 99999999999999999999"]
    got = one(spark, C.classify, *lines)
    assert got[:3] == ["HW_CPU_CORE", "HW_MEM_DIMM", "HW_MCE_UNK"] and got[4:] == [None, None, None, "HW_MCE_UNK"]


def test_rule_order(spark):
    lines = ["Fatal error during GPU init", "RIP: 0010:a1", "slurmstepd startup took 9 s", "cxi_core a\rb Carrier lost", "lneterror: x FAILED"]
    assert one(spark, C.classify, *lines) == ["NET_CXI_HW_ECC", "SYS_SEGFAULT", "APP_INFRA_FAIL", "NET_CXI_LINK", "NET_LNET_ERR"]


def test_rarity(spark):
    assert one(spark, C.rarity, 0, 499, 500, 5000, 50000, 500000, kind="long") == ["ULTRA_RARE", "ULTRA_RARE", "RARE", "MODERATE", "COMMON", "VERY_COMMON"]


def test_repair(spark):
    assert one(spark, R.null_sentinels, "nan", "None", "<NA>", "NaT", "x") == [None, None, None, "NaT", "x"]
    assert one(spark, R.long_of, "12.0", "x", None, "7") == [12, None, None, 7]
    assert one(spark, lambda c: R.clip(c, 0, 10), -1, 5, 11, kind="int") == [0, 5, 10]


def test_synthetic_axis(spark):
    rows = [("a", 0), ("a", 14), ("b", 20), ("b", 29)]
    m = B.manifest(spark.createDataFrame(rows, "node string, ts long"), 5).orderBy("rank").collect()
    assert [(r.n_bins, r.start_bin * 5, r.separator_bin * 5) for r in m] == [(3, 0, 15), (2, 20, 30)]
    assert one(spark, lambda c: B.bin_of(c, 5), -7, -5, 4, kind="long") == [-2, -1, 0]


def test_windows(spark):
    assert Q.n_windows(10, 4, 2) == 4 and Q.n_windows(3, 4, 2) == 1
    seq = spark.createDataFrame([(i, t, i) for i, t in enumerate([0, 0, 0, 1])], "g long, token int, ts long")
    w = Q.capped(Q.window_rows(seq, 4, 8, 4), 2).orderBy("pos").collect()
    assert [r.token for r in w] == [0, 0, 88, 1]
    t = Q.training_windows(Q.with_deltas(Q.window_rows(seq, 4, 8, 4)), 8).collect()[0]
    assert list(t.event_ids) == [0, 0, 0, 1, 87, 87, 87, 87] and list(t.target) == [0, 0, 1, 87, 87, 87, 87, 87] and t.time_deltas[0] == 0


def test_window_seconds_are_summed_before_deltas_are_narrowed(spark):
    steps = [40_000.004, 40_000.004, 40_000.004, 40_000.4879]  # 160000.4999; 160000.5 and more in 32 bits
    at = [0] + [round(sum(steps[: i + 1]) * 1e6) for i in range(4)]
    seq = spark.createDataFrame([(i, 0, t) for i, t in enumerate(at)], "g long, token int, ts long")
    w = Q.training_windows(Q.with_deltas(Q.window_rows(seq, 5, 8, 4), per_second=1_000_000), 8).collect()[0]
    assert abs(w.seconds - 160_000.4999) < 1e-6 and sum(w.time_deltas) >= 160_000.5


def test_ordinals_over_many_ranges(spark):
    rows = [(f"n{i % 7}", i * 37 % 1000) for i in range(1000)]
    got = Q.ordinals(spark.createDataFrame(rows, "node string, ts long"), ["node", "ts"], 6).orderBy("g").collect()
    assert [r.g for r in got] == list(range(1000)) and [(r.node, r.ts) for r in got] == sorted(rows)


def test_cover_and_merge(spark):
    rows = spark.createDataFrame([("a", r, 99) for r in (3, 5, 9, 10, 30)], "node string, r int, lim int")
    w = S.greedy_cover(rows, ["node"], "r", 4, "lim").orderBy("lo")
    assert [(r.lo, r.hi) for r in w.collect()] == [(0, 7), (5, 13), (26, 34)]
    many = [("b" if r % 3 else None, r * r % 10_007, 10_006) for r in range(3000)] + [("c", None, 5), ("d", 1, None), ("d", 1, None)]
    want = set()
    for node in ("b", None, "d"):
        covered = -1
        for r, end in sorted({(r, end) for n, r, end in many if n == node}):
            if r > covered:
                covered = r + 4 if end is None else min(r + 4, end)
                want.add((node, max(r - 4, 0), covered))
    got = S.greedy_cover(spark.createDataFrame(many, "node string, r int, lim int"), ["node"], "r", 4, "lim").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert [(r.lo, r.hi) for r in S.merged(w, ["node"]).orderBy("lo").collect()] == [(0, 13), (26, 34)]


def test_sampler_covers_rare_rows_and_the_target(spark):
    active = [t for t in range(500) if t * 7 % 3]
    cells = [("g", "n", t, 1 if t in active else None, 1 if t in active else 0) for t in range(500)] + [("g", "n", t, 2, 1) for t in (3, 77, 400)]
    df = spark.createDataFrame(cells, "group string, node string, t long, token int, cnt long")
    for target in (10, 120, 600):
        got = {r.t: r.segment for r in S.contiguous_sample(df, target, 20, 0.1).collect()}
        assert len(got) >= min(target, 500) and {t for r in (3, 77, 400) for t in range(max(0, r - 10), r + 11)} <= set(got)
        assert all((t - 1 not in got) == (got[t] != got.get(t - 1)) for t in got)
        assert len(got) <= max(target + 20, 56)
    out = S.separated(S.contiguous_sample(df, 120, 20, 0.1)).collect()
    assert sum(r.is_separator for r in out) == len({r.segment for r in out}) - 1 and all((r.t is None) == r.is_separator for r in out)


def test_cross_groups_are_seeded(spark):
    groups = S.node_groups(spark.createDataFrame([(f"n{i:02d}",) for i in range(48)], "node string"))
    got, again = (sorted(map(tuple, S.cross_groups(groups, 0.5).collect())) for _ in range(2))
    assert got == again and len({g for _, g in got}) == 3 and len(got) == 24
    for name in {g for _, g in got}:
        assert sorted(n < "n24" for n, g in got if g == name) == [False] * 4 + [True] * 4


def test_fisher(spark):
    df = spark.createDataFrame([(20.0, 3), (0.0, 1), (5.0, 1)], "x double, n long")
    a, b, c = (r.p for r in df.select(L.fisher_p(F.col("x"), F.col("n")).alias("p")).collect())
    assert a == pytest.approx(0.00276939571551) and b == 1.0 and c == pytest.approx(math.exp(-2.5))


def test_rarity_score(spark):
    links = spark.createDataFrame([("a", "b", 1, 1e-6, 3), ("a", "zz", 1, 1e-6, 3), ("a", "b", 2, 0.5, 9)], "cause string, effect string, tau int, p_val double, n_votes long")
    events = spark.createDataFrame([("a", 40, 24, "ULTRA_RARE"), ("b", 10**6, 400, "VERY_COMMON")], "event string, total_count long, nodes_with_event long, rarity string")
    got = {(r.effect, r.tau): r for r in L.scored(links, events).collect()}
    assert set(got) == {("b", 1), ("zz", 1)}
    assert got["b", 1].max_votes == 3 and got["b", 1].score == 6.0 and got["b", 1].edge_rarity == "ULTRA_RARE"
    assert got["zz", 1].max_votes == 1 and got["zz", 1].effect_count == 0


def test_transfer_entropy_against_plain_python(spark):
    rng = random.Random(0)
    x = [rng.randint(0, 2) for _ in range(400)]
    y = [0, 0, 0] + [x[i - 3] if rng.random() < 0.8 else rng.randint(0, 2) for i in range(3, 400)]
    rows = [(0, i, v) for i, v in enumerate(x)] + [(1, i, v) for i, v in enumerate(y)]
    series = spark.createDataFrame(rows, "token int, bin long, x long")
    wanted = E.lags(E.pairs(series.select("token").distinct()), 1, 4)
    got = {(r.cause, r.effect, r.tau): r.te for r in E.transfer_entropy(series, wanted).collect()}
    for (c, e, tau), te in got.items():
        a, b = (x, y) if c == 0 else (y, x)
        assert te == pytest.approx(E.transfer_entropy_of(a, b, tau), abs=1e-9)
    best = {(r.cause, r.effect): r.tau for r in E.best_lag(E.transfer_entropy(series, wanted)).collect()}
    assert best[0, 1] == 2  # acts one step beyond the shift


def test_t_tail():
    assert P.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-9)
    assert P.t_two_sided(0.0, 5) == pytest.approx(1.0) and P.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_planted_link_is_found():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(800, 4))
    for t in range(2, 800):
        data[t, 1] += 0.8 * data[t - 2, 0]
        data[t, 2] += 0.7 * data[t - 1, 1]
    found = {(c, e, tau) for c, e, tau, _, _ in P.pcmci(data, alpha=0.001)}
    assert {(0, 1, 2), (1, 2, 1)} <= found and (0, 2, 3) not in found and not any(3 in (c, e) for c, e, _ in found)


def test_lags_stay_in_their_segment():
    lagged = P.Lagged(np.zeros((20, 1)), np.repeat([0, 1], 10), 6)
    assert lagged.rows.tolist() == [6, 7, 8, 9, 16, 17, 18, 19]


def test_notes(spark):
    notes = spark.createDataFrame([("hub", "see [[ops/a]] and [[gone|x]]\nPower\n"), ("ops/a", "one\r\ntwo\npower two\nfour")], "note string, body string")
    assert {(r.note, r.line, r.context) for r in N.search(notes, "POWER").collect()} == {("hub", "2", "see [[ops/a]] and [[gone|x]]\nPower"), ("ops/a", "3", "one\ntwo\npower two\nfour")}
    assert [(r.target) for r in N.dangling(notes).collect()] == ["gone"]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1.0", "a line", "nan"), ("x", "MC5_STATUS", "n2")], "pid string, log_message string, name string")
    df.write.parquet(str(tmp_path / "raw"))
    raw = logs.read_raw(spark, str(tmp_path / "raw"))
    assert raw.columns == R.LOG_COLUMNS
    done = raw.withColumn("event_token", C.classify(F.col("log_message"))).withColumn("dataset_type", C.dataset_type(F.col("event_token")))
    logs.write_classified(done, str(tmp_path / "out"))
    back = logs.read_classified(spark, str(tmp_path / "out"), str(tmp_path / "absent")).orderBy("log_message").collect()
    assert [(r.pid, r.name, r.dataset_type) for r in back] == [(None, "n2", "parsed_logs"), (1, None, "residuals")]
    with pytest.raises(ValueError):
        logs.batch_paths(9, {1: "a"}, {1: "b"})
    links = spark.createDataFrame([("a", "b", 3, "-->", 0.0608, 0.0, 28)], "cause string, effect string, tau int, edge string, val double, p_comb double, n_votes int")
    logs.write_report(links, str(tmp_path / "report"), "title line")
    assert logs.parse_report(spark.read.text(str(tmp_path / "report"))).collect()[0].n_votes == 28
    logs.write_csv(links, str(tmp_path / "csv"), decimals={"val": 2})
    assert logs.read_csv(spark, str(tmp_path / "csv"), "cause string, effect string, tau int, edge string, val double, p_comb double, n_votes int").first().val == 0.06
    (tmp_path / "kb" / "ops").mkdir(parents=True)
    (tmp_path / "kb" / "hub.md").write_text("x [[ops/a]]")
    (tmp_path / "kb" / "ops" / "a.md").write_text("y")
    assert sorted(r.note for r in logs.read_notes(spark, str(tmp_path / "kb")).collect()) == ["hub", "ops/a"]
    assert logs.prompt("p", domain="d") == "[Domain: d] p"


def test_json_links_and_arrays(spark, tmp_path):
    import json

    (tmp_path / "g").mkdir()
    link = {"cause": "a", "effect": "b", "tau": 1, "val": 0.5, "p_val": 0.01, "edge": "-->", "group_id": "g1", "nodes": ["n1"]}
    (tmp_path / "g" / "1.json").write_text(json.dumps({"group_id": "g1", "nodes": ["n1"], "T_total": 9, "T_data_rows": 8, "total_cells_capped": 2, "capped_per_var_group": {"FS": 2}, "links": [link]}, indent=1))
    got = logs.read_links(spark, str(tmp_path / "g")).first()
    assert (got.cause, got.tau, got.T_data_rows, list(got.nodes)) == ("a", 1, 8, ["n1"])
    seq = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "node string, ts long, token int")
    logs.write_sequence(seq, str(tmp_path / "seq"), 2)
    assert spark.read.parquet(str(tmp_path / "seq")).count() == 2
    logs.export_arrays(seq.orderBy("ts"), str(tmp_path), ["ts", "token"], 2)
    assert np.load(tmp_path / "token.npy").tolist() == [5, 6]


def test_stream_counts(spark, tmp_path):
    from eventloom.streaming.live import classified, tumbling_counts

    rows = [("2024-01-01 00:00:01", "Out of memory: Killed process"), ("2024-01-01 00:00:03", "x"), ("2024-01-01 00:10:00", "late enough")]
    spark.createDataFrame(rows, "t string, log_message string").select(F.to_timestamp("t").alias("ts"), "log_message").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, log_message string").parquet(str(tmp_path / "in"))
    q = tumbling_counts(classified(stream), "ts", ["dataset_type"]).writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.dataset_type, r.cnt) for r in spark.table("live").collect()} == {("parsed_logs", 1), ("residuals", 1)}
