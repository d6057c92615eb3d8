import random
import re

from eventloom.llm import components, ngram_join

SCHEMA = "doc_id long, text string, n long"


def brute(rows):
    sets = {}
    for d, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert got == want, [(k, got[k], want[k]) for k in want if got[k] != want[k]][:5]


def test_documents(spark, small):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()])


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A b c  d"), (8, "a b c d e"), (9, "É a b c d e"), (10, "é a b c d e"), (11, "x " * 5000), (12, "x " * 9)])


def test_near_copies_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PACK_SETS", 16)
    monkeypatch.setattr(ngram_join, "BUCKET", 256)
    monkeypatch.setattr(ngram_join, "RATIO", 0)
    rng, rows = random.Random(3), []
    words = [f"w{i}" for i in range(400)]
    for base in range(3):
        text = rng.choices(words, k=120)
        for _ in range(45):
            copy = [rng.choice(words) if rng.random() < rng.choice([0.0, 0.01, 0.02, 0.04]) else w for w in text]
            rows.append((len(rows), " ".join(copy[: rng.randint(90, 120)])))
    passage = rng.choices(words, k=30)
    for _ in range(40):  # one passage in texts that differ otherwise
        rows.append((len(rows), " ".join(rng.choices(words, k=rng.randint(3, 40)) + passage + rng.choices(words, k=5))))
    check(spark, rows)


def test_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_and_ids(spark):
    a, b = " ".join(map(str, range(60))), " ".join(map(str, range(1, 61)))
    rows = [(1, a, 0)] * 5 + [(1, b, 0), (2, b, 0), (None, a, 0), (3, "z y x w v u", 0)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 56, 1)] + [(1, 56, 1)] * 6 + [(2, 56, 1), (3, 2, 3)]


def test_near_copies_are_linked_before_the_last_join(spark, monkeypatch):
    rng, rows, made = random.Random(11), [], []
    text = [f"w{i}" for i in range(200)]
    for _ in range(400):  # texts of three changes each link to those of two, but hardly to one another
        copy = list(text)
        for at in rng.sample(range(200), rng.choice([2, *[3] * 9])):
            copy[at] = f"v{rng.randint(0, 10**9)}"
        rows.append((len(rows), " ".join(copy)))
    enough, dealt = ngram_join.enough, ngram_join.dealt

    def counted(pairs):
        made.append(pairs.count())
        return enough(pairs)

    monkeypatch.setattr(ngram_join, "enough", counted)
    monkeypatch.setattr(ngram_join, "dealt", lambda *a: (*dealt(*a)[:3], 10**9))  # pairs that other lists hold and no link takes away
    check(spark, rows)
    assert len(made) > 2 and made[-1] <= 20 * len(rows)


def test_rounds_look_at_open_lists_only(spark, monkeypatch):
    rng, rows, looked = random.Random(5), [], []
    words = [f"w{i}" for i in range(5000)]
    for _ in range(20):  # copies that link to one another: their lists are done after a round
        text = rng.choices(words, k=120)
        rows += [(len(rows) + i, " ".join([*text, f"end{i}"])) for i in range(8)]
    passage = rng.choices(words, k=60)
    for i in range(20):  # a passage in texts that differ otherwise: its lists stay open
        rows.append((len(rows), " ".join([*passage, *(f"own{i}of{j}" for j in range(14))])))
    dealt = ngram_join.dealt

    def counted(lists, roots, turn):
        looked.append(lists.selectExpr("coalesce(sum(size(places)), 0)").first()[0] if "places" in lists.columns else lists.count())
        return (*dealt(lists, roots, turn)[:3], 10**9)

    monkeypatch.setattr(ngram_join, "dealt", counted)
    check(spark, rows)
    assert len(looked) > 2 and 0 < looked[2] < looked[0] / 2


def test_components_in_one_task_and_by_steps(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    root = {x: x for a, b in edges if a is not None and a != b for x in (a, b)}
    for _ in root:
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (1000, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = components.components(df).collect()
        assert len(got) == len(root) and dict(map(tuple, got)) == root
    assert components.components(df.limit(0)).collect() == []
