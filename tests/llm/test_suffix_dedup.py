import hashlib
import random
from collections import Counter

from eventloom.llm import suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes string"
N = suffix_dedup.LENGTH


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + N] for r in raws for i in range(len(r) - N + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - N + 1):
            if seen[r[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want, [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]][:5]


def test_documents(spark, small):
    check(spark, [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()])


def test_edges(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    base, other = word(1500), word(1500)
    texts = [None, "", "a" * 399, "a" * 400, "b" * 400, "a" * 3000, "ab" * 700, base, base[:700] + other[:300] + base[900:], base, base[100:]]
    for size in range(396, 406):  # repeats about the length, at the edges of texts and amid them
        piece = word(size)
        cut = piece.encode()[:size].decode("utf-8", "ignore")
        texts += [cut, word(rng.randint(0, 300)) + cut, word(rng.randint(0, 300)) + cut + word(rng.randint(0, 300)), word(200) + cut + word(7) + cut]
    long = word(900)
    for _ in range(12):
        copy = list(long)
        copy[rng.randrange(900)] = "#"
        a = rng.randrange(0, 400)
        texts.append(word(rng.randint(0, 50)) + "".join(copy)[a : a + rng.randint(400, 900)])
    check(spark, texts)


def test_repeated_rows_and_empty(spark):
    text = "".join(chr(97 + i % 23) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (1, "short"), (None, text + "x")], "doc_id long, text string")
    rows = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.removed(df).collect())
    n = len(text)
    assert rows == [(5, 0), (n, n), (n, n), (n + 1, n)]
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
