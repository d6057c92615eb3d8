import random
import re
from collections import defaultdict

from eventloom.llm import passages, suffix_dedup

W = passages.WORDS


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    rows = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - W + 1):
            rows[tuple(w[k : k + W])].add(i)
    out = []
    for w in words:
        hit = set()
        for k in range(len(w) - W + 1):
            if len(rows[tuple(w[k : k + W])]) > 1:
                hit.update(range(k, k + W))
        out.append(len(hit))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.removed(df).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want, [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]][:5]
    return got


def test_documents(spark, small):
    assert any(check(spark, [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]).values())


def test_passages_under_400_bytes(spark):
    rng = random.Random(3)
    some = lambda n: [rng.choice("abcdefgn") + rng.choice("hijk") for _ in range(n)]
    passage, inner = some(60), some(90)
    texts = [" ".join(some(40) + passage + some(70)), "\n".join(some(5)) + "  " + "\t".join(w.upper() for w in passage), None, "", "a b"]
    texts += [" ".join(inner + some(9) + inner)]  # repeats within one text do not count by themselves
    long = some(300)
    texts += [" ".join(long), " ".join(long), " ".join(long[100:200]), " ".join(some(30) + long[20:71] + some(30) + long[120:170] + some(4))]
    for size in range(49, 54):
        piece = some(size)
        texts += [" ".join(some(rng.randint(0, 80)) + piece), " ".join(piece + some(rng.randint(0, 80)) + piece)]
    for _ in range(10):
        copy = list(long)
        copy[rng.randrange(300)] = "#"
        a = rng.randrange(0, 200)
        texts.append(" ".join(copy[a : a + rng.randint(51, 120)] + some(3)))
    got = check(spark, texts)
    assert got[0] == 60 and got[5] == 0


def test_tables_have_few_files(spark):
    from pathlib import Path

    from eventloom.llm.common import cut_lean, drop

    table = cut_lean(spark.range(1000).repartition(40, "id").groupBy("id").count(), 3)
    folder = Path(table.table_path.removeprefix("file:"))
    assert len(table.inputFiles()) <= 3 and table.count() == 1000
    assert not [p for p in folder.iterdir() if p.name.endswith(".crc")]
    drop(table)
    assert not folder.exists()
