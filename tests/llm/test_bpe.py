import hashlib
import random

from tokenizers import Tokenizer

from eventloom.llm import bpe

SCHEMA = "doc_id long, text string, n_tokens string"
PARTS = ["a", "b", " ", "\n", "\t", "  ", "'s", "'ll", "é", "ß", "1", "²", "Ⅷ", "٣", "—", "…", "中", "文", "😀", "<|endoftext|>", " ", " ", "\x1c", "\x85", "​", "\r\n", "=", "====", "the", " in", "ʰ", "́", "　", "0", "_", "-", "\x00"]


def digest(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    out = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()


def test_documents_and_edges(spark, small):
    tokenizer = Tokenizer.from_file(bpe.public_vocabulary())
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [None, "", " ", "\n\n", "a" * 5000, " " * 700, "=" * 900, "ß" * 300, "<|endoftext|>" * 3, "x<|endoftext|> y", "<|endoftext|", texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(df).collect()}
    assert got == {i: digest(tokenizer, t) for i, t in enumerate(texts)}


def test_fuzz_and_round_trip():
    tokenizer, codec, rng = Tokenizer.from_file(bpe.public_vocabulary()), bpe.codec(bpe.public_vocabulary()), random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        ids = codec.encode(text)
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == text


def test_shared_prefixes_are_worked_out_once():
    codec = bpe.Codec(bpe.public_vocabulary())
    words = [w.encode() for w in (" inter", " interest", " interesting", " interests")]
    assert {w: ids for w, ids in codec.traverse(words)} == {w: codec.encode(w.decode()) for w in words}


def test_empty_table_and_ids(spark):
    assert bpe.bpe_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    row = bpe.bpe_round_trip(spark.createDataFrame([(1, "hello world", "")], SCHEMA), ids=True).first()
    assert bpe.codec(bpe.public_vocabulary()).decode(row.token_ids) == "hello world" and row.n_tokens == len(row.token_ids)
