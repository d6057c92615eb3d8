"""Byte-level BPE by prefix-sharing trie traversal.

Distinct words are visited in sorted order, which is the depth-first order of
their trie. The state of a trie node is the last token of the BPE encoding of
the prefix that ends there; it follows from the states above it, so a prefix
shared by many words is worked out once. A token ``t`` that is a suffix of the
prefix is its last token exactly when ``t`` and the last token of what stands
before it stay apart under the merges.

Defined results: null text counts as empty; the empty text has no tokens and
hashes of the empty string; repeated rows are encoded each by itself; extra
columns are ignored. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the word pattern of this family of vocabularies, with white space spelled out.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words kept in a task before the table is started anew; bounds memory only.
CACHE_WORDS = 500_000
#: Characters gathered before their new words are put in a trie together.
BLOCK_CHARS = 2_000_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes, by the rule byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token = {i: bytes(stand[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.size = {i: len(b) for i, b in self.token.items()}
        self.vocab = {b: i for i, b in self.token.items() if i not in self.special.values()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(stand[c] for c in s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.halves = {new: (*pair, rank) for pair, (rank, new) in self.merge.items()}
        # lengths of the tokens that end in a tail, longest first
        self.tails: tuple[dict[bytes, tuple[int, ...]], ...] = ({}, {}, {}, {}, {})
        for n in (1, 2, 3, 4):
            found: dict[bytes, set[int]] = {}
            for b in self.vocab:
                if len(b) >= n:
                    found.setdefault(b[-n:], set()).add(len(b))
            for tail, sizes in found.items():
                sizes.update(k for k in range(1, n) if tail[-k:] in self.vocab)
                self.tails[n][tail] = tuple(sorted(sizes, reverse=True))
        self.apart: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORD).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.ids: dict[str, str] = {}
        self.out: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give back what was learnt from texts, so that a worker holds the vocabulary alone between tasks."""
        for table in (self.apart, self.ids, self.out):
            table.clear()
        pa.default_memory_pool().release_unused()

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, for pairs of tokens only."""
        parts = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.merge.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            pair, i, done = (parts[best[2]], parts[best[2] + 1]), 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    done.append(best[1])
                    i += 2
                else:
                    done.append(parts[i])
                    i += 1
            parts = done
        return parts

    def _stay(self, key: tuple[int, int]) -> bool:
        """Whether the second token can follow the first; -1 stands for the start of a word.

        Merges run by rank, so the two stay apart unless some merge across
        their border comes before the merges that built what touches the border.
        """
        a, b = key
        if a < 0:
            good = self.merged(self.token[b]) == [b]
        else:
            good, merge, halves, limit = True, self.merge, self.halves, 1 << 60
            while True:
                across = merge.get((a, b))
                if across is not None and across[0] < limit:
                    good = False
                    break
                ha, hb = halves.get(a), halves.get(b)
                ra, rb = ha[2] if ha else -1, hb[2] if hb else -1
                if ha is None and hb is None:
                    break
                # undo the later of the two merges; on a tie the left one ran first
                if ra > rb:
                    limit, a = ra, ha[1]
                else:
                    limit, b = rb + 1, hb[0]
        self.apart[key] = good
        return good

    def traverse(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Depth first over the trie of ``words``; gives each word's token ids."""
        vocab, apart, stay, size = self.vocab.get, self.apart, self._stay, self.size
        known, one, two, three, four = apart.get, *(t.get for t in self.tails[1:])
        last, before = [-1], b""
        for w in sorted(words):
            n, shared = len(w), 0
            most = min(n, len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n + 1):
                for k in (i > 3 and four(w[i - 4 : i])) or (i > 2 and three(w[i - 3 : i])) or (i > 1 and two(w[i - 2 : i])) or one(w[i - 1 : i]):
                    if k <= i:
                        t = vocab(w[i - k : i])
                        if t is not None:
                            key = (last[i - k], t)
                            good = known(key)
                            if good or good is None and stay(key):
                                last.append(t)
                                break
                else:
                    raise ValueError("the vocabulary cannot encode a byte")
            before, ids, i = w, [], n
            while i:
                ids.append(last[i])
                i -= size[last[i]]
            ids.reverse()
            yield w, ids
        if len(apart) > 4_000_000:
            apart.clear()

    def learn(self, words: set[str]) -> None:
        new = words - self.ids.keys()
        token = self.token
        for w, ids in self.traverse([w.encode() for w in new]):
            word = w.decode()
            self.ids[word] = ",".join(map(str, ids))
            self.out[word] = b"".join([token[i] for i in ids])

    def pieces(self, text: str) -> list[list[str] | int]:
        """Words between special tokens, and the ids of special tokens."""
        if self.split is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [self.special[p] if k % 2 else self.words(p) for k, p in enumerate(self.split(text))]

    def block(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Comma-joined ids and decoded bytes of each text."""
        cut = [self.pieces(t) for t in texts]
        need: set[str] = set()
        for doc in cut:
            for p in doc:
                if not isinstance(p, int):
                    need.update(p)
        if len(self.ids) + len(need) > 1.2 * CACHE_WORDS:
            self.ids.clear()
            self.out.clear()
        self.learn(need)
        ids, out, done = self.ids.__getitem__, self.out.__getitem__, []
        for doc in cut:
            a = [str(p) if isinstance(p, int) else ",".join(map(ids, p)) for p in doc]
            b = [self.token[p] if isinstance(p, int) else b"".join(map(out, p)) for p in doc]
            done.append((",".join(x for x in a if x), b"".join(b)))
        return done

    def encode(self, text: str) -> list[int]:
        joined = self.block([text])[0][0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def bpe_round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves on request.

    No shuffle: each task streams its rows through one Codec. The table of known
    words is bounded and goes with the task, the trie of a block holds that block's new words only.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("token_ids", pa.list_(pa.int32()))] * ids

    def run(batches):
        c = codec(public_vocabulary(vocabulary))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cols: list[list] = [[] for _ in fields]
            for held in blocks(texts):
                for joined, out in c.block(held):
                    cols[0].append(joined.count(",") + 1 if joined else 0)
                    cols[1].append(sha256(joined.encode()).hexdigest())
                    cols[2].append(sha256(out).hexdigest())
                    if ids:
                        cols[3].append([int(x) for x in joined.split(",")] if joined else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f[1]) for c, f in zip(cols, fields, strict=True))], names=[key, *(f[0] for f in fields)])
        c.forget()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return docs.select(key, text).mapInArrow(run, schema)
