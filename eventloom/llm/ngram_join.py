"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of shingles; equal sets form a class, and classes are
joined. Shingles are ordered by their exact number of classes, rarest first. Of
n shingles, two sets with Jaccard of 0.75 or more share at least l of their
first n - ceil(0.75 n) + l ones; each document picks the l that the frequencies
make cheapest, a pair needs the smaller l of the two, and is verified only if it
has that many. Shingles of one class only meet nothing and are never dealt out;
a set whose shortest prefix holds no others is linked to nothing.

Frequencies: classes lie in packs of bounded size. A pack sends each of its
shingles once, with its count there, to a bucket of the hash range, and gets the
bucket's totals back in the order sent. So a frequent shingle costs a row for
each pack, not for each document.

Links: a shingle's list is dealt by the components that its members have so far.
Members outside the largest component are held against one member of it, then
against HEADS others a round, all lists at once and counted before verification,
again and again with other members while that finds enough links: a member that a
group's first few leave out mostly links to one of the next, and each one that is
still out costs the last join a pair for each of the group. What then remains, members outside the
largest component against all of other components, is joined where sizes, places
and signatures allow, counted and verified. Only signatures travel with a list,
not its sets. Pairs within one component are never made, so a group of near
copies costs rows in proportion to its size; no link between components is lost.
A list whose members have become one component is not looked at again.

Defined results: texts with fewer words than a shingle are one shingle; null,
empty or wordless texts have none, link to nothing and are their own component;
equal sets share a class, also rows that repeat an id; the least id of a
component that holds ids and nulls is the least id; an empty table gives no
rows; extra columns are ignored; very long texts are handled whole, one text
being the least unit of memory. Sets are named by two 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, drop, whole_row
from eventloom.llm.components import components
from eventloom.llm.hashing import STEPS, U64, mix, shingle_sets

SIZE, PERCENT = 5, 75
MAX_MATCH = 4
#: Cost model of l: rows' worth of a verification.
VERIFY = 50
#: Names that a task remembers, to send equal sets once; bounds memory only.
REMEMBER = 200_000
#: Bytes of text and sets of a pack, and shingles of a bucket.
PACK_BYTES, PACK_SETS, BUCKET = 1 << 20, 1 << 12, 1 << 20
#: Bits of a shingle that are counted; equal prefixes only make a shingle look more frequent.
BITS = 48
#: Bits of a set's signature: the parities of its shingles by hash. Two sets differ by as many shingles at least as their signatures do by bits.
SIGNATURE = 512
#: Another round of single members is worth it while the remaining pairs are more than RATIO rows for each row, and the last one after the first found a link for each PER_LINK rows of the lists.
RATIO, PER_LINK = 2, 5_000
#: Members of the largest component that a round after the first tries, and the most rounds; both bound work only.
HEADS, ROUNDS = 8, 16


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _name(s: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set as two signed numbers."""
    return tuple(int(mix(mix(s * k + k).sum(dtype=U64, keepdims=True) + U64(len(s))).view(np.int64)[0]) for k in STEPS[10:12])


def survey(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, mark (hash of the text), n, n1, n2 (name of the set) of every row, and its compressed text where the task has not sent that set yet."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sent: set[tuple[int, int]] = set()
        shut = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw, ns, names, packed = _texts(batch.column(2)), [], [], []
            for t, s in zip(raw, shingle_sets(raw, size), strict=True):
                name = _name(s)
                new = len(s) > 0 and name not in sent
                ns.append(len(s))
                names.append(name)
                packed.append(shut(t) if new else None)
                if new:
                    sent.add(name)
                    if len(sent) > REMEMBER:
                        sent.clear()
            cols = [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "n", "n1", "n2", "packed"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, n long, n1 long, n2 long, packed binary")


def packs_of(found: DataFrame) -> DataFrame:
    """pack, names (n1, n2), sizes ns and compressed texts of the classes, in packs of bounded size."""
    one = found.where("packed IS NOT NULL").groupBy("n1", "n2").agg(F.first("packed").alias("packed"), F.first("n").alias("n"))
    schema = pa.schema([("pack", pa.int64()), ("n1", pa.list_(pa.int64())), ("n2", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary()))])

    def run(batches):
        ids, held, bytes_ = count(TaskContext.get().partitionId() << 24), [[], [], [], []], 0

        def full():
            cols = [[next(ids)], *([c] for c in held)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c, v in zip(held, row, strict=True):
                    c.append(v)
                bytes_ += zstandard.frame_content_size(row[3])
                if bytes_ >= PACK_BYTES or len(held[0]) >= PACK_SETS:
                    yield full()
                    held, bytes_ = [[], [], [], []], 0
        if held[0]:
            yield full()

    return one.select("n1", "n2", "n", "packed").mapInArrow(run, "pack long, n1 array<long>, n2 array<long>, ns array<long>, texts array<binary>")


def _id(pack: Column, place: Column) -> Column:
    return F.shiftleft(pack, 16) + place


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    return list(shingle_sets([open_(t) for t in texts], size))


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct counted parts of a pack's shingles in order, and in how many of its sets each is."""
    return np.unique(np.concatenate([np.unique(s >> U64(64 - BITS)) for s in sets]), return_counts=True)


def _shut(tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted tokens and counts, by bytes of equal weight, compressed."""
    steps = np.diff(tokens, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes() + counts.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(BITS // 8 + 2, -1)
    steps, counts = np.zeros((planes.shape[1], 8), np.uint8), np.zeros((planes.shape[1], 2), np.uint8)
    steps[:, : BITS // 8], counts[:] = planes[: BITS // 8].T, planes[BITS // 8 :].T
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64), counts.view("<u2").ravel().astype(np.int64)


def grades(totals: np.ndarray) -> np.ndarray:
    """Numbers of classes as bytes on a scale of logarithms: 0 for one class, the same order otherwise."""
    return np.where(totals > 1, np.minimum(1 + np.floor(8 * np.log2(totals)), 255), 0).astype(np.uint8)


def counts_of(packs: DataFrame, bits: int, size: int = SIZE) -> DataFrame:
    """pack, bucket and the grades of the pack's shingles in that bucket, in order; 2**bits buckets part the hash range."""

    def send(batches):
        for batch in batches:
            for pack, texts in zip(batch.column(0), batch.column(1), strict=True):
                tokens, counts = _counted(_sets(texts.as_py(), size))
                owner = tokens >> U64(BITS - bits)
                edge = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
                buckets = owner[edge[:-1]].astype(np.int64)
                cols = [buckets, np.full(len(buckets), pack.as_py()), [_shut(tokens[a:b], counts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.binary())], names=["bucket", "pack", "blob"])

    def total(table: pa.Table) -> pa.Table:
        parts = [_open(b.as_py()) for b in table.column("blob")]
        tokens, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        # a bucket's totals stay far below 2**53, so sums of floats are exact
        marks = grades(np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(tokens)))[at]
        shut, ends = zstandard.ZstdCompressor(level=1).compress, np.cumsum([0, *(len(p[0]) for p in parts)])
        back = [shut(marks[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "marks": pa.array(back, pa.binary())})

    sent = packs.select("pack", "texts").mapInArrow(send, "bucket long, pack long, blob binary")
    return sent.groupBy("bucket").applyInArrow(total, "pack long, bucket long, marks binary")


def prefix(s: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The shingles on a set's prefix that are on other sets too, how many stand before them, and l, the cheapest of 1 to MAX_MATCH."""
    n = len(s)
    order = np.lexsort((s, marks))
    alone = int((marks == 0).sum())
    least = -(-PERCENT * n // 100)
    if alone > n - least:  # the shortest prefix meets nothing
        return s[:0], 0, 1
    others = np.cumsum(np.where(marks[order] > 0, 2.0 ** ((marks[order].astype(float) - 1) / 8) - 1, 0.0))
    # a row for each shingle sent, and verified pairs, which fall as the square of l
    costs = [n - least + m - alone + VERIFY * others[n - least + m - 1] / m**2 for m in range(1, min(MAX_MATCH, least) + 1)]
    best = 1 + int(np.argmin(costs))
    return s[order[alone : n - least + best]], alone, best


def _signature(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & U64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def ranked(packs: DataFrame, counts: DataFrame, size: int = SIZE) -> DataFrame:
    """id, nl (set size * 8 + l), skip, tokens, signature and compressed text of every class whose prefix meets another."""
    back = counts.groupBy("pack").agg(F.collect_list(F.struct("bucket", "marks")).alias("back"))
    both = packs.join(back, "pack").select("pack", "texts", "back")
    schema = pa.schema([("id", pa.int64()), ("nl", pa.int64()), ("skip", pa.int32()), ("tokens", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for pack, texts, back in zip(*(c for c in batch.columns), strict=True):
                pack, texts = pack.as_py(), texts.as_py()
                sets = _sets(texts, size)
                tokens = _counted(sets)[0]
                marks = np.frombuffer(b"".join(open_(x["marks"]) for x in sorted(back.as_py(), key=lambda x: x["bucket"])), np.uint8)
                rows = []
                for i, s in enumerate(sets):
                    p, skip, m = prefix(s, marks[np.searchsorted(tokens, s >> U64(64 - BITS))])
                    if len(p):
                        rows.append(((pack << 16) + i, len(s) * 8 + m, skip, p.view(np.int64), _signature(s), texts[i]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return both.mapInArrow(run, "id long, nl long, skip int, tokens array<long>, signature array<long>, packed binary")


def lists_of(rows: DataFrame) -> DataFrame:
    """token, id, nl and at (the token's place in the set's order) of the tokens on two prefixes or more."""
    every = rows.select("id", "nl", "skip", F.posexplode("tokens").alias("pos", "token")).select("token", "id", "nl", (F.col("skip") + F.col("pos")).alias("at"))
    shared = cut(every.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    return every.join(shared, "token")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _least(na: str | Column, nb: str | Column) -> Column:
    return F.least(_col(na).bitwiseAND(7), _col(nb).bitwiseAND(7))


def fits(na: str | Column, nb: str | Column, ata: str | Column, atb: str | Column) -> Column:
    """Whether sets of these sizes can be similar, and the token stands on the prefixes that the pair itself calls for."""
    a, b = F.shiftright(na, 3), F.shiftright(nb, 3)
    overlap = F.ceil((PERCENT * (a + b)) / F.lit(100 + PERCENT))
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & (_col(ata) < a - overlap + _least(na, nb)) & (_col(atb) < b - overlap + _least(na, nb))


def alike(na: str, nb: str, sa: str, sb: str) -> Column:
    """Whether sets of these sizes and signatures can be similar: 100 * overlap >= 75 * union leaves them (na + nb) / 7 shingles that only one has."""
    differ = sum((F.bit_count(F.col(sa)[i].bitwiseXOR(F.col(sb)[i])) for i in range(SIGNATURE // 64)), F.lit(0))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.shiftright(na, 3) + F.shiftright(nb, 3))


def enough(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (x, nx, y, ny: a row for each token that they share) with as many tokens as the smaller l."""
    found = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(_least("nx", "ny")).alias("least"))
    return found.where("c >= least").select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The similar ones of the pairs (a, b). Compressed texts travel, a quarter the size of their sets, which are made again where pairs meet."""
    mine = texts.select(F.col("id").alias("b"), F.col("packed").alias("mb"))
    theirs = texts.select(F.col("id").alias("a"), F.col("packed").alias("ma"))
    both = pairs.select("a", "b").join(mine, "b").join(theirs, "a").select("a", "b", "ma", "mb")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                packed = dict(zip(a, part.column(2), strict=True)) | dict(zip(b, part.column(3), strict=True))
                made = dict(zip(packed, _sets([x.as_py() for x in packed.values()], size), strict=True))
                keep = []
                for x, y in zip(a, b, strict=True):
                    p, q = made[x], made[y]
                    over = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    keep.append(100 * over >= percent * (len(p) + len(q) - over))
                yield part.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def dealt(lists: DataFrame, roots: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Of lists (token, id, nl, at, or with roots id, nl, places) those that hold several components: rows with root and the list's main root; some members of that for each list; how many rows and pairs they have."""
    if roots is None:
        rows = lists.select("token", "id", "nl", "at", F.col("id").alias("root"))
    else:  # roots meet sets, a row each, before these are spread over their tokens
        held = lists.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rows = cut(held.select("id", "nl", "root", F.explode("places").alias("x")).select("x.token", "id", "nl", "x.at", "root"))
    heads = F.array(*(F.min(F.struct(F.xxhash64("id", F.lit(turn), F.lit(i)).alias("h"), "id", "nl", "at")) for i in range(HEADS if turn else 1)))
    groups = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), heads.alias("heads"))
    mains = groups.groupBy("token").agg(F.max(F.struct("c", F.col("heads")[0]["h"].alias("h"), "root", "heads")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"))
    mains = cut(mains.where("kinds > 1").select("token", F.col("top.root").alias("main"), F.col("top.heads").alias("heads"), "size", (F.col("size") - F.col("top.c")).alias("strays")))
    size, pairs = mains.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("strays") * (F.col("size") - F.col("strays") / 2)), F.lit(0.0))).first()
    members = cut(rows.join(mains.select("token", "main"), "token"))
    if roots is not None:
        drop(rows)
    return members, mains, int(size), int(pairs)


def links(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Surveyed rows (doc_id, mark, n, id of the class, null without words), and the component root of every class that links to another (node, root)."""
    found = cut(survey(docs, size))
    packs = cut(packs_of(found))
    rows = cut(found.drop("packed"))
    drop(found)
    held = packs.select("pack", F.posexplode(F.arrays_zip("n1", "n2")).alias("i", "x")).select(F.col("x.n1").alias("n1"), F.col("x.n2").alias("n2"), _id(F.col("pack"), F.col("i")).alias("id"))
    classed = cut(rows.join(held, ["n1", "n2"], "left").drop("n1", "n2"))
    total = packs.agg(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    counts = cut(counts_of(packs, max(0, int(total // BUCKET).bit_length()), size))
    sets = cut(ranked(packs, counts, size))
    drop(rows, packs, counts)
    lists, texts = cut(lists_of(sets)), sets.select("id", "packed")
    linked, tried, roots, idle = None, None, None, False
    for turn in count():
        members, mains, n, pairs = dealt(lists, roots, turn)
        drop(lists)
        if pairs <= RATIO * n or idle or turn == ROUNDS:
            break
        stars = members.where("root <> main").join(mains.select("token", "heads"), "token")
        fitting = F.filter(F.array_distinct(F.transform("heads", lambda h: h.dropFields("h"))), lambda h: fits(h["nl"], "nl", h["at"], "at"))
        stars = stars.select(F.explode(fitting).alias("head"), F.col("id").alias("y"), F.col("nl").alias("ny"))
        new = enough(stars.select(F.col("head.id").alias("x"), F.col("head.nl").alias("nx"), "y", "ny"))
        new = cut(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        tried = new if tried is None else tried.unionByName(new)
        found_now = cut(verified(new, texts, size))
        linked = found_now if linked is None else linked.unionByName(found_now)
        drop(mains)
        links_now = found_now.count()
        idle = turn > 0 and links_now < max(1, n // PER_LINK)
        if links_now:
            roots = components(linked)
        # components only grow, so a list of one component stays so: the next round has to look at these lists alone
        lists = members
        if roots is not None:
            lists = cut(members.groupBy("id", "nl").agg(F.collect_list(F.struct("token", "at")).alias("places")))
            drop(members)
    drop(mains)
    rest = members.withColumn("main", F.col("root") == F.col("main"))
    # signatures keep unlike pairs out of the join; the others cost a row for each token that they share, as in the rounds
    held = cut(sets.join(rest.select("id").distinct(), "id").select("id", "signature"))
    rest = rest.join(held, "id")
    x, y = (rest.select("token", *(F.col(c).alias(c + s) for c in ("id", "nl", "at", "root", "main", "signature"))) for s in "xy")
    apart = (F.col("rootx") != F.col("rooty")) & (F.col("mainy") | (F.col("idx") < F.col("idy")))
    both = x.where("NOT mainx").join(y, "token").where(apart & fits("nlx", "nly", "atx", "aty") & alike("nlx", "nly", "signaturex", "signaturey"))
    left = enough(both.select(F.col("idx").alias("x"), F.col("nlx").alias("nx"), F.col("idy").alias("y"), F.col("nly").alias("ny")))
    left = cut(left if tried is None else left.join(tried, ["a", "b"], "left_anti"))
    last = cut(verified(left, texts, size))
    drop(held, left, sets, members)
    return classed, components(last if linked is None else linked.unionByName(last))


def _grouped(docs: DataFrame, size: int) -> DataFrame:
    """Surveyed rows (doc_id, mark, n) with the root of their component, null where they have no words."""
    rows, roots = links(docs, size)
    return rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).select("doc_id", "mark", "n", "root")


def join(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = cut(_grouped(docs, size))
    least = cut(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component")))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, columns as they were; documents without words stay.

    The row with the least doc_id stays, a null one only where all are null; of
    several with that doc_id the one with the least hash of its text, and of rows
    that repeat that text the one with the least hash of the whole row.
    """
    rows = cut(_grouped(docs.select("doc_id", "text"), SIZE).where("root IS NOT NULL"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = rows.groupBy("root").agg(F.min(key).alias("least"))
    keys = rows.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies")).join(least, "root")
    keys = keys.withColumn("first", key.eqNullSafe(F.col("least"))).where("NOT first OR copies > 1").select("doc_id", "mark", "first")
    held = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("at"), whole_row(docs).alias("row"))
    met = held.join(keys, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("mark")), "left")
    # rows that repeat a doc_id and its text: few columns of few documents, met in partial sums
    again = met.where("first").groupBy("key", "at").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return met.where("first IS NULL").select("row.*").unionByName(again.select("row.*"))
