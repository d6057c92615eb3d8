"""Main text of web pages by markup and nearest-URL page differencing.

A page becomes lines, one for each block. Blocks inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments go by
their markup. Every page's remaining lines are held against the page nearest to
it by URL path on the same host: both pages' lines are aligned by longest common
subsequence, and shared lines, being the site's and not the page's, go. Where a
page marks its article (or main part), the lines in it are its text, and a check
follows: shared lines go only with a named part of the article (a div, section,
list or table with a class, id or role that the list of names does not know) whose
lines are all shared; other article lines stay, since articles share sentences.

Copies under other URLs of a host are one class, by the list of their lines, and
the class stands at its first URL, so that a neighbour is a different page.
Neighbours come from one global sort by (host, path) and ordinals, joined on
ordinal + 1: a host with a third of all pages is spread like any other. Only
line hashes take part; pages without lines join nothing.

Defined results: null html gives the empty text; null urls have no neighbour; a
neighbour that shares all of a page's lines takes nothing away, and the one on the
other side is tried;
repeated rows give repeated rows, each named by a number of its own; ties between
neighbours go to the earlier page; an empty table gives no rows; extra columns
are ignored; a very long page is parsed whole.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut
from eventloom.llm.hashing import U64, Sums
from eventloom.llm.urls import host_of, path_of

#: Elements without content, with raw content, that hold no article text, and that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
APART = frozenset("head nav footer aside form button select option menu dialog fieldset datalist object audio video canvas map".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Words in class, id or role that name what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|sidebar|side|nav\w*|menu|breadcrumbs?|pagination|pager|footer|masthead|toolbar|topbar|widget|related|recommend\w*|share|sharing|social|comments?|respond|replies|newsletter|subscribe|signup|login|search|contentinfo|complementary|skip-link)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")
CLOSES_P = BLOCKS - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "html", "body"}

#: Elements that part an article, where they bear a name.
PARTS = frozenset("div section ul ol dl table details".split())


#: The same for an element that is itself an article: only what is another's words.
OTHERS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|comments?|respond|replies)(?:$|[\s_-])", re.I)


def _named_apart(element: str, attributes: str, inside: bool) -> bool:
    if element in ("html", "body", "main") or not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and ((OTHERS if element == "article" else NAMES).search(value) or not inside and re.search(r"(?:^|[\s_-])header(?:$|[\s_-])", value, re.I)):
            return True
    return False


def _named(attributes: str) -> bool:
    return "=" in attributes and any(x[0].lower() in ("class", "id", "role") and any(x[1:]) for x in ATTRIBUTE.findall(attributes))


def page_lines(html: str | None) -> tuple[list[str], bool, list[str]]:
    """Lines of the article, whether the page marked one, and every line of the page, site parts included."""
    return page_parts(html)[:3]


def page_parts(html: str | None) -> tuple[list[str], bool, list[str], list[int]]:
    """The same, and the number of the innermost named part of the marked article that each of its lines is in, 0 for none."""
    if not html:
        return [], False, [], []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, apart, inside a marked article, its part
    held: list[str] = []
    own: list[tuple[bool, int, str]] = []
    every: list[str] = []
    marked = False
    apart = inside = False
    part = parts = 0

    def flush() -> None:
        if held:
            line = SPACES.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if line:
                every.append(line)
                if not apart:
                    own.append((inside, part, line))

    at, n = 0, len(html)
    search = TAG.search
    while at < n:
        m = search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name, close = m[1], m[3]
        if name:
            name = name.lower()
            if name in BLOCKS:
                flush()
                if name in CLOSES_P and any(x[0] == "p" for x in stack[-8:]):
                    while stack[-1][0] != "p":
                        if stack[-1][0] in BLOCKS:
                            break
                        stack.pop()
                    if stack[-1][0] == "p":
                        stack.pop()
                elif name == stack[-1][0] and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    stack.pop()
                apart, inside, part = stack[-1][1:]
            elif name == "br":
                held.append(" ")
            if name in VOID:
                continue
            if name in RAW:
                if not m[2].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = end.end() if end else n
                continue
            goes = apart or name in APART or name == "header" and not inside or _named_apart(name, m[2], inside)
            main = inside or not goes and (name in ("article", "main") or 'role="main"' in m[2])
            if main and not inside:
                flush()
                marked = True
            if goes != apart and name not in BLOCKS:
                flush()
            if inside and name in PARTS and _named(m[2]):
                parts += 1
                part = parts
            stack.append((name, goes, main, part))
            apart, inside = goes, main
        elif close:
            close = close.lower()
            if any(x[0] == close for x in stack):
                if close in BLOCKS or stack[-1][1:] != stack[-2][1:]:
                    flush()
                while stack.pop()[0] != close:
                    pass
                apart, inside, part = stack[-1][1:]
            elif close in BLOCKS:
                flush()
    flush()
    kept = [x for x in own if x[0] or not marked]
    return [x[2] for x in kept], marked, every, [x[1] for x in kept]


#: Places of a line from which its mask is kept rather than made again.
OFTEN = 64


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of a and b.

    Rows of the table of lengths are bits of one number, 1 where the length does
    not grow; every root-th row is kept and those between are made again on the
    way back, so lines that repeat cost no more than others: len(a) * len(b) / 64
    steps in all.
    """
    both = set(a) & set(b)
    left, right = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    where: dict = {}
    for j, x in enumerate(right):
        where.setdefault(x, []).append(j)
    often: dict[object, int] = {}

    def mask(x) -> int:
        if x in often:
            return often[x]
        bits = 0
        for j in where[x]:
            bits |= 1 << j
        if len(where[x]) >= OFTEN:
            often[x] = bits
        return bits

    every = (1 << len(right)) - 1

    def rows(v: int, at: int, upto: int) -> list[int]:
        out = [v]
        for i in range(at, upto):
            u = v & mask(a[left[i]])
            v = ((v + u) | (v - u)) & every
            out.append(v)
        return out

    step = max(1, int(len(left) ** 0.5))
    kept, v = [], every
    for at in range(0, len(left), step):
        kept.append(v)
        v = rows(v, at, min(at + step, len(left)))[-1]
    found, col = [], len(right)
    for k in range(len(kept) - 1, -1, -1):
        part = rows(kept[k], k * step, min((k + 1) * step, len(left)))
        i = len(part) - 1
        while i and col:
            if part[i] >> (col - 1) & 1:  # the length does not grow here
                col -= 1
            elif part[i - 1] >> (col - 1) & 1:
                found.append(left[k * step + i - 1])
                i, col = i - 1, col - 1
            else:
                i -= 1
    return found[::-1]


def _hashes(lines: list[str]) -> np.ndarray:
    raw = [line.encode() for line in lines]
    ends = np.cumsum([0, *map(len, raw)])
    return Sums(np.frombuffer(b"".join(raw), np.uint8)).ranges(ends[:-1], ends[1:]) + np.diff(ends).astype(U64)


def parsed_of(pages: DataFrame) -> DataFrame:
    """row (a number), page_id, url, host, path, whether the page needs a neighbour, hashes of its own and of all its lines, the parts of its own lines where it marks an article, and its own lines, compressed."""
    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["row", "page_id", "url", "host", "path", "needs", "own", "lines", "parts", "text"]

    def run(batches):
        shut, n = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 40
        for batch in batches:
            own, every, needs, parts, texts = [], [], [], [], []
            for html in batch.column(4):
                lines, marked, whole, part = page_parts(html.as_py())
                needs.append(bool(lines))
                own.append(_hashes(lines).tobytes() if lines else b"")
                parts.append(np.array(part, np.int32).tobytes() if marked else None)
                every.append(_hashes(whole).tobytes() if whole else b"")
                texts.append(shut("\n".join(lines).encode("utf-8", "replace")))
            rows = pa.array(np.arange(n, n + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *(batch.column(i) for i in range(4)), pa.array(needs), *(pa.array(c, pa.binary()) for c in (own, every, parts, texts))], names=names)

    keyed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    return keyed.mapInArrow(run, f"row long, page_id {kind}, url string, host string, path string, needs boolean, own binary, lines binary, parts binary, text binary")


def neighbours(parsed: DataFrame) -> DataFrame:
    """row, own lines' hashes and parts, and the lists of the hashes of the neighbours' lines, nearest first, for pages that need a neighbour."""
    parsed = parsed.where("url IS NOT NULL").select("row", "host", "path", "url", "needs", "own", "parts", "lines")
    # one page stands for all of a host that have its lines, so that a page's neighbour is another page
    parsed = parsed.withColumn("kind", F.sha2("lines", 256))
    one = parsed.groupBy("host", "kind").agg(F.min(F.struct("path", "url")).alias("u"), F.first("lines").alias("lines")).select("host", "u.path", "u.url", "kind", "lines")
    ordered = one.sort("host", "path", "url", "kind")

    def number(batches):
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part, np.int32)), pa.array(np.arange(i, i + m))], names=[*batch.schema.names, "part", "i"])
            i += m

    placed = cut(ordered.mapInArrow(number, "host string, path string, url string, kind string, lines binary, part int, i long"))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    if not sizes:
        return parsed.select("row", "own", "parts", F.array("lines").alias("lines"))
    starts, total = [], 0
    for part in range(max(sizes) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    place = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part")) + F.col("i")
    placed = placed.withColumn("at", place)
    asks = parsed.where("needs").select("row", "host", "path", "kind", "own", "parts").join(placed.select("host", "kind", "at"), ["host", "kind"])
    other = placed.select(F.col("host").alias("h"), F.col("path").alias("p"), "lines", F.col("at").alias("to"))
    sides = asks.withColumn("to", F.explode(F.array(F.col("at") - 1, F.col("at") + 1))).join(other, "to").where("host = h")
    # nearest: the longer common start of the path, the earlier page on ties
    shared = F.expr("aggregate(sequence(1, least(size(split(path, '/')), size(split(p, '/')))), 0, (n, k) -> CASE WHEN n = k - 1 AND split(path, '/')[k - 1] = split(p, '/')[k - 1] THEN k ELSE n END)")
    # two sides at most: the most and the least near are both of them
    both = F.array(F.max_by("lines", "near"), F.min_by("lines", "near"))
    best = sides.withColumn("near", F.struct(shared.alias("n"), (-F.col("to")).alias("o"))).groupBy("row").agg(both.alias("lines"), F.first("own").alias("own"), F.first("parts").alias("parts"))
    return best.select("row", "own", "parts", "lines")


def leaving(shared: list[int], parts: list[int]) -> list[int]:
    """The places among ``shared`` that go from a marked article: those of its named parts whose lines are all shared."""
    held = set(shared)
    stay = {0, *(p for i, p in enumerate(parts) if i not in held)}
    return [i for i in shared if parts[i] not in stay]


def shared_lines(parsed: DataFrame) -> DataFrame:
    """row and the places of its lines that go: of those that the nearest neighbour shares which does not share them all."""

    def run(batches):
        for batch in batches:
            rows, places = [], []
            for row, own, parts, lines in zip(*batch.columns, strict=True):
                a = np.frombuffer(own.as_py(), U64).tolist()
                for other in lines.as_py():
                    got = common(a, np.frombuffer(other, U64).tolist())
                    if len(got) < len(a):
                        if parts.is_valid:
                            got = leaving(got, np.frombuffer(parts.as_py(), np.int32).tolist())
                        if got:
                            rows.append(row.as_py())
                            places.append(got)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["row", "gone"])

    return neighbours(parsed).mapInArrow(run, "row long, gone array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; pages are parsed once."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = cut(parsed_of(pages))
    gone = cut(shared_lines(parsed))
    rows = parsed.select("row", "page_id", "url", "text")
    joined = rows.join(gone, "row", "left")  # pages that lose no line have no row in gone

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for shut, drop in zip(batch.column(2), batch.column(3), strict=True):
                text = open_(shut.as_py()).decode()
                if drop.is_valid:
                    out = set(drop.as_py())
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "text", "gone").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
