import random

from eventloom.llm import html

SCHEMA = "page_id long, url string, html string, text string"


def lines(page):
    return html.page_lines(page)[0]


def test_markup():
    assert lines("<nav>Menu</nav><article><h1>T &amp; U</h1><p><b>a\n  b<br><p>c&copy d</article><footer>f</footer>") == ["T & U", "a b", "c© d"]
    assert lines('<script>var t="</p><article>x</article>";</script><style>p{}</style><article><p>x</p><!-- <p>no</p> --></article>') == ["x"]
    assert lines('<article><p>x<div class="ad">buy</div><p>y<section id="comments"><p>me too</p></section><form>f</form></article>') == ["x", "y"]
    assert lines('<header>site</header><main><header><h1>Head</h1></header><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></main><aside>s</aside>') == ["Head", "one", "two", "1", "2"]
    assert lines('<body class="has sidebar"><div class="content"><p>text</p></div><div class="cookie-notice">c</div></body>') == ["text"]
    assert lines("no markup &lt;b&gt;") == ["no markup <b>"] and lines(None) == lines("") == lines("<p>  </p>") == []
    assert lines('<article><p title="a>b">x</p><p hidden>h</p></article>') == ["x"]
    assert lines("<p>a < b and <3 c</p>") == ["a < b and <3 c"] and lines("<article><p>cut <b") == ["cut <b"]


def test_long_page_is_linear():
    n = 20_000
    assert len(lines("<article>" + "<p>a<b>" * n + "</article>")) == n
    assert len(lines("<article>" + "<div>" * 3000 + "x" + "<" * 5000)) == 1


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got, rest = html.common(a, b), iter(b)
        assert len(got) == best[-1][-1] and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_nearest_page_takes_shared_lines(spark):
    page = lambda *own: "<div>Site name</div><div>Hot news</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>All rights</div>"
    rows = [
        (1, "http://h.example.com/a/1", page("first", "text")), (2, "http://h.example.com/a/2", page("second")), (3, "http://h.example.com/b/9", page("ninth")),
        (4, "http://other.example.com/a/1", page("first", "text")), (5, "http://h.example.com/a/2", page("second")), (6, None, page("no url")),
        (7, "http://c.example.com/1", page("same")), (8, "http://c.example.com/2", page("same")), (9, "http://h.example.com/a/3", "<article><p>Site name</p><p>kept</p></article>"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.page_id: r.text.split("\n") for r in html.main_text(df).collect()}
    whole = lambda *own: ["Site name", "Hot news", *own, "All rights"]
    assert got[1] == ["first", "text"] and got[2] == got[5] == ["second"]
    assert got[4] == whole("first", "text") and got[6] == whole("no url") and got[7] == got[8] == whole("same") and got[9] == ["Site name", "kept"]


def test_pages(spark, small):
    got = html.main_text(spark.read.parquet(f"{small}/pages.parquet")).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) and "<" not in r.text for r in got)


def test_many_ranges(spark, monkeypatch):
    body = "<div>shared by all</div>"
    rows = [(i, f"http://h.example.com/{i:04d}", body + f"<div>own {i}</div>", "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {r.text for r in html.main_text(df).collect()} == {f"own {i}" for i in range(300)}


def test_copies_under_other_urls_are_no_neighbours(spark):
    page = lambda own: f"<div>Site name</div><div>{own}</div><div>All rights</div>"
    urls = ["a", "a?utm=1", "a?utm=2", "a/print", "m", "m?utm=1", "m?utm=2"]
    rows = [(i, f"http://h.example.com/{u}", page(u[0]), "x") for i, u in enumerate(urls)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: u[0] for i, u in enumerate(urls)}


def test_other_side_is_tried(spark):
    page = lambda *own: "<div>Site name</div>" + "".join(f"<div>{x}</div>" for x in own)
    rows = [(1, "http://h.example.com/a/1", page("text"), "x"), (2, "http://h.example.com/a/2", page("text", "printed"), "x"), (0, "http://h.example.com/A", page("else"), "x")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "text"


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_equals_a_plain_version(spark):
    rng, rows = random.Random(4), []
    for i in range(160):
        host, path = rng.choice(["h", "h", "h", "g", "f"]), "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) + f"/{i}"
        parts = ["site"] * rng.randint(0, 2) + [f"menu {rng.randint(0, 5)}" for _ in range(rng.randint(0, 6))] + [f"own {rng.randint(0, 40)}" for _ in range(rng.randint(0, 3))] + ["end"]
        body = "".join(f"<div>{x}</div>" for x in parts)
        rows.append((i, f"http://{host}.example.com/{path}", f"<article>{body}</article>" if rng.random() < 0.2 else body, "x"))
    rows += rows[:5] + [(500, "http://h.example.com/a", None, "x")]
    classes = {}
    for _, url, page, _ in rows:
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        key = (host, tuple(html.page_lines(page)[2]))
        classes[key] = min(classes.get(key, (path, url)), (path, url))
    want = []
    for i, url, page, _ in rows:
        own, marked, every = html.page_lines(page)
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
        n = len(own)
        if own and not marked:
            order = sorted((*classes[k], k) for k in classes if k[0] == host)
            at = [x[2] for x in order].index((host, tuple(every)))
            near = lambda j: next((k for k, (p, q) in enumerate(zip(path.split("/"), order[j][0].split("/"))) if p != q), min(path.count("/"), order[j][0].count("/")) + 1)
            for j in sorted((j for j in (at - 1, at + 1) if 0 <= j < len(order)), key=lambda j: (-near(j), j)):
                shared = longest(own, order[j][2][1])
                if shared < len(own):
                    n -= shared
                    break
        want.append((i, n))
    got = [(r.page_id, len(r.text.split("\n")) if r.text else 0) for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


def test_long_pages_of_repeated_lines_align():
    a, b = ["x", "y"] * 20_000, ["y", "x", "z"] * 15_000
    got = html.common(a, b)
    assert got == sorted(set(got)) and len(got) >= 30_000


def test_marked_pages_are_aligned_too(spark):
    page = lambda *own: "<article><h1>Same title</h1>" + "".join(f"<p>{x}</p>" for x in own) + '<div class="qx7"><p>Get the app</p><ul><li>Now</ul></div><p>Same end</p></article>'
    whole = '<article><div class="entry"><p>Shared start</p><p>own {}</p></div></article>'
    rows = [
        (1, "http://h.example.com/a/1", page("first"), "x"), (2, "http://h.example.com/a/2", page("second", "third"), "x"), (3, "http://g.example.com/1", page("alone"), "x"),
        (4, "http://f.example.com/1", whole.format(4), "x"), (5, "http://f.example.com/2", whole.format(5), "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.needs for r in html.parsed_of(df).collect()] == [True] * 5
    got = {r.page_id: r.text.split("\n") for r in html.main_text(df).collect()}
    assert got[1] == ["Same title", "first", "Same end"] and got[2] == ["Same title", "second", "third", "Same end"]
    assert got[3] == ["Same title", "alone", "Get the app", "Now", "Same end"] and got[4] == ["Shared start", "own 4"] and got[5] == ["Shared start", "own 5"]


def test_empty_and_unknown(spark):
    assert html.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
