"""WARC archives, main text and fingerprints."""

from __future__ import annotations

import base64
import math
import random
import time
from collections import Counter
from hashlib import sha1, sha256

import pytest
from pyspark.sql import functions as F

from huntframe.llm import fingerprints, html_extract, queries, warc
from huntframe.sources.store import translated
from tests import oracle
from tests.test_windows import final_plan, splitting

PAGES = "page_id long, url string, html string, key string, size int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], PAGES).repartition(3)


PAGE_ROWS = [
    (1, "http://www.Example.com:80/a?b#c", "<p>one</p>"), (2, "https://example.com/a?b", "<p>one</p>"), (3, "http://x.org/", "two ü"), (4, None, None), (5, "http://x.org/", ""),
    (6, "http://x.org/\r\nbad", "a\r\n\r\nb"), (7, "http://u@h.net:8080/x", "x" * 300_000), (9, "http://x.org/", "<p>one</p>"),
]


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.round_trip(spark, pages(spark, PAGE_ROWS)).collect()}
    assert set(got) == {i for i, _, _ in PAGE_ROWS}
    payloads = {i: (h or "").encode() for i, _, h in PAGE_ROWS}
    for i, p in payloads.items():
        winner = max(j for j, q in payloads.items() if q == p)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(p), base64.b32encode(sha1(p).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == winner else ("revisit", winner))


def test_archives_may_lie_where_spark_names_them(monkeypatch):
    asked = []
    monkeypatch.setattr(warc, "file_system", lambda uri: asked.append(translated(uri)))
    for name in ("s3a://bucket/shared/x.warc.gz", "dbfs:/shared/x", "file:///tmp/x", "abfss://c@a.dfs.example/x"):
        warc._open(name)
    assert asked == ["s3://bucket/shared/x.warc.gz", "/dbfs/shared/x", "file:///tmp/x", "abfss://c@a.dfs.example/x"]


def test_small_payloads_are_all_responses(spark):
    rows = warc.with_record_types(pages(spark, PAGE_ROWS), min_bytes=10).collect()
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {1, 2}


def test_lookup_reads_blocks_of_the_key(spark):
    rnd = random.Random(3)
    rows = [(i, f"http://h{rnd.randrange(40)}.example.com/p{rnd.randrange(30)}", f"body {i}") for i in range(900)]
    archive = warc.write_archives(pages(spark, rows), file_bytes=3000)
    assert archive.captures.select("file").distinct().count() > 3
    index = warc.build_index(archive, block_lines=7)
    keys = pages(spark, rows).select(warc.url_key(F.col("url")).alias("key"), "page_id")
    wanted = keys.where("page_id % 50 = 0").select("key").distinct().withColumn("page_id", F.lit(None).cast("long"))
    found = warc.lookup(index, wanted.union(spark.createDataFrame([("com,none)/", None)], "key string, page_id long")))
    want = keys.join(wanted.select("key"), "key")
    assert sorted(r.page_id for r in found.collect()) == sorted(r.page_id for r in want.collect())
    bodies = {r.page_id: r.html for r in warc.read_records(archive, found).collect()}
    assert all(bodies[i] == f"body {i}" for i in bodies) and len(bodies) == want.count()


def test_url_keys(spark):
    urls = ["http://www.Example.com:80/A?b#c", "https://example.com/a?b", None, "ftp://u:p@h.net:8080/x", "no url"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()
    assert [r[0] for r in got] == ["com,example)/a?b", "com,example)/a?b", ")", "net,h:8080)/x", ")no url"]


def test_a_payload_of_many_pages_is_split(spark):
    own = splitting(spark)
    rows = own.range(6000).selectExpr("id AS page_id", "'http://x.org/' AS url", "CASE WHEN id % 3 < 2 THEN repeat('hot ', 40) ELSE concat('page ', id) END AS html")
    typed = warc.with_record_types(rows.repartition(6))
    assert sum(r.record_type == "revisit" for r in typed.collect()) == 3999
    assert "skew=true" in final_plan(typed)


def test_warc_sql_and_empty(spark, sf):
    oracle.check(spark, oracle.connect(sf), "op2", queries.op2_warc, queries.OP2_SQL, sf)
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b><br>line&nbsp;x
 next<p>Second &#x41;&eacute;<ul><li>one<li>two</ul><div class="share-buttons">Share</div><table><tr><td>c1<td>c2</table>
<form><p>Mail</p></form><pre>a
  b</pre></article><aside>Side</aside><section id="comments"><p>First!</p></section><footer>Foot</footer></body></html>"""


def with_hosts(pages):
    return pages.withColumn("host", html_extract.host_of(F.col("url")))


def text_of(html):
    return html_extract.main_text(html_extract.parsed(html), {})


def test_article():
    assert text_of(ARTICLE).split("\n") == ["Title & more", "First bold line x next", "Second Aé", "one", "two", "c1", "c2", "a b"]


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>open", "open"), ("<p>a</div>b", "ab"), ("<div><div>a</div>b</div>", "a\nb"), ("a < b <p>c", "a < b\nc"),
        ("<script>x", ""), ("<p title='>'>t</p>", "t"), ("<div hidden>x</div>y", "y"), ("<!-- x", ""), ("&lt;p&gt; &bogus; &#0;", None), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_odd_markup(html, text):
    got = text_of(html)
    assert text is None or got == text


def test_style_tree_drops_what_all_pages_of_a_site_share(spark):
    rnd = random.Random(5)
    body = lambda: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(40))
    rows = [(i, f"http://site.org/{i}", f"<body><div class='top'>Welcome to the site</div><div class='main'><p>{body()}</p><p>Shared passage of many articles.</p></div><div class='bottom'>Made by us</div></body>") for i in range(20)]
    rows += [(100, "http://few.org/1", "<div class='top'>Only page</div>"), (101, None, None), (102, "http://site.org/x", "")]
    got = {r.page_id: r for r in html_extract.extract(pages(spark, rows)).collect()}
    assert len(got) == 23
    for i in range(20):
        lines = got[i].text.split("\n")
        assert len(lines) == 2 and lines[1] == "Shared passage of many articles." and got[i].n_chars == len(got[i].text)
    assert got[100].text == "Only page" and got[101].text == got[102].text == ""
    importance = html_extract.branch_importance(with_hosts(pages(spark, rows)))
    assert importance.where("importance < 0 OR importance > 1.0000001").count() == 0
    assert html_extract.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        "<article class='post comments-open'><p>x</p></article>", "<main class='site-main no-sidebar'><p>x</p></main>", "<div class='content has-sidebar'><p>x</p></div>", "<h2 id='related-work'>x</h2>",
        "<article><section id='social-impact'><p>x</p></section></article>", "<article><h2 id='search-algorithms'>x</h2></article>", "<article><h2 id='comments'>x</h2></article>", "<h3 id=search>x</h3>",
        "<article><section id='related'>x</section></article>", "<article><div class='section' id='search'>x</div></article>", "<main id='search' role='main'>x</main>", "<article><p class='share'>x</p></article>",
        "<article><ul class='nav'><li class='menu-item'>x</ul></article>", "<div class='elementor-widget-text'>x</div>", "<div class='" + "nav-" * 3000 + "x'>x</div>",
    ],
)
def test_names_that_an_article_may_have(html):
    assert text_of(html) == "x"


@pytest.mark.parametrize("name", ["sidebar", "post comments-area", "share-buttons", "Social_Links", "main-nav", "site-header", "ad-slot", "cookie-notice", "related-posts", "nav__list", "log-in-form", "skip-link"])
def test_names_that_are_not_the_article(name):
    assert text_of(f"<div class='{name}'>n</div><p>x</p>") == text_of(f"<article><div id='{name}'>n</div><p>x</p></article>") == "x"


def words(rnd, n=12):
    return " ".join(f"w{rnd.randrange(10_000)}" for _ in range(n))


def test_a_plain_wrapper_stays_with_its_article(spark):
    rnd = random.Random(6)
    menu = "<nav><ul>" + "".join(f"<li>Entry {i}" for i in range(30)) + "</ul></nav>"
    notes = "<div>" + "".join(f"<div>Shared {i}</div>" for i in range(30)) + "</div>"
    texts = [[words(rnd) for _ in range(5)] for _ in range(24)]
    body = ["".join(f"<p>{p}</p>" for p in t) for t in texts]
    rows = [(i, f"http://a.org/{i}", f"<body><div id='wrapper'>{menu}<article>{body[i]}</article></div>") for i in range(12)]
    # Shared boxes that no name gives away outweigh the paragraphs beside them.
    rows += [(i, f"http://b.org/{i}", f"<body><div class='all'>{notes}<div class='t'>{body[i]}</div></div>") for i in range(12, 24)]
    rows += [(i, f"http://c.org/{i}", "<body><div class='all'><main><p>The same on all pages.</p></main></div>") for i in range(24, 36)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[i].split("\n") == texts[i] for i in range(24))
    assert all(got[i] == "The same on all pages." for i in range(24, 36))


def test_texts_count_for_all_levels_above(spark):
    rnd = random.Random(7)
    texts = [words(rnd) for _ in range(20)]
    rows = [(i, f"http://deep.org/{i}", f"<body><div class='top'>Welcome</div>{'<div>' * 20}{t}{'</div>' * 20}") for i, t in enumerate(texts)]
    found = html_extract.branch_importance(with_hosts(pages(spark, rows))).where("pages = 20").select("importance").collect()
    assert len(found) == 23 and sum(r[0] == 0 for r in found) == 1
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == dict(enumerate(texts))


def test_importance_is_the_faded_mean_of_all_below(spark):
    # Per level one text: of 4 pages each has its own (1) or all have the same (0).
    shared = [i % 3 == 0 for i in range(13)]
    rows = [(i, f"http://x.org/{i}", "".join(f"<div>{'all' if same else i} {k}" for k, same in enumerate(shared))) for i in range(4)]
    got = sorted(r.importance for r in html_extract.branch_importance(with_hosts(pages(spark, rows))).collect())
    own = [(0.0, 0.2), *[(0.0 if same else 1.0, 4.0) for same in shared]]
    faded = [[w * 0.9**d for d, (_, w) in enumerate(own[at:])] for at in range(len(own))]
    want = sorted(sum(n * f for (n, _), f in zip(own[at:], fs, strict=True)) / sum(fs) for at, fs in enumerate(faded))
    assert got == pytest.approx(want)


def planted_site(rnd, k):
    """A site without telling names: pages with their article's blocks, and what all its pages share.  Markup is the site's own."""
    name = lambda: rnd.choice("bcdfg") + rnd.choice("aeiou") + rnd.choice("klmnp") + str(k)
    top, bottom, body, box = (name() for _ in range(4))
    menu = "".join(f"<li><a href='/{i}'>{words(rnd, 2)}</a>" for i in range(rnd.randint(3, 9)))
    notice, imprint, kind = words(rnd, 8), words(rnd, 6), rnd.choice(["div", "section"])
    out = []
    for i in range(rnd.randint(8, 16)):
        blocks_ = [words(rnd, rnd.randint(5, 40)) for _ in range(rnd.randint(2, 7))]
        article = f"<h1>{blocks_[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks_[1:])
        html = f"<html><body><div class={top}><ul>{menu}</ul></div><{kind} class={box}>{notice}</{kind}><div class={body}>{article}</div><div class='{bottom}'><p>{imprint}</p></div></body></html>"
        out.append((1000 * k + i, f"https://www.site{k}.org/{i}", html, blocks_))
    return out


def test_sites_without_names(spark):
    """The tree finds the planted text of every page; without it every page differs."""
    rnd = random.Random(11)
    rows = [r for k in range(6) for r in planted_site(rnd, k)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, [r[:3] for r in rows])).collect()}
    assert got == {i: "\n".join(want) for i, _, _, want in rows}
    assert all(text_of(html) != got[i] for i, _, html, _ in rows)


def test_repeated_rows_are_one_page_of_the_tree(spark):
    """A motto that 12 pages share goes, however often one of them is repeated, with whatever ids."""
    rnd = random.Random(5)
    rows = [(i, f"http://a.org/{i}", f"<body><div class=x>A motto for all of us</div><div class=y><p>{words(rnd, 20)}</p></div></body>") for i in range(12)]
    want = {html: text_of(html).split("\n")[1] for _, _, html in rows}
    for ids in ([0] * 40, [None] * 40, range(100, 140)):
        got = html_extract.extract(pages(spark, rows + [(i, *rows[0][1:]) for i in ids])).collect()
        assert len(got) == 52 and sorted(r.text for r in got) == sorted([*want.values(), *[want[rows[0][2]]] * 40])
    got = html_extract.extract(pages(spark, [(None, *r[1:]) for r in rows])).collect()
    assert sorted(r.text for r in got) == sorted(want.values())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class=story><p>The real text</p></div><article class=teaser>Other story</article>", "The real text\nOther story"),
        ("<main><h1>Title</h1></main><div><p>Body</p></div>", "Title\nBody"),
        ("<article><p>A long text of the article</p></article><div>Beside it</div>", "A long text of the article"),
        ("<article><p>Text of the article</p><div class='user-comment'>x</div><div class=reader-remarks>y</div><div class=notice>z</div><div class=advertisement-x>w</div></article>", "Text of the article"),
        ("<article><h1>Only a title</h1></article><div></div>", "Only a title"),
    ],
)
def test_an_article_weighs_what_it_holds(html, text):
    assert text_of(html) == text


def test_articles_that_are_teasers(spark):
    """The site's tree outweighs the element's name where it holds little of the text."""
    rnd = random.Random(6)
    teasers = "".join(f"<article class=teaser><p>{words(rnd, 3)}</p></article>" for _ in range(3))
    rows = [(i, f"http://t.org/{i}", f"<body><div class=story><p>{words(rnd, 40)}</p><p>{words(rnd, 30)}</p></div>{teasers}</body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: "\n".join(text_of(html).split("\n")[:2]) for i, _, html in rows}


def by_definition(site):
    """Text of each page of one site: importance, evidence and choice written out as recursions over all pages."""
    trees = [html_extract.parsed(h) for h in sorted(set(site))]
    seen: dict[int, list] = {}  # per path: pages, child sequences, texts, child paths

    def walk(n, page):
        kids = [p for p in n.parts if not isinstance(p, str) and not p.cut]
        entry = seen.setdefault(n.path, [set(), {}, {}, set()])
        entry[0].add(page)
        row = tuple(p.path for i, p in enumerate(kids) if i == 0 or p.path != kids[i - 1].path)
        entry[1].setdefault(row, set()).add(page)
        entry[3].update(p.path for p in kids)
        for owner, text in html_extract.blocks(n):
            if owner is n:
                entry[2].setdefault(text, set()).add(page)
        for p in kids:
            walk(p, page)

    for i, t in enumerate(trees):
        walk(t, i)
    entropy = lambda sizes, m: sum(k * math.log(k) for k in sizes) / sum(sizes) / math.log(m)

    def own(path):
        m, styles, texts = (len(x) if i == 0 else [len(p) for p in x.values()] for i, x in enumerate(seen[path][:3]))
        if m == 1:
            return 1.0, max(float(len(texts)), 0.05)
        return 1 - (entropy(texts, m) if texts else entropy(styles, m)), max(float(sum(texts)), 0.05 * m)

    def sums(path, fade=1.0):
        value, weight = own(path)
        below = [sums(p, fade * html_extract.DISCOUNT) for p in seen[path][3]]
        return fade * weight * value + sum(a for a, _ in below), fade * weight + sum(b for _, b in below)

    says = {}
    for path in seen:
        a, b = sums(path)
        m = len(seen[path][0])
        says[path] = (a / b - 0.6) * 2.5 * (1 - 2 / (m + 1))

    def chosen(html):
        root = html_extract.parsed(html)
        own = [(n, t) for n, t in html_extract.blocks(root) if not n.cut]
        body = [(n, t) for n, t in own if n.name not in html_extract.HEADINGS] or own
        share = sum(len(t) for n, t in body if n.marked) / max(1, sum(len(t) for _, t in body))
        ramp = 0.0 if share < 0.25 else 1.0 if share > 0.5 else (share - 0.25) * 4
        marked = share > 0.5

        def noisy(n):
            if n.cut:
                return True
            kids = [p for p in n.parts if not isinstance(p, str)]
            texts = [t for o, t in html_extract.blocks(n) if o is n]
            prior = 3.0 if n.name in ("#page", "html", "body") else 0.5
            if n.marked and n.name in ("article", "main") or n.marked and n.name in html_extract.FLOW:
                prior = 0.5 + ramp * (2.5 if n.name in ("article", "main") else 1.5)
            silent = not texts and all(noisy(p) for p in kids)
            return silent or (prior + min(0.0, says[n.path]) <= 0 and all(noisy(p) for p in kids))

        def kept(n, dropped):
            gone = dropped or noisy(n)
            mine = {id(n)} if not gone and not n.cut and (n.marked or not marked) else set()
            return mine.union(*(kept(p, gone) for p in n.parts if not isinstance(p, str)))

        ids = kept(root, False)
        allowed = [(id(n), t) for n, t in html_extract.blocks(root) if not n.cut and (n.marked or not marked)]
        return "\n".join([t for i, t in allowed if i in ids] or [t for _, t in allowed])

    return [chosen(h) for h in site]


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition(spark, seed):
    rnd = random.Random(seed)
    shared = [words(rnd, 4) for _ in range(6)]

    def branch(depth):
        kind = rnd.choice(["div", "div", "div class=a", "div class='b c'", "section", "p", "ul", "table", "span", "nav", "div class=sidebar", "article" if depth < 2 and rnd.random() < 0.2 else "div"])
        inner = "".join(branch(depth + 1) for _ in range(rnd.randint(0, 3))) if depth < 4 else ""
        text = rnd.choice([*shared, words(rnd, 5), words(rnd, 5), "", ""])
        return f"<{kind}>{text}{inner}</{kind.split()[0]}>"

    sites = []
    for _ in range(8):  # a site's pages have some branches in common
        same = [f"<div class=q{i}>{branch(1)}{rnd.choice(shared)}</div>" for i in range(3)]
        sites.append([f"<body>{same[0]}{branch(0)}<div class=r>{branch(1)}{same[1]}</div>{rnd.choice(same)}</body>" for _ in range(rnd.randint(1, 14))])
    sites = [site + site[:2] for site in sites]  # copies count once
    rows = [(1000 * k + i, f"http://h{k}.org/{i}", h) for k, site in enumerate(sites) for i, h in enumerate(site)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    want = {1000 * k + i: t for k, site in enumerate(sites) for i, t in enumerate(by_definition(site))}
    assert got == want
    assert any(text_of(h) != got[i] for i, _, h in rows)


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 350_000, "<a " * 350_000 + ">", "<div title=\"" * 80_000, "<a \">\" " * 150_001 + "\"", "<script>" + "</script " * 120_000, "<!--" * 250_000, "<!x" * 350_000, "<div>" * 100_000 + "</section>" * 90_000,
        "<ul>" + "<div>" * 50_000 + "<li></li>" * 80_000, "<p><x-y>" + "<ul>" * 200_000, "<div a='" * 120_000 + "x>", "&" * 1_000_000, "<" * 1_000_000, "<div " + "a " * 500_000 + ">t", "<p>" * 330_000, "<tr><td>" * 120_000,
        "<div class='" + "nav-" * 250_000 + "'>t</div>",
    ],
    ids=range(17),
)
def test_a_megabyte_of_broken_markup(html):
    began = time.process_time()
    text_of(html)
    assert time.process_time() - began < 8


def test_quotes_that_never_close():
    assert text_of("<p title=\">a</p><p>b</p>") == "a\nb"
    assert text_of("<p title='x>y'>a</p><p title=\"x>b") == "a\nb"


def test_registered_pages(spark, sf):
    got = queries.op3_html_text(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.where("text = '' OR text LIKE '%<%>%' OR n_chars <> length(text)").count() == 0


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_prefix_hashes():
    rnd = random.Random(2)
    a = "".join(rnd.choices("ab", k=3000)) + "x" * 70_000
    b = a[1000:2000] + "".join(rnd.choices("ab", k=500))
    p, q = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for _ in range(200):
        i, k, n = rnd.randrange(len(a)), rnd.randrange(len(b)), rnd.randrange(40)
        i, k = min(i, len(a) - n), min(k, len(b) - n)
        assert p.equal(i, q, k, n) == (a[i : i + n] == b[k : k + n])
        assert p.extension(i, q, k) == lcp(a[i:], b[k:])
    assert p.extension(1000, q, 0) >= 1000
    joined = fingerprints.Prefixes.joined(p, 1500, q, 700)
    assert joined.fingerprint == fingerprints.Prefixes(a[:1500] + b[:700]).fingerprint


def test_hashes_of_all_spans():
    text = "".join(random.Random(8).choices("ab", k=70_000))
    p = fingerprints.Prefixes(text)
    found = [int(x) for part in p.spans() for x in part]
    assert len(found) == len(text) - fingerprints.SPAN + 1
    assert all(found[i] == p.span(i, i + fingerprints.SPAN, 1) for i in range(0, len(found), 97))
    assert [int(x) for part in fingerprints.Prefixes("abc").spans() for x in part] == [fingerprints.Prefixes("abc").span(0, 3, 1)]
    assert not list(fingerprints.Prefixes("").spans())


def test_likeness_of_moved_and_framed_text():
    rnd = random.Random(9)
    a = " ".join(f"w{rnd.randrange(9000)}" for _ in range(800))
    other = " ".join(f"v{rnd.randrange(9000)}" for _ in range(800))
    near = lambda x, y: fingerprints.likeness(fingerprints.Prefixes(x).fingerprint, fingerprints.Prefixes(y).fingerprint)
    assert near(a, "!" + a + "!") > 0.9
    assert near(a, a[2000:] + a[:2000]) > 0.9
    assert near(a, other) < 0.1
    assert 0.3 < near(a, a[:2000] + other[2000:]) < 0.8


@pytest.mark.parametrize("seed", range(4))
def test_likeness_is_the_shared_ends(seed):
    rnd = random.Random(seed)
    a = "".join(rnd.choices("abcd", k=rnd.randint(50, 4000)))
    cut = rnd.randint(0, len(a))
    b = a[:cut] + "".join(rnd.choices("wxyz", k=rnd.randint(1, 300))) + a[min(len(a), cut + rnd.randint(0, 300)) :]
    got = fingerprints.likeness(fingerprints.Prefixes(a).fingerprint, fingerprints.Prefixes(b).fingerprint)
    front = lcp(a, b)
    back = min(lcp(a[::-1], b[::-1]), min(len(a), len(b)) - front)
    true = (front + back) / max(len(a), len(b))
    spans = [{t[i : i + fingerprints.SPAN] for i in range(len(t) - fingerprints.SPAN + 1)} for t in (a, b)]
    both = len(spans[0] & spans[1]) / max(1, len(spans[0] | spans[1]))
    assert true - 2 / 16 <= got <= max(true, both + 0.2) + 1e-9
    assert fingerprints.likeness("", "") == 1.0


def test_next_documents(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choices("abc ü🙂", k=rnd.randint(0, 300)))) for i in range(0, 90, 2)] + [(7, None), (9, ""), (11, "x" * 50_000), (13, "same"), (15, "same"), (None, "last")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kind string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.with_next(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + u[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.Prefixes(t).fingerprint and r.edited_fingerprint == fingerprints.Prefixes(edited).fingerprint
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.Prefixes(u).fingerprint)
        assert (r.front_edited, r.front_next) == (lcp(t, edited), lcp(t, u))
    assert got[13].fingerprint == got[15].fingerprint


def test_many_documents_without_an_id(spark):
    texts = sorted({f"text {i}" for i in range(300)})
    df = spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id long, text string").repartition(4)
    got = fingerprints.with_next(df)
    want = Counter(fingerprints.Prefixes(t).fingerprint for t in texts * 2)
    assert Counter(r.fingerprint for r in got.collect()) == want


def test_many_equal_rows_are_walked_once(spark, monkeypatch):
    """Rows repeated with one id and text, or without an id, are one row of the walk, and the result has them all."""
    rows = [(5, "the same text")] * 900 + [(None, "no id")] * 800 + [(i, f"text {i}") for i in range(12)] + [(None, "another")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = sorted(map(tuple, fingerprints.with_next(df).collect()), key=repr)
    walked = []
    keep = fingerprints.written
    monkeypatch.setattr(fingerprints, "REPEATED", 100)
    monkeypatch.setattr(fingerprints, "CHUNK", 70)
    monkeypatch.setattr(fingerprints, "written", lambda x, name: walked.append((name, keep(x, name))) or walked[-1][1])
    got = sorted(map(tuple, fingerprints.with_next(df).collect()), key=repr)
    assert got == plain and len(got) == len(rows)
    assert dict(walked)["fingerprints"].where("kind = 0").count() < 30 and dict(walked)["same-rows"].count() == 2


def test_one_document_and_none(spark):
    one = fingerprints.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == sha256(b"abab").hexdigest()
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
