"""Main texts: tags alone, templates against a slow deduction, and pages that only their template can tell apart."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest

from proofloom.llm import htmltext
from proofloom.llm.htmltext import ELEMENT, HOLDER, TEXT, Page, extract

PAGES = "page_id long, url string, html string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><!-- ad --><div class="ad">Buy</div><article><h1>One &amp; two</h1><p><b>First
 line<br>goes on.<p>Second &lt;b&gt; &eacute;</p><ul><li>a<li>b</ul><form><input><p>f</p></form><section id="comments"><p>Nice!</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""


def test_main_text():
    assert extract(PAGE) == "One & two\nFirst line goes on.\nSecond <b> é\na\nb"
    assert extract("<p>plain</p>a < b<div>x") == "plain\na < b\nx"
    assert extract("") == extract("<html><body></body></html>") == ""
    assert extract("<article><p>Hello <span class='share'>Share</span>world</p></article>") == "Hello world"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar'><nav>n</nav><article><p>Text</p></article></body>", "<div class='with-sidebar'><article><p>Text</p></article><div class='sidebar'>s</div></div>",
        "<article class='post comments-open'><p>Text</p></article><div id='comments'><article class='comment'><p>Me too</p></article></div>", "<div id='content' class='widget'><p>Text</p></div><div class='ad'>x</div>",
        "<article><section id='related-work'><div class='search-results'></div></section><p>Text</p></article>", "<div class='menu'><article><p>Text</p></article></div>", "<main class='discussion'><p>Text</p></main>",
    ],
)
def test_furniture_words_spare_what_holds_the_article(page):
    assert extract(page) == "Text"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n)) + "."


def plain_site(pages=30, seed=1):
    """(rows, expected texts) of a host without article elements or telling names: menu, advert and small print differ by page, a box does not."""
    rnd, rows, want = random.Random(seed), [], {}
    for i in range(pages):
        title, paragraphs = sentence(rnd, 5), [sentence(rnd, rnd.randint(20, 60)) for _ in range(rnd.randint(1, 6))]
        want[i] = "\n".join([title, *paragraphs])
        rows.append((i, f"http://plain.example/{i}", f"<html><body><div class=x1><a>{sentence(rnd, 2)}</a></div><div class=x2>{sentence(rnd, 6)}</div><div class=x3 id=p{i}><h1>{title}</h1><div class=x5>Read <b>all</b> of it here</div>"
                     + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div><div class=x4>{sentence(rnd, 7)}</div></body></html>"))
    return rows, want


def test_templates_tell_text_from_furniture_without_names(spark):
    rows, want = plain_site()
    found = spark.createDataFrame(rows, PAGES)
    out = {r.page_id: r.text for r in htmltext.main_texts(found).collect()}
    assert out == want
    # the template decides: without it, or with that of other pages, the text is another
    t = htmltext.templates(found).first()
    holders, texts = {h.token for h in t.holders}, set(t.texts)
    page = rows[3][2]
    assert extract(page, holders, texts) == want[3] != extract(page)
    assert extract(page, holders) == want[3].replace("\n", "\nRead all of it here\n", 1)
    assert extract(page, {Page(page).element_key(2)}, texts) != want[3]
    few = htmltext.main_texts(spark.createDataFrame(rows[: htmltext.LEAST_PAGES - 1], PAGES)).collect()
    assert all("Read all of it here" in r.text for r in few), "too few pages for a template"


def test_template_box_in_an_article_goes(spark):
    """What every page has at one place is template, also inside an article; what some pages share stays; copies of a page stay whole."""
    rnd = random.Random(2)
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>{sentence(rnd, 3)}</h1><p>{sentence(rnd, 9)}</p><div class='box'>Sign our letter</div>{'<p>Shared paragraph.</p>' if i % 3 else ''}</article></body>") for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", PAGE) for i in range(12)]
    out = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("Sign our letter" not in out[i] and ("Shared paragraph." in out[i]) == bool(i % 3) and out[i].count("\n") == 1 + bool(i % 3) for i in range(12))
    assert {out[100 + i] for i in range(12)} == {extract(PAGE)}


def slow_templates(rows):
    """Valid classes by their full occurrence vectors."""
    hosts = defaultdict(list)
    for _, url, page in rows:
        m = re.match(r"[a-z]+://([^/]*)", url or "")
        hosts[m[1].lower() if m else ""].append(Page(page or ""))
    out = {}
    for host, pages in hosts.items():
        vectors, kinds, places, chars = defaultdict(lambda: [0] * len(pages)), {}, defaultdict(list), Counter()
        for i, p in enumerate(pages):
            for k, (kind, node, value) in enumerate(p.items):
                if p.out[node] or kind not in "<t" or kind == "t" and not value.strip():
                    continue
                token = p.element_key(node) if kind == "<" else p.run_key(node, value)
                if not vectors[token][i]:
                    places[token].append(k)
                    chars[token] += p.chars[node] if kind == "<" else 0
                vectors[token][i] += 1
                kinds[token] = TEXT if kind == "t" else HOLDER if value in htmltext.HOLDERS else ELEMENT
        classes = defaultdict(list)
        for token, v in vectors.items():
            if (n := sum(map(bool, v))) >= htmltext.LEAST_PAGES and n >= htmltext.LEAST_SHARE * len(pages):
                classes[tuple(v)].append(token)
        valid = []
        mean = lambda t: sum(places[t]) / len(places[t])
        for v, tokens in classes.items():
            if sum(1 if kinds[t] == TEXT else 2 for t in tokens) >= htmltext.LEAST_CLASS:
                valid.append({"pages": sum(map(bool, v)), "v1": 0, "first": min(map(mean, tokens)), "last": max(map(mean, tokens)), "tokens": tokens, "v": v})
        kept = [c for c in htmltext.nested(valid)]
        holders = {t for c in kept for t in c["tokens"] if kinds[t] == HOLDER and max(c["v"]) == 1 and chars[t] >= htmltext.MAIN_SHARE * sum(p.chars[0] for p, x in zip(pages, c["v"]) if x)}
        if kept:
            out[host] = (holders, {t for c in kept for t in c["tokens"] if kinds[t] == TEXT})
    return out


def test_templates_against_slow_deduction(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()] + plain_site(12)[0]
    rows = [(i, u if i % 2 else "http://one.example/", h) for i, u, h in rows]  # a large host
    got = {r.host: ({h.token for h in r.holders}, set(r.texts)) for r in htmltext.templates(spark.createDataFrame(rows, PAGES)).collect()}
    want = slow_templates(rows)
    assert got == want and len(want["one.example"][0]) > 1


def test_crossing_classes_are_not_valid():
    c = lambda pages, first, last: {"pages": pages, "first": first, "last": last, "v1": 0}
    out = htmltext.nested([c(9, 5, 12), c(20, 0, 100), c(10, 3, 8), c(9, 4, 6), c(9, 20, 30)])
    assert [(x["first"], x["depth"]) for x in out] == [(0, 0), (3, 1), (20, 1), (4, 2)]


def test_awkward_pages(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1, "h") for r in rows], PAGES + ", host string, token int, text string")
    long = "<article>" + "<p>" + "word " * 50_000 + "</p>" + "<p>end</p>" * 3000 + "</article>"
    rows = [(1, None, None), (None, "not a url", "<p>a&nbsp; b</p>"), (2, "http://x/", ""), (2, "http://x/", ""), (3, "http://x/", long), (4, "http://x/", "<" * 2000 + "&#0;퟿"), (5, "http://x/", "<div>" * 3000 + "deep"), (6, "http://x/", "</p></div>t")]
    out = {(r.page_id, r.url): r for r in htmltext.main_texts(frame(rows)).collect()}
    assert htmltext.main_texts(frame(rows)).count() == len(rows)
    assert out[1, None].text == "" == out[2, "http://x/"].text and out[None, "not a url"].text == "a b" and out[5, "http://x/"].text == "deep" and out[6, "http://x/"].text == "t"
    assert out[3, "http://x/"].n_chars == len("word " * 50_000) - 1 + 3000 * 4
    assert htmltext.main_texts(frame([])).count() == 0 and htmltext.main_texts(frame([])).columns == ["page_id", "url", "text", "n_chars"]


def test_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    out = {r.page_id: r.text for r in htmltext.main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert out[r.page_id] == "\n".join(x for x in parts if x)


def test_small_hosts_go_by_their_pool(spark, data):
    """With every landmark tag renamed, pages of small hosts are read by the elements that pages of their kind have on all hosts."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    want = {i: extract(h) for i, _, h in rows}
    bare = [(i, f"http://h{n // 3}.example/", re.sub(r"<(/?)(?:article|main|nav|footer|header|aside)\b", r"<\1div", h)) for n, (i, _, h) in enumerate(rows)]
    out = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(bare, PAGES)).collect()}
    right = sum(out[i] == want[i] for i in want)
    assert len(bare) >= htmltext.LEAST_PAGES and right >= 0.95 * len(want)
    assert sum(extract(h) == want[i] for i, _, h in bare) == 0, "tags alone tell none of them"


def test_a_pool_has_no_text_in_its_template(spark):
    """What pages of different hosts share stays, though each host's own boilerplate would go; a kind of too few pages goes by tags."""
    rows, want = plain_site(20, seed=5)
    apart = [(i, f"http://h{i}.example/", h) for i, _, h in rows]
    box = "Read all of it here"
    out = {r.page_id: r.text for r in htmltext.main_texts(spark.createDataFrame(apart + [(99, None, "<body><div><p>a</p></div><div>b</div></body>")], PAGES)).collect()}
    assert all(out[i] == want[i].replace("\n", f"\n{box}\n", 1) for i in want) and out[99] == "a\nb"
    pools = [r for r in htmltext.deduced(spark.createDataFrame(apart, PAGES)).collect()]
    assert len(pools) == 1 and pools[0].pool and pools[0].holders and not pools[0].texts
