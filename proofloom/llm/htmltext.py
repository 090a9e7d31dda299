"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: elements, known by the path they open, and runs
of text, known by their path and words. Over the pages of a host, tokens with
the same occurrence vector (how often each page has them) form an equivalence
class; the vector of a token is kept as two sums of keyed hashes over pages, so
that classes are found by aggregations, however many pages a host has. A class
is valid if it has enough tokens and pages, and if its span nests with those of
the classes that more pages have. The valid classes are the host's template.

What stands between template tokens are slots. The main element of a page is the
deepest template element, of those that can hold an article, in whose slots the
host's pages have at least half of their text. A page's text is what its slots
hold there: not the runs that are template tokens themselves, and not what is
furniture by its tag (menus, forms ...) or, unless it holds the article, by its
class. A heading of its own around the main element belongs to the text as well.

Where its host tells no main element of a page that marks none by a tag, its
pool does: the pages of all hosts with the same elements at the top, whose
elements make a template in the same way. What is text is never template by a
pool, since other hosts may well have the same article. Tags alone decide on
pages that mark their article, and on pages of too few of a kind.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, trim

LEAST_PAGES = 8  # with a token, for it to count
LEAST_SHARE = 0.1  # of a host's pages that a token is on
LEAST_CLASS = 3  # tokens of a valid class, an element's two tags being two
POOL_DEPTH = 4  # elements around and including those that pages of a pool have in common
MAIN_SHARE = 0.5  # of the text of the pages that have it, for an element to be the main one

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|title|xmp|noembed|noframes)\b(?P<rawattrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head"}
#: Opening one of these closes an open one of the set, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"caption", "dd", "dt", "li", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "head", "figcaption"}
#: Elements whose text is never main text.
OUT = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "label", "input", "object", "audio", "video", "canvas", "map"}
MAIN = {"article", "main"}
#: Elements that can hold an article, told apart by their number among their like.
HOLDERS = {"article", "main", "section", "div", "td", "tr", "table", "tbody", "center", "body"}
#: Words of class, id and role that tell the same of an element that does not hold the article.
OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "complementary", "alert", "alertdialog", "disclaimer", "responses", "discussion", "paywall", "login"}
_WORD = re.compile(r"[a-z]+")
#: With such words a furniture word tells of something else: no-sidebar, with-menu, comments-open.
_NOT = re.compile(r"\b(?:no|has|with|without|not|hide|is)[-_][\w-]*|[\w-]*[-_](?:open|closed|enabled|disabled|on|off)(?![\w-])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(attrs: str) -> tuple[str, bool, bool]:
    """Class, id and role of an element (numbers as #), whether it is hidden, and whether they hold a furniture word."""
    found, hidden, word = [], False, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            found.append(f"{name}={_DIGITS.sub('#', value)}")
            word |= bool(OUT_WORDS.intersection(_WORD.findall(_NOT.sub(" ", _CAMEL.sub(" ", value).lower()))))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            hidden = True
    return " ".join(found), hidden, word


class Page:
    """A parsed page. Node 0 is above the first element.

    items holds (kind, node, value) in page order: ``<`` and ``>`` (an element
    opens or closes), ``-`` (a break between blocks), ``s`` (an element within
    a line) or ``t`` (a run of text, references decoded).
    """

    def __init__(self, page: str):
        self.tags, self.parents, self.paths, self.ruled, self.worded = [""], [0], [""], [False], [False]
        self.items: list[tuple[str, int, str]] = []
        self._parse(page)
        self._roles()

    def _parse(self, page: str) -> None:
        tags, parents, paths, items, stack, number = self.tags, self.parents, self.paths, self.items, [0], {}

        def close(k: int) -> None:
            while len(stack) > k:
                items.append((">", stack[-1], tags[stack[-1]]))
                stack.pop()

        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                items.append(("t", stack[-1], html.unescape(page[at : m.start()])))
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if m["end"]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] == tag), 0)
                if k:
                    close(k)
                elif tag == "p":
                    items.append(("-", stack[-1], "p"))
                continue
            if tag in ENDS_P and (k := next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] == "p"), 0)):
                if not any(tags[x] in ("td", "th", "button", "object") for x in stack[k:]):
                    close(k)
            if tag in CLOSES:
                own, stop = CLOSES[tag]
                while (near := next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] in own | stop), 0)) and tags[stack[near]] in own:
                    close(near)
            marks, out, word = _marks(m["attrs"]) if m["attrs"].strip() else ("", False, False)
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK:
                if tag == "hr" or tag in ("br", "wbr", "img", "input"):
                    items.append(("-" if tag == "hr" else "s", stack[-1], tag))
                continue
            path = f"{paths[stack[-1]]}/{tag}" + (f"[{marks}]" if marks else "")
            if tag in HOLDERS:
                number[stack[-1], path] = n = number.get((stack[-1], path), 0) + 1
                path = f"{path}.{n}"
            out |= tag in OUT or tag == "header" and not any(tags[x] in MAIN for x in stack)
            tags.append(tag)
            parents.append(stack[-1])
            paths.append(path)
            self.ruled.append(out)
            self.worded.append(word)
            stack.append(len(tags) - 1)
            items.append(("<", stack[-1], tag))
        if at < len(page):
            rest = page[at:]
            cut = rest.find("<")
            items.append(("t", stack[-1], html.unescape(rest if cut < 0 or not re.match(r"<[a-zA-Z/!?]", rest[cut:]) else rest[:cut])))

    def _above(self, node: int) -> Iterator[int]:
        """The node and all around it, innermost first."""
        while node:
            yield node
            node = self.parents[node]
        yield 0

    def _summed(self, out: list[bool]) -> list[int]:
        """Characters of the text of each node, inner elements included, without what is out."""
        chars = [0] * len(self.tags)
        for kind, node, value in self.items:
            if kind == "t" and not out[node]:
                chars[node] += len(value.strip())
        for k in range(len(chars) - 1, 0, -1):
            chars[self.parents[k]] += chars[k]
        return chars

    def _roles(self) -> None:
        """out: the node is furniture or within it. main: within an article or main element. chars: of the text that is not out."""
        out = list(self.ruled)
        self.main = [tag in MAIN for tag in self.tags]
        for k in range(1, len(out)):
            out[k] |= out[self.parents[k]]
            self.main[k] |= self.main[self.parents[k]]
        self.chars = self._summed(out)
        if any(self.worded):
            # what holds the article is no furniture, whatever its class; where nothing is marked as one, what holds most of the text
            main = max((k for k in range(1, len(out)) if self.tags[k] in MAIN and not out[k]), key=lambda k: (-sum(self.worded[x] for x in self._above(k)), self.chars[k], -k), default=0)
            kept = set(self._above(main)) if main else {k for k in range(len(out)) if 2 * self.chars[k] > self.chars[0]}
            for k in range(1, len(out)):
                out[k] |= out[self.parents[k]] or self.worded[k] and k not in kept and self.tags[k] not in ("html", "body")
            self.chars = self._summed(out)
        self.out = out

    def run_key(self, node: int, value: str) -> int:
        return _hash(f"t{self.paths[node]}\t{_SPACE.sub(' ', value).strip()}")

    def element_key(self, node: int) -> int:
        return _hash("<" + self.paths[node])

    def blocks(self) -> Iterator[tuple[str, list[tuple[int, str]]]]:
        """(text, runs) of each block that is not out, white space collapsed; runs are (node, text). Empty blocks are left out."""
        held: list[str] = []
        runs: list[tuple[int, str]] = []
        for kind, node, value in [*self.items, ("-", 0, "")]:
            if kind == "t":
                if not self.out[node]:
                    held.append(value)
                    if value.strip():
                        runs.append((node, value))
            elif kind == "s":
                held.append("" if value == "wbr" or self.out[node] else " ")
            elif kind == "-" or value in BLOCK:
                if runs:
                    yield _SPACE.sub(" ", "".join(held)).strip(), runs
                held, runs = [], []


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


ELEMENT, HOLDER, TEXT = 0, 1, 2


def pool_of(page: Page) -> str | None:
    """What the page shares with its pool, the holders at its top; null if it marks its article by a tag, or has no holders."""
    if any(page.main):
        return None
    depth, top = [0] * len(page.tags), set()
    for k in range(1, len(depth)):
        depth[k] = depth[page.parents[k]] + 1
        if depth[k] <= POOL_DEPTH and page.tags[k] in HOLDERS and not page.out[k]:
            top.add(page.paths[k])
    return xxhash.xxh3_128_hexdigest("\n".join(sorted(top)).encode("utf-8", "surrogatepass")) if top else None


def signature(page: Page) -> Iterator[tuple[int, int, int, int, int]]:
    """(token, kind, how often the page has it, its first place, characters of the text in it) of elements and runs of text that are not out."""
    counts: dict[int, list[int]] = {}
    for k, (kind, node, value) in enumerate(page.items):
        if page.out[node]:
            continue
        if kind == "<":
            counts.setdefault(page.element_key(node), [HOLDER if value in HOLDERS else ELEMENT, 0, k, page.chars[node]])[1] += 1
        elif kind == "t" and value.strip():
            counts.setdefault(page.run_key(node, value), [TEXT, 0, k, 0])[1] += 1
    return ((t, *x) for t, x in counts.items())


def host_column(url: str = "url"):
    """The host of a URL in lower case; null and unreadable URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def nested(classes: list[dict]) -> list[dict]:
    """The classes whose spans nest or lie apart, each with ``depth``, the classes around it.

    Classes of more pages come first, then wider ones; one that crosses a class
    before it is not valid.
    """
    kept: list[dict] = []
    for c in sorted(classes, key=lambda c: (-c["pages"], c["first"] - c["last"], c["first"], c["v1"])):
        if all(c["last"] < k["first"] or c["first"] > k["last"] or k["first"] <= c["first"] and c["last"] <= k["last"] or c["first"] <= k["first"] and k["last"] <= c["last"] for k in kept):
            kept.append(c)
    return [{**c, "depth": sum(k is not c and k["first"] <= c["first"] and c["last"] <= k["last"] for k in kept)} for c in kept]


def templates(pages: DataFrame) -> DataFrame:
    """(host, holders, texts) of each host that has valid classes: tokens of its template (see :func:`deduced`)."""
    return deduced(pages).filter("not pool").drop("pool")


def deduced(pages: DataFrame) -> DataFrame:
    """(pool, host, holders, texts) of each host, and of each pool (pool is true, host its name), that has valid classes: tokens of its template.

    holders are the elements that may hold an article and that no page has
    twice, each with its share of the text of the pages that have it; texts are
    runs of text. A token counts from LEAST_PAGES pages and LEAST_SHARE of the
    host's pages on, so that a host's template is no more than a few pages long.
    A pool has elements only, so its texts are empty.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pool", pa.bool_()), ("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("chars", pa.int64()), ("of_page", pa.int64())])
        for b in batches:
            rows = []
            for h, p, t in zip(*(c.to_pylist() for c in b.columns)):
                page = Page(t or "")
                found, pool = [(p, *x, page.chars[0]) for x in signature(page)], pool_of(page)
                rows += [(False, h, *x) for x in found]
                rows += [(True, pool, *x) for x in found if pool and x[2] != TEXT]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        trim()

    own = pages.select(host_column().alias("host"), F.xxhash64("page_id", "url").alias("page"), F.col("html").cast("string").alias("html"))
    seen = own.mapInArrow(run, "pool boolean, host string, page long, token long, kind int, n int, place int, chars long, of_page long")
    # the occurrence vector: sums over pages of two hashes of (page, count), to which a repeated row adds like any other
    each = seen.groupBy("pool", "host", "token").agg(
        F.max("kind").alias("kind"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("chars"), F.sum("of_page").alias("of_page"),
        F.sum(F.pmod(F.xxhash64("page", "n"), F.lit(1 << 31))).alias("v1"), F.sum(F.pmod(F.xxhash64("n", "page"), F.lit(1 << 31))).alias("v2"), F.avg("place").alias("place"),
    )
    often = saved(each.filter(F.col("pages") >= LEAST_PAGES), "tokens")
    sizes = pages.groupBy(F.lit(False).alias("pool"), host_column().alias("host")).agg(F.count("*").alias("of_host"))
    # every page of a pool has the elements that it is known by
    sizes = sizes.union(often.filter("pool").groupBy("pool", "host").agg(F.max("pages").alias("of_host")))
    frequent = often.join(sizes, ["pool", "host"]).filter(F.col("pages") >= F.lit(LEAST_SHARE) * F.col("of_host"))
    share = F.when((F.col("kind") == HOLDER) & (F.col("total") == F.col("pages")), F.col("chars") / F.greatest("of_page", F.lit(1)))
    tokens = F.collect_list(F.struct("token", "kind", share.alias("share")))
    size = F.sum(F.when(F.col("kind") == TEXT, 1).otherwise(2))
    classes = frequent.groupBy("pool", "host", "pages", "total", "v1", "v2").agg(tokens.alias("tokens"), size.alias("size"), F.min("place").alias("first"), F.max("place").alias("last")).filter(F.col("size") >= LEAST_CLASS)
    hosts = classes.groupBy("pool", "host").agg(F.collect_list(F.struct("pages", "v1", "first", "last", "tokens")).alias("classes"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holders, texts = [], []
            for classes in b.column(2).to_pylist():
                tokens = [t for c in nested(classes) for t in c["tokens"]]
                holders.append(sorted(((t["token"], t["share"]) for t in tokens if (t["share"] or 0) >= MAIN_SHARE)))
                texts.append(sorted(t["token"] for t in tokens if t["kind"] == TEXT))
            kind = pa.list_(pa.struct([("token", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"token": t, "share": s} for t, s in x] for x in holders], kind), pa.array(texts, pa.list_(pa.int64()))], ["pool", "host", "holders", "texts"])

    return hosts.mapInArrow(nest, "pool boolean, host string, holders array<struct<token:long,share:double>>, texts array<long>")


def main_element(page: Page, holders: set[int]) -> int:
    """The page's node that its host's template says is the main element; 0 if it has none.

    The deepest of the template's elements; where an article or main element of
    the template is around it, that one.
    """
    found = [k for k in range(1, len(page.tags)) if page.tags[k] in HOLDERS and not page.out[k] and page.element_key(k) in holders]
    if not found:
        return 0
    deepest = max(found, key=lambda k: (sum(1 for _ in page._above(k)), page.chars[k], -k))
    return next((k for k in page._above(deepest) if page.tags[k] in MAIN and k in found), deepest)


def extract(html_text: str, holders: set[int] = frozenset(), texts: set[int] = frozenset()) -> str:
    """Main text of a page, given the template of its host (see :func:`templates`)."""
    return _read(Page(html_text), holders, texts)[0]


def _read(page: Page, holders: set[int], texts: set[int]) -> tuple[str, bool]:
    """The main text of a page, and whether the template told it."""
    blocks = list(page.blocks())
    main = main_element(page, holders) if holders else 0
    if main:
        around = set(page._above(main))
        inside = [False] * len(page.tags)
        for k in range(1, len(inside)):
            inside[k] = k == main or inside[page.parents[k]] or page.tags[k] == "h1" and page.parents[k] in around
        own = [(text, runs) for text, runs in blocks if any(inside[node] for node, _ in runs)]
        slots = [text for text, runs in own if not all(page.run_key(*r) in texts for r in runs)]
        if slots or own:  # a page with nothing but template in it is a copy of the others, not an empty one
            return "\n".join(slots or [text for text, _ in own]), True
    marked = [text for text, runs in blocks if any(page.main[node] for node, _ in runs)]
    return "\n".join(marked or [text for text, _ in blocks]), False


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    Null or empty html: empty text. Null url: the empty host. Repeated rows
    stay. Very long pages are read whole; extra columns may have any name.
    White space is what Python's ``\\s`` matches, no-break spaces included. A
    text of an article that all pages of a kind have, at the same place, is
    template; one that only some of them share is not. Empty input: no rows.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = saved(deduced(own), "templates")

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for b in batches:
            texts, pools, rest = [], [], []
            for k, (page, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = ({x["token"] for x in b.column(4)[k].as_py() or ()}, set(b.column(5)[k].as_py() or ()))
                parsed = Page(page or "")
                text, told = _read(parsed, *known[host])
                texts.append(text)
                pools.append(None if told else pool_of(parsed))
                rest.append(page if pools[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in (texts, pools, rest))], ["page_id", "url", "text", "host", "html"])
        trim()

    def by_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for k, (page, holders) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                if page and holders:
                    texts[k] = extract(page, {x["token"] for x in holders})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        trim()

    joined = own.withColumn("host", host_column()).join(found.filter("not pool").drop("pool"), "host", "left")
    read = joined.select("page_id", "url", "html", "host", "holders", "texts").mapInArrow(by_host, "page_id long, url string, text string, host string, html string")
    # pages that need no pool are dealt out evenly: no pool has such a name
    read = read.withColumn("host", F.coalesce("host", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    joined = read.join(found.filter("pool").select("host", "holders"), "host", "left")
    return joined.select("page_id", "url", "text", "html", "holders").mapInArrow(by_pool, "page_id long, url string, text string, n_chars long")
