"""Pages to text, headings, lists, metadata and links, from an own tree of the markup. One vectorised call per batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.text import clean_extracted, content_metrics, unnested
from lodeworks.functions.urls import DOMAIN, crawlable, page_type, page_type_of_path, valid

# What is pruned and where content is looked for.
DROPPED_TAGS = "script style nav header footer aside menu noscript iframe object embed form input button select textarea label fieldset legend link meta".split()
DROPPED_CLASSES = "nav navbar navigation menu sidebar footer header advertisement ads ad social share comments comment pagination breadcrumb cookie popup modal overlay".split()
DROPPED_IDS = "nav navbar navigation menu sidebar footer header advertisement ads social comments pagination breadcrumb".split()
CONTENT_PLACES = ["main", "article", '[role="main"]', ".main-content", ".content", "#main", "#content", ".post-content", ".entry-content", ".page-content"]
LIGHT_TAGS = "script style nav header footer aside menu noscript iframe object embed".split()
LIGHT_IDS = "nav navbar navigation menu sidebar footer header ads social comments".split()
BREAKS = "p div h1 h2 h3 h4 h5 h6 li br".split()
SCRIPT_URLS = (
    r"https?://[^\"\s<>]+",
    r"(?:href|src|action|data-href|data-url)=[\"']([^\"']+)[\"']",
    r"window\.location\s*=\s*[\"']([^\"']+)[\"']",
    r"\.href\s*=\s*[\"']([^\"']+)[\"']",
    r"fetch\([\"']([^\"']+)[\"']",
    r"axios\.[get|post]+\([\"']([^\"']+)[\"']",
    r"url:\s*[\"']([^\"']+)[\"']",
)
# End of fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these kinds that nothing of the second list stands in.
CLOSES = {t: (("p",), ("div", "li", "td", "body")) for t in "p div ul ol h1 h2 h3 h4 h5 h6 table section article form blockquote pre".split()}
CLOSES |= {"li": (("li",), ("ul", "ol")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",))}


class Node:
    __slots__ = ("tag", "attrs", "children", "dead")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.dead = tag, attrs, [], False

    def walk(self) -> Iterator[Node | str]:
        """All that stands below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    if x.dead:
                        continue
                    yield x
                    stack.append(iter(x.children))
                    break
                yield x
            else:
                stack.pop()

    def all(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and (not tags or x.tag in tags)]

    def text(self, glue: str = "") -> str:
        parts = (x for x in self.walk() if isinstance(x, str))
        return glue.join(filter(None, map(str.strip, parts))) if glue else "".join(parts)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Tree(HTMLParser):
    """Builds nodes from markup, however it is nested; comments and declarations are left out."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        ends, within = CLOSES.get(tag, ((), ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in ends:
                del self.open[k:]
                break
            if self.open[k].tag in within:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


#: An ampersand, with the name behind it if a semicolon ends that; numbers that a semicolon ends are left alone.
AMPERSAND = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


def parse(markup: str | None, closed: bool = False) -> Node:
    """closed takes character references by their semicolon only, so that "&amp" stays as it is."""
    if closed:
        markup = AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), markup or "")
    return Tree(markup or "").root


def select(root: Node, place: str) -> list[Node]:
    """Elements by tag, class, id or role."""
    if place[0] == ".":
        return [x for x in root.all() if place[1:] in x.classes()]
    if place[0] == "#":
        return [x for x in root.all() if x.attrs.get("id") == place[1:]]
    if place[0] == "[":
        return [x for x in root.all() if x.attrs.get("role") == "main"]
    return root.all(place)


def prune(root: Node, tags=DROPPED_TAGS, classes=DROPPED_CLASSES, ids=DROPPED_IDS, strict: bool = False) -> None:
    """Marks what isn't content as dead. strict matches classes and ids by any part of their names, as "ad" in "header"."""
    inside = re.compile("|".join(classes), re.IGNORECASE), re.compile("|".join(ids), re.IGNORECASE)
    for x in root.all():
        own, name = x.classes(), x.attrs.get("id", "")
        if x.tag in tags or (any(map(inside[0].search, own)) or name and inside[1].search(name) if strict else {c.lower() for c in own} & {*classes} or name.lower() in ids):
            x.dead = True


def main_content(root: Node) -> Node:
    """The first place with more than fifty characters, else the largest div with more than a hundred, else the body."""
    for place in CONTENT_PLACES:
        for x in select(root, place)[:1]:
            if len(x.text().strip()) > 50:
                return x
    sized = [(len(x.text().strip()), x) for x in root.all("div")]
    large = [s for s in sized if s[0] > 100]
    return max(large, key=lambda s: s[0])[1] if large else next(iter(root.all("body")), root)


def linear(node: Node) -> str:
    """Stripped strings in order, with line ends for block elements."""
    parts = []
    for x in node.walk():
        if isinstance(x, str):
            if x.strip():
                parts.append(x.strip())
        elif x.tag in BREAKS:
            parts.append("\n")
    return " ".join(parts)


def headings(node: Node) -> list[dict]:
    return [{"level": n, "text": t} for n in range(1, 7) for h in node.all(f"h{n}") if (t := h.text().strip())]


def lists(node: Node) -> list[dict]:
    out = []
    for tag, kind in (("ul", "unordered"), ("ol", "ordered")):
        for x in node.all(tag):
            items = [t for c in x.children if isinstance(c, Node) and c.tag == "li" and not c.dead and (t := c.text().strip())]
            if items:
                out.append({"type": kind, "items": items})
    return out


def metas(root: Node) -> dict[str, str]:
    """Title, description, keywords, social fields, canonical address and language."""
    out = {}
    if title := next(iter(root.all("title")), None):
        out["title"] = title.text().strip()
    for m in root.all("meta"):
        name, value = m.attrs.get("name") or m.attrs.get("property") or "", m.attrs.get("content", "")
        if value and (name in ("description", "keywords") or name.startswith(("og:", "twitter:"))):
            out.setdefault(name.replace(":", "_"), value.strip())
    for x in root.all("link"):
        if "canonical" in x.attrs.get("rel", "").split() and x.attrs.get("href"):
            out.setdefault("canonical_url", x.attrs["href"])
    for x in root.all("html")[:1]:
        if x.attrs.get("lang"):
            out["language"] = x.attrs["lang"]
    return out


EXTRACTED = T.StructType(
    [
        T.StructField("raw_text", T.StringType()),
        T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))),
        T.StructField("lists", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))]))),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def _rows(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.name for f in EXTRACTED])


def extract(html: Column, strict: bool = False, closed: bool = False) -> Column:
    """Main text, headings by level, lists and metadata of a page. strict prunes before metadata is read, and by parts of names;
    closed leaves character references without their semicolon as they are."""

    @F.pandas_udf(EXTRACTED)
    def run(pages: pd.Series) -> pd.DataFrame:
        out = []
        for markup in pages:
            try:
                root = parse(markup, closed)
                found = {} if strict else metas(root)
                prune(root, strict=strict)
                body = main_content(root)
                out.append({"raw_text": linear(body), "headings": headings(body), "lists": lists(body), "metadata": metas(root) if strict else found, "error": None})
            except Exception as error:  # a page that can't be read is a row with its reason
                out.append({"raw_text": "", "headings": [], "lists": [], "metadata": {}, "error": str(error)})
        return _rows(out)

    return run(html)


def extract_all(html: Column) -> Column:
    """All content places of more than a hundred characters, else paragraphs and headings of more than twenty, else the body."""

    @F.pandas_udf(EXTRACTED)
    def run(pages: pd.Series) -> pd.DataFrame:
        out = []
        for markup in pages:
            root = parse(markup)
            found = metas(root)
            prune(root, LIGHT_TAGS, DROPPED_CLASSES, LIGHT_IDS)
            texts = [t for place in (*CONTENT_PLACES, ".article-content") for x in select(root, place) if len(t := x.text(" ")) > 100]
            texts = texts or [t for x in root.all("p", "h1", "h2", "h3", "h4", "h5", "h6") if len(t := "".join(filter(None, map(str.strip, (s for s in x.walk() if isinstance(s, str)))))) > 20]
            texts = texts or [x.text(" ") for x in root.all("body")[:1]]
            out.append({"raw_text": " ".join(" ".join(texts).split()), "headings": headings(root), "lists": [], "metadata": found, "error": None})
        return _rows(out)

    return run(html)


def page_lists(html: Column) -> Column:
    """All lists of a page, those of its menus among them."""

    @F.pandas_udf(EXTRACTED["lists"].dataType)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda markup: lists(parse(markup)))

    return run(html)


def pages_to_content(pages: DataFrame, strict: bool = False, closed: bool = False) -> DataFrame:
    """Pages with clean text, headings, lists, metadata, page type and metrics."""
    rows = pages.withColumn("x", extract(F.col("html"), strict, closed))
    rows = rows.select(*pages.columns, clean_extracted(F.col("x.raw_text")).alias("clean_text"), F.transform("x.headings", lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), clean_extracted(h["text"]).alias("clean_text"))).alias("headings"), F.transform("x.lists", lambda v: F.struct(v["type"].alias("type"), F.transform(v["items"], clean_extracted).alias("items"))).alias("lists"), F.col("x.metadata").alias("metadata"), F.col("x.error").alias("error"))
    return rows.withColumns({"page_type": page_type(F.col("url")), "path_type": page_type_of_path(F.col("url")), "metrics": content_metrics(F.col("clean_text"))})


def is_quality(content_length: Column, words: Column, content: Column, title: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.coalesce((content_length >= 100) & (words >= 20), F.lit(False)) & ~blank(content) & ~blank(title)


def is_page(status: Column, kind: Column, body: Column, title: Column, company: str) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return (status == 200) & F.contains(F.lower(kind), F.lit("html")) & F.contains(F.lower(body), F.lit(company.lower())) & ~F.contains(low, F.lit("404")) & ~F.contains(low, F.lit("not found"))


def page_links(markup: str | None, base: str) -> list[str]:
    """Addresses of links, data attributes, scripts and metas, made absolute, in order and once each."""
    return list(dict.fromkeys(_each_link(markup, base)))


def _each_link(markup: str | None, base: str) -> list[str]:
    """The same with every repeat."""
    root, out = parse(markup), []
    tagged = [*root.all("a"), *root.all("link"), *root.all("area")]
    for x in [*(t for t in tagged if "href" in t.attrs), *(x for x in root.all() if "data-href" in x.attrs or "data-url" in x.attrs)]:
        href = (x.attrs.get("href") or x.attrs.get("data-href") or x.attrs.get("data-url") or "").strip()
        if href and not href.startswith(("javascript:", "mailto:", "tel:")):
            out.append(_joined(base, href))
    for s in root.all("script"):
        out += [u.strip("\"'") for u in re.findall(r"[\"']https?://[^\"']+[\"']", s.text())]
    for m in root.all("meta"):
        out += re.findall(r"https?://[^\s<>\"']+", m.attrs.get("content", ""))
    return list(filter(None, out))


def all_links(markup: str | None, base: str) -> list[str]:
    """Addresses of links, forms, data attributes and all script patterns, made absolute, sorted."""
    root = parse(markup)
    found = [x.attrs.get("href") for x in root.all("a", "link", "area")] + [x.attrs.get("action") for x in root.all("form")] + [x.attrs.get("data-href") for x in root.all()]
    found += [u for s in root.all("script") for p in SCRIPT_URLS for u in re.findall(p, s.text())]
    return sorted({_joined(base, u) for u in found if u} - {""})


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


def links(pages: DataFrame, wide: bool = False, domain: str = DOMAIN, keep_invalid: bool = False) -> DataFrame:
    """(url, place, link): each address's links that may be crawled; wide also reads forms and script patterns.

    Pages of one address count as one: each link once, in the order of its first place on any of them, and by itself where
    places are equal; wide goes by the links alone.
    """
    find = all_links if wide else _each_link

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([find(h, u) for h, u in zip(html, url, strict=True)])

    @F.pandas_udf(T.StringType())
    def netloc(url: pd.Series) -> pd.Series:
        return url.map(lambda u: urlparse(u).netloc)

    rows = unnested(pages.select("url", "html"), run("html", "url"), "k", "link").groupBy("url", "link").agg(F.min("k").alias("k"))
    order = ["link"] if wide else ["k", "link"]
    rows = rows.select("url", (F.row_number().over(Window.partitionBy("url").orderBy(*order)) - 1).alias("place"), "link")
    if not keep_invalid:
        rows = rows.where(valid(F.col("link"), domain) if wide else crawlable(F.col("link"), base=netloc("url")))
    return rows.select("url", "place", "link")
