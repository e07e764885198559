"""Operator 2: main text of web pages by nearest-URL page differencing.

1. Each page is cut into text lines (blocks), each with the part of the page that it
   stands in: main (article or main element), aside (menus, page headers and footers,
   sidebars, notices, adverts, forms, comments), or open.
2. Pages are put in the order of host, path and key, in range buckets; the page before
   or after with the longer common path is a page's nearest on its host. The first
   and last page of each bucket also go to the neighbouring bucket, so that a page's
   nearest doesn't depend on the buckets, and a host with a third of all pages is
   spread over many of them.
3. The lines of a page and of its nearest are aligned by longest common subsequence;
   shared lines are deleted. Two checks follow: aside lines go even if no other page
   shares them (menus and adverts of the given pages differ from page to page), and
   main lines stay even if shared (else the copies of an article would delete one
   another). Open lines stay only in pages without a main element.

Defined results: null html counts as empty; a page without text gives an empty string;
a null URL, or one without `://`, has an empty host, and such pages are each other's
host; rows stay apart even where keys repeat; whole pages, of any length, in time that
grows with the length; a tag that the page's end cuts off is no text, and a quote
without its counterpart ends with its tag; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_null, slices, text_batches
from .url_filter import host_of, path_of

MAIN, ASIDE, OPEN = "m", "a", "o"
#: Elements whose text is never shown, elements outside the main text, and elements that end a line.
_SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "textarea", "canvas", "audio", "video"}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}
_MAIN = {"article", "main"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Fixed value: names in class, id or role of a part outside the main text.
_MARKS = {
    "ad", "ads", "adsbygoogle", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
    "promoted", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Fixed value: names that may stand beside those in one class name (cookie-banner, sidebar_left, ad-box) and say nothing of their own.
_NEUTRAL = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "header", "inner", "item", "items", "left", "link", "links", "list", "main",
    "outer", "panel", "post", "posts", "right", "row", "section", "site", "slot", "text", "top", "unit", "wrap", "wrapper",
}
#: Fixed value: those that count whatever words stand before them in a class name (user-comments, story-ads), but not on a page's own parts.
_ANYWHERE = {"ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "comment", "comments", "replies", "disqus", "newsletter"}
_OWN = {"html", "body", "article", "main"}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: An attribute's name and value.
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_STOP = re.compile(r"[>\"']")
_CLOSE = {x: re.compile(rf"</{x}\b[^>]*>|\Z", re.I) for x in _SILENT}


def _marked(value: str, own: bool = False) -> bool:
    """True if one of the names is a mark, is made of marks and neutral words, or (not on a page's own parts) ends in a mark of comments or adverts."""
    for name in value.lower().split():
        parts = re.split("[-_]+", name.strip("-_"))
        if not _MARKS.isdisjoint(parts) and all(x in _MARKS or x in _NEUTRAL or x.isdigit() for x in parts):
            return True
        if not own and parts[-1] in _ANYWHERE:
            return True
    return False


def _outside(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _ASIDE or tag == "header" and not in_main:
        return True
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name in ("class", "id", "role") and _marked(value, tag in _OWN):
            return True
    return False


def _next_tag(page: str, at: int) -> tuple[int, int, str, str, str] | None:
    """Start and end of the next tag, "/" of an end tag, name (empty for comments and the like) and attributes; each character is looked at a few times at most."""
    while (start := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), start):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            return start, len(page) if end < 0 else end + (3 if comment else 1), "", "", ""
        closing = "/" if page.startswith("/", start + 1) else ""
        name = _NAME.match(page, start + 1 + len(closing))
        if name:
            at = name.end()
            while m := _STOP.search(page, at):
                if m[0] == ">":
                    return start, m.end(), closing, name[0].lower(), page[name.end() : m.start()]
                at = m.end()
                # a quote counts after = and if there is another one
                if page[max(name.end(), m.start() - 20) : m.start()].rstrip().endswith("=") and (other := page.find(m[0], at)) >= 0:
                    at = other + 1
            return None
        at = start + 1
    return None


def lines_of(page: str) -> list[tuple[str, str]]:
    """(part, line) in page order; character references decoded, white space folded."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements that set the part, or that an end tag must be told from
    words: list[str] = []
    part, at, end = OPEN, 0, len(page)

    def flush() -> None:
        line = " ".join(html.unescape("".join(words)).split())
        if line:
            out.append((part, line))
        words.clear()

    while at < end:
        found = _next_tag(page, at)
        words.append(page[at : found[0]] if found else _cut(page[at:]))
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1] != (stack[k - 1][1] if k else OPEN):
                        flush()
                    del stack[k:]
                    part = stack[-1][1] if stack else OPEN
                    break
        elif tag in _SILENT and not attributes.endswith("/"):
            at = _CLOSE[tag].search(page, at).end() if tag != "head" else at
        elif tag not in _VOID and not attributes.endswith("/"):
            own = part
            if part != ASIDE:
                own = ASIDE if tag not in ("html", "body") and _outside(tag, attributes, part == MAIN) else MAIN if tag in _MAIN else part
            if own != part:
                flush()
            if own != part or tag in ("div", "section", "ul", "ol", "table", "span", *_MAIN, *_ASIDE):
                stack.append((tag, own))
                part = own
    flush()
    return out


def _cut(rest: str) -> str:
    """What follows the last whole tag: a tag that the page's end cuts off isn't text."""
    k = rest.rfind("<")
    return rest[:k] if k >= 0 and re.match(r"<[/!a-zA-Z]", rest[k:]) else rest


def shared(mine: list[str], other: list[str]) -> set[int]:
    """Indexes of my lines in a longest common subsequence: the longest rising run of matches."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, int]] = []  # my line, node before
    last: list[int] = []
    for i, line in enumerate(mine):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            nodes.append((i, last[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                last.append(len(nodes) - 1)
            else:
                tails[k], last[k] = j, len(nodes) - 1
    found, n = set(), last[-1] if last else -1
    while n >= 0:
        found.add(nodes[n][0])
        n = nodes[n][1]
    return found


def main_text(lines: list[tuple[str, str]], nearest: list[str] | None) -> str:
    gone = shared([x for _, x in lines], nearest) if nearest else set()
    has_main = any(p == MAIN for p, _ in lines)
    return "\n".join(x for i, (p, x) in enumerate(lines) if p == MAIN or p == OPEN and not has_main and i not in gone)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", rows_a_bucket: int = 2000) -> DataFrame:
    """key, url, text, n_chars of every row."""
    spark = text_batches(pages).sparkSession
    order = ["host", "path", "sort_key"]
    df = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), blank_null(page).alias("html"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("sort_key"))
    kind = df.schema["key"].dataType.simpleString()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_a_bucket)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first, last = first or b.slice(0, 1), b.slice(b.num_rows - 1)
        if first is not None:
            yield from pa.Table.from_batches([first, last]).to_batches()

    # first and last key of each range: two short rows for each bucket
    marks = df.select(*order).repartitionByRange(buckets, *order).sortWithinPartitions(*order).mapInArrow(ends, "host string, path string, sort_key string")
    found = [tuple(x.encode("utf-8", "surrogatepass") for x in r) for r in marks.collect()]
    firsts, lasts = sorted(found[::2]), set(found[1::2])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            rows = b.select(["html", *order]).to_pylist()
            at, bucket, context, parts, lines = [], [], [], [], []
            for i, row in enumerate(rows):
                cut = lines_of(row["html"])
                own = tuple(row[c].encode("utf-8", "surrogatepass") for c in order)
                k = max(bisect_right(firsts, own) - 1, 0)
                to = [(k, False)] + [(k - 1, True)] * (k > 0 and firsts[k] == own) + [(k + 1, True)] * (own in lasts)
                for n, beside in to:
                    at.append(i)
                    bucket.append(n)
                    context.append(beside)
                    parts.append("".join(p for p, _ in cut))
                    lines.append([x for _, x in cut])
            again = b.select(["key", "url", *order]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(bucket, pa.int64()), pa.array(context, pa.bool_()), pa.array(parts, pa.string()), pa.array(lines, pa.list_(pa.string()))], names=["key", "url", *order, "bucket", "context", "parts", "lines"])

    cut = df.mapInArrow(parse, f"key {kind}, url string, host string, path string, sort_key string, bucket long, context boolean, parts string, lines array<string>")
    dealt = cut.repartition(buckets, "bucket").sortWithinPartitions("bucket", *order, "context")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def alike(row: dict, other: dict | None) -> int:
            return len(commonprefix([row["path"], other["path"]])) if other and (row["bucket"], row["host"]) == (other["bucket"], other["host"]) else -1

        def text(before: dict | None, row: dict, after: dict | None) -> str:
            near = before if alike(row, before) >= alike(row, after) else after
            return main_text(list(zip(row["parts"], row["lines"], strict=True)), near["lines"] if alike(row, near) >= 0 else None)

        def written(rows: list[tuple]) -> pa.RecordBatch:
            keys = pa.concat_arrays([r[0] for r in rows]) if rows else pa.array([], shape)
            return pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["key", "url", "text"])

        before = row = None
        shape, out = pa.int64(), []
        for b in batches:
            for i, after in enumerate(b.drop_columns(["key"]).to_pylist()):
                shape = b.schema.field("key").type
                after["key"] = b.column("key").slice(i, 1)
                if row is not None and not row["context"]:
                    out.append((row["key"], row["url"], text(before, row, after)))
                before, row = row, after
            if len(out) >= 500:
                yield written(out)
                out = []
        if row is not None and not row["context"]:
            out.append((row["key"], row["url"], text(before, row, None)))
        if out:
            yield written(out)

    done = dealt.mapInArrow(compare, f"key {kind}, url string, text string")
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
