"""HTML extraction with site style trees.

Pages of one host are merged into a style tree: its nodes are paths of elements
(tag and class), each with the presentations its children take and the contents
its text takes over the host's pages.  A node's presentation importance is the
entropy of its presentations, its content importance one less the mean entropy
of its contents, both in units of the number of pages; the composite of both,
averaged over what stands below, is a branch's importance.  Branches that are of
low importance with all that stands below, the same on page after page, are cut
from each page; so is a single content that most pages of its host have in the
same path.

What a page's own markup declares comes first: navigation, headers, footers,
asides, forms, scripts and the like are no text, nor are elements whose role,
class or id names a menu, notice, advert, comment section and so on.  The inside
of <article> or <main> has its importance raised (``DECLARED``); importance
decides there too, and no text goes for standing outside of them.

Scale: trees are counts, combined before the shuffle by (host, path, content),
so a host that holds a third of all pages is no group in memory; only the cut
branches of a host are joined back to its pages.

Defined results: a null or empty page has the empty text; a null or odd url
belongs to the host ""; broken markup (unclosed or stray tags, comments or
scripts that do not end) is read as far as it goes; repeated pages are extracted
alike; importance counts ``UNSEEN`` pages more than a host has, each with contents
of its own, so the few pages of a small host are no proof of repetition; elements
deeper than ``DEEP`` stand in the tree at their ancestor of that depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import map_rows, stored, table

#: Pages with contents of their own that every host is thought to have besides those seen.
UNSEEN = 2
#: Depth of the tree: deeper elements share the node of their ancestor.
DEEP = 64
#: Weight of contents against presentations, and the importance below which a branch is cut.
CONTENT_WEIGHT, LOW = 0.9, 0.2
#: By how much the markup raises the importance of what is inside <article> or <main>.
DECLARED = 2.0
#: Bytes of the per-host table that may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 8 << 20

#: Elements by their part in a page.
RAW = frozenset("script style noscript template iframe textarea svg math object canvas video audio head".split())
DROPPED = RAW | frozenset("nav footer aside form menu dialog button select option input datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts "
    "advertisement adsbygoogle sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login comment comments reply replies disqus respond share sharing "
    "social related recommended widget toolbar pager pagination skip search form".split()
)
#: An element that opens while one of these is open ends it first.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _host() -> Column:
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    return F.coalesce(F.lower(F.regexp_extract("url", pattern, 1)), F.lit(""))


class Block:
    """Text of one block: its element path and its words."""

    __slots__ = ("path", "text")

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text

    @property
    def digest(self) -> int:
        return xxhash.xxh64_intdigest(self.text) - (1 << 63)


class _Open:
    """An element that is open: inline ones stand in the path of what holds them."""

    __slots__ = ("tag", "path", "depth", "dropped", "content", "children")

    def __init__(self, tag: str, label: str, dropped: bool, content: bool, above: _Open | None):
        self.tag, self.dropped, self.content = tag, dropped, content
        self.children: dict[str, None] = {}
        if above is None:
            self.path, self.depth = "", 0
        elif tag in INLINE or above.depth == DEEP:
            self.path, self.depth = above.path, above.depth
        else:
            self.path, self.depth = f"{above.path}/{label}" if above.path else label, above.depth + 1


def _names_no_text(token: str) -> bool:
    """Whether a class or id says so: ``site-menu`` and ``menuTop`` do, ``with-sidebar`` doesn't."""
    parts = [x.lower() for x in _NAME.findall(token)]
    return bool(parts) and parts[0] not in ("with", "has", "no", "without", "is") and (parts[0] in NAMES or parts[-1] in NAMES)


def _declared(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """(the element's part of a path, whether its markup says that it is no text)."""
    label, dropped = tag, tag in DROPPED or tag == "header" and not in_article
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden":
                dropped = dropped or not m[0].strip().lower().startswith("hidden=")
            elif key == "role":
                dropped = dropped or value.lower() in ROLES
            else:
                if key == "class" and value:
                    label = f"{tag}.{value.split()[0]}" if value.split() else tag
                dropped = dropped or any(map(_names_no_text, value.split()))
    return label, dropped and tag not in ("html", "body", "article", "main") or tag == "article" and dropped and in_article


def blocks_of(html: str | None, styles: Counter | None = None) -> list[Block]:
    """Blocks with text, in page order, outside of what the markup drops.

    styles: counts (path, children) presentations of the elements that closed.
    Time is in proportion to the length of the page, however deep it nests.
    """
    out: list[Block] = []
    if not html:
        return out
    stack = [_Open("", "", False, False, None)]
    opened: Counter = Counter()  # tags on the stack
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Block(stack[-1].path, text))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            last = stack.pop()
            opened[last.tag] -= 1
            if styles is not None and not last.dropped and last.tag not in INLINE:
                styles[last.path, "/".join(last.children)] += 1

    at = 0
    while m := _MARKUP.search(html, at):
        slash, tag = m[1], (m[2] or "").lower()
        if m.start() > at and not stack[-1].dropped:
            held.append(unescape(html[at : m.start()]))
        at = m.end()
        if not tag:
            continue
        if slash:
            if not opened[tag]:
                continue
            if tag not in INLINE:
                while stack[-1].tag != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            elif stack[-1].tag == tag:  # a stray end of an inline element does nothing
                opened[stack.pop().tag] -= 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW and tag != "head":
            if tag not in INLINE:
                flush()
            if not m[0].endswith("/>"):  # only its own end tag ends a raw element
                end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            flush()
            ended, scope = ENDS.get(tag, {"p"}), _SCOPES.get(tag, set())
            for depth in range(len(stack) - 1, max(0, len(stack) - DEEP), -1):
                if stack[depth].tag in ended:
                    close(depth)
                elif stack[depth].tag in scope or stack[depth].tag not in INLINE and tag not in ENDS:
                    break
        above = stack[-1]
        label, dropped = _declared(tag, m[3] or "", above.content)
        if "main" in (m[3] or "") and 'role="main"' in m[3].lower():
            label = "main" + label[len(tag) :]
        above.children[label] = None
        content = above.content or label.partition(".")[0] in ("article", "main")
        stack.append(_Open(tag, label, above.dropped or dropped, content, above))
        opened[tag] += 1
    if at < len(html) and not stack[-1].dropped:
        held.append(unescape(html[at:]))
    close(1)
    flush()
    return out


def main_text(html: str | None, low: set[str] | None = None) -> str:
    """The text of a page less the branches and contents in low (of its host)."""
    found = blocks_of(html)
    if low:
        left = [b for b in found if b.path not in low and f"{b.path}\n{b.digest}" not in low]
        found = left or found  # a page that is nothing but repeated branches keeps them
    return " ".join(b.text for b in found)


# ---------------------------------------------------------------- style trees


def _tree_rows(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, n): on how many pages a path has a presentation or
    content; kind "page" counts the pages."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            seen: Counter = Counter()
            for host, html in zip(b["host"], b["html"], strict=True):
                styles: Counter = Counter()
                mine = {(host, "", "page", 0)}
                for x in blocks_of(html, styles):
                    mine.add((host, x.path, "content", x.digest))
                for path, children in styles:
                    mine.add((host, path, "style", xxhash.xxh64_intdigest(children) - (1 << 63)))
                seen.update(mine)
            host, path, kind, value = zip(*seen, strict=True) if seen else ((), (), (), ())
            yield {"host": host, "path": path, "kind": kind, "value": value, "n": list(seen.values())}

    rows = map_rows(pages.select(_host().alias("host"), "html"), run, "host string, path string, kind string, value long, n long")
    return rows.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): the paths of each host whose importance is low with all below, and
    as path, line feed and digest the contents that are low by themselves.  The latter
    are few: each is on more than m ** (1 - LOW / CONTENT_WEIGHT) of m pages."""
    tree = stored(_tree_rows(pages), "style_tree")
    size = tree.where("kind = 'page'").select("host", (F.col("n") + UNSEEN).alias("m"))
    # a host may hold a third of all contents: they meet by node, and only nodes meet by host
    per = tree.where("kind <> 'page'").groupBy("host", "path", "kind").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("values"),
        F.sum(F.log("n")).alias("logs"),
        F.sum(F.col("n") * F.log("n")).alias("n_logs"),
    )
    per = per.join(size, "host")
    base = F.log("m")
    style = (F.log("total") - F.col("n_logs") / F.col("total")) / base  # entropy of the presentations
    content = 1 - F.col("logs") / F.col("values") / base  # one less the mean entropy of the contents
    nodes = per.withColumn("importance", F.greatest(F.lit(0.0), F.when(F.col("kind") == "style", style).otherwise(content)))
    raised = lambda path: F.when(F.col(path).rlike(r"(^|/)(article|main)(\.|/|$)"), DECLARED).otherwise(1.0)

    def above(path: str) -> Column:
        steps = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda d: F.array_join(F.slice(steps, 1, d), "/"))

    branches = (
        nodes.withColumn("branch", F.explode(above("path")))
        .groupBy("host", "branch", "kind")
        .agg((F.sum(F.col("importance") * F.col("total")) / F.sum("total")).alias("i"))
    )
    wide = branches.groupBy("host", "branch").agg(
        F.max(F.when(F.col("kind") == "style", F.col("i"))).alias("style"),
        F.max(F.when(F.col("kind") == "content", F.col("i"))).alias("content"),
    )
    composite = (1 - CONTENT_WEIGHT) * F.coalesce("style", F.lit(0.0)) + CONTENT_WEIGHT * F.col("content")
    important = F.col("content").isNotNull() & (composite * raised("branch") >= LOW)
    low = (
        wide.select("host", F.explode(above("branch")).alias("branch"), important.alias("kept"), F.col("content").isNotNull().alias("text"))
        .groupBy("host", "branch")
        .agg(F.max("kept").alias("kept"), F.max("text").alias("text"))
        .where("text and not kept")
        .select("host", "branch")
    )
    alone = CONTENT_WEIGHT * (1 - F.log("n") / F.log("m")) * raised("path")
    # of m pages, UNSEEN + 1 at least, no content is low that is not on three
    leaves = tree.where("kind = 'content' and n > 2").join(size, "host").where(alone < LOW)
    low = low.unionByName(leaves.select("host", F.concat_ws("\n", "path", F.col("value").cast("string")).alias("branch")))
    return low.groupBy("host").agg(F.collect_set("branch").alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    low = stored(low_branches(pages), "low_branches")
    size = low.agg(F.sum(F.aggregate("low", F.lit(64), lambda a, x: a + F.length(x) + 32))).first()[0] or 0
    joined = pages.select("page_id", "url", "html", _host().alias("host")).join(
        F.broadcast(low) if size <= BROADCAST_BYTES else low, "host", "left"
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [main_text(h, set(x) if x else None) for h, x in zip(b["html"], b["low"], strict=True)]
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(joined.select("page_id", "url", "html", "low"), run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
