"""Main text of web pages by wrapper induction.

Every page's element tree is folded to a skeleton: inline elements are looked through, runs of equal siblings are one
node. The most frequent skeleton of a host is its wrapper; every page of the host is aligned with it by simple tree
matching, and each wrapper node gathers the texts that it held on all the host's pages. A node that held one and the same
text on at least half of the host's stories, and on ``MIN_STORIES`` of them, is template; all others are slots. Pages
with one main heading are one story: copies and edited copies must not make an article look like template.

The content region is the innermost part of the wrapper that holds ``MAIN_SHARE`` of the text of all slots, and every
main heading that varies. A page's text is what its nodes of the region hold, without template. Menus, headers, footers
and sidebars are left out by that alone, whatever they are called. What tags, roles and names say of an element decides
where alignment cannot: inside the region (adverts, forms, notices, comments), for pages that don't align with their
host's wrapper, and for hosts whose wrapper has no such region.

A wrapper is one row of sums for each (host, node): a host with a third of all pages is no larger than another. Pages
are parsed twice and never moved but to meet their host's wrapper, which is broadcast by its size on disk or joined.

Defined cases: null or empty html gives an empty text; a page without a host is judged by its elements alone; on a host of
fewer than ``MIN_STORIES`` stories all text counts as varying. Malformed markup (unclosed, misnested, cut off) is read as
far as it goes; text is never dropped or capped, however long or deep. Repeated pages are extracted each. An empty table
gives an empty result; columns of other names, also such as ``host`` or ``wrapper``, are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._dom import BLOCK, RAW, Node, fold, match, parse, skeleton_tree, text_hashes
from ._util import python_ready, written

MIN_STORIES = 3
#: Share of the text of all slots that the content region holds at least.
MAIN_SHARE = 0.85
MEMO = 20_000
#: Elements that a content region may be; others are parts of one.
CONTAINERS = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td", "main", "article"}
DROP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "input", "label", "object", "canvas",
             "audio", "video", "annotation", "annotation-xml", "desc", "metadata", "defs"} | RAW
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu",
              "menubar", "toolbar", "status"}
#: Names of parts that are never content, and of parts that aren't outside of an article.
DROP_NAMES = re.compile(
    r"(?:^|[-_])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side-bar|aside|ad|ads|advert|adverts|advertisement|advertising|"
    r"sponsor|sponsored|promo|promoted|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|sign-up|login|comment|comments|commentlist|disqus|reply|replies|respond|breadcrumb|breadcrumbs|"
    r"toolbar|skip|skip-link|form|outbrain|taboola)(?:$|[-_])|(?:nav|menu|footer|sidebar|comments)$|^ads?(?:box|slot|unit|wrap|by)")
OUTER_NAMES = re.compile(r"(?:^|[-_])(?:share|sharing|social|related|recommended|pagination|pager|widget|search|copyright|legal)(?:$|[-_])")
#: Names of reader comments: dropped even around what looks like an article.
COMMENT_NAMES = re.compile(r"comment|disqus|repl(?:y|ies)|respond")
#: Names of adverts.
ADVERT_NAMES = re.compile(r"(?:^|[-_])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|promotion)(?:$|[-_])|^ads?(?:box|slot|unit|wrap|by)")
#: Names that look like the above but hold content.
KEEP_NAMES = re.compile(r"^(?:article|post|entry|story|page)-(?:header|body|content|text)$|^with-|^has-|^no-")


def dropped(node: Node, in_content: bool) -> bool:
    """True for an element that says of itself that it isn't main text."""
    if node.tag in DROP_TAGS:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    a = node.attrs
    if node.tag == "header" and not in_content:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in DROP_ROLES:
        return True
    names = (a.get("class", "") + " " + a.get("id", "")).lower().split()
    found = [x for x in names if (DROP_NAMES.search(x) or not in_content and OUTER_NAMES.search(x)) and not KEEP_NAMES.search(x)]
    if found and node.holds_main and not in_content:  # a wrapper around the article, named after what it also holds
        return any(COMMENT_NAMES.search(x) for x in found)
    return bool(found)


def mark_foreign(tree: Node) -> None:
    """Marks what is no part of a layout: adverts, reader comments, forms and what is hidden, with all that they hold."""
    def walk(x: Node, foreign: bool) -> None:
        for c in x.children:
            if isinstance(c, Node):
                names = (c.attrs.get("class", "") + " " + c.attrs.get("id", "")).lower().split() if c.attrs else []
                c.foreign = foreign or c.tag in ("form", "dialog", "button", "select") or "hidden" in c.attrs or any(
                    (COMMENT_NAMES.search(n) or ADVERT_NAMES.search(n)) and not KEEP_NAMES.search(n) for n in names)
                walk(c, c.foreign)

    walk(tree, False)


def _roots(tree: Node) -> list[Node]:
    """The outermost articles, or else main parts, that aren't dropped; or else the whole page."""
    for tags in ({"article"}, {"main"}):
        found: list[Node] = []

        def walk(x: Node, tags=tags, found=found) -> None:
            for c in x.children:
                if isinstance(c, Node):
                    if c.tag in tags or ("main" in tags and c.attrs.get("role") == "main"):
                        if not dropped(c, True):
                            found.append(c)
                    elif not dropped(c, False):
                        walk(c)
        walk(tree)
        if found:
            return found
    return [tree]


def blocks(tree: Node, template: set[int], region: list[Node] | None = None) -> list[str]:
    """Blocks of main text in page order; ``template`` holds the ids (``node_id``) of nodes whose own text is template.

    ``region`` are the nodes to read; without them, what tags and names say.
    """
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            out.append(text)

    def walk(x: Node, content: bool) -> None:
        block = x.tag in BLOCK
        if block:
            flush()
        silent = block and x.node_id in template
        for c in x.children:
            if isinstance(c, str):
                if not silent:
                    inline.append(c)
            elif c.tag == "br" or c.tag == "hr":
                inline.append(" ")
            elif not dropped(c, content):
                walk(c, content)
            elif c.tag in BLOCK:
                flush()
            else:
                inline.append(" " if c.tag in ("input", "select", "button") else "")
        if block:
            flush()

    for r in region or _roots(tree):
        walk(r, bool(region) or r.tag in ("article", "main"))
        flush()
    return out


def main_text(source: str | None, wrapper: str | None = None, constant: list[int] | None = None, region: int | None = None,
              memo: dict | None = None) -> str:
    """Main text of a page, given its host's wrapper skeleton, the wrapper nodes that are template, and the content region's node."""
    if not source:
        return ""
    tree = parse(source, dropped)
    template: set[int] = set()
    roots: list[Node] = []
    if wrapper:
        sig, members = fold(tree)
        pairs = aligned(sig, wrapper, {} if memo is None else memo)
        same = set(constant if constant is not None else ())
        for k, nodes in enumerate(members):
            if pairs.get(k) in same:
                for x in nodes:
                    x.node_id = k
                template.add(k)
            if region is not None and region >= 0 and pairs.get(k) == region:
                roots = nodes
    return "\n\n".join(blocks(tree, template, roots))


def aligned(sig: str, wrapper: str, memo: dict) -> dict[int, int]:
    if (sig, wrapper) not in memo:
        if len(memo) > MEMO:
            memo.clear()
        memo[(sig, wrapper)] = match(skeleton_tree(sig), skeleton_tree(wrapper))
    return memo[(sig, wrapper)]


def region_of(wrapper: str, slots: dict[int, int]) -> int:
    """The wrapper node that is the content region, given the characters that each slot held; -1 if that is no part of the body."""
    total: dict[int, int] = {}
    heads: dict[int, int] = {}

    def add(x) -> None:
        label, k, kids = x
        for c in kids:
            add(c)
        total[k] = slots.get(k, 0) + sum(total[c[1]] for c in kids)
        heads[k] = int(label.partition(".")[0] == "h1" and slots.get(k, 0) > 0) + sum(heads[c[1]] for c in kids)

    root = at = skeleton_tree(wrapper)
    add(root)
    whole = total[root[1]]
    while whole and at[0].partition(".")[0] not in ("article", "main"):
        inner = [c for c in at[2] if c[2] and c[0].partition(".")[0] in CONTAINERS and total[c[1]] >= MAIN_SHARE * whole and heads[c[1]] == heads[root[1]]]
        if not inner:
            break
        at = inner[0]
    return at[1] if whole and at[0].partition(".")[0] not in ("html", "body") else -1


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def story_of(sig: str, hashes: list[int], members: list[list[Node]]) -> int:
    """What tells a page's story from others: its first main heading, or else all its text."""
    heading = next((h for h, nodes in zip(hashes, members, strict=True) if h >= 0 and nodes[0].tag == "h1"), None)
    return heading if heading is not None else -1 - zlib.crc32(repr((sig, hashes)).encode())


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, constant, region) of every host of ``pages(url, html)``."""
    python_ready(pages.sparkSession)

    def skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                if source:
                    tree = parse(source, dropped)
                    mark_foreign(tree)
                    sig, members = fold(tree)
                    hashes, chars = text_hashes(members)
                    rows.append((host, story_of(sig, hashes, members), sig, hashes, chars))
            yield pd.DataFrame(rows, columns=["host", "story", "sig", "hashes", "chars"])

    known = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")
    read = written(known.mapInPandas(skeletons, "host string, story long, sig string, hashes array<long>, chars array<int>"), "html-skeletons")
    page = F.struct("sig", "hashes", "chars")
    parsed = written(read.groupBy("host", "story").agg(F.min(page).alias("page")).select("host", "page.*"), "html-stories")
    kinds = parsed.groupBy("host", "sig").count()
    wrappers = written(kinds.groupBy("host").agg(F.sum("count").alias("stories"), F.max_by("sig", F.struct("count", "sig")).alias("wrapper")), "html-wrappers")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in batches:
            rows = []
            for host, sig, wrapper, hashes, chars in zip(pdf["host"], pdf["sig"], pdf["wrapper"], pdf["hashes"], pdf["chars"], strict=True):
                rows += [(host, to, int(hashes[k]), int(chars[k])) for k, to in aligned(sig, wrapper, memo).items() if hashes[k] >= 0]
            out = pd.DataFrame(rows, columns=["host", "node", "hash", "chars"])
            yield out.groupby(["host", "node"], as_index=False).agg(low=("hash", "min"), high=("hash", "max"), n=("hash", "size"), chars=("chars", "sum"))

    sums = parsed.join(wrappers, "host").select("host", "sig", "wrapper", "hashes", "chars").mapInPandas(
        held, "host string, node int, low long, high long, n long, chars long")
    nodes = sums.groupBy("host", "node").agg((F.min("low") == F.max("high")).alias("same"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    fixed = F.col("same") & (F.col("n") >= MIN_STORIES) & (2 * F.col("n") >= F.col("stories"))
    flags = nodes.join(wrappers.select("host", "stories"), "host").groupBy("host").agg(
        F.collect_list(F.when(fixed, F.col("node"))).alias("constant"), F.collect_list(F.when(~fixed, F.struct("node", "chars"))).alias("slots"))

    @F.pandas_udf("int")
    def region(wrapper: pd.Series, slots: pd.Series) -> pd.Series:
        return pd.Series([region_of(w, {x["node"]: x["chars"] for x in s}) for w, s in zip(wrapper, slots, strict=True)])

    found = wrappers.join(flags, "host").where("size(slots) > 0")
    return written(found.select("host", "wrapper", "constant", region("wrapper", "slots").alias("region")), "html-wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``."""
    wrappers = induce(pages).withColumnRenamed("host", "h_")

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict = {}
        for html, wrapper, constant, region in batches:
            yield pd.Series([main_text(s, w, c if isinstance(c, (list, np.ndarray)) else None, None if pd.isna(r) else int(r), memo)
                             for s, w, c, r in zip(html, wrapper, constant, region, strict=True)], dtype=object)

    joined = pages.select("page_id", "url", "html").join(wrappers, host_of(F.col("url")) == F.col("h_"), "left")
    out = joined.select("page_id", "url", of("html", "wrapper", "constant", "region").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
