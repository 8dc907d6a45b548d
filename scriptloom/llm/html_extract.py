"""Main text of pages through site style trees.

Pages of one host are merged into a style tree: element nodes by their path of tags and
classes, each with the styles (sequences of children) that pages give it and the contents that
they put there. All hosts' trees together make the shared template tree, which tells for hosts
with few pages.

* Presentation importance of a node: entropy of its styles over the pages that have it, with
  that number of pages as base (1 for a single page).
* Content importance: one minus the mean entropy of its contents, each content's distribution
  being uniform over the pages that show it. A text that every page repeats counts 0, a text of
  one page 1.
* Few pages say little: on ``m`` pages, a share of ``1 / m`` of the importance is 1 whatever they show.
* A node whose combined importance is below ``LEAST_IMPORTANCE``, in its host's tree or in the
  shared one, is noise with all below it. Article and main elements are never removed as a whole,
  and where the tree would take more than ``MOST_TAKEN`` of a page's text, it takes nothing.
* Pages with the same longest block of main text (by tags and names alone) count as one, which
  shows what any of them shows, so mirrors, near copies, print views and repeated rows say
  nothing about importance.

Tags and class names with a fixed meaning (navigation, adverts, forms, ...) are a prior: their
importance is 0 whatever the trees say, as boilerplate may change from page to page. An article or
main element, where a page has one, bounds the text.

The trees are summed by (host, node, value), never gathered per host, so a host that holds a third
of all pages is spread over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import broadcast_if_small, cut
from scriptloom.llm.url_filter import host_and_path
from scriptloom.session import map_arrow

LEAST_IMPORTANCE, CONTENT_SHARE, MOST_TAKEN = 0.2, 0.9, 0.8
#: Hosts with noise nodes, and nodes of 8 bytes in all, that may be broadcast; more are joined by host.
BROADCAST_HOSTS, BROADCAST_NODES = 20_000, 2_000_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: Elements that never hold main text.
NOISE_TAGS = frozenset(
    "nav aside footer form head script style noscript template textarea title iframe svg math button select option "
    "dialog menu object canvas audio video map datalist xmp noembed noframes".split()
)
#: Words of class, id and role that never hold main text.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer colophon sidebar aside rail widget widgets ad ads advert adverts "
    "advertisement advertising adslot adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay paywall newsletter subscribe subscription signup login search searchbox breadcrumb "
    "breadcrumbs pagination pager share sharing social related recommended recommendations trending comment comments "
    "commentlist disqus reply replies respond discussion toolbar skip contentinfo complementary legal disclaimer copyright tagcloud".split()
)
#: Words that mark an inline element as an advert even inside running text.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adslot adbox banner sponsored".split())
#: First parts of names that tell of a page's layout, and last parts that leave a noise word's meaning.
LAYOUT_PREFIXES = frozenset("has no not with without is are hide hides hidden show shows non never enable disable supports body page layout".split())
NOISE_SUFFIXES = frozenset("list box bar item items link links left right top bottom block inner text title area section sections panel menu form icon icons button buttons".split())
#: A marked branch with more of a page's text than this isn't noise, where no unmarked article or main has text.
WRAPPER_SHARE = 0.8
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPES = frozenset("ul ol table dl td th".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)(?:([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)|([^>]*)(?:>|\Z))",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "key", "noise", "weak", "main", "kids", "inline", "mark", "size")

    def __init__(self, tag, key, noise, weak, main, inline, mark):
        self.tag, self.key, self.noise, self.weak, self.main, self.inline, self.mark, self.size = tag, key, noise, weak, main, inline, mark, 0
        self.kids: list[str] = []


def _noise_word(token: str) -> str:
    """The noise word that a whole class name, id or role stands for; names of a layout stand for none.

    ``sidebar``, ``site-footer``, ``cookie-notice`` and ``comment-list`` do; ``has-sidebar``,
    ``no-comments``, ``ad-free`` and ``page-header-wrap`` do not.
    """
    parts = _WORD.findall(token)
    if not parts or parts[0] in LAYOUT_PREFIXES:
        return ""
    if parts[-1] in NOISE_WORDS:
        return parts[-1]
    return parts[0] if parts[0] in NOISE_WORDS and NOISE_SUFFIXES.issuperset(parts[1:]) else ""


def _label(tag: str, attributes: str) -> tuple[str, bool, str]:
    """A node's name within its parent, whether it is hidden, and the noise word of its names."""
    names, hidden, word = [], False, ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name in ("class", "id", "role"):
            for token in value.split():
                word = word or _noise_word(token)
            if name != "id":
                names += _WORD.findall(value)
    return (f"{tag}.{'.'.join(names)}" if names else tag), hidden, word


def parse(html: str, nodes: bool = False, noise_keys: frozenset = frozenset()):
    """Blocks of a page: ``(text, node key, is noise, inside article or main)``.

    With ``nodes`` also the style of every element node: ``(node key, style)``. Names mark a
    branch as noise, unless it is the page itself: where no unmarked article or main has text,
    branches that hold one, or more than ``WRAPPER_SHARE`` of the text, are none.
    """
    found, wrappers = _parse(html, nodes, noise_keys, frozenset())
    return _parse(html, nodes, noise_keys, wrappers)[0] if wrappers else found


def _parse(html: str, nodes: bool, noise_keys: frozenset, wrappers: frozenset):
    """:func:`parse` with the marks ``wrappers`` (by their place among all marks) ignored, and those to ignore."""
    marks: list[list] = []  # of each mark: holds an article or main, size of its text
    plain_main = False
    blocks: list[tuple[str, int, bool, int]] = []
    styles: list[tuple[int, int]] = []
    keys: dict[tuple[int, str], int] = {}
    stack = [_Node("", 0, False, False, 0, False, -1)]
    pieces: list[tuple[str, bool]] = []  # and whether a marked inline element holds it

    def key_of(parent: int, name: str) -> int:
        found = keys.get((parent, name))
        if found is None:
            found = keys[parent, name] = xxhash.xxh64_intdigest(name, parent) >> 1
        return found

    def add(text: str) -> None:
        pieces.append((unescape(text) if "&" in text else text, stack[-1].weak))

    def flush() -> None:
        nonlocal plain_main
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            # marked inline elements are noise on their own, and part of the text inside running text
            alone = all(weak or not t.strip() for t, weak in pieces)
            pieces.clear()
            if text:
                top = stack[-1]
                blocks.append((text, top.key, top.noise or alone, top.main))
                top.size += 0 if top.noise and top.mark < 0 else len(text)
                plain_main |= bool(top.main) and not top.noise

    def leave() -> None:
        node = stack[-1]
        if not node.inline or node.noise != stack[-2].noise:
            flush()
        stack.pop()
        stack[-1].size += node.size
        if node.mark >= 0 and (len(stack) == 1 or stack[-1].mark != node.mark):
            marks[node.mark][1] = node.size
        if nodes and not node.inline:
            styles.append((node.key, xxhash.xxh64_intdigest(" ".join(node.kids)) >> 1))

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        start, end = m.span()
        if start > at:
            add(html[at:start])
        at = end
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                pieces.append((m[0][9:].removesuffix("]]>"), stack[-1].weak))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("br", "p") and not any(n.tag == tag for n in stack):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        leave()
                    break
                if tag in INLINE and not stack[k].inline:
                    break  # a stray end of an inline element closes no block
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        while len(stack) > 1 and (stack[-1].inline and not inline and stack[-2].tag in CLOSED_BY and tag in CLOSED_BY[stack[-2].tag] or stack[-1].tag in CLOSED_BY and tag in CLOSED_BY[stack[-1].tag]):
            leave()
        if tag in ("li", "dt", "dd", "tr", "td", "th"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY and tag in CLOSED_BY[stack[k].tag]:
                    while len(stack) > k:
                        leave()
                    break
                if stack[k].tag in SCOPES:
                    break
        parent = stack[-1]
        attributes = m[3] or m[4]
        name, hidden, word = _label(tag, attributes) if attributes else (tag, False, "")
        if not inline:
            parent.kids.append(name)
        if tag in VOID:
            continue
        if inline and name == tag and not hidden and not word:
            continue  # plain inline elements neither break text nor make nodes
        key = key_of(parent.key, name)
        whole = tag in ("article", "main")
        article = 0 if parent.main == 0 and not whole else max(parent.main, 2 if tag == "article" else 1 if tag == "main" else 0)
        comment = tag == "article" and "comment" in word
        weak = inline and (parent.weak or bool(word) and word not in ADVERT_WORDS)
        noise = parent.noise or tag in NOISE_TAGS or hidden and not whole or key in noise_keys and not whole
        noise = noise or tag == "header" and not parent.main or comment or inline and word in ADVERT_WORDS
        mark = parent.mark
        if word and not inline and not whole and tag not in ("html", "body") and (not noise or mark >= 0):
            marks.append([False, 0])
            if len(marks) - 1 not in wrappers:
                noise, mark = True, len(marks) - 1
                article = parent.main
        elif noise and not parent.noise:
            mark = -1
        if whole and mark >= 0 and not comment:
            for n in reversed(stack):
                if n.mark < 0 or marks[n.mark][0]:
                    break
                marks[n.mark][0] = True
        if inline and noise and not parent.noise:
            head = " ".join("".join(t for t, _ in pieces).split())
            if head:  # text before a marked inline element belongs to the block around it
                blocks.append((head, parent.key, parent.noise, parent.main))
                parent.size += len(head)
                plain_main |= bool(parent.main) and not parent.noise
            pieces.clear()
        stack.append(_Node(tag, key, noise, weak, article if not noise else 0, inline, mark))
        if tag in RAW:
            closing = _RAW_END[tag].search(html, at)
            at = closing.end() if closing else len(html)
            leave()
    while len(stack) > 1:
        leave()
    flush()
    held = frozenset() if plain_main or wrappers else frozenset(k for k, (main, size) in enumerate(marks) if main or size > WRAPPER_SHARE * stack[0].size)
    return ((blocks, styles) if nodes else blocks), held


def _bounded(blocks: list[tuple[str, int, bool, int]]) -> tuple[int, list[str]]:
    """Depth of the innermost article or main element that holds text, and its blocks."""
    kept = [b for b in blocks if not b[2]]
    depth = max((b[3] for b in kept), default=0)
    return depth, [b[0] for b in kept if b[3] >= depth]


def extracted(html: str | None, noise_keys: frozenset = frozenset()) -> tuple[str, int]:
    """Main text of one page, empty if it has none, and the number of blocks that the tree took from it."""
    depth, plain = _bounded(parse(html or ""))
    if not noise_keys:
        return " ".join(plain), 0
    inner, left = _bounded(parse(html or "", noise_keys=noise_keys))
    size = lambda blocks: sum(map(len, blocks))
    if inner < depth or size(left) < (1 - MOST_TAKEN) * size(plain):
        return " ".join(plain), 0
    return " ".join(left), len(plain) - len(left)


def main_text(html: str | None, noise_keys: frozenset = frozenset()) -> str:
    return extracted(html, noise_keys)[0]


def page_values(html: str | None) -> tuple[int, set[tuple[int, int, int]]]:
    """Hash of a page's longest block, and ``node, kind, value`` of its styles (0), contents (1) and nodes (2).

    The hash is equal for repeated rows, mirrors and other views of one content.
    """
    blocks, styles = parse(html or "", nodes=True)
    hashed = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
    longest = max(_bounded(blocks)[1], key=lambda b: (len(b), b), default="")
    found = {(k, 0, s) for k, s in styles} | {(k, 1, hashed(t)) for t, k, _, _ in blocks} | {(k, 2, 0) for k, _ in styles}
    return hashed(longest), found


def node_values(pages: DataFrame) -> DataFrame:
    """``host, page, node, kind, value`` of :func:`page_values` for each of ``host, html``; html stays where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rest = [], []
            for i, html in enumerate(batch.column(1)):
                page, found = page_values(html.as_py())
                row += [i] * len(found)
                rest += [(page, *x) for x in found]
            columns = list(zip(*rest)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["host", "page", "node", "kind", "value"],
            )

    return map_arrow(pages.select("host", "html"), run, "host string, page long, node long, kind byte, value long")


def importance(values: DataFrame, by: list[str]) -> DataFrame:
    """``importance`` of each node ``by`` from ``kind, value, n``, the pages that show each value.

    Nodes that hold no text of their own are left out.
    """
    sums = values.groupBy(*by).agg(
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("styled"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("style_n_log_n"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("contents"),
        F.sum(F.when(F.col("kind") == 1, F.log("n"))).alias("content_log_n"),
    )
    wide = F.log(F.greatest(F.lit(2), "m"))
    presentation = F.greatest(F.lit(0.0), F.log("styled") - F.col("style_n_log_n") / F.col("styled")) / wide
    content = F.greatest(F.lit(0.0), 1 - F.col("content_log_n") / F.col("contents") / wide)
    shown = (1 - CONTENT_SHARE) * presentation + CONTENT_SHARE * content
    return sums.where("contents > 0").select(*by, (1 - (1 - 1 / F.col("m")) * (1 - shown)).alias("importance"))


def noise_nodes(pages: DataFrame) -> DataFrame:
    """``host, nodes``: keys of each host's nodes of low importance, in its own or in the shared tree.

    ``pages`` has ``host, html``. Null html is an empty page; repeated rows count once; hosts
    without such nodes have no row, and an empty table gives an empty result.
    """
    values = cut(node_values(pages).distinct())
    count = F.count(F.lit(1)).alias("n")
    own = importance(values.groupBy("host", "node", "kind", "value").agg(count), ["host", "node"])
    all_hosts = values.select("page", "node", "kind", "value").distinct().groupBy("node", "kind", "value").agg(count)
    low = importance(all_hosts, ["node"]).where(F.col("importance") < LEAST_IMPORTANCE).select("node", F.lit(True).alias("low"))
    return (
        own.join(low, "node", "left")
        .where((F.col("importance") < LEAST_IMPORTANCE) | F.col("low"))
        .groupBy("host")
        .agg(F.collect_list("node").alias("nodes"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, tree_blocks`` of every row of ``page_id, url, html``.

    ``tree_blocks``: blocks that tags and names alone would have kept and the trees took. Null
    html is an empty page with an empty text. A null URL, or one without host, belongs to the
    empty host, whose pages share no style tree. Repeated rows come back as often, null ids
    stay, an empty table gives an empty result, extra columns are ignored.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    noise = cut(noise_nodes(rows.where("host <> ''").select("host", "html")))
    if (noise.agg(F.sum(F.size("nodes"))).first()[0] or 0) <= BROADCAST_NODES:
        noise, _ = broadcast_if_small(noise, BROADCAST_HOSTS)
    joined = rows.join(noise, "host", "left").select("page_id", "url", "html", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extracted(html.as_py(), frozenset(nodes.as_py() or ())) for html, nodes in zip(batch.column(2), batch.column(3))]
            texts = pa.array([t for t, _ in found], pa.string())
            counts = [pa.array(x, pa.int64()) for x in ([len(t) for t, _ in found], [n for _, n in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, *counts], names=["page_id", "url", "text", "n_chars", "tree_blocks"])

    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long, tree_blocks long")
