"""HTML extraction: the main text of a page, by composite text density.

Every page is parsed into a tree of blocks (block-level elements, and the runs of text and inline
elements between them). Each node has its characters C, tags T, link characters LC and link tags LT;
its density is C / T, weighted down by the share of links as composite text density does. The
node whose children's densities sum highest is the article; the lowest density on the path from the
body to it is the threshold at which blocks beside it belong to the text too, each again by the
highest sum below it and only with a third of the article's sum or more. Where the chosen node lies in an
article element, that element is taken whole; headings right before it belong to it. Pages are parsed one by one inside Arrow batches; nothing is shuffled.

Left out before densities are taken: scripts, styles, forms and other elements without prose,
navigation, headers of the page, footers and asides, and elements whose class, id or role names a
menu, notice, advert, sidebar, comment or the like (`NOISE`, by whole words of the name). If nothing
else holds text, the text is empty. A block with two links or more, more than two thirds of whose
characters are links and whose density is below the threshold, is left out of the article as well.

Text: character references decoded, white space inside a block one space, blocks in page order
joined by a line feed. `<br>` is white space.

Odd input: null and empty html give an empty text; html without tags is one block; tags that aren't
closed end with their parent, comments, tags and quoted attributes that aren't closed go as text or end with the
page as browsers do; null and repeated page_ids keep a row each; extra columns don't matter. Work is
linear in the length of a page, of any length and depth, and so is the memory of one page.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessel.llm.common import small_batches, table

#: Elements without prose of their own; their content goes with them. Fixed values.
DROPPED = frozenset("script style noscript template form button select option textarea input iframe object embed svg math canvas audio video map head title nav footer aside dialog menu".split())
#: Elements whose content is text up to their end tag. Fixed values.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that never have content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: An open element of the value is closed by a start tag of the key. Fixed values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
#: Elements beyond which a start tag closes nothing. Fixed values.
SCOPE = frozenset("html body table ul ol dl div article section main aside nav form blockquote header footer".split())
#: Block-level elements that end a paragraph. Fixed values.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Words of class, id and role that name what isn't the article. Fixed values.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adbox sponsor sponsored sponsors promo promos promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert subscribe subscription newsletter signup login paywall "
    "comment comments commentlist disqus replies respond sidebar rail aside widget widgets related recommended recommendations popular trending share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager toolbar masthead topbar footer colophon copyright legal disclaimer skip search complementary contentinfo hidden".split()
)

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the article's density sum from which a block beside it is another part of it.
PART = 1 / 3

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Node:
    """An element or, with `tag` None, a run of text; `texts` holds the pieces of a run."""

    __slots__ = ("chars", "density", "drop", "kids", "link_chars", "link_tags", "raw_links", "sum", "tag", "tags", "texts", "up")

    def __init__(self, tag: str | None, up: Node | None, drop: bool = False):
        self.tag, self.up, self.drop, self.kids, self.texts = tag, up, drop, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = self.raw_links = 0
        self.density = self.sum = 0.0


def noisy(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't part of an article; a header inside an article is."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if not attributes:
        return False
    for found in _NAMES.finditer(attributes):
        for word in _WORD.findall(next(g for g in (*found.groups(), "") if g is not None)):
            if word.lower() in NOISE:
                return True
    return _HIDDEN.search(attributes) is not None


def parse(page: str) -> Node:
    """The tree of blocks of a page below its body; text of inline elements lies in runs."""
    top = Node("body", None)
    # Open elements, innermost last: (tag, node that takes its content). Inline elements share their block's node.
    stack: list[tuple[str, Node]] = [("body", top)]
    count: dict[str, int] = {"body": 1}
    run: Node | None = None
    skip: list[str] = []

    def close(depth: int) -> None:
        nonlocal run
        while len(stack) > depth:
            tag, _ = stack.pop()
            count[tag] -= 1
            if tag not in INLINE:
                run = None

    def text(piece: str) -> None:
        nonlocal run
        if run is None:
            if not piece or piece.isspace():
                return
            run = Node(None, stack[-1][1])
            run.up.kids.append(run)
        run.texts.append(piece)
        if count.get("a"):
            run.raw_links += len(piece.strip())

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            break
        if found.start() > at and not skip:
            text(html.unescape(page[at : found.start()]) if "&" in page[at : found.start()] else page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag, closing = tag.lower(), found.group(1)
        if not closing and tag in RAW:
            # Its content is no markup; only its own end tag ends it.
            last = _end_tag(tag).search(page, at)
            at = last.end() if last else end
            continue
        if skip:
            # Inside an element that is left out only its own name counts.
            if tag == skip[-1]:
                if closing:
                    skip.pop()
                elif tag not in VOID and not found.group(3).endswith("/"):
                    skip.append(tag)
            continue
        if closing:
            if tag == "p" and not count.get("p"):
                run = None
            elif count.get(tag) and tag not in ("body", "html"):
                depth = len(stack) - 1
                while stack[depth][0] != tag and (tag in SCOPE or stack[depth][0] not in SCOPE):
                    depth -= 1
                if stack[depth][0] == tag:
                    close(depth)
            continue
        if tag in ("html", "body"):
            run = None
            continue
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        if tag in ENDS_P and count.get("p") or tag in CLOSES:
            ends, depth = ("p",) if tag in ENDS_P else CLOSES[tag], len(stack)
            lowest = depth
            while depth > 1:
                depth -= 1
                if stack[depth][0] in ends:
                    lowest = depth
                elif stack[depth][0] in SCOPE:
                    break
            close(lowest)
        if noisy(tag, found.group(3), bool(count.get("article") or count.get("main"))):
            if tag not in INLINE:
                run = None
            if tag not in VOID and not (found.group(3).endswith("/") and tag in ("svg", "math")):
                skip.append(tag)
            continue
        if tag in VOID:
            if tag not in INLINE:
                run = None
            elif run is not None:
                run.tags += 1
            continue
        if tag in INLINE:
            if tag == "a" and count.get("a"):
                # A link inside a link closes the outer one.
                depth = max(i for i, (t, _) in enumerate(stack) if t == "a")
                if all(t in INLINE for t, _ in stack[depth:]):
                    close(depth)
            node = stack[-1][1]
            if run is None:
                run = Node(None, node)
                node.kids.append(run)
            run.tags += 1
            run.link_tags += tag == "a"
            stack.append((tag, node))
        else:
            run = None
            node = Node(tag, stack[-1][1])
            node.up.kids.append(node)
            stack.append((tag, node))
        count[tag] = count.get(tag, 0) + 1
    if at < end and not skip:
        text(html.unescape(page[at:]))
    return top


_ENDS: dict[str, re.Pattern] = {}


def _end_tag(tag: str) -> re.Pattern:
    return _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I))


def in_order(top: Node) -> list[Node]:
    """All nodes, parents before children, children in page order."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def measure(top: Node) -> list[Node]:
    """Fill in characters, tags, links, densities and density sums of every node; the nodes in page order."""
    nodes = in_order(top)
    for node in reversed(nodes):
        if node.tag is None:
            said = " ".join("".join(node.texts).split())
            node.texts = [said] if said else []
            node.chars, node.link_chars = len(said), min(node.raw_links, len(said))
            node.tags = max(1, node.tags)
        else:
            for kid in node.kids:
                own = kid.tag is not None
                node.chars += kid.chars
                node.link_chars += kid.link_chars
                node.tags += kid.tags + own
                node.link_tags += kid.link_tags
            node.tags = max(1, node.tags)
    share = top.link_chars / top.chars if top.chars else 0.0
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.up is not None:
            node.up.sum += node.density
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, times a logarithm of their ratio to the links'; plain on pages without links."""
    if not chars:
        return 0.0
    plain = chars / tags
    if share <= 0:
        return plain
    base = math.log(chars * link_chars / max(1, chars - link_chars) + share * chars + math.e)
    ratio = chars / max(1, link_chars) * tags / max(1, link_tags)
    return plain * math.log(max(ratio, 1.0)) / math.log(base)


def main_blocks(top: Node) -> list[str]:
    """The blocks of the main text in page order."""
    nodes = measure(top)
    if not top.chars:
        return []
    best = max(nodes, key=lambda n: n.sum)  # the first, so the outermost, of equal ones
    # An article element holds one article: its parts stay together.
    node = best
    while node is not None and node.tag != "article":
        node = node.up
    best = node or best
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.up
    kept = {id(best)}
    # The headings right before it are its own.
    before = best.up.kids[: best.up.kids.index(best)] if best.up is not None else []
    while before and before[-1].tag in HEADINGS and not linked(before[-1]):
        kept.add(id(before.pop()))
    # Beside the path: blocks at or above the threshold, by the highest sum among their own.
    path, node = {id(best)}, best
    while node.up is not None:
        node = node.up
        path.add(id(node))
    todo = [kid for n in nodes if id(n) in path and n is not best for kid in n.kids if id(kid) not in path]
    while todo:
        node = todo.pop()
        # Large parts only, as of an article that is split in two: a line beside the article is no part of it.
        if node.tag is None or node.density < threshold or linked(node):
            continue
        part = max(in_order(node), key=lambda n: n.sum)
        if part.sum >= PART * best.sum:
            kept.add(id(part))
    out: list[str] = []
    walk = [(top, False)]
    while walk:
        node, inside = walk.pop()
        inside = inside or id(node) in kept
        if node.tag is None:
            if inside:
                out += node.texts
            continue
        if inside and node is not best and node.density < threshold and linked(node):
            continue
        walk.extend((kid, inside) for kid in reversed(node.kids))
    return out


def linked(node: Node) -> bool:
    """Whether a block is a list of links rather than prose."""
    return node.link_tags >= 2 and 3 * node.link_chars > 2 * node.chars


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    return "\n".join(main_blocks(parse(page))) if page else ""


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `carry` of every row of `pages` (html), text and n_chars."""
    small_batches(pages.sparkSession)
    kept = pages.select(*[f"`{c}`" for c in carry], "html")
    fields = [f.simpleString().split(":", 1) for f in kept.schema.fields[:-1]]
    schema = ", ".join([f"`{name}` {kind}" for name, kind in fields] + ["text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*[n for n, _ in fields], "text", "n_chars"])

    return kept.mapInArrow(run, schema)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))


#: The pages of the tables hold one plain article each, so there its paragraphs can be cut out by patterns.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(replace(split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1), '<br>', ' '), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
