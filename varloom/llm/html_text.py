"""Main text of web pages by composite text density.

Each page becomes a tree. Scripts, styles, hidden elements, menus, asides and footers are no part of an article. Other elements that a
role, class or id marks as notice, advert, form, share bar and the like are only suspected: they go unless they hold the page's article
or main element or most of its plain (unlinked) text, so that no word of a class can take the article away. Reader comments
go unless they hold the article or the page's first heading.

Every node gets its composite text density: characters per tag, scaled down by the share of linked characters and tags, the page's own
link ratio setting the scale. The subtree whose children's densities have the largest sum is the article, widened to the article or
main element around it; subtrees beside the path from body to it join in if they are at least as dense as the least dense node of that
path, and headings before them.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order.

Edge cases: null, empty or text-free html gives an empty text; unclosed, crossed or truncated markup is repaired as browsers do for
paragraphs and list items, or closed at the end; nothing recurses or walks back over the open elements, so that depth is no limit and
time grows with the page's length; repeated rows are read one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw text, that stand as blocks, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("html body li td th tr tbody thead tfoot caption dd dt option optgroup legend summary".split()) | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element closes when it starts while one of these is open, up to the given container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

#: Elements, roles and words of class or id that are no part of an article. CUT go in any case; SUSPECT, by element, role or
#: word, unless they hold the article.
CUT_TAGS = frozenset("head script style noscript template iframe object embed svg canvas audio video button input select textarea nav aside footer menu dialog title".split())
SUSPECT_TAGS = frozenset("form fieldset".split())
SUSPECT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
SUSPECT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay widget toolbar pagination pager login signup register copyright disclaimer skip".split())
#: Words that say where or how a suspect stands, not what it is.
PLACE_WORDS = frozenset("site page main top bottom left right upper lower head body box bar wrap wrapper container inner outer list lists item items block section area region col column row slot unit zone link links button buttons btn icon icons text content primary secondary global mobile desktop sticky fixed floating small large wide mini first last js id".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
CONTAINERS = frozenset(("article", "main"))
KEPT, SUSPECT, COMMENTS, CUT = range(4)
#: The share of the page's plain text beyond which a suspect stays: on pages without and with an article or main element.
MOST, MOST_BESIDE = 0.5, 0.9

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z|(?=['\"]))|[^<]+|<", re.S)
MARKS = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
WORDS = re.compile(r"[a-z0-9]+")
#: Inline end tags do not close these.
WALLS = CONTAINERS | {"td", "th", "table"}


class Node:
    __slots__ = ("tag", "parent", "kids", "mark", "inside", "holds", "heads", "gone", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int = KEPT):
        self.tag, self.parent, self.mark, self.kids = tag, parent, mark, []
        #: Whether it stands in an article or main element.
        self.inside = parent is not None and (parent.inside or parent.tag in CONTAINERS)
        self.holds = self.heads = self.gone = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def suspicious(token: str) -> bool:
    """Whether a class or id names a suspect: by the last of its words, or by one of them if the rest only say where it stands. So
    `cookie-policy-banner` and `footer-links` are suspects, `notice-board-history` is not."""
    words = [w for w in WORDS.findall(token) if not w.isdigit()]
    return bool(words) and (words[-1] in SUSPECT_WORDS or any(w in SUSPECT_WORDS for w in words) and all(w in SUSPECT_WORDS or w in PLACE_WORDS for w in words))


def mark_of(tag: str, attributes: str, inside: bool) -> int:
    """inside: whether the element stands in an article or main element, whose header is a part of it."""
    if tag in CUT_TAGS:
        return CUT
    out = SUSPECT if tag in SUSPECT_TAGS or tag == "header" and not inside else KEPT
    if not attributes or tag in ("html", "body"):
        return out
    for m in MARKS.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return CUT
        if name == "role" and value in SUSPECT_ROLES:
            out = max(out, SUSPECT)
        if name in ("class", "id"):
            words = set(WORDS.findall(value))
            if words & COMMENT_WORDS:
                out = max(out, COMMENTS)
            elif tag not in CONTAINERS and (any(map(suspicious, value.split())) or "header" in words and not inside and tag not in HEADINGS):
                out = max(out, SUSPECT)
    return out if tag != "main" else KEPT


class Open:
    """The open elements: a stack, with the places of each tag and of the blocks in it."""

    def __init__(self, root: Node):
        self.stack, self.blocks = [root], []
        self.places: dict[str, list[int]] = {}

    def push(self, n: Node) -> None:
        self.places.setdefault(n.tag, []).append(len(self.stack))
        if n.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(n)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of these; 0 without."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, tags, after: int) -> int:
        """The place of the outermost open element of these after a place; 0 without."""
        found = []
        for t in tags:
            at = self.places.get(t, ())
            k = bisect.bisect_right(at, after)
            if k < len(at):
                found.append(at[k])
        return min(found, default=0)


def tree(page: str) -> Node:
    root = Node("#root", None)
    now = Open(root)
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        close, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                now.stack[-1].kids.append(text)
            continue
        tag = tag.lower()
        if not m[0].endswith(">") and at >= end:
            break  # cut off inside a tag
        if close:
            place = now.last((tag,))
            if place and (tag in BLOCK or tag in WALLS or now.last(WALLS) < place):
                now.cut(place)
            elif tag == "p" and not place:
                now.stack[-1].kids.append(Node("p", now.stack[-1]))
            continue
        if tag in ENDS_P and now.blocks and now.stack[now.blocks[-1]].tag == "p":
            now.cut(now.blocks[-1])
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            place = now.outermost(closed, now.last(within))
            if place:
                now.cut(place)
        parent = now.stack[-1]
        new = Node(tag, parent)
        new.mark = mark_of(tag, attributes, new.inside)
        parent.kids.append(new)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at)
            at = page.find(">", stop.end())
            at = end if at < 0 or stop.start() == end else at + 1
        elif tag not in VOID and not attributes.endswith("/") or tag not in VOID and tag in BLOCK:
            now.push(new)
    return root


def in_order(root: Node) -> list[Node]:
    """The nodes that may belong to an article, parents before children; those that go are marked as gone."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo.extend(k for k in reversed(n.kids) if isinstance(k, Node) and k.mark != CUT)
    plain, first = {}, next((n for n in nodes if n.tag == "h1"), None)
    for n in reversed(nodes):  # unlinked characters, without those of comments
        own = sum(len(k) - k.count(" ") for k in n.kids if isinstance(k, str) and not k.isspace())
        plain[id(n)] = plain.get(id(n), 0) + own
        up = n.parent
        if up is None:
            continue
        if n.tag in CONTAINERS and n.mark == KEPT or n.holds:
            up.holds = True
        if n is first or n.heads:
            up.heads = True
        if n.tag != "a" and n.mark != COMMENTS:
            plain[id(up)] = plain.get(id(up), 0) + plain[id(n)]
    most = (MOST_BESIDE if root.holds else MOST) * plain[id(root)]
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        for k in reversed(n.kids):
            if isinstance(k, Node):
                k.gone = k.mark == CUT or k.mark == SUSPECT and not k.holds and plain[id(k)] <= most or k.mark == COMMENTS and not (k.holds or k.heads)
                if not k.gone:
                    todo.append(k)
    return out


def composite(n: Node, ratio: float) -> float:
    """Composite text density; ratio: the body's linked share of its characters."""
    if not n.chars:
        return 0.0
    tags, links, link_tags = n.tags or 1, n.link_chars or 1, n.link_tags or 1
    plain = max(n.chars - n.link_chars, 1)
    base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
    # Without links the base is 1, whose logarithm is 0.
    return n.chars / tags * math.log(max(n.chars / links * tags / link_tags, 1.0)) / max(math.log(base), 0.1)


def article(root: Node) -> list[Node]:
    """The roots of the article's subtrees in page order."""
    nodes = in_order(root)
    kept = set(map(id, nodes))
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(k) - k.count(" ") if k.strip() else 0
            elif id(k) in kept:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.chars if k.tag == "a" else k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
    if not root.chars:
        return []
    ratio = root.link_chars / root.chars
    for n in nodes:
        n.density = composite(n, ratio)
    for n in nodes:
        if n.parent is not None:
            n.parent.total += n.density
    best = max(nodes, key=lambda n: n.total)
    if not best.total:  # text without any element
        return [root]
    while best.tag not in ("body", "html", "#root") and 2 * best.link_chars >= best.chars:  # links tie at no density: the list they stand in
        best = best.parent
    up = best
    while up.parent is not None:
        if up.tag in CONTAINERS:
            best = up
        up = up.parent
    path, up = [], best
    while up is not None and up.tag not in ("html", "#root"):
        path.append(up)
        up = up.parent
    if best.tag in CONTAINERS or not path:
        return [best]
    threshold = min(n.density for n in path)
    chosen, on_path = [], set(map(id, path))
    todo = [path[-1]]
    while todo:
        n = todo.pop()
        if n is best or id(n) not in on_path and n.density >= threshold and 2 * n.link_chars < n.chars:
            chosen.append(n)
        elif id(n) in on_path:
            after = [k for k in n.kids if isinstance(k, Node) and id(k) in kept]
            last = next(i for i, k in enumerate(after) if id(k) in on_path)
            chosen.extend(k for k in after[:last] if k.tag in HEADINGS and k.density < threshold)
            todo.extend(reversed([k for k in after if k.tag not in HEADINGS or k.density >= threshold or id(k) in on_path]))
    place = {id(n): i for i, n in enumerate(nodes)}
    return sorted(chosen, key=lambda n: place[id(n)])


def text_of(roots: list[Node]) -> str:
    blocks, now = [], []

    def cut() -> None:
        if now:
            text = " ".join("".join(now).split())
            if text:
                blocks.append(text)
            now.clear()

    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                now.append(_html.unescape(x))
            elif x is None:
                cut()
            elif x.tag == "br":
                now.append(" ")
            elif not x.gone:
                if x.tag in BLOCK:
                    cut()
                    todo.append(None)
                todo.extend(reversed(x.kids))
        cut()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(article(tree(page))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """pages with out_col, the main text."""
    own = [c for c in pages.columns if c != out_col]
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in own] + [f"`{out_col}` string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = pa.array([main_text(h.as_py()) for h in batch.column(names.index(html_col))], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in own), texts], names=[*own, out_col])

    return pages.mapInArrow(run, ", ".join(fields))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
