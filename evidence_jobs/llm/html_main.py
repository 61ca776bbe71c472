"""Main text of web pages by wrapper induction over pages of the same host.

Every page of a host is aligned with another one by simple tree matching. What stays
equal in aligned places is constant; what differs varies. Summed up over all pages of
the host, this gives its wrapper: the content slot, which is the innermost container that
holds most of the varying text, and the constant leaves. The rest is template.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from evidence_jobs.llm.common import column, packed, saved, slices, unpacked

#: Bytes of markup that are aligned in one group, about; a larger host has several groups.
GROUP_BYTES = 512 << 10
#: Wrappers up to this many bytes are broadcast; larger tables are joined by host.
BROADCAST_BYTES = 32 << 20
#: The content slot holds at least this share of a host's varying text; a constant leaf stands on this share of its different stories, and on so many of them.
SLOT_SHARE, CONSTANT_SHARE, CONSTANT_STORIES = 0.6, 0.5, 4
#: Two pages with this share of their text in common are near copies.
NEAR_COPY = 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the left closes open tags of the right, up to the container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
}
#: Elements that hold no main text by their kind.
DROP_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg canvas button select textarea dialog menu title object embed audio video map".split())
#: A class or id made of these words alone (and of PLAIN_WORDS) hints at a menu, header, footer, sidebar, notice, advert, form or comment list.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead sidebar side aside cookie cookies consent notice notices gdpr privacy popup modal overlay newsletter subscribe subscription signup "
    "share sharing social comment comments commentlist disqus replies reply respond reactions related recommended recommendations widget widgets toolbar "
    "skip login search form copyright pager pagination alert toast".split()
)
PLAIN_WORDS = frozenset("site main page top bottom left right list box bar block container wrapper wrap inner outer area group row col item items links link buttons button icons posts articles section global primary secondary the my js id".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond reactions".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
MAIN_TAGS = ("article", "main")
#: Elements that can be a host's content slot, and those that class words never drop.
CONTAINERS = frozenset("html body main article section div center table tbody tr td form".split())
TEXT_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6 p li td pre blockquote figure figcaption span b i em strong a code".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>\"']*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


@lru_cache(maxsize=4096)
def label_of(tag: str, classes: str) -> str:
    return f"{tag}.{_DIGITS.sub('0', classes)}"


class Node:
    """An element, or a text leaf with tag '#'.

    label: tag and class without digits; path: hash of the labels down to it; chars: of
    its text; main: whether it is, or holds, an article or main element; shape: a number
    for its labels and those of all below; parent: the element around it; depth: below the root.
    """

    __slots__ = ("tag", "attributes", "children", "text", "label", "path", "chars", "main", "shape", "parent", "depth", "varying")

    def __init__(self, tag: str, attributes: dict | None = None, text: str = ""):
        self.tag, self.attributes, self.children, self.text = tag, attributes or {}, [], text
        self.label = label_of(tag, attributes["class"]) if attributes and "class" in attributes else tag
        self.path, self.chars, self.main, self.shape, self.parent, self.depth, self.varying = 0, 0, False, 0, None, 0, 0


class Scanner:
    """The tags of a text in order, each found in one pass over it, however broken.

    From a place outside of quotes a tag's end is settled by the next quote or `>`, so
    a place that led to no end once never does: such places are remembered, and no
    stretch of the text is read more than once for tags that never end.
    """

    def __init__(self, html: str):
        self.html, self.last_end, self.no_end = html, html.rfind(">"), set()
        self.next_special = (0, -1)

    def special(self, at: int) -> int:
        """The next quote or `>` from here, -1 if none."""
        low, high = self.next_special
        if not low <= at <= high:
            found = _SPECIAL.search(self.html, at)
            self.next_special = low, high = at, found.start() if found else len(self.html)
        return high if high < len(self.html) else -1

    def end_of_tag(self, at: int) -> int:
        """The place of the `>` that ends the tag around here, -1 if there is none."""
        html, seen = self.html, []
        while at <= self.last_end:
            place = self.special(at)
            if place < 0 or place in self.no_end:
                break
            if html[place] == ">":
                return place
            seen.append(place)
            closing = html.find(html[place], place + 1)
            if closing < 0:
                break
            at = closing + 1
        self.no_end.update(seen)
        return -1

    def token(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, tag or None, whether it closes, attributes' text) of the next comment, declaration or tag."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), None, False, ""
            if html.startswith(("<!", "<?"), start):
                if start < self.last_end:
                    return start, html.find(">", start) + 1, None, False, ""
            elif (name := _NAME.match(html, at)) and (end := self.end_of_tag(name.end())) >= 0:
                return start, end + 1, name[1].lower(), html[at] == "/", html[name.end() : end]
        return None


class Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 if none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, until) -> None:
        """Ends the innermost element of the tags, if none of `until` is open inside of it."""
        place = self.last(tags)
        if place > self.last(until):
            for node in reversed(self.nodes[place:]):
                self.places[node.tag].pop()
            del self.nodes[place:]


#: Closing tags of these don't reach out of an open element of BARRIERS; a new block ends an open p up to PARAGRAPH_ENDS.
INNER, BARRIERS = frozenset(("p", "b", "i", "span", "a", "em", "strong", "li")), ("article", "main", "body", "table")
PARAGRAPH_ENDS = ("article", "main", "body", "div", "section", "td", "li", "blockquote")


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>|\Z", re.I)


def parse(html: str | None) -> Node:
    """A tree of any markup, however broken, in time linear in its length; unclosed tags end with their container."""
    html = html or ""
    root = Node("#root")
    scanner, opened, at = Scanner(html), Open(root), 0

    def leaf(text: str) -> None:
        if text:
            opened.nodes[-1].children.append(Node("#", text=unescape(text)))

    while token := scanner.token(at):
        start, end, tag, closing, rest = token
        leaf(html[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            opened.close((tag,), BARRIERS if tag in INNER else ())
            continue
        if tag in BLOCK:
            opened.close(("p",), PARAGRAPH_ENDS)
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        node = Node(tag, attributes)
        opened.nodes[-1].children.append(node)
        if tag in RAW:
            at = _raw_end(tag).search(html, at).end()
        elif tag not in VOID and not (rest.endswith("/") and tag not in BLOCK):
            opened.push(node)
    leaf(html[at:])
    return root


def annotated(root: Node) -> list[Node]:
    """All nodes in page order, with path, parent, chars and main set; no recursion, however deep the markup."""
    order, stack, paths = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        path, depth = node.path, node.depth + 1
        for child in node.children:
            child.parent, child.depth = node, depth
            if child.tag == "#":
                child.path = path
            else:
                key = (path, child.label)
                child.path = paths[key] if key in paths else paths.setdefault(key, xxh3_64_intdigest(f"{path}/{child.label}"))
        stack += node.children[::-1]
    for node in reversed(order):
        if node.tag == "#":
            node.chars = len(node.text.strip())
        else:
            node.main = node.main or node.tag in MAIN_TAGS or node.attributes.get("role") == "main"
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.main = node.parent.main or node.main
    return order


def class_words(node: Node) -> list[set[str]]:
    """The lower-case words of each class and of the id."""
    a = node.attributes
    return [{w.lower() for w in _WORD.findall(token)} for token in [*a.get("class", "").split(), *a.get("id", "").split()]]


def is_comments(node: Node) -> bool:
    return bool(node.attributes) and node.tag not in TEXT_TAGS and any(words & COMMENT_WORDS and words <= DROP_WORDS | PLAIN_WORDS for words in class_words(node))


def dropped(node: Node, in_main: bool, page_chars: int) -> bool:
    """Whether an element is of a kind that holds no main text, by its tag, role, or class words.

    Words count only if they make up a whole class or id. Hints never drop an element
    that holds the main element or over half of the page's text; comment lists always go.
    """
    a = node.attributes
    holds_most = node.main or 2 * node.chars > page_chars
    if node.tag in DROP_TAGS and not (node.tag == "form" and holds_most) or node.tag == "header" and not in_main and not node.main:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if is_comments(node):
        return True
    if holds_most:
        return False
    if a.get("role", "").lower() in DROP_ROLES:
        return True
    kinds = DROP_WORDS - {"header"} if in_main else DROP_WORDS
    return node.tag not in TEXT_TAGS and any(words & kinds and words <= DROP_WORDS | PLAIN_WORDS for words in class_words(node))


def leaf_key(path: int, text: str) -> int:
    """Of a leaf's place and words, as a signed 64-bit number."""
    return xxh3_64_intdigest(f"{path} {text.strip()}") - 2**63


def text_of(node: Node, template: frozenset | set = frozenset(), hints: bool = True, page_chars: int = 0) -> str:
    """The text below a node in page order: blocks joined by a space, constant leaves and dropped kinds left out."""
    parts: list[str] = []
    inside = False
    up = node.parent
    while up is not None:
        inside, up = inside or up.tag in MAIN_TAGS, up.parent
    stack = [(node, inside, False)]
    while stack:
        now, in_main, closing = stack.pop()
        if closing or now.tag == "br":
            parts.append(" ")
        elif now.tag == "#":
            parts.append(" " if template and now.chars and leaf_key(now.path, now.text) in template else now.text)
        elif now is not node and (dropped(now, in_main, page_chars) if hints else now.tag in RAW or now.tag == "head"):
            parts.append(" " if now.tag in BLOCK else "")
        else:
            in_main = in_main or now.tag in MAIN_TAGS
            if now.tag in BLOCK:
                parts.append(" ")
                stack.append((now, in_main, True))
            stack += [(c, in_main, False) for c in reversed(now.children)]
    return " ".join("".join(parts).split())


def main_text(html: str | None, slot: int | None = None, template: frozenset | set = frozenset(), hints: bool = True) -> str:
    """The page's main text: its content slot without constant leaves.

    A slot inside an article or main element stands for that element. A page without the
    host's slot, or with its main element elsewhere, gives what its main elements hold,
    or else what is left when dropped kinds go.
    """
    root = parse(html)
    order = annotated(root)
    found: list[Node] = []
    for node in order if slot is not None else []:
        if node.tag == "#" or node.path != slot:
            continue
        up, outer = node, None
        while up is not None:
            outer, up = up if up.tag in MAIN_TAGS else outer, up.parent
        if (outer or node) not in found:
            found.append(outer or node)
    if root.main and not any(n.main or n.tag in MAIN_TAGS for n in found):
        found = []
    texts = [text_of(n, template, hints, root.chars) for n in found]
    if any(texts):
        if not any(n.main for n in found):  # the title may stand beside the slot
            inside = {id(n) for n in found}
            for node in order:
                if id(node) in inside:
                    break
                if node.tag == "h1" and not any(id(x) in inside for x in _above(node)) and not any(hints and dropped(x, False, root.chars) for x in _above(node)):
                    texts.insert(0, text_of(node, template, hints, root.chars))
                    break
        return " ".join(t for t in texts if t)
    mains = [n for n in order if n.tag in MAIN_TAGS and not any(x.tag in MAIN_TAGS or hints and dropped(x, False, root.chars) for x in _above(n)[1:])]
    texts = [text_of(n, template, hints, root.chars) for n in mains]
    return " ".join(t for t in texts if t) or text_of(root, template, hints, root.chars)


def _above(node: Node) -> list[Node]:
    """The node and what is around it, from the inside."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


class Shapes:
    """Simple tree matching between shapes.

    The largest top-down, order-keeping match of two trees hangs on their labels alone, so
    equal shapes are matched once. weight() is the size of that match; aligned() gives the
    pairs of two child lists that make it up.
    """

    def __init__(self):
        self.ids, self.labels, self.kids, self.sizes, self.known = {}, [], [], [], {}

    def number(self, order: list[Node]) -> None:
        for node in reversed(order):
            kids = tuple(c.shape for c in node.children)
            node.shape = self.ids.setdefault((node.label, kids), len(self.labels))
            if node.shape == len(self.labels):
                self.labels.append(node.label)
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))

    def _middle(self, a: tuple, b: tuple) -> tuple[int, int]:
        """How many shapes at the start and at the end are equal; these match each other in a largest match."""
        most = min(len(a), len(b))
        start = next((i for i in range(most) if a[i] != b[i]), most)
        end = next((i for i in range(most - start) if a[-1 - i] != b[-1 - i]), most - start)
        return start, end

    def _known(self, x: int, y: int) -> int:
        return self.sizes[x] if x == y else self.known.get((x, y), 0)

    def _table(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ours, i = np.unique(a, return_inverse=True)
        theirs, j = np.unique(b, return_inverse=True)
        table = np.array([[self._known(x, y) for y in theirs.tolist()] for x in ours.tolist()], np.int64)
        return table, i, j

    @staticmethod
    def _totals(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The best total of all of i with every prefix of j."""
        best = np.zeros(len(j) + 1, np.int64)
        for x in i:
            step = best.copy()
            step[1:] = np.maximum(best[1:], best[:-1] + table[x][j])
            best = np.maximum.accumulate(step)
        return best

    def weight(self, a: int, b: int) -> int:
        """The size of the largest match, worked out from the leaves up without recursion."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if x == y or (x, y) in self.known or self.labels[x] != self.labels[y]:
                stack.pop()
                continue
            left, right = self.kids[x], self.kids[y]
            start, end = self._middle(left, right)
            whole = sum(self.sizes[k] for k in left[:start]) + sum(self.sizes[k] for k in left[len(left) - end :])
            left, right = left[start : len(left) - end], right[start : len(right) - end]
            open_ = [(k, m) for k in set(left) for m in set(right) if k != m and self.labels[k] == self.labels[m] and (k, m) not in self.known]
            if open_:
                stack += open_
                continue
            if min(len(left), len(right)) <= 1:
                middle = max((self._known(k, m) for k in left for m in right), default=0)
            else:
                middle = int(self._totals(*self._table(left, right))[-1])
            self.known[x, y] = 1 + whole + middle
            stack.pop()
        return self._known(a, b)

    def aligned(self, a: tuple, b: tuple) -> list[tuple[int, int]]:
        """Positions of the child lists that the largest match pairs, in linear memory: halves of a meet the best halves of b."""
        start, end = self._middle(a, b)
        out = [(k, k) for k in range(start)] + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
        left, right = a[start : len(a) - end], b[start : len(b) - end]
        if min(len(left), len(right)) <= 1:
            best = max(((self._known(x, y), -i, -j) for i, x in enumerate(left) for j, y in enumerate(right)), default=(0, 0, 0))
            return [*out, (start - best[1], start - best[2])] if best[0] else out
        table, i, j = self._table(left, right)
        parts = [(0, len(i), 0, len(j))]
        while parts:
            low, high, first, last = parts.pop()
            if low == high or first == last:
                continue
            if high - low == 1:
                own = table[i[low]][j[first:last]]
                if own.max() > 0:
                    out.append((start + low, start + first + int(own.argmax())))
                continue
            half = (low + high) // 2
            before = self._totals(table, i[low:half], j[first:last])
            after = self._totals(table, i[half:high][::-1], j[first:last][::-1])[::-1]
            cut = first + int((before + after).argmax())
            parts += [(low, half, first, cut), (half, high, cut, last)]
        return out


def tree_match(a: Node, b: Node, shapes: Shapes) -> list[tuple[Node, Node]]:
    """The leaf pairs of the largest match of two trees."""
    pairs, stack = [], [(a, b)]
    shapes.weight(a.shape, b.shape)
    while stack:
        x, y = stack.pop()
        if x.tag == "#":
            pairs.append((x, y))
            continue
        if x.children and y.children:
            stack += [(x.children[i], y.children[j]) for i, j in shapes.aligned(shapes.kids[x.shape], shapes.kids[y.shape])]
    return pairs


_FOUND = pa.schema([("_host", pa.string()), ("slot", pa.bool_()), ("key", pa.int64()), ("depth", pa.int32()), ("varying", pa.int64()), ("nodes", pa.int64()), ("pages", pa.int64()), ("story", pa.int64())])
_FOUND_DDL = "_host string, slot boolean, key long, depth int, varying long, nodes long, pages long, story long"


def _read(html: str, shapes: Shapes) -> tuple[Node, list[Node]]:
    tree = parse(html)
    order = annotated(tree)
    shapes.number(order)
    return tree, order


def slot_votes(pages: list[str]) -> tuple[dict[int, list[int]], set[tuple[int, int]]]:
    """What aligning each page with the next one says: by path of a container its depth, varying characters, nodes and pages; and (leaf key, story) of constant leaves.

    Equal pages are one. A page's story is its longest varying leaf, and a page that hardly
    differs from the next one has no vote on constants, so near copies of an article can't
    make it template. Text of links and of comment lists does not count as varying.
    """
    slots: dict[int, list[int]] = {}
    constant: set[tuple[int, int]] = set()
    html = sorted(dict.fromkeys(pages), key=lambda h: xxh3_64_intdigest(h))
    if len(html) < 2:
        return slots, constant
    shapes = Shapes()
    for at in range(len(html) + 1):
        tree, order = first if at == len(html) else _read(html[at], shapes)  # noqa: F821
        if at == 0:
            first = tree, order
        else:
            _compare(before, nodes, order, tree_match(before, tree, shapes), slots, constant)  # noqa: F821
        before, nodes = tree, order
    return slots, constant


def _compare(page: Node, order: list[Node], following: list[Node], pairs: list[tuple[Node, Node]], slots: dict, constant: set) -> None:
    """Add what one page and the following one say. A leaf is constant if the slot it stands in, or the list of alike slots, holds the same text there."""
    slots_met = {x.path for x, _ in pairs}
    there = {(n.path, n.text.strip()) for n in following if n.chars and n.tag == "#"}
    seen = [n for n in order if n.tag == "#" and n.chars]
    same = {id(n) for n in seen if n.path in slots_met and (n.path, n.text.strip()) in there}
    # Near copies of a page say nothing about what is template.
    voting = sum(n.chars for n in seen if id(n) in same) < NEAR_COPY * sum(n.chars for n in seen)
    story = xxh3_64_intdigest(max((n.text.strip() for n in seen if id(n) not in same), key=len, default="")) - 2**63
    own: dict[int, list[int]] = {}
    silent: set[int] = set()
    for node in order:
        if node.parent is not None and id(node.parent) in silent or node.tag in RAW or node.tag in ("head", "a") or is_comments(node):
            silent.add(id(node))
        node.varying = node.chars if node.tag == "#" and id(node) not in silent and id(node) not in same else 0
        if voting and id(node) in same:
            constant.add((leaf_key(node.path, node.text), story))
    for node in reversed(order):
        node.varying += sum(c.varying for c in node.children)
        if node.varying and (node.tag in CONTAINERS or node is page):
            slot = own.setdefault(node.path, [node.depth, 0, 0])
            slot[1] += node.varying
            slot[2] += 1
    for path, (depth, varying, nodes) in own.items():
        total = slots.setdefault(path, [depth, 0, 0, 0])
        total[1], total[2], total[3] = total[1] + varying, total[2] + nodes, total[3] + 1


def _group_votes(table: pa.Table) -> pa.Table:
    host = table.column("_host")[0].as_py()
    slots, constant = slot_votes(table.column("html").to_pylist())
    rows = [(host, True, path - 2**63, *rest, None) for path, rest in slots.items()] + [(host, False, key, None, None, None, None, story) for key, story in constant]
    columns = zip(*rows, strict=True) if rows else [[] for _ in _FOUND]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def host_of(url: str):
    """Lower-cased host of a URL column; null or odd URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(column(url), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its rows come to BROADCAST_BYTES at most."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(_host, _slot, _template): the content slot's path and the keys of constant leaves, from all pages of each host.

    The pages of a host are dealt into groups of about GROUP_BYTES; within a group each
    page is aligned with the next one by hash. Only sums by path and (leaf, story) pairs
    leave a group, and they are added up by host and key, never host by host.
    """
    rows = pages.where(column(html).isNotNull()).select(host_of(url).alias("_host"), column(html).alias("html"))
    groups = F.ceil(F.sum(F.octet_length("html")) / GROUP_BYTES).cast("int")
    several = saved(rows.groupBy("_host").agg(groups.alias("groups")).where("groups > 1"))
    dealt = rows.join(small(several, 128), "_host", "left").withColumn("group", F.pmod(F.xxhash64("html"), F.coalesce("groups", F.lit(1))))
    found = saved(dealt.groupBy("_host", "group").applyInArrow(_group_votes, _FOUND_DDL))

    slots = found.where("slot").groupBy("_host", "key").agg(F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("varying", "nodes", "pages")))
    totals = slots.where(F.col("key") == -(2**63)).select("_host", F.col("varying").alias("total"))
    most = (F.col("varying") >= SLOT_SHARE * F.col("total")) & (2 * F.col("nodes") <= 3 * F.col("pages"))
    # Slots with over half of the text are nested, so the deepest is one.
    chosen = slots.join(totals, "_host").where(most).groupBy("_host").agg(F.max_by("key", "depth").alias("_slot"))

    stories = found.where("not slot").select("_host", "key", "story").distinct()
    known = stories.select("_host", "story").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("stories"))
    often = stories.groupBy("_host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONSTANT_STORIES)
    leaves = often.join(known, "_host").where(F.col("n") >= CONSTANT_SHARE * F.col("stories"))
    template = leaves.groupBy("_host").agg(F.sort_array(F.collect_list("key")).alias("_template"))  # as many as two pages have leaves, at most
    return chosen.join(template, "_host", "full")


def extract_main(pages: DataFrame, url: str = "url", html: str = "html", hints: bool = True) -> DataFrame:
    """pages with `text`, the main text ("" if none), and `n_chars` long, its code points; html goes.

    The wrapper of a host comes from all of its pages and is applied to each. Pages of
    hosts with one page rely on main elements and on the kinds of elements. Null html
    gives "". However deep, long or broken, markup has a tree; repeated rows each keep a
    row; an empty table stays empty; other columns are kept, whatever their names, and
    those named text or n_chars are replaced.
    """
    names = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    learnt = saved(wrappers(pages, url, html))
    size = learnt.agg(F.coalesce(F.sum(8 * F.greatest(F.size("_template"), F.lit(0)) + 64), F.lit(0))).first()[0]
    rows = pages.select(packed(pages, names).alias("_row"), column(html).alias("_html"), host_of(url).alias("_host"))
    joined = rows.join(F.broadcast(learnt) if size <= BROADCAST_BYTES else learnt, "_host", "left").select("_row", "_html", "_slot", "_template")

    def extract(batches):
        known: dict[tuple, frozenset] = {}
        for batch in slices(batches):
            out = []
            for page, slot, template in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                key = tuple(template or ())
                if len(known) > 256:
                    known.clear()
                out.append(main_text(page, None if slot is None else slot + 2**63, known.setdefault(key, frozenset(key)), hints))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["_row", "text", "n_chars"])

    done = joined.mapInArrow(extract, joined.select("_row").schema.add("text", "string").add("n_chars", "long"))
    return done.select(*unpacked("_row", names), "text", "n_chars")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
