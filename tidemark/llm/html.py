"""Main text of web pages by wrapper induction over pages of the same host.

1. Pages become element trees; neighbouring siblings with the same tag and class count as one repeated
   node, so a tree has as many nodes as a layout has parts, not as a text has paragraphs.
2. All pages of a host are aligned with the one of the least hash: simple tree matching (Yang, 1991) pairs each
   tree's nodes with that one's, in order, page by page; the texts of paired nodes are counted over all different pages of the
   host. Slots whose texts vary, so that none is on half of ``SHARED`` of the pages, are content. The host's path leads to
   the deepest node that holds most of the varying text, and the main heading if there is one; elements that say they
   are an article only end the way down.
3. All texts of the content are counted over all pages of the host, copies of a page once; one is template if it is on
   ``SHARED`` of them and on ``LEAST`` at least. Pages whose content is the same text for the most part are near copies
   and have no template.
4. Every page of a host is read by its path, without the template's texts. Elements that can't be article text
   (menus, forms, scripts and the like), and containers, but never paragraphs or headings, that are named as adverts,
   notices or comments, are left out. A page that lacks the path, and a host with one page, are read by the tags alone.

Wrappers are small rows, as many as hosts: they are broadcast while they have ``BROADCAST_BYTES`` or fewer, else
joined by host with a salt, so that a host with a third of all pages is spread over ``SALT`` tasks.

Defined results: null html is empty; a page without text gives the empty string; a null or strange url is
the host of the empty name; unclosed, misnested and stray tags are repaired; trees of any depth are read whole
(for alignment, what lies more than ``DEPTH`` levels down counts as text of that level); texts of any length are
read whole; repeated rows and extra columns pass through; an empty table gives an empty result.
"""

import base64
import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, materialise

DEPTH, SALT = 60, 32
#: A template text is on this share of a host's different pages, and on so many.
SHARED, LEAST = 0.6, 4

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title nav footer aside form button select option textarea input label dialog menu".split())
#: Elements that hold a piece of text: inside the content they are never left out for their names.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption b strong i em a span code q cite mark sub sup small u s".split())
CLOSES = {t: frozenset({t}) for t in ("li", "option", "tr")} | {t: frozenset({"dt", "dd"}) for t in ("dt", "dd")} | {t: frozenset({"td", "th"}) for t in ("td", "th")}
SCOPE = frozenset("html body article section div main table td th ul ol dl aside nav footer header form blockquote li dd figure".split())
HOLDS = {"h1": 1, "p": 2, "article": 4, "main": 4}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|banners?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side|footers?|headers?|masthead"
    r"|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscri(?:be|ption)|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend(?:ed|ations?)?"
    r"|widgets?|toolbar|pagination|pager|login|signup|search|forms?|copyright|legal|disclaimer|skip|hidden|tags?)(?:$|[\s_-]|\d)"
)
TALK = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|respond)(?:$|[\s_-]|\d)")
_ELEMENT = r"<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[A-Za-z])[^>]*>?"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|" + _ELEMENT, re.S)
#: The same where no CDATA section can end any more.
_LATER = re.compile(r"<!--.*?(?:-->|\Z)|" + _ELEMENT, re.S)
#: What takes the rest of a page in which no tag ends any more.
_REST = re.compile(r"<!--|<(?=/?[A-Za-z])")
#: Numbers in class names that tell pages apart, not parts of a layout.
_NUMBER = re.compile(r"(?<=[-_])\d+|\d{3,}")
#: One attribute after the other, name and value, so that no value is read as a name.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
#: What keeps an item, a cell or an option from closing one outside.
_LISTS = frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "body"))


class Node:
    """An element: tag, label (tag and class), what its attributes are named, and its children, texts among them."""

    __slots__ = ("children", "hidden", "holds", "label", "named", "tag", "talk")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.holds = tag, [], 0
        got: dict[str, str] = {}
        for m in _ATTR.finditer(attributes) if attributes else ():
            if (name := m[1].lower()) in _READ:
                got.setdefault(name, m[2] or m[3] or m[4] or "")
        css = " ".join(sorted(_NUMBER.sub("", got.get("class", "")).split()))
        self.label = f"{tag}.{css}" if css else tag
        self.talk = bool(got) and bool(TALK.search(got.get("class", "")) or TALK.search(got.get("id", "")))
        self.hidden = bool(got) and ("hidden" in got or got.get("aria-hidden") == "true")
        self.named = bool(got) and (
            got.get("role", "").lower() in ROLES
            or bool(NAMED.search(got.get("class", "")) or NAMED.search(got.get("id", "")))
        )


class Open:
    """The open elements, with how many there are of each tag: in all, since the last element that bounds inline ones,
    and since the last list, table or the like. So whether a tag ends anything takes no look at what is open."""

    def __init__(self, root: Node):
        self.stack, self.talks = [root], 0
        self.all: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]
        self.lists: list[Counter] = [Counter()]

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.talks += node.talk
        self.all[node.tag] += 1
        self.scopes[-1][node.tag] += 1
        self.lists[-1][node.tag] += 1
        if node.tag in SCOPE:
            self.scopes.append(Counter())
        if node.tag in _LISTS:
            self.lists.append(Counter())

    def pop(self) -> Node:
        """Close the last element; what it holds, its parent holds."""
        node = self.stack.pop()
        self.stack[-1].holds |= node.holds
        self.talks -= node.talk
        if node.tag in SCOPE:
            self.scopes.pop()
        if node.tag in _LISTS:
            self.lists.pop()
        self.all[node.tag] -= 1
        self.scopes[-1][node.tag] -= 1
        self.lists[-1][node.tag] -= 1
        return node

    def close(self, tags: frozenset[str]) -> None:
        """Close elements up to the last of these tags, which is open."""
        while self.pop().tag not in tags:
            pass


def parse(page: str) -> Node:
    """The tree of a page, in time that grows with its length. A block element ends an open paragraph; end tags close what
    is open inside; one that ends nothing within its bounds is left out."""
    root = Node("#root")
    open_, at, n, sections, ends = Open(root), 0, len(page), page.rfind("]]>"), page.rfind(">")
    while at < n:
        if at > ends:
            rest = _REST.search(page, at)
            open_.top.children.append(page[at : rest.start() if rest else n])
            break
        m = (_TOKEN if at <= sections else _LATER).search(page, at)
        if not m:
            open_.top.children.append(page[at:])
            break
        if m.start() > at:
            open_.top.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and m[0].endswith("]]>"):
                open_.top.children.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if (open_.all if tag in SCOPE else open_.scopes[-1])[tag]:
                open_.close(frozenset((tag,)))
            continue
        if tag in BLOCK and open_.scopes[-1]["p"]:
            open_.close(frozenset(("p",)))
        if tag in CLOSES and any(open_.lists[-1][t] for t in CLOSES[tag]):
            open_.close(CLOSES[tag])
        node = Node(tag, m[3])
        open_.top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(node)
        if tag in HOLDS and not (HOLDS[tag] == 4 and (node.talk or open_.talks)):
            open_.top.holds |= HOLDS[tag]
    while open_.top is not root:
        open_.pop()
    return root


def _boilerplate(node: Node, inside: bool) -> bool:
    """Whether a part is left out. Named parts stay if they hold an article, or a main heading and paragraphs,
    as layouts are named after their sidebars; a header stays inside an article, whose title it holds."""
    if node.tag in SKIPPED or node.hidden:
        return True
    if node.tag in ("html", "body", "main", "article"):
        return node.talk and node.tag == "article"
    if node.tag == "header" and not inside:
        return True
    if inside and node.tag in LEAVES:
        return False
    return node.named and not (node.holds & 4 or node.holds & 3 == 3 or inside and node.holds & 1)


def _squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def blocks(node: Node, inside: bool) -> list[str]:
    """The texts of a part's blocks in order; white space in each is one blank."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = _squeezed("".join(line))
            line.clear()
            if text:
                out.append(text)

    stack = [iter(node.children)]
    ends = [True]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                line.append(child)
            elif not _boilerplate(child, inside):
                block = child.tag in BLOCK
                if child.tag == "br":
                    line.append(" ")
                if block:
                    end()
                stack.append(iter(child.children))
                ends.append(block)
                break
            elif child.tag in BLOCK:
                end()
        else:
            stack.pop()
            if ends.pop():
                end()
    end()
    return out


class Layout:
    """A tree with neighbouring siblings of one label merged: its label, children and own texts."""

    __slots__ = ("content", "heading", "kids", "label", "tag", "texts")

    def __init__(self, nodes: list[Node], depth: int = 0):
        self.label, self.tag, self.texts, self.content = nodes[0].label, nodes[0].tag, [], nodes[0].tag in ("article", "main")
        self.heading = self.tag == "h1" or any(n.holds & 1 for n in nodes)
        runs: list[list[Node]] = []
        for node in nodes:
            if depth == DEPTH:
                self.texts += blocks(node, self.content)
                continue
            for child in node.children:
                if isinstance(child, str):
                    if text := _squeezed(child):
                        self.texts.append(text)
                elif not _boilerplate(child, self.content or child.tag in LEAVES):
                    if runs and runs[-1][0].label == child.label:
                        runs[-1].append(child)
                    else:
                        runs.append([child])
        self.kids = [Layout(run, depth + 1) for run in runs]


def match(a: Layout, b: Layout) -> tuple[int, list]:
    """Simple tree matching: the size of the largest pairing in order, and its pairs of children with theirs."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    own: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            got = own[i, j] = match(a.kids[i - 1], b.kids[j - 1])
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + got[0])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((a.kids[i - 1], b.kids[j - 1], own[i, j][1]))
            i, j = i - 1, j - 1
    return 1 + best[m][n], pairs[::-1]


def _mark(text: str) -> str:
    """A text's 128-bit digest, which stands for it where texts are counted."""
    return base64.b64encode(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()).decode()[:22]


def slot_texts(first: Layout, other: Layout) -> dict[tuple[int, str], int]:
    """The texts (slot, mark) of another tree by the first tree's slots that they are paired with, and their characters; slots are
    numbered from the root downwards, in order."""
    number: dict[int, int] = {}
    todo = [first]
    while todo:
        slot = todo.pop()
        number[id(slot)] = len(number)
        todo += reversed(slot.kids)
    found: dict[tuple[int, str], int] = {}

    def note(slot: Layout, texts: list[str], pairs: list) -> None:
        for t in texts:
            found[number[id(slot)], _mark(t)] = len(t)
        for x, y, below in pairs:
            note(x, y.texts, below)

    note(first, other.texts, match(first, other)[1])
    return found


def _few(pages: int) -> float:
    """On so many of a host's pages a text no longer varies."""
    return max(2, SHARED * pages / 2)


def path_of(first: Layout, own: dict[int, int]) -> list[str]:
    """The labels from the root to the content, given the characters of varying texts of each slot."""
    weight: dict[int, int] = {}
    numbers = iter(range(1 << 62))

    def varying(slot: Layout) -> int:
        at = next(numbers)
        weight[id(slot)] = own.get(at, 0) + sum(varying(kid) for kid in slot.kids)
        return weight[id(slot)]

    node, path = first, [first.label]
    total = varying(node)
    while not node.content and node.kids:
        kid = max(node.kids, key=lambda k: weight[id(k)] * (1 + k.content))
        deeper = kid.content or kid.tag in BLOCK and kid.kids and weight[id(kid)] >= 0.8 * total and kid.heading == node.heading
        if not (kid.tag in ("html", "body") or deeper):
            break
        node = kid
        path.append(node.label)
    return path


def content_texts(root: Node, path: list[str]) -> dict[str, int]:
    """The marks of the content's texts and the characters of all with that mark."""
    found: Counter = Counter()
    for text in _read(root, path):
        found[_mark(text)] += len(text)
    return found


def induce(pages: list[str]) -> dict:
    """The wrapper of a host of these different pages: the labels from the root to the content, and the marks of the texts that
    are template. ``wrappers`` is the same for the hosts of a table."""
    parsed = [parse(p) for p in pages]
    trees, n = [Layout([root]) for root in parsed], len(parsed)
    counts: Counter = Counter()
    size: dict[tuple[int, str], int] = {}
    for tree in trees:
        texts = slot_texts(trees[0], tree)
        counts.update(texts.keys())
        size |= texts
    own: Counter = Counter()
    for (slot, mark), k in counts.items():
        own[slot] += size[slot, mark] if k < _few(n) else 0
    path = path_of(trees[0], own)
    texts = [content_texts(root, path) for root in parsed]
    on, chars = Counter(m for t in texts for m in t), Counter()
    for t in texts:
        chars.update(t)
    copies = 2 * sum(c for m, c in chars.items() if on[m] >= _few(n)) > sum(chars.values())
    return {"path": path, "template": [] if copies else sorted(m for m, k in on.items() if k >= max(LEAST, SHARED * n))}


def _content(root: Node) -> list[Node]:
    """The outermost articles that are not boilerplate, or main elements without one, else the body, else the root."""
    found, body, todo = [], None, [root]
    while todo:
        node = todo.pop()
        if node.tag == "body" and body is None:
            body = node
        if node.tag in ("main", "article"):
            inner = _articles(node) if node.tag == "main" else []
            found += inner or [node]
            continue
        for child in reversed(node.children):
            if isinstance(child, Node) and not _boilerplate(child, False):
                todo.append(child)
    return found or [body or root]


def _articles(node: Node) -> list[Node]:
    """The outermost articles inside a part, in order."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if at.tag == "article" and at is not node:
            out.append(at)
        else:
            todo += [c for c in reversed(at.children) if isinstance(c, Node) and not _boilerplate(c, True)]
    return out


def _by_path(root: Node, path: list[str]) -> list[Node]:
    """The nodes that a path of labels leads to from the root."""
    level = [root]
    for label in path[1:]:
        level = [c for node in level for c in node.children if isinstance(c, Node) and c.label == label and not _boilerplate(c, False)]
    return level if len(path) > 1 else []


def _read(root: Node, path: list[str]) -> list[str]:
    """The blocks of the content: what the path leads to, or, where it leads nowhere, what the tags say."""
    parts = _by_path(root, path)
    inside = bool(parts)
    if not parts:
        parts = _content(root)
        inside = parts[0].tag in ("article", "main")
    return [text for part in parts for text in blocks(part, inside)]


def extract(page: str, wrapper: dict | None = None) -> str:
    """The main text of a page, its blocks joined by an empty line."""
    found = _read(parse(page), wrapper["path"] if wrapper else [])
    template = frozenset(wrapper["template"]) if wrapper else frozenset()
    return "\n\n".join(t for t in found if not template or _mark(t) not in template)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, template) of every host; ``pages`` has host, html and copy, the hash of the html.

    Each page is aligned with its host's first one and read by its host's path by itself; only marks of texts are shuffled.
    """
    of_host = materialise(pages.select("host", "copy").distinct().groupBy("host").agg(F.min("copy").alias("copy"), F.count(F.lit(1)).alias("pages")), "hosts")
    few = of_host.agg(F.sum(F.octet_length("host") + 40)).first()[0] or 0
    drawn = of_host.select("host", "copy")
    first = materialise(pages.join(F.broadcast(drawn) if few <= BROADCAST_BYTES else drawn, ["host", "copy"]).groupBy("host").agg(F.first("html").alias("first")), "first-pages")
    met = _with_each(pages, first, "first", "inner").select("host", "copy", F.explode(_slots_column(F.col("html"), F.col("first"))).alias("t"))
    least = F.greatest(F.lit(2.0), F.lit(SHARED / 2) * F.col("pages"))
    texts = met.select("host", "copy", "t.*").distinct().groupBy("host", "slot", "mark").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"))
    vary = texts.join(of_host.drop("copy"), "host").groupBy("host", "slot").agg(F.sum(F.when(F.col("n") < least, F.col("chars")).otherwise(F.lit(0))).alias("own"))
    slots = vary.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "own"))).alias("own"))
    paths = materialise(first.join(slots, "host", "left").select("host", _path_column(F.col("first"), F.to_json("own")).alias("path")), "paths")
    read = _with_wrappers(pages, paths.withColumn("template", F.array().cast("array<string>")), "inner").select("host", "copy", F.explode(_content_column(F.col("html"), F.col("wrapper"))).alias("t"))
    counted = read.select("host", "copy", "t.*").distinct().groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).join(of_host.drop("copy"), "host")
    sure = F.when((F.col("n") >= LEAST) & (F.col("n") >= F.lit(SHARED) * F.col("pages")), F.col("mark"))
    found = counted.groupBy("host").agg(
        F.sum(F.when(F.col("n") >= least, F.col("chars")).otherwise(F.lit(0))).alias("same"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list(sure)).alias("sure")
    )
    own = found.filter(2 * F.col("same") <= F.col("chars")).select("host", "sure")
    return paths.join(own, "host", "left").select("host", "path", F.coalesce("sure", F.array().cast("array<string>")).alias("template"))


def _with_wrappers(pages: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``pages`` with the wrapper of their hosts, as JSON."""
    return _with_each(pages, found.select("host", F.to_json(F.struct("path", "template")).alias("wrapper")), "wrapper", how)


def _with_each(pages: DataFrame, found: DataFrame, name: str, how: str) -> DataFrame:
    """``pages`` with a text of their hosts."""
    size = found.agg(F.sum(F.octet_length(name) + F.octet_length("host") + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(found), "host", how)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return pages.withColumn("salt", F.pmod("copy", F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], how)


def _read_wrappers(work):
    """An iterator function over batches of (page, wrapper), each wrapper being read once."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[list]:
        known: dict[str | None, dict | None] = {None: None}
        for pages, hosts in batches:
            out = []
            for p, w in zip(pages, hosts, strict=True):
                text = w.as_py()
                if text not in known:
                    if len(known) > 500:
                        known.clear()
                    known[text] = json.loads(text) if text else None
                out.append(work(p.as_py(), known[text]))
            yield out

    return run


def _slots_column(page: Column, first: Column) -> Column:
    """The texts of a page by the slots of its host's first page."""

    @F.arrow_udf("array<struct<slot: int, mark: string, chars: int>>")
    def slots(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("mark", pa.string()), ("chars", pa.int32())]))
        known: dict[str, Layout] = {}
        for pages, firsts in batches:
            out = []
            for p, f in zip(pages, firsts, strict=True):
                text = f.as_py()
                if text not in known:
                    if len(known) > 100:
                        known.clear()
                    known[text] = Layout([parse(text)])
                found = slot_texts(known[text], Layout([parse(p.as_py())]))
                out.append([{"slot": s, "mark": m, "chars": n} for (s, m), n in found.items()])
            yield pa.array(out, kind)

    return slots(page, first)


def _path_column(first: Column, own: Column) -> Column:
    """The path of a host by its first page and the characters of varying texts in its slots (JSON or null)."""

    @F.arrow_udf("array<string>")
    def paths(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, owns in batches:
            read = ((p.as_py(), json.loads(o.as_py() or "{}")) for p, o in zip(pages, owns, strict=True))
            yield pa.array([path_of(Layout([parse(p)]), {int(k): v for k, v in o.items()}) for p, o in read], pa.list_(pa.string()))

    return paths(first, own)


def _content_column(page: Column, wrapper: Column) -> Column:
    """The marks of a page's content, as its host's path reads it, and their characters."""

    def content(page: str, wrapper: dict) -> list[dict]:
        return [{"mark": m, "chars": n} for m, n in content_texts(parse(page), wrapper["path"]).items()]

    @F.arrow_udf("array<struct<mark: string, chars: int>>")
    def contents(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for out in _read_wrappers(content)(batches):
            yield pa.array(out, pa.list_(pa.struct([("mark", pa.string()), ("chars", pa.int32())])))

    return contents(page, wrapper)


def main_text_column(page: Column, wrapper: Column) -> Column:
    """The main text of each page, given its host's wrapper (JSON or null)."""

    @F.arrow_udf("string")
    def main_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for out in _read_wrappers(extract)(batches):
            yield pa.array(out, pa.string())

    return main_text(F.coalesce(page, F.lit("")), wrapper)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: its id, url and main text."""
    html = F.coalesce(html_col, F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), html.alias("html"), F.xxhash64(html).alias("copy"))
    found = materialise(wrappers(pages.select("host", "html", "copy")), "wrappers")
    joined = _with_wrappers(pages, found, "left")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), main_text_column(F.col("html"), F.col("wrapper")).alias("text"))
