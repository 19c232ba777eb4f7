"""Main text of pages by wrappers inferred per host: union-free regular expressions over token streams.

A page becomes a tree of elements and texts; neighbours of one kind fold to a repeated group. The pages of a host are
aligned one after the other, in every partition and then over partitions: what one side lacks becomes optional, what
repeats a neighbour becomes a repeated group, texts that differ become slots. To extract, a page is matched against its
host's wrapper. The slots that the page fills say where its content stands: in the deepest group that holds most slot text
of the host's pages; where that lies in article or main elements or holds some, in the groups of these elements. Constant
texts of the wrapper and texts that most pages of the host repeat at one path are template. Tags, roles and class names of menus, notices,
adverts, forms, comments and the like are a further filter.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import broadcast_bytes, cut, tidy
from sanmaru.llm.url_filter import host_and_path

#: Different pages that a text has to stand on to be template, and the share of the pages with its path.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.9
#: Share of the slot text that a group must hold to be the content.
CONTENT_SHARE = 0.8
#: Depth to which wrappers follow a page, and neighbours and groups of a wrapper beyond which it is generalised.
MAX_DEPTH, MAX_CHILDREN, MAX_NODES = 60, 64, 4000
#: Hosts whose begun wrappers a task holds.
HELD_HOSTS = 128
#: Partial wrappers of one host are first aligned in so many parts.
PARTS = 64
#: Pages from which on a host's wrapper is joined by broadcast even if all wrappers are too many for that.
HOT_PAGES = 1_000_000

# Element and class names of HTML and of common page layouts.
RAW = "script style noscript template iframe object svg canvas math textarea xmp".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CHROME_TAGS = frozenset("nav aside footer form head title button select option dialog menu search fieldset label".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay interstitial paywall newsletter subscribe subscription signup login signin "
    "sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs footer masthead topbar toolbar skip "
    "comment comments commentlist discussion disqus reply replies respond share sharing social related recommended recommendations outbrain taboola widget widgets pagination pager search searchbox".split()
)
AMBIGUOUS = frozenset("discussion related search social share sharing notice notices alert alerts promotion subscription respond reply replies overlay rail skip widget widgets".split())
STATES = frozenset("has no not with without is are open closed on off hide hidden show enabled disabled layout".split())
CONTENT_NAMES = frozenset("article post entry content story body".split())
INLINE = frozenset("a abbr b big cite code em font i kbd mark q s small span strong sub sup tt u var".split())
TEXTUAL = INLINE | frozenset("blockquote dd dt figcaption figure h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
UNDIVIDED = TEXTUAL - frozenset(("td", "tr")) | frozenset(("ul", "ol", "dl"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
CLOSES_P = BLOCK - frozenset("body caption head html option title tbody td tfoot th thead tr legend summary".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|</?[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    """An element of a page with its children, or a text (``tag`` is ``#``). ``chrome`` is 2 by tag or role, 1 by a class name."""

    __slots__ = ("tag", "label", "chrome", "children", "text", "holds")

    def __init__(self, tag: str, label: str, chrome: int = 0, text: str | None = None):
        self.tag, self.label, self.chrome, self.text = tag, label, chrome, text
        self.children: list[Node] = []
        self.holds = tag in ("article", "main")  # an article or main element, itself or inside


def _named_chrome(tag: str, classes: list[str], ident: str) -> bool:
    """Whether names of class or id mark what is not part of an article.

    Elements of text need a whole class name; names of layout states (``has-sidebar``) tell nothing; an id has to be such
    a name as a whole and, as on section and article, not an ambiguous one.
    """
    if tag in ("html", "body", "main", "h1"):
        return False
    if tag in TEXTUAL:
        return any(c in CHROME_WORDS for c in classes) and tag not in ("h2", "h3", "h4", "h5", "h6")
    strict = tag in ("section", "article", "header")
    for name in classes:
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if STATES.isdisjoint(parts) and any(p in CHROME_WORDS and not (strict and p in AMBIGUOUS) for p in parts):
            return True
        if "header" in parts and tag in ("div", "section", "table") and CONTENT_NAMES.isdisjoint(parts):
            return True
    parts = [p for p in re.split(r"[_-]+", ident) if p]
    return bool(parts) and all(p in CHROME_WORDS for p in parts) and not (len(parts) == 1 and strict and parts[0] in AMBIGUOUS)


def _element(tag: str, attrs: str) -> Node:
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTR.findall(attrs)} if attrs.strip(" /") else {}
    split_case = [re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get(k, "")).lower() for k in ("class", "id")] if found else ["", ""]
    classes = split_case[0].split()
    chrome = 2 if tag in CHROME_TAGS or found.get("role", "").lower() in CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in re.sub(r"\s", "", found.get("style", "").lower()) else 0
    if found and not chrome and _named_chrome(tag, classes, split_case[1].strip()):
        chrome = 1
    return Node(tag, ".".join([tag, *sorted(set(classes))][:4]), chrome)


def parse(source: str) -> Node:
    """Tree of a page. Unclosed and stray tags are mended; a page that breaks off ends all that is open."""
    root = Node("#root", "")
    stack = [root]
    for m in TOKEN.finditer(source):
        text = m["text"]
        if text is not None:
            last = stack[-1].children[-1] if stack[-1].children else None
            if last is not None and last.tag == "#":
                last.text += text
            else:
                stack[-1].children.append(Node("#", "#", text=text))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "body", "table") and tag not in BLOCK:
                    break
            continue
        node = _element(tag, m["attrs"] or m["attrs2"] or "")
        closes, fences = CLOSES.get(tag, ()), FENCES.get(tag, ())
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fences:
                    break
                if stack[i].tag in closes:
                    del stack[i:]
                    break
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        stack[-1].children.append(node)
        if node.holds:
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(node)
    return root


# --- wrappers


class Group:
    """A part of a wrapper: an element or a text (label ``#``), which may be repeated (``many``) or optional (``maybe``).

    ``pages`` counts the pages it stands on, ``chars`` the characters of its texts outside links. ``text`` is None in a slot.
    """

    __slots__ = ("label", "many", "maybe", "pages", "chars", "text", "children")

    def __init__(self, label: str, text: str | None = None, chars: int = 0):
        self.label, self.text, self.chars = label, text, chars
        self.many = self.maybe = False
        self.pages, self.children = 1, []

    def dump(self) -> list:
        return [self.label, self.many + 2 * self.maybe, self.pages, self.chars, self.text, [c.dump() for c in self.children]]

    @staticmethod
    def load(row: list) -> Group:
        out = Group(row[0], row[4], row[3])
        out.many, out.maybe, out.pages, out.children = bool(row[1] & 1), bool(row[1] & 2), row[2], [Group.load(c) for c in row[5]]
        return out

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def _plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _all_text(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        top = stack.pop()
        if top.tag == "#":
            parts.append(top.text)
        elif not _skipped(top, False):
            stack += reversed(top.children)
    return " ".join(parts)


def _skipped(node: Node, article: bool) -> bool:
    """Chrome; but what holds an article isn't dropped for its class name or as a form, and an article may have a header."""
    return (node.chrome == 2 and not (node.holds and node.tag == "form")) or (node.chrome == 1 and not (node.holds and node.tag not in ("article", "main"))) or (node.tag == "header" and not article and not node.holds)


def fold(node: Node, depth: int = 0, link: bool = False, article: bool = False) -> Group:
    """A page as a wrapper of itself: neighbours of one label are one repeated group; chrome keeps its label only."""
    if node.tag == "#":
        text = _plain(node.text)
        return Group("#", text, 0 if link else len(text))
    out = Group(node.label)
    link, article = link or node.tag == "a", article or node.tag in ("article", "main")
    if _skipped(node, article) and depth:
        return out
    if depth >= MAX_DEPTH:
        text = _plain(_all_text(node))
        out.children = [Group("#", text, 0 if link else len(text))] if text else []
        return out
    for child in node.children:
        if child.tag == "#" and not child.text.strip():
            continue
        new = fold(child, depth + 1, link, article)
        if out.children and out.children[-1].label == new.label:
            align(out.children[-1], new, 0)
            out.children[-1].many = True
        else:
            out.children.append(new)
    return out


def align(wrapper: Group, page: Group, more: int = 1) -> None:
    """Generalise ``wrapper`` so that it also matches ``page``; ``more`` is 0 where both stand on the same page."""
    wrapper.many |= page.many
    wrapper.maybe |= page.maybe
    wrapper.pages += more * page.pages
    wrapper.chars += page.chars
    if wrapper.text != page.text:
        wrapper.text = None
    left, right = [c.label for c in wrapper.children], [c.label for c in page.children]
    if left == right:
        for a, b in zip(wrapper.children, page.children, strict=True):
            align(a, b, more)
        return
    merged: list[Group] = []
    for kind, i, j, k, n in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            for a, b in zip(wrapper.children[i:j], page.children[k:n], strict=True):
                align(a, b, more)
                merged.append(a)
        else:
            for c in wrapper.children[i:j] + page.children[k:n]:
                c.maybe = True
                merged.append(c)
    wrapper.children = []
    for c in merged:
        _put(wrapper.children, c)
    if len(wrapper.children) > MAX_CHILDREN:
        _generalise(wrapper, tags=len(set(c.label for c in wrapper.children)) > MAX_CHILDREN)


def _put(children: list[Group], c: Group) -> None:
    """Add a group; next to one of the same label it repeats that one."""
    if children and children[-1].label == c.label:
        last, optional = children[-1], children[-1].maybe and c.maybe
        align(last, c)
        last.many, last.maybe = True, optional
    else:
        children.append(c)


def _generalise(wrapper: Group, tags: bool) -> None:
    """One optional repeated group for each label, or only for each tag, in place of a long sequence."""
    kinds: dict[str, Group] = {}
    for c in wrapper.children:
        c.label = c.label.partition(".")[0] if tags else c.label
        if c.label in kinds:
            align(kinds[c.label], c)
        else:
            kinds[c.label] = c
        kinds[c.label].many = kinds[c.label].maybe = True
    wrapper.children = list(kinds.values())


def _bounded(wrapper: Group) -> Group:
    """``wrapper``, generalised if it has too many groups: first classes go, then levels from the deepest up."""
    depth = 16
    if wrapper.size() > MAX_NODES:
        level = [wrapper]
        while level:
            for g in level:
                _generalise(g, tags=True)
            level = [c for g in level for c in g.children]
    while wrapper.size() > MAX_NODES and depth > 2:
        level = [wrapper]
        for _ in range(depth):
            level = [c for g in level for c in g.children]
        for g in level:
            slot = Group("#", None, _slot_chars(g, False))
            g.children = [slot] if g.label != "#" else []
        depth -= 2
    return wrapper


def expression(group: Group) -> str:
    """The wrapper as a regular expression over ``tokens``, free of unions: text slots, ``?``, ``+`` and ``*`` groups."""
    if group.label == "#":
        body = "[^<>]+" if group.text is None else re.escape(group.text.replace("<", "(").replace(">", ")"))
    else:
        body = re.escape(f"<{group.label}>") + "".join(map(expression, group.children)) + re.escape(f"</{group.label}>")
    mark = "*" if group.many and group.maybe else "+" if group.many else "?" if group.maybe else ""
    return f"(?:{body}){mark}" if mark else body


def tokens(node: Node, depth: int = 0, article: bool = False) -> str:
    """A page's token stream as ``expression`` reads it."""
    if node.tag == "#":
        return _plain(node.text).replace("<", "(").replace(">", ")")
    article = article or node.tag in ("article", "main")
    inner = "" if _skipped(node, article) and depth else "".join(tokens(c, depth + 1, article) for c in node.children)
    return f"<{node.label}>{inner}</{node.label}>"


def _slot_chars(group: Group, known: bool) -> int:
    """Characters in the slots of a group; before a host has enough pages, every text counts as a slot."""
    if group.label == "#":
        return 0 if known and group.text is not None else group.chars
    return sum(_slot_chars(c, known) for c in group.children)


class Wrapper:
    """A host's wrapper made ready for matching."""

    def __init__(self, root: Group | None, template: list[int] | None = None):
        self.root, self.template = root, frozenset(template or ())
        self.known = root is not None and root.pages >= LEAST_PAGES
        self.weight: dict[int, float] = {}
        if root is not None:
            self._weigh(root)

    def _weigh(self, group: Group) -> int:
        total = sum(map(self._weigh, group.children)) if group.label != "#" else _slot_chars(group, self.known)
        self.weight[id(group)] = total / max(1, group.pages)
        return total


# --- extraction


def text_mark(path: int, text: str) -> int:
    """What stands for a text at a path (of labels) in the counts of template texts."""
    return zlib.crc32(text.encode(), path) << 31 | zlib.adler32(text.encode(), path & 0xFFFF) & 0x7FFFFFFF


class Text:
    """A text of a page outside chrome: its block, the groups above it, the outermost article it stands in."""

    __slots__ = ("text", "block", "article", "above", "fixed", "path")

    def __init__(self, text: str, block: int, article: bool, above: tuple, fixed: bool, path: int):
        self.text, self.block, self.article, self.above, self.fixed, self.path = text, block, article, above, fixed, path


def match(root: Node, wrapper: Wrapper) -> list[Text]:
    """The texts of a page outside chrome, each with the groups of the wrapper that it matches. Keeps its own stack.

    Children are matched in order: each to the next group of its label at or after the group of the child before, else to
    the first such group. What the wrapper lacks counts as a slot.
    """
    out: list[Text] = []
    block = 0
    stack: list[tuple] = [(root, wrapper.root, (), False, 0)]
    while stack:
        node, group, above, article, path = stack.pop()
        if node is None:
            block += 1
            continue
        if node.tag == "#":
            fixed = wrapper.known and group is not None and group.text is not None and group.text == _plain(node.text)
            out.append(Text(node.text, block, article, above, fixed, path))
            continue
        if node.tag == "br":
            out.append(Text(" ", block, article, above, False, path))
            continue
        article = article or node.tag in ("article", "main")
        if _skipped(node, article):
            block += 1
            continue
        if node.tag in BLOCK:
            block += 1
            stack.append((None, None, (), False, 0))
        path = zlib.crc32(node.label.encode(), path)
        if group is not None and len(above) < MAX_DEPTH:
            above = (*above, (id(group), id(node), node.tag))
        groups, at, rows = group.children if group is not None else [], 0, []
        for child in node.children:
            found = None
            if groups and (child.tag != "#" or child.text.strip()):
                label = child.label
                if at < len(groups) and groups[at].label == label:
                    found = groups[at]
                else:
                    hit = next((i for i in range(at, len(groups)) if groups[i].label == label), None)
                    hit = next((i for i in range(at) if groups[i].label == label), None) if hit is None else hit
                    if hit is not None:
                        at, found = hit, groups[hit]
            rows.append((child, found, above, article, path))
        stack += reversed(rows)
    return out


def _article_group(t: Text) -> int | None:
    """The wrapper's group of the outermost article or main element that a text stands in."""
    return next((group for group, _, tag in t.above if tag in ("article", "main")), None)


def content(found: list[Text], wrapper: Wrapper) -> list[Text]:
    """The texts of the article among ``found``.

    The wrapper chooses the region: down from the root, as long as one group holds most of what the slots on its level
    hold. If texts of the region fill slots in article or main elements, the groups of these elements are the content as a
    whole (with texts that happen to repeat); other articles of the page, teasers say, are not. Else the region is the content.
    """
    kept = [t for t in found if not t.fixed and text_mark(t.path, _plain(t.text)) not in wrapper.template]
    kept = kept if any(t.text.strip() for t in kept) else found
    inside, depth, held = kept, 0, 0.0
    while True:
        weights: dict[int, float] = {}
        for t in inside:
            if len(t.above) > depth and t.above[depth][2] not in UNDIVIDED:
                weights[t.above[depth][0]] = wrapper.weight.get(t.above[depth][0], 0.0)
        best = max(weights, key=lambda g: weights[g], default=None)
        if best is None or weights[best] < CONTENT_SHARE * held:
            break
        narrower = [t for t in inside if len(t.above) > depth and t.above[depth][0] == best]
        if not any(t.text.strip() for t in narrower):
            break
        inside, held, depth = narrower, weights[best], depth + 1
    groups = {_article_group(t) for t in inside if t.article and not t.fixed and t.text.strip()}
    return [t for t in found if t.article and _article_group(t) in groups] if groups else inside


def extract(source: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of a page; without a wrapper, by its own."""
    if not source:
        return ""
    page = parse(source)
    wrapper = wrapper or Wrapper(fold(page))
    blocks: dict[int, list[str]] = {}
    for t in content(match(page, wrapper), wrapper):
        blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def infer_wrapper(sources: list[str]) -> Group:
    """Wrapper of a host's pages, aligned in the given order; equal pages count once."""
    wrapper = None
    for s in dict.fromkeys(sources):
        page = fold(parse(s))
        if wrapper is None:
            wrapper = page
        else:
            align(wrapper, page)
            wrapper = _bounded(wrapper) if len(wrapper.children) else wrapper
    return wrapper if wrapper is not None else Group("")


# --- Spark


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``host, html, page``: begun wrappers (``mark`` null) and one row for each path and text that may be template."""
    held: dict[str, tuple[Group, int | None]] = {}

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "page", "path", "mark", "wrapper"])

    def begun() -> list[tuple]:
        return [(host, one, None, None, json.dumps(_bounded(w).dump())) for host, (w, one) in held.items()]

    empty = Wrapper(None)
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part, out = batch.slice(lo, 64), []
            for host, source, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                tree = parse(source)
                mine = fold(tree)
                if host not in held:
                    held[host] = (mine, page)
                elif held[host][1] != page:
                    align(held[host][0], mine)
                    held[host] = (held[host][0], None)
                texts = [t for t in match(tree, empty) if not t.article and t.text.strip()]
                out += [(host, page, p, None, "") for p in {t.path for t in texts}]
                out += [(host, page, p, m, "") for p, m in {(t.path, text_mark(t.path, _plain(t.text))) for t in texts}]
                if held[host][0].size() > MAX_NODES:
                    held[host] = (_bounded(held[host][0]), held[host][1])
            if len(held) > HELD_HOSTS:
                out += begun()
                held.clear()
            yield rows(out)
    yield rows(begun())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the wrappers of rows sorted by ``host, part``; one row for each. Holds one wrapper and one batch."""
    key, held, one = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.string()), (one, pa.int64()), (held.pages, pa.int64()), (json.dumps(_bounded(held).dump()), pa.string()))], names=["host", "page", "pages", "wrapper"])

    for batch in batches:
        for host, part, page, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (host, part) != key:
                if key is not None:
                    yield row()
                key, held, one = (host, part), Group.load(json.loads(text)), page
            elif one is None or one != page:
                align(held, Group.load(json.loads(text)))
                one = None
                if held.size() > MAX_NODES:
                    held = _bounded(held)
    if key is not None:
        yield row()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, pages, wrapper`` (JSON), ``template`` (marks) from all rows of ``pages(host, html)``.

    Every task aligns the pages of its hosts; begun wrappers are aligned in ``PARTS`` parts of a host, then the parts. All
    orders are fixed, so reruns agree. Template texts are counted by Spark over all different pages of a host: at least
    ``LEAST_PAGES``, and ``TEMPLATE_SHARE`` of those with the path. A host has as many of them as a page has texts.
    """
    rows = pages.filter("html is not null").select("host", "html", F.xxhash64("html").alias("page"))
    begun = cut(rows.mapInArrow(tidy(_begin), "host string, page long, path long, mark long, wrapper string"))
    kinds = "host string, page long, pages long, wrapper string"
    parts = begun.filter("wrapper <> ''").select("host", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).alias("part"), "page", "wrapper")
    for last in (False, True):
        parts = parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(tidy(_merge), kinds)
        parts = parts if last else parts.select("host", F.lit(0).alias("part"), "page", "wrapper")
    counts = begun.filter("wrapper = ''").groupBy("host", "path", "mark").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    counts = cut(counts)
    fixed = counts.filter("mark is not null").join(counts.filter("mark is null").select("host", "path", F.col("n").alias("of")), ["host", "path"]).filter(F.col("n") >= TEMPLATE_SHARE * F.col("of"))
    template = fixed.groupBy("host").agg(F.sort_array(F.collect_set("mark")).alias("template"))
    return parts.drop("page").join(template, "host", "left")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars``.

    Null and empty pages give an empty text. White space inside a block becomes one space; blocks, in page order, are
    joined by an empty line. Pages with a null or odd url share one wrapper. Repeated rows give repeated rows and count
    once for the wrapper, an empty table gives none; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_and_path(F.col("url"))[0].alias("host"))
    wrappers = cut(infer_wrappers(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, texts = batch.slice(lo, 64), []
                for host, source, wrapper, template in zip(*(part.column(i).to_pylist() for i in (4, 2, 5, 6)), strict=True):
                    if wrapper is not None and host not in known:
                        if len(known) > HELD_HOSTS:
                            known.clear()
                        known[host] = Wrapper(Group.load(json.loads(wrapper)), template)
                    texts.append(extract(source, known.get(host)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        found = left.join(right.select(F.col("host").alias("of"), "wrapper", "template"), F.col("host") == F.col("of"), "left")
        return found.select("page_id", "url", "html", F.lit(0), "host", "wrapper", "template").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")

    small = broadcast_bytes(wrappers, "wrapper", "template")
    if small is not None:
        return joined(rows, small)
    hot = broadcast_bytes(cut(wrappers.filter(F.col("pages") >= HOT_PAGES)), "wrapper", "template")
    if hot is None:  # adaptive execution splits what is left of skew
        return joined(rows, wrappers)
    of = F.broadcast(hot.select("host"))
    return joined(rows.join(of, "host", "left_semi"), hot).unionByName(joined(rows.join(of, "host", "left_anti"), wrappers))
