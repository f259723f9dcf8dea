"""HTML extraction by tree scoring.

One linear pass reads the markup, whatever its faults, into elements and runs: a run is the text between two block boundaries, with how much
of it is linked. Elements that never hold an article (scripts, buttons, frames and so on) are cut. Menus, forms, headers, notices and the like, by tag, role, or a class or id that says
nothing else, are cut as well unless they hold the page's prose: what such an element holds itself is counted while reading, and if that outweighs all that was kept, the page is read again with this
element open. Reader comments are cut by name, and by structure: sibling blocks of one kind that each have an author or date and a link to reply. Each paragraph passes points for its length and commas to its ancestors, less with each level up; a
container's points are discounted by its link density. From the best container the choice climbs to the highest article or main around
it, else to its parent, and on to every ancestor that holds more prose, lists, tables or articles beside. All runs in there are joined in
page order, whatever their points; only outside articles and the best container are those that are mostly links left out.

Defined cases: null or empty html gives empty text; a page without paragraphs gives the text left in its body; of equal containers the
first wins; broken nesting closes at the nearest open ancestor; a comment, declaration, tag or script without an end reaches to the end of
the page, as in browsers; an article inside an unclosed menu or a form counts; pages of any length are taken whole; repeated rows each give
their row; null ids and urls stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CUT_TAGS = frozenset(
    "script style noscript template head title iframe object svg math canvas audio video map form fieldset input select option textarea button nav header footer aside menu dialog noembed noframes".split()
)
#: An article inside these is still an article.
LOOSE_CUTS = frozenset("nav header menu form fieldset".split())
#: Characters of prose beyond which an element that is cut by its tag or role, or by its name, may hold the article, and those that do inside an article of which nothing else is left.
HELD, HELD_NAMED, HELD_INSIDE = 140, 500, 25
#: Their text is none of the prose of what is around them.
NO_PROSE = frozenset("a button label legend option select title style script noscript template".split())
#: Words of names that tell of a thread of reader comments, whatever stands before them.
THREADS = ("comments", "commentlist", "disqus", "replies")
#: Words of names, and texts of links, that each entry of such a thread has.
SIGNED = frozenset("author avatar byline user username commenter date time timestamp datetime published posted".split())
REPLIES = frozenset("reply replies répondre antworten responder rispondi 回复 返信 report flag quote".split())
#: A box of this name between paragraphs of an article, without anything to click, is part of it.
ASIDES = frozenset("notice notices alert notification".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html"}
#: Start tag -> tags that it closes, each up to the nearest of the stops.
CLOSES = {
    "li": [("li", ("ul", "ol", "menu"))],
    "td": [("td", ("table", "tr")), ("th", ("table", "tr"))],
    "th": [("td", ("table", "tr")), ("th", ("table", "tr"))],
    "tr": [("td", ("table",)), ("th", ("table",)), ("tr", ("table",))],
    "dd": [("dd", ("dl",)), ("dt", ("dl",))],
    "dt": [("dd", ("dl",)), ("dt", ("dl",))],
    "option": [("option", ("select",))],
    "body": [("head", ())],
}
CUT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Words of class names and ids that tell of what is no article, and words that say nothing beside them.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist reply replies respond cookie cookies consent gdpr notice "
    "notices notification alert footer foot footnav header masthead topbar menu menus nav navbar navigation subnav sidenav modal popup overlay newsletter subscribe signup login pager pagination related recommended "
    "recommendations share sharing social sidebar skyscraper toolbar toc widget widgets".split()
)
PLAIN_WORDS = frozenset(
    "site page global main top bottom left right inner outer wrap wrapper container box block section area item items list link links button buttons btn bar row col column content body text module panel group holder slot "
    "unit primary secondary mobile desktop sticky fixed float floating post posts entry article articles blog story reader readers user users the id class js ui form policy icons media".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_GOOD_NAMES = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story", re.I)
#: Classes such as has-sidebar tell of the page's state, not of the element's kind.
_STATE_NAMES = re.compile(r"(?:has|with|no|without|is|js)[-_]", re.I)
MAIN_NAMES = frozenset("main content article post entry story".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TEXT_BOXES = frozenset("div section td article main body html".split())
LISTS = frozenset("ul ol dl".split())
#: Links alone in these do not make them menus.
ITEMS = HEADINGS | {"li", "td", "th", "dt", "dd", "caption", "figcaption"}
TAG_POINTS = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}

# No part of these is read twice, so they are linear on any text.
_MARKUP = re.compile(r"<(?:!--|[!?]|/[A-Za-z]|/|[A-Za-z])")
_NAME = re.compile(r"[^\s/>]++")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)?""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    """An element that is not cut; its runs are ``first`` to ``last``."""

    __slots__ = ("after", "cut", "depth", "first", "held", "inside", "last", "links", "names", "number", "parent", "points", "signs", "soft", "tag", "threads")

    def __init__(self, tag: str, parent: Node | None, cut: bool, names: str, depth: int) -> None:
        self.tag, self.parent, self.cut, self.names, self.depth = tag, parent, cut, names, depth
        self.first = self.last = self.links = 0
        self.points: float | None = None
        self.after = self.held = self.number = self.signs = 0
        #: Why it is cut, if it may be open: tag, name or thread.
        self.soft, self.inside = "", False
        #: Children with both signs of a comment, by kind.
        self.threads: dict[tuple[str, str], list[Node]] | None = None


def named_cut(names: str) -> bool:
    """Whether a class or id tells of a menu, advert, notice or the like, and of nothing else."""
    tokens = names.split()
    if any(x.lower() in MAIN_NAMES for x in tokens):
        return False
    for token in tokens:
        if not _STATE_NAMES.match(token):
            words = [w.lower() for w in _WORDS.findall(token)]
            if any(w in CUT_WORDS for w in words) and all(w in CUT_WORDS or w in PLAIN_WORDS or w.isdigit() or len(w) == 1 for w in words):
                return True
    return False


def named_thread(names: str) -> bool:
    """Whether a class or id tells of a thread of comments."""
    return any(words[-1].endswith(THREADS) or "disqus" in words for token in names.split() if not _STATE_NAMES.match(token) and (words := [w.lower() for w in _WORDS.findall(token)]))


def _words_of(names: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(names)}


class Page:
    """Elements and runs of a page, from one pass over its markup. ``opened`` are the numbers of elements that are not cut though they look so."""

    def __init__(self, html: str, opened: frozenset[int] = frozenset()) -> None:
        self.opened, self.number = opened, 0
        #: Elements that were cut and may be opened, and raw tags of which no end follows.
        self.soft: list[Node] = []
        self.endless: set[str] = set()
        self.root = Node("html", None, False, "", 0)
        self.nodes, self.stack = [self.root], [self.root]
        #: Depths of the open elements by tag, of open blocks other than p, and of open cuts.
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.cuts: list[int] = []
        self.cut = self.in_link = 0
        self.texts: list[str] = []
        self.owners: list[Node] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.piece: list[str] = []
        self.sizes = [0, 0]
        self.read(html)
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        self.root.last = len(self.texts)

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = _MARKUP.search(html, at)
            if found is None:
                self.text(html[at:])
                return
            begin, kind = found.start(), found.group()
            if begin > at:
                self.text(html[at:begin])
            if kind == "<!--":
                end = _COMMENT_END.search(html, begin + 2)
                at = n if end is None else end.end()
            elif kind in ("<!", "<?", "</"):
                end = html.find(">", begin)
                at = n if end < 0 else end + 1
            else:
                closing = kind[1] == "/"
                name = _NAME.match(html, begin + 1 + closing)
                tag, at, attributes = name.group().lower(), name.end(), {}
                while at < n and html[at] != ">":
                    part = _ATTRIBUTE.match(html, at)
                    if part.end() == at:
                        at += 1
                        continue
                    at = part.end()
                    if part[1] and not closing:
                        attributes.setdefault(part[1].lower(), next((x for x in part.groups()[1:] if x is not None), ""))
                if at >= n:
                    return
                at += 1
                if closing:
                    self.end(tag)
                    continue
                self.start(tag, attributes)
                if tag in RAW and tag not in self.endless:
                    end = _RAW_ENDS[tag].search(html, at)
                    if end is not None:
                        at = end.start()
                    elif tag != "title":
                        return
                    else:
                        self.endless.add(tag)

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if len(data) < 40 and top.tag in ("a", "button", "span") and data.strip().lower() in REPLIES:
            top.signs |= 2
        if self.cut:
            if top.tag not in NO_PROSE and not self.open.get("label") and len(data) > 25:
                self.stack[self.cuts[-1]].held += len("".join(data.split()))
        else:
            data = unescape(data) if "&" in data else data
            self.piece.append(data)
            size = len("".join(data.split()))
            self.sizes[0] += size
            if self.in_link:
                self.sizes[1] += size

    def flush(self) -> None:
        if self.piece:
            if text := " ".join("".join(self.piece).split()):
                self.texts.append(text)
                self.owners.append(self.stack[max(self.blocks[-1:] + self.open.get("p", [])[-1:], default=0)])
                self.chars.append(self.sizes[0])
                self.linked.append(self.sizes[1])
            self.piece, self.sizes = [], [0, 0]

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "br" and not self.cut:
            self.piece.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in ("html", "body") and len(self.stack) == 1 and not attributes:
            return
        if tag in CLOSES_P:
            self.close("p", self.blocks)
        for other, stops in CLOSES.get(tag, ()):
            self.close(other, *(self.open.get(s, ()) for s in stops))
        names = unescape(f"{attributes.get('class', '')} {attributes.get('id', '')}".strip())
        self.number += 1
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        hard = tag in CUT_TAGS and tag not in LOOSE_CUTS or hidden
        soft = ""
        if not hard:
            named = bool(names) and tag not in ("html", "body", "article", "main")
            soft = "thread" if named and named_thread(names) else "tag" if tag in LOOSE_CUTS or attributes.get("role", "").lower() in CUT_ROLES else "name" if named and named_cut(names) else ""
        cut = hard or bool(soft) and self.number not in self.opened
        parent = self.stack[-1]
        node = Node(tag, parent, cut, names, len(self.stack))
        node.after, node.number, node.soft = self.cut, self.number, soft
        node.inside = bool(self.open.get("article") or self.open.get("main"))
        if cut and soft:
            self.soft.append(node)
        if tag == "time" or names and not SIGNED.isdisjoint(_words_of(names)):
            node.signs |= 1
        if names and not REPLIES.isdisjoint(_words_of(names)):
            node.signs |= 2
        if tag in BLOCKS and not self.cut:
            self.flush()
        if tag in ("article", "main") and not cut and self.cut and all(self.stack[d].tag in LOOSE_CUTS for d in self.cuts):
            self.cut = 0
        self.cut += cut
        if cut:
            self.cuts.append(node.depth)
        node.first = len(self.texts)
        if not self.cut:
            self.nodes.append(node)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(node.depth)
        if tag in BLOCKS and tag != "p":
            self.blocks.append(node.depth)
        if tag == "a" and not self.cut:
            self.in_link += 1
            node.links = 1

    def close(self, tag: str, *stops) -> None:
        """Close the innermost open ``tag`` unless a stop or a cut is nearer."""
        depths = self.open.get(tag)
        if depths and all(not s or s[-1] < depths[-1] for s in (*stops, self.cuts if tag != "head" else ())):
            self.pop_to(depths[-1])

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self.flush()
        elif depths := self.open.get(tag):
            self.pop_to(depths[-1])

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def pop(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCKS and not self.cut:
            self.flush()
        self.stack.pop()
        self.open[node.tag].pop()
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.pop()
        if node.cut:
            self.cuts.pop()
        if node.tag == "a" and node.links:
            self.in_link -= 1
        self.cut = node.after
        # A run that goes on past an inline element belongs to what is around it.
        node.last = len(self.texts)
        if node.parent is not None:
            node.parent.links += node.links
            node.parent.signs |= node.signs
            if node.signs == 3 and not node.cut and not self.cut and node.tag in BLOCKS and node.last > node.first:
                if node.parent.threads is None:
                    node.parent.threads = {}
                node.parent.threads.setdefault((node.tag, node.names.split(" ")[0]), []).append(node)


def _prose(text: str, linked: float) -> bool:
    return linked < 0.25 if len(text) > 80 else linked == 0 and bool(re.search(r"[.!?…。！？](?:\s|$)", text))


class Scores:
    """Sums over the runs of a page, so that any element's figures take one step."""

    def __init__(self, page: Page) -> None:
        self.page = page
        self.chars = [0, *accumulate(page.chars)]
        self.linked = [0, *accumulate(page.linked)]
        worth = []
        for text, owner, chars, linked in zip(page.texts, page.owners, page.chars, page.linked, strict=True):
            share = linked / chars if chars else 0.0
            prose = owner.tag == "p" and _prose(text, share) or owner.tag in TEXT_BOXES and len(text) > 25 and _prose(text, share)
            worth.append(int(prose or share <= 0.5 and owner.tag in ("article", "main", "pre", "blockquote", "h1")))
        for node in page.nodes:
            # A list or table tells of an article where it is not mostly links.
            if (node.tag in LISTS or node.tag == "table") and node.last > node.first and self.density(node) <= 0.5:
                worth[node.first] = 1
        self.worth = [0, *accumulate(worth)]

    def density(self, node: Node) -> float:
        n = self.chars[node.last] - self.chars[node.first]
        return (self.linked[node.last] - self.linked[node.first]) / n if n else 0.0

    def menu(self, node: Node) -> bool:
        """A list or box that is mostly links."""
        return node.tag in ("ul", "ol", "dl", "div", "section", "table") and self.density(node) > 0.6 and (node.links >= 3 or node.tag in LISTS)

    def best(self) -> Node | None:
        """The container with the most points, discounted by link density; the first of equal ones."""
        for text, owner in zip(self.page.texts, self.page.owners, strict=True):
            if owner.tag in ("p", "pre", "blockquote"):
                above = owner.parent
            elif owner.tag in TEXT_BOXES and owner is not self.page.root and len(text) > 25:
                above = owner
            else:
                continue
            points, share = 1.0 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3.0), 1.0
            for level in range(4):
                if above is None:
                    break
                if above.points is None:
                    above.points = TAG_POINTS.get(above.tag, 0.0) + (25.0 if above.names and _GOOD_NAMES.search(above.names) else 0.0)
                above.points += points * share
                above, share = above.parent, 1.0 / (2 + 1.5 * level)
        scored = [x for x in self.page.nodes if x.points is not None]
        return max(scored, key=lambda x: x.points * (1 - self.density(x)), default=None)

    def container(self, best: Node) -> Node:
        """The element whose runs make the text."""
        path = [best]
        while path[-1].parent is not None:
            path.append(path[-1].parent)
        marked = [i for i, x in enumerate(path) if x.tag in ("article", "main")]
        level = marked[-1] if marked else min(1, len(path) - 1)
        inner = self.worth[path[level].last] - self.worth[path[level].first]
        for i in range(level + 1, len(path)):
            around = self.worth[path[i].last] - self.worth[path[i].first]
            if around > inner:
                level, inner = i, around
        return path[level]


def read_page(html: str) -> Page:
    """A page with those of its menus, forms and named boxes open that hold its prose."""
    opened: frozenset[int] = frozenset()
    for _ in range(4):
        page = Page(html, opened)
        kept = sum(c - k for c, k in zip(page.chars, page.linked, strict=True))
        more = {x.number for x in page.soft if x.held > kept and _may_open(x, kept)} | {x.number for x in page.soft if _is_aside(page, x)}
        if not more:
            return page
        opened |= more
    return page


def _may_open(node: Node, kept: int) -> bool:
    if node.soft == "thread":
        return False
    if node.held > (HELD if node.soft == "tag" else HELD_NAMED):
        return True
    return node.inside and kept == 0 and node.held >= HELD_INSIDE


def _is_aside(page: Page, node: Node) -> bool:
    """A notice that stands between paragraphs of an article and has nothing to click."""
    if node.soft != "name" or node.links or not node.held or _words_of(node.names) - PLAIN_WORDS - ASIDES or node.parent.tag not in ("article", "main") or node.parent.cut:
        return False
    owners = [i for i in range(node.parent.first, node.parent.last) if page.owners[i].parent is node.parent and page.owners[i].tag == "p"]
    return bool(owners) and owners[0] < node.first <= owners[-1]


def threads(page: Page, best: Node | None) -> bytearray:
    """Runs in sibling blocks of one kind that each look like a reader's comment."""
    marked = bytearray(len(page.texts) + 1)
    for node in page.nodes:
        for kind in (node.threads or {}).values():
            if len(kind) > 1 and not any(x is best or best is not None and x.first <= best.first and best.last <= x.last and x.tag in ("article", "main") for x in kind):
                for x in kind:
                    for i in range(x.first, x.last):
                        marked[i] = 1
                # What is around the thread goes with it where it has only headings beside.
                for _ in range(3):
                    if node.parent is None or best is not None and node.first <= best.first and best.last <= node.last or not all(marked[i] or page.owners[i].tag in HEADINGS for i in range(node.first, node.last)):
                        break
                    for i in range(node.first, node.last):
                        marked[i] = 1
                    node = node.parent
    return marked


def extract_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = read_page(html)
    scores = Scores(page)
    best = scores.best()
    comments = threads(page, best)
    if best is None:
        return "\n\n".join(t for i, t in enumerate(page.texts) if not comments[i])
    container = scores.container(best)
    inside, dropped = bytearray(len(page.texts) + 1), bytearray(len(page.texts) + 1)
    reach = at = 0
    for node in sorted((x for x in page.nodes if x is best or x.tag in ("article", "main")), key=lambda x: x.first):
        for i in range(max(node.first, reach), node.last):
            inside[i] = 1
        reach = max(reach, node.last)
    for node in page.nodes:
        # Nodes come in page order, so what a menu holds is passed over.
        if node.first >= at and node is not container and scores.menu(node) and not inside[node.first] and not (node.first <= best.first and best.last <= node.last):
            for i in range(node.first, node.last):
                dropped[i] = not inside[i]
            at = node.last
    out = []
    for i in range(container.first, container.last):
        linky = page.owners[i].tag not in ITEMS and 2 * page.linked[i] > page.chars[i]
        if not comments[i] and (inside[i] or not dropped[i] and not linky):
            out.append(page.texts[i])
    return "\n\n".join(out)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page with its main text and the number of code points in it."""
    small_batches(pages)

    def run(batches):
        for batch in slices(batches, rows=1024, column=2, max_bytes=8 << 20):
            texts = [extract_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, SCHEMA)
