"""Main text of HTML pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, half as many at
each level; a container's points are discounted by its link density. Where the page marks
its text as <article> or <main>, those that hold prose are the best containers, and only
paragraphs and headings beside them are kept. Elsewhere the text of all that stands beside the best
container is kept, level by level, up to where links prevail.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
GONE = frozenset("head script style noscript template iframe object svg canvas audio video button select option textarea input nav footer aside menu dialog title link meta annotation annotation-xml".split())
BLOCK = frozenset("html address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element's start tag ends: a paragraph any block, others their own kind within a list or table.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
#: Words that mark what may be no main text where a class or id token is one of them or ends in one; of reader comments likewise.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidenav aside menu nav navbar navigation topnav breadcrumb breadcrumbs pagination pager footer foot masthead toolbar share sharing social related recommended recommendations trending login search skip notice notices".split()
)
COMMENTS = frozenset("comment comments commentlist respond response responses replies disqus opinions reactions discussion guestbook".split())
#: Those that count outside an article only.
SOFT = frozenset("banner alert widget widgets toc".split())
#: Those that may as well be an article's subject: inside one they count for elements of links, or without a sentence.
SUBJECTS = frozenset("promotion consent overlay subscription aside menu navigation share sharing social related recommended recommendations trending login search skip".split())
#: Those of comments that may be: inside an article they count only for elements that are lists of comments.
TALKS = COMMENTS - {"comment", "comments", "commentlist", "disqus", "guestbook"}
#: Words of layout, which may follow in a token.
LAYOUT = frozenset("area bar block body bottom box button buttons center column container content field footer form group header holder icons inner item items left link links list main module outer panel posts primary row secondary section slot slots top unit units wrap wrapper".split())
#: Words of class tokens by which an element tells who wrote a comment, and when.
WHO = frozenset("author byline by user username name nick nickname commenter poster cite avatar vcard fn".split())
WHENS = frozenset("date time timestamp datetime posted published ago when meta".split())
#: Words that turn a token into a statement about the page: has-sidebar, no-ads, comments-open.
STATES = frozenset("has have no non not with without is are open opened closed on off enabled disabled hide hidden show layout page".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
SAFE = frozenset("html body article main".split())

TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>""")
LOOSE_TAG = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>[^>]*+)>")
ATTR = re.compile(r"""(?P<k>class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?P<v>"[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
START = re.compile("<(?=[!?]|/?[A-Za-z])")
WHITE = re.compile(r"\s+")
#: How a comment's first line tells when it was written, and who wrote it.
WHEN = re.compile(r"\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago\b")
SAYS = re.compile(r"\b(?:says|said|wrote|writes|replied|commented)\b")
#: Characters of a comment's first line, or of its author's or time's element, at most.
SIGNED = 60
#: Nodes of a block among which its first line is looked for.
HEAD = 200
#: Characters of prose beside reader comments that make a page more than these.
LEAST = 25


class Node:
    __slots__ = ("name", "parent", "children", "gone", "score", "chars", "linked", "prose", "titles", "suspect", "talk", "near", "inside", "shape", "words")

    def __init__(self, name: str, parent: Node | None, gone: bool = False):
        self.name, self.parent, self.gone = name, parent, gone
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked, self.prose, self.titles = 0.0, 0, 0, 0, 0
        #: "" or why the node may be no main text: "noise" or "comments".
        self.suspect, self.near, self.inside, self.shape = "", 0, False, ""
        #: Whether the suspicion needs the proof of links or of a list of comments.
        self.talk, self.words = False, frozenset()


def _text(s: str) -> str:
    """Character references decoded; numbers too long for any character are replaced."""
    if "&#" in s:
        s = re.sub(r"&#[0-9]{8,};?", "�", re.sub(r"&#0+(?=[0-9])", "&#", s))
    return unescape(s)


def _words(token: str) -> list[str]:
    return re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())


def _marks(token: str) -> str:
    """The word that a class or id token ends in, but for words of layout and numbers; "" for statements about the page."""
    low, words = token.lower(), _words(token)
    if low in NOISE or low in COMMENTS or low in SOFT:
        return low
    if not STATES.isdisjoint(words):
        return ""
    while len(words) > 1 and (words[-1] in LAYOUT or not words[-1] or words[-1].isdigit()):
        words.pop()
    return words[-1]


def _judge(node: Node, attrs: str) -> None:
    """Sets gone, suspect, words and shape of a node from its name, place and attributes."""
    name = node.name
    node.gone = name in GONE or (name == "header" and not node.inside)  # an article's own header holds its title
    if name == "form":
        node.suspect = "noise"
    if not attrs or node.gone:
        return
    for m in ATTR.finditer(attrs):
        key, value = m["k"].lower(), (m["v"] or "").strip("\"'")
        low = value.lower()
        if key == "class":
            node.shape = low
        if key in ("class", "itemprop"):
            node.words = node.words.union(_words(value))
        if name in SAFE:
            continue
        if key == "hidden" or (key == "aria-hidden" and low == "true") or (key == "role" and low in ROLES) or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low)):
            node.gone = True
        elif key in ("class", "id"):
            for word in map(_marks, value.split()):
                if word in COMMENTS:
                    node.suspect, node.talk = "comments", node.inside and word in TALKS
                elif (word in NOISE or (word in SOFT and not node.inside)) and not node.suspect:
                    node.suspect, node.talk = "noise", node.inside and word in SUBJECTS


class _Open:
    """The open elements while a page is read, with the depths of each name."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], defaultdict(list)

    def close(self, depth: int) -> None:
        """Closes all elements from a depth on."""
        while len(self.stack) > max(1, depth):
            self.depths[self.stack.pop().name].pop()

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        node.near = depth if node.name in BLOCK else self.stack[-1].near
        self.depths[node.name].append(depth)
        self.stack.append(node)

    def end(self, name: str) -> None:
        """An end tag: of no open element it does nothing, nor does one of inline kind outside the block it stands in."""
        if self.depths[name]:
            depth = self.depths[name][-1]
            if name in BLOCK or name == "a" or depth > self.stack[-1].near:
                self.close(depth)

    def make_room(self, name: str) -> None:
        """Closes what a start tag ends."""
        if name in BLOCK:
            block = self.stack[self.stack[-1].near]
            if block.name == "p" or (block.name in HEADING and name in HEADING):
                self.close(self.stack[-1].near)
        if name in ENDS:
            ended, stops = (x.split() for x in ENDS[name])
            stop = max((self.depths[s][-1] for s in stops if self.depths[s]), default=0)
            above = [d[bisect_right(d, stop)] for d in map(self.depths.__getitem__, ended) if d and d[-1] > stop]
            if above:
                self.close(min(above))


def parse(html: str) -> Node:
    """A tree without what is never shown; left-open elements are closed where HTML closes them.

    Every scan for an end that isn't there is made once, so time is linear in the page.
    """
    root = Node("html", None)
    open_, at, raw, tag = _Open(root), 0, "", TAG
    ends = {"]]>": True, "-->": True, ">": True}

    def find(mark: str, start: int) -> int:
        place = html.find(mark, start) if ends[mark] else -1
        ends[mark] = place >= 0
        return place

    while at < len(html):
        node = open_.stack[-1]
        if raw:
            stop = re.compile(f"</{raw}(?=[\\s/>])", re.I).search(html, at)
            end = stop.start() if stop else len(html)
            if node.name == raw and not node.gone:
                node.children.append(_text(html[at:end]))
            at, raw = end, ""
            continue
        begin = START.search(html, at)
        start = begin.start() if begin else len(html)
        if start > at and not node.gone:
            node.children.append(_text(html[at:start]))
        at = start
        if at == len(html):
            break
        if html.startswith("<!--", at):
            end = find("-->", at + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        if html.startswith("<![CDATA[", at) and (end := find("]]>", at)) >= 0:
            if not node.gone:
                node.children.append(html[at + 9 : end])
            at = end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = find(">", at)
            at = end + 1 if end >= 0 else len(html)
            continue
        m = tag.match(html, at)
        if m is None and tag is TAG:
            tag = LOOSE_TAG  # a quote is never closed: from here on tags end at the next >
            m = tag.match(html, at)
        if m is None:  # nor is this tag
            if not node.gone:
                node.children.append(_text(html[at:]))
            break
        at = m.end()
        name = m["name"].lower()
        if m["end"]:
            open_.end(name)
        elif name in ("html", "body"):
            if name == "body" and open_.depths["head"]:
                open_.close(open_.depths["head"][-1])
        elif name in ("br", "wbr"):
            if name == "br" and not node.gone:
                node.children.append(" ")
        else:
            open_.make_room(name)
            node = open_.stack[-1]
            child = Node(name, node)
            child.inside = node.inside or name in ("article", "main")
            if not node.gone:
                _judge(child, m["attrs"])
            child.gone = child.gone or node.gone
            if not child.gone and (name not in VOID or name == "hr"):
                node.children.append(child)
            if name not in VOID:
                open_.push(child)
                if name in RAW and not m["attrs"].endswith("/"):
                    raw = name
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    order.reverse()
    return order


def _measure(order: list[Node]) -> None:
    """Fills in characters, linked characters, characters of prose, titles and points."""
    for node in order:
        node.score, node.chars, node.linked, node.prose, node.titles = 0.0, 0, 0, 0, 0
    for node in order:
        own, commas = 0, 0
        for c in node.children:
            if isinstance(c, str):
                text = WHITE.sub(" ", c).strip()
                own += len(text)
                node.chars += len(text)
                commas += sum(map(text.count, ",،、，;"))
            else:
                node.chars += c.chars
                node.linked += c.linked
                node.prose += c.prose
                node.titles += c.titles
                if c.name not in BLOCK:
                    own += c.chars
        if node.name == "a":
            node.linked = node.chars
        node.titles += node.name == "h1" or node.name == "main"
        if own and node.name in BLOCK and node.name not in HEADING:
            read = 1 - node.linked / max(1, node.chars)
            node.prose += own * (read > 0.5)
            points = (1 + commas + min(own / 100, 3.0)) * read
            up = node.parent if node.name in ("p", "li", "td", "pre", "blockquote", "dd", "dt") and node.parent is not None else node
            up.score += points
        if node.parent is not None:
            node.parent.score += node.score / 2


def _kids(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def _head(node: Node) -> tuple[str, bool, bool]:
    """The text before a block's first paragraph, up to a line's length, and whether elements in it tell who and when."""
    out, who, when, stack = "", False, False, list(reversed(node.children))
    for _ in range(HEAD):
        if not stack or len(out) > SIGNED:
            break
        c = stack.pop()
        if isinstance(c, str):
            out += c
            continue
        if c.name == "p" and (out.strip() or who or when):
            break
        short = 0 < c.chars <= SIGNED
        when = when or c.name == "time" or (short and not WHENS.isdisjoint(c.words))
        who = who or c.name == "cite" or (short and not WHO.isdisjoint(c.words))
        stack.extend(reversed(c.children))
    return WHITE.sub(" ", out).strip(), who, when


def _signed(node: Node) -> bool:
    """Whether a block begins with who wrote it and when: by elements for them, by "wrote" and a time, or, outside an article, by a short line with a name and a time of its own."""
    line, who, when = _head(node)
    timed = when or WHEN.search(line)
    if len(line) > SIGNED or not timed:
        return False
    if who or (SAYS.search(line) and not (node.name == "li" and node.inside)):
        return True
    more = node.chars > len(line) + 1 and any(c.name in BLOCK for c in _kids(node))
    return not node.inside and more and any(x.isalpha() for x in WHEN.sub("", line))


def _thread(node: Node) -> bool:
    """Whether a node is a list of comments: several blocks of one shape, most of them signed."""
    items = [c for c in _kids(node) if c.name in ("div", "li", "article", "section", "blockquote", "dd") and c.prose]
    if len(items) < 2 or Counter((c.name, c.shape) for c in items).most_common(1)[0][1] < 2:
        return False
    return sum(map(_signed, items)) > len(items) / 2


def _settle(root: Node, order: list[Node]) -> None:
    """Takes the suspects out of the tree, but never one that holds the page's text.

    Reader comments go where a sentence stands outside the suspects. Other suspects stay where they hold the title,
    or most of the prose with little outside; what is suspect inside them is judged in turn.
    """
    for node in order:
        if node.talk and node.suspect == "noise":
            node.suspect = "noise" if 2 * node.linked > node.chars or node.prose < LEAST else ""
        if node.talk or not node.suspect:
            talk = node.name not in SAFE and _thread(node)
            node.suspect = "comments" if talk else "" if node.suspect == "comments" else node.suspect
    waiting, held = [], [root]
    while held:
        for c in _kids(held.pop()):
            (waiting if c.suspect else held).append(c)
    dropped = sum(c.prose for c in waiting)
    while waiting:
        node = waiting.pop()
        outside = root.prose - dropped
        if node.suspect == "comments":
            stays = node.prose > 0 and (outside < LEAST or node.titles > 0)
        else:
            stays = node.prose > 0 and (node.titles > 0 or (2 * node.prose > root.prose and 4 * outside < node.prose))
        if not stays:
            node.gone = True
            continue
        dropped -= node.prose
        held = [node]
        while held:
            for c in _kids(held.pop()):
                if c.suspect:
                    waiting.append(c)
                    dropped += c.prose
                else:
                    held.append(c)
    for node in order:
        if any(c.gone for c in _kids(node)):
            node.children = [c for c in node.children if isinstance(c, str) or not c.gone]


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _menu(node: Node) -> bool:
    return node.name in ("ul", "ol", "div", "section", "table", "dl", "p") and node.chars > 0 and node.linked > 0.8 * node.chars and len(_kids(node)) > 1


def _prose(node: Node) -> bool:
    if node.name not in BLOCK or node.name in HEADING or not node.chars or _density(node) >= 0.5:
        return False
    return node.name in ("p", "li", "td", "dd", "pre", "blockquote") or any(isinstance(c, str) and c.strip() for c in node.children)


def _blocks(node: Node, out: list[list[str]], skip: frozenset[int] | set[int] = frozenset(), lists: bool = True) -> None:
    """Texts of the blocks below node in page order, without the nodes to skip; an iterative walk, as trees may be deep.

    Unless `lists`, lists of links go that come before all prose, as menus do.
    """
    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif id(item) in skip or (not lists and item is not node and _menu(item)):
            out.append([])
        else:
            lists = lists or _prose(item)
            if item.name in BLOCK:
                out.append([])
                stack.append(None)
            stack.extend(reversed(item.children))


def _around(best: Node) -> tuple[Node, set[int]]:
    """The highest ancestor up to which text rather than links stands beside best, and the nodes below it that are mostly links."""
    top, skip, node = best, set(), best
    while (parent := node.parent) is not None:
        others = [c for c in _kids(parent) if c is not node and c.chars]
        chars = sum(c.chars for c in others) + sum(len(c.strip()) for c in parent.children if isinstance(c, str))
        if top is not best and 2 * sum(c.linked for c in others) > chars:
            break
        if chars:
            top = parent
            skip.update(id(c) for c in others if c.name not in HEADING and (_density(c) >= 0.5 or _menu(c)))
        node = parent
    return top, skip


def _marked(root: Node, best: Node) -> list[Node]:
    """The articles that the page marks, in page order: the only one with prose, or the one around the best container with
    those beside it that hold prose; elsewhere on the page those that hold half as much as it."""
    found, held = [], [root]
    while held:
        for c in reversed(_kids(held.pop())):
            if c.name in ("article", "main"):
                found += [c] if c.prose else []
            else:
                held.append(c)
    while len(found) == 1 and found[0].name == "main":
        inner, held = [], [found[0]]
        while held:
            for c in reversed(_kids(held.pop())):
                (inner if c.name == "article" and c.prose else held).append(c)
        if len(inner) != 1 or 2 * inner[0].prose < found[0].prose:
            break
        found = inner
    if len(found) == 1:
        return found
    known, up = {id(c) for c in found}, best
    while up is not None and id(up) not in known:
        up = up.parent
    if up is None:
        return []
    order = {id(c): k for k, c in enumerate(_order(root))}
    more = [c for c in found if c is up or (_density(c) < 0.5 and (c.parent is up.parent or 2 * c.prose >= up.prose))]
    return sorted(more, key=lambda c: order[id(c)])


def main_text(html: str | None) -> str:
    """The main text: blocks in page order joined by newlines, white space in a block single; empty if none."""
    if not html:
        return ""
    root = parse(html)
    order = _order(root)
    _measure(order)
    _settle(root, order)
    order = _order(root)
    _measure(order)
    containers = [n for n in order if n.name in BLOCK and n.name not in ("p", "li", "td", "th", "tr", "dt", "dd", "pre", *HEADING)]
    best = max(containers, key=lambda n: n.score * (1 - _density(n)), default=root)
    if best.score <= 0:
        best = root
    out: list[list[str]] = [[]]
    marked = _marked(root, best)
    chosen = {id(c) for c in marked}
    if not marked:
        top, skip = _around(best)
        _blocks(top, out, skip, lists=False)
    for parent in dict.fromkeys(c.parent for c in marked):
        for c in parent.children:
            paragraph = not isinstance(c, str) and (c.name in HEADING or c.name == "p") and _density(c) < 0.25
            if paragraph or id(c) in chosen:
                out.append([])
                _blocks(c, out)
    lines = (WHITE.sub(" ", "".join(b)).strip() for b in out)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text (the main text) and n_chars (its code points), a row for each input row.

    pages needs html; all other columns but text and n_chars stay. Null or empty html,
    and pages without main text, give an empty text. Broken markup is read as far as it
    goes, in time linear in the page and at any depth. Repeated rows give equal texts; an
    empty table an empty result. Nothing is shuffled; a task holds a few MB of pages, or one.
    """
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    df = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = [main_text(b.decode(errors="replace")) for b in piece.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    out = df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "text", "n_chars")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
