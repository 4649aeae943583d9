"""Main text of web pages by union-free wrappers, inferred per host.

A page is read as a stream of tokens: block elements opening and closing (an element's kind is its name
with the words of class and id, numbers as 0), and between them text lines. A wrapper is a union-free
regular expression over such streams (``expression`` prints it): elements that stand once, may be missing
(optional) or come again (repeated), and lines, which are fixed text or slots. The pages of a host are
aligned one after the other: elements of one kind below the same ones match, what one side lacks becomes
optional, what comes again repeated, and of the lines only those stay fixed that are the same on both.
These are sums, minima and intersections, so a wrapper doesn't depend on how pages are dealt to tasks,
and a host with very many pages costs a row per task.

The wrapper decides what is main text:

* Fixed lines are the host's, not the page's: they go where ``FIXED_PAGES`` pages or more have the
  element, and all have the line. They stay if the host has no other text (its pages are copies).
* Lists of links go: repeated elements outside ``article`` and ``main`` with little text but links.
* Elements that HTML or ARIA name as navigation, header of the body, footer, side bar, form, dialog,
  script, style or the like go. Words in class or id never decide alone: a block named as an advert,
  notice, comments and so on goes if the wrapper agrees, which is to say that it is outside the articles,
  or fixed, or mostly links, or optional, or holds a repeated group, or little text (or has one page only).
* The place of the text is the smallest container of all other slots; with ``main`` or ``article``
  elements, these. All lines in it that remain are returned, in blocks. A page without text there is
  judged by its own wrapper.

Defined results: null and empty pages have an empty text; null urls are the host ``''``. Repeated rows each
get their result, an empty table gives none, further columns are ignored whatever their names. Reading a
page takes time in proportion to its length, however it is cut off, nested or broken: unclosed and stray
tags are tolerated, an unfinished tag at the end is markup, an unclosed comment or script reaches to the
end of the page. Buttons, text areas and lists of options are parts of forms wherever they stand.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.arrow import bounded_batches, trimmed
from evenkeel.sources.scratch import materialise

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSHOWN = frozenset("head nav aside footer menu dialog fieldset template noscript select datalist button".split())
#: Of these, those that don't begin where none of them ends any more.
PAIRED = frozenset("template noscript select datalist button".split())
ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert menu menubar toolbar form".split())
#: Elements that can be the place of a host's text.
PLACES = frozenset("html body main article section div center form".split())
#: An open element of the second kind ends where one of the first begins.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("tr", "thead", "tbody"), "tfoot": ("tr", "tbody"), "option": ("option",), "button": ("button",), "select": ("select",)}
SCOPE = frozenset("ul ol dl table td th div section article main body aside nav form blockquote select".split())
#: Words of class or id, as a whole, of blocks that are no text if the wrapper agrees.
NAMED = frozenset("ad ads advert advertisement adsense sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments respond discussion disqus replies share sharing social related recommended newsletter subscribe signup login widget pagination pager toolbar".split())

#: Pages that must have an element before its lines can be fixed; kinds below an element that are told apart.
FIXED_PAGES, MOST_KINDS = 5, 200
#: Shares of an element's text: in links, fixed, and of the host's that is little.
LINKED, SAME, LITTLE = 0.8, 0.9, 0.1

# Each matches at a "<" whatever follows, reads every character once and has nothing to try again: a quote opens a value only
# after "=", and one that isn't closed is a character like others.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>?)""")
_MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_RAW_END = {name: re.compile(f"</{name}(?![a-zA-Z0-9-])[^>]*+>?", re.I) for name in RAW}


class Element:
    __slots__ = ("name", "key", "kids", "shown")

    def __init__(self, name: str, key: str, shown: bool = True):
        self.name, self.key, self.kids, self.shown = name, key, [], shown


def _kind(name: str, attributes: str) -> tuple[str, bool]:
    """Key of an element, and whether its role is one of text."""
    words, shown = set(), name not in UNSHOWN
    for m in _MARK.finditer(attributes) if "=" in attributes else ():
        own = (m[2] or m[3] or m[4] or "").lower().split()
        if m[1].lower() == "role":
            shown = shown and not ROLES.intersection(own)
        else:
            words.update(re.sub(r"\d+", "0", w) for w in own)
    return (f"{name}.{' '.join(sorted(words))}" if words else name), shown


def parse(page: str) -> Element:
    """The page's tree; kids are elements and strings (raw text, references not yet decoded)."""
    root = Element("html", "html")
    stack, at, size = [root], 0, len(page)
    opened: Counter = Counter()
    last_end: dict[str, int] = {}

    def close(i: int) -> None:
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]

    def ends(name: str) -> bool:
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(f"</{name}", page, re.I)), default=-1)
        return last_end[name] >= at

    while at < size:
        start = page.find("<", at)
        if start < 0:
            stack[-1].kids.append(page[at:])
            break
        if start > at:
            stack[-1].kids.append(page[at:start])
        m = _TAG.match(page, start)
        if m is None:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 1)
                at = end + 3 if end >= 0 else size
            elif page[at : at + 1] in ("!", "?", "/"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else size
            else:
                stack[-1].kids.append("<")
            continue
        at = m.end()
        if not m[4]:
            break  # the page ends inside a tag
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if name in RAW:
            stack[-1].kids.append(" ")
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name == "html" or name == "body" and opened["body"]:
            continue
        if name in VOID or m[3].endswith("/"):
            stack[-1].kids.append(Element(name, name))
            continue
        if name in PAIRED and not ends(name):
            continue
        if name in BLOCK and stack[-1].name == "head":
            close(len(stack) - 1)
        for kinds in ((("p",),) if name in BLOCK else ()) + ((CLOSES[name],) if name in CLOSES else ()):
            for i in range(len(stack) - 1, 0, -1) if any(opened[k] for k in kinds) else ():
                if stack[i].name in kinds:
                    close(i)
                    break
                if stack[i].name in SCOPE and stack[i].name not in kinds:
                    break
        e = Element(name, *(_kind(name, m[3]) if m[3] or name in UNSHOWN else (name, True)))
        if name == "header" and stack[-1].name in ("html", "body"):
            e.shown = False
        stack[-1].kids.append(e)
        stack.append(e)
        opened[name] += 1
    return root


def tokens(page: str) -> list[tuple]:
    """The page's stream: (key,) opens a block element, () closes it, (text, linked) is a line; what isn't shown is left out."""
    out: list[tuple] = []
    line: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if line:
            if words := html.unescape("".join(line)).split():
                text = " ".join(words)
                out.append((text, linked >= LINKED * len(text)))
            line.clear()
        linked = 0

    todo: list = [(parse(page), 0, False)]
    while todo:
        x, done, link = todo.pop()
        if isinstance(x, str):
            line.append(x)
            if link:
                linked += len(x)
            continue
        if done:
            flush()
            out.append(())
            continue
        if not x.shown:
            line.append(" ")
            continue
        if x.name in VOID:
            if x.name == "hr":
                flush()
            elif x.name == "br":
                line.append(" ")
            continue
        if x.name in BLOCK:
            flush()
            out.append((x.key,))
            todo.append((x, 1, link))
        link = link or x.name == "a"
        todo.extend((k, 0, link) for k in reversed(x.kids))
    flush()
    return out


class Node:
    """An element of a wrapper: pages that have it, its place among its neighbours (summed over these), its lines' characters and
    those in links, whether it comes again, lines common to all pages."""

    __slots__ = ("pages", "place", "chars", "links", "again", "texts", "kids")

    def __init__(self, pages: int = 1, place: int = 0, chars: int = 0, links: int = 0, again: bool = False, texts: dict | None = None):
        self.pages, self.place, self.chars, self.links, self.again = pages, place, chars, links, again
        self.texts: dict[int, int] = {} if texts is None else texts  # digest of a line to its length
        self.kids: dict[str, Node] = {}


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def fold(stream: list[tuple]) -> Node:
    """The wrapper of one page: elements of one kind below the same ones are one, repeated if they stand in one of these."""
    root = Node()
    at, seen = [root], [set()]
    for t in stream:
        if not t:
            at.pop()
            seen.pop()
        elif len(t) == 1:
            key = t[0]
            node = at[-1].kids.get(key)
            if node is None:
                node = at[-1].kids[key] = Node(place=len(seen[-1]))
            node.again |= key in seen[-1]
            seen[-1].add(key)
            at.append(node)
            seen.append(set())
        else:
            text, linked = t
            node = at[-1]
            node.chars += len(text)
            if linked:
                node.links += len(text)
            else:
                node.texts[digest(text)] = len(text)
    return root


def merge(a: Node, b: Node) -> Node:
    """``a`` becomes the wrapper that the pages of both match."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.pages, x.place, x.chars, x.links, x.again = x.pages + y.pages, x.place + y.place, x.chars + y.chars, x.links + y.links, x.again or y.again
        x.texts = {d: n for d, n in x.texts.items() if d in y.texts}
        for key, kid in y.kids.items():
            if key in x.kids:
                todo.append((x.kids[key], kid))
            else:
                x.kids[key] = kid
    return a


def bounded(root: Node) -> Node:
    """The wrapper, elements that have over ``MOST_KINDS`` kinds below them with their kinds' names only."""
    todo = [root]
    while todo:
        x = todo.pop()
        if len(x.kids) > MOST_KINDS:
            by_name: dict[str, Node] = {}
            for key, kid in sorted(x.kids.items()):
                name = key.partition(".")[0]
                if name in by_name:
                    by_name[name] = merge(by_name[name], kid)
                    by_name[name].again = True
                else:
                    by_name[name] = kid
            for kid in by_name.values():
                kid.pages = min(kid.pages, x.pages)
            x.kids = by_name
        todo.extend(x.kids.values())
    return root


def _preorder(root: Node) -> list[tuple[str, Node]]:
    out, todo = [], [("", root)]
    while todo:
        key, x = todo.pop()
        out.append((key, x))
        todo.extend(reversed(x.kids.items()))
    return out


def dumps(root: Node) -> str:
    """The wrapper as flat JSON: each node before its kids, with their number."""
    return json.dumps([[key, x.pages, x.place, x.chars, x.links, int(x.again), [*x.texts.items()], len(x.kids)] for key, x in _preorder(root)])


def loads(text: str) -> Node:
    done: list[tuple[str, Node]] = []
    for key, pages, place, chars, links, again, texts, n in reversed(json.loads(text)):
        x = Node(pages, place, chars, links, bool(again), dict(map(tuple, texts)))
        x.kids = dict(done.pop() for _ in range(n))
        done.append((key, x))
    return done[0][1]


def expression(root: Node) -> str:
    """The wrapper in the notation of regular expressions: ``?`` optional, ``+`` repeated, ``"fixed"`` and ``#`` lines."""
    out, todo = [], [("", root, 1, None)]
    while todo:
        key, x, pages, end = todo.pop()
        if end is not None:
            out.append(end)
            continue
        mark = ("+" if x.again else "") + ("?" if x.pages < pages else "")
        out.append(("(" if mark else "") + (f"<{key}>" if key else ""))
        fixed = sum(x.texts.values()) * x.pages
        out.append(('"fixed"' if x.texts and x.pages > 1 else "") + ("#" if x.chars > (fixed if x.pages > 1 else 0) else ""))
        todo.append((key, x, pages, (f"</{key.partition('.')[0]}>" if key else "") + (f"){mark}" if mark else "")))
        todo.extend((k, kid, x.pages, None) for k, kid in sorted(x.kids.items(), key=lambda i: (i[1].place / i[1].pages, i[0]), reverse=True))
    return "".join(out)


#: What becomes of an element's lines.
OUTSIDE, TEXT, GONE = 0, 1, 2


def guide(root: Node) -> list[list]:
    """What the wrapper says of each element, in preorder: key, verdict, fixed lines that go, number of kids."""
    every = _preorder(root)
    n = len(every)
    up, depth_end = [-1] * n, [n] * n
    number = {id(x): i for i, (_, x) in enumerate(every)}
    for i, (_, x) in enumerate(every):
        for kid in x.kids.values():
            up[number[id(kid)]] = i
    for i in range(n - 1, 0, -1):  # kids come after their parents
        depth_end[i] = i + 1 if not every[i][1].kids else depth_end[number[id([*every[i][1].kids.values()][-1])]]
    names = [key.partition(".")[0] for key, _ in every]
    fixed = [sum(x.texts.values()) * x.pages if x.pages >= FIXED_PAGES else 0 for _, x in every]

    def summed(own: list[int]) -> list[int]:
        total = list(own)
        for i in range(n - 1, 0, -1):
            total[up[i]] += total[i]
        return total

    chars, links, same = summed([x.chars for _, x in every]), summed([x.links for _, x in every]), summed(fixed)
    declared = [False] * n
    for i in range(1, n):
        declared[i] = declared[up[i]] or names[i] in ("article", "main")
    has_declared = any(d and every[i][1].chars > every[i][1].links + fixed[i] for i, d in enumerate(declared))
    gone = [False] * n
    for i in range(1, n):
        key, x = every[i]
        if gone[up[i]]:
            gone[i] = True
            continue
        words = set(key.partition(".")[2].split())
        if names[i] == "form":
            gone[i] = 2 * chars[i] <= chars[0]
        elif NAMED & words and names[i] not in ("html", "body", "article", "main"):
            repeats = x.again or any(k.again for k in x.kids.values())
            optional = x.pages < every[up[i]][1].pages
            little = chars[i] < LITTLE * chars[0]
            gone[i] = has_declared and not declared[i] or same[i] >= SAME * chars[i] or 2 * links[i] >= chars[i] or repeats or optional or little or root.pages == 1
        elif not declared[i] and links[i] >= LINKED * chars[i] > 0:
            gone[i] = x.again or any(k.again for k in x.kids.values())
    slots = [0 if g else max(0, x.chars - x.links - f) for (_, x), f, g in zip(every, fixed, gone)]
    if not any(slots):  # copies of one page, or links only: nothing tells fixed text from other
        fixed, slots = [0] * n, [0 if g else x.chars for (_, x), g in zip(every, gone)]
    main = [False] * n
    for i in range(1, n):
        main[i] = main[up[i]] or names[i] == "main"
    if any(s for s, m in zip(slots, main) if m):
        slots = [s if m or d and names[i] != "main" else 0 for i, (s, m, d) in enumerate(zip(slots, main, declared))]
    total = summed(slots)
    at = max((i for i in range(n) if total[i] == total[0]), default=0) if total[0] else 0
    path = []
    while at >= 0:
        path.append(at)
        at = up[at]
    path.reverse()
    of = [names[i] for i in path]
    for name in ("article", "main"):
        if name in of:
            path = path[: of.index(name) + 1]
            break
    else:
        path = path[: max((k for k, name in enumerate(of) if name in PLACES), default=0) + 1]
    place = path[-1]
    above = set(path[:-1])
    out = []
    for i, (key, x) in enumerate(every):
        verdict = OUTSIDE if i in above else GONE if gone[i] or not place <= i < depth_end[place] else TEXT
        out.append([key, verdict, sorted(x.texts) if verdict == TEXT and fixed[i] else [], len(x.kids)])
    return out


class Guide:
    """A guide as a tree, to walk along with a page."""

    __slots__ = ("verdict", "fixed", "kids")

    def __init__(self, verdict: int, fixed: frozenset = frozenset()):
        self.verdict, self.fixed = verdict, fixed
        self.kids: dict[str, Guide] = {}

    @classmethod
    def of(cls, rows: list[list]) -> Guide:
        done: list[tuple[str, Guide]] = []
        for key, verdict, fixed, n in reversed(rows):
            x = cls(verdict, frozenset(fixed))
            x.kids = dict(done.pop() for _ in range(n))
            done.append((key, x))
        return done[0][1]


_INSIDE, _BESIDE = Guide(TEXT), Guide(GONE)


def lines(stream: list[tuple], root: Guide) -> list[str]:
    at, out = [root], []
    for t in stream:
        if not t:
            at.pop()
        elif len(t) == 1:
            x = at[-1]
            kid = x.kids.get(t[0]) or x.kids.get(t[0].partition(".")[0])
            at.append(kid or (_INSIDE if x.verdict == TEXT else _BESIDE))
        elif at[-1].verdict == TEXT and not (at[-1].fixed and digest(t[0]) in at[-1].fixed):
            out.append(t[0])
    return out


def main_text(stream: list[tuple], root: Guide | None) -> str:
    found = lines(stream, root) if root else []
    return "\n\n".join(found or lines(stream, Guide.of(guide(fold(stream)))))


HOSTS_HELD, LINES_HELD = 500, 200_000


def host(url: str) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON) of each host, from all of its pages."""
    bounded_batches(pages.sparkSession)

    def rows(held: dict[str, Node]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([dumps(bounded(w)) for w in held.values()], pa.string())], ["host", "wrapper"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        size = 0
        for b in batches:
            for u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stream, h = tokens(x or ""), host(u)
                w = fold(stream)
                size += len(stream)
                held[h] = merge(held[h], w) if h in held else w
                if len(held) > HOSTS_HELD or size > LINES_HELD:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = None, Node(0)
        for b in batches:
            for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h == at:
                    w = bounded(merge(w, loads(x)))
                    continue
                if at is not None:
                    yield rows({at: w})
                at, w = h, loads(x)
        if at is not None:
            yield rows({at: w})

    parts = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(trimmed(infer), "host string, wrapper string")
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(trimmed(unite), "host string, wrapper string")


#: Bytes of guides that are broadcast; beyond it pages are joined by host, dealt over salts.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: ``id_col``, url, text, n_chars."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(guide(loads(x))) for x in b.column(1).to_pylist()], pa.string())], ["host", "guide"])

    guides = materialise(wrappers(pages, url_col, html_col).mapInArrow(trimmed(decide), "host string, guide string"))
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), name.alias("host"))
    if (guides.agg(F.sum(F.length("guide") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(guides), "host", "left")
    else:
        salted = guides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Guide] = {}
        for b in batches:
            text = []
            for x, g in zip(b.column("html").to_pylist(), b.column("guide").to_pylist()):
                if g is not None and g not in known:
                    if len(known) > HOSTS_HELD:
                        known.clear()
                    known[g] = Guide.of(json.loads(g))
                text.append(main_text(tokens(x or ""), known[g] if g is not None else None))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    out = rows.select("id", "url", "html", "guide").mapInArrow(trimmed(run), f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)
